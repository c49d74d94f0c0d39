"""Quality rules: log-likelihood ratio of hashed n-grams, trusted target against the raw corpus.

Two multinomials over hashed byte n-grams (one to three bytes, so word endings, symbols and case all count)
are estimated with add-one smoothing: one from the trusted documents, one from all documents. A document's score is the
mean log ratio of its n-grams, so it does not depend on its length. Every document at or above the threshold is kept.

Null texts count as empty; an empty text has score 0 and no words, and so fails the base rules. With no
trusted document at all both multinomials are taken as equal, and every score is 0. Repeated rows are
judged row by row. Columns of the input with the name of a result column give way to it.
"""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.llm.batches import add_columns, bounded_broadcast

BUCKETS = 1 << 16
#: Mean log ratio (nats per n-gram) below which a document is rejected.
THRESHOLD = -0.3
#: A labelled table up to this many trusted rows is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 500_000
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

VERDICT = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "llr double, base_failed boolean, kept boolean"
)
_SPACE = bytes([0x20, *range(0x09, 0x0E)])
_NOT_COUNTED = _SPACE + bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"


def buckets_of(data: np.ndarray) -> list[np.ndarray]:
    """Buckets of the 1-, 2- and 3-byte grams that start at each place of a byte row."""
    x = data.astype(np.uint32)
    out = []
    for n in (1, 2, 3):
        m = max(0, len(x) - n + 1)
        h = np.full(m, n, np.uint32)
        for k in range(n):
            h = h * np.uint32(16777619) + x[k : m + k]
        h = h * np.uint32(2654435769)
        out.append(h >> np.uint32(16))
    return out


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer(b"".join(texts), np.uint8), offsets


def _valid(offsets: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which gram starts lie inside one document."""
    ok = np.ones(max(0, total - n + 1), bool)
    for back in range(1, n):
        at = offsets[1:-1] - back
        ok[at[(at >= 0) & (at < len(ok))]] = False
    return ok


def ngram_counts(docs: DataFrame, trusted: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Counts of each bucket over all documents and over the trusted ones; at most BUCKETS rows.

    Partial counts leave each task once, so the shuffle has at most BUCKETS rows per task.
    """
    marks = trusted.select(F.col(key).alias("_key")).where("_key IS NOT NULL").distinct().withColumn("_trusted", F.lit(True))
    marks = bounded_broadcast(marks, BROADCAST_ROWS)
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("text")).join(marks, "_key", "left").select("_trusted", "text")

    def count(batches):
        import pyarrow as pa

        from paddock.llm.batches import slices, texts_of

        raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = texts_of(part.column(1))
                flags = [bool(x) for x in part.column(0).to_pylist()]
                for want, into in ((False, raw), (True, good)):
                    data, offsets = _joined([t for t, f in zip(texts, flags, strict=True) if f == want])
                    for n, h in enumerate(buckets_of(data), 1):
                        into += np.bincount(h[_valid(offsets, n, len(data))], minlength=BUCKETS)
        raw += good
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(raw[at]), pa.array(good[at])], names=["bucket", "n_raw", "n_target"])

    parts = rows.mapInArrow(count, "bucket int, n_raw bigint, n_target bigint")
    return parts.groupBy("bucket").agg(F.sum("n_raw").alias("n_raw"), F.sum("n_target").alias("n_target"))


def log_ratios(counts: DataFrame) -> np.ndarray:
    """One weight per bucket. The table has at most BUCKETS rows, whatever the input."""
    raw, good = np.ones(BUCKETS), np.ones(BUCKETS)
    for r in counts.collect():
        raw[r.bucket] += r.n_raw
        good[r.bucket] += r.n_target
    if good.sum() == BUCKETS:
        return np.zeros(BUCKETS)
    return (np.log(good / good.sum()) - np.log(raw / raw.sum()))


def _repeat_words(words: list[list[bytes]]) -> np.ndarray:
    """Words that lie in a window of WINDOW words found twice or more in its document."""
    sizes = np.array([len(w) for w in words], np.int64)
    total = int(sizes.sum())
    if total < WINDOW:
        return np.zeros(len(words), np.int64)
    doc = np.repeat(np.arange(len(words)), sizes)
    ids = np.fromiter((hash(w) for ws in words for w in ws), np.int64, total).view(np.uint64)
    m = total - WINDOW + 1
    h = np.zeros(m, np.uint64)
    for k in range(WINDOW):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + ids[k : m + k]
    h = (h ^ (h >> np.uint64(32))) + doc[:m].astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    inside = np.flatnonzero(doc[:m] == doc[WINDOW - 1 :])
    order = inside[np.argsort(h[inside], kind="stable")]
    same = (h[order[1:]] == h[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    hit = np.zeros(len(order), bool)
    hit[1:] |= same
    hit[:-1] |= same
    at = order[hit]
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return np.bincount(doc, weights=np.cumsum(edge[:-1]) > 0, minlength=len(words)).astype(np.int64)


def _dup_lines(text: bytes) -> int:
    if b"\n" not in text:
        return 0
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def _mean_ratio(texts: list[bytes], weights: np.ndarray) -> np.ndarray:
    data, offsets = _joined(texts)
    total, grams = np.zeros(len(texts)), np.zeros(len(texts))
    for n, h in enumerate(buckets_of(data), 1):
        sums = np.concatenate([[0.0], np.cumsum(weights[h])])
        a = np.minimum(offsets[:-1], len(h))
        b = np.clip(offsets[1:] - n + 1, a, len(h))
        total += sums[b] - sums[a]
        grams += b - a
    return np.where(grams > 0, total / np.maximum(grams, 1), 0.0)


def judge(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """`docs` with the base counts, the mean log ratio and the verdict of every row. No shuffle."""

    def columns(texts: list[bytes]) -> dict:
        words = [t.split() for t in texts]
        n = np.array([len(w) for w in words], np.int64)
        repeat = _repeat_words(words)
        llr = np.round(_mean_ratio(texts, weights), 6)
        failed = (n < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n)
        return {
            "n_words": n,
            "word_chars": [len(t.translate(None, _NOT_COUNTED)) for t in texts],
            "n_symbols": [len(t) - len(t.translate(None, _SYMBOLS)) for t in texts],
            "n_dup_lines": [_dup_lines(t) for t in texts],
            "n_repeat_words": repeat,
            "llr": llr,
            "base_failed": failed,
            "kept": ~failed & (llr >= threshold),
        }

    return add_columns(docs, columns, VERDICT, text)


def quality_rules(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Judge every document of `docs`; `trusted` names the documents of the target by `key`."""
    return judge(docs, log_ratios(ngram_counts(docs, trusted, text, key)), threshold, text)
