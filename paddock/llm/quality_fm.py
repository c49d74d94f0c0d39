"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

    z(x) = w0 + sum_i w_i x_i + 1/2 sum_f [ (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2 ],   score = 1 / (1 + exp(-z))

The bracket is the pairwise sum over all i < j of <v_i, v_j> x_i x_j, in time linear in a document's features. Features: distinct words
hashed to WORDS buckets (equal weights, unit length together), one bin per structure statistic, and one bin of the metadata column
`n_chars`. Labels, language, source and key are never features.

The model learns from about FIT_ROWS labelled documents at most (chosen by a hash of the key) in one task; all documents
are scored where they lie, without a shuffle. Null texts count as empty and are scored from their structure. A null n_chars,
or a table without that column, has a bin of its own. Without labels of both kinds every score is the share
of good labels (0.5 if there are none). Repeated rows are scored alike.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.llm.batches import map_texts, word_hashes
from paddock.llm.mixing import sample

WORDS = 1 << 15
RANK = 6
FIT_ROWS = 12_000
EPOCHS = 4
RATE = 0.1
L2 = 1e-5
#: score at or above which a document is predicted good.
CUT = 0.3
HELD_OUT = 5

_RATIOS = np.array([0.0005, 0.005, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9])
_BINS = len(_RATIOS) + 2
STATS = ("symbols", "capitals", "digits", "bars", "marks", "distinct", "repeats", "dup_lines", "word_length", "lines", "size", "n_chars")
SIZE = WORDS + len(STATS) * _BINS + 1
_STAT_WEIGHT = 0.5


def statistics(text: bytes, words: list[bytes], distinct: set, n_chars) -> list[float]:
    """Structure of a text, each between 0 and 1, -1 where it doesn't exist."""
    n, k = len(text), len(words)
    if n == 0:
        return [-1.0] * 11 + [-1.0 if n_chars is None else min(1.0, np.log10(1 + max(0, n_chars)) / 7)]
    share = lambda chars: 1 - len(text.translate(None, chars)) / n
    lines = [x for x in text.split(b"\n") if x.strip()]
    return [
        share(b"#*$%&"), share(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), share(b"0123456789"), share(b"|<>"), share(b"!?"),
        len(distinct) / k if k else -1.0,
        sum(map(bytes.__eq__, words[1:], words)) / k if k else -1.0,
        1 - len(set(lines)) / len(lines) if lines else -1.0,
        min(1.0, n / k / 25) if k else 1.0,
        min(1.0, 5 * len(lines) / k) if k else -1.0,
        min(1.0, np.log10(1 + n) / 7),
        -1.0 if n_chars is None else min(1.0, np.log10(1 + max(0, n_chars)) / 7),
    ]


def features(texts: list[bytes], n_chars: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices and values of all documents in a row, and the number of features of each."""
    bags, stats = [], []
    for t, c in zip(texts, n_chars, strict=True):
        words = t.split()
        bag = set(words)
        bags.append(bag)
        stats.append(statistics(t, words, bag, c))
    sizes = np.array([len(b) for b in bags], np.int64)
    hashed = (word_hashes([w for b in bags for w in b]) * np.uint32(2654435769) >> np.uint32(17)).astype(np.int64)
    stats = np.array(stats)
    bins = np.where(stats < 0, 0, 1 + np.searchsorted(_RATIOS, stats, "right"))
    fixed = np.concatenate([WORDS + np.arange(len(STATS)) * _BINS + bins, np.full((len(texts), 1), SIZE - 1)], axis=1)
    total = sizes + fixed.shape[1]
    ends = np.cumsum(total)
    idx, val = np.empty(int(total.sum()), np.int64), np.empty(int(total.sum()), np.float32)
    tail = (ends[:, None] - fixed.shape[1] + np.arange(fixed.shape[1])).ravel()
    head = np.ones(len(idx), bool)
    head[tail] = False
    idx[tail], idx[head] = fixed.ravel(), hashed
    val[tail] = np.tile(np.append(np.full(len(STATS), _STAT_WEIGHT), 1.0), len(texts))
    val[head] = np.repeat(1 / np.sqrt(np.maximum(1, sizes)), sizes)
    return idx, val, total


def machine(idx: np.ndarray, val: np.ndarray, sizes: np.ndarray, w: np.ndarray, v: np.ndarray):
    """z of each document, and the sums over its features that the gradient needs too. The bias is the last weight of `w`."""
    starts = np.cumsum(sizes) - sizes
    x = v[idx] * val[:, None]
    sums = np.add.reduceat(x, starts)
    z = np.add.reduceat(w[idx] * val, starts) + 0.5 * (sums**2 - np.add.reduceat(x * x, starts)).sum(axis=1)
    return z, sums


def train(idx, val, sizes, y, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Logistic loss, Adagrad over mini-batches in a fixed random order."""
    rng = np.random.default_rng(seed)
    w, v = np.zeros(SIZE), rng.normal(0, 0.02, (SIZE, RANK))
    v[SIZE - 1] = 0
    gw, gv = np.full(SIZE, 1e-4), np.full((SIZE, RANK), 1e-4)
    ends = np.cumsum(sizes)
    rows = [(idx[e - n : e], val[e - n : e]) for e, n in zip(ends, sizes, strict=True)]
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for s in range(0, len(order), 64):
            at = order[s : s + 64]
            i, x, n = np.concatenate([rows[k][0] for k in at]), np.concatenate([rows[k][1] for k in at]), sizes[at]
            z, sums = machine(i, x, n, w, v)
            error = np.repeat((1 / (1 + np.exp(-z)) - y[at]) / len(at), n)
            dv = error[:, None] * (x[:, None] * np.repeat(sums, n, axis=0) - v[i] * (x * x)[:, None])
            ids, back = np.unique(i, return_inverse=True)
            a, b = np.bincount(back, error * x, len(ids)), np.zeros((len(ids), RANK))
            for f in range(RANK):
                b[:, f] = np.bincount(back, dv[:, f], len(ids))
            a += L2 * w[ids]
            b += L2 * v[ids]
            b[ids == SIZE - 1] = 0
            gw[ids] += a * a
            gv[ids] += b * b
            w[ids] -= RATE * a / np.sqrt(gw[ids])
            v[ids] -= RATE * b / np.sqrt(gv[ids])
    return w, v


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    has = dict(docs.dtypes).get("n_chars", "") in ("bigint", "int", "smallint", "tinyint", "double", "float")
    n = F.col("n_chars").cast("double") if has else F.lit(None).cast("double")
    return docs.select(F.col(key).cast("bigint").alias("_key"), F.col(text).alias("text"), n.alias("_n"))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", rows: int = FIT_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the machine from labelled rows (columns `key` and `quality`)."""
    marked = labels.where(F.col(key).isNotNull() & F.col("quality").isin(0, 1)).select(F.col(key).cast("bigint").alias("_key"), F.col("quality").cast("int").alias("y"))
    # A key with two labels takes the lower one.
    marked = sample(marked.groupBy("_key").agg(F.min("y").alias("y")), rows, "_key")
    found = _rows(docs, key, text).join(F.broadcast(marked), "_key")

    def encode(part, texts):
        idx, val, sizes = features(texts, part.column(1).to_pylist())
        ends = np.cumsum(sizes)
        yield {"y": part.column(0), "_key": part.column(2), "idx": [idx[e - n : e].astype(np.int32).tobytes() for e, n in zip(ends, sizes, strict=True)],
               "val": [val[e - n : e].tobytes() for e, n in zip(ends, sizes, strict=True)]}

    coded = map_texts(found, encode, "y int, _key bigint, idx binary, val binary", ["y", "_n", "_key"])

    def learn(batches):
        y, idx, val = [], [], []
        for b in batches:
            y += b.column(0).to_pylist()
            idx += [np.frombuffer(x, np.int32) for x in b.column(2).to_pylist()]
            val += [np.frombuffer(x, np.float32) for x in b.column(3).to_pylist()]
        y = np.array(y, float)
        w, v = np.zeros(SIZE), np.zeros((SIZE, RANK))
        if 0 < y.sum() < len(y):
            w, v = train(np.concatenate(idx), np.concatenate(val), np.array([len(x) for x in idx]), y)
        elif len(y):
            p = (y.sum() + 1) / (len(y) + 2)
            w[SIZE - 1] = np.log(p / (1 - p))
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()]), pa.array([v.tobytes()])], names=["w", "v"])

    got = coded.repartition(1).sortWithinPartitions("_key", "idx").mapInArrow(learn, "w binary, v binary").collect()
    if not got:
        return np.zeros(SIZE), np.zeros((SIZE, RANK))
    return np.frombuffer(bytes(got[0].w)).copy(), np.frombuffer(bytes(got[0].v)).reshape(SIZE, RANK).copy()


def scored(docs: DataFrame, w: np.ndarray, v: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of every row of `docs`."""
    w, v = w.astype(np.float32), v.astype(np.float32)

    def run(part, texts):
        z, _ = machine(*features(texts, part.column(1).to_pylist()), w, v)
        yield {"doc_id": part.column(0), "score": np.round(1 / (1 + np.exp(-z.astype(np.float64))), 6)}

    return map_texts(_rows(docs, key, text), run, "doc_id bigint, score double", ["_key", "_n"])


def held_out(key: str = "doc_id"):
    """Rows that no model learns from: crc32 of the key as text, modulo HELD_OUT, is 0. Null keys are not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % HELD_OUT == 0, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    w, v = fit(docs, labels.where(~held_out(key)), key, text)
    rows = scored(docs, w, v, key, text)
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
