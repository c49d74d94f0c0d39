"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are case-folded, split at ASCII white space and freed of punctuation at both ends. Each benchmark item is cut into segments;
the rare n-grams of a segment are its seeds. Documents are searched for seeds through a bit table of fixed
size, hits become passages, passages join segments on the seed, and each (passage, segment) pair is aligned.
The score of a pair is the alignment score over the segment's score against itself, so edited, shortened and
re-ordered-at-the-edges copies still score. A document is contaminated if any segment reaches the threshold.

An n-gram is rare if at most RARE_ITEMS items hold it and it isn't one word repeated; a segment without any
rare n-gram keeps all of its n-grams. Items shorter than an n-gram have no seed and match nothing. Null texts
count as empty. Repeated rows are searched row by row and keep their own rows of the result. Null keys are kept.
"""

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paddock.llm.batches import bit_table, in_table, map_texts, ngram_hashes, word_hashes
from paddock.session import cut

SEED_WORDS = 3
RARE_ITEMS = 3
#: Score of an alignment, as a share of the segment's own, at which a document is contaminated.
THRESHOLD = 0.55
MATCH, MISMATCH, GAP = 2, -1, -1
SEGMENT = 64
#: Words kept on both sides of a hit, and the longest passage (longer runs of hits are cut with an overlap).
MARGIN = 80
PASSAGE = 512
#: log2 of the bits in the table that filters hits before the join.
FILTER_BITS = 24
_EDGE = b".,;:!?\"'()[]{}*|<>#$%&"


def plain_words(text: bytes) -> list[bytes]:
    return [w for w in (x.strip(_EDGE) for x in text.decode("utf-8", "replace").casefold().encode().split()) if w]


def _segments(n: int) -> list[tuple[int, int]]:
    if n <= SEGMENT + SEGMENT // 2:
        return [(0, n)]
    starts = list(range(0, n - SEGMENT // 2, SEGMENT // 2))
    return [(a, min(n, a + SEGMENT)) for a in starts]


def seed_table(benchmark: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item, segment, words, seed): one row per rare n-gram of each segment."""

    def cut_up(part, texts):
        ids = part.column(0).to_pylist()
        out = {"item_id": [], "segment": [], "words": [], "seed": [], "plain": []}
        for item, t in zip(ids, texts, strict=True):
            h = word_hashes(plain_words(t))
            for k, (a, b) in enumerate(_segments(len(h))):
                w = h[a:b]
                grams = ngram_hashes(w, SEED_WORDS).view(np.int64)
                one = np.array([len(set(w[i : i + SEED_WORDS].tolist())) == 1 for i in range(len(grams))], bool)
                for g, p in {int(g): bool(p) for g, p in zip(grams, one, strict=True)}.items():
                    for name, v in zip(out, (item, k, w.tobytes(), g, p), strict=True):
                        out[name].append(v)
        yield out

    rows = map_texts(benchmark.select(F.col(key).cast("bigint").alias("item_id"), F.col(text).alias("text")), cut_up,
                     "item_id bigint, segment int, words binary, seed bigint, plain boolean", ["item_id"])
    items = rows.groupBy("seed").agg(F.count_distinct("item_id").alias("n_items"))
    rows = rows.join(items, "seed")
    rare = ~F.col("plain") & (F.col("n_items") <= RARE_ITEMS)
    any_rare = F.max(rare).over(Window.partitionBy("item_id", "segment"))
    return rows.withColumn("_rare", rare).withColumn("_any", any_rare).where("_rare OR NOT _any").select("item_id", "segment", "words", "seed")


def seed_filter(seeds: DataFrame) -> np.ndarray:
    """Which seeds may exist, as a bit table."""
    return bit_table(seeds.select(F.shiftrightunsigned("seed", 64 - FILTER_BITS).alias("slot")), FILTER_BITS)


def passages(docs: DataFrame, table: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, start, words, seeds): stretches of documents around n-grams that may be seeds."""
    shift = np.uint64(64 - FILTER_BITS)

    def find(part, texts):
        ids = part.column(0).to_pylist()
        out = {"_key": [], "start": [], "words": [], "seeds": []}
        words = [plain_words(t) for t in texts]
        flat = word_hashes([w for ws in words for w in ws])
        ends = np.cumsum([len(w) for w in words])
        grams = ngram_hashes(flat, SEED_WORDS)
        hits = in_table(table, grams >> shift)
        doc = np.searchsorted(ends, hits, "right")
        inside = hits + SEED_WORDS <= ends[doc] if len(hits) else hits
        hits, doc = (hits[inside], doc[inside]) if len(hits) else (hits, doc)
        first = 0
        for i in range(1, len(hits) + 1):
            if i < len(hits) and doc[i] == doc[first] and hits[i] - hits[i - 1] <= MARGIN // 2 and hits[i] - hits[first] < PASSAGE - 2 * MARGIN:
                continue
            d = int(doc[first])
            low, high = int(ends[d]) - len(words[d]), int(ends[d])
            a, b = max(low, int(hits[first]) - MARGIN), min(high, int(hits[i - 1]) + SEED_WORDS + MARGIN)
            out["_key"].append(ids[d])
            out["start"].append(a - low)
            out["words"].append(flat[a:b].tobytes())
            out["seeds"].append(np.unique(grams[hits[first:i]]).view(np.int64).tolist())
            first = i
        yield out

    return map_texts(docs.select(F.col(key).cast("bigint").alias("_key"), F.col(text).alias("text")), find,
                     "_key bigint, start bigint, words binary, seeds array<bigint>", ["_key"])


def align(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smith-Waterman scores of (segment, passage) pairs of word hashes, as a share of the segment's own score.

    All pairs of a call advance together, one segment word at a time. Within a row the best gap that ends at
    each place is a running maximum, as gaps cost the same for every word.
    """
    if not pairs:
        return np.zeros(0)
    n = len(pairs)
    rows, cols = max(len(a) for a, _ in pairs), max(len(b) for _, b in pairs)
    a, b = np.full((n, rows), -1, np.int64), np.full((n, cols), -2, np.int64)
    for i, (x, y) in enumerate(pairs):
        a[i, : len(x)], b[i, : len(y)] = x, y
    ramp = np.arange(1, cols + 1, dtype=np.int32) * -GAP
    last = np.zeros((n, cols + 1), np.int32)
    best = np.zeros(n, np.int32)
    for r in range(rows):
        step = np.where(b == a[:, r : r + 1], MATCH, MISMATCH).astype(np.int32)
        x = np.maximum(np.maximum(last[:, :-1] + step, last[:, 1:] + GAP), 0)
        x = np.maximum.accumulate(x + ramp, axis=1) - ramp
        last = np.concatenate([np.zeros((n, 1), np.int32), x], axis=1)
        best = np.maximum(best, x.max(axis=1))
    return best / (MATCH * np.array([max(1, len(x)) for x, _ in pairs]))


def aligned(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """(doc, item, score): the best alignment of each pair that shares a seed."""
    seeds = cut(seed_table(benchmark, item, text))
    found = cut(passages(docs, seed_filter(seeds), key, text))
    # The words travel only with pairs that exist: first match seeds, then fetch both sides' words.
    hits = found.select("_key", "start", F.col("words").alias("passage"), F.explode("seeds").alias("seed"))
    matched = hits.join(seeds, "seed")
    pairs = matched.groupBy("_key", "start", "passage", "item_id", "segment", "words").agg(F.count(F.lit(1)).alias("n_seeds"))

    def score(batches):
        import pyarrow as pa

        for batch in batches:
            names = batch.schema.names
            a = [np.frombuffer(x, np.uint32) for x in batch.column(names.index("words")).to_pylist()]
            b = [np.frombuffer(x, np.uint32) for x in batch.column(names.index("passage")).to_pylist()]
            out = np.zeros(len(a))
            order = np.lexsort(([len(x) for x in b], [len(x) for x in a]))
            for i in range(0, len(order), 512):
                at = order[i : i + 512]
                out[at] = align([(a[j], b[j]) for j in at])
            yield pa.RecordBatch.from_arrays(
                [batch.column(names.index("_key")), batch.column(names.index("item_id")), pa.array(np.round(out, 9))], names=["_key", "item_id", "score"])

    scored = pairs.select("_key", "item_id", "words", "passage").mapInArrow(score, "_key bigint, item_id bigint, score double")
    return scored.groupBy("_key", "item_id").agg(F.max("score").alias("score"))


def contamination(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text",
                  item: str = "item_id") -> DataFrame:
    """(doc_id, items, best_item, score) of every document with an item at or above the threshold.

    `items` lists all such items in order; ties for the best go to the smaller item.
    """
    hits = aligned(docs, benchmark, key, text, item).where(F.col("score") >= threshold)
    return hits.groupBy("_key").agg(
        F.sort_array(F.collect_set("item_id")).alias("items"),
        F.min(F.struct((-F.col("score")).alias("s"), F.col("item_id").alias("i"))).alias("b"),
    ).select(F.col("_key").alias("doc_id"), "items", F.col("b.i").alias("best_item"), (-F.col("b.s")).alias("score"))
