"""Document fingerprints: MinHash over word shingles, bands of signatures joined in Spark, Jaccard similarity verified.

A text's shingles are its distinct runs of five words (A-Z lower-cased, split at ASCII white space); a text of one to
four words is one shingle. PERMUTATIONS universal hashes x -> a x + b (mod 2**64, a odd) permute the shingles' 64-bit hashes; the
minimum under each, cut to 16 bits, is one value of the fingerprint. The share of equal values of two fingerprints estimates the
Jaccard similarity of the texts. A text without words has an empty fingerprint: like another empty one (1), unlike all others (0).

* `fingerprinted` also compares every text with an edited copy that ends in the beginning of the next document, and with that next
  document. Documents are range-partitioned in descending order of id; a task streams its range and keeps one text, and only the first and
  the last text of every range meet again, in a join of as many rows as there are ranges. Texts travel compressed.
* `near_classes` joins documents. Copies (equal word sequences) become one node. Every run of ROWS values is a band, and rows of equal
  bands form a bucket. First each bucket's hub, the node that shares its buckets with most others, is compared with all other nodes in it, by
  exact Jaccard similarity of their shingle sets: one comparison per row, however large the bucket, in slices of about SLICE. That settles nearly
  all buckets: their nodes are in one class. In those that stay live, nodes outside their group's largest class are compared with all nodes of
  the group, block by block inside tasks; a block holds at most BLOCK_NODES nodes and about BLOCK_WORDS words. Only a spanning set
  of links leaves a task, never pairs. So no two nodes that share a bucket stay uncompared but those already in one class.

Two texts at the threshold of 0.8 share no bucket with probability (1 - 0.8**5)**24, below 1 in 10,000.

Defined cases. Null texts count as empty. Null ids sort after all others; equal ids are ordered by a hash of the text, and rows equal in both
stand side by side in any order (each is the next of the one before). One document is its own next. Documents without words are in
a class of their own. Texts of any length are read whole, one at a time. An empty table gives no rows. Columns other than id
and text are not read.
"""

import hashlib

import numpy as np
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paddock.llm.batches import bounded_broadcast, emit, map_texts, ngram_hashes, slices, tokens_in
from paddock.llm.components import components
from paddock.llm.ngram_join import _linked as linked_pairs
from paddock.session import cut

SHINGLE = 5
#: Similarity of a link, as a fraction of two integers, so that the test is exact.
THRESHOLD = (4, 5)
BANDS, ROWS = 24, 5
PERMUTATIONS = BANDS * ROWS
#: A block of a group holds at most so many nodes, and about so many words.
BLOCK_NODES, BLOCK_WORDS = 800, 1_000_000
#: Nodes compared with a hub in one task, about.
SLICE = 2000
#: Tables of ids up to this many rows are broadcast.
LIST_ROWS = 1_000_000
#: Shingles permuted at once: small enough for a processor's cache.
_BLOCK = 1 << 16

_RNG = np.random.default_rng(20250607)
_A = _RNG.integers(0, 1 << 63, PERMUTATIONS, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, PERMUTATIONS, np.uint64) * np.uint64(2) + _RNG.integers(0, 2, PERMUTATIONS, np.uint64)


def shingles(text: bytes) -> tuple[np.ndarray, bytes | None]:
    """64-bit hashes of a text's shingles, repeated ones too, and a 128-bit name of its word sequence."""
    words = tokens_in(text)
    if not words:
        return np.zeros(0, np.uint64), None
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    return ngram_hashes(h, min(SHINGLE, len(words))), xxhash.xxh3_128_digest(h.tobytes())


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """16-bit MinHash values of every set, one row each; the row of an empty set is meaningless."""
    out = np.zeros((len(sets), PERMUTATIONS), np.uint64)
    i = 0
    while i < len(sets):
        j, n = i, 0
        while j < len(sets) and (j == i or n + len(sets[j]) <= _BLOCK):
            n += len(sets[j])
            j += 1
        full = [k for k in range(i, j) if len(sets[k])]
        if full:
            low = np.full((PERMUTATIONS, len(full)), ~np.uint64(0))
            lengths = np.array([len(sets[k]) for k in full])
            x = np.concatenate([sets[k] for k in full])
            starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            # a longer text is one set, permuted piece by piece
            pieces = range(0, len(x), _BLOCK) if len(full) == 1 else [0]
            for c in pieces:
                y, at = (x[c : c + _BLOCK], [0]) if len(full) == 1 else (x, starts)
                z = np.empty_like(y)
                for p in range(PERMUTATIONS):
                    np.multiply(y, _A[p], out=z)
                    z += _B[p]
                    np.minimum(low[p], np.minimum.reduceat(z, at), out=low[p])
            out[full] = low.T
        i = j
    # a minimum's high bits are mostly zero: mix them into those that are kept
    return (((out ^ (out >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(48)).astype(np.uint16)


def likeness(a: np.ndarray, a_empty: np.ndarray, b: np.ndarray, b_empty: np.ndarray) -> np.ndarray:
    """Share of equal values of fingerprints, row by row."""
    return np.where(a_empty | b_empty, (a_empty & b_empty).astype(float), (a == b).mean(axis=1) if len(a) else 0.0)


def edited(text: str, following: str) -> str:
    """`text` with its last half (rounded down) replaced by as much of the beginning of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_ROW = "doc_id bigint, fp bigint, n_chars bigint, edited_hash binary, node binary, signature binary, edited_signature binary, near_edited double, near_next double"


def _compared(ids: list, fps: list, texts: list[str], following: list[str], own, nexts) -> dict:
    """Columns of _ROW for texts and their next ones; `own` and `nexts` are (signatures, names)."""
    (sig, names), (next_sig, next_names) = own, nexts
    changed = [edited(a, b).encode("utf-8", "replace") for a, b in zip(texts, following, strict=True)]
    found = [shingles(t) for t in changed]
    new = signatures([x for x, _ in found])
    empty, gone = np.array([x is None for x in names], bool), np.array([x is None for _, x in found], bool)
    return {
        "doc_id": ids, "fp": fps, "n_chars": [len(t) for t in texts], "edited_hash": [hashlib.sha256(t).digest() for t in changed], "node": names,
        "signature": [b"" if e else s.tobytes() for s, e in zip(sig, empty, strict=True)],
        "edited_signature": [b"" if e else s.tobytes() for s, e in zip(new, gone, strict=True)],
        "near_edited": likeness(sig, empty, new, gone), "near_next": likeness(sig, empty, next_sig, np.array([x is None for x in next_names], bool)),
    }


def _signed(texts: list[bytes]) -> tuple[np.ndarray, list]:
    found = [shingles(t) for t in texts]
    return signatures([x for x, _ in found]), [name for _, name in found]


def _packed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, fp, salt, zip): compressed texts, dealt out in descending order of id and sorted; the salt cuts runs of equal rows."""
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("fp"), F.monotonically_increasing_id().alias("salt"), F.col(text).alias("text"))

    def run(part, texts):
        press = zstandard.ZstdCompressor(level=3)
        yield {"doc_id": part.column(0).to_pylist(), "fp": part.column(1).to_pylist(), "salt": part.column(2).to_pylist(), "zip": [press.compress(t) for t in texts]}

    order = [F.col("doc_id").desc_nulls_last(), F.col("fp").desc(), F.col("salt").desc()]
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = map_texts(rows, run, "doc_id bigint, fp bigint, salt bigint, zip binary", ["doc_id", "fp", "salt"])
    return rows.repartitionByRange(ranges, *order).withColumn("part", F.spark_partition_id()).sortWithinPartitions(*order)


def fingerprinted(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row of _ROW and a unique `rid` per document; written."""
    full = T.StructType.fromDDL(_ROW + ", part int, edge string, zip binary")
    names = [f.name for f in full]

    def run(batches):
        load = zstandard.ZstdDecompressor().decompress
        last = None  # the row whose next one is still to come
        for batch in batches:
            for piece in slices(batch, "zip"):
                ids, fps, _, zips, parts = (piece.column(k).to_pylist() for k in range(5))
                raw = [load(z) if z else b"" for z in zips]
                sig, own = _signed(raw)
                texts = [t.decode("utf-8", "replace") for t in raw]
                if last is None:
                    yield emit({n: [None] for n in names} | {"part": [parts[0]], "edge": ["first"], "zip": [zips[0]]}, full)
                else:
                    ids, fps, zips, texts = [last[0], *ids], [last[1], *fps], [last[2], *zips], [last[3], *texts]
                    sig, own = np.concatenate([last[4], sig]), [last[5], *own]
                n = len(ids) - 1
                if n:
                    out = _compared(ids[:-1], fps[:-1], texts[:-1], texts[1:], (sig[:-1], own[:-1]), (sig[1:], own[1:]))
                    yield emit(out | {"part": [parts[0]] * n, "edge": [None] * n, "zip": [None] * n}, full)
                last = (ids[-1], fps[-1], zips[-1], texts[-1], sig[-1:], own[-1], parts[0])
        if last is not None:
            yield emit({n: [None] for n in names} | {"doc_id": [last[0]], "fp": [last[1]], "part": [last[6]], "edge": ["last"], "zip": [last[2]]}, full)

    rows = cut(_packed(docs, key, text).mapInArrow(run, full))
    # Two rows per range: the last text of a range is followed by the first of the next range with rows, the very last by the very first.
    firsts = rows.where("edge = 'first'").select("part", F.col("zip").alias("following"))
    order = Window.orderBy("part")
    after = rows.where("edge = 'first'").select("part").withColumn("then", F.lead("part").over(order))
    after = after.select(F.col("part").alias("p"), F.coalesce("then", F.min("part").over(Window.partitionBy())).alias("then"))
    ends = rows.where("edge = 'last'").select("doc_id", "fp", "part", "zip").join(F.broadcast(after), F.col("part") == F.col("p")).select("doc_id", "fp", "zip", "then")
    ends = ends.join(firsts, F.col("then") == F.col("part")).select("doc_id", "fp", "zip", "following")
    fields = T.StructType.fromDDL(_ROW)

    def close(batches):
        load = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for i in range(batch.num_rows):
                doc, fp, a, b = (batch.column(k)[i].as_py() for k in range(4))
                a, b = (load(x) if x else b"" for x in (a, b))
                yield emit(_compared([doc], [fp], [a.decode("utf-8", "replace")], [b.decode("utf-8", "replace")], _signed([a]), _signed([b])), fields)

    closed = ends.mapInArrow(close, fields)
    done = rows.where("edge IS NULL").select(*[f.name for f in fields]).unionByName(closed)
    return cut(done.withColumn("rid", F.monotonically_increasing_id()))


def buckets_of(marks: DataFrame) -> DataFrame:
    """(bucket, rid): one row per band; `marks` has rid and signature."""
    fields = T.StructType.fromDDL("bucket bigint, rid bigint")

    def run(batches):
        for batch in batches:
            rid, sig = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for i in range(0, len(sig), 4096):
                x = np.frombuffer(b"".join(sig[i : i + 4096]), np.uint16).reshape(-1, BANDS, ROWS).astype(np.uint64)
                h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), x.shape[:2]).copy()
                for r in range(ROWS):
                    h = (h ^ x[:, :, r]) * np.uint64(0x9E3779B97F4A7C15)
                    h ^= h >> np.uint64(29)
                yield emit({"bucket": h.ravel().view(np.int64), "rid": np.repeat(rid[i : i + 4096], BANDS)}, fields)

    return marks.select("rid", "signature").mapInArrow(run, fields)


def _texts_of(docs: DataFrame, marks: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """`wanted` (one row per rid) with the documents' texts."""
    wanted = cut(wanted.join(marks.select("rid", F.col("doc_id").alias("_k"), F.col("fp").alias("_f")), "rid"))
    rows = docs.select(F.col(key).cast("bigint").alias("_key"), F.xxhash64(text).alias("fp"), F.col(text).alias("text"))
    return rows.join(bounded_broadcast(wanted, LIST_ROWS), (F.col("fp") == F.col("_f")) & F.col("_key").eqNullSafe(F.col("_k"))).drop("_key", "fp", "_k", "_f")


_LINK = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def hub_links(docs: DataFrame, marks: DataFrame, pairs: DataFrame, threshold: tuple[int, int], key: str, text: str) -> DataFrame:
    """(a, b) of the pairs (hub, rid) whose shingle sets have a Jaccard similarity at or above the threshold; exact."""
    parts = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / SLICE).cast("int").alias("parts"))
    parts = bounded_broadcast(cut(parts), LIST_ROWS)
    # a place is a hub's slice, and 0 for the hub itself: it comes first
    place = lambda part, side: F.struct("hub", part.alias("part"), F.lit(side).alias("side"))
    ends = pairs.join(parts, "hub").select("rid", place(F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int"), 1).alias("p"))
    hubs = parts.select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("k")).select(F.col("hub").alias("rid"), place(F.col("k"), 0).alias("p"))
    wanted = ends.unionByName(hubs).groupBy("rid").agg(F.collect_list("p").alias("p"))
    wanted = wanted.select("rid", *[F.col("p")[c].cast("array<bigint>").alias(c) for c in ("hub", "part", "side")])
    rows = _sets(_texts_of(docs, marks, wanted, key, text), ["hub", "part", "side"])
    top, bottom = threshold

    def compare(batches):
        now, hub_set, done = None, None, None
        for batch in batches:
            found = {"a": [], "b": []}
            for hub, part, side, rid, s in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                x = np.frombuffer(s, np.uint64)
                if (hub, part) != now:
                    now, hub_set, done = (hub, part), x, rid
                if side == 0 or rid == done:
                    continue  # the hub, or a repeated row
                done = rid
                if min(len(x), len(hub_set)) * bottom >= max(len(x), len(hub_set)) * top:
                    both = len(np.intersect1d(x, hub_set, assume_unique=True))
                    if both * bottom >= (len(x) + len(hub_set) - both) * top:
                        found["a"].append(hub)
                        found["b"].append(rid)
            yield emit(found, _LINK)

    return rows.repartition("hub", "part").sortWithinPartitions("hub", "part", "side", "rid").mapInArrow(compare, _LINK)


def _sets(rows: DataFrame, places: list[str]) -> DataFrame:
    """(*places, rid, set): shingle sets of texts, once for each of the places in the array columns."""

    def run(part, texts):
        cols = [part.column(i).to_pylist() for i in range(len(places) + 1)]
        out = {c: [] for c in [*places, "rid", "set"]}
        for *at, rid, t in zip(*cols, texts, strict=True):
            s = np.unique(shingles(t)[0]).tobytes()
            for c, x in zip(places, at, strict=True):
                out[c] += x
            out["rid"] += [rid] * len(at[0])
            out["set"] += [s] * len(at[0])
        yield out

    return map_texts(rows, run, ", ".join(f"{c} bigint" for c in places) + ", rid bigint, set binary", [*places, "rid"])


def block_links(docs: DataFrame, marks: DataFrame, live: DataFrame, threshold: tuple[int, int], key: str, text: str) -> DataFrame:
    """(a, b): a spanning set of the links between nodes of different classes that `live` (bucket, rid, label) puts in one group."""
    firsts = live.groupBy("bucket").agg(F.min("rid").alias("a"))
    groups = components(live.join(bounded_broadcast(cut(firsts), LIST_ROWS), "bucket").select("a", F.col("rid").alias("b")))
    nodes = live.select("rid", "label").distinct().join(groups.select(F.col("node").alias("rid"), F.col("label").alias("grp")), "rid")
    nodes = cut(nodes.join(marks.select("rid", (F.col("n_chars") / 6).alias("words")), "rid"))
    classes = nodes.groupBy("grp", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("words").alias("words"))
    total = classes.groupBy("grp").agg(F.max_by(F.struct("label", "n", "words"), "n").alias("most"), F.sum("n").alias("n"), F.sum("words").alias("words"))
    blocks = lambda n, words: F.ceil(F.greatest(n / BLOCK_NODES, words / BLOCK_WORDS)).cast("int")
    total = total.select("grp", F.col("most.label").alias("largest"), blocks(F.col("n"), F.col("words")).alias("ys"),
                         F.greatest(blocks(F.col("n") - F.col("most.n"), F.col("words") - F.col("most.words")), F.lit(1)).alias("xs"))
    nodes = nodes.join(bounded_broadcast(cut(total), LIST_ROWS), "grp")
    at = lambda n: F.pmod(F.xxhash64("rid"), n).cast("int")
    each = lambda n: F.sequence(F.lit(0), n - 1)
    unit = lambda x, y, side: F.struct(x.cast("bigint").alias("x"), y.cast("bigint").alias("y"), F.lit(side).cast("bigint").alias("side"))
    as_y = F.transform(each(F.col("xs")), lambda x: unit(x, at(F.col("ys")), 1))
    as_x = F.when(F.col("label") != F.col("largest"), F.transform(each(F.col("ys")), lambda y: unit(at(F.col("xs")), y, 0)))
    units = F.concat(as_y, F.coalesce(as_x, F.slice(as_y, 1, 0)))
    wanted = nodes.select("rid", F.array_repeat("grp", F.size(units)).alias("grp"), *[units[c].alias(c) for c in ("x", "y", "side")])
    rows = _sets(_texts_of(docs, marks, wanted, key, text), ["grp", "x", "y", "side"])

    def spanning(held):
        """Links between sides of a unit, as (root, node)."""
        left = {r: s for side, r, s in held if side == 0}
        right = {r: s for side, r, s in held if side == 1}
        names = [*left, *right]
        number = {r: i for i, r in enumerate(dict.fromkeys(names))}
        i, j = linked_pairs([*left.values(), *right.values()], threshold, len(left)) if left and right else ([], [])
        a, b = (np.array([number[names[k]] for k in x], np.int64) for x in (i, j))
        root = np.arange(len(number))
        while True:
            before = root.copy()
            np.minimum.at(root, a, root[b])
            np.minimum.at(root, b, root[a])
            root = root[root]
            if (root == before).all():
                break
        known = list(number)
        return [(known[r], known[k]) for k, r in enumerate(root) if r != k]

    def run(batches):
        now, held, found = None, [], []
        for batch in batches:
            for *unit_of, side, rid, s in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if unit_of != now:
                    found += spanning(held)
                    now, held = unit_of, []
                held.append((side, rid, np.frombuffer(s, np.uint64)))
            yield emit({"a": [a for a, _ in found], "b": [b for _, b in found]}, _LINK)
            found = []
        found = spanning(held)
        yield emit({"a": [a for a, _ in found], "b": [b for _, b in found]}, _LINK)

    return rows.repartition("grp", "x", "y").sortWithinPartitions("grp", "x", "y", "side").mapInArrow(run, _LINK)


def near_classes(docs: DataFrame, marks: DataFrame, threshold: tuple[int, int] = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(node, class_id) of every node with copies or links; class_id is the smallest id among the documents that links and copies connect."""
    nodes = cut(marks.where("node IS NOT NULL").groupBy("node").agg(F.min("rid").alias("rid"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    once = marks.join(bounded_broadcast(nodes.select("rid"), LIST_ROWS), "rid", "left_semi")
    rows = buckets_of(once)
    shared = cut(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    members = cut(rows.join(bounded_broadcast(shared, LIST_ROWS), "bucket"))
    degrees = members.groupBy("rid").agg(F.sum("n").alias("degree"))
    members = cut(members.join(bounded_broadcast(cut(degrees), LIST_ROWS), "rid").select("bucket", "rid", "degree"))
    hubs = members.groupBy("bucket").agg(F.min(F.struct((-F.col("degree")).alias("d"), "rid")).alias("h")).select("bucket", F.col("h.rid").alias("hub"))
    pairs = members.join(bounded_broadcast(cut(hubs), LIST_ROWS), "bucket").where("rid <> hub").select("hub", "rid").distinct()
    links = cut(hub_links(docs, marks, cut(pairs), threshold, key, text))
    classes = components(links)
    named = members.join(classes.select(F.col("node").alias("rid"), "label"), "rid", "left").select("bucket", "rid", F.coalesce("label", "rid").alias("label"))
    live = cut(named.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("n")).where("low <> high AND n > 2").select("bucket"))
    if live.limit(1).count():
        named = cut(named.join(bounded_broadcast(live, LIST_ROWS), "bucket"))
        more = cut(block_links(docs, marks, named, threshold, key, text))
        classes = components(cut(links.unionByName(more)))
    named = nodes.join(classes.select(F.col("node").alias("rid"), "label"), "rid", "left").select("node", "least", "n", "label")
    least = named.where("label IS NOT NULL").groupBy("label").agg(F.min("least").alias("class_id"))
    return named.join(least, "label", "left").where("n > 1 OR label IS NOT NULL").select("node", F.coalesce("class_id", "least").alias("class_id"))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and its edited copy, how alike they are, and the document's class of near copies."""
    marks = fingerprinted(docs, key, text)
    classes = cut(near_classes(docs, marks, key=key, text=text))
    rows = marks.join(bounded_broadcast(classes, LIST_ROWS), "node", "left")
    digits = lambda c: F.lower(F.hex(c))
    return rows.select("doc_id", "n_chars", digits("edited_hash").alias("edited_sha256"), digits("signature").alias("fingerprint"),
                       digits("edited_signature").alias("edited_fingerprint"), "near_edited", "near_next", F.coalesce("class_id", "doc_id").alias("class_id"))
