"""N-gram Jaccard join: a MinHash LSH forest, then exact verification.

A document's shingles are the distinct runs of five words (A-Z lower-cased, split at ASCII white space); a text of one
to four words is one shingle. Documents with equal shingle sets are copies: they form one node, and the work
below is done once per node.

* Forest: TREES signatures of DEPTH one-byte MinHash values, each packed into one long, so that the order of the longs is
  the order of a prefix trie. Every tree's rows are dealt out by prefix and sorted once. A row is linked to the first row of
  the deepest trie node that it shares with an earlier row, and the edge keeps that depth: one edge per row, however large a group
  is. The edges of depth d or more connect just the rows that share a prefix of d values.
* Verification: components of the edges are candidate groups. Each is compared exactly, in blocks of bounded size. Only
  counts and a spanning set of links leave a block, never all pairs.
* Shortening: matched prefixes have DEPTH values at first. The similarities of the verified links tell how many links like them the
  forest misses: a link of similarity s meets in some tree with probability f = 1 - (1 - s^d)^TREES, so it stands for
  (1 - f) / f missed ones. While the recall measured so (over links near the threshold, where it is lowest) is below `recall`,
  prefixes are shortened by one value; groups that this merges are verified anew, all others keep their links. At the depth
  where even a link at the threshold is found with probability `recall` the target is met whatever the data.

Null and empty texts have no shingle: no copies, no links, a class of their own. Null ids stay in the result (such
rows count as copies; a class whose ids are all null has a null class_id). Repeated rows are copies.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.llm.batches import bounded_broadcast, map_texts, ngram_hashes, tokens_in, word_hashes
from paddock.llm.components import components
from paddock.session import cut

SHINGLE = 5
#: Similarity of a link, as a fraction of two integers, so that the test is exact.
THRESHOLD = (4, 5)
TREES = 40
DEPTH = 8
RECALL = 0.9999
#: Links in the lowest part of the range from the threshold to 1 measure the recall.
NEAR = 0.25
#: A block of a candidate group holds at most so many nodes and so many shingles.
BLOCK_NODES = 800
BLOCK_SHINGLES = 1_000_000
#: A plan of blocks up to this many nodes is broadcast to the shingle sets; a larger one is joined by shuffle.
BROADCAST_ROWS = 400_000
#: Nodes and shingles whose overlap matrix is built at once.
_CHUNK = 2048


def prefix_depth(threshold: float, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix at which a pair at the threshold meets in some tree with probability `recall`."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def missed(similarity, depth: int):
    """Links of this similarity that no tree shows at a prefix of `depth` values, for each one that some tree shows."""
    lost = (1 - similarity**depth) ** TREES
    return lost / (1 - lost)


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240501)
    return rng.integers(1, 1 << 32, n, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, np.uint32)


_A, _B = _coefficients(TREES * DEPTH)


def signature(shingles: np.ndarray) -> np.ndarray:
    """TREES longs; the bytes of each are MinHash values of a shingle set."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(_A), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 256):
        h = x[i : i + 256] * _A[:, None]
        h += _B[:, None]
        np.minimum(low, h.min(axis=1), out=low)
    # A minimum's low bits are as good as random; high bits are mostly zero.
    low = (low ^ (low >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (low >> np.uint32(24)).astype(np.uint8).reshape(TREES, DEPTH).view(">i8").ravel().astype(np.int64)


def shingles_of(text: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    words = tokens_in(text)
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(ngram_hashes(word_hashes(words), min(SHINGLE, len(words))))


def nodes_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, node, n, trees, shingles) per document; the last two only where a task meets a node first.

    A node is a 64-bit hash of its shingle set, n the set's size.
    """

    def run(part, texts):
        out = {"_key": part.column(0).to_pylist(), "node": [], "n": [], "trees": [], "shingles": []}
        seen = set()
        for t in texts:
            s = shingles_of(t)
            node = int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "big", signed=True) if len(s) else None
            new = node is not None and node not in seen
            seen.add(node)
            out["node"].append(node)
            out["n"].append(len(s))
            out["trees"].append(signature(s).tolist() if new else None)
            out["shingles"].append(s.tobytes() if new else None)
        yield out

    return map_texts(docs.select(F.col(key).cast("bigint").alias("_key"), F.col(text).alias("text")), run,
                     "_key bigint, node bigint, n bigint, trees array<bigint>, shingles binary", ["_key"])


def candidate_edges(nodes: DataFrame, least: int) -> DataFrame:
    """(a, b, depth): each row of a tree with the first row of the deepest trie node, of `least` values or more, that they share.

    Rows stream past in the order of the tries, so the memory is that of one batch, however many share a prefix.
    """
    cut_off = 8 * (DEPTH - least)
    rows = nodes.where("trees IS NOT NULL").select("node", F.posexplode("trees").alias("tree", "sig")).select(
        F.col("tree").cast("tinyint").alias("tree"), "sig", "node")
    rows = rows.repartition("tree", F.shiftright("sig", cut_off)).sortWithinPartitions("tree", "sig")
    depths = range(least, DEPTH + 1)

    def run(batches):
        last, first = None, dict.fromkeys(depths, 0)
        for batch in batches:
            tree, sig, node = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            if not len(node):
                continue
            a, depth = node.copy(), np.zeros(len(node), np.int8)
            for d in depths:
                prefix = sig >> 8 * (DEPTH - d)
                new = np.ones(len(node), bool)
                new[1:] = (prefix[1:] != prefix[:-1]) | (tree[1:] != tree[:-1])
                new[0] = last is None or (tree[0], prefix[0]) != (last[0], last[1] >> 8 * (DEPTH - d))
                at = np.maximum.accumulate(np.where(new, np.arange(len(node)), -1))
                top = np.where(at < 0, first[d], node[at])
                first[d] = top[-1]
                a[~new], depth[~new] = top[~new], d
            last = (tree[-1], sig[-1])
            ok = a != node
            yield pa.RecordBatch.from_arrays([pa.array(x[ok]) for x in (a, node, depth)], names=["a", "b", "depth"])

    return rows.mapInArrow(run, "a bigint, b bigint, depth tinyint").groupBy("a", "b").agg(F.max("depth").alias("depth"))


def _linked(sets: list[np.ndarray], threshold: tuple[int, int], split: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of sets with a Jaccard similarity at or above the threshold; exact.

    With `split`, only pairs of one set before and one at or after that index.
    """
    return _compared(sets, threshold, split)[:2]


def _compared(sets: list[np.ndarray], threshold: tuple[int, int], split: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same with the number of shingles that each pair shares."""
    top, bottom = threshold
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    if n <= 24:
        found = []
        for i in range(n if split is None else split):
            for j in range(i + 1 if split is None else split, n):
                small, large = sorted((int(sizes[i]), int(sizes[j])))
                if small * bottom >= large * top:
                    both = small + large - len(np.unique(np.concatenate((sets[i], sets[j]))))
                    if both * bottom >= (small + large - both) * top:
                        found.append((i, j, both))
        x = np.array(found, np.int64).reshape(-1, 3)
        return x[:, 0], x[:, 1], x[:, 2]
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    _, ids, df = np.unique(flat, return_inverse=True, return_counts=True)
    many = df > 1
    number = np.cumsum(many) - 1
    keep = many[ids]
    cols, owner = number[ids[keep]], owner[keep]
    order = np.argsort(cols, kind="stable")
    cols, owner = cols[order], owner[order]
    both = np.zeros((n, n), np.float32)
    total = int(many.sum())
    for c in range(0, total, _CHUNK):
        a, b = np.searchsorted(cols, (c, min(total, c + _CHUNK)))
        x = np.zeros((n, min(_CHUNK, total - c)), np.float32)
        x[owner[a:b], cols[a:b] - c] = 1
        both += x @ x.T  # counts below 2**24 are exact in single precision
    i, j = np.nonzero(both)
    pick = (i < j) if split is None else (i < split) & (j >= split)
    i, j = i[pick], j[pick]
    shared = both[i, j].astype(np.int64)
    ok = shared * bottom >= (sizes[i] + sizes[j] - shared) * top
    return i[ok], j[ok], shared[ok]


def _verify(names: list[int], sets: list[np.ndarray], weight: np.ndarray, half: list[int], pair: tuple[int, int], threshold, depths: range) -> dict:
    split = None
    if pair[0] != pair[1]:
        order = sorted(range(len(names)), key=lambda k: half[k])
        names, sets, weight = [names[k] for k in order], [sets[k] for k in order], weight[order]
        split = sum(h == pair[0] for h in half)
    i, j, shared = _compared(sets, threshold, split)
    n = len(names)
    sizes = np.array([len(s) for s in sets], np.int64)
    similarity = shared / (sizes[i] + sizes[j] - shared)
    low = threshold[0] / threshold[1]
    close = similarity < low + (1 - low) * NEAR
    tally = [np.bincount(i[close], minlength=n), *(np.bincount(i[close], weights=missed(similarity[close], d), minlength=n) for d in depths)]
    links = np.bincount(i, weights=weight[j], minlength=n) + np.bincount(j, weights=weight[i], minlength=n)
    root = np.arange(n)
    while True:
        before = root.copy()
        np.minimum.at(root, j, root[i])
        np.minimum.at(root, i, root[j])
        root = root[root]
        if (root == before).all():
            break
    at = np.flatnonzero(links)
    tally = np.array(tally, np.float64)[:, at].T
    return {"node": [names[k] for k in at], "n_links": links[at].astype(np.int64), "root": [names[k] for k in root[at]],
            "tally": [row.tolist() if row[0] else None for row in tally]}


def blocks_of(groups: DataFrame, sizes: DataFrame) -> DataFrame:
    """(node, label, blocks, half, n_copies): how many blocks a candidate group is cut into, and each node's block."""
    rows = groups.join(sizes.select("node", "n", "n_copies"), "node")
    extent = rows.groupBy("label").agg(F.count(F.lit(1)).alias("nodes"), F.sum("n").alias("shingles"))
    blocks = F.ceil(F.greatest(F.col("nodes") / BLOCK_NODES, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    rows = rows.join(extent.select("label", blocks.alias("blocks")), "label")
    return rows.select("node", "label", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("half"), "n_copies")


def verified(nodes: DataFrame, groups: DataFrame, sizes: DataFrame, threshold: tuple[int, int], depths: range) -> DataFrame:
    """(node, n_links, root, tally): links found in each block, weighted by copies, and a spanning set of them.

    tally: of the links near the threshold that a block counts at this node the number and, for each depth, the
    links missed (see `missed`); null where there are none.
    """
    blocks = bounded_broadcast(cut(blocks_of(groups, sizes)), BROADCAST_ROWS)
    rows = nodes.where("shingles IS NOT NULL").select("node", "shingles").join(blocks, "node")
    # Every pair of blocks of a group is one unit of work.
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, "half").alias("x"), F.greatest(k, "half").alias("y")))
    rows = rows.withColumn("pair", F.explode(pairs)).select("label", F.col("pair.x").alias("x"), F.col("pair.y").alias("y"), "node", "half", "n_copies", "shingles")
    rows = rows.repartition("label", "x", "y").sortWithinPartitions("label", "x", "y", "node")

    def run(batches):
        now, names, sets, weight, half = None, [], [], [], []

        def done():
            if len(names) > 1:
                yield _verify(names, sets, np.array(weight, np.float64), half, now[1:], threshold, depths)

        found = {"node": [], "n_links": [], "root": [], "tally": []}
        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in range(7)]
            for label, x, y, node, h, n, s in zip(*cols, strict=True):
                if (label, x, y) != now:
                    for r in done():
                        for k, v in r.items():
                            found[k].extend(v)
                    now, names, sets, weight, half = (label, x, y), [], [], [], []
                if names and names[-1] == node:
                    continue  # the same node, met first by more than one task
                names.append(node)
                sets.append(np.frombuffer(s, np.uint64))
                weight.append(n)
                half.append(h)
            if len(found["node"]) > 20_000:
                yield _batch(found)
                found = {"node": [], "n_links": [], "root": [], "tally": []}
        for r in done():
            for k, v in r.items():
                found[k].extend(v)
        yield _batch(found)

    return rows.mapInArrow(run, "node bigint, n_links bigint, root bigint, tally array<double>")


def _batch(found: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [*(pa.array(found[k], pa.int64()) for k in ("node", "n_links", "root")), pa.array(found["tally"], pa.list_(pa.float64()))],
        names=["node", "n_links", "root", "tally"])


def measured_recall(links: DataFrame, depth: int, depths: range, threshold: tuple[int, int]) -> float:
    """Share of the links near the threshold that a forest of this depth finds, by the links it has found.

    One link at the threshold itself is counted along, so that few links or none make the measure cautious.
    """
    k = depths.index(depth) + 1
    near, gone = links.agg(F.sum(F.col("tally")[0]), F.sum(F.col("tally")[k])).first()
    near, gone = (near or 0) + 1, (gone or 0) + float(missed(threshold[0] / threshold[1], depth))
    return near / (near + gone)


def merged(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label): the nodes of candidate groups that further edges join together, with the label of the new group."""
    a, b = (groups.select(F.col("node").alias(x), F.col("label").alias("l" + x)) for x in ("a", "b"))
    over = edges.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    labels = components(over)
    old = groups.join(labels.select(F.col("node").alias("label"), F.col("label").alias("new")), "label").select("node", F.col("new").alias("label"))
    return cut(old.unionByName(labels.join(groups.select("node"), "node", "left_anti")))


def forest_links(nodes: DataFrame, sizes: DataFrame, threshold: tuple[int, int] = THRESHOLD, recall: float = RECALL) -> tuple[DataFrame, int, float]:
    """The verified links, the number of values in a matched prefix at the end, and the recall measured there."""
    least = prefix_depth(threshold[0] / threshold[1], recall=recall)
    depths = range(least, DEPTH + 1)
    edges = cut(candidate_edges(nodes, least))
    depth = DEPTH
    groups = components(edges.where(F.col("depth") == DEPTH).select("a", "b"))
    links = cut(verified(nodes, groups, sizes, threshold, depths))
    while (reached := measured_recall(links, depth, depths, threshold)) < recall and depth > least:
        depth -= 1
        fresh = merged(groups, edges.where(F.col("depth") == depth).select("a", "b"))
        names = fresh.select("node")
        again = verified(nodes, fresh, sizes, threshold, depths)
        links = cut(links.join(names, "node", "left_anti").unionByName(again))
        groups = cut(groups.join(names, "node", "left_anti").unionByName(fresh))
    return links, depth, reached


def ngram_join(docs: DataFrame, threshold: tuple[int, int] = THRESHOLD, recall: float = RECALL, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its class and how many other documents it is linked to.

    class_id: smallest id among all documents connected by links; copy_id: smallest id among copies (equal
    shingle sets); n_copies: documents with that set, itself included; n_links: other documents at or above the
    threshold, copies included.
    """
    nodes = cut(nodes_of(docs, key, text))
    sizes = cut(nodes.where("node IS NOT NULL").groupBy("node").agg(F.min("_key").alias("copy_id"), F.max("n").alias("n"), F.count(F.lit(1)).alias("n_copies")))
    links, _, _ = forest_links(nodes, sizes, threshold, recall)
    classes = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    per_node = links.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    named = classes.join(sizes.select("node", "copy_id"), "node")
    least = named.groupBy("label").agg(F.min("copy_id").alias("class_id"))
    known = sizes.join(per_node, "node", "left").join(named.join(least, "label").select("node", "class_id"), "node", "left")
    known = known.select("node", F.coalesce("class_id", "copy_id").alias("class_id"), "copy_id", "n_copies",
                         (F.col("n_copies") - 1 + F.coalesce("n_links", F.lit(0))).alias("n_links"))
    lone = F.col("node").isNull()
    return nodes.select(F.col("_key").alias("doc_id"), "node").join(known, "node", "left").select(
        "doc_id", F.when(lone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(lone, F.col("doc_id")).otherwise(F.col("copy_id")).alias("copy_id"),
        F.coalesce("n_copies", F.lit(1)).alias("n_copies"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
