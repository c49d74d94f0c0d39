"""Conversation prefix trie, with subtree totals by centroid decomposition of its parent-edge forest.

A node of depth d is a distinct sequence of first d turns (role, text); the root (d = 0) has no turn. Conversations that start with the
sequence are the node's members. A prefix is named by 128 bits: the XOR of hashes of (position, role, text) over its turns, so
names come from running aggregates that cut long conversations into blocks, and a node's parent is one XOR away.

Totals over subtrees (leaves, saved tokens) are rolled up by centroids. A component is a connected piece of the forest; at first the
whole tree is one. In each round every component is split at its centroid, the deepest node that has more than half of the component
below it (itself included): the pieces are what hangs at each child of the centroid, and the rest above it. The total of the
centroid's subtree inside its component is the sum of the totals of the pieces below and its own value; it is added to
the centroid and to all nodes on the path from there to the component's top. A node's total is the sum of what it was given. Every round halves
the components, so there are at most log2(nodes) rounds, however deep the tree, and however many children a node has.

Components of more than LOCAL nodes are split by joins and aggregates; smaller ones are dealt out whole and finished inside tasks, with
the same rounds in numpy. Sizes of subtrees, needed to find centroids, come from ownership: each node belongs to its smallest member, a
conversation owns the end of its own path, so a subtree's size is the sum of what its members own, less what
the smallest of them owns above the node.

Defined cases. Turns are ordered by `turn`, nulls first, equal ones by role and text (by their hashes); repeated rows are turns of their
own. Null roles and texts count as empty. Rows with a null id belong to no conversation. A conversation without turns is a
member of the root. An empty table has no conversation, hence no node. Other columns are not read. Very long texts are hashed where they lie and
never travel; very long conversations are cut into blocks of BLOCK turns.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paddock.llm.batches import bounded_broadcast, emit
from paddock.operators.spread import with_position
from paddock.session import cut

#: Nodes of a component that one task may finish.
LOCAL = 4096
#: Turns of one conversation that stay together in one window.
BLOCK = 1024
#: Tables of ids up to this many rows are broadcast.
LIST_ROWS = 1_000_000
#: Conversation ids differing only below this power of two are listed in one string.
_ID_BITS = 8
#: Nodes a task rolls up at once, about.
_BATCH = 50_000

K, PARENT, COMP = ["k0", "k1"], ["p0", "p1"], ["c0", "c1"]


def turns_of(conversations: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv_id, i, t0, t1, n_bytes): turns in order, i from 1; texts are replaced by two hashes of role and text, and their length."""
    said = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text)]
    rows = conversations.where(F.col(key).isNotNull()).select(
        F.col(key).cast("bigint").alias("conv_id"), F.col(turn).alias("turn"), F.xxhash64(F.lit(1), *said).alias("t0"), F.xxhash64(F.lit(2), *said).alias("t1"),
        F.octet_length(said[1]).cast("bigint").alias("n_bytes"))
    return with_position(rows, ["conv_id"], ["turn", "t0", "t1"], "i", reread=True).drop("turn")


def rebuilt(turns: DataFrame, every: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that share beginnings: (conv_id, depth, t0, t1, n_bytes) and (conv_id, len).

    The first h turns of conversation c give way to the first h of conversation c - c % every (all if it has fewer), h = crc32(c) % most.
    """
    c = F.col("conv_id")
    lengths = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    heads = F.crc32(c.cast("string").cast("binary")) % most
    base = lengths.select(c.alias("base"), F.col("n").alias("n_base"))
    convs = lengths.select("conv_id", "n", (c - c % every).alias("base"), F.when(c % every == 0, F.lit(0)).otherwise(heads).alias("h"))
    convs = convs.join(base, "base", "left").withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0))))
    convs = cut(convs.select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")))
    own = turns.join(convs.select("conv_id", "h", "taken"), "conv_id").where("i > h")
    own = own.select("conv_id", (F.col("i") - F.col("h") + F.col("taken")).alias("depth"), "t0", "t1", "n_bytes")
    first = turns.where(F.col("i") < most).withColumnRenamed("conv_id", "base")
    borrowed = first.join(convs.where("taken > 0").select("conv_id", "base", "taken"), "base").where("i <= taken")
    return own.unionByName(borrowed.select("conv_id", F.col("i").alias("depth"), "t0", "t1", "n_bytes")), convs.select("conv_id", "len")


def prefixes(turns: DataFrame, lengths: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, depth, k0, k1, p0, p1, n_bytes, ended): every prefix of every conversation, its name and its parent's; written."""
    x = [F.xxhash64(F.lit(11 + j), "depth", "t0", "t1").alias(f"x{j}") for j in range(2)]
    rows = turns.select("conv_id", "depth", "n_bytes", F.floor((F.col("depth") - 1) / block).alias("block"), *x)
    inside = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    rows = cut(rows.select("*", *[F.bit_xor(f"x{j}").over(inside).alias(f"k{j}") for j in range(2)]))
    ends = rows.groupBy("conv_id", "block").agg(*[F.bit_xor(f"x{j}").alias(f"x{j}") for j in range(2)])
    ends = ends.select("conv_id", "block", *[F.bit_xor(f"x{j}").over(before).alias(f"off{j}") for j in range(2)]).where("block > 0")
    rows = rows.join(bounded_broadcast(cut(ends), LIST_ROWS), ["conv_id", "block"], "left")
    name = [F.col(f"k{j}").bitwiseXOR(F.coalesce(f"off{j}", F.lit(0))) for j in range(2)]
    rows = rows.select("conv_id", F.col("depth").cast("bigint").alias("depth"), *[n.alias(f"k{j}") for j, n in enumerate(name)],
                       *[n.bitwiseXOR(F.col(f"x{j}")).alias(f"p{j}") for j, n in enumerate(name)], "n_bytes")
    zero = F.lit(0).cast("bigint")
    roots = lengths.select("conv_id", zero.alias("depth"), zero.alias("k0"), zero.alias("k1"), F.lit(None).cast("bigint").alias("p0"),
                           F.lit(None).cast("bigint").alias("p1"), zero.alias("n_bytes"))
    rows = rows.unionByName(roots).join(lengths, "conv_id")
    return cut(rows.select("conv_id", "depth", *K, *PARENT, "n_bytes", (F.col("depth") == F.col("len")).alias("ended"), "len"))


def end_digests(paths: DataFrame) -> DataFrame:
    """(k0, k1, ends_sha256): SHA-256 of the ascending, comma-joined ids of the conversations that end at each node.

    Ids are listed in short runs, and a task feeds a node's runs to its hash one after the other.
    """
    run_of = F.shiftright("conv_id", _ID_BITS)
    runs = paths.where("ended").groupBy(*K, run_of.alias("run")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    fields = T.StructType.fromDDL("k0 bigint, k1 bigint, ends_sha256 string")

    def digest(batches):
        now, sha = None, None
        for batch in batches:
            out = {f.name: [] for f in fields}

            def done():
                for name, x in zip(out, (*now, sha.hexdigest()), strict=True):
                    out[name].append(x)  # noqa: B023  called in this turn of the loop only

            for k0, k1, ids in zip(*(batch.column(c).to_pylist() for c in (0, 1, 3)), strict=True):
                if (k0, k1) != now:
                    if now:
                        done()
                    now, sha = (k0, k1), hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield emit(out, fields)
        if now:
            yield emit({"k0": [now[0]], "k1": [now[1]], "ends_sha256": [sha.hexdigest()]}, fields)

    return runs.select(*K, "run", "ids").repartition(*K).sortWithinPartitions(*K, "run").mapInArrow(digest, fields)


def nodes_of(paths: DataFrame) -> DataFrame:
    """One row per node: name, parent, depth, smallest member, members, children, subtree size in nodes, bytes of the last text; written."""
    nodes = cut(paths.groupBy(*K).agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), *[F.max(p).alias(p) for p in PARENT],
        F.count(F.lit(1)).alias("n_convs"), F.max("n_bytes").alias("n_bytes")))
    children = nodes.where("depth > 0").groupBy(*PARENT).agg(F.count(F.lit(1)).alias("n_children")).withColumnsRenamed(dict(zip(PARENT, K, strict=True)))
    owned = cut(nodes.groupBy("conv_id").agg(F.count(F.lit(1)).alias("owned")))
    rows = paths.select(*K, "conv_id", "len").join(owned, "conv_id", "left").withColumn("owned", F.coalesce("owned", F.lit(0)))
    sizes = rows.groupBy(*K).agg(F.sum("owned").alias("below"), F.min(F.struct("conv_id", "owned", "len")).alias("least"))
    rows = nodes.join(children, K, "left").join(sizes, K)
    size = F.col("below") - F.col("least.owned") + F.col("least.len") - F.col("depth") + 1
    return cut(rows.select(*K, *PARENT, "conv_id", "depth", "n_convs", "n_bytes", F.coalesce("n_children", F.lit(0)).alias("n_children"), size.alias("size")))


def _split(live: DataFrame, paths: DataFrame, big: DataFrame, values: list[str]) -> tuple[DataFrame, DataFrame]:
    """One round over large components: (nodes left, with their new components and sizes; what nodes were given)."""
    live = live.join(bounded_broadcast(big, LIST_ROWS), COMP)
    heavy = live.where(2 * F.col("size") > F.col("n")).groupBy(*COMP).agg(
        F.max_by(F.struct(*K, "conv_id", "depth", "size", *values), "depth").alias("z"), F.max("top").alias("z_top"))
    centroids = cut(heavy)
    named = centroids.select(*COMP, F.col("z.k0").alias("z0"), F.col("z.k1").alias("z1"), F.col("z.depth").alias("z_depth"))
    live = live.join(bounded_broadcast(named, LIST_ROWS), COMP)
    # a node is below the centroid if its path passes through it: look up its path one step below the centroid's depth
    step = paths.select(F.col("conv_id").alias("_c"), F.col("depth").alias("_d"), F.col("k0").alias("b0"), F.col("k1").alias("b1"), F.col("p0").alias("q0"), F.col("p1").alias("q1"))
    deeper = F.when(F.col("depth") > F.col("z_depth"), F.col("z_depth") + 1)
    live = cut(live.withColumn("_at", deeper).join(step.where("_d > 0"), (F.col("conv_id") == F.col("_c")) & (F.col("_at") == F.col("_d")), "left").withColumn(
        "under", F.coalesce((F.col("q0") == F.col("z0")) & (F.col("q1") == F.col("z1")), F.lit(False))))
    # the pieces' totals, and the centroid's own value
    below = live.where("under").groupBy(*COMP).agg(*[F.sum(v).alias(f"_{v}") for v in values])
    totals = cut(centroids.join(below, COMP, "left").select(
        "z", "z_top", *[(F.coalesce(f"_{v}", F.lit(0)) + F.col(f"z.{v}")).alias(v) for v in values]))
    up = paths.select(F.col("conv_id").alias("_c"), "depth", *K)
    climb = totals.select(F.col("z.conv_id").alias("_c"), F.col("z.depth").alias("z_depth"), F.col("z.size").alias("z_size"), "z_top", *values)
    path = cut(up.join(bounded_broadcast(climb, LIST_ROWS), "_c").where("depth >= z_top AND depth < z_depth").select(*K, "z_size", *values))
    given = path.select(*K, *values).unionByName(totals.select(F.col("z.k0").alias("k0"), F.col("z.k1").alias("k1"), *values))
    rest = live.where("NOT (k0 = z0 AND k1 = z1)")
    pieces = rest.where("under").withColumns({"c0": F.col("b0"), "c1": F.col("b1")})
    above = rest.where("NOT under").join(bounded_broadcast(path.select(*K, "z_size"), LIST_ROWS), K, "left").withColumn(
        "size", F.col("size") - F.coalesce("z_size", F.lit(0)))
    keep = [*K, *PARENT, *COMP, "conv_id", "depth", "size", *values]
    return cut(pieces.select(*keep).unionByName(above.select(*keep))), given


def rollup(parent: np.ndarray, depth: np.ndarray, size: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Subtree totals of a forest (parent -1 at tops) by centroid decomposition; `size` counts the nodes of each subtree."""
    out, size, up = np.zeros_like(values), size.copy(), parent.copy()
    alive = np.ones(len(parent), bool)
    order = np.argsort(depth, kind="stable")
    layers = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)

    def tops() -> np.ndarray:
        top = np.arange(len(up))
        for at in layers:
            top[at] = np.where(up[at] < 0, at, top[up[at]])
        return top

    while alive.any():
        top = tops()
        heavy = np.flatnonzero(alive & (2 * size > size[top]))
        heavy = heavy[np.lexsort((depth[heavy], top[heavy]))]
        z = heavy[np.append(top[heavy][1:] != top[heavy][:-1], True)]
        chosen = np.zeros(len(up), bool)
        chosen[z] = True
        alive[z] = False
        old = up.copy()
        child = np.flatnonzero((old >= 0) & chosen[old])
        up[child] = -1
        totals = np.zeros_like(values)
        left = np.flatnonzero(alive)
        np.add.at(totals, tops()[left], values[left])
        whole = values.copy()
        np.add.at(whole, old[child], totals[child])
        out[z] += whole[z]
        at, t, n = old[z], whole[z], size[z]
        while len(at := at[(go := at >= 0)]):
            t, n = t[go], n[go]
            out[at] += t  # one centroid per component: no node twice
            size[at] -= n
            at = old[at]
        up[z] = -1
    return out


def _finished(pool: DataFrame, values: list[str]) -> DataFrame:
    """What the nodes of small components are given: each component is rolled up inside one task."""
    fields = T.StructType.fromDDL("k0 bigint, k1 bigint, " + ", ".join(f"{v} bigint" for v in values))

    def done(rows: list[pa.RecordBatch]):
        t = pa.Table.from_batches(rows)
        k0, k1, p0, p1 = (t.column(c).to_pylist() for c in (*K, *PARENT))
        number = {k: i for i, k in enumerate(zip(k0, k1, strict=True))}
        comp = list(zip(*(t.column(c).to_pylist() for c in COMP), strict=True))
        # only the top of a component has its parent elsewhere
        parent = np.array([-1 if comp[i] == (k0[i], k1[i]) else number[p] for i, p in enumerate(zip(p0, p1, strict=True))], np.int64)
        x = np.column_stack([t.column(v).to_numpy() for v in values])
        out = rollup(parent, t.column("depth").to_numpy(), t.column("size").to_numpy(), x)
        yield emit({"k0": k0, "k1": k1} | {v: out[:, i] for i, v in enumerate(values)}, fields)

    def run(batches):
        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            c = np.column_stack([batch.column(batch.schema.get_field_index(k)).to_numpy() for k in COMP])
            if n >= _BATCH:
                # the component that the batch begins with may have begun before it
                last = held[-1]
                now = [last.column(last.schema.get_field_index(k))[last.num_rows - 1].as_py() for k in COMP]
                stop = np.flatnonzero((c != now).any(axis=1))
                if len(stop):
                    yield from done([*held, batch.slice(0, int(stop[0]))])
                    held, n, batch = [], 0, batch.slice(int(stop[0]))
            held.append(batch)
            n += batch.num_rows
        if held:
            yield from done(held)

    rows = pool.select(*COMP, *K, *PARENT, "depth", "size", *values)
    return rows.repartition(*COMP).sortWithinPartitions(*COMP, "depth").mapInArrow(run, fields)


def subtree_totals(nodes: DataFrame, paths: DataFrame, values: dict[str, Column], local: int = LOCAL) -> DataFrame:
    """(k0, k1, *values): sums of `values` (long expressions over `nodes`) over the subtree of every node."""
    names = list(values)
    root = F.lit(0).cast("bigint")
    live = nodes.select(*K, *PARENT, root.alias("c0"), root.alias("c1"), "conv_id", "depth", "size", *[v.cast("bigint").alias(n) for n, v in values.items()])
    live = cut(live)
    given, pools = [], []
    while True:
        comps = cut(live.groupBy(*COMP).agg(F.count(F.lit(1)).alias("n"), F.min("depth").alias("top")).where(F.col("n") > local))
        if not comps.limit(1).count():
            pools.append(live)
            break
        pools.append(live.join(bounded_broadcast(comps.select(*COMP), LIST_ROWS), COMP, "left_anti").select(live.columns))
        live, more = _split(live, paths, comps, names)
        given.append(more)
    pool, parts = pools[0], given
    for p in pools[1:]:
        pool = pool.unionByName(p)
    out = _finished(pool, names)
    for p in parts:
        out = out.unionByName(p.select(out.columns))
    return out.groupBy(*K).agg(*[F.sum(n).alias(n) for n in names])


def trie(paths: DataFrame, local: int = LOCAL) -> DataFrame:
    """All nodes of the trie of `paths` with their totals."""
    nodes = nodes_of(paths)
    totals = subtree_totals(nodes, paths, {
        "n_leaves": F.when(F.col("n_children") == 0, 1).otherwise(0), "saved_tokens": (F.col("n_convs") - 1) * F.col("n_bytes")}, local)
    parents = nodes.select(F.col("k0").alias("p0"), F.col("k1").alias("p1"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(totals, K).join(end_digests(paths), K, "left").join(parents, PARENT, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def conversation_trie(
    conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", local: int = LOCAL, block: int = BLOCK,
) -> DataFrame:
    """The trie of rebuilt conversations (see `rebuilt`)."""
    turns = cut(turns_of(conversations, key, turn, role, text))
    return trie(prefixes(*rebuilt(turns), block), local)


def plain_trie(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", local: int = LOCAL) -> DataFrame:
    """The trie of the conversations as they are."""
    turns = cut(turns_of(conversations, key, turn, role, text))
    lengths = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("len"))
    return trie(prefixes(turns.withColumnRenamed("i", "depth"), lengths), local)
