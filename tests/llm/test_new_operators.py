"""Conversation trie, fingerprints and vector codes against brute force."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F

from paddock.llm import conversation_trie as ct
from paddock.llm import fingerprints as fp
from paddock.llm import queries
from paddock.llm import vector_codes as vc

# --- vector codes


@given(st.integers(1, 40), st.integers(1, 27), st.integers(0, 2**32 - 1))
@settings(max_examples=60, deadline=None)
def test_exact_dot_equals_python_integers(width, bits, seed):
    rng = np.random.default_rng(seed)
    a, b = (rng.integers(-(1 << bits), (1 << bits) + 1, (3, width)) for _ in range(2))
    want = [[sum(int(x) * int(y) for x, y in zip(r, c, strict=True)) for c in b] for r in a]
    assert vc.exact_dot(a, b).tolist() == want


def test_limbs_stay_below_the_mantissa():
    for width in (1, 2, 3, 16, 100):
        bits = vc.limb_bits(width)
        x = np.array([[vc.bound_of(width), -vc.bound_of(width)]] * 2)
        parts = vc.limbs(x, bits)
        assert (sum(p.astype(np.int64) << (bits * i) for i, p in enumerate(parts)) == x).all()
        assert all(np.abs(p).max() < 1 << bits for p in parts) and width * ((1 << bits) - 1) ** 2 < 2**53


def test_nearest_takes_the_first_of_equals():
    entries = np.array([[4, 0], [0, 0], [4, 0], [0, 0], [2, 0]])
    k, d = vc.nearest(np.array([[1, 0], [3, 0], [0, 0], [5, 5]]), entries)
    assert k.tolist() == [1, 0, 1, 0] and d.tolist() == [1, 1, 0, 26]


def plain_codes(rows, scale=1024, parts=4, entries=256, rounds=4):
    kept = []
    for i, v, label in rows:
        if v and not any(x is None or not math.isfinite(x) for x in v) and len(v) % parts == 0:
            kept.append((i, [math.floor(scale * x) for x in v], label))
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    m = len(kept[0][1]) // parts
    cut = [[r[1][p * m : (p + 1) * m] for p in range(parts)] for r in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def assign(p):
        return [min(range(len(books[p])), key=lambda e, c=c: (dist(c[p], books[p][e]), e)) for c in cut]

    for _ in range(rounds):
        for p in range(parts):
            got = defaultdict(list)
            for c, e in zip(cut, assign(p), strict=True):
                got[e].append(c[p])
            for e, xs in got.items():
                books[p][e] = [sum(col) // len(xs) for col in zip(*xs, strict=True)]
    codes = [assign(p) for p in range(parts)]
    errors = [sum(dist(c[p], books[p][codes[p][n]]) for p in range(parts)) for n, c in enumerate(cut)]
    by_label = defaultdict(int)
    for r, e in zip(kept, errors, strict=True):
        by_label[r[2]] += e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(r[0], "".join(f"{codes[p][n]:02x}" for p in range(parts)), errors[n], by_label[r[2]], sha) for n, r in enumerate(kept)]


def vector_rows(n, width, seed, spread=0.3):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, spread) for _ in range(width)], rng.choice([None, 1, 2])) for i in range(n)]


@pytest.mark.parametrize("n,width,seed", [(3, 4, 1), (40, 8, 2), (300, 8, 3)])
def test_vector_codes_equal_plain_rounds(spark, n, width, seed):
    rows = vector_rows(n, width, seed)
    rows += [(-1, None, 1), (-2, [float("nan")] * width, 1), (-3, [None] + [0.0] * (width - 1), 1), (-4, [float("inf")] * width, 1), (-5, [], 1),
             (-6, [1.0] * (width + 1), 1), (1000, [1.0] * (2 * width), 1), (-7, [1e30] * width, 1)]
    rows += [(0, rows[1][1], 2), rows[2], rows[2], (None, [0.5] * width, None)]  # equal ids, repeated rows, a null id
    df = spark.createDataFrame([(a, b, c, "x", 1) for a, b, c in rows], "vec_id long, embedding array<double>, label int, code string, error int")
    got = [tuple(r) for r in vc.vector_codes(df.repartition(5)).collect()]
    want = plain_codes([r for r in rows if r[0] != -7])
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(got, key=key) == sorted(want, key=key)


def test_vector_codes_of_large_components_and_of_nothing(spark):
    rows = [(i, [x * 120_000 for x in v], c) for i, v, c in vector_rows(30, 8, 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted(tuple(r) for r in vc.vector_codes(df).collect()) == plain_codes(rows)
    none = vc.vector_codes(df.limit(0))
    assert none.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and none.count() == 0


def test_codes_decode_to_their_entries(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows, _ = vc.integer_vectors(vectors, "vec_id", "embedding", "label")
    books = vc.codebooks(rows)
    x = {r._key: np.array(r.v) for r in rows.collect()}
    got = vc.coded(rows, books).collect()
    back = vc.decoded([r.code for r in got], books)
    assert all(((x[r._key] - b) ** 2).sum() == r.error for r, b in zip(got, back, strict=True))


# --- conversation trie


def plain_trie(rows, rebuild=True):
    said = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            said[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in said.items()}
    new = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        new[c] = own.get(c - c % 5, [])[:h] + turns[h:] if rebuild else turns
    members = defaultdict(set)
    for c, s in new.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].add(c)
    out = {}
    for s, cs in members.items():
        below = [t for t in members if t[: len(s)] == s]
        leaf = lambda t: not any(len(u) == len(t) + 1 and u[: len(t)] == t for u in members)
        ends = sorted(c for c in cs if len(new[c]) == len(s))
        out[min(cs), len(s)] = (
            min(members[s[:-1]]) if s else None, len(cs), sum(len(u) == len(s) + 1 and u[: len(s)] == s for u in members),
            sum(map(leaf, below)), sum((len(members[t]) - 1) * len(t[-1][1].encode()) for t in below if t), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest())
    return out


TURNS = "conv_id long, turn long, role string, text string"


def conversation_rows(seed, n=40, words=("hi", "yes", "é no", "")):
    rng = random.Random(seed)
    rows = [(c, t, rng.choice(["user", "assistant", None]) if rng.random() < 0.3 else "user", rng.choice(words) if rng.random() < 0.9 else None)
            for c in rng.sample(range(60), n) for t in range(rng.randrange(1, 9))]
    return rows


def found_trie(df):
    rows = df.collect()
    out = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("seed,local,block", [(1, 4096, 1024), (2, 1, 3), (3, 5, 2)])
def test_trie_equals_plain_prefixes(spark, seed, local, block):
    rows = conversation_rows(seed)
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], TURNS + ", depth int, k0 string").repartition(3)
    assert found_trie(ct.conversation_trie(df, local=local, block=block)) == plain_trie(rows)


def test_trie_of_odd_conversations(spark, tight):
    rows = [(5, None, None, None), (5, 1, "user", "a"), (6, 0, "user", "a"), (6, 0, "user", "a"), (10, 1, "b", "x" * 70_000), (None, 0, "user", "lost"), (7, 3, "", ""), (21, 2, "u", "long")]
    rows += [(20, t, "u", f"turn {t % 7}") for t in range(60)]
    df = spark.createDataFrame(rows, TURNS)
    assert found_trie(ct.conversation_trie(df, local=7, block=4)) == plain_trie(rows)
    assert found_trie(ct.plain_trie(df, local=7)) == plain_trie(rows, rebuild=False)
    assert ct.conversation_trie(df.limit(0)).count() == 0


def test_trie_with_a_hot_beginning_and_a_hot_end(spark):
    rows = [(c, t, "u", "same") for c in range(0, 3000, 5) for t in range(2)] + [(c, 2, "u", f"own {c}") for c in range(0, 500, 5)]
    df = spark.createDataFrame(rows, TURNS)
    got = found_trie(ct.plain_trie(df, local=20))
    assert got[0, 0][1] == 600 and got[0, 2][2] == 100 and got[0, 0][3] == 100 and got[0, 0][4] == 2 * 4 * 599
    ends = ",".join(str(c) for c in range(500, 3000, 5))
    assert got[0, 2][5] == hashlib.sha256(ends.encode()).hexdigest()


@given(st.integers(1, 120), st.integers(0, 2**32 - 1), st.booleans())
@settings(max_examples=60, deadline=None)
def test_rollup_equals_sums_over_subtrees(n, seed, chain):
    rng = np.random.default_rng(seed)
    parent = np.array([-1 if i == 0 or (not chain and rng.random() < 0.05) else (i - 1 if chain else int(rng.integers(0, i))) for i in range(n)])
    depth, size = np.zeros(n, np.int64), np.ones(n, np.int64)
    values = rng.integers(-5, 50, (n, 2))
    want = values.copy()
    for i in range(n):
        depth[i] = 0 if parent[i] < 0 else depth[parent[i]] + 1
    for i in range(n - 1, -1, -1):
        if parent[i] >= 0:
            size[parent[i]] += size[i]
            want[parent[i]] += want[i]
    assert (ct.rollup(parent, depth, size, values) == want).all()


# --- fingerprints


def plain_shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def plain_classes(texts):
    ids = sorted(texts)
    root = {i: i for i in ids}
    sets = {i: plain_shingles(texts[i]) for i in ids}
    index = defaultdict(set)
    for i in ids:
        for s in sets[i]:
            index[s].add(i)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in set().union(*[index[s] for s in sets[i]]) if sets[i] else ():
            if j > i and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


@pytest.fixture(scope="module")
def prints(spark, sf):
    return {r.doc_id: r for r in queries.op12_fingerprints(spark, sf).collect()}


def test_fingerprints_of_whole_and_edited_texts(prints, texts):
    order = sorted(texts, reverse=True)
    off = []
    for i, k in enumerate(order):
        t, following = texts[k] or "", texts[order[(i + 1) % len(order)]] or ""
        edited = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        r = prints[k]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        own, new = (fp.signatures([fp.shingles(x.encode())[0]])[0].tobytes().hex() if x.split() else "" for x in (t, edited))
        assert (r.fingerprint, r.edited_fingerprint) == (own, new)
        off += [r.near_edited - jaccard(plain_shingles(t), plain_shingles(edited)), r.near_next - jaccard(plain_shingles(t), plain_shingles(following))]
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    # PERMUTATIONS values: a standard error of at most 0.5 / sqrt(120)
    assert abs(np.mean(off)) < 0.005 and np.std(off) < 0.046 and np.abs(off).max() < 0.3


def test_fingerprint_classes_are_those_of_all_pairs(prints, texts):
    assert {k: r.class_id for k, r in prints.items()} == plain_classes(texts)


def test_permutations_do_not_depend_on_the_cut():
    rng = np.random.default_rng(0)
    sets = [rng.integers(0, 2**63, n, np.uint64) for n in (3, 0, 200_000, 70_000, 1, 5)]
    whole = fp.signatures(sets)
    want = [((fp._A[:, None] * s[None, :] + fp._B[:, None]).min(axis=1)) if len(s) else None for s in (sets[0], sets[4])]
    for k, w in zip((0, 4), want, strict=True):
        w = (((w ^ (w >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(48)).astype(np.uint16)
        assert (whole[k] == w).all()
    assert all((fp.signatures([s])[0] == whole[i]).all() for i, s in enumerate(sets) if len(s))


@pytest.mark.parametrize("edits", [1, 6, 14])
def test_a_large_group_of_near_copies(spark, monkeypatch, edits):
    """With few edits all copies are alike, with more only some pairs are: links run through the least edited texts."""
    monkeypatch.setattr(fp, "SLICE", 50)
    monkeypatch.setattr(fp, "BLOCK_NODES", 60)
    base = [f"word{i}" for i in range(200)]
    rng = random.Random(5)
    rows = []
    for i in range(400):
        w = list(base)
        for k in rng.sample(range(200), rng.randrange(edits) + 1):
            w[k] = f"own{i}x{k}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(f"other{i}x{j}" for j in range(30))) for i in range(50)] + [(2000 + i, rows[3][1]) for i in range(30)]
    got = {r.doc_id: r.class_id for r in fp.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = plain_classes(dict(rows))
    # a pair at the threshold is missed with probability below 1 in 10,000
    assert sum(got[i] != want[i] for i in got) <= 1 and len(set(want.values())) >= 51


def test_fingerprints_of_odd_rows(odd, empty):
    rows = fp.fingerprints(odd).collect()
    assert len(rows) == odd.count()
    by_text = defaultdict(set)
    texts = defaultdict(list)
    for r in odd.select("doc_id", "text").collect():
        texts[r.doc_id].append(r.text or "")
    for r in rows:
        assert r.n_chars in [len(t) for t in texts[r.doc_id]]
        if r.doc_id is not None and len(texts[r.doc_id]) == 1:
            by_text[texts[r.doc_id][0]].add(r.fingerprint)
        if not r.fingerprint:
            assert r.class_id == r.doc_id
    assert all(len(x) == 1 for x in by_text.values())
    assert {r.class_id for r in rows if r.doc_id in (7, 8)} == {7}
    assert fp.fingerprints(empty).count() == 0


def test_one_document_follows_itself(spark):
    r = fp.fingerprints(spark.createDataFrame([Row(doc_id=3, text="a b c d e f")])).first()
    # 11 characters: the last 5 give way to the first 5
    assert r.n_chars == 11 and r.near_next == 1.0 and r.edited_sha256 == hashlib.sha256(b"a b c a b c").hexdigest()


def test_new_queries_read_whole_tables(spark, sf):
    assert queries.op12_fingerprints(spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert queries.op13_vector_codes(spark, sf).agg(F.count_distinct("vec_id")).first()[0] == spark.read.parquet(f"{sf}/embeddings.parquet").count()
