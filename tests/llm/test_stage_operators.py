"""The five operators of the pipeline against brute force, and the cases every operator must handle."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from paddock.llm import decontamination, mixing, ngram_join, pii, quality_rules, queries
from paddock.session import cut
from tests.llm.conftest import ODD

WORD = re.compile("[^\x20\x09-\x0d]+")


def base_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i : i + 8])].append(i)
    covered = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n, repeat = len(words), len(covered)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeat, n < 20 or 100 * repeat > 30 * n


def test_quality_rules_base_counts(spark, sf, texts):
    for r in queries.op2_quality_rules(spark, sf).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_counts(texts[r.doc_id])
        assert r.kept == (not r.base_failed and r.llr >= quality_rules.THRESHOLD)


def test_quality_rules_ratio(spark, sf, texts):
    good = {r.doc_id for r in queries.trusted(spark, sf).collect()}
    raw, target = Counter(), Counter()

    def grams(t):
        b = t.encode()
        for n in (1, 2, 3):
            for i in range(len(b) - n + 1):
                h = n
                for x in b[i : i + n]:
                    h = (h * 16777619 + x) & 0xFFFFFFFF
                yield (h * 2654435769 & 0xFFFFFFFF) >> 16

    for i, t in texts.items():
        c = Counter(grams(t))
        raw.update(c)
        if i in good:
            target.update(c)
    size = quality_rules.BUCKETS
    a, b = sum(target.values()) + size, sum(raw.values()) + size
    got = {r.doc_id: r.llr for r in queries.op2_quality_rules(spark, sf).collect()}
    for i in list(texts)[:60]:
        w = [np.log((target[g] + 1) / a) - np.log((raw[g] + 1) / b) for g in grams(texts[i])]
        assert got[i] == pytest.approx(np.mean(w), abs=1e-5)


def test_quality_rules_keep_clean_documents(spark, sf):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in queries.op2_quality_rules(spark, sf).collect() if r.doc_id in labels and not r.base_failed]
    good = [r.kept for r in rows if labels[r.doc_id] == 1]
    bad = [r.kept for r in rows if labels[r.doc_id] == 0]
    assert np.mean(good) > 0.99
    assert np.mean(bad) < 0.1


def shingles(text):
    words = (text or "").encode().lower().split()
    n = min(5, len(words))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if words else frozenset()


def brute_join(texts, threshold=(4, 5)):
    """(class, n_links) by comparing every pair that shares a shingle."""
    sets = {i: shingles(t) for i, t in texts.items()}
    post = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            post[g].append(i)
    both = Counter()
    for at in post.values():
        for k, i in enumerate(at):
            for j in at[k + 1 :]:
                both[i, j] += 1
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = Counter()
    for (i, j), n in both.items():
        if threshold[1] * n >= threshold[0] * (len(sets[i]) + len(sets[j]) - n):
            links[i] += 1
            links[j] += 1
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    return {i: (root(i), links[i]) for i in texts}


def test_ngram_join_finds_every_link(spark, sf, texts):
    want = brute_join(texts)
    got = {r.doc_id: (r.class_id, r.n_links) for r in queries.op5_ngram_join(spark, sf).collect()}
    assert got == want


def test_ngram_join_splits_large_groups(spark, monkeypatch):
    """Many near copies of one text: blocks are compared pair by pair, and no link is lost or counted twice."""
    monkeypatch.setattr(ngram_join, "BLOCK_NODES", 30)
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(200):
        w = list(words)
        for k in rng.choice(120, rng.integers(0, 4), replace=False):
            w[k] = f"x{rng.integers(3)}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_join(dict(rows))


def test_prefix_is_shortened_to_the_recall():
    assert ngram_join.prefix_depth(0.8, 40, 8, 0.999) == 8
    d = ngram_join.prefix_depth(0.8, 10, 8, 0.99)
    assert 1 - (1 - 0.8**d) ** 10 >= 0.99 > 1 - (1 - 0.8 ** (d + 1)) ** 10


def pairs_of_texts(n, words, tail):
    """Pairs of texts of `words` words whose last `tail` words differ; no two pairs share a word."""
    rows = []
    for k in range(n):
        w = [f"p{k}w{i}" for i in range(words)]
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(w[: words - tail] + [f"q{k}w{i}" for i in range(tail)]))]
    return rows


def links_of(spark, rows, **kw):
    nodes = cut(ngram_join.nodes_of(spark.createDataFrame(rows, "doc_id long, text string")))
    sizes = cut(nodes.where("node IS NOT NULL").groupBy("node").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("n_copies")))
    return ngram_join.forest_links(nodes, sizes, **kw)


def test_prefixes_are_shortened_until_measured_recall(spark):
    """Links at the threshold call for shorter prefixes, at production parameters; links far above it do not."""
    at_threshold = pairs_of_texts(200, 94, 10)  # 80 of 100 shingles are shared
    links, depth, recall = links_of(spark, at_threshold)
    assert (links.count(), depth) == (400, 7) and recall >= ngram_join.RECALL
    links, depth, recall = links_of(spark, pairs_of_texts(50, 90, 7))  # 79 of 93
    assert (links.count(), depth) == (100, ngram_join.DEPTH) and recall >= ngram_join.RECALL


def test_shortened_prefixes_find_what_long_ones_miss(spark):
    """At 0.5 a prefix of eight values shows one pair in seven; prefixes are shortened and groups merged until all are found."""
    rows = pairs_of_texts(150, 64, 19) + [(1000 + i, t) for i, t in pairs_of_texts(20, 64, 8)]
    rows += [(2000, rows[0][1] + " x"), (2001, rows[2][1] + " x"), (2002, None), (2003, "")]
    links, depth, recall = links_of(spark, rows, threshold=(1, 2), recall=0.99)
    assert depth < 5 and recall >= 0.99
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), (1, 2), 0.99).collect()}
    want = brute_join(dict(rows), (1, 2))
    assert sum(got[i] == want[i] for i in want) >= 0.99 * len(want)
    assert all(got[i][1] <= want[i][1] for i in want)


def slow_align(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            s = decontamination.MATCH if a[i - 1] == b[j - 1] else decontamination.MISMATCH
            h[i, j] = max(0, h[i - 1, j - 1] + s, h[i - 1, j] + decontamination.GAP, h[i, j - 1] + decontamination.GAP)
    return h.max() / (decontamination.MATCH * len(a))


def test_alignment_is_smith_waterman():
    rng = np.random.default_rng(3)
    pairs = [(rng.integers(0, 5, rng.integers(1, 12)).astype(np.uint32), rng.integers(0, 5, rng.integers(1, 30)).astype(np.uint32)) for _ in range(80)]
    assert decontamination.align(pairs) == pytest.approx([slow_align(a, b) for a, b in pairs])


def test_decontamination_finds_copies_and_edited_copies(spark, sf):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    rng = np.random.default_rng(5)
    rows, want = [], set()
    for r in items.collect():
        words = r.text.split()
        edited = [w for k, w in enumerate(words) if k % 9 != 4]
        edited = [("zz" if k % 11 == 7 else w) for k, w in enumerate(edited)]
        pad = [f"p{x}" for x in rng.integers(0, 10**6, 300)]
        rows.append((r.item_id, " ".join(pad[:150] + edited + pad[150:]).upper()))
        rows.append((1000 + r.item_id, " ".join(pad + words)))
        rows.append((2000 + r.item_id, " ".join(pad + words[: len(words) // 4])))
        want |= {r.item_id, 1000 + r.item_id}
    got = decontamination.contamination(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()
    assert {r.doc_id for r in got} == want
    assert all(r.doc_id % 1000 in r.items for r in got)


def test_decontamination_against_all_pairs(spark, sf, texts):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    plain = {i: " ".join(w.decode() for w in decontamination.plain_words(t.encode())) for i, t in texts.items()}
    want = {(i, k) for k, t in items.items() for i, p in plain.items()
            if f" {' '.join(w.decode() for w in decontamination.plain_words(t.encode()))} " in f" {p} "}
    got = {(r.doc_id, r.item_id) for r in queries.op10_decontamination(spark, sf).collect()}
    assert want <= got
    assert len(got - want) <= 0.2 * len(want)


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def plain_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(EMAIL, text)]
    out += [("ip", *m.span()) for m in re.finditer(IP, text) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [("card", *m.span()) for m in re.finditer(CARD, text) if 13 <= len(digits(m.group())) <= 19 and pii.luhn(digits(m.group()))]
    return out + [("phone", *m.span()) for m in re.finditer(PHONE, text) if 9 <= len(digits(m.group())) <= 15]


def test_pii_base_spans(spark, sf, texts):
    n = 0
    for r in queries.op6_pii(spark, sf).collect():
        spans = plain_spans(texts[r.doc_id])
        text = pii.joined(spans)
        n += len(spans)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert r.spans == text or r.spans.startswith(text + ",term:" if text else "")
        c = Counter(k for k, _, _ in spans)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(c[k] for k in pii.KINDS)
    assert n > 50


@pytest.mark.parametrize("text", [t for _, t in ODD if t and len(t) < 9000] + [
    "1.2.3.4.5.6.7.8.9", "+1+1 234 567 890-+44 (0) 20.7946.0958x", "a@b.c.d-e@f.g", "00000000001.2.3.4", "4111-1111-1111-1111 1", "+12((((((34"])
def test_pii_patterns_equal_the_plain_ones(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_pii_terms_that_disclose_a_value(spark):
    rows = [(i, f"note {i} filler{i} Zebulon wrote from z.q@mail.example.org about item{i} and so on") for i in range(6)]
    rows += [(100 + i, f"plain text number {i} where and so on about things from wrote note stand alone {i * 7}") for i in range(200)]
    got = {r.doc_id: r.spans for r in pii.private_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text = dict(rows)
    for i in range(6):
        terms = [text[i][int(a) : int(b)] for k, a, b in (x.split(":") for x in got[i].split(",")) if k == "term"]
        assert terms == ["Zebulon"]
    assert not any(got[100 + i] for i in range(200))
    copies = [(i, rows[0][1]) for i in range(20)] + rows[6:]
    got = pii.private_spans(spark.createDataFrame(copies, "doc_id long, text string")).collect()
    assert not any("term" in r.spans for r in got)
    assert pii.redact(text[1], "email:34:53,term:16:23") == "note 1 filler1  <EMAIL>" + text[1][53:] or "<NAME>" in pii.redact(text[1], "term:15:22")


def marked_terms(spark, rows):
    """Terms marked in each document."""
    text = dict(rows)
    got = pii.private_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    cut = lambda r: [text[r.doc_id][int(a) : int(b)] for k, a, b in (x.split(":") for x in r.spans.split(",")) if k == "term"]
    return {r.doc_id: cut(r) if r.spans else [] for r in got}


def test_pii_meetings_that_are_enough_do_not_depend_on_the_corpus(spark):
    plain = [(100 + i, f"plain text number {i} where and so on about things from wrote note stand alone {i * 7}") for i in range(2000)]
    met = "note from Zebulon wrote from z.q@mail.example.org about things and so on"
    for others in (plain, plain[:200]):
        # words that are merely rare stay: copies are one meeting, two texts are two
        assert not any(marked_terms(spark, [(1, met), (2, met), *others]).values())
        assert not any(marked_terms(spark, [(1, met), (2, met), (3, "where and " + met), *others]).values())
        got = marked_terms(spark, [(1, met), (2, met), (3, "where and " + met), (4, "alone " + met), *others])
        assert got[1] == got[2] == got[3] == got[4] == ["Zebulon"] and not any(got[i] for i, _ in others)
        mail = (1, f"{plain[0][1]} pomegranate mail x.y@corp.example.org")
        assert not any(marked_terms(spark, [mail, *others]).values())


def test_pii_parts_of_an_address_disclose_it(spark):
    plain = [(100 + i, f"plain text number {i} where and so on about things from wrote note stand alone {i * 7}") for i in range(300)]
    rows = [(1, "a note from Quimby, thing wrote: j.quimby_things@example.org and so on"), (2, "things of plain@example.org stand"), *plain]
    got = marked_terms(spark, rows)
    # `things` and `plain` are words of other texts too
    assert got[1] == ["Quimby"] and not any(got[i] for i, _ in rows[1:])
    # a second text with the name alone leaves doubt
    assert marked_terms(spark, [*rows, (3, "Quimby stand alone")])[1] == []


def plain_disclosing(texts, level=pii.DISCLOSURE):
    """Strengths by counting over distinct texts."""
    held, words = {}, {}
    for t in set(texts):
        spans = plain_spans(t)
        held[t] = {k + ":" + t[a:b].lower() for k, a, b in spans}
        cut = lambda w: w.strip(".,;:!?\"'()[]{}*|<>#$%&")
        words[t] = {cut(m.group()).lower() for m in WORD.finditer(t) if not any(a < m.end() and b > m.start() for _, a, b in spans)}
        words[t] = {w for w in words[t] if len(w) > 1}
    every = {cut_word for t in set(texts) for cut_word in {m.group().lower().strip(".,;:!?\"'()[]{}*|<>#$%&") for m in WORD.finditer(t)}}
    where = {v: frozenset(t for t in held if v in held[t]) for v in set().union(*held.values())}
    first = {}
    for v in sorted(where):
        first.setdefault(where[v], v)
    n_docs = Counter(w for t in set(texts) for w in {m.group().lower().strip(".,;:!?\"'()[]{}*|<>#$%&") for m in WORD.finditer(t)})
    assert every
    out = {}
    for v, ts in where.items():
        local = re.findall("^email:(.*)@", v)
        parts = {x for x in re.split("[._%+0-9-]+", local[0]) if len(x) >= pii.NAME_LETTERS} if local else set()
        for w, both in Counter(w for t in ts for w in words[t]).items():
            prior = pii.NAME_PRIOR if w in parts else 0
            if prior or first[ts] == v:
                strength = (both + prior) / (max(n_docs[w], both) + 1)
                if strength >= level and strength * len(held) >= pii.INFORMS * len(ts):
                    out[v, w] = (len(ts), both, strength)
    return out


def test_pii_strengths_equal_plain_counts(spark, documents, texts):
    extra = [f"{texts[i] or ''} Wendelin said mail w.x{j % 3}@host.example.org or frobnitz{j}@example.org frobnitz{j}" for j, i in enumerate(sorted(texts)[:60])]
    rows = [(k, t) for k, t in texts.items()] + [(10_000_000 + j, t) for j, t in enumerate(extra)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.value, r.term): (r.n_value, r.n_both, r.strength) for r in pii.disclosing(df, pii.find(df)).collect()}
    want = plain_disclosing([t or "" for _, t in rows])
    assert got == want and len(got) > 0


def test_pii_table_passes_all_wanted_terms_and_few_others(spark, monkeypatch):
    terms = spark.range(5000).selectExpr("concat('term', id) AS term")
    table = pii._table(terms)
    assert len(pii._wanted(" ".join(f"Term{i}," for i in range(5000)), table)) == 5000
    assert len(pii._wanted(" ".join(f"other{i}" for i in range(50_000)), table)) < 50
    monkeypatch.setattr(pii, "MAX_BITS", 5)
    assert pii._table(terms) is None and pii._wanted("some words", None) and set(pii._wanted("Some, words", None)) == {"some", "words"}


def test_pii_terms_are_paired_and_marked_in_whole_texts(spark):
    far = " and so on about things" * 3
    rows = [(i, f"Zebulon wrote note {i}{far} from z.q@mail.example.org about things{far} ZEBULON") for i in range(6)]
    rows += [(50, f"about Zebulon, and so on {'things ' * 9}")]  # a text without the value
    rows += [(100 + i, f"plain text number {i} where and so on about things from wrote note stand alone {i * 7}") for i in range(200)]
    got = marked_terms(spark, rows)
    assert all(got[i] == ["Zebulon", "ZEBULON"] for i in range(6)) and got[50] == ["Zebulon"]
    assert not any(got[100 + i] for i in range(200))
    text = {r.doc_id: r.text for r in pii.sanitised(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert text[50] == rows[6][1].replace("Zebulon", "<NAME>") and not any("zebulon" in t.lower() for t in text.values())


def test_mixing_meets_its_targets(spark, sf, documents):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    domains, w = mixing.fit(documents, labels)
    assert domains == ["0-0", "0-1", "1-0", "1-1"]
    members = mixing.memberships(documents.select("doc_id", "text"), domains, w).drop("text").cache()
    shares = {"0-0": 0.1, "0-1": 0.01, "1-0": 0.84, "1-1": 0.05}
    rows, how = mixing.rates(members, domains, shares)
    got = rows.toPandas()
    assert (got.rate >= 0).all() and len(got) == documents.count()
    tokens = np.array([(got.rate * got.n_tokens * got[f"p_{d}"]).sum() for d in range(4)])
    assert tokens / got.n_tokens.sum() == pytest.approx([shares[d] for d in domains], rel=mixing.ACCURACY)
    assert how.steps[-1] == pytest.approx(tokens, rel=1e-3) and how.at_rest and how.met and how.missed.max() <= mixing.ACCURACY
    # the production targets, which give the small toxic domains a small part of what they hold
    _, how = mixing.rates(members, domains)
    assert how.at_rest and how.met and len(how.steps) < mixing.STEPS


def test_mixing_steps_equal_plain_descent(spark):
    rng = np.random.default_rng(2)
    p = rng.dirichlet([1, 1, 1], 200).round(6)
    n = rng.integers(0, 500, 200)
    rows = [(int(i), int(n[i]), *map(float, p[i])) for i in range(200)]
    members = spark.createDataFrame(rows, "doc_id long, n_tokens long, p_0 double, p_1 double, p_2 double")
    shares = {"a": 0.6, "b": 0.3, "c": 0.1}
    rated, how = mixing.rates(members, ["a", "b", "c"], shares)
    got = rated.toPandas().sort_values("doc_id").rate.to_numpy()
    a = p.T * n
    want = a.sum() * np.array([0.6, 0.3, 0.1])
    r = np.ones(200)
    for ridge in how.ridges:
        on = a[:, r > 0] if (r != 1).any() else a
        r = np.maximum(0, r - (a.T @ np.linalg.solve(on @ on.T, a @ r - want) + ridge * (r - 1)) / (1 + ridge))
    assert how.ridges[0] == mixing.RIDGE and how.met
    assert got == pytest.approx(r, abs=1e-6)
    assert a @ got == pytest.approx(want, rel=mixing.ACCURACY)


def test_mixing_of_many_domains_and_two_labels_of_a_document(spark):
    rng = np.random.default_rng(5)
    docs = spark.createDataFrame([(i, " ".join(f"w{i % 20}x{j}" for j in rng.integers(0, 30, 40))) for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 20, 0) for i in range(400)] + [(7, 3, 0), (None, 1, 1), (8, None, 0)], "doc_id long, quality int, toxic int")
    domains, w = mixing.fit(docs, labels)
    assert domains == sorted(f"{q}-0" for q in range(20))  # more than 16, none left out
    members = mixing.memberships(docs, domains, w).drop("text")
    wanted = {d: 2.0 if d == "6-0" else 1.0 for d in domains}
    _, how = mixing.rates(members, domains, wanted)
    assert how.met and how.steps[-1][domains.index("6-0")] == pytest.approx(2 * how.steps[-1][0], rel=0.02)
    again = mixing.fit(docs, labels.orderBy(F.desc("quality")))
    assert again[0] == domains and np.allclose(again[1], w)  # document 7 is of 3-0 in whatever order its labels come
    hopeless = {**dict.fromkeys(domains, 0.0), "none": 1.0}
    assert mixing.rates(members, domains, hopeless)[1].missed.max() >= 0  # no target at all: the rates stay


def test_mixing_says_when_a_target_is_out_of_reach(spark):
    members = spark.createDataFrame([(i, 10, 0.9, 0.1) for i in range(50)], "doc_id long, n_tokens long, p_0 double, p_1 double")
    rated, how = mixing.rates(members, ["a", "b"], {"a": 0.1, "b": 0.9})
    assert not how.met and how.missed.max() > 0.5 and all(r.rate >= 0 for r in rated.collect())


def test_odd_rows(odd, empty, odd_labels, spark):
    trusted = odd_labels.where("quality = 1").select("doc_id")
    items = spark.createDataFrame([(1, None), (2, ""), (3, "two words"), (4, "same text here for all of us"), (None, "no id but some words in it")], "item_id long, text string")
    n = len(ODD)
    rows = quality_rules.quality_rules(odd, trusted).collect()
    assert len(rows) == n and sum(r.kept for r in rows) == 0 or all(r.n_words >= 20 for r in rows if r.kept)
    rows = ngram_join.ngram_join(odd).collect()
    assert len(rows) == n
    by = {r.doc_id: r for r in rows}
    assert (by[7].class_id, by[7].n_links, by[8].n_copies) == (7, 2, 3)
    assert (by[1].class_id, by[1].n_links, by[3].class_id) == (1, 0, 3)
    found = {r.doc_id: list(r["items"]) for r in decontamination.contamination(odd, items).collect()}
    assert found[7] == [4] and found[8] == [4] and 1 not in found
    rows = pii.private_spans(odd).collect()
    assert len(rows) == n
    clean = {(r.doc_id, r.text) for r in pii.sanitised(odd).collect()}
    assert (11, "mail me at <EMAIL>, or <PHONE> now") in clean and (1, None) in clean
    rows = mixing.mixed(odd, odd_labels).collect()
    assert len(rows) == n and all(r.rate >= 0 for r in rows)
    for t in (odd, empty):
        assert len(mixing.mixed(t, odd_labels.limit(0)).collect()) == t.count()
        assert len(quality_rules.quality_rules(t, trusted.limit(0)).collect()) == t.count()
        assert decontamination.contamination(t, items.limit(0)).collect() == []
    assert ngram_join.ngram_join(empty).collect() == []
    assert pii.private_spans(empty).collect() == []


def test_pipeline_stages(spark, sf, documents, texts):
    rules = {r.doc_id: r.kept for r in queries.op2_quality_rules(spark, sf).collect()}
    docs, seen = documents, {}
    from paddock.session import cut

    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut(stage(spark, docs, sf))
        assert docs.columns == documents.columns
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
    kept = {i: texts[i] for i in texts if rules[i]}
    assert seen["quality_rules"] == kept
    classes = brute_join(kept)
    assert set(seen["near_duplicates"]) == {c for c, _ in classes.values()}
    gone = {r.doc_id for r in queries.op10_decontamination(spark, sf).collect()}
    assert set(seen["decontamination"]) == set(seen["near_duplicates"]) - gone
    assert set(seen["pii"]) == set(seen["decontamination"])
    assert not any(plain_spans(t) for t in seen["pii"].values())
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == len(seen["pii"])


def test_pipeline_on_odd_rows(spark, odd, tmp_path):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for t, name in ((docs, "odd"), (docs.limit(0), "none")):
        d = f"{tmp_path}/{name}"
        t.write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(4, "same text here for all of us")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").limit(1 if name == "odd" else 0).write.parquet(f"{d}/labels.parquet")
        corpus_pipeline.run(spark, d).collect()
