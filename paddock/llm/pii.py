"""PII: fixed patterns, then information-theoretic sanitisation of the terms that disclose what they found.

Patterns find e-mail addresses, IPv4 addresses, card numbers and phone numbers; the values found are the protected
entities. A term is any word of a text that holds an entity, outside the entities, lower-cased, without punctuation at its ends.
Over all distinct texts, n(x) is the number that hold x, and

    P(value | term) = (n(term, value) + prior) / (n(term) + 1)

is a cautious estimate: one text more holds the term, and the value only as far as the prior says. -log2 P(value | term) is the information
about the value, in bits, that somebody who reads the term still lacks (its self-information less the pointwise mutual information), so it
does not depend on the size of the corpus. A term discloses a value if P(value | term) reaches DISCLOSURE and the term tells
at least one bit (P(value | term) is twice P(value) or more).

The prior of a term is pooled over its kind: NAME_PRIOR for a term that is a part of the local part of an e-mail address (`smith` of
j.smith@example.org), which discloses it if they meet in the only text that holds either; 0 for all others, which need three
texts. So words that are merely rare stay. Copies of a text are one text. Terms are counted and marked wherever they stand, in all
texts. A marked term with a digit is generalised to `<NUMBER>`, one that begins with a capital to `<NAME>`, and any other is removed.

Values that the same texts hold disclose alike, so one of them is rated for all.

Defined cases. Null texts count as empty: no spans. Repeated rows get equal spans (rows are told apart by key and text). Null keys stay. Empty
tables give no rows. Columns other than key and text are not read by `private_spans` and kept as they are by `sanitised`. Texts are read whole, one slice of
bounded size at a time; a longer text is a slice of its own. Terms of equal strength are all marked.
"""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paddock.llm.batches import bit_table, bounded_broadcast, in_table, map_texts, slices, texts_of
from paddock.session import cut

KINDS = ("email", "ip", "card", "phone")
#: P(value | term) from which on a term discloses a value: at most 0.42 bits are lacking.
DISCLOSURE = 0.75
#: What a text more would say of a term that is part of an address, and letters of such a part at least.
NAME_PRIOR = 0.75
NAME_LETTERS = 4
#: Times P(value) that P(value | term) is at least: one bit.
INFORMS = 2.0
#: A table of repeated texts up to this many rows is broadcast.
REPEATED_ROWS = 1_000_000
#: A table of disclosing terms up to this many rows is broadcast.
TERM_ROWS = 200_000
#: Bits per term and hashes of the table that picks terms to count: 1 of 5,000 other words passes it.
TERM_BITS, HASHES = 32, 4
#: log2 of the largest table; for more terms all words go to the join.
MAX_BITS = 27
#: Distinct terms a task holds before it hands its counts on.
_FLUSH = 200_000

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = ".,;:!?\"'()[]{}*|<>#$%&"
_EDGE_BYTES = _EDGE.encode()
_ASCII_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def emails(s: str) -> list[tuple[int, int]]:
    """Leftmost matches of local part, `@` and dotted domain, in time linear in the text."""
    out, end = [], 0
    at = s.find("@")
    while at >= 0:
        a = at
        while a > end and s[a - 1] in _ASCII_LOCAL:
            a -= 1
        m = _DOMAIN.match(s, at + 1) if a < at else None
        if m:
            out.append((a, m.end()))
            end = m.end()
        # A domain cannot hold `@`, so no `@` is skipped.
        at = s.find("@", max(at + 1, end))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(s: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind in the order of KINDS, then start; code points, end exclusive."""
    out = [("email", a, b) for a, b in emails(s)] if "@" in s else []
    if _DIGIT.search(s):
        for m in _IP.finditer(s):
            # An octet of many digits is too large unless it is zeros; int() of a very long run is never taken.
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m.group().split(".")):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(s):
            digits = re.sub("[^0-9]", "", m.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in s:
            for m in _PHONE.finditer(s):
                if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
                    out.append(("phone", *m.span()))
    return out


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _covered(a: int, b: int, starts: np.ndarray, stops: np.ndarray) -> bool:
    k = int(np.searchsorted(starts, b, "left")) - 1
    return k >= 0 and stops[k] > a


def _terms(s: str, spans, wanted: set[str] | None = None):
    """(term, start, end) of the words outside the entities; with `wanted`, only of those terms."""
    spans = sorted((a, b) for _, a, b in spans)
    starts = np.array([a for a, _ in spans], np.int64)
    stops = np.maximum.accumulate(np.array([b for _, b in spans], np.int64)) if spans else starts
    for m in _WORD.finditer(s):
        raw = m.group()
        term = raw.strip(_EDGE)
        if wanted is not None and term.lower() not in wanted:
            continue
        if len(term) >= 2 and not _covered(*m.span(), starts, stops):
            a = m.start() + len(raw) - len(raw.lstrip(_EDGE))
            yield term.lower(), a, a + len(term)


_FOUND = (
    "_key bigint, fp bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base string, "
    "value array<string>, term array<string>"
)


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Base spans of every document, and the distinct values and terms of those with any; texts do not leave their task."""

    def run(part, texts):
        out = {c.split()[0]: [] for c in _FOUND.split(", ")}
        out["_key"], out["fp"] = part.column(0).to_pylist(), part.column(1).to_pylist()
        for t in texts:
            s = t.decode("utf-8", "replace")
            spans = base_spans(s)
            n = Counter(k for k, _, _ in spans)
            for k in KINDS:
                out["n_" + k].append(n[k])
            out["base"].append(joined(spans))
            out["value"].append(list({kind + ":" + s[a:b].lower() for kind, a, b in spans}))
            out["term"].append(list({w for w, _, _ in _terms(s, spans)}) if spans else [])
        yield out

    rows = docs.select(F.col(key).cast("bigint").alias("_key"), F.xxhash64(text).alias("fp"), F.col(text).alias("text"))
    return map_texts(rows, run, _FOUND, ["_key", "fp"])


def _slots(words: list[bytes], bits: int) -> np.ndarray:
    """HASHES places of each word in a table of 2**bits bits, one row per word."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    steps = (h >> np.uint64(32)) | np.uint64(1)
    places = (h & np.uint64(0xFFFFFFFF))[:, None] + steps[:, None] * np.arange(HASHES, dtype=np.uint64)
    return (places & np.uint64((1 << bits) - 1)).astype(np.int64)


def _table(terms: DataFrame) -> tuple[np.ndarray, int] | None:
    """A bit table sized by the number of terms, so that the share of other words that pass it stays the same at every size.

    None if it would be too large to send to every task: then every word passes, and the join decides.
    """
    bits = max(10, (terms.count() * TERM_BITS - 1).bit_length())
    if bits > MAX_BITS:
        return None

    def run(batches):
        for batch in batches:
            slots = _slots([t.encode() for t in batch.column(0).to_pylist()], bits).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(slots)], names=["slot"])

    return bit_table(terms.select("term").mapInArrow(run, "slot bigint"), bits), bits


def _wanted(s: str, table: tuple[np.ndarray, int] | None) -> list[str]:
    """Distinct terms of a text that pass the table, cut as `_terms` cuts them."""
    words = list({w.strip(_EDGE_BYTES) for w in s.lower().encode().split()})
    if table is None:
        return [w.decode() for w in words if w]
    bits, n = table
    slots = _slots(words, n)
    found = np.ones(len(words), bool)
    for k in range(HASHES):
        hit = np.zeros(len(words), bool)
        hit[in_table(bits, slots[:, k])] = True
        found &= hit
    return [words[i].decode() for i in np.flatnonzero(found)]


def term_counts(docs: DataFrame, terms: DataFrame, repeated: DataFrame, text: str = "text") -> DataFrame:
    """(term, n_docs): distinct texts that hold each term of `terms`, over all documents.

    A text with n copies (`repeated`: fp, n) counts 1 / n at each of them, so texts need not be shuffled to be counted once.
    A bit table tells tasks which terms may be wanted; the join afterwards is exact.
    """
    table = _table(terms)

    def count(batches):
        total = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.float64())], names=["term", "n_docs"])

        for batch in batches:
            for part in slices(batch, "text"):
                for t, share in zip(texts_of(part.column(0)), part.column(1).to_pylist(), strict=True):
                    for w in _wanted(t.decode("utf-8", "replace"), table):
                        total[w] += share
                if len(total) > _FLUSH:
                    yield out()
                    total.clear()
        yield out()

    rows = docs.select(F.xxhash64(text).alias("fp"), F.col(text).alias("text")).join(bounded_broadcast(repeated, REPEATED_ROWS), "fp", "left")
    counts = rows.select("text", F.coalesce(F.lit(1.0) / F.col("n"), F.lit(1.0)).alias("share")).mapInArrow(count, "term string, n_docs double")
    counts = counts.groupBy("term").agg(F.round(F.sum("n_docs")).cast("bigint").alias("n_docs"))
    return counts.join(terms, "term", "left_semi")


def _name_parts(value: Column) -> Column:
    """Parts of the local part of an e-mail value."""
    local = F.regexp_extract(value, "^email:(.*)@", 1)
    return F.filter(F.split(local, "[._%+0-9-]+"), lambda x: F.length(x) >= NAME_LETTERS)


def disclosing(docs: DataFrame, found: DataFrame, text: str = "text", level: float = DISCLOSURE) -> DataFrame:
    """(value, term, n_value, n_docs, n_both, strength): terms that disclose a protected value; of values that the same texts hold, the smallest is named."""
    copies = cut(found.groupBy("fp").agg(F.count(F.lit(1)).alias("n")))
    repeated = cut(copies.where("n > 1"))
    total = float(max(copies.count(), 1))
    # Copies of a text have the same values and terms: one of them stands for all.
    texts = cut(found.where(F.size("value") > 0).groupBy("fp").agg(F.first("value").alias("value"), F.first("term").alias("term")))
    held = cut(texts.select("fp", F.explode("value").alias("value")))
    where = [F.bit_xor(F.xxhash64("fp", F.lit(k))).alias(f"where_{k}") for k in range(2)]
    values = cut(held.groupBy("value").agg(F.count(F.lit(1)).alias("n_value"), *where))
    # Terms of no kind need a value that enough texts hold; a term meets it in at most n_value texts.
    enough = lambda both, prior: both + prior >= level * (both + 1)
    often = values.where(enough(F.col("n_value"), F.lit(0.0))).groupBy("n_value", "where_0", "where_1").agg(F.min("value").alias("value"))
    often = held.join(bounded_broadcast(cut(often.select("value", "n_value")), REPEATED_ROWS), "value").select("fp", "value", "n_value")
    pairs = texts.select("fp", F.explode("term").alias("term")).join(cut(often), "fp").groupBy("value", "term", "n_value").agg(F.count(F.lit(1)).alias("n_both"))
    pairs = pairs.where(enough(F.col("n_both"), F.lit(0.0))).withColumn("prior", F.lit(0.0))
    named = texts.select("term", F.explode(F.filter("value", lambda v: v.startswith("email:"))).alias("value"))
    named = named.select("value", F.explode(F.array_intersect(_name_parts(F.col("value")), "term")).alias("term"))
    named = named.groupBy("value", "term").agg(F.count(F.lit(1)).alias("n_both")).join(values.select("value", "n_value"), "value")
    pairs = cut(pairs.unionByName(named.withColumn("prior", F.lit(NAME_PRIOR)).select(pairs.columns)))
    counts = term_counts(docs, cut(pairs.select("term").distinct()), repeated, text)
    pairs = pairs.join(counts, "term").withColumn("strength", (F.col("n_both") + F.col("prior")) / (F.greatest("n_docs", "n_both") + 1))
    tells = F.col("strength") * total >= INFORMS * F.col("n_value")
    best = pairs.where((F.col("strength") >= level) & tells).groupBy("value", "term", "n_value", "n_docs", "n_both")
    return best.agg(F.max("strength").alias("strength"))


def occurrences(docs: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(_key, fp, start, stop): every place in every text where a term of `terms` stands outside the entities."""
    table = _table(terms)

    def run(part, texts):
        out = {"_key": [], "fp": [], "term": [], "start": [], "stop": []}
        for k, fp, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts, strict=True):
            s = t.decode("utf-8", "replace")
            wanted = set(_wanted(s, table))
            for w, a, b in _terms(s, base_spans(s), wanted) if wanted else ():
                for name, x in zip(out, (k, fp, w, a, b), strict=True):
                    out[name].append(x)
        yield out

    rows = docs.select(F.col(key).cast("bigint").alias("_key"), F.xxhash64(text).alias("fp"), F.col(text).alias("text"))
    places = map_texts(rows, run, "_key bigint, fp bigint, term string, start int, stop int", ["_key", "fp"])
    return places.join(bounded_broadcast(terms, TERM_ROWS), "term").drop("term")


def private_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", level: float = DISCLOSURE) -> DataFrame:
    """Base counts, base spans and all spans of every row of `docs`, with `fp`, the hash that names its text."""
    found = cut(find(docs, key, text))
    bad = disclosing(docs, found, text, level)
    terms = cut(bad.select("term").distinct())
    more = occurrences(docs, terms, key, text).groupBy("_key", "fp").agg(
        F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("start", "stop"))),
                                 lambda z: F.concat(F.lit("term:"), z["start"].cast("string"), F.lit(":"), z["stop"].cast("string"))), ",").alias("more"))
    more = more.withColumnRenamed("_key", "_k").withColumnRenamed("fp", "_f")
    rows = found.drop("value", "term").join(more, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("fp") == F.col("_f")), "left")
    base = F.when(F.col("base") != "", F.col("base"))
    return rows.select(F.col("_key").alias("doc_id"), "fp", *[f"n_{k}" for k in KINDS], F.sha2(F.col("base"), 256).alias("base_sha256"),
                       F.concat_ws(",", base, "more").alias("spans"))


def _replacement(kind: str, raw: str) -> str:
    if kind != "term":
        return f"<{kind.upper()}>"
    if any(c.isdigit() for c in raw):
        return "<NUMBER>"
    return "<NAME>" if raw[:1].isupper() else ""


def redact(s: str, spans: str) -> str:
    """`s` with its spans replaced; where spans overlap, the first of them, and the longest of equal starts, stands."""
    marks = sorted(((int(a), -int(b), k) for k, a, b in (x.split(":") for x in spans.split(","))))
    out, at = [], 0
    for a, b, k in marks:
        if a >= at:
            out += [s[at:a], _replacement(k, s[a:-b])]
            at = -b
        elif -b > at:  # the rest of a span that began inside another
            at = -b
    return "".join([*out, s[at:]])


def sanitised(docs: DataFrame, key: str = "doc_id", text: str = "text", level: float = DISCLOSURE) -> DataFrame:
    """`docs` with private spans replaced in `text`; all other columns as they were."""
    spans = private_spans(docs, key, text, level).where("spans <> ''").select(
        F.col("doc_id").alias("_k"), F.col("fp").alias("_f"), F.col("spans").alias("_spans")).distinct()
    rows = docs.join(spans, F.col(key).cast("bigint").eqNullSafe(F.col("_k")) & (F.xxhash64(text) == F.col("_f")), "left").drop("_k", "_f")
    fields = T.StructType([docs.schema[c] for c in docs.columns])

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                names = part.schema.names
                marks = part.column(names.index("_spans")).to_pylist()
                if any(marks):
                    old = part.column(names.index(text)).to_pylist()
                    new = pa.array([redact(s, m) if m else s for s, m in zip(old, marks, strict=True)], part.column(names.index(text)).type)
                    cols = [new if c == text else part.column(names.index(c)) for c in fields.names]
                else:
                    cols = [part.column(names.index(c)) for c in fields.names]
                yield pa.RecordBatch.from_arrays(cols, names=fields.names)

    return rows.mapInArrow(run, fields)
