"""The registered queries of this subpackage, each over its whole table with production parameters."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paddock.llm import (
    conversation_trie, decontamination, fingerprints, licenses, lm_mixing, mixing, ngram_join, pii, quality_fm, quality_rules, token_counts, url_filter, vector_codes,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that `labels` marks as good: the target of the quality rules."""
    return _table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")


def with_edits(docs: DataFrame) -> DataFrame:
    """Three edits of every document, made from its own columns: a cut in the first third, a note in the middle, the source at the end."""
    n = F.coalesce(F.length("text"), F.lit(0))
    third, half = (n / 3).cast("int"), (n / 2).cast("int")
    edit = lambda a, b, t: F.struct(a.alias("start"), b.alias("stop"), t.alias("text"))
    return docs.withColumn("edits", F.array(
        edit(third, third + 12, F.lit("")), edit(half, half, F.concat(F.lit(" [seen "), F.coalesce("lang", F.lit("?")), F.lit("] "))),
        edit(n + 100, n + 100, F.concat(F.lit("\n"), F.coalesce("source", F.lit("?"))))))


def op1_lm_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_mixing.lm_scores(_table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.quality_rules(docs, trusted(spark, sf_dir)).drop("text")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.edited_counts(with_edits(_table(spark, sf_dir, "documents")))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(_table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.private_spans(_table(spark, sf_dir, "documents")).drop("fp")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_verdicts(_table(spark, sf_dir, "pages"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_fm.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, score) of every document and item at or above the threshold."""
    found = decontamination.aligned(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.where(F.col("score") >= decontamination.THRESHOLD).withColumnRenamed("_key", "doc_id")


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.conversation_trie(_table(spark, sf_dir, "conversations"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(_table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(_table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (
    op1_lm_mixing, op2_quality_rules, op3_licenses, op4_token_counts, op5_ngram_join, op6_pii, op7_url_filter, op8_mixing, op9_quality_fm, op10_decontamination,
    op11_conversation_trie, op12_fingerprints, op13_vector_codes)}
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACE = r"[\x20\x09-\x0D]"

OP2_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good FROM documents),
-- bytes of every text, and the buckets of the 1-, 2- and 3-byte grams that start at each
x AS (SELECT k, good, hex(encode(text)) AS h FROM d),
b AS (SELECT k, good, i, CAST('0x' || substr(h, 2 * i + 1, 2) AS UBIGINT) AS v, length(h) // 2 AS n FROM (SELECT *, unnest(range(length(h) // 2)) AS i FROM x)),
w AS (SELECT k, good, v AS v0, lead(v, 1) OVER t AS v1, lead(v, 2) OVER t AS v2 FROM b WINDOW t AS (PARTITION BY k ORDER BY i)),
g AS (
  SELECT k, good, (1 * 16777619 + v0) % 4294967296 AS h FROM w
  UNION ALL SELECT k, good, ((2 * 16777619 + v0) * 16777619 + v1) % 4294967296 FROM w WHERE v1 IS NOT NULL
  UNION ALL SELECT k, good, ((((3 * 16777619 + v0) * 16777619 + v1) % 4294967296) * 16777619 + v2) % 4294967296 FROM w WHERE v2 IS NOT NULL),
c AS (SELECT k, good, (h * 2654435769 % 4294967296) // 65536 AS bucket FROM g),
t AS (SELECT bucket, count(*) AS raw, count(*) FILTER (WHERE good) AS target FROM c GROUP BY bucket),
z AS (SELECT 65536 + sum(raw) AS raw, 65536 + sum(target) AS target FROM t),
lr AS (SELECT bucket, CASE WHEN z.target = 65536 THEN 0 ELSE ln((t.target + 1) / z.target) - ln((t.raw + 1) / z.raw) END AS r FROM t, z),
llr AS (SELECT k, avg(r) AS llr FROM c JOIN lr USING (bucket) GROUP BY k),
-- words, windows of eight, lines
ws AS (SELECT k, [x for x in string_split_regex(text, '{_SPACE}+') if x <> ''] AS ws FROM d),
win AS (SELECT k, i, array_to_string(ws[i:i + 7], ' ') AS win FROM (SELECT *, unnest(range(1, len(ws) - 6)) AS i FROM ws)),
rep AS (SELECT k, count(DISTINCT j) AS n FROM (
  SELECT k, unnest(range(i, i + 8)) AS j FROM (SELECT *, count(*) OVER (PARTITION BY k, win) AS m FROM win) WHERE m > 1) GROUP BY k),
dup AS (SELECT k, count(*) - count(DISTINCT line) AS n FROM (SELECT k, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY k),
f AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '{_SPACE}', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, round(coalesce(llr, 0), 6) AS llr
  FROM d JOIN ws USING (k) LEFT JOIN rep USING (k) LEFT JOIN dup USING (k) LEFT JOIN llr USING (k)),
v AS (SELECT *, n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM f)
SELECT *, NOT base_failed AND llr >= {quality_rules.THRESHOLD} AS kept FROM v"""

OP5_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, [x for x in string_split_regex({_LOWER}, '{_SPACE}+') if x <> ''] AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE [array_to_string(ws[i:i + 4], ' ') for i in range(1, len(ws) - 3)] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b, i = x.c AND i = y.c AS same FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 5 * i >= 4 * (x.c + y.c - i)),
r AS (SELECT doc_id, doc_id AS m FROM documents UNION SELECT l.b, r.m FROM r JOIN l ON l.a = r.doc_id),
c AS (SELECT doc_id, min(m) AS class_id FROM r GROUP BY doc_id),
k AS (SELECT a AS doc_id, count(*) AS links, count(*) FILTER (WHERE same) AS copies, min(b) FILTER (WHERE same) AS first FROM l GROUP BY a)
SELECT doc_id, class_id, least(doc_id, coalesce(first, doc_id)) AS copy_id, 1 + coalesce(copies, 0) AS n_copies, coalesce(links, 0) AS n_links
FROM c LEFT JOIN k USING (doc_id)"""

#: crc32 of a number's decimal digits: bytes (marked by 256) are mixed in, zeros are steps by one bit.
_CRC = (
    "xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: [256 + ascii(x), 0, 0, 0, 0, 0, 0, 0, 0]))), "
    "lambda a, e: CASE WHEN e >= 256 THEN xor(a, e - 256) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END), 4294967295)"
)

OP11_SQL = f"""
WITH o AS (SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS ts FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT *, conv_id - conv_id % 5 AS base, CAST({_CRC} % 9 AS BIGINT) AS h FROM o),
r AS (SELECT h.conv_id, list_concat(list_slice(coalesce(b.ts, []), 1, h.h), list_slice(h.ts, h.h + 1, len(h.ts))) AS s FROM h LEFT JOIN o b ON b.conv_id = h.base),
p AS (SELECT conv_id, d, list_slice(s, 1, d) AS s, d = len(s) AS ended FROM (SELECT *, unnest(range(len(s) + 1)) AS d FROM r)),
n AS (SELECT s, any_value(d) AS d, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CASE WHEN ended THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256 FROM p GROUP BY s),
k AS (SELECT list_slice(s, 1, d - 1) AS s, count(*) AS n FROM n WHERE d > 0 GROUP BY 1),
m AS (SELECT n.*, coalesce(k.n, 0) AS n_children, (n_convs - 1) * coalesce(strlen(n.s[-1].t), 0) AS saved FROM n LEFT JOIN k USING (s)),
t AS (SELECT p.s, count(*) FILTER (WHERE m.n_children = 0) AS n_leaves, CAST(sum(m.saved) AS BIGINT) AS saved_tokens
  FROM m JOIN p ON p.conv_id = m.conv_id AND p.d <= m.d GROUP BY p.s)
SELECT m.conv_id, m.d AS depth, u.conv_id AS parent_conv_id, m.n_convs, m.n_children, t.n_leaves, t.saved_tokens, m.ends_sha256
FROM m JOIN t USING (s) LEFT JOIN n u ON m.d > 0 AND u.s = list_slice(m.s, 1, m.d - 1)"""


def _op13_round(i: int) -> str:
    """CTEs: the parts' nearest entries in codebook b<i>, and the codebook after that."""
    floored = "CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT)"
    return f"""
a{i} AS (SELECT k, p, min({{'d': d, 'e': e}}) AS best FROM (
  SELECT v.k, v.p, b.e, list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM v JOIN b{i} b USING (p)) GROUP BY k, p),
m{i} AS (SELECT p, e, list(x ORDER BY j) AS x FROM (SELECT p, e, j, {floored} AS x FROM (
  SELECT v.p, a.best.e AS e, unnest(range(len(v.x))) AS j, unnest(v.x) AS x FROM v JOIN a{i} a USING (k, p)) GROUP BY p, e, j) GROUP BY p, e),
b{i + 1} AS (SELECT p, e, coalesce(m.x, b.x) AS x FROM b{i} b LEFT JOIN m{i} m USING (p, e))"""


_R = vector_codes.ROUNDS
OP13_SQL = f"""
WITH f AS (SELECT row_number() OVER (ORDER BY vec_id, v) AS k, * FROM (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({vector_codes.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
v AS (SELECT k, p, list_slice(v, p * len(v) // {vector_codes.PARTS} + 1, (p + 1) * len(v) // {vector_codes.PARTS}) AS x FROM f, range({vector_codes.PARTS}) t(p)),
b0 AS (SELECT p, k - 1 AS e, x FROM v WHERE k <= {vector_codes.ENTRIES}),
{",".join(_op13_round(i) for i in range(_R))},
z AS (SELECT k, p, min({{'d': d, 'e': e}}) AS best FROM (
  SELECT v.k, v.p, b.e, list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM v JOIN b{_R} b USING (p)) GROUP BY k, p),
c AS (SELECT k, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM z GROUP BY k),
s AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS h FROM b{_R})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM f JOIN c USING (k), s"""

#: Alignment, learned models, byte-pair tokens, fingerprints and search for terms have no SQL text; tests/llm hold those queries against brute force.
ORACLES: dict[str, str] = {"op2_quality_rules": OP2_SQL, "op5_ngram_join": OP5_SQL, "op11_conversation_trie": OP11_SQL, "op13_vector_codes": OP13_SQL}
