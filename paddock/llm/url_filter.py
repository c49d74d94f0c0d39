"""URL filters: fixed rules first, then segmented host and path words under multinomial naive Bayes.

Runs of letters in host and path are split into words by a unigram Viterbi search. Word frequencies come from the visible
words of all pages; a piece that is no known word costs log10(10 / (N 10^length)). Naive Bayes (add-one smoothing) learns from distinct URLs: a
URL that a rule blocks, or that holds one of SEED_WORDS, is an example of `block`; any other that a rule allows is one of `allow`. A URL
without a rule is blocked if the log odds of its tokens are above 0.

Null and malformed URLs (no `://`) have empty host and path, no rule and no token: the prior alone would judge them, so
they are allowed. Runs of more than RUN letters are cut into pieces of that length first. Repeated rows are judged alike.
"""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paddock.llm.batches import slices, texts_of
from paddock.session import cut

#: Fixed rules: verdict, host, path.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Fixed words of unwanted sites.
SEED_WORDS = ("spam", "pills", "casino", "viagra", "porn", "xxx", "poker", "betting", "payday", "warez", "torrent", "replica")
RUN = 64
MAX_WORD = 20
_FLUSH = 200_000
_TAG = re.compile(rb"<[^<>]*>")
_LETTERS = re.compile(rb"[a-z]+")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def first_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as (verdict, rule); null if none does."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))).otherwise(out)
    return out


def word_counts(pages: DataFrame, html: str = "html") -> DataFrame:
    """(word, n): visible words of all pages, A-Z lower-cased; tasks combine their counts before the shuffle."""

    def count(batches):
        total = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for part in slices(batch, "html"):
                for t in texts_of(part.column(0)):
                    total.update(w for w in _LETTERS.findall(_TAG.sub(b" ", t).lower()) if len(w) <= MAX_WORD)
                if len(total) > _FLUSH:
                    yield out()
                    total.clear()
        yield out()

    rows = pages.select(F.col(html).alias("html")).mapInArrow(count, "word string, n bigint")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def viterbi(run: str, counts: dict[str, int], total: float) -> list[str]:
    """The most likely split of a run of letters; of equals, the one with the longer last word."""
    best, back = [0.0], [0]
    for i in range(1, len(run) + 1):
        top, at = -np.inf, i - 1
        for j in range(max(0, i - MAX_WORD), i):
            n = counts.get(run[j:i], 0)
            s = best[j] + (np.log10(n / total) if n else np.log10(10.0 / total) - (i - j))
            if s > top:
                top, at = s, j
        best.append(top)
        back.append(at)
    out, i = [], len(run)
    while i:
        out.append(run[back[i] : i])
        i = back[i]
    return out[::-1]


def segmented(runs: DataFrame, words: DataFrame) -> DataFrame:
    """(run, tokens) for distinct `run`s: each meets the known words among its substrings by a join."""
    total = float(words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n or 1)
    spans = "transform(sequence(1, length(run)), i -> transform(sequence(1, least({m}, length(run) - i + 1)), k -> substr(run, i, k)))".format(m=MAX_WORD)
    pieces = runs.select("run", F.explode(F.array_distinct(F.flatten(F.expr(spans)))).alias("word"))
    known = pieces.join(words, "word").groupBy("run").agg(F.collect_list(F.struct("word", "n")).alias("known"))  # at most RUN * MAX_WORD
    rows = runs.join(known, "run", "left").select("run", F.col("known.word").alias("w"), F.col("known.n").alias("n"))

    def split(batches):
        for b in batches:
            r = b.column(0).to_pylist()
            tokens = [viterbi(x, dict(zip(w or [], n or [], strict=True)), total) for x, w, n in zip(r, b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(tokens, pa.list_(pa.string()))], names=["run", "tokens"])

    return rows.mapInArrow(split, "run string, tokens array<string>")


def _runs(host: Column, path: Column) -> Column:
    """Runs of letters in host and path, cut at RUN letters."""
    letters = F.regexp_extract_all(F.concat(host, F.lit("/"), F.translate(path, _UPPER, _LOWER)), F.lit(f"[a-z]{{1,{RUN}}}"), F.lit(0))
    return letters


def url_verdicts(pages: DataFrame, rules=RULES, seeds=SEED_WORDS, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, host, path, rule, verdict, log_odds) of every page."""
    host, path = host_and_path(F.col("url"))
    urls = pages.select(F.col(url).alias("url")).where(F.col("url").isNotNull()).distinct()
    urls = urls.select("url", host.alias("host"), path.alias("path")).withColumn("fit", first_rule(F.col("host"), F.col("path"), rules))
    urls = cut(urls.select("url", F.col("fit.verdict").alias("ruled"), _runs(F.col("host"), F.col("path")).alias("runs")))
    runs = urls.select("url", "ruled", F.explode("runs").alias("run"))
    splits = cut(segmented(runs.select("run").distinct(), cut(word_counts(pages, html))))
    seed = F.arrays_overlap("tokens", F.array(*[F.lit(s) for s in seeds]))
    # One row per URL and token with its number; a URL's tokens are as many as its letters at most.
    tokens = runs.join(splits.withColumn("seed", seed), "run")
    seeded = tokens.groupBy("url", "ruled").agg(F.max("seed").alias("seed"))
    label = F.when((F.col("ruled") == "block") | F.col("seed"), 1).when(F.col("ruled") == "allow", 0)
    marked = cut(seeded.select("url", label.alias("label")))
    tokens = cut(tokens.select("url", F.explode("tokens").alias("token")).groupBy("url", "token").agg(F.count(F.lit(1)).alias("n")))
    known = tokens.join(marked.where("label IS NOT NULL"), "url")
    counts = cut(known.groupBy("token").agg(F.sum(F.col("n") * F.col("label")).alias("bad"), F.sum(F.col("n") * (1 - F.col("label"))).alias("good")))
    s = counts.agg(F.count(F.lit(1)).alias("v"), F.sum("bad").alias("bad"), F.sum("good").alias("good")).first()
    p = marked.agg(F.sum("label").alias("bad"), F.count("label").alias("n")).first()
    v, bad, good = s.v, (s.bad or 0) + s.v, (s.good or 0) + s.v
    prior = float(np.log(((p.bad or 0) + 1) / ((p.n or 0) - (p.bad or 0) + 1)))
    scale = float(np.log(good / bad)) if v else 0.0
    weights = counts.select("token", (F.log((F.col("bad") + 1) / (F.col("good") + 1)) + scale).alias("w"))
    odds = tokens.join(weights, "token", "left").groupBy("url").agg((F.sum(F.col("n") * F.coalesce("w", F.lit(0.0))) + prior).alias("odds"))
    rows = pages.select(F.col(key).cast("bigint").alias("page_id"), F.col(url).alias("url")).join(odds, "url", "left")
    rows = rows.select("page_id", host.alias("host"), path.alias("path"), F.round("odds", 6).alias("log_odds"))
    fit = first_rule(F.col("host"), F.col("path"), rules)
    own = F.when((F.col("log_odds") > 0) & (F.col("host") != ""), "block").otherwise("allow")
    return rows.withColumn("fit", fit).select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce(F.col("fit.verdict"), own).alias("verdict"), F.coalesce("log_odds", F.lit(0.0)).alias("log_odds"))
