"""Mixing sources to target weights: soft membership and nonnegative document rates.

A softmax classifier on hashed words, learned from the labelled table, gives each document a posterior over domains; a
domain is one (quality, toxic) combination of that table, however many there are. Each document then gets a rate r >= 0 (how often it is
drawn) such that the expected tokens of every domain meet a target:

    minimise  1/2 (A r - target)' P (A r - target)  +  ridge/2 * sum((r - 1)^2),   A[d, i] = tokens[i] * posterior[i, d].

P is the inverse of A A' over the documents whose rate is above 0 at the step (slightly regularised), so that small domains are met as well
as large ones and the step size doesn't depend on the input's size. Projected gradient: r <- max(0, r - step * gradient).
All that a step needs from the corpus is A r and A A', k and k^2 numbers for k domains, so a step is one aggregate over the rows; a
document's rate follows from the gradients so far, which every step replays, and is never stored between steps. The ridge starts at
RIDGE; where the steps have come to rest and a domain still misses its target by more than ACCURACY, it is lowered,
to LOWEST_RIDGE at least. `rates` returns how the fit went; a target that no rates reach (tokens for a domain that has none) ends
with `met` false and the rates nearest to it.

The classifier learns from about FIT_ROWS labelled documents (chosen by a hash of the key); posteriors, totals and
rates cover all documents. Null and empty texts have no tokens: their rate stays at 1. Texts are read whole, whatever their length. Labels
without a key, quality or toxicity are left out; a document with several labels has the smallest domain by name. A document without a
key has no label but a rate like any other. Without two labelled domains there is one domain, and all rates are 1; an empty table of documents
gives an empty result. Repeated rows are rows of their own. Other columns of either table are not read, whatever their names.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paddock.llm.batches import add_columns, map_texts, word_hashes
from paddock.session import cut

BUCKETS = 1 << 15
FIT_ROWS = 12_000
EPOCHS = 4
RATE = 0.5
L2 = 1e-5
STEPS = 48
#: Change of a domain's tokens, as a share of all tokens, at which the steps are at rest.
TOLERANCE = 1e-5
#: Part of its target that a domain may miss.
ACCURACY = 0.01
RIDGE = 0.02
LOWEST_RIDGE = 1e-5
#: Wanted tokens of a domain (`quality`, `toxic`) against those it has, before all are scaled to the same total.
PREFERENCE = {"1-0": 1.0, "1-1": 0.25, "0-0": 0.5, "0-1": 0.1}


def features(text: bytes) -> np.ndarray:
    """Distinct buckets of a text's words, with one for the bias."""
    words = list({w.strip(b".,;:") for w in text.lower().split()})
    h = word_hashes(words) * np.uint32(2654435769) >> np.uint32(17)
    return np.append(np.unique(h), BUCKETS).astype(np.int32)


def _values(size: int) -> float:
    """All features of a document weigh the same, and longer documents do not weigh more."""
    return 1 / np.sqrt(max(1, size - 1))


def sample(labelled: DataFrame, rows: int, key: str) -> DataFrame:
    """About `rows` rows of the labelled table at most, by a hash of the key; all if there are fewer."""
    n = labelled.count()
    cap = 1 << 30
    return labelled if n <= rows else labelled.where(F.pmod(F.xxhash64(key), F.lit(cap)) < int(cap * rows / n))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", rows: int = FIT_ROWS) -> tuple[list[str], np.ndarray]:
    """Domains and weights (BUCKETS + 1, domains). One task learns from the bounded sample."""
    marked = labels.where(f"{key} IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").select(
        F.col(key).alias("_key"), F.concat_ws("-", "quality", "toxic").alias("domain")).groupBy("_key").agg(F.min("domain").alias("domain"))
    marked = sample(marked, rows, "_key")
    domains = sorted(r.domain for r in marked.select("domain").distinct().collect())  # at most FIT_ROWS, about; in fact the labels' few combinations
    if len(domains) < 2:
        return domains or ["all"], np.zeros((BUCKETS + 1, 1), np.float32)
    joined = docs.select(F.col(key).alias("_key"), F.col(text).alias("text")).join(F.broadcast(marked), "_key")

    def encode(part, texts):
        yield {"domain": part.column(0), "x": [features(t).tobytes() for t in texts], "_key": part.column(1)}

    coded = map_texts(joined, encode, "domain string, x binary, _key bigint", ["domain", "_key"])

    index = {d: i for i, d in enumerate(domains)}

    def learn(batches):
        xs, ys = [], []
        for b in batches:
            xs += [np.frombuffer(x, np.int32) for x in b.column(1).to_pylist()]
            ys += [index[d] for d in b.column(0).to_pylist()]
        w = softmax_fit(xs, np.array(ys, np.int64), len(domains))
        yield pa.RecordBatch.from_arrays([pa.array([w.astype(np.float32).tobytes()])], names=["w"])

    got = coded.repartition(1).sortWithinPartitions("_key", "x").mapInArrow(learn, "w binary").collect()
    return domains, np.frombuffer(bytes(got[0].w), np.float32).reshape(BUCKETS + 1, len(domains)).copy()


def softmax_fit(xs: list[np.ndarray], ys: np.ndarray, k: int) -> np.ndarray:
    """Adagrad over mini-batches in a fixed random order."""
    w, g2 = np.zeros((BUCKETS + 1, k)), np.full((BUCKETS + 1, k), 1e-6)
    rng = np.random.default_rng(7)
    if not len(xs):
        return w
    for _ in range(EPOCHS):
        order = rng.permutation(len(xs))
        for s in range(0, len(order), 64):
            at = order[s : s + 64]
            sizes = np.array([len(xs[i]) for i in at])
            flat, row = np.concatenate([xs[i] for i in at]), np.repeat(np.arange(len(at)), sizes)
            v = np.where(flat == BUCKETS, 1.0, np.repeat([_values(n) for n in sizes], sizes))
            starts = np.cumsum(sizes) - sizes
            z = np.add.reduceat(w[flat] * v[:, None], starts)
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(at)), ys[at]] -= 1
            ids, back = np.unique(flat, return_inverse=True)
            grad = np.zeros((len(ids), k))
            np.add.at(grad, back, p[row] * v[:, None] / len(at))
            grad += L2 * w[ids]
            g2[ids] += grad * grad
            w[ids] -= RATE * grad / np.sqrt(g2[ids])
    return w


def memberships(docs: DataFrame, domains: list[str], w: np.ndarray, text: str = "text") -> DataFrame:
    """`docs` with `n_tokens` and one posterior column p_0, p_1, ... per domain. No shuffle."""
    k = len(domains)

    def columns(texts: list[bytes]) -> dict:
        xs = [features(t) for t in texts]
        sizes = np.array([len(x) for x in xs])
        flat = np.concatenate(xs)
        v = np.where(flat == BUCKETS, 1.0, np.repeat([_values(n) for n in sizes], sizes)).astype(np.float32)
        z = np.add.reduceat(w[flat] * v[:, None], np.cumsum(sizes) - sizes)
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p = np.round(p / p.sum(axis=1, keepdims=True), 6)
        return {"n_tokens": [len(t.split()) for t in texts], **{f"p_{d}": p[:, d].astype(np.float64) for d in range(k)}}

    return add_columns(docs, columns, "n_tokens bigint, " + ", ".join(f"p_{d} double" for d in range(k)), text)


def targets(domains: list[str], now: np.ndarray, shares: dict[str, float] | None) -> np.ndarray:
    """Wanted tokens per domain, as many in all as there are: by given shares (a domain without one gets none), else by PREFERENCE."""
    x = np.array([shares.get(d, 0.0) for d in domains]) if shares is not None else now * [PREFERENCE.get(d, 1.0) for d in domains]
    return now.sum() * x / x.sum() if x.sum() > 0 else now


def replayed(batch: pa.RecordBatch, history: list[tuple[np.ndarray, float]]) -> tuple[np.ndarray, np.ndarray]:
    """Rates of a batch's documents after the steps in `history`, and the tokens (documents, domains) behind A."""
    names = batch.schema.names
    column = lambda c: pc.fill_null(batch.column(names.index(c)), 0).to_numpy(zero_copy_only=False).astype(float)
    k = sum(n.startswith("p_") for n in names)
    a = np.stack([column(f"p_{d}") for d in range(k)], axis=1) * column("n_tokens")[:, None]
    r = np.ones(len(a))
    for g, ridge in history:
        r = np.maximum(0, r - (a @ g + ridge * (r - 1)) / (1 + ridge))
    return r, a


def _sums(members: DataFrame, history: list[tuple[np.ndarray, float]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """A r, and A A' of documents with a rate above 0: each task sums its documents, and one aggregate sums the tasks."""

    def run(batches):
        total, gram = np.zeros(k), np.zeros((k, k))
        for b in batches:
            r, a = replayed(b, history)
            total += r @ a
            on = a[r > 0]
            gram += on.T @ on
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k + k * k)), pa.array(np.append(total, gram))], names=["at", "v"])

    parts = members.select("n_tokens", *[f"p_{d}" for d in range(k)]).mapInArrow(run, "at bigint, v double")
    out = np.zeros(k + k * k)
    for x in parts.groupBy("at").agg(F.sum("v").alias("v")).collect():  # k + k * k rows
        out[x.at] = x.v
    return out[:k], out[k:].reshape(k, k)


def metric(gram: np.ndarray) -> np.ndarray:
    """The inverse of A A', slightly regularised."""
    top = float(np.linalg.eigvalsh(gram)[-1])
    return np.linalg.inv(gram / top + 1e-9 * np.eye(len(gram))) / top if top > 0 else np.zeros_like(gram)


@dataclass
class Fit:
    """How a fit of rates ended: tokens expected of each domain before the first and after every step, those wanted, and each step's ridge."""

    domains: list[str]
    steps: list[np.ndarray]
    wanted: np.ndarray
    ridges: list[float]
    at_rest: bool

    @property
    def missed(self) -> np.ndarray:
        """Part of its target that each domain misses."""
        return np.abs(self.steps[-1] - self.wanted) / np.maximum(self.wanted, 1e-9 * max(1.0, self.wanted.sum()))

    @property
    def met(self) -> bool:
        return bool((np.abs(self.steps[-1] - self.wanted) <= ACCURACY * self.wanted + TOLERANCE * self.wanted.sum()).all())


def rates(
    members: DataFrame, domains: list[str], shares: dict[str, float] | None = None, steps: int = STEPS, ridge: float = RIDGE, lowest: float = LOWEST_RIDGE,
) -> tuple[DataFrame, Fit]:
    """`members` with `rate`, and how the fit went."""
    k = len(domains)
    now, gram = _sums(members, [], k)
    total = max(1.0, now.sum())
    fit_ = Fit(domains, [now], targets(domains, now, shares), [], False)
    history: list[tuple[np.ndarray, float]] = []
    for _ in range(steps):
        history.append(((now - fit_.wanted) @ metric(gram), ridge))
        fit_.ridges.append(ridge)
        after, gram = _sums(members, history, k)
        fit_.at_rest = bool(np.abs(after - now).max() <= TOLERANCE * total)
        now = after
        fit_.steps.append(now)
        if fit_.at_rest:
            if fit_.met or ridge <= lowest:
                break
            ridge = max(lowest, ridge / 8)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.round(replayed(b, history)[0], 9))], names=[*b.schema.names, "rate"])

    fields = T.StructType([*members.schema.fields, T.StructField("rate", T.DoubleType())])
    return members.mapInArrow(run, fields), fit_


def mixed(docs: DataFrame, labels: DataFrame, shares: dict[str, float] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, p_*, rate, missed) of every document; `missed` is the largest part of its target that a domain misses, the same in all rows."""
    domains, w = fit(docs, labels, key, text)
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    members = cut(memberships(rows, domains, w, "text").drop("text"))
    rated, how = rates(members, domains, shares)
    return rated.withColumn("missed", F.round(F.lit(float(how.missed.max())), 6))
