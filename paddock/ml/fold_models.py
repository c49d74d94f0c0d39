"""Logistic models of all folds, fold columns, row sets and penalties, fitted together: one scan of the rows per step.

A job is one model: which rows it is fitted on, which columns it may use and its penalty. The solver keeps a (jobs x columns) matrix of
coefficients. Each step is one aggregate: every task sums loss, gradient and Hessian of all jobs over its rows, and the sums, whose size
depends on jobs and columns only, reach the driver, which takes a damped Newton step for each job (by coordinate descent where a
job has an L1 share). So the number of scans is that of the slowest job, some six to ten, however many folds there are. Rows are then
scored once, by an array of all models.

A job minimises

    (1 / sum w) sum w log-loss + reg ((1 - l1) / 2 sum (sd_j b_j)^2 + l1 sum |sd_j b_j|)

with an unpenalised intercept, sd_j being the sample deviation of column j over the job's rows: the objective of the engine's own
logistic regression, here solved to `TOLERANCE`. A column that is constant over a job's rows gets the coefficient 0. A job
without rows of both classes is not separable from its mean: it keeps coefficients 0 and the (bounded) log-odds of its target.

Memory of a task: one Arrow batch, and jobs x columns^2 sums; use it for up to a few hundred columns.
"""

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

TOLERANCE = 1e-9
STEPS = 100
#: Bound of the log-odds of a job whose rows are all of one class.
_ONE_CLASS = 12.0
#: Fold number of rows that join the training part of every job that asks for them.
EXTRA = -1


@dataclass(frozen=True)
class Job:
    """Fitted on rows whose number in fold column `folds` is not null and not `held` (extra rows only if `extra`)."""

    held: int | None = None
    folds: int = 0
    extra: bool = True
    reg: float = 1e-4
    l1: float = 0.0
    #: Indexes of the feature columns it uses; None: all.
    columns: tuple[int, ...] | None = None


@dataclass
class Fit:
    """Coefficients per job, the intercept last; whether each job converged; and the scans it took."""

    weights: np.ndarray
    converged: np.ndarray
    scans: int


def job_table(rows: DataFrame, folds: Sequence[str] = ("fold",), extra: DataFrame | None = None, weight: str | None = None, label="label") -> DataFrame:
    """(x, y, w, f0, f1, ..) of the rows that jobs read at every step; written."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    base = [vector_to_array("features").alias("x"), F.col(label).cast("double").alias("y"), w.alias("w")]
    out = rows.select(*base, *[F.col(f).cast("int").alias(f"f{i}") for i, f in enumerate(folds)])
    if extra is not None:
        out = out.unionByName(extra.select(*base, *[F.lit(EXTRA).alias(f"f{i}") for i in range(len(folds))]))
    return cut(out.where("y IS NOT NULL"))


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Features with a column of ones, label, weight and fold numbers (-2: none) of a batch of `job_table`."""
    n = batch.num_rows
    x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
    f = [batch.column(i).fill_null(-2).to_numpy(zero_copy_only=False) for i in range(3, batch.num_columns)]
    return np.column_stack([x, np.ones(n)]), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False), np.array(f)


def _membership(jobs: Sequence[Job], f: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weight of every row in every job (rows x jobs)."""
    out = np.empty((f.shape[1], len(jobs)))
    for j, job in enumerate(jobs):
        mine = f[job.folds]
        out[:, j] = w * ((mine > -2) & (mine != (job.held if job.held is not None else -3)) & ((mine != EXTRA) | job.extra))
    return out


def _summed(table: DataFrame, size: int, add: Callable[[np.ndarray, tuple], None]) -> np.ndarray:
    """Sum over all rows of what `add(total, arrays)` adds to a task's total of `size` numbers."""

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                add(total, _arrays(batch))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["slot", "v"])

    out = np.zeros(size)
    for r in table.mapInArrow(run, "slot bigint, v double").groupBy("slot").agg(F.sum("v").alias("v")).collect():  # at most `size` rows
        out[r.slot] = r.v
    return out


def _width(table: DataFrame) -> int:
    first = table.select(F.size("x").alias("n")).first()
    return first.n + 1 if first else 1


def _moments(table: DataFrame, jobs: Sequence[Job], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Total weight, target mean and sample deviation of the columns, per job."""
    m = len(jobs)

    def add(total, arrays):
        x, y, w, f = arrays
        member = _membership(jobs, f, w)
        t = total.reshape(m, 2 * width + 2)
        t[:, :width] += member.T @ x
        t[:, width : 2 * width] += member.T @ (x * x)
        t[:, -2] += member.T @ y
        t[:, -1] += (member * member).sum(axis=0)

    t = _summed(table, m * (2 * width + 2), add).reshape(m, -1)
    n = t[:, width - 1]
    safe = np.maximum(n, 1e-300)[:, None]
    mean = t[:, :width] / safe
    free = n - t[:, -1] / safe[:, 0]  # n - 1 for weights of one
    var = (t[:, width : 2 * width] - safe * mean * mean) / np.maximum(free, 1e-300)[:, None]
    sd = np.sqrt(np.maximum(var, 0))
    # beyond rounding, a constant column has no deviation
    sd[sd <= 1e-10 * np.sqrt(t[:, width : 2 * width] / safe)] = 0
    return n, t[:, -2] / safe[:, 0], sd


def _derivatives(table: DataFrame, jobs: Sequence[Job], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of loss, gradient and Hessian per job: one scan."""
    m, width = weights.shape
    upper = np.triu_indices(width)
    size = 1 + width + len(upper[0])

    def add(total, arrays):
        x, y, w, f = arrays
        member = _membership(jobs, f, w)
        z = x @ weights.T
        p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
        t = total.reshape(m, size)
        t[:, 0] += (member * (np.logaddexp(0, z) - y[:, None] * z)).sum(axis=0)
        t[:, 1 : 1 + width] += ((p - y[:, None]) * member).T @ x
        curve = p * (1 - p) * member
        for j in range(m):
            t[j, 1 + width :] += (x.T @ (x * curve[:, j : j + 1]))[upper]

    t = _summed(table, m * size, add).reshape(m, size)
    hessian = np.zeros((m, width, width))
    hessian[:, upper[0], upper[1]] = hessian[:, upper[1], upper[0]] = t[:, 1 + width :]
    return t[:, 0], t[:, 1 : 1 + width], hessian


def _step(b: np.ndarray, g: np.ndarray, h: np.ndarray, ridge: np.ndarray, lasso: np.ndarray) -> np.ndarray:
    """Minimiser of the quadratic model g.d + d'hd/2 plus the penalties at b + d."""
    h = h + np.diag(ridge)
    g = g + ridge * b
    if not lasso.any():
        return b - np.linalg.lstsq(h, g, rcond=None)[0]
    new, diagonal = b.copy(), np.maximum(np.diag(h), 1e-300)
    for _ in range(10_000):
        most = 0.0
        for j in range(len(b)):
            at = diagonal[j] * new[j] - (g[j] + h[j] @ (new - b))
            to = np.sign(at) * max(abs(at) - lasso[j], 0) / diagonal[j]
            most, new[j] = max(most, abs(to - new[j])), to
        if most < TOLERANCE / 10:
            break
    return new


def fit_jobs(table: DataFrame, jobs: Sequence[Job], tolerance: float = TOLERANCE, steps: int = STEPS) -> Fit:
    """All jobs, fitted together. `table` comes from `job_table`."""
    m, width = len(jobs), _width(table)
    n, mean, sd = _moments(table, jobs, width)
    scans = 1
    weights = np.zeros((m, width))
    edge = 1 / (1 + np.exp(_ONE_CLASS))
    mean = np.clip(np.where(n > 0, mean, 0.5), edge, 1 - edge)
    weights[:, -1] = np.log(mean / (1 - mean))
    free = []
    for job, s in zip(jobs, sd, strict=True):
        used = s > 0
        if job.columns is not None:
            used &= np.isin(np.arange(width), job.columns)
        used[-1] = True
        free.append(np.flatnonzero(used))
    one_class = (mean <= edge) | (mean >= 1 - edge) | (n <= 0)
    active, done = ~one_class, one_class.copy()
    trial, best, accepted = weights.copy(), np.full(m, np.inf), weights.copy()
    while active.any() and scans < steps:
        at = np.flatnonzero(active)
        loss, gradient, hessian = _derivatives(table, [jobs[j] for j in at], trial[at])
        scans += 1
        for k, j in enumerate(at):
            job, cols = jobs[j], free[j]
            scale = np.where(cols == width - 1, 1.0, sd[j, cols])
            penalised = cols != width - 1
            ridge, lasso = job.reg * (1 - job.l1) * penalised, job.reg * job.l1 * penalised
            b = trial[j, cols] * scale
            value = loss[k] / n[j] + (ridge * b * b).sum() / 2 + (lasso * np.abs(b)).sum()
            if value > best[j] + 1e-12 * max(1.0, abs(best[j])):
                trial[j] = (trial[j] + accepted[j]) / 2  # the step went too far
                continue
            best[j], accepted[j] = value, trial[j]
            new = _step(b, gradient[k, cols] / n[j] / scale, hessian[k][np.ix_(cols, cols)] / n[j] / scale / scale[:, None], ridge, lasso)
            moved = np.abs(new - b).max()
            trial[j] = 0
            trial[j, cols] = new / scale
            if moved < tolerance:
                accepted[j], done[j], active[j] = trial[j], True, False
    weights[~one_class] = accepted[~one_class]
    return Fit(weights, done, scans)


def scored(rows: DataFrame, weights: np.ndarray, keep: list[str], out="scores") -> DataFrame:
    """`keep` and an array of the probabilities that all models give a row: one scan for all of them."""
    d = rows.select(*keep, vector_to_array("features").alias("_x"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields[:-1]) + f", {out} array<double>"

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            x = batch.column(len(keep)).flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, weights.shape[1] - 1))
            p = 1 / (1 + np.exp(-np.clip(np.column_stack([x, np.ones(n)]) @ weights.T, -700, 700)))
            offsets = pa.array(np.arange(n + 1) * len(weights), pa.int32())
            scores = pa.ListArray.from_arrays(offsets, pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], scores], names=[*keep, out])

    return d.mapInArrow(run, schema)


def out_of_fold_logistic(
    rows: DataFrame, k: int, extra: DataFrame | None = None, test: DataFrame | None = None, label="label", fold="fold", key="id", reg: float = 1e-4, l1: float = 0.0,
) -> tuple[DataFrame, DataFrame | None, Fit]:
    """Score every row by the model that did not see its fold; test scores are averaged over the models.

    As `oof.out_of_fold` with a logistic regression, but all folds are fitted in the same scans and rows are scored in one.
    """
    fit = fit_jobs(job_table(rows, [fold], extra, label=label), [Job(held=f, reg=reg, l1=l1) for f in range(k)])
    oof = scored(rows, fit.weights, [key, label, fold]).select(key, label, fold, F.get("scores", F.col(fold).cast("int")).alias("score"))
    tests = None
    if test is not None:
        mean = F.aggregate("scores", F.lit(0.0), lambda a, s: a + s) / k
        tests = scored(test, fit.weights, [key]).select(key, mean.alias("score"))
    return oof, tests, fit
