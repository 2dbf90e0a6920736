"""Censored regression kernels in numpy, run as one task for each topic, fold and parameter.

Records with equal features and interval are one row with a weight, and 0/1 features are kept as places, so a fit grows with the
distinct rows. The boosted model is a second-order gradient booster on 0/1 features with the same loss and defaults as usual boosting
libraries, not a re-implementation of one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayflow.functions.normal import FLOOR, interval_probability

SIGMA = (0.05, 64.0)
PENALTIES = (1000.0, 100.0, 10.0, 1.0, 0.1, 0.01, 0.001)
FITS = 128  # tasks that fits are spread over; their tables are small, and would be coalesced into few


def density(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.where(np.isfinite(x), np.exp(-0.5 * np.minimum(x * x, 1400)) / math.sqrt(2 * math.pi), 0.0)


class Indicators:
    """A 0/1 matrix as the places of its ones, with the products that a linear fit needs."""

    def __init__(self, row: np.ndarray, column: np.ndarray, shape: tuple[int, int]) -> None:
        self.row, self.column, self.shape = row, column, shape

    def __matmul__(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, v[self.column], self.shape[0])

    def __getitem__(self, rows: np.ndarray) -> Indicators:
        """The rows of a mask."""
        keep = rows[self.row]
        return Indicators((np.cumsum(rows) - 1)[self.row[keep]], self.column[keep], (int(rows.sum()), self.shape[1]))

    @property
    def T(self) -> Indicators:  # noqa: N802
        return Indicators(self.column, self.row, self.shape[::-1])


def middle(values: np.ndarray, weight: np.ndarray) -> float:
    """The median of values that count by whole weights; 0 of none."""
    if not len(values):
        return 0.0
    order = np.argsort(values, kind="stable")
    upto = np.cumsum(weight[order])
    n = upto[-1]
    at = np.searchsorted(upto, [(n - 1) // 2, n // 2], side="right")
    return float(values[order][at].mean())


def ends_of(lo: np.ndarray, hi: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b = np.isfinite(lo), np.isfinite(hi)
    return np.concatenate([lo[a], hi[b]]), np.concatenate([weight[a], weight[b]])


def likelihood(mu: np.ndarray, log_sigma: float, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each interval (lo - 1, hi]: probability, and first and second derivatives of its negative log by mu and log sigma (mu, s, mu mu, mu s, s s)."""
    sigma = math.exp(log_sigma)
    a, b = (lo - 1 - mu) / sigma, (hi - mu) / sigma
    p = interval_probability(a, b)
    fa, fb = density(a), density(b)
    live = p > FLOOR
    inside = np.where(np.isfinite(lo), np.where(np.isfinite(hi), (lo + hi) / 2, lo), hi)
    a, b = np.where(np.isfinite(a), a, 0.0), np.where(np.isfinite(b), b, 0.0)
    afa, bfb = a * fa, b * fb
    r = (bfb - afa) / p
    g = (fb - fa) / (p * sigma)
    dmu = np.where(live, g, np.clip(mu - inside, -1, 1) / sigma)
    dsig = np.where(live, r, -1.0)
    mm = np.where(live, np.maximum(r / sigma**2 + g * g, 0.0), 0.0)
    ms = np.where(live, (b * bfb - a * afa) / (p * sigma) - g + g * r, 0.0)
    ss = np.where(live, (b * b * bfb - a * a * afa) / p - r + r * r, 0.0)
    return p, dmu, dsig, mm, ms, ss


def objective(theta: np.ndarray, x: np.ndarray | Indicators, lo: np.ndarray, hi: np.ndarray, penalty: float, weight: np.ndarray | float = 1.0) -> tuple[float, np.ndarray]:
    """Penalised negative log likelihood of intervals (lo - 1, hi] and its gradient; theta is intercept, log sigma, slopes."""
    return curved(theta, x, lo, hi, penalty, weight)[:2]


def curved(theta: np.ndarray, x: np.ndarray | Indicators, lo: np.ndarray, hi: np.ndarray, penalty: float, weight: np.ndarray | float = 1.0) -> tuple[float, np.ndarray, tuple[np.ndarray, ...]]:
    """objective() and the weighted second derivatives of its rows (mu mu, mu s, s s)."""
    beta = theta[2:]
    p, dmu, dsig, *second = likelihood(theta[0] + x @ beta, theta[1], lo, hi)
    dmu, dsig = dmu * weight, dsig * weight
    grad = np.concatenate([[dmu.sum()], [dsig.sum()], x.T @ dmu + 2 * penalty * beta])
    return float(-(np.log(p) * weight).sum() + penalty * beta @ beta), grad, tuple(h * weight for h in second)


def newton_step(x: np.ndarray | Indicators, grad: np.ndarray, second: tuple[np.ndarray, ...], penalty: float, free: bool, most: int = 60) -> np.ndarray:
    """The step that the second derivatives give, by preconditioned conjugate gradients; cut short where the curvature is not positive.
    Log sigma stays where it is unless free."""
    mm, ms, ss = second
    places = x if isinstance(x, Indicators) else x * x
    cross, bend = x.T @ ms, ss.sum()
    scale = np.concatenate([[max(mm.sum(), 1e-9)], [max(bend, 1e-9 + abs(grad[1]))], places.T @ mm + 2 * penalty + 1e-9])
    on = np.ones(len(grad))
    on[1] = float(free)

    def times(v: np.ndarray) -> np.ndarray:
        u = mm * (v[0] + x @ v[2:]) + ms * v[1]
        return on * np.concatenate([[u.sum()], [ms.sum() * v[0] + cross @ v[2:] + bend * v[1]], x.T @ u + 2 * penalty * v[2:]])

    step, left = np.zeros(len(grad)), on * grad
    z = left / scale
    way, size = z.copy(), left @ z
    stop = min(0.01, math.sqrt(abs(size))) ** 2 * size
    for _ in range(most):
        if size <= stop:
            break
        h = times(way)
        c = way @ h
        if c <= 0:
            return step if step.any() else z
        step = step + size / c * way
        left = left - size / c * h
        z = left / scale
        size, before = left @ z, size
        way = z + size / before * way
    return step


def fit_ridge(x: np.ndarray | Indicators, lo: np.ndarray, hi: np.ndarray, penalty: float, rounds: int = 200, weight: np.ndarray | None = None, start: np.ndarray | None = None) -> np.ndarray:
    """Minimum by truncated Newton steps with backtracking, from start if there is one; log sigma stays within its bounds."""
    w = np.ones(len(lo)) if weight is None else weight
    least, most = map(math.log, SIGMA)
    if start is None:
        theta = np.zeros(x.shape[1] + 2)
        theta[0], theta[1] = middle(*ends_of(lo, hi, w)), math.log(2)
    else:
        theta = start
    bound = lambda t: np.concatenate([t[:1], [min(max(t[1], least), most)], t[2:]])
    value, grad, second = curved(theta, x, lo, hi, penalty, w)
    for _ in range(rounds):
        free = not (theta[1] <= least and grad[1] > 0 or theta[1] >= most and grad[1] < 0)
        way, step, found = newton_step(x, grad, second, penalty, free), 1.0, False
        way[1] = min(max(way[1], -1.0), 1.0)
        for _ in range(30):
            new = bound(theta - step * way)
            v, g, h = curved(new, x, lo, hi, penalty, w)
            if v <= value - 1e-4 * (grad @ (theta - new)):
                found = True
                break
            step /= 2
        if not found:
            break
        done = value - v < 1e-9 * max(1.0, abs(value))
        theta, value, grad, second = new, v, g, h
        if done:
            break
    return theta


def fit_boosted(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, trees: int = 100, depth: int = 3, rate: float = 0.05, least_weight: float = 5.0, sigma: float = 1.0, weight: np.ndarray | None = None) -> tuple[float, list]:
    """(start, trees) of an accelerated-failure-time booster on 0/1 features: normal errors of scale sigma, leaf penalty 1."""
    w = np.ones(len(lo)) if weight is None else weight
    start = middle(*ends_of(lo, hi, w))
    score = np.full(len(lo), start)
    x = x > 0.5
    forest = []

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, left: int) -> tuple | float:
        sg, sh = g[rows].sum(), h[rows].sum()
        if left and len(rows) > 1:
            on = x[rows]
            g1, h1 = g[rows] @ on, h[rows] @ on
            gain = g1**2 / (h1 + 1) + (sg - g1) ** 2 / (sh - h1 + 1) - sg**2 / (sh + 1)
            gain[(h1 < least_weight) | (sh - h1 < least_weight)] = -1
            best = int(np.argmax(gain)) if len(gain) else -1
            if best >= 0 and gain[best] > 1e-9:
                return best, grow(rows[~on[:, best]], g, h, left - 1), grow(rows[on[:, best]], g, h, left - 1)
        return float(-rate * sg / (sh + 1))

    for _ in range(trees):
        a, b = (lo - 1 - score) / sigma, (hi - score) / sigma
        p, fa, fb = interval_probability(a, b), density(a), density(b)
        g = -(fa - fb) / (p * sigma)
        fin = lambda z, f: np.where(np.isfinite(z), z, 0.0) * f
        h = np.clip(g * g - (fin(a, fa) - fin(b, fb)) / (p * sigma * sigma), 1e-6, None)
        tree = grow(np.arange(len(score)), g * w, h * w, depth)
        forest.append(tree)
        score = score + apply_tree(tree, x)
    return start, forest


def apply_tree(tree: tuple | float, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    on = x[:, tree[0]] > 0.5
    out = np.empty(len(x))
    out[~on], out[on] = apply_tree(tree[1], x[~on]), apply_tree(tree[2], x[on])
    return out


def predict(model: object, x: np.ndarray) -> np.ndarray:
    if isinstance(model, np.ndarray):
        return model[0] + x @ model[2:]
    start, forest = model
    return start + sum((apply_tree(t, x) for t in forest), np.zeros(len(x)))


def principal_components(train: np.ndarray, other: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores of both on the first k components of train; signs make each component's largest loading positive."""
    mean = train.mean(axis=0)
    _, _, v = np.linalg.svd(train - mean, full_matrices=False)
    v = v[:k]
    v = v * np.sign(v[np.arange(len(v)), np.abs(v).argmax(axis=1)])[:, None]
    return (train - mean) @ v.T, (other - mean) @ v.T


def matrix(features: Sequence, vocabulary: list[str]) -> np.ndarray:
    place = {f: i for i, f in enumerate(vocabulary)}
    x = np.zeros((len(features), len(vocabulary)))
    for i, fs in enumerate(features):
        for f in fs if fs is not None else ():
            if f in place:
                x[i, place[f]] = 1
    return x


def indicators(features: Sequence, vocabulary: list[str]) -> Indicators:
    """matrix() by the places of its ones."""
    place = {f: i for i, f in enumerate(vocabulary)}
    ones = [(i, place[f]) for i, fs in enumerate(features) for f in (set(fs) if fs is not None else ()) if f in place]
    row, column = np.array(ones, dtype=np.int64).reshape(-1, 2).T
    return Indicators(row, column, (len(features), len(vocabulary)))


def vocabulary_of(features: Sequence, least: int, weight: Sequence | None = None) -> list[str]:
    n: dict[str, int] = {}
    for fs, w in zip(features, [1] * len(features) if weight is None else weight, strict=True):
        for f in set(fs) if fs is not None else ():
            n[f] = n.get(f, 0) + w
    return sorted(f for f, k in n.items() if k >= least)


def nested_predictions(df: DataFrame, topic: str, record: str, group: str, fold: str, lo: str, hi: str, features: str, learner: str = "ridge", grid: Sequence[float] = PENALTIES, inner: int = 4, least: int = 5) -> DataFrame:
    """(topic, record, fold, predicted, choice): each outer fold is predicted by a model whose parameter was chosen on inner folds of the others.

    Features of the training folds with enough records make the vocabulary; groups never cross inner folds. The choice has the best share of
    predictions within one dilution, the stronger penalty (or smaller model) of equals. One task for each topic and fold, over the distinct
    rows of (group, fold, lo, hi, features) with their numbers of records, and the distinct ones of (inner fold, lo, hi, vocabulary) in the fits;
    only ridge keeps its features as places.
    """
    from assayflow.operators.folds import tie_order

    rows = df.select(topic, record, group, fold, lo, hi, F.array_sort(F.array_distinct(features)).alias(features)).where(F.col(fold).isNotNull())
    cols = [topic, group, fold, lo, hi, features]
    weighted = rows.where(F.col(topic).isNotNull()).groupBy(*cols).agg(F.count("*").alias("__w"))
    tasks = weighted.select(F.col(topic).alias("__t"), F.col(fold).alias("__f")).distinct()
    jobs = tasks.join(weighted, F.col("__t") == F.col(topic)).select("__t", "__f", *cols, "__w")
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    places = indicators if learner == "ridge" else matrix

    def fit(x: np.ndarray | Indicators, a: np.ndarray, b: np.ndarray, w: np.ndarray, p: float, start: object = None) -> object:
        return fit_ridge(x, a, b, p, weight=w, start=start) if learner == "ridge" else fit_boosted(x, a, b, trees=100, depth=int(p), weight=w)

    def agreement(model: object, x: np.ndarray | Indicators, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> float:
        p = np.floor(predict(model, x) + 0.5)
        return float(w[np.maximum(np.maximum(p - b, a - p), 0) <= 1].sum())

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # one order whatever the partitions, so that sums come out alike
        said = pdf[features].map(lambda fs: "" if fs is None else "\0".join(map(str, fs)))
        keys = pd.DataFrame({"g": pdf[group].map(str), "f": pdf[fold].map(str), "lo": pdf[lo], "hi": pdf[hi], "x": said}).reset_index(drop=True)
        pdf = pdf.iloc[keys.sort_values(["g", "f", "lo", "hi", "x"]).index]
        out = pdf[pdf[fold] == pdf["__f"]]
        train = pdf[pdf[fold] != pdf["__f"]]
        if out.empty or train.empty:
            return pd.DataFrame({topic: [], fold: [], features: [], "predicted": [], "choice": []}).astype({"predicted": float, "choice": float})
        out = out.loc[~out[features].map(lambda fs: None if fs is None else tuple(fs)).duplicated()]
        words = vocabulary_of(list(train[features]), least, list(train["__w"]))
        sizes = train.groupby(group)["__w"].sum().to_dict()
        load, place = [0] * inner, {}
        for g in sorted(sizes, key=lambda g: (-sizes[g], tie_order(20260815, str(g)))):
            f = load.index(min(load))
            place[g] = f
            load[f] += sizes[g]
        # rows that are alike once rare features are gone are one
        known = set(words)
        kept = train[features].map(lambda fs: () if fs is None else tuple(f for f in fs if f in known))
        rows = pd.DataFrame({"at": train[group].map(place), "a": train[lo].astype(float), "b": train[hi].astype(float), "x": kept, "w": train["__w"].astype(float)})
        rows = rows.groupby(["at", "a", "b", "x"], sort=False, dropna=False)["w"].sum().reset_index()
        at, a, b, w = (rows[c].to_numpy() for c in ("at", "a", "b", "w"))
        x = places(list(rows["x"]), words)
        hits = np.zeros(len(grid))
        model = None
        for f in sorted(set(at)) if len(set(at)) > 1 else ():
            model = None
            for i, p in enumerate(grid):  # each penalty goes on from the fit before
                model = fit(x[at != f], a[at != f], b[at != f], w[at != f], p, model)
                hits[i] += agreement(model, x[at == f], a[at == f], b[at == f], w[at == f])
        choice = grid[int(hits.argmax())]  # the first of equals
        model = fit(x, a, b, w, choice, model)
        return pd.DataFrame({topic: out[topic], fold: out[fold], features: out[features], "predicted": predict(model, places(list(out[features]), words)), "choice": float(choice)})

    feature_kind = rows.schema[features].dataType.simpleString()
    said = jobs.repartition(FITS, "__t", "__f").groupBy("__t", "__f").applyInPandas(run, f"{topic} {kinds[topic]}, {fold} {kinds[fold]}, {features} {feature_kind}, predicted double, choice double")
    said = said.withColumnsRenamed({topic: "__t", fold: "__f", features: "__x"})
    return rows.join(said, (F.col(topic) == F.col("__t")) & (F.col(fold) == F.col("__f")) & F.col(features).eqNullSafe(F.col("__x"))).select(topic, record, fold, "predicted", "choice")


def predict_batches(model: object, words: list[str]):  # noqa: ANN201
    """mapInPandas function that adds predictions for rows with a features column."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(predicted=predict(model, matrix(list(b["features"]), words)))

    return run
