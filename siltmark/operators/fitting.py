"""Many presence-background fits over the same rows, in one scan for each iteration.

A study fits the same kind of model many times: for each fold, each setting of a grid, each set of layers. All of them
read the same table, so one pass sums loss, gradient and curvature for every fit that hasn't converged: tasks add up their
rows (numpy over Arrow batches), and what is shuffled is a number for each task, fit and term or pair of terms, whatever the
number of rows. The steps themselves are of that size and are made on the driver: Newton's, with the L1 penalty kept
exact, halved while the objective doesn't fall. Some ten passes do where gradients alone would need hundreds.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import metrics
from .model import CODES, Additive

#: Row sets whose membership one long column holds.
BITS = 62
#: Distinct rows of a partition of counted rows, about: every pass starts a task for each.
PART = 100_000
#: How many rows one stands for.
ROWS = "__rows"


def counted(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """The columns of the distinct rows, and ROWS. The order of sums apart, a row of n gives what n rows do. Kept in memory or on disk until unpersist()."""
    of = df.select(*[c.alias(n) for n, c in columns.items()])
    kept = of.groupBy(*of.columns).agg(F.count("*").alias(ROWS)).persist()
    out = kept.coalesce(max(8, kept.count() // PART))
    out.unpersist = kept.unpersist
    return out


@dataclass(frozen=True)
class Fit:
    """Layers, the name of the rows that train, and settings."""

    layers: tuple[str, ...]
    rows: str = "all"
    beta: float = 0.5
    classes: str = "LQ"


@dataclass
class _State:
    """Of one fit: coefficients (the intercept first), the objective there, and the step that is tried."""

    theta: np.ndarray
    step: np.ndarray
    size: float = 1.0
    expected: float = -np.inf
    value: float = np.inf
    penalty: float = 0.0
    done: bool = False
    presences: float = 0.0
    rows: float = 0.0
    gradient: np.ndarray = field(default_factory=lambda: np.zeros(0))

    @property
    def tried(self) -> np.ndarray:
        return self.theta + self.size * self.step


def _table(df: DataFrame, presence: str, layers: list[str], sets: dict[str, Column], rows: str | None = None) -> DataFrame:
    flags = list(sets.values())
    words = [sum((F.when(c, F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, c in enumerate(flags[a : a + BITS])), F.lit(0).cast("long")) for a in range(0, len(flags), BITS)]
    columns = {"y": F.col(f"`{presence}`").cast("double")} | {f"v{k}": F.col(f"`{c}`").cast("double") for k, c in enumerate(layers)} | {f"s{k}": w for k, w in enumerate(words)}
    return df.select(*[c.alias(n) for n, c in columns.items()], F.col(rows).alias(ROWS)).persist() if rows else counted(df, columns)


def _summed(of: DataFrame, run, how=F.sum) -> np.ndarray:
    """Totals by slot of what tasks emit as (slot, value)."""
    got = of.mapInArrow(run, "slot int, value double").groupBy("slot").agg(how("value").alias("value")).toArrow()
    out = np.zeros(int(pa.compute.max(got.column(0)).as_py() + 1) if got.num_rows else 0)
    out[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return out


def _slots(values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], names=["slot", "value"])


def _columns(batch: pa.RecordBatch, n_layers: int, n_sets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labels, layers (a row for each) with nan for nulls, and membership of row sets (a row for each)."""
    y = batch.column(0).to_numpy(zero_copy_only=False)
    v = np.stack([batch.column(1 + k).to_numpy(zero_copy_only=False).astype(float) for k in range(n_layers)]) if n_layers else np.zeros((0, len(y)))
    words = [batch.column(1 + n_layers + k).to_numpy() for k in range(-(-n_sets // BITS))]
    member = np.stack([(words[k // BITS] >> (k % BITS)) & 1 for k in range(n_sets)]).astype(bool)
    return y.astype(float), v, member


def _ranges(of: DataFrame, n_layers: int, n_sets: int) -> np.ndarray:
    """(set, layer, 4): least and largest of each layer and of its square among a set's rows; nan where it has none."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((n_sets, n_layers, 4), np.inf)
        for batch in batches:
            _, v, member = _columns(batch, n_layers, n_sets)
            for s in range(n_sets):
                x = v[:, member[s]]
                if x.shape[1]:
                    known = ~np.isnan(x)
                    both = [np.where(known, z, np.inf).min(axis=1) for z in (x, -x, x * x, -x * x)]
                    best[s] = np.minimum(best[s], np.stack(both, axis=1))
        yield _slots(best.ravel())

    out = _summed(of, run, F.min)
    out = (out if len(out) else np.full(n_sets * n_layers * 4, np.inf)).reshape(n_sets, n_layers, 4)
    out[np.isinf(out)] = np.nan
    out[:, :, [1, 3]] *= -1
    return out


def _unit(x: np.ndarray, low: float, high: float) -> np.ndarray:
    """As clamp01."""
    if np.isnan(low) or high == low:
        return np.where(np.isnan(x), np.nan, 0.0)
    return np.clip((x - low) / (high - low), 0.0, 1.0)


def _terms(fit: Fit, index: dict[str, int], codes: dict[str, list[float]]) -> list[tuple[str, str, float | None]]:
    out: list[tuple[str, str, float | None]] = []
    for c in fit.layers:
        if c not in codes:
            out += [(c, kind, None) for kind, letter in (("linear", "L"), ("quadratic", "Q")) if letter in fit.classes]
    for c in fit.layers:
        if c in codes:
            out += [(c, "categorical", k) for k in codes[c]]
    return out


def _newton(gradient: np.ndarray, curvature: np.ndarray, theta: np.ndarray, penalty: float, sweeps: int = 500) -> tuple[np.ndarray, float]:
    """The step that minimises the quadratic model with the L1 penalty on all but the intercept, coordinate by coordinate, and the fall that it promises."""
    d = np.zeros(len(theta))
    diagonal = np.maximum(np.diag(curvature), 1e-10)
    slope = gradient.copy()
    for _ in range(sweeps):
        most = 0.0
        for j in range(len(theta)):
            at = theta[j] + d[j]
            new = at - slope[j] / diagonal[j]
            if j:
                new = np.sign(new) * max(abs(new) - penalty / diagonal[j], 0.0)
            if new != at:
                slope += curvature[:, j] * (new - at)
                d[j] += new - at
                most = max(most, abs(new - at) * diagonal[j] ** 0.5)
        if most < 1e-9:
            break
    fall = float(gradient @ d + penalty * (np.abs(theta + d)[1:].sum() - np.abs(theta)[1:].sum()))
    return d, fall


def _passes(of: DataFrame, fits: list[tuple[Fit, list]], live: list[int], states: list[_State], ranges: np.ndarray, index: dict[str, int], set_of: dict[str, int], background_weight: float) -> dict[int, tuple[float, float, float, np.ndarray, np.ndarray]]:
    """Of each live fit at the coefficients that are tried: presences, rows, loss, gradient and curvature."""
    n_layers, n_sets = len(index), len(set_of)
    tried = {f: states[f].tried for f in live}
    by_set: dict[int, list[int]] = {}
    for f in live:
        by_set.setdefault(set_of[fits[f][0].rows], []).append(f)
    sizes = {f: 3 + (k := len(fits[f][1]) + 1) + k * k for f in live}
    starts = dict(zip(live, np.concatenate([[0], np.cumsum([sizes[f] for f in live])]).astype(int), strict=False))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(sum(sizes.values()))
        for batch in batches:
            y, v, member = _columns(batch, n_layers, n_sets)
            rows = batch.column(batch.num_columns - 1).to_numpy().astype(float)
            for s, of_set in by_set.items():
                m = member[s] & ~np.isnan(y)
                if not m.any():
                    continue
                label, x, number = y[m], v[:, m], rows[m]
                made: dict[tuple, np.ndarray] = {}

                def term(t: tuple, x=x, made=made, s=s) -> np.ndarray:
                    if t not in made:
                        c, kind, code = t
                        z, r = x[index[c]], ranges[s, index[c]]
                        if kind == "categorical":
                            made[t] = np.where(np.isnan(z), np.nan, (z == code).astype(float))
                        else:
                            made[t] = _unit(z, r[0], r[1]) if kind == "linear" else _unit(z * z, r[2], r[3])
                    return made[t]

                for f in of_set:
                    columns = [np.ones(len(label))] + [term(t) for t in fits[f][1]]
                    a = np.stack(columns, axis=1)
                    whole = ~np.isnan(a).any(axis=1)
                    a, l, n = a[whole], label[whole], number[whole]
                    w = np.where(l == 1, 1.0, background_weight) * n
                    eta = a @ tried[f]
                    p = 1 / (1 + np.exp(-np.clip(eta, -700, 700)))
                    signed = np.where(l == 1, -eta, eta)
                    loss = float(w @ np.logaddexp(0, signed))
                    gradient = a.T @ (w * (p - (l == 1)))
                    curvature = (a * (w * p * (1 - p))[:, None]).T @ a
                    b = starts[f]
                    total[b : b + sizes[f]] += np.concatenate([[l @ n, n.sum(), loss], gradient, curvature.ravel()])
        yield _slots(total)

    total = _summed(of, run)
    if not len(total):
        total = np.zeros(sum(sizes.values()))
    out = {}
    for f in live:
        x = total[starts[f] : starts[f] + sizes[f]]
        k = len(fits[f][1]) + 1
        out[f] = float(x[0]), float(x[1]), float(x[2]), x[3 : 3 + k], x[3 + k :].reshape(k, k)
    return out


def fit_all(df: DataFrame, presence: str, fits: dict[str, Fit], sets: dict[str, Column] | None = None, categorical: Iterable[str] = (), background_weight: float = 100.0, iterations: int = 100, tolerance: float = 1e-11, rows: str | None = None) -> dict[str, Additive]:
    """Every fit as an additive model: logistic regression with heavily weighted background and an L1 penalty of beta times the root of the presences.

    sets names conditions on rows; "all" is every row. Features are clamped to their range in a fit's own rows; rows that lack one of its
    layers, or the label, don't train. Equal rows are counted, or ``rows`` tells how many a row stands for; the table is kept in memory or on disk while
    it is scanned. A categorical layer has at most CODES codes.
    """
    sets = {"all": F.lit(True)} | (sets or {})
    sets = {k: c for k, c in sets.items() if any(f.rows == k for f in fits.values())}
    layers = sorted({c for f in fits.values() for c in f.layers})
    index, set_of = {c: k for k, c in enumerate(layers)}, {s: k for k, s in enumerate(sets)}
    of = _table(df, presence, layers, sets, rows)
    try:
        codes = {c: sorted(r[0] for r in of.select(f"v{index[c]}").where(F.col(f"v{index[c]}").isNotNull()).distinct().limit(CODES + 1).collect()) for c in categorical if c in index}
        if over := [c for c in codes if len(codes[c]) > CODES]:
            raise ValueError(f"over {CODES} codes: {over}")
        ranges = _ranges(of, len(layers), len(sets))
        tasks = [(f, _terms(f, index, codes)) for f in fits.values()]
        states = [_State(np.zeros(len(t) + 1), np.zeros(len(t) + 1)) for _, t in tasks]
        for _ in range(iterations):
            live = [k for k, s in enumerate(states) if not s.done]
            if not live:
                break
            for k, (presences, rows, loss, gradient, curvature) in _passes(of, tasks, live, states, ranges, index, set_of, background_weight).items():
                _moved(states[k], tasks[k][0].beta, presences, rows, loss, gradient, curvature, tolerance)
    finally:
        of.unpersist()
    return {name: _additive(t, s, ranges[set_of[f.rows]], index, f.beta) for name, (f, t), s in zip(fits, tasks, states, strict=True)}


def _moved(s: _State, beta: float, presences: float, rows: float, loss: float, gradient: np.ndarray, curvature: np.ndarray, tolerance: float) -> None:
    """Takes the step that was tried if the objective fell, and sets the next one; else halves it."""
    s.presences, s.rows = presences, rows
    s.penalty = beta * max(presences, 1.0) ** 0.5
    at = s.tried
    value = loss + s.penalty * float(np.abs(at[1:]).sum())
    if value > s.value + 1e-4 * s.size * s.expected + 1e-12 * abs(value) and s.size > 1e-6:
        s.size /= 2
        return
    s.theta, s.value, s.gradient, s.size = at, value, gradient, 1.0
    s.step, s.expected = _newton(gradient, curvature, at, s.penalty)
    s.done = not rows or -s.expected <= tolerance * max(1.0, abs(value))


def _additive(terms: list[tuple], s: _State, ranges: np.ndarray, index: dict[str, int], beta: float) -> Additive:
    out = Additive()
    out.fitted = {"presences": int(s.presences), "rows": int(s.rows), "objective": s.value, "intercept": float(s.theta[0]), "beta": beta, "converged": s.done, "slack": _slack(s)}
    for (c, kind, code), w in zip(terms, s.theta[1:].tolist(), strict=True):
        r = np.nan_to_num(ranges[index[c]]).tolist()
        if kind == "linear":
            out.linear[c] = (w, r[0], r[1])
        elif kind == "quadratic":
            out.quadratic[c] = (w, r[2], r[3])
        elif w:
            out.categorical.setdefault(c, {})[code] = w
    return out


def _slack(s: _State) -> float:
    """How far the gradient is from that of an optimum, as a part of the penalty: 0 but for rounding."""
    if not len(s.gradient):
        return 0.0
    g, b = s.gradient[1:], s.theta[1:]
    off = np.where(b != 0, np.abs(g + s.penalty * np.sign(b)), np.maximum(np.abs(g) - s.penalty, 0.0))
    return float(max(off.max(initial=0.0), abs(s.gradient[0])) / s.penalty) if s.penalty else 0.0


def gradients(df: DataFrame, presence: str, models: dict[str, tuple[Additive, Iterable[str], Column | None]], background_weight: float = 100.0) -> DataFrame:
    """(arm, n, presences, worst): the rows a model trains on, and how far the weighted loss's gradient there is from an optimum's, as a part of the penalty.

    Linear and quadratic terms, by built-in functions over the rows: a check of fits that doesn't share their code.
    """
    out = None
    models = {n: (m, list(layers), F.lit(True) if rows is None else rows) for n, (m, layers, rows) in models.items()}
    used = {"y": F.col(presence).cast("double")} | {c: F.col(c) for _, layers, _ in models.values() for c in layers}
    table = counted(df, used | {f"__in{k}": F.coalesce(rows, F.lit(False)) for k, (_, _, rows) in enumerate(models.values())})
    for place, (name, (m, layers, _)) in enumerate(models.items()):
        of = table.where(f"__in{place}").select("y", *layers, ROWS).dropna()
        eta = m.predictor(layers) + m.fitted["intercept"]
        error = F.col(ROWS) * F.when(F.col("y") == 1, 1.0).otherwise(background_weight) * (1 / (1 + F.exp(-eta)) - F.col("y"))
        terms = [(w, Additive(linear={c: (1.0, *r)} if t is m.linear else {}, quadratic={c: (1.0, *r)} if t is m.quadratic else {}).contribution(c)) for t in (m.linear, m.quadratic) for c, (w, *r) in t.items()]
        sums = of.agg(F.coalesce(F.sum(ROWS), F.lit(0).cast("long")).alias("n"), F.sum(F.col("y") * F.col(ROWS)).cast("long").alias("presences"), F.sum(error).alias("g"), *[F.sum(error * x).alias(f"g{k}") for k, (_, x) in enumerate(terms)])
        penalty = m.fitted["beta"] * F.sqrt("presences")
        off = [F.abs(F.col(f"g{k}") + penalty * float(np.sign(w))) if w else F.greatest(F.abs(F.col(f"g{k}")) - penalty, F.lit(0.0)) for k, (w, _) in enumerate(terms)]
        part = sums.select(F.lit(name).alias("arm"), "n", "presences", (F.greatest(F.abs("g"), F.lit(0.0), *off) / penalty).alias("worst"))
        out = part if out is None else out.unionByName(part)
    return out


def scored(df: DataFrame, presence: str, models: dict[str, tuple[Additive, Iterable[str], Column | None]], into: str = "arm", rows: str | None = None) -> DataFrame:
    """(arm, n_pos, n_neg, auc): of each (model, layers, rows) over its rows, all in one scan. An arm whose rows lack a class has no area."""
    arms = [F.struct(F.lit(name).alias(into), F.when(F.lit(True) if where is None else where, m.predictor(list(layers))).alias("eta")) for name, (m, layers, where) in models.items()]
    long = df.select(F.col(presence).alias("y"), *([rows] if rows else []), F.inline(F.array(*arms)))
    found = metrics.auc(long, "y", "eta", [into], rows)
    names = df.sparkSession.createDataFrame([(n,) for n in models], f"{into} string")
    return names.join(found, into, "left")


def likelihoods(df: DataFrame, presence: str, models: dict[str, tuple[Additive, Iterable[str], Column | None]], rows: str | None = None) -> dict[str, tuple[int, float]]:
    """(presences, log likelihood) of the raw output of each (model, layers, rows), normalised over its rows, in one scan."""
    sums = []
    number = F.col(rows) if rows else F.lit(1)
    for k, (m, layers, where) in enumerate(models.values()):
        # features are within 0 and 1, so no exponent is over 0
        top = sum(max(0.0, t[0]) for table in (m.linear, m.quadratic) for t in table.values()) + sum(max([0.0, *c.values()]) for c in m.categorical.values())
        eta = F.when(F.lit(True) if where is None else where, m.predictor(list(layers)) - top)
        here = F.col(presence) == 1
        known = F.coalesce(F.sum(F.when(here & eta.isNotNull(), number)), F.lit(0))
        sums += [F.sum(number * F.exp(eta)).alias(f"z{k}"), known.alias(f"n{k}"), F.sum(F.when(here, number * eta)).alias(f"e{k}")]
    r = df.agg(*sums).first()
    return {name: (int(r[f"n{k}"]), float((r[f"e{k}"] or 0.0) - r[f"n{k}"] * np.log(r[f"z{k}"] or 1.0))) for k, name in enumerate(models)}
