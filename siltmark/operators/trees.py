"""Tree ensembles as comparators: forests, and boosting depth-wise, leaf-wise and with ordered category statistics.

All rows train. Spark cuts each layer at quantiles of all rows (ranks to one part in 10000) and counts equal rows (layers by
bin, label, row sets); every task reads these counted rows, whose number the bins of the layers bound, whatever the number
of rows: layers of many bins each make many. Only a caller that gives `most` has a sample counted. Ensembles are what is distributed:
every model of every row set is a task of its own, and a forest's trees are divided over several. Histograms are of
counted rows, so their cost follows distinct rows. Scores and attributions are of any number of rows, in batches.

Boosting stops when the area under the curve on held-out training rows has not grown for `patience` rounds, and keeps
the trees up to the best round.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .running import running_sums
from .sampling import draw

#: Bins of a layer, nodes of an ensemble, trees of a forest in one task.
BINS, NODES, FOREST_PART = 255, 5_000_000, 25
#: Scores of an ensemble that a task keeps.
KNOWN = 200_000
#: The part of the training rows that only tells when to stop.
HELD = 0.2
#: Weight of the prior in a category's statistic.
PRIOR = 1.0


@dataclass(frozen=True)
class Recipe:
    """How an ensemble is made. boosted: trees are fitted to gradients of the log loss one after another, else each to a bootstrap sample, and averaged."""

    boosted: bool = True
    trees: int = 500
    depth: int = 4
    leaves: int = 1 << 30
    rate: float = 0.05
    rows: float = 0.8
    columns: float = 0.8
    l2: float = 1.0
    least_rows: float = 1.0
    least_curvature: float = 0.0
    #: one split for all nodes of a level
    level: bool = False
    #: categories by ordered statistics of the label
    ordered: bool = False
    patience: int = 30


#: The study's settings.
RECIPES = {
    "random_forest": Recipe(boosted=False, depth=1 << 30, l2=0.0, least_rows=5.0),
    "boosted_depth_wise": Recipe(least_curvature=1.0),
    "boosted_leaf_wise": Recipe(leaves=15, l2=0.0, least_rows=20.0, least_curvature=1e-3),
    "boosted_ordered": Recipe(l2=3.0, columns=1.0, level=True, ordered=True),
}


@dataclass
class Ensemble:
    """Nodes of all trees: where a tree begins, and for each node its layer (-1: a leaf), threshold (at most it: left), children, value and rows."""

    layers: list[str]
    boosted: bool
    base: float
    start: np.ndarray
    layer: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    #: by category of a layer the statistic that stands for it, and for those not seen
    statistics: dict[str, tuple[dict[float, float], float]] = field(default_factory=dict)
    #: areas under the curve on the held rows after each round
    history: list[float] = field(default_factory=list)

    def encoded(self, x: np.ndarray) -> np.ndarray:
        """Layers as the trees see them."""
        x = np.array(x, float)
        for k, c in enumerate(self.layers):
            if c in self.statistics:
                of, other = self.statistics[c]
                codes, where = np.unique(x[:, k], return_inverse=True)
                x[:, k] = np.array([of.get(v, other) for v in codes.tolist()])[where.ravel()] if len(codes) else x[:, k]
        return x

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Log odds of boosted trees, else the mean vote, of encoded rows; equal rows are walked once."""
        out = np.full(len(x), self.base)
        for s in self.start.tolist():
            at = np.full(len(x), s)
            rows = np.flatnonzero(self.layer[at] >= 0)
            while len(rows):
                n = at[rows]
                go = x[rows, self.layer[n]] <= self.threshold[n]
                at[rows] = np.where(go, self.left[n], self.right[n])
                rows = rows[self.layer[at[rows]] >= 0]
            out += self.value[at]
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        of, where = np.unique(self.encoded(x), axis=0, return_inverse=True)
        m = self.margins(of)
        return (1 / (1 + np.exp(-m)) if self.boosted else m)[where.ravel()]

    def leaves(self) -> Iterator[tuple[float, dict[int, tuple[float, float, float]]]]:
        """Each leaf's value and, of each layer on its path, (over, up to, part of the rows that the splits on it leave)."""
        for s in self.start.tolist():
            stack = [(s, {})]
            while stack:
                n, path = stack.pop()
                f = int(self.layer[n])
                if f < 0:
                    yield float(self.value[n]), path
                    continue
                low, high, part = path.get(f, (-np.inf, np.inf, 1.0))
                t, of = float(self.threshold[n]), max(float(self.cover[n]), 1e-300)
                stack.append((int(self.left[n]), path | {f: (low, min(high, t), part * float(self.cover[self.left[n]]) / of)}))
                stack.append((int(self.right[n]), path | {f: (max(low, t), high, part * float(self.cover[self.right[n]]) / of)}))

    def attributions(self, x: np.ndarray) -> tuple[np.ndarray, float]:
        """Exact path-dependent Shapley values of each layer on the margin, and the margin that all share: both sum to the margin.

        A leaf's share of a layer is a sum over the sets of other layers on its path: of those in the set, whether the row goes
        that way; of the others, the part of the training rows that did. Sets of one size are summed as a polynomial's coefficients.
        """
        x, where = np.unique(self.encoded(x), axis=0, return_inverse=True)
        out, expected = np.zeros(x.shape), self.base
        for value, path in self.leaves():
            m = len(path)
            expected += value * float(np.prod([p for _, _, p in path.values()]))
            if not m:
                continue
            goes = {f: ((x[:, f] > low) & (x[:, f] <= high)).astype(float) for f, (low, high, _) in path.items()}
            for f in path:
                sums = [np.ones(len(x))]
                for o, (_, _, part) in path.items():
                    if o != f:
                        sums = [(sums[k] * part if k < len(sums) else 0.0) + (sums[k - 1] * goes[o] if k else 0.0) for k in range(len(sums) + 1)]
                weight, chance = 1.0 / m, 0.0
                for k, c in enumerate(sums):
                    chance = chance + weight * c
                    weight *= (k + 1) / max(m - 1 - k, 1)
                out[:, f] += value * (goes[f] - path[f][2]) * chance
        return out[where.ravel()], expected


class _Scorer:
    """Probabilities by an ensemble. Rows that lie between the same thresholds have the same; those of up to KNOWN are kept, so a task walks few rows, whatever their number."""

    def __init__(self, model: Ensemble) -> None:
        self.model, self.known = model, {}
        self.cuts = [np.unique(model.threshold[model.layer == f]) for f in range(len(model.layers))]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        x = self.model.encoded(x)
        # a leading column of zeros, so that a row without layers has a place
        at = np.zeros((len(x), len(self.cuts) + 1), np.int32)
        for f, cut in enumerate(self.cuts):
            at[:, f + 1] = np.searchsorted(cut, x[:, f])
        _, first, where = np.unique(at.view(f"V{at.shape[1] * 4}").ravel(), return_index=True, return_inverse=True)
        keys = [row.tobytes() for row in at[first]]
        p = np.array([self.known.get(k, np.nan) for k in keys])
        new = np.flatnonzero(np.isnan(p))
        if len(new):
            m = self.model.margins(x[first[new]])
            p[new] = 1 / (1 + np.exp(-m)) if self.model.boosted else m
            room = new[: max(0, KNOWN - len(self.known))]
            self.known |= zip((keys[k] for k in room), p[room].tolist(), strict=True)
        return p[where.ravel()]


class _Nodes:
    def __init__(self) -> None:
        self.layer, self.threshold, self.left, self.right, self.value, self.cover = ([] for _ in range(6))

    def add(self, value: float, cover: float) -> int:
        for of, v in ((self.layer, -1), (self.threshold, 0.0), (self.left, 0), (self.right, 0), (self.value, value), (self.cover, cover)):
            of.append(v)
        return len(self.layer) - 1


def _split(bins: np.ndarray, rows: np.ndarray, g: np.ndarray, h: np.ndarray, w: np.ndarray, columns: Iterable[int], r: Recipe) -> tuple[float, int, int]:
    """(gain, layer, bin) of the best split of rows at "at most bin"; of equal gains the first."""
    best = (0.0, -1, -1)
    g, h, w = g[rows], h[rows], w[rows]
    for f in columns:
        b = bins[rows, f]
        size = int(b.max()) + 1
        if size == 1:
            continue
        sums = [np.cumsum(np.bincount(b, z, size)) for z in (g, h, w)]
        (gl, hl, wl), (gt, ht, wt) = ((s[:-1] for s in sums)), ((s[-1] for s in sums))
        gr, hr, wr = gt - gl, ht - hl, wt - wl
        ok = (wl >= r.least_rows) & (wr >= r.least_rows) & (hl >= r.least_curvature) & (hr >= r.least_curvature) & (wl > 0) & (wr > 0)
        gain = np.where(ok, gl**2 / (hl + r.l2 + 1e-300) + gr**2 / (hr + r.l2 + 1e-300) - gt**2 / (ht + r.l2 + 1e-300), -1.0)
        k = int(np.argmax(gain))
        if gain[k] > best[0] + 1e-12:
            best = (float(gain[k]), f, k)
    return best


def grow(bins: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, w: np.ndarray, r: Recipe, rng: np.random.Generator, nodes: _Nodes, scale: float = 1.0) -> np.ndarray:
    """Adds a tree for gradients g and curvatures h of counted rows, the split of the largest gain first, and gives each row's value."""
    n_layers = bins.shape[1]
    drawn = np.sort(rng.choice(n_layers, max(1, round(n_layers * r.columns)), replace=False)) if r.boosted and r.columns < 1 else np.arange(n_layers)
    per_split = max(1, int(n_layers**0.5))

    def columns() -> np.ndarray:
        return drawn if r.boosted else np.sort(rng.choice(n_layers, per_split, replace=False))

    def leaf(rows: np.ndarray) -> int:
        return nodes.add(-scale * float(g[rows].sum()) / (float(h[rows].sum()) + r.l2 + 1e-300), float(w[rows].sum()))

    out = np.zeros(len(bins))
    live = np.flatnonzero(w > 0)
    first = leaf(live)
    if r.level:
        _grow_level(bins, cuts, g, h, w, r, nodes, first, live, leaf, drawn)
    else:
        waiting: list[tuple] = []
        order = 0

        def offer(node: int, rows: np.ndarray, depth: int) -> None:
            nonlocal order
            if depth < r.depth and len(rows) > 1:
                gain, f, k = _split(bins, rows, g, h, w, columns(), r)
                if f >= 0:
                    heapq.heappush(waiting, (-gain, order, node, f, k, rows, depth))
                    order += 1

        offer(first, live, 0)
        leaves = 1
        while waiting and leaves < r.leaves:
            _, _, node, f, k, rows, depth = heapq.heappop(waiting)
            go = bins[rows, f] <= k
            parts = rows[go], rows[~go]
            nodes.layer[node], nodes.threshold[node] = f, float(cuts[f][k])
            nodes.left[node], nodes.right[node] = leaf(parts[0]), leaf(parts[1])
            nodes.value[node] = 0.0
            leaves += 1
            offer(nodes.left[node], parts[0], depth + 1)
            offer(nodes.right[node], parts[1], depth + 1)
    # every row's leaf, also of those that were not drawn
    stack = [(first, np.arange(len(bins)))]
    while stack:
        node, rows = stack.pop()
        f = nodes.layer[node]
        if f < 0:
            out[rows] = nodes.value[node]
            continue
        go = bins[rows, f] <= np.searchsorted(cuts[f], nodes.threshold[node])
        stack += [(nodes.left[node], rows[go]), (nodes.right[node], rows[~go])]
    return out


def _grow_level(bins, cuts, g, h, w, r, nodes, first, live, leaf, drawn) -> None:
    """Levels of one split each, that of the largest sum of gains."""
    parts = [(first, live)]
    for _ in range(r.depth):
        total: dict[tuple[int, int], float] = {}
        for f in drawn.tolist():
            size = len(cuts[f]) + 1
            gain = np.zeros(size - 1)
            for _, rows in parts:
                if len(rows):
                    gl, hl = (np.cumsum(np.bincount(bins[rows, f], z[rows], size))[:-1] for z in (g, h))
                    gt, ht = float(g[rows].sum()), float(h[rows].sum())
                    gain += gl**2 / (hl + r.l2 + 1e-300) + (gt - gl) ** 2 / (ht - hl + r.l2 + 1e-300) - gt**2 / (ht + r.l2 + 1e-300)
            if size > 1:
                k = int(np.argmax(gain))
                total[f, k] = float(gain[k])
        if not total or max(total.values()) <= 1e-12:
            return
        f, k = max(total, key=lambda x: (total[x], -x[0], -x[1]))
        new = []
        for node, rows in parts:
            go = bins[rows, f] <= k
            nodes.layer[node], nodes.threshold[node], nodes.value[node] = f, float(cuts[f][k]), 0.0
            nodes.left[node], nodes.right[node] = leaf(rows[go]), leaf(rows[~go])
            new += [(nodes.left[node], rows[go]), (nodes.right[node], rows[~go])]
        parts = new


def weighted_auc(y: np.ndarray, score: np.ndarray, w: np.ndarray) -> float:
    """Area under the curve of counted rows, ties counting half; 0.5 where a class is empty."""
    _, where = np.unique(score, return_inverse=True)
    pos, neg = np.bincount(where, w * (y == 1)), np.bincount(where, w * (y != 1))
    both = pos.sum() * neg.sum()
    return float((pos * (np.cumsum(neg) - neg / 2)).sum() / both) if both else 0.5


def first_without_gain(history: list[float], patience: int) -> int:
    """The best of the rounds before the first that lies `patience` rounds after it; -1 of none."""
    best = -1
    for k, v in enumerate(history):
        if best < 0 or v > history[best]:
            best = k
        elif k - best >= patience:
            break
    return best


def train(x: np.ndarray, y: np.ndarray, w: np.ndarray, held: np.ndarray, cuts: list[np.ndarray], layers: list[str], r: Recipe, seed: int, trees: int | None = None) -> Ensemble:
    """An ensemble of counted rows: x are bins, w numbers of rows, held marks those that only tell when to stop."""
    rng, nodes, start = np.random.default_rng(seed), _Nodes(), []
    use = ~held if r.boosted and held.any() else np.ones(len(y), bool)
    n_pos, n_neg = float(w[use & (y == 1)].sum()), float(w[use & (y != 1)].sum())
    count = r.trees if trees is None else trees
    if r.boosted:
        # presences weigh as much as the background
        weight = np.where(y == 1, n_neg / n_pos if n_pos else 1.0, 1.0)
        margin, history = np.zeros(len(y)), []
        for _ in range(count):
            p = 1 / (1 + np.exp(-margin))
            n = np.where(use, w, 0.0)
            n = rng.binomial(n.astype(np.int64), r.rows).astype(float) if r.rows < 1 else n
            start.append(len(nodes.layer))
            margin = margin + grow(x, cuts, (p - y) * weight * n, p * (1 - p) * weight * n, n, r, rng, nodes, r.rate)
            if r.patience and held.any():
                history.append(weighted_auc(y[held], margin[held], w[held]))
                if len(history) - 1 - first_without_gain(history, r.patience) >= r.patience:
                    break
        if history:
            start = start[: first_without_gain(history, r.patience) + 1]
    else:
        history = []
        balance = np.where(y == 1, (n_pos + n_neg) / max(2 * n_pos, 1), (n_pos + n_neg) / max(2 * n_neg, 1))
        for _ in range(count):
            n = rng.poisson(w).astype(float)
            start.append(len(nodes.layer))
            grow(x, cuts, -y * balance * n, balance * n, n, r, rng, nodes, 1.0 / r.trees)
    end = len(nodes.layer) if not start else _end(nodes, start[-1])
    of = [np.array(a[:end], t) for a, t in ((nodes.layer, np.int32), (nodes.threshold, float), (nodes.left, np.int32), (nodes.right, np.int32), (nodes.value, float), (nodes.cover, float))]
    return Ensemble(layers, r.boosted, 0.0, np.array(start, np.int64), *of, history=history)


def merged(bins: np.ndarray, y: np.ndarray, w: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Counted rows of which no two are equal: the numbers of equal ones are added up."""
    of = [*bins.T, held, y]
    at = np.lexsort(of)
    first = np.flatnonzero(np.r_[True, np.any([c[at[1:]] != c[at[:-1]] for c in of], axis=0)]) if len(at) else at
    return bins[at[first]], y[at[first]], np.add.reduceat(w[at], first) if len(at) else w, held[at[first]]


def _end(nodes: _Nodes, start: int) -> int:
    """Where the tree that begins at start ends."""
    last, stack = start, [start]
    while stack:
        n = stack.pop()
        last = max(last, n)
        if nodes.layer[n] >= 0:
            stack += [nodes.left[n], nodes.right[n]]
    return last + 1


def joined(parts: list[Ensemble]) -> Ensemble:
    """One ensemble of the trees of several."""
    first, out, shift = parts[0], [], 0
    for p in parts:
        out.append((p.start + shift, p.layer, p.threshold, p.left + shift, p.right + shift, p.value, p.cover))
        shift += len(p.layer)
    return replace(first, **dict(zip(("start", "layer", "threshold", "left", "right", "value", "cover"), (np.concatenate(a) for a in zip(*out, strict=True)), strict=True)))


def ordered_statistics(df: DataFrame, category: str, label: str, key: str, seed: int | str = 42, prior: float = PRIOR, into: str = "statistic") -> DataFrame:
    """Adds the mean label of the rows of the same category that were drawn before the row, with `prior` rows of the whole table's mean.

    The order is by a hash of the key, which must be distinct. Running totals are by ranges of the order within a category, so a frequent
    category isn't one task. A null category is one of its own; null labels count as 0.
    """
    y = F.coalesce(F.col(label).cast("double"), F.lit(0.0))
    mean = F.broadcast(df.agg(F.coalesce(F.avg(y), F.lit(0.0)).alias("__mean")))
    drawn = df.withColumns({"__draw": draw(F.col(key), seed), "__y": y, "__one": F.lit(1).cast("long")})
    run = running_sums(drawn, "__draw", {"__sum": "__y", "__n": "__one"}, within=[category]).crossJoin(mean)
    value = (F.col("__sum") - F.col("__y") + prior * F.col("__mean")) / (F.col("__n") - 1 + prior)
    return run.withColumn(into, value).drop("__draw", "__y", "__one", "__sum", "__n", "__mean")


def _counted(df: DataFrame, label: str, layers: list[str], key: str, sets: dict[str, Column], categorical: list[str], needs_order: bool, most: int | None, seed: int) -> tuple[pa.Table, list[np.ndarray], dict[str, dict]]:
    """Distinct rows by bin, label, held rows and membership of row sets with their numbers; cuts of the columns; statistics of categories."""
    from .fitting import BITS

    if len(sets) > BITS:
        raise ValueError(f"over {BITS} row sets")
    member = sum((F.when(c, F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, c in enumerate(sets.values())), F.lit(0).cast("long"))
    of = df.select(F.col(label).cast("int").alias("y"), F.col(key).alias("key"), *[F.col(c).cast("double").alias(f"v{k}") for k, c in enumerate(layers)], member.alias("member"))
    of = of.dropna(subset=["y", *(f"v{k}" for k in range(len(layers)))]).where("member <> 0")
    columns, statistics = [f"v{k}" for k in range(len(layers))], {}
    if needs_order:
        for c in categorical:
            k = layers.index(c)
            total = of.groupBy(f"v{k}").agg(F.sum("y").alias("s"), F.count("*").alias("n")).limit(10_001).collect()
            if len(total) > 10_000:
                raise ValueError(f"over 10000 categories of {c}")
            rows = sum(r["n"] for r in total)
            mean = sum(r["s"] for r in total) / rows if rows else 0.0
            statistics[c] = ({r[0]: (r["s"] + PRIOR * mean) / (r["n"] + PRIOR) for r in total}, mean)
            of = ordered_statistics(of, f"v{k}", "y", "key", seed, into=f"o{k}")
            columns.append(f"o{k}")
    # read twice, and a plan of its own: inferring what isn't null through so many aliases takes longer than the rows
    kept = of = of.persist()
    if most is not None:
        n = of.count()
        if n > most and of.select("y", "member", *columns).distinct().count() > most:
            of = of.where(F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1 << 30)) < int(most / n * (1 << 30)))
    edges = of.agg(*[F.array_distinct(F.percentile_approx(c, [k / BINS for k in range(1, BINS)], 10_000)).alias(c) for c in columns]).first()
    cuts = [np.array(sorted(edges[c] or []), float) for c in columns]
    held = (F.pmod(F.xxhash64("key", F.lit("held")), F.lit(1 << 30)) < int(HELD * (1 << 30))).alias("held")

    def binned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = [pa.array(np.searchsorted(cut, batch.column(3 + k).to_numpy()).astype(np.int32)) for k, cut in enumerate(cuts)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *bins], names=["y", "member", "held", *names])

    names = [f"b{k}" for k in range(len(columns))]
    rows = of.select("y", "member", held, *columns).mapInArrow(binned, ", ".join(["y int", "member long", "held boolean", *(f"{n} int" for n in names)]))
    table = rows.groupBy(*rows.columns).agg(F.count("*").alias("w")).toArrow()
    kept.unpersist()
    return table, cuts, statistics


def fit_trees(df: DataFrame, label: str, layers: list[str], key: str, recipes: dict[str, Recipe] | None = None, sets: dict[str, Column] | None = None, categorical: Iterable[str] = (), most: int | None = None, seed: int = 42) -> dict[tuple[str, str], Ensemble]:
    """Ensembles by (row set, recipe). Rows that lack a layer or the label don't train; keys must be distinct.

    All of them do, unless ``most`` is given: then of more distinct rows a hash sample of about that many.
    Draws follow the seed and the counted rows, so reruns agree. An ensemble of over NODES nodes is an error.
    """
    recipes, sets = RECIPES if recipes is None else recipes, {"all": F.lit(True)} if sets is None else sets
    categorical = [c for c in categorical if c in layers]
    needs_order = bool(categorical) and any(r.ordered for r in recipes.values())
    table, cuts, statistics = _counted(df, label, list(layers), key, sets, categorical, needs_order, most, seed)
    columns = [n for n in table.column_names if n[0] == "b"]
    order = [(n, "ascending") for n in ("y", "member", "held", *columns)]
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast((table.sort_by(order), cuts))
    plain, ordered = list(range(len(layers))), list(range(len(layers)))
    for k, c in enumerate(categorical if needs_order else []):
        ordered[list(layers).index(c)] = len(layers) + k
    jobs = []
    for s, name in enumerate(sets):
        for m, r in recipes.items():
            parts = [r.trees] if r.boosted else [min(FOREST_PART, r.trees - a) for a in range(0, r.trees, FOREST_PART)]
            jobs += [(s, name, m, k, n) for k, n in enumerate(parts)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle
        import zlib

        rows, cuts = shared.value
        y, member, held, w = (rows.column(c).to_numpy() for c in ("y", "member", "held", "w"))
        bins = np.stack([rows.column(c).to_numpy() for c in columns], axis=1) if columns else np.zeros((len(y), 0), int)
        for batch in batches:
            for s, name, m, k, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                r, use = recipes[m], (member >> s) & 1 == 1
                of = ordered if r.ordered else plain
                # row sets that share rows tell apart rows that one model doesn't, and so does what only boosting holds
                x, z, count, stop = merged(bins[use][:, of], y[use].astype(float), w[use].astype(float), held[use] & r.boosted)
                made = train(x, z, count, stop, [cuts[c] for c in of], list(layers), r, seed + 1000 * k, n)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([m]), pa.array([k]), pa.array([len(made.layer)]), pa.array([zlib.compress(pickle.dumps(made), 1)], pa.binary())], names=["set", "model", "part", "nodes", "ensemble"])

    tasks = spark.createDataFrame(jobs, "s int, name string, model string, part int, trees int").repartition(min(len(jobs), 1000), F.col("part"), "name", "model")
    made = tasks.mapInArrow(run, "set string, model string, part long, nodes long, ensemble binary").collect()
    if any(sum(r["nodes"] for r in made if (r["set"], r["model"]) == (s, m)) > NODES for s in sets for m in recipes):
        raise ValueError(f"an ensemble has over {NODES} nodes")
    import pickle
    import zlib

    out = {}
    for s in sets:
        for m, r in recipes.items():
            one = joined([pickle.loads(zlib.decompress(x["ensemble"])) for x in sorted((x for x in made if (x["set"], x["model"]) == (s, m)), key=lambda x: x["part"])])
            out[s, m] = replace(one, statistics=statistics if r.ordered else {})
    return out


def scores(df: DataFrame, models: dict[str, Ensemble], rows: dict[str, Column] | None = None, into: str = "model", score: str = "y_score", keep: list[str] | None = None) -> DataFrame:
    """df's rows (or its columns `keep`) once for each model (of `rows`, where it names a condition, only these), with its name and probability. Rows that lack a layer have none."""
    of = df.columns if keep is None else keep
    layers = sorted({c for m in models.values() for c in m.layers})
    names = list(models)
    shared = df.sparkSession.sparkContext.broadcast(models)
    wanted = F.array(*[F.coalesce((rows or {}).get(n, F.lit(True)), F.lit(False)) for n in names])
    inner = df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(of)], *[F.col(f"`{c}`").cast("double").alias(f"v{i}") for i, c in enumerate(layers)], wanted.alias("w"))
    keep = inner.columns[: len(of)]
    schema = ", ".join([*[f"{c} {t}" for c, t in inner.dtypes[: len(keep)]], "m string", "p double"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers = {n: _Scorer(m) for n, m in shared.value.items()}
        for batch in batches:
            x = np.stack([batch.column(len(keep) + i).to_numpy(zero_copy_only=False).astype(float) for i in range(len(layers))], axis=1)
            w = batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).astype(bool).reshape(-1, len(names))
            for k, n in enumerate(names):
                m = shared.value[n]
                at = np.flatnonzero(w[:, k])
                if not len(at):
                    continue
                own = x[at][:, [layers.index(c) for c in m.layers]]
                whole = ~np.isnan(own).any(axis=1)
                p = np.full(len(at), np.nan)
                if whole.any():
                    p[whole] = scorers[n](own[whole])
                part = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array([n] * len(at)), pa.array(p, from_pandas=True)], names=[*keep, "m", "p"])

    return inner.mapInArrow(run, schema).toDF(*of, into, score)


def attributions(df: DataFrame, models: dict[str, Ensemble], key: str) -> DataFrame:
    """(model, key, layer, value, phi, expected): each layer's exact share of each row's margin, and what all rows share. Rows that lack a layer have none."""
    layers = sorted({c for m in models.values() for c in m.layers})
    shared = df.sparkSession.sparkContext.broadcast(models)
    inner = df.select(F.col(key).alias("key"), *[F.col(f"`{c}`").cast("double").alias(f"v{i}") for i, c in enumerate(layers)]).dropna()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack([batch.column(1 + i).to_numpy(zero_copy_only=False) for i in range(len(layers))], axis=1)
            for n, m in shared.value.items():
                own = x[:, [layers.index(c) for c in m.layers]]
                phi, expected = m.attributions(own)
                for k, c in enumerate(m.layers):
                    size = len(own)
                    yield pa.RecordBatch.from_arrays([pa.array([n] * size), batch.column(0), pa.array([c] * size), pa.array(own[:, k]), pa.array(phi[:, k]), pa.array(np.full(size, expected))], names=["model", "key", "layer", "value", "phi", "expected"])

    return inner.mapInArrow(run, f"model string, key {inner.dtypes[0][1]}, layer string, value double, phi double, expected double")


def attribution_summary(phi: DataFrame) -> DataFrame:
    """(model, layer, mean_abs, mean_signed, share, direction): by layer, its part of the model's total, and the rank correlation of value and share of a row."""
    from .stats import spearman

    means = phi.groupBy("model", "layer").agg(F.avg(F.abs("phi")).alias("mean_abs"), F.avg("phi").alias("mean_signed"))
    total = means.groupBy("model").agg(F.sum("mean_abs").alias("__total"))
    rho = spearman(phi, "value", "phi", ["model", "layer"]).select("model", "layer", F.col("rho").alias("direction"))
    share = F.coalesce(F.try_divide(F.col("mean_abs"), F.col("__total")), F.lit(0.0)).alias("share")
    return means.join(total, "model").join(rho, ["model", "layer"], "left").select("model", "layer", "mean_abs", "mean_signed", share, "direction")
