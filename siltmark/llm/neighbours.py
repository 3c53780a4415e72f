"""Approximate nearest neighbours by cosine: inverted file with product-quantised residuals.

Coarse centroids divide the unit vectors into lists. A vector is stored in the list of its
nearest centroid as the codes of its residual, one byte for each subspace. A query visits
the lists of its nearest centroids; a table of its products with every code word gives the
approximate cosine of each vector there (asymmetric: the query isn't quantised). It is 1 less half the
squared distance from what the codes stand for, whose length isn't quite 1: without that, rows of a tight
group are told apart by what their codes miss along the group's own direction. The best are reranked by the exact cosine of the original vectors in double precision.

Equal vectors are indexed once, with their k + 1 smallest ids: others can't be among any
row's k nearest. Lists near each other form groups of about CHUNK vectors, which a task
compares with all queries that visit any of its lists, so that it returns a query's best once;
a larger group is divided into chunks. It returns what can be among the nearest only: a query's
k + 1 nearest of the fitting sample bound what others must reach, less what an approximate product
falls short of the exact one by. Centroids and code words are fitted on a bounded sample; every row is indexed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import written
from .words import tidy

#: Rows of the sample that centroids and code words are fitted on, at most (about).
SAMPLE = 20_000
#: Lists for each root of the number of vectors, and at most.
LISTS_PER_ROOT, LISTS = 2.0, 4096
CODES = 256
#: Distinct vectors of a group, and of a chunk of it, about.
CHUNK = 4096
#: Distinct vectors that are reranked for each query.
RERANK = 256
#: Recall that the number of visited lists is chosen for, on the sample.
TARGET = 0.99
#: Part of the sample's nearest pairs whose approximate product falls short of the exact one by no more than is allowed for.
SHORT = 0.998
_QUERIES = 128


def usable(v: Column) -> Column:
    """Neither null nor empty nor zero, and all components finite."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # no overflow or underflow of squares
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows, in double precision. Scaling comes in only where a square would overflow or vanish."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    with np.errstate(all="ignore"):
        dot, norm = np.einsum("ij,ij->i", a, b), np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b))
        out = dot / norm
    odd = ~np.isfinite(out) | (norm < 1e-290) | ~np.isfinite(norm)
    if odd.any():
        out[odd] = np.einsum("ij,ij->i", unit(a[odd]), unit(b[odd]))
    return out


def _k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(c))
        c[n > 0] = sums[n > 0] / n[n > 0, None]
        if (n == 0).any():
            c[n == 0] = x[rng.choice(len(x), int((n == 0).sum()))]
    return c


def closeness(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Falls with the distance of each x from each c, in double precision."""
    c = c.astype(np.float64)
    return x.astype(np.float64) @ c.T - 0.5 * np.einsum("ij,ij->i", c, c)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([np.argmax(closeness(p, c), axis=1) for p in np.array_split(x, max(1, len(x) // 2048))]) if len(x) else np.zeros(0, np.int64)


@dataclass
class Quantiser:
    centroids: np.ndarray
    #: code words by subspace
    words: list[np.ndarray]
    #: columns of each subspace
    parts: list[slice]
    visits: int = 1
    #: group of each list
    group: np.ndarray | None = None
    #: unit vectors of the sample, and what an approximate product can fall short of the exact one by
    sample: np.ndarray | None = None
    short: float = 0.0

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near = nearest(x, self.centroids)
        rest = x - self.centroids[near]
        return near, np.stack([nearest(rest[:, p], w) for p, w in zip(self.parts, self.words, strict=True)], axis=1).astype(np.uint8)

    def table(self, q: np.ndarray) -> np.ndarray:
        """Products of each query with all code words: queries, subspaces, codes."""
        out = np.zeros((len(q), len(self.parts), CODES))
        for k, (p, w) in enumerate(zip(self.parts, self.words, strict=True)):
            out[:, k, : len(w)] = q[:, p].astype(np.float64) @ w.T.astype(np.float64)
        return out

    def meant(self, near: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The vectors that lists near and codes stand for."""
        out = self.centroids[near].astype(np.float64)
        for k, (p, w) in enumerate(zip(self.parts, self.words, strict=True)):
            out[:, p] += w[codes[:, k]]
        return out

    def excess(self, near: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """What the product with a meant vector is over 1 less half the squared distance, from its length."""
        m = self.meant(near, codes)
        return 0.5 * (np.einsum("ij,ij->i", m, m) - 1)

    def product(self, q: np.ndarray, near: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Approximate products of queries with the vectors of lists near and codes, row by row."""
        return np.einsum("ij,ij->i", q.astype(np.float64), self.meant(near, codes)) - self.excess(near, codes)

    def least(self, q: np.ndarray, k: int) -> np.ndarray:
        """Approximate products that a query's k nearest reach: the sample has k as near as this, so no farther vector is among them."""
        if len(self.sample) < k:
            return np.full(len(q), -np.inf)
        parts = (np.partition(p @ self.sample.T, -k, axis=1)[:, -k] for p in np.array_split(q, max(1, len(q) // 128)))
        return np.concatenate(list(parts)).astype(np.float64) - self.short - 1e-6


def fit(sample: np.ndarray, rows: int, subspaces: int = 16, k: int = 5) -> Quantiser:
    """From unit vectors of a sample; rows: how many vectors there are. Visits are set by the recall on the sample."""
    rng = np.random.default_rng(0)
    x = sample.astype(np.float32)
    lists = int(min(LISTS, max(1, LISTS_PER_ROOT * rows**0.5), max(1, len(x) // 4)))
    centroids = _k_means(x, lists, rng)
    rest = x - centroids[nearest(x, centroids)]
    edges = np.linspace(0, x.shape[1], min(subspaces, x.shape[1]) + 1).astype(int)
    parts = [slice(int(a), int(b)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    q = Quantiser(centroids, [_k_means(rest[:, p], CODES, rng, 6) for p in parts], parts)
    asked = x[rng.choice(len(x), min(len(x), 400), replace=False)]
    best = np.argsort(-closeness(asked, x), axis=1)[:, 1 : 1 + k]
    order = np.argsort(-closeness(asked, centroids), axis=1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None].repeat(len(order), 0), 1)
    needed = np.sort(np.take_along_axis(place, nearest(x, centroids)[best], 1).ravel()) if best.size else np.zeros(1, int)
    groups = max(1, min(lists, -(-rows // CHUNK)))
    q.group = nearest(centroids, _k_means(centroids, groups, rng)).astype(np.int32)
    q.visits = int(needed[min(len(needed) - 1, int(TARGET * len(needed)))]) + 1
    q.sample = x
    if best.size:
        near, codes = q.encode(x[best.ravel()])
        asker = np.repeat(asked, best.shape[1], axis=0)
        q.short = max(0.0, float(np.quantile(np.einsum("ij,ij->i", asker.astype(np.float64), x[best.ravel()]) - q.product(asker, near, codes), SHORT)))
    return q


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dimensions)


def search(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE, rerank: int = RERANK) -> DataFrame:
    """For each row with is_query its k nearest others: query_id, rank (from 1), the key, score.

    Nearest by cosine, ties to the smaller key. Vectors that are null, empty, zero or hold a
    null or a component that isn't finite take no part, nor do those whose number of
    components isn't the most frequent one. A row's own key is excluded, so repeated rows of
    a key aren't each other's neighbours. Rows without a key take no part. Fewer rows than k
    + 1 give all there are; an empty table gives an empty result. Other columns are ignored.
    """
    spark = vectors.sparkSession
    id_type = vectors.schema[key].dataType
    rows = vectors.where(usable(F.col(vector)) & F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    out_schema = T.StructType([T.StructField("query_id", id_type), T.StructField("rank", T.IntegerType()), T.StructField(key, id_type), T.StructField("score", T.DoubleType())])
    if not sizes:
        return spark.createDataFrame([], out_schema)
    d = sizes[0][0]
    rows = rows.where(F.size("v") == d)
    # one row for each different vector; its smallest ids can answer, all ids that ask are asked for
    ids = F.array_sort(F.collect_set("id"))
    h = F.xxhash64("v")
    ranked = rows.select("id", "v", h.alias("h")).distinct().withColumn("n", F.row_number().over(Window.partitionBy("h", "v").orderBy("id"))).where(F.col("n") <= k + 1)
    distinct = written(ranked.groupBy("h", "v").agg(F.min("id").alias("rep"), ids.alias("ids")).drop("h"), "ann-distinct")
    n = distinct.count()
    rate = min(1.0, sample / n)
    picked = distinct.where(F.pmod(F.xxhash64("rep", F.lit("ann")), F.lit(1 << 30)) < int(rate * (1 << 30)) + 1).select("rep", "v").toArrow().sort_by("rep")
    x = unit(np.concatenate([_matrix(b.column(1), d) for b in picked.to_batches()]))
    model = spark.sparkContext.broadcast(fit(x, n, k=k))

    @tidy
    def encode(batches):
        for b in batches:
            if b.num_rows:
                near, codes = model.value.encode(unit(_matrix(b.column(1), d)).astype(np.float32))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.value.group[near]), pa.array(near.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())], ["rep", "group", "list", "codes"])

    encoded = distinct.select("rep", "v").mapInArrow(encode, T.StructType([T.StructField("rep", id_type), T.StructField("group", T.IntegerType()), T.StructField("list", T.IntegerType()), T.StructField("codes", T.BinaryType())]))
    encoded = written(encoded, "ann-index")
    held, in_group = {}, {}  # at most LISTS rows
    for l, g, c in encoded.groupBy("list", "group").count().collect():
        held[l] = c
        in_group[g] = in_group.get(g, 0) + c
    chunks = {g: -(-c // CHUNK) for g, c in in_group.items()}
    shared = spark.sparkContext.broadcast((held, chunks))
    chunks_of = F.element_at(F.create_map(*[F.lit(y) for g, c in chunks.items() for y in (g, c)]), F.col("group"))
    index = encoded.withColumn("chunk", F.pmod(F.xxhash64("rep"), chunks_of.cast("long")).cast("int"))

    asking = rows.where("asks").select("v", "id").distinct()
    queries = written(asking.groupBy(F.xxhash64("v").alias("h"), "v").agg(F.min("id").alias("q")).drop("h"), "ann-queries")
    asking = asking.join(queries, "v").select("id", "q")

    @tidy
    def visit(batches):
        m = model.value
        sizes, chunks = shared.value
        for b in batches:
            for a in range(0, b.num_rows, 1024):
                part = b.slice(a, 1024)
                u = unit(_matrix(part.column(1), d)).astype(np.float32)
                order = np.argsort(-closeness(u, m.centroids), axis=1)
                least = m.least(u, k + 1)
                row, where, wanted, early = [], [], [], []
                for i, lists in enumerate(order):
                    found, seen = 0, {}
                    for j, l in enumerate(lists.tolist()):
                        if j >= m.visits and found > rerank:
                            break
                        found += sizes.get(l, 0)
                        if l in sizes:
                            seen.setdefault(int(m.group[l]), []).append(l)
                    for place, (g, visited) in enumerate(seen.items()):
                        for c in range(chunks[g]):
                            row.append(i)
                            where.append((g, c))
                            wanted.append(visited)
                            early.append(place == 0)
                where = np.array(where, np.int32).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row, pa.int64())), pa.array(where[:, 0]), pa.array(where[:, 1]), pa.array(list(u[row]), pa.list_(pa.float32())), pa.array(wanted, pa.list_(pa.int32())), pa.array(early, pa.bool_()), pa.array(least[row], pa.float64())], ["q", "group", "chunk", "u", "lists", "early", "reach"])

    visits = queries.select("q", "v").mapInArrow(visit, T.StructType([T.StructField("q", id_type), T.StructField("group", T.IntegerType()), T.StructField("chunk", T.IntegerType()), T.StructField("u", T.ArrayType(T.FloatType())), T.StructField("lists", T.ArrayType(T.IntegerType())), T.StructField("early", T.BooleanType()), T.StructField("reach", T.DoubleType())]))
    visits = written(visits, "ann-visits")

    def compare(key_, left, right):
        if not left.num_rows or not right.num_rows:
            return pa.table({"q": left.column("q").slice(0, 0), "rep": right.column("rep").slice(0, 0), "near": pa.array([], pa.float64())})
        m = model.value
        codes = np.frombuffer(b"".join(right.column("codes").to_pylist()), np.uint8).reshape(right.num_rows, -1)
        lists, of = np.unique(np.asarray(right.column("list")), return_inverse=True)
        centroids, excess = m.centroids[lists].astype(np.float64), m.excess(lists[of], codes)
        qs, reps, nears = [], [], []
        for a in range(0, left.num_rows, _QUERIES):
            part = left.slice(a, _QUERIES)
            u = np.concatenate([_matrix(c, d) for c in part.column("u").chunks])
            table = m.table(u)
            visited = np.stack([np.isin(lists, x) for x in part.column("lists").to_pylist()])
            near = np.where(visited, u.astype(np.float64) @ centroids.T, -np.inf)[:, of] - excess
            for s in range(codes.shape[1]):
                near += table[:, s, :][:, codes[:, s]]
            best = np.argpartition(-near, min(rerank, len(codes)) - 1, axis=1)[:, :rerank]
            value = np.take_along_axis(near, best, 1)
            over = (value >= np.asarray(part.column("least"))[:, None]) & np.isfinite(value)
            qs.append(np.repeat(np.arange(a, a + len(u)), best.shape[1])[over.ravel()])
            reps.append(best[over])
            nears.append(value[over])
        take = lambda c, i: c.take(pa.array(np.concatenate(i)))
        return pa.table({"q": take(left.column("q"), qs), "rep": take(right.column("rep"), reps), "near": pa.array(np.concatenate(nears), pa.float64())})

    near_schema = T.StructType([T.StructField("q", id_type), T.StructField("rep", id_type), T.StructField("near", T.DoubleType())])

    def compared(rows: DataFrame) -> DataFrame:
        return rows.groupBy("group", "chunk").cogroup(index.groupBy("group", "chunk")).applyInArrow(compare, near_schema)

    def best_of(rows: DataFrame) -> DataFrame:
        return rows.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("near"), "rep"))).where(F.col("n") <= rerank).drop("n")

    # the group of the nearest list first: what the last of their best reaches, others must reach as well
    never = F.lit(float("-inf"))
    first = written(best_of(compared(visits.where("early").select("q", "group", "chunk", "u", "lists", F.col("reach").alias("least")))), "ann-first")
    last = first.groupBy("q").agg(F.when(F.count(F.lit(1)) >= rerank, F.min("near")).otherwise(never).alias("last"))
    rest = compared(visits.where("not early").join(last, "q", "left").select("q", "group", "chunk", "u", "lists", F.greatest("reach", F.coalesce("last", never)).alias("least")))
    best = best_of(first.unionByName(rest))
    pairs = best.join(queries.withColumnRenamed("v", "qv"), "q").join(distinct, "rep").select("q", "qv", "v", "ids")

    @tidy
    def exact(batches):
        for b in batches:
            if b.num_rows:
                s = cosine(_matrix(b.column(1), d), _matrix(b.column(2), d))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), pa.array(s)], ["q", "ids", "score"])

    scored = pairs.mapInArrow(exact, T.StructType([T.StructField("q", id_type), T.StructField("ids", T.ArrayType(id_type)), T.StructField("score", T.DoubleType())]))
    # of a query vector only the k + 1 best rows can answer any of its askers: one of them may be the asker's own
    flat = scored.select("q", "score", F.explode("ids").alias("other"))
    flat = flat.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "other"))).where(F.col("n") <= k + 1).drop("n")
    answers = asking.join(flat, "q").where(F.col("id") != F.col("other"))
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "other"))
    return answers.withColumn("rank", place).where(F.col("rank") <= k).select(F.col("id").alias("query_id"), "rank", F.col("other").alias(key), "score")
