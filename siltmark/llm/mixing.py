"""Mixing sources to target weights by weighted fair queueing. DataFrame functions only.

Every source's documents are shuffled by a hash. A document's virtual finish time is the
number of its source's words up to and including it, divided by the source's target.
Serving documents in the order of that time interleaves the sources in proportion to their
targets; the mix ends where the total budget is spent.

Prefix sums are made in two levels (sums of hash buckets within a source, then within a
bucket), so a source that holds a third of all rows is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import written

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: Rows that one task sums at most, about.
BUCKET_ROWS = 20_000
#: Bins of a histogram of virtual finish times, collected by the driver.
BINS = 4096
#: Sources whose bounds are broadcast at most.
BROADCAST_SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Runs of characters that are no ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """By source: its size, and its target of words.

    The budget is share times all words. Targets are in proportion to the weights except
    that none exceeds most times its source's size; what is cut off goes to the others by
    weight. In the order of size/weight, the sources that stop at their limit are a prefix,
    so that one running sum finds the level of the rest. The windows run over one row for
    each source.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    numbered = by.withColumn("__n", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    limit = numbered.withColumn("__w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("__n") % len(weights) + 1).cast("int")))
    limit = limit.withColumn("__limit", F.lit(most) * F.col("source_size"))
    every = Window.partitionBy(F.lit(1))
    before = Window.orderBy(F.col("__limit") / F.col("__w"), "__n").rowsBetween(Window.unboundedPreceding, -1)
    level = limit.withColumn(
        "__level",
        (F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("__limit").over(before), F.lit(0.0))) / (F.sum("__w").over(every) - F.coalesce(F.sum("__w").over(before), F.lit(0.0))),
    )
    free = level.withColumn("__free", F.col("__limit") / F.col("__w") > F.col("__level"))
    first = Window.partitionBy(F.lit(1))
    free = free.withColumn("__lambda", F.min_by(F.when(F.col("__free"), F.col("__level")), F.when(F.col("__free"), F.struct(F.col("__limit") / F.col("__w"), F.col("__n")))).over(first))
    target = F.when(F.col("__lambda").isNull(), F.col("__limit")).otherwise(F.least(F.col("__limit"), F.col("__lambda") * F.col("__w")))
    return free.select("source", "source_size", target.alias("target"))


def _cutoff(timed: DataFrame, budget: float, epochs: int) -> float:
    """The largest virtual finish time up to which all copies fit the budget together.

    Histograms of BINS bins, each of the bin before in which the budget ends.
    """
    copies = timed.select(F.explode(F.array(*[F.struct(F.col(f"__t{e}").alias("t"), F.col("size").alias("size")) for e in range(epochs)])).alias("c")).select("c.t", "c.size")
    low, high, spent, cut = 0.0, None, 0, 0.0
    while True:
        if high is None:
            high = copies.agg(F.max("t")).first()[0]
            if high is None:
                return 0.0
        width = (high - low) / BINS
        inside = copies.where((F.col("t") >= low) & (F.col("t") <= high))
        bin_of = F.least(F.floor((F.col("t") - low) / F.lit(width)), F.lit(BINS - 1)) if width > 0 else F.lit(0)
        rows = sorted(inside.groupBy(bin_of.alias("bin")).agg(F.sum("size").alias("size"), F.min("t").alias("low"), F.max("t").alias("high")).collect())
        for _, size, least, most in rows:
            if spent + size > budget:
                low, high = least, most
                break
            spent, cut = spent + size, most
        else:
            return cut
        if low == high:
            return cut


def mix_plan(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0, text: str = "text", keep: tuple[str, ...] = ("doc_id",), key: str = "doc_id", seed: str = "mix", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row for each row of docs: keep, source, size, source_size, target, virtual times __t0.., copies, taken.

    A null text has size 0, its row is in the mix at no cost. Null sources are one source, last in
    order. Repeated rows count each. Ties of the shuffle are ordered by size, then by text. copies is
    how often the mix holds the document (at most ``most``), taken is copies times size.
    """
    h = F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":" + seed)))
    sized = docs.select(*keep, *[c for c in ("source",) if c not in keep], word_count(F.col(text)).alias("size"), h.alias("__h"), F.xxhash64(F.col(text)).alias("__text"))
    sized = written(sized, "mixing")
    epochs = int(-(-most // 1))
    n, words = sized.agg(F.count(F.lit(1)), F.sum("size")).first()
    goal = targets(sized, weights, share, most)
    buckets = max(1, -(-n // bucket_rows))
    rows = sized.withColumn("__b", F.floor(F.conv(F.substring("__h", 1, 8), 16, 10).cast("double") * F.lit(buckets) / F.lit(float(1 << 32))))
    sums = rows.groupBy("source", "__b").agg(F.sum("size").alias("__sum"))
    sums = sums.withColumn("__before", F.sum("__sum").over(Window.partitionBy("source").orderBy("__b")) - F.col("__sum"))
    sums = sums.join(goal, sums["source"].eqNullSafe(goal["source"])).select(sums["source"].alias("__src"), F.col("__b").alias("__bk"), "__before", "source_size", "target")
    run = F.sum("size").over(Window.partitionBy("source", "__b").orderBy("__h", "size", *keep, "__text").rowsBetween(Window.unboundedPreceding, 0))
    timed = rows.withColumn("__run", run).join(sums, F.col("source").eqNullSafe(F.col("__src")) & (F.col("__b") == F.col("__bk")))
    served = F.col("__before") + F.col("__run")
    for e in range(epochs):
        timed = timed.withColumn(f"__t{e}", F.when(F.col("target") > 0, (served + F.lit(e) * F.col("source_size")) / F.col("target")).otherwise(F.lit(0.0)))
    timed = written(timed.drop("__b", "__run", "__src", "__bk", "__before"), "mixing-times")
    cut = _cutoff(timed, share * (words or 0), epochs)
    copies = sum(((F.col(f"__t{e}") <= F.lit(cut)).cast("int") for e in range(epochs)), F.lit(0))
    return timed.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))


def mix_documents(docs: DataFrame, text: str = "text", key: str = "doc_id", seed: str = "mix", **options) -> DataFrame:
    """The rows of docs, each as often as the mix holds it; columns as in docs.

    What a source gives to the mix is, in each round over its documents, a prefix of their
    shuffled order. One bound for each source and round therefore decides, and texts are not
    shuffled; only of repeated rows at a bound it is counted how many are in. The bounds are one row for each source; they are broadcast up to
    BROADCAST_SOURCES of them and joined otherwise.
    """
    plan = mix_plan(docs, text=text, key=key, seed=seed, keep=(key,), **options)
    rounds = range(sum(c.startswith("__t") and c[3:].isdigit() for c in plan.columns))
    place = F.struct("__h", "size", "__text")
    by = plan.groupBy(F.col("source").alias("__src")).agg(*[F.max(F.when(F.col("copies") > e, place)).alias(f"__bound{e}") for e in rounds])
    # rows equal to a bound: how many there are, and how many the plan takes
    ends = plan.join(F.broadcast(by) if by.count() <= BROADCAST_SOURCES else by, F.col("source").eqNullSafe(F.col("__src")))
    ends = ends.groupBy("__src").agg(*[F.first(f"__bound{e}").alias(f"__bound{e}") for e in rounds], *[F.sum(((place == F.col(f"__bound{e}")) & (F.col("copies") > e)).cast("long")).alias(f"__in{e}") for e in rounds], *[F.sum((place == F.col(f"__bound{e}")).cast("long")).alias(f"__at{e}") for e in rounds])
    bounds = written(ends, "mixing-bounds")
    if bounds.count() <= BROADCAST_SOURCES:
        bounds = F.broadcast(bounds)
    h = F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":" + seed)))
    own = F.struct(h.alias("__h"), word_count(F.col(text)).alias("size"), F.xxhash64(F.col(text)).alias("__text"))
    joined = docs.join(bounds, F.col("source").eqNullSafe(F.col("__src")))
    columns = [docs[c] for c in docs.columns]

    def under(e: int) -> Column:
        return F.coalesce((own < F.col(f"__bound{e}")) | ((own == F.col(f"__bound{e}")) & (F.col(f"__in{e}") == F.col(f"__at{e}"))), F.lit(False))

    copies = sum((under(e).cast("int") for e in rounds), F.lit(0))
    out = joined.withColumn("__copies", copies).where(F.col("__copies") > 0).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*columns)
    for e in rounds:
        # rows of one key and text of which the plan takes some only: for each source one such group at most
        if not bounds.where(F.col(f"__in{e}") < F.col(f"__at{e}")).isEmpty():
            tied = joined.where((own == F.col(f"__bound{e}")) & (F.col(f"__in{e}") < F.col(f"__at{e}")))
            tied = tied.withColumn("__n", F.row_number().over(Window.partitionBy("__src").orderBy(F.col(f"__bound{e}"))))
            out = out.unionByName(tied.where(F.col("__n") <= F.col(f"__in{e}")).select(*columns))
    return out
