"""What a study must say of itself, made from its tables each time: what an index consists of, which zones a confound touches, which layer is coupled with the outcome, why a layer was left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Indicators of the composite indices with their sign: 1 where more of it is more of the index (fixed values).
VULNERABILITY = {"pct_nonwhite": 1, "pct_renter": 1, "rent_burden_pct": 1, "pct_elderly": 1, "median_income": -1, "poverty_rate": 1, "pct_disability": 1}
ADAPTIVE_CAPACITY = {"pct_owner": 1, "median_income": 1, "pct_no_vehicle": -1}
#: The share of residents aged 18 to 24 from which a zone counts as one of students (fixed value).
STUDENT_SHARE = 0.30


def index_composition(table: DataFrame, indices: dict[str, dict[str, int]] | None = None) -> DataFrame:
    """(index, indicator, sign, known, used, reason): the indicators that were meant for each index, the rows that know them, and why one isn't used: it is missing, or known for no row. One scan."""
    indices = {"vulnerability": VULNERABILITY, "adaptive_capacity": ADAPTIVE_CAPACITY} if indices is None else indices
    meant = [(i, c, s) for i, of in indices.items() for c, s in of.items()]
    row = table.agg(*[F.count(F.col(f"`{c}`") if c in table.columns else F.lit(None)).alias(f"n{k}") for k, (_, c, _) in enumerate(meant)])
    each = F.array(*[F.struct(F.lit(i).alias("index"), F.lit(c).alias("indicator"), F.lit(s).alias("sign"), F.col(f"n{k}").alias("known"), F.lit(c in table.columns).alias("__has")) for k, (i, c, s) in enumerate(meant)])
    out = row.select(F.inline(each))
    reason = F.when(~F.col("__has"), "not in the table").when(F.col("known") == 0, "known for no row")
    return out.select("index", "indicator", "sign", "known", (F.col("known") > 0).alias("used"), reason.alias("reason"))


def confound_note(table: DataFrame, share: str, threshold: float = STUDENT_SHARE) -> DataFrame:
    """(flagged, known, threshold, note): zones whose share reaches the threshold, of those that know it. A table without the column knows none."""
    of = table.select(F.col(f"`{share}`").cast("double").alias("s")) if share in table.columns else table.select(F.lit(None).cast("double").alias("s"))
    n = of.agg(F.count_if(F.col("s") >= threshold).alias("flagged"), F.count("s").alias("known")).withColumn("threshold", F.lit(float(threshold)))
    told = F.concat(F.col("flagged").cast("string"), F.lit(" of "), F.col("known").cast("string"), F.lit(f" zones have a share of {share} of at least {threshold:.0%}; their incomes and tenures say less about hardship. Nothing is corrected for it."))
    return n.withColumn("note", F.when(F.col("known") > 0, told).otherwise(f"{share} is not known, so how many zones are affected can't be told. Nothing is corrected for it."))


def coupling_note(coefficients: DataFrame, layer: str, name: str = "feature", value: str = "lambda") -> DataFrame:
    """(layer, replicates, mean, least, most, note) of a layer that is a predictor of the outcome it is compared with: its coefficients over replicate fits."""
    s = coefficients.where(F.col(name) == layer).agg(F.count(value).alias("replicates"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))
    number = lambda c: F.format_string("%.3f", F.col(c).cast("double"))
    told = F.concat(F.lit(f"The outcome is partly a function of {layer} by construction: mean coefficient "), number("mean"), F.lit(" over "), F.col("replicates").cast("string"), F.lit(" fits ("), number("least"), F.lit(" to "), number("most"), F.lit("). A correlation with it is no independent evidence."))
    note = F.when(F.col("replicates") > 0, told).otherwise(f"No coefficient of {layer} is known; whether the outcome depends on it by construction can't be told.")
    return s.select(F.lit(layer).alias("layer"), "replicates", "mean", "least", "most", note.alias("note"))


def screening_reasons(dropped: DataFrame, pairs: DataFrame, layer: str = "layer", stage: str = "stage") -> DataFrame:
    """(layer, stage, partner, r, reason) of dropped layers (layer, stage: pearson or vif): the kept layer that each correlates with most (ties: the first by name). pairs: (a, b, r), each pair once."""
    both = pairs.select("a", "b", "r").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "r"))
    out = dropped.select(F.col(layer).alias("layer"), F.col(stage).alias("stage"))
    met = out.join(both, F.col("layer") == F.col("a")).join(dropped.select(F.col(layer).alias("b")), "b", "left_anti").where("r is not null")
    best = met.groupBy("layer").agg(F.min(F.struct((-F.abs("r")).alias("k"), F.col("b").alias("partner"), "r")).alias("m")).select("layer", "m.partner", "m.r")

    def said(kind: str, text: str) -> Column:
        return F.concat(F.lit(f"{kind} (r = "), F.format_string("%.3f", F.col("r")), F.lit(" with "), F.col("partner"), F.lit(f"{text})"))

    reason = F.when(F.col("partner").isNull(), "multicollinearity screening").when(F.col("stage") == "vif", said("variance inflation", ", under the limit of pairs")).otherwise(said("pairwise correlation", ", which is kept"))
    return out.join(best, "layer", "left").select("layer", "stage", "partner", "r", reason.alias("reason"))
