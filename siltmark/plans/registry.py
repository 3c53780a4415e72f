"""Queries over the driver's tables with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of a sum doesn't show."""
    return df.select(*[F.round(f"`{c}`", digits).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: y_true is the quality label, y_score the length."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return d.join(l, "doc_id").select("doc_id", "lang", "source", F.col("quality").alias("y_true"), F.col("n_chars").cast("double").alias("y_score"), "toxic")


#: The same in SQL.
SCORES = "s AS (SELECT d.doc_id, d.lang, d.source, l.quality AS y_true, CAST(d.n_chars AS DOUBLE) AS y_score, l.toxic FROM documents d JOIN labels l USING (doc_id))"


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a grid of 50 by 50 cells with the largest value of each."""
    e = table(spark, sf_dir, "events")
    return e.groupBy((F.col("user_id") % 50).alias("row"), (F.col("event_id") % 50).alias("col")).agg(F.max("value").alias("value"))


CELLS = "c AS (SELECT user_id % 50 AS \"row\", event_id % 50 AS col, max(value) AS value FROM events GROUP BY ALL)"
