"""Samples, splits, folds, de-duplication, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import guards, sampling
from .registry import SCORES, query, rounded, scores, table


def draw_sql(key: str, seed: str = "42") -> str:
    return f"CAST(concat('0x', substr(md5(concat('{seed}:', CAST({key} AS VARCHAR))), 1, 15)) AS BIGINT)"


@query(f"""WITH b AS (SELECT event_id, concat(CAST(floor(value / 20) AS BIGINT), '_', CAST(floor(user_id / 50) AS BIGINT)) AS block FROM events)
SELECT event_id, CAST(dense_rank() OVER (ORDER BY block) - 1 AS BIGINT) AS fold FROM b""")
def block_folds(spark, d):
    e = table(spark, d, "events").select("event_id", (F.col("value") * 100).alias("x"), (F.col("user_id") * 40).alias("y"))
    return sampling.block_codes(e, "x", "y", 2000.0).select("event_id", "fold")


@query("""SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY floor(user_id / 7), floor(value / 5) ORDER BY event_id) = 1""")
def first_of_cell(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", F.floor(F.col("user_id") / 7).alias("r"), F.floor(F.col("value") / 5).alias("c"))
    return sampling.first_of_cell(e, "r", "c", "event_id").select("event_id", "user_id", "event_type")


@query(f"""SELECT event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_type, floor(user_id / 30.0), floor(value / 30) ORDER BY {draw_sql('event_id')}, event_id) = 1""")
def thin_by_type(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", F.col("user_id").cast("double").alias("y"), F.col("value").alias("x"))
    return sampling.thin(e, "x", "y", "event_id", 30.0, within=["event_type"]).select("event_id", "event_type")


@query(f"""SELECT event_id, (row_number() OVER (ORDER BY {draw_sql('event_id')}) <= round_even((SELECT count(*) FROM events) * 0.3, 0)) AS is_test FROM events""")
def holdout_split(spark, d):
    return sampling.holdout_split(table(spark, d, "events").select("event_id"), "event_id").select("event_id", "is_test")


@query(f"""SELECT event_id, (row_number() OVER (PARTITION BY event_type ORDER BY {draw_sql('event_id')}) <= round_even(count(*) OVER (PARTITION BY event_type) * 0.2, 0)) AS is_test FROM events""")
def stratified_split(spark, d):
    return sampling.stratified_split(table(spark, d, "events").select("event_id", "event_type"), "event_id", "event_type").select("event_id", "is_test")


@query(f"SELECT event_id FROM events WHERE value IS NOT NULL ORDER BY {draw_sql('event_id')}, event_id LIMIT 1000")
def sample_background(spark, d):
    e = table(spark, d, "events").where("value is not null").select("event_id")
    return sampling.first_by_draw(e, 1000, "event_id")


@query(f"""SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49) ORDER BY {draw_sql('o_orderkey')}, o_orderkey LIMIT 500""")
def background_excluding_presence(spark, d):
    pool = table(spark, d, "orders").select("o_orderkey")
    presence = table(spark, d, "lineitem").where("l_quantity >= 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return sampling.first_by_draw(pool.join(presence, "o_orderkey", "left_anti"), 500, "o_orderkey")


@query(f"""WITH {SCORES}, p AS (SELECT * FROM s WHERE y_true = 1), e AS (SELECT list_sort(list_distinct(quantile_cont(y_score, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS edges FROM p),
pb AS (SELECT greatest(0, least(len(list_filter(edges, lambda x: x <= y_score)) - 1, len(edges) - 2)) AS bin FROM p, e),
want AS (SELECT bin, round_even(200 * count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM p), 0) AS w FROM pb GROUP BY bin),
q AS (SELECT doc_id, CAST(n_chars AS DOUBLE) AS v, greatest(0, least(len(list_filter(edges, lambda x: x <= n_chars)) - 1, len(edges) - 2)) AS bin FROM documents, e)
SELECT q.doc_id, CAST(q.bin AS BIGINT) AS bin FROM q JOIN want USING (bin) QUALIFY row_number() OVER (PARTITION BY q.bin ORDER BY {draw_sql('q.doc_id')}) <= max(w) OVER (PARTITION BY q.bin)""")
def matched_background(spark, d):
    presence = scores(spark, d).where("y_true = 1").select("doc_id", "y_score")
    pool = table(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("y_score"))
    return sampling.matched_background(presence, pool, "y_score", "doc_id", 200).select("doc_id", "bin")


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n, CAST(min(event_id) AS BIGINT) AS first_id, CAST(sum(event_id) AS BIGINT) AS id_sum FROM events GROUP BY event_type")
def leave_one_event_out_folds(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"), F.sum("event_id").alias("id_sum"))


@query("""WITH p AS (SELECT event_id, value AS x, CAST(user_id AS DOUBLE) AS y, CAST(floor(value / 60) AS BIGINT) * 100 + user_id // 10 AS b FROM events),
c AS (SELECT b, avg(x) AS cx, avg(y) AS cy, count(*) AS n FROM p GROUP BY b),
m AS (SELECT s.b, l.b AS t FROM c s, c l WHERE s.n < 12 AND l.n >= 12 QUALIFY row_number() OVER (PARTITION BY s.b ORDER BY pow(s.cx - l.cx, 2) + pow(s.cy - l.cy, 2), l.n DESC, l.b) = 1)
SELECT event_id, CAST(coalesce(m.t, p.b) AS BIGINT) AS fold FROM p LEFT JOIN m USING (b)""")
def merge_small_blocks(spark, d):
    p = table(spark, d, "events").select("event_id", F.col("value").alias("x"), F.col("user_id").cast("double").alias("y"), (F.floor(F.col("value") / 60) * 100 + F.floor(F.col("user_id") / 10)).alias("fold"))
    return sampling.merge_small_blocks(p, "x", "y", "fold", 12).select("event_id", "fold")


@query("SELECT source, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 5")
def top_groups(spark, d):
    return sampling.top_groups(table(spark, d, "documents"), "source", 5)


@query("SELECT CAST(count(*) AS BIGINT) AS leaked FROM (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0 INTERSECT SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 1)")
def leakage_check(spark, d):
    o = table(spark, d, "orders")
    return guards.leaked(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), "o_custkey").agg(F.count(F.lit(1)).alias("leaked"))


@query("""WITH p AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 3 <> 1 UNION ALL SELECT o_custkey FROM (SELECT DISTINCT o_custkey FROM orders) WHERE o_custkey % 5 = 0), n AS (SELECT k, count(*) AS n FROM p GROUP BY k)
SELECT CAST(coalesce(n.k, c.c_custkey) AS BIGINT) AS k, CASE WHEN c.c_custkey IS NULL THEN 'unknown' WHEN n.n IS NULL THEN 'missing' ELSE 'repeated' END AS fault FROM n FULL JOIN customer c ON n.k = c.c_custkey WHERE c.c_custkey IS NULL OR n.n IS NULL OR n.n > 1""")
def partition_faults(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    parts = c.where("c_custkey % 3 <> 1").select(F.col("c_custkey").alias("k")).unionByName(o.select(F.col("o_custkey").alias("k")).distinct().where("k % 5 = 0"))
    return guards.partition_faults(parts, c.select(F.col("c_custkey").alias("k")), "k")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = (SELECT min(c_mktsegment) FROM customer) EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000")
def set_difference(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    first = F.broadcast(c.agg(F.min("c_mktsegment").alias("m")))
    return c.crossJoin(first).where("c_mktsegment = m").select("c_custkey").distinct().join(o.where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("""WITH m AS (SELECT l_returnflag, l_linestatus, avg(l_quantity) AS q FROM lineitem GROUP BY ALL) SELECT l_returnflag, round(max(CASE WHEN l_linestatus = 'F' THEN q END), 6) AS f, round(max(CASE WHEN l_linestatus = 'O' THEN q END), 6) AS o FROM m GROUP BY l_returnflag""")
def pivot_models(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.avg("l_quantity"))
    return rounded(li.select("l_returnflag", F.col("F").alias("f"), F.col("O").alias("o")))


@query("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name < b.n_name")
def pairs_of_models(spark, d):
    n = table(spark, d, "nation")
    a, b = n.select(F.col("n_name").alias("a"), "n_regionkey"), n.select(F.col("n_name").alias("b"), "n_regionkey")
    return a.join(b, "n_regionkey").where("a < b").select("a", "b")


@query("""SELECT lang, CAST(count(*) AS BIGINT) AS raw, CAST(count(DISTINCT text) AS BIGINT) AS retained FROM documents GROUP BY lang UNION ALL SELECT 'Total', count(*), (SELECT sum(n) FROM (SELECT count(DISTINCT text) AS n FROM documents GROUP BY lang)) FROM documents""".replace("(SELECT sum(n)", "(SELECT CAST(sum(n) AS BIGINT)"))
def counts_with_total(spark, d):
    by = table(spark, d, "documents").groupBy("lang", F.xxhash64("text").alias("h")).agg(F.count(F.lit(1)).alias("n")).groupBy("lang").agg(F.sum("n").alias("raw"), F.count(F.lit(1)).alias("retained"))
    return by.unionByName(by.agg(F.sum("raw").alias("raw"), F.sum("retained").alias("retained")).select(F.lit("Total").alias("lang"), "raw", "retained"))
