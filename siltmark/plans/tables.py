"""Scans, predicates, joins, aggregates and scalars over tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import guards
from ..sources import surveys, tables
from ..streaming import windows
from .registry import query, rounded, table


def _log(spark, d):
    """Survey lines made of events: number, northing, easting, elevation, description, status."""
    e = table(spark, d, "events")
    kinds = F.array(*[F.lit(x) for x in ("HW", "b hw", "WH 3", "EOW/left", "EL / HIGH WATER", "TOPO", "EOA")])
    north = F.when(F.col("event_id") % 11 == 0, "x").otherwise((F.col("event_id") * 10).cast("string"))
    line = F.concat_ws(",", F.concat(F.lit(" p"), F.col("event_id")), north, F.col("user_id").cast("string"), (F.col("event_id") % 97).cast("string"), F.get(kinds, (F.col("event_id") % 7).cast("int")), F.when(F.col("event_id") % 3 == 0, " status:fixed").otherwise("STATUS:FLOAT"))
    line = F.when(F.col("event_id") % 13 == 0, F.concat(F.lit("// "), line)).when(F.col("event_id") % 17 == 0, F.concat(F.lit("Pt"), line)).otherwise(line)
    return e.select(F.concat(F.lit("/raw/"), F.col("event_type"), F.lit("/log.txt")).alias("file"), F.col("event_id").cast("int").alias("pos"), line.alias("line"))


_LOG = """k AS (SELECT event_id AS i, event_type, user_id, ['HW', 'b hw', 'WH 3', 'EOW/left', 'EL / HIGH WATER', 'TOPO', 'EOA'][event_id % 7 + 1] AS said, event_id % 3 = 0 AS fixed,
CASE WHEN event_id % 13 = 0 THEN '// ' WHEN event_id % 17 = 0 THEN 'Pt' ELSE '' END AS pre FROM events WHERE event_id % 11 <> 0)"""


def _parsed(rows: str, kind: str) -> str:
    return f"""SELECT trim(concat(pre, ' p', i)) AS pt_id, CAST(i * 10 AS DOUBLE) AS northing_ft, CAST(user_id AS DOUBLE) AS easting_ft, CAST(i % 97 AS DOUBLE) AS elevation_ft, said AS description, '{kind}' AS type, event_type AS event, 'log.txt' AS source_file FROM k WHERE {rows}"""


@query(f"WITH {_LOG} " + _parsed("pre <> 'Pt' AND said IN ('HW', 'b hw', 'WH 3')", "HW"))
def survey_standard(spark, d):
    return surveys.parse(_log(spark, d), "A")


@query(f"WITH {_LOG} " + _parsed("pre <> 'Pt' AND said IN ('HW', 'b hw') AND fixed", "HW"))
def survey_receiver(spark, d):
    return surveys.parse(_log(spark, d), "B")


@query(f"WITH {_LOG} " + _parsed("pre <> '// ' AND said = 'HW'", "HW"))
def survey_plain(spark, d):
    return surveys.parse(_log(spark, d), "D")


@query(f"WITH {_LOG} " + _parsed("said = 'EL / HIGH WATER'", "HW"))
def survey_described(spark, d):
    return surveys.parse(_log(spark, d), "H")


@query(f"WITH {_LOG} " + _parsed("pre <> '// ' AND said IN ('EOW/left', 'EOA')", "EOW"))
def survey_edges(spark, d):
    return surveys.parse(_log(spark, d), "EOW")


@query("""WITH t AS (SELECT conv_id, turn, text, row_number() OVER w AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
x AS (SELECT a.conv_id, a.turn, min(CASE WHEN len(b.text) % 5 = 0 THEN b.n END) AS hit, min(CASE WHEN len(b.text) % 7 = 0 THEN b.n END) AS stop FROM t a LEFT JOIN t b ON a.conv_id = b.conv_id AND b.n BETWEEN a.n + 1 AND a.n + 5 GROUP BY ALL)
SELECT conv_id, turn FROM x WHERE hit IS NOT NULL AND (stop IS NULL OR hit < stop)""")
def survey_raw_log(spark, d):
    c = table(spark, d, "conversations")
    said = F.when(F.length("text") % 7 == 0, "GPS,").when(F.length("text") % 5 == 0, "--STATUS:FIXED").otherwise("other")
    body = c.select(F.concat(F.lit("/raw/e/"), F.col("conv_id")).alias("file"), (F.col("turn") * 2 + 1).alias("pos"), said.alias("line"))
    # a block's head before each turn's line sees the lines of later turns: the look-ahead counts lines, so heads are tested one turn at a time
    w = Window.partitionBy("file").orderBy("pos")
    heads = body.withColumn("n", F.row_number().over(w))
    lines = heads.join(heads.select("file", F.col("n").alias("of")), "file").where("n > of and n <= of + 5").select(F.concat_ws("#", "file", "of").alias("file"), F.col("n").cast("int").alias("pos"), "line")
    first = heads.select(F.concat_ws("#", "file", "n").alias("file"), F.lit(0).alias("pos"), F.lit("--GS,PN1,N 1.0,E 2.0,EL3.0,--HW").alias("line"))
    found = surveys.parse(first.unionByName(lines), "RW5").select(F.split("source_file", "#").alias("p"))
    back = found.select(F.get("p", 0).cast("long").alias("conv_id"), F.get("p", 1).cast("int").alias("n"))
    turns = c.withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).select("conv_id", "n", "turn")
    return back.join(turns, ["conv_id", "n"]).select("conv_id", "turn")


@query("SELECT event_id FROM events WHERE value >= 5 AND value <= 60 AND user_id >= 10 AND user_id <= 70")
def bounding_box(spark, d):
    p = table(spark, d, "events").select("event_id", F.col("value").alias("x"), F.col("user_id").alias("y"))
    return surveys.inside(p, (5, 10, 60, 70)).select("event_id")


@query("""WITH h AS (SELECT p_partkey % 50 AS mukey, p_brand AS hydgrp, p_retailprice AS pct, p_partkey FROM part) SELECT mukey, arg_max(hydgrp, pct) AS dominant FROM (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY mukey ORDER BY pct DESC, p_partkey) = 1) GROUP BY mukey""")
def dominant_component(spark, d):
    p = table(spark, d, "part")
    return p.groupBy((F.col("p_partkey") % 50).alias("mukey")).agg(F.max_by("p_brand", F.struct("p_retailprice", -F.col("p_partkey"))).alias("dominant"))


@query("""SELECT n_name, CAST(n_regionkey AS BIGINT) AS region, CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE CAST(n_nationkey * 100 AS DOUBLE) END AS income, CAST(n_nationkey AS DOUBLE) / nullif(n_regionkey, 0) AS ratio FROM nation""")
def header_json(spark, d):
    n = table(spark, d, "nation")
    income = F.when(F.col("n_nationkey") % 4 == 0, F.lit(str(tables.SUPPRESSED))).otherwise((F.col("n_nationkey") * 100).cast("string"))
    row = F.array("n_name", F.col("n_regionkey").cast("string"), income, F.col("n_nationkey").cast("string"))
    text = n.select(F.to_json(F.array(F.array(*[F.lit(x) for x in ("NAME", "REGION", "INCOME", "POP")]), row)).alias("j"))
    t = tables.header_json(text, "j", ["NAME", "REGION", "INCOME", "POP"])
    return t.select(F.col("NAME").alias("n_name"), F.col("REGION").cast("long").alias("region"), tables.estimate(F.col("INCOME")).alias("income"), tables.ratio(F.col("POP").cast("double"), F.col("REGION").cast("double")).alias("ratio"))


@query("""WITH a AS (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY ALL), b AS (SELECT s_nationkey AS k, count(*) AS m FROM supplier WHERE s_acctbal > 5000 GROUP BY ALL)
SELECT CAST(coalesce(a.k, b.k) AS INTEGER) AS k, CAST(n AS BIGINT) AS n, CAST(m AS BIGINT) AS m, round(n / CAST(nullif(m, 0) AS DOUBLE), 6) AS ratio FROM a FULL JOIN b ON a.k = b.k""")
def chunked_outer_merge(spark, d):
    a = table(spark, d, "customer").where("c_acctbal > 0").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    b = table(spark, d, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("m"))
    return rounded(a.join(b, "k", "full").withColumn("ratio", tables.ratio(F.col("n"), F.col("m"))))


@query("""WITH z AS (SELECT n_name, n_regionkey, avg(c_acctbal) AS susc FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_mktsegment = 'BUILDING' GROUP BY ALL) SELECT n_name, r_name, round(susc, 6) AS susc FROM z JOIN region ON n_regionkey = r_regionkey WHERE susc IS NOT NULL""")
def zones_with_attributes(spark, d):
    n, r, c = table(spark, d, "nation"), table(spark, d, "region"), table(spark, d, "customer")
    mean = c.where("c_mktsegment = 'BUILDING'").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("susc"))
    z = n.join(mean, F.col("n_nationkey") == F.col("c_nationkey"), "left").dropna(subset=["susc"])
    return rounded(z.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name", "susc"))


@query("""WITH t AS (SELECT o_orderpriority AS label, round(o_totalprice, -4) AS threshold, avg(o_totalprice) AS hit FROM orders GROUP BY ALL) SELECT label, threshold, round(hit, 6) AS hit FROM t QUALIFY row_number() OVER (PARTITION BY label ORDER BY abs(threshold - 123550), threshold) = 1""")
def nearest_threshold(spark, d):
    t = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("label"), F.round("o_totalprice", -4).alias("threshold")).agg(F.avg("o_totalprice").alias("hit"))
    best = t.groupBy("label").agg(F.min_by(F.struct("threshold", "hit"), F.struct(F.abs(F.col("threshold") - 123550), F.col("threshold"))).alias("b"))
    return rounded(best.select("label", "b.threshold", "b.hit"))


@query("""SELECT o_orderpriority AS fold, CAST(count(*) AS BIGINT) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS sd_samp, round(stddev_pop(o_totalprice), 4) AS sd_pop, round(sum(o_totalprice * o_custkey) / sum(o_custkey), 4) AS weighted FROM orders GROUP BY ALL""")
def fold_summary(spark, d):
    x = "o_totalprice"
    o = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("fold"))
    return rounded(o.agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd_samp"), F.stddev_pop(x).alias("sd_pop"), (F.sum(F.col(x) * F.col("o_custkey")) / F.sum("o_custkey")).alias("weighted")), 4)


@query("""SELECT o_orderkey % 100 AS cell, round(avg(o_totalprice), 4) AS mean, round(coalesce(stddev_samp(o_totalprice), 0), 4) AS sd, CAST(count(*) AS BIGINT) AS replicates FROM orders GROUP BY ALL""")
def replicate_mean_sd(spark, d):
    o = table(spark, d, "orders").groupBy((F.col("o_orderkey") % 100).alias("cell"))
    return rounded(o.agg(F.avg("o_totalprice").alias("mean"), F.coalesce(F.stddev_samp("o_totalprice"), F.lit(0.0)).alias("sd"), F.count(F.lit(1)).alias("replicates")), 4)


@query("""SELECT 'quality' AS "column", CAST(count(*) - count(quality) AS BIGINT) AS missing, round((count(*) - count(quality)) / CAST(count(*) AS DOUBLE), 6) AS share FROM documents d LEFT JOIN labels l USING (doc_id) UNION ALL SELECT 'toxic', count(*) - count(toxic), round((count(*) - count(toxic)) / CAST(count(*) AS DOUBLE), 6) FROM documents d LEFT JOIN labels l USING (doc_id) UNION ALL SELECT 'lang', count(*) - count(lang), round((count(*) - count(lang)) / CAST(count(*) AS DOUBLE), 6) FROM documents""")
def qa_report(spark, d):
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return rounded(guards.missing_share(j, ["quality", "toxic", "lang"]))


@query("SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL AND n_chars IS NOT NULL")
def validity_mask(spark, d):
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return j.where(scalars.all_present(F.col("quality"), F.col("toxic"), F.col("n_chars"))).select("doc_id")


@query("SELECT CAST(count(*) AS BIGINT) AS layers, CAST(count(DISTINCT (n_regionkey % 2, n_regionkey)) AS BIGINT) AS grids, count(DISTINCT (n_regionkey % 2, n_regionkey)) <= 1 AS aligned FROM nation")
def alignment_audit(spark, d):
    return guards.alignment(table(spark, d, "nation").withColumn("crs", F.col("n_regionkey") % 2), ["crs", "n_regionkey"])


@query("SELECT doc_id, count(*) OVER () AS n FROM documents WHERE regexp_matches(source, '^src1[0-9]$') UNION ALL SELECT doc_id, 0 FROM documents WHERE source = 'src0' AND NOT EXISTS (SELECT 1 FROM documents WHERE regexp_matches(source, '^src1[0-9]$'))".replace("count(*) OVER () AS n", "CAST(1 AS INTEGER) AS n"))
def replicate_rows(spark, d):
    x = table(spark, d, "documents").select("doc_id", "source")
    hits = x.where(F.col("source").rlike("^src1[0-9]$"))
    any_ = F.broadcast(hits.limit(1).select(F.lit(1).alias("one")))
    rest = x.where("source = 'src0'").join(any_, F.lit(True), "left_anti").select("doc_id", F.lit(0).alias("n"))
    return hits.select("doc_id", F.lit(1).alias("n")).unionByName(rest)


@query("SELECT event_id, TRY_CAST(CASE WHEN event_id % 9 = 0 THEN 'n/a' ELSE CAST(1700 + event_id % 400 AS VARCHAR) END AS INTEGER) AS year FROM events WHERE event_id % 9 <> 0 AND 1700 + event_id % 400 > 1800 AND 1700 + event_id % 400 < 2030 AND 1700 + event_id % 400 <= 2007")
def dated_before(spark, d):
    raw = F.when(F.col("event_id") % 9 == 0, "n/a").otherwise((1700 + F.col("event_id") % 400).cast("string"))
    y = table(spark, d, "events").select("event_id", raw.try_cast("int").alias("year"))
    return y.where("year > 1800 and year < 2030 and year <= 2007")


@query("""SELECT event_type, CAST(sum(CASE WHEN k < 0 THEN 1 ELSE 0 END) AS BIGINT) AS infinite, round(sum(CASE WHEN k > 0 THEN aicc END), 4) AS aicc FROM (SELECT event_type, n - 7 AS k, CASE WHEN n - 7 > 0 THEN 12 - 2 * ll + 84.0 / (n - 7) END AS aicc FROM (SELECT event_type, count(*) AS n, sum(ln(value + 1)) AS ll FROM events GROUP BY event_type)) GROUP BY event_type""")
def aicc_by_group(spark, d):
    g = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.ln(F.col("value") + 1)).alias("ll"))
    a = g.withColumn("aicc", scalars.aicc(F.col("ll"), F.lit(6), F.col("n")))
    inf = F.col("aicc") == float("inf")
    return a.select("event_type", inf.cast("long").alias("infinite"), F.round(F.when(~inf, F.col("aicc")), 4).alias("aicc"))


@query("""WITH g AS (SELECT o_orderstatus AS features, o_orderpriority AS beta, round(avg(o_totalprice), 2) AS aicc, CASE WHEN min(o_custkey) % 2 = 0 THEN 'ok' ELSE 'failed' END AS status FROM orders GROUP BY ALL) SELECT features, beta, aicc, round(aicc - (SELECT min(aicc) FROM g WHERE status = 'ok'), 2) AS delta FROM g WHERE status = 'ok' ORDER BY aicc, features, beta LIMIT 1""")
def best_candidate(spark, d):
    g = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("features"), F.col("o_orderpriority").alias("beta")).agg(F.round(F.avg("o_totalprice"), 2).alias("aicc"), (F.min("o_custkey") % 2 == 0).alias("ok"))
    return g.where("ok").orderBy("aicc", "features", "beta").limit(1).select("features", "beta", "aicc", F.lit(0.0).alias("delta"))


@query("""SELECT event_type, substr(sha256(string_agg(printf('%.3f,%.3f', value, CAST(user_id AS DOUBLE)), ';' ORDER BY printf('%.3f,%.3f', value, CAST(user_id AS DOUBLE)))), 1, 12) AS fingerprint, concat('test:', count(*)) AS eval_id FROM events GROUP BY event_type""")
def point_fingerprint(spark, d):
    p = table(spark, d, "events").withColumn("p", F.struct(F.col("value").alias("x"), F.col("user_id").cast("double").alias("y")))
    return p.groupBy("event_type").agg(scalars.point_fingerprint(F.col("p")).alias("fingerprint"), F.concat_ws(":", F.lit("test"), F.count(F.lit(1)).cast("string")).alias("eval_id"))


@query("""WITH p AS (SELECT n_name, n_nationkey, n_regionkey FROM nation) SELECT n_name AS feature, CASE n_regionkey % 4 WHEN 0 THEN 'linear' WHEN 1 THEN 'quadratic' WHEN 2 THEN 'categorical' ELSE 'other' END AS kind, CASE WHEN n_regionkey % 4 = 2 THEN CAST(n_nationkey AS DOUBLE) END AS code, CAST(n_nationkey AS DOUBLE) / 8 AS lambda, 0.0::DOUBLE AS low, 5.0::DOUBLE AS high FROM p""".replace("n_name AS feature", "CASE WHEN n_regionkey % 4 = 3 THEN concat(n_name, '*x') ELSE n_name END AS feature").replace("AS lambda", 'AS "lambda"'))
def coefficient_file(spark, d):
    n = table(spark, d, "nation")
    kind = F.col("n_regionkey") % 4
    name = F.when(kind == 1, F.concat("n_name", F.lit("^2"))).when(kind == 2, F.concat(F.lit("("), F.col("n_name"), F.lit("="), F.col("n_nationkey").cast("double").cast("string"), F.lit(")"))).when(kind == 3, F.concat("n_name", F.lit("*x"))).otherwise(F.col("n_name"))
    line = F.concat_ws(", ", name, (F.col("n_nationkey") / 8).cast("string"), F.lit("0.0"), F.lit("5.0"))
    return tables.coefficients(n.select(line.alias("value")), "value")


@query("""SELECT "row", string_agg(coalesce(printf('%.6g', v), '-9999'), ' ' ORDER BY col) AS line FROM (SELECT r."row", k.col, c.v FROM (SELECT DISTINCT user_id % 10 AS "row" FROM events) r CROSS JOIN range(0, 12) k(col) LEFT JOIN (SELECT user_id % 10 AS "row", event_id % 12 AS col, CAST(max(event_id) AS DOUBLE) / 7 AS v FROM events WHERE event_id % 5 <> 0 GROUP BY ALL) c ON c."row" = r."row" AND c.col = k.col) GROUP BY "row" """)
def text_grid(spark, d):
    c = table(spark, d, "events").where("event_id % 5 <> 0").groupBy((F.col("user_id") % 10).alias("row"), (F.col("event_id") % 12).alias("col")).agg((F.max("event_id") / 7).alias("v"))
    return tables.grid_lines(c, "v", 12)


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total, max(value) AS most FROM events GROUP BY ALL""")
def tumbling_windows(spark, d):
    return windows.tumbling(table(spark, d, "events")).withColumn("total", F.round("total", 4))


@query("""WITH m AS (SELECT c_mktsegment, sum(c_acctbal) AS s FROM customer WHERE c_acctbal > 0 GROUP BY ALL) SELECT c_mktsegment, round(s / sum(s) OVER (), 6) AS share, round(s - max(CASE WHEN c_mktsegment = 'BUILDING' THEN s END) OVER (), 4) AS delta FROM m""")
def share_and_delta(spark, d):
    m = table(spark, d, "customer").where("c_acctbal > 0").groupBy("c_mktsegment").agg(F.sum("c_acctbal").alias("s"))
    every = Window.partitionBy(F.lit(1))
    return m.select("c_mktsegment", F.round(F.col("s") / F.sum("s").over(every), 6).alias("share"), F.round(F.col("s") - F.max(F.when(F.col("c_mktsegment") == "BUILDING", F.col("s"))).over(every), 4).alias("delta"))


@query("SELECT p_partkey, coalesce(CASE p_size % 4 WHEN 0 THEN 'sand' WHEN 1 THEN 'loam' WHEN 2 THEN 'clay' END, CAST(p_size AS VARCHAR)) AS label, bround FROM (SELECT p_partkey, p_size, CAST(round_even(p_retailprice / 100, 0) AS BIGINT) AS bround FROM part)")
def category_labels(spark, d):
    labels = F.create_map(F.lit(0), F.lit("sand"), F.lit(1), F.lit("loam"), F.lit(2), F.lit("clay"))
    return table(spark, d, "part").select("p_partkey", F.coalesce(F.try_element_at(labels, F.col("p_size") % 4), F.col("p_size").cast("string")).alias("label"), F.bround(F.col("p_retailprice") / 100).cast("long").alias("bround"))
