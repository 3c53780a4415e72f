"""Queries over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language, licences, neighbours, pieces, prefixtrie, quality, spelling
from .decontamination import scan
from .mixing import mix_plan
from .nearduplicates import near_duplicates
from .pii import BASE, find_pii, listed
from .secrets import N_BASE, find_secrets
from .sharding import shard_documents


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(_table(spark, sf_dir, "documents"), keep=["doc_id"])
    base = F.filter("pii", lambda x: x["rank"] < len(BASE))

    def of_kind(name: str):
        return lambda x: x["kind"] == name

    return found.select(
        "doc_id",
        *[F.size(F.filter("pii", of_kind(k.name))).cast("long").alias(f"n_{k.name}") for k in BASE],
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("pii")).alias("spans"),
    )


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = licences.find_licences(docs, licences.fit(docs), keep=["doc_id"])
    families = F.array_sort(F.array_distinct(F.transform("licences", lambda x: x["family"])))
    notices = F.array_join(F.transform("licences", lambda x: F.concat_ws(":", x["paragraph"].cast("string"), x["family"])), ",")
    return found.select("doc_id", F.size("licences").cast("long").alias("n_notices"), F.array_join(families, ",").alias("families"), notices.alias("notices"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix_plan(_table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(_table(spark, sf_dir, "documents"), keep=["doc_id"])

    def count(rank: int):
        return F.size(F.filter("secrets", lambda x: x["rank"] == rank)).cast("long")

    base = F.filter("secrets", lambda x: x["rank"] < N_BASE)
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("secrets")).alias("spans"),
    )


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    dictionaries = language.fit(docs.where(~language.held_out(docs)))
    found = language.identify(docs.withColumn("held_out", language.held_out(docs)), dictionaries, keep=["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    scored = quality.score_quality(docs.withColumn("held_out", quality.held_out()), model, keep=["doc_id", "held_out"])
    return scored.select("doc_id", "held_out", "score", "predicted")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(_table(spark, sf_dir, "documents"), shards=40, keep=["doc_id"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = prefixtrie.rebuilt(_table(spark, sf_dir, "conversations"))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = spelling.lowered_runs(_table(spark, sf_dir, "documents"))
    # of one run in 97 of a document, a letter is left out
    h = F.crc32(F.concat(F.coalesce(F.col("key").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    gone = (h % F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), gone), F.substring("run", gone + 2, F.length("run")))
    words = spelling.counted(runs.select(F.when(h % 97 == 0, less).otherwise(F.col("run")).alias("word")))
    return spelling.spelling_groups(words).select("word", "form", "root", "n", "n_near", "form_n")


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = pieces.Model.read(str(public_tokenizers.path("piece_bpe_32k.model")))
    found = pieces.decode(pieces.encode(_table(spark, sf_dir, "documents"), model, keep=["doc_id"]), model)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


QUERIES = {
    "op1_neighbours": op1_neighbours,
    "op2_pii": op2_pii,
    "op3_licences": op3_licences,
    "op4_mixing": op4_mixing,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_decontamination": op6_decontamination,
    "op7_secrets": op7_secrets,
    "op8_language": op8_language,
    "op9_quality": op9_quality,
    "op10_sharding": op10_sharding,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_spelling": op12_spelling,
    "op13_pieces": op13_pieces,
}



def _crc32(text: str) -> str:
    """SQL of the unsigned crc32 of a text's UTF-8: a byte is taken in and shifted out bit by bit."""
    hexed = f"hex(encode({text}))"
    byte = f"CAST(concat('0x', substring({hexed}, 2 * i + 1, 2)) AS BIGINT)"
    steps = f"flatten(list_transform(range(0, CAST(octet_length(encode({text})) AS BIGINT)), lambda i: [{byte}, -1, -1, -1, -1, -1, -1, -1, -1]))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {steps}), lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) WHEN s % 2 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END), CAST(4294967295 AS BIGINT))"


ORACLE_SQL: dict[str, str] = {
    "op4_mixing": r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':mix')) AS h
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, 2.0 * CAST(source_size AS DOUBLE) AS lim, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n FROM s
), w2 AS (
  SELECT *, CAST(CASE n % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS wt FROM w
), l AS (
  SELECT *, (1.5 * CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(lim) OVER b, 0.0)) / (sum(wt) OVER () - coalesce(sum(wt) OVER b, 0.0)) AS lev
  FROM w2 WINDOW b AS (ORDER BY lim / wt, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), lam AS (
  SELECT lev AS lvl FROM l WHERE lim / wt > lev ORDER BY lim / wt, n LIMIT 1
), t AS (
  SELECT source, source_size, CASE WHEN (SELECT lvl FROM lam) IS NULL THEN lim ELSE least(lim, (SELECT lvl FROM lam) * wt) END AS target FROM l
), timed AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target,
         CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.size, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS served
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), copies AS (
  SELECT doc_id, size, CASE WHEN target > 0 THEN CAST(served + e * source_size AS DOUBLE) / target ELSE 0.0 END AS vt
  FROM timed, (VALUES (0), (1)) x(e)
), spent AS (
  SELECT vt, sum(sum(size)) OVER (ORDER BY vt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total FROM copies GROUP BY vt
), cut AS (
  SELECT max(vt) AS vt FROM spent WHERE total <= 1.5 * (SELECT sum(size) FROM d)
)
SELECT doc_id, size, source_size, target,
       size * (CAST((CASE WHEN target > 0 THEN CAST(served AS DOUBLE) / target ELSE 0.0 END) <= (SELECT vt FROM cut) AS BIGINT)
             + CAST((CASE WHEN target > 0 THEN CAST(served + source_size AS DOUBLE) / target ELSE 0.0 END) <= (SELECT vt FROM cut) AS BIGINT)) AS taken
FROM timed
""",
    "op6_decontamination": r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), bw AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT item, least(len(w), 10) AS k, list_aggregate(w[i:i + least(len(w), 10) - 1], 'string_agg', ' ') AS g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM bw WHERE len(w) > 0)
), lens AS (SELECT DISTINCT k FROM win), keys AS (SELECT DISTINCT g FROM win),
pos AS (
  SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM dw
), grams AS (
  SELECT doc_id, i, k, list_aggregate(w[i:i + k - 1], 'string_agg', ' ') AS g FROM pos, lens WHERE i + k - 1 <= len(w)
), found AS (
  SELECT doc_id, i, k, g FROM grams SEMI JOIN keys USING (g)
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM found) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT f.doc_id, w.item FROM found f JOIN win w USING (g)) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM dw d LEFT JOIN hit h USING (doc_id) LEFT JOIN its t USING (doc_id)
""",
    "op11_prefix_trie": f"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role) AS pos FROM conversations WHERE conv_id IS NOT NULL
), h AS (
  SELECT c, {_crc32("CAST(c AS VARCHAR)")} % 4 AS h FROM (SELECT DISTINCT c FROM t)
), r AS (
  SELECT h.c, 1 AS part, t.pos, t.role, t.text FROM h JOIN t ON t.c = h.c - h.c % 20 AND t.pos <= h.h
  UNION ALL SELECT h.c, 2, t.pos, t.role, t.text FROM h JOIN t ON t.c = h.c AND t.pos > h.h
), s AS (
  SELECT h.c, coalesce(list(md5(concat(md5(role), md5(text))) ORDER BY part, pos) FILTER (WHERE pos IS NOT NULL), []) AS turns,
         coalesce(list(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) ORDER BY part, pos) FILTER (WHERE pos IS NOT NULL), []) AS words
  FROM h LEFT JOIN r ON r.c = h.c GROUP BY h.c
), p AS (
  SELECT c, d, turns[1:d] AS node, words[d] AS words, d = len(turns) AS ends FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM s)
), n AS (
  SELECT d, node, min(c) AS c, count(*) AS n, max(words) AS words, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends), '') AS ends FROM p GROUP BY d, node
), k AS (
  SELECT node[1:d - 1] AS node, count(*) AS k FROM n WHERE d > 0 GROUP BY 1
), o AS (
  SELECT n.*, coalesce(k.k, 0) AS k FROM n LEFT JOIN k USING (node)
), u AS (
  SELECT node[1:x] AS node, sum((n - 1) * words) AS saved, count_if(k = 0) AS leaves FROM (SELECT *, unnest(range(0, d + 1)) AS x FROM (SELECT node, d, n, coalesce(words, 0) AS words, k FROM o)) GROUP BY 1
)
SELECT o.c AS conv_id, CAST(o.d AS BIGINT) AS depth, a.c AS parent_conv_id, CAST(o.n AS BIGINT) AS n_convs, CAST(o.k AS BIGINT) AS n_children, CAST(u.leaves AS BIGINT) AS n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, sha256(o.ends) AS ends_sha256
FROM o JOIN u USING (node) LEFT JOIN n a ON o.d > 0 AND a.node = o.node[1:o.d - 1]
""",
    "op12_spelling": f"""
WITH RECURSIVE r AS (
  SELECT doc_id, translate(run, '{spelling.UPPER}', '{spelling.LOWER}') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '{spelling.LETTERS}')) AS run FROM documents) GROUP BY ALL
), h AS (
  SELECT run, n, {_crc32("concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', run)")} AS h FROM r
), w AS (
  SELECT CASE WHEN h % 97 = 0 THEN concat(substring(run, 1, CAST(h % length(run) AS BIGINT)), substring(run, CAST(h % length(run) AS BIGINT) + 2)) ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n
  FROM h GROUP BY 1 HAVING length(word) >= 5 AND sum(n) >= 3
), less AS (
  SELECT word, n, i, concat(substring(word, 1, i), substring(word, i + 2)) AS rest FROM (SELECT *, unnest(range(0, length(word))) AS i FROM w)
), near AS (
  SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS k FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT l.word, l.n, w.word, w.n FROM less l JOIN w ON w.word = l.rest
  UNION SELECT w.word, w.n, l.word, l.n FROM less l JOIN w ON w.word = l.rest
), best AS (
  SELECT word, n, count(*) AS n_near, arg_min(other, (-k, other)) AS form, max(k) AS form_n FROM near GROUP BY word, n
), f AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.form_n >= 2 * w.n THEN b.form END AS form, CASE WHEN b.form_n >= 2 * w.n THEN b.form_n END AS form_n FROM w LEFT JOIN best b USING (word)
), way AS (
  SELECT word, word AS root, form AS next FROM f
  UNION ALL SELECT way.word, way.next, f.form FROM way JOIN f ON f.word = way.next
)
SELECT f.word, f.form, way.root, f.n, f.n_near, f.form_n FROM f JOIN way ON way.word = f.word AND way.next IS NULL
""",
}
