"""Rates, sizes, breaking points and other grouped reports over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalloom.operators import aggregate as A
from evalloom.operators.ordered import interleaved, numbered, running_share
from evalloom.plans.registry import query, table



def wilson_sql(k: str, n: str) -> str:
    p, d = f"({k} * 1.0::DOUBLE / {n})", f"(1 + 3.8416::DOUBLE / {n})"
    c, h = f"(({p} + 3.8416::DOUBLE / (2 * {n})) / {d})", f"(1.96::DOUBLE * sqrt({p} * (1 - {p}) / {n} + 3.8416::DOUBLE / (4.0::DOUBLE * {n} * {n})) / {d})"
    return f"{p} AS rate, greatest(0::DOUBLE, {c} - {h}) AS lo, least(1::DOUBLE, {c} + {h}) AS hi"


def labelled(spark, sf_dir):
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id").withColumns({"flag": F.col("toxic") == 1, "good": F.col("quality") == 1})


LABELLED = "SELECT l.doc_id, lang, source, toxic = 1 AS flag, quality = 1 AS good FROM labels l JOIN documents USING (doc_id)"


@query(f"SELECT lang, count(*) FILTER (flag) AS k, count(flag) AS n, {wilson_sql('count(*) FILTER (flag)', 'count(flag)')} FROM ({LABELLED}) GROUP BY lang")
def rate_wilson_by_lang(spark, sf_dir):
    return A.rate(labelled(spark, sf_dir), ["lang"], "flag")


@query(f"SELECT CASE WHEN grouping(lang) = 1 THEN 'all' ELSE lang END AS lang, CASE WHEN grouping(source) = 1 THEN 'all' ELSE source END AS source, count(*) FILTER (good) AS k, count(good) AS n, {wilson_sql('count(*) FILTER (good)', 'count(good)')} FROM ({LABELLED}) GROUP BY ROLLUP (lang, source)")
def pooled_rate_rollup(spark, sf_dir):
    return A.pooled_rate(labelled(spark, sf_dir), ["lang", "source"], "good")


@query("SELECT event_type, min(r) AS rows_min, max(r) AS rows_max, min(c) AS clusters_min, max(c) AS clusters_max FROM (SELECT event_type, CAST(ts AS DATE) AS d, count(*) AS r, count(DISTINCT user_id) AS c FROM events GROUP BY 1, 2) GROUP BY event_type")
def cell_sizes(spark, sf_dir):
    return A.cell_sizes(table(spark, sf_dir, "events").withColumn("d", F.to_date("ts")), ["event_type"], "user_id", "d")


@query("SELECT event_type, avg(k / n) AS macro, sum(k) / sum(n) AS micro, count(*) AS units FROM (SELECT event_type, user_id, count(*) FILTER (value > 50) AS k, count(value) AS n FROM events GROUP BY 1, 2) GROUP BY event_type")
def macro_rate(spark, sf_dir):
    return A.macro_rate(table(spark, sf_dir, "events").withColumn("flag", F.col("value") > 50), "user_id", ["event_type"], "flag")


@query("SELECT user_id FROM events GROUP BY user_id HAVING count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events)")
def complete_units(spark, sf_dir):
    return A.complete_units(table(spark, sf_dir, "events"), "user_id", "event_type")


RATES_BY_STEP = f"SELECT event_type, user_id % 7 AS step, {wilson_sql('count(*) FILTER (value > 50 - 4 * (user_id % 7))', 'count(value)')} FROM events GROUP BY 1, 2"


def _rates_by_step(spark, sf_dir, sign):
    rows = table(spark, sf_dir, "events").withColumn("step", F.col("user_id") % 7)
    return A.rate(rows.withColumn("flag", F.col("value") > 50 + sign * 4 * F.col("step")), ["event_type", "step"], "flag")


@query(f"WITH r AS ({RATES_BY_STEP}), b AS (SELECT event_type, hi AS hi0 FROM r WHERE step = 0) SELECT event_type, min(CASE WHEN step > 0 AND lo > hi0 THEN step END) AS breaks_at FROM b JOIN r USING (event_type) GROUP BY event_type")
def breaking_point(spark, sf_dir):
    return A.breaking_point(_rates_by_step(spark, sf_dir, -1), ["event_type"], "step", 0)


@query(f"WITH r AS ({RATES_BY_STEP.replace('50 - 4', '50 + 4')}), b AS (SELECT event_type, lo AS lo0, rate AS rate0 FROM r WHERE step = 0) SELECT event_type, min(CASE WHEN step > 0 AND hi < lo0 AND rate0 - rate >= CAST(0.1 AS DOUBLE) THEN step END) AS breaks_at FROM b JOIN r USING (event_type) GROUP BY event_type")
def accuracy_drop(spark, sf_dir):
    return A.breaking_point(_rates_by_step(spark, sf_dir, 1), ["event_type"], "step", 0, 0.1)


@query("SELECT l_returnflag AS context, CASE WHEN grouping(l_linestatus) = 1 THEN 'all' ELSE l_linestatus END AS level, avg(l_linenumber) AS mean, median(l_linenumber) AS median, avg(CASE WHEN l_linenumber >= 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS share_2, avg(l_quantity) AS mean_partial FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag))")
def exposure_grouping_sets(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("context"), F.col("l_linestatus").alias("level"), "l_linenumber", "l_quantity")
    return A.exposure(rows, "context", "level", "l_linenumber", "l_quantity")


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS \"F\", count(*) FILTER (o_orderstatus = 'O') AS \"O\", count(*) FILTER (o_orderstatus = 'P') AS \"P\" FROM orders GROUP BY 1")
def count_matrix(spark, sf_dir):
    return A.matrix(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2")
def composition_histogram(spark, sf_dir):
    return A.histogram(table(spark, sf_dir, "documents"), "lang", "source")


@query("SELECT lang, avg(n_chars) AS mean, max(n_chars) AS max, 32768 - max(n_chars) AS headroom FROM documents GROUP BY lang")
def token_headroom(spark, sf_dir):
    return A.token_stats(table(spark, sf_dir, "documents"), ["lang"], "n_chars", 32768)


@query("WITH e AS (SELECT lang, avg(n_chars) AS mean, max(n_chars) AS max FROM documents GROUP BY lang) SELECT lang, mean, max, mean / (SELECT mean FROM e WHERE lang = 'en') AS ratio, max <= 32768 AS fits FROM e")
def token_ratios(spark, sf_dir):
    return A.token_ratios(table(spark, sf_dir, "documents"), "lang", "n_chars", "en", 32768)


@query("WITH a AS (SELECT o_custkey % 50 AS c, o_orderpriority, count(*) AS v FROM orders GROUP BY 1, 2), b AS (SELECT o_custkey % 50 AS c, o_orderpriority, count(*) FILTER (o_orderstatus <> 'P') AS v FROM orders GROUP BY 1, 2) SELECT count(*) AS cells, avg(abs(a.v - b.v)) AS mean_abs_diff, avg(CASE WHEN abs(a.v - b.v) <= 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS share_within FROM a JOIN b USING (c, o_orderpriority)")
def cell_agreement(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("c", F.col("o_custkey") % 50)
    ours = rows.groupBy("c", "o_orderpriority").agg(F.count("*").alias("v"))
    theirs = rows.groupBy("c", "o_orderpriority").agg(F.count_if(F.col("o_orderstatus") != "P").alias("v"))
    return A.agreement(ours, theirs, ["c", "o_orderpriority"], "v")


@query("SELECT c_mktsegment, count(*) AS n, count(o.o_custkey) AS found, count(*) - count(o.o_custkey) AS missing FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderkey % 5 = 0) o ON c_custkey = o_custkey GROUP BY 1")
def record_coverage(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where("o_orderkey % 5 = 0").select(F.col("o_custkey").alias("c_custkey"))
    return A.coverage(table(spark, sf_dir, "customer"), orders, ["c_custkey"], ["c_mktsegment"])


@query("SELECT o_custkey FROM (SELECT DISTINCT o_custkey FROM orders) ANTI JOIN (SELECT c_custkey AS o_custkey FROM customer WHERE c_custkey % 3 <> 0) USING (o_custkey)")
def unknown_ids(spark, sf_dir):
    known = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").select("o_custkey").distinct().join(known, "o_custkey", "left_anti")


@query("SELECT event_id, user_id, event_type, src FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY src) AS r FROM (SELECT event_id, user_id, event_type, 'main' AS src FROM events WHERE event_id % 3 = 0 UNION ALL SELECT event_id, user_id, event_type, 'part1' FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, user_id, event_type, 'part2' FROM events)) WHERE r = 1")
def merge_shards(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return A.merged([e.where("event_id % 3 = 0").withColumn("src", F.lit("main")), e.where("event_id % 2 = 0").withColumn("src", F.lit("part1")), e.withColumn("src", F.lit("part2"))], ["event_id"])


@query("SELECT DISTINCT user_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE user_id % 4 <> 0 OR event_id % 5 = 0)")
def resume_anti(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return A.left_to_do(e, e.where("user_id % 4 <> 0 or event_id % 5 = 0"), "user_id", "event_id")


@query("SELECT doc_id, lang, source, round FROM (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS round FROM documents) ORDER BY round, lang, source LIMIT 60")
def balanced_sample(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return A.balanced(docs, ["lang", "source"], [F.md5(F.col("doc_id").cast("string")), F.col("doc_id")], 60, ["lang", "source"]).withColumn("round", F.col("round").cast("long"))


@query("WITH p AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY quality DESC, md5(concat('0|', doc_id)), doc_id) AS n FROM labels JOIN documents USING (doc_id)) SELECT doc_id, lang, row_number() OVER (ORDER BY md5(concat('0-order|', doc_id)), doc_id) AS item FROM p WHERE n <= 5")
def group_sample(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return A.sampled(rows, ["lang"], "doc_id", 5, 0, [F.desc("quality")]).select("doc_id", "lang", "item").withColumn("item", F.col("item").cast("long"))


@query("SELECT o_orderkey, number FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS number FROM orders) WHERE number % 4 = 1")
def shard_split(spark, sf_dir):
    return A.shard(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], 4, 1).select("o_orderkey", "number")


@query("SELECT c_name, row_number() OVER (ORDER BY c_name) - 1 AS number FROM customer")
def global_numbers(spark, sf_dir):
    return numbered(table(spark, sf_dir, "customer").select("c_name"), ["c_name"])


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(l_quantity) OVER (PARTITION BY l_orderkey) AS position FROM lineitem")
def running_position(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return running_share(lines, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], "l_quantity").drop("l_quantity")


@query("SELECT o_custkey, o_orderkey, copy, row_number() OVER (PARTITION BY o_custkey ORDER BY copy, o_orderkey) - 1 AS place FROM orders, unnest(range(1, 3)) AS t(copy)")
def interleaved_copies(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("copy"))
    return interleaved(rows, ["o_custkey"], "copy", "o_orderkey").withColumn("place", F.col("place").cast("long"))


@query("SELECT lang, min(doc_id) AS doc_id FROM documents GROUP BY lang, text")
def distinct_passages(spark, sf_dir):
    from evalloom.operators.retrieve import first_of

    return first_of(table(spark, sf_dir, "documents").select("lang", "text", "doc_id"), ["lang", "text"], [F.col("doc_id")]).select("lang", "doc_id")


@query("SELECT o_custkey, o_orderkey, used FROM (SELECT o_custkey, o_orderkey, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS used FROM orders) WHERE used <= 300000")
def greedy_fill(spark, sf_dir):
    from evalloom.operators.retrieve import filled

    return filled(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], ["o_orderkey"], "o_totalprice", 300000).select("o_custkey", "o_orderkey", "used")


@query("SELECT length, ladder, level, context, 7 + 3000 + row_number() OVER (ORDER BY a, b, c, context) - 1 AS seed FROM (VALUES (0, 8), (1, 32)) x(a, length), (VALUES (0, 'name'), (1, 'role')) y(b, ladder), (VALUES (0, 'none'), (1, 'weak'), (2, 'strong')) z(c, level), (VALUES (0), (1), (2)) w(context)")
def dataset_grid(spark, sf_dir):
    return A.grid(spark, {"length": [8, 32], "ladder": ["name", "role"], "level": ["none", "weak", "strong"]}, 3, 7, 3).withColumn("seed", F.col("seed").cast("long")).withColumn("context", F.col("context").cast("int"))
