"""Reports over answers rendered from orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalloom.functions import folding
from evalloom.operators import label as L
from evalloom.operators import reports as R
from evalloom.plans.registry import query, spread, table
from evalloom.plans.statistics_queries import DRAW, DRAWS
from evalloom.plans.text_queries import _NOT_FOUND, LABELS, rendered

HELD = f"SELECT *, CASE WHEN o_orderkey % 4 < 2 AND label = 'made_up' THEN true ELSE false END AS captured, NOT answerable AND o_orderkey % 4 < 2 AND states AS mentions FROM ({LABELS})"


def scored(spark, sf_dir):
    return L.capture_tags(L.label_answers(rendered(spark, sf_dir)))


@query(f"SELECT form, avg((label = 'refused')::INT) AS refused, avg((label = 'made_up' AND hedges)::INT) AS flagged, avg((label = 'made_up' AND NOT hedges)::INT) AS silent, count(*) AS n FROM ({LABELS}) WHERE NOT answerable GROUP BY form")
def three_way_split(spark, sf_dir):
    return R.three_way(scored(spark, sf_dir).withColumn("flagged", F.col("hedged")), ["form"])


@query(f"SELECT form, count(*) AS n, count(*) FILTER (label = 'made_up' OR (label = 'refused' AND mentions)) AS strict FROM ({HELD}) WHERE NOT answerable GROUP BY form")
def strict_reading(spark, sf_dir):
    return R.strict_reading(scored(spark, sf_dir), ["form"])


@query(f"SELECT form, o_orderkey % 4 AS part, NULL AS label, count(*) AS n, count(*) FILTER (captured) AS captured, 'cells' AS cell FROM ({HELD}) GROUP BY 1, 2 UNION ALL SELECT NULL, NULL, label, count(*), count(*) FILTER (captured), 'labels' FROM ({HELD}) GROUP BY 3 UNION ALL SELECT form, NULL, NULL, count(*), count(*) FILTER (captured), 'forms' FROM ({HELD}) GROUP BY 1")
def several_groupings(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumn("part", F.col("o_orderkey") % 4)
    return R.all_cells(rows, {"cells": ["form", "part"], "labels": ["label"], "forms": ["form"]}, {"n": F.count(F.lit(1)), "captured": F.count_if("captured")})


_FIRST = f"CASE WHEN answerable THEN CASE WHEN {_NOT_FOUND('c')} THEN 'wrong_refusal' ELSE 'wrong' END ELSE CASE WHEN {_NOT_FOUND('c')} THEN 'refused' ELSE 'made_up' END END"


@query(f"SELECT old, label AS new, count(*) AS n FROM (SELECT *, {_FIRST} AS old FROM ({LABELS})) WHERE old <> label GROUP BY 1, 2")
def label_changes(spark, sf_dir):
    """All replies labelled by the first scoring, which takes every reply to state a wrong value, and by the present one."""
    new = L.label_answers(rendered(spark, sf_dir)).select("o_orderkey", "label")
    old = rendered(spark, sf_dir)
    old = old.withColumn("label", R.provisional_label("response", F.col("answerable"), F.lit(True), F.lit(False)))
    return R.label_changes(old, new, "o_orderkey")


@query(f"SELECT form, y, CAST(w AS BIGINT) AS w FROM (SELECT form, 1 AS y, count(*) FILTER (captured) AS w FROM ({HELD}) GROUP BY 1 UNION ALL SELECT form, 0, count(*) - count(*) FILTER (captured) FROM ({HELD}) GROUP BY 1) WHERE w > 0")
def design_rows(spark, sf_dir):
    return R.design_rows(scored(spark, sf_dir).groupBy("form").agg(F.count_if("captured").alias("k"), F.count("*").alias("n")), "k", "n")


@query("SELECT count(*) FILTER (n_chars + 500 <= 4000) AS fit, count(*) FILTER (n_chars + 500 > 4000) AS rejected FROM documents")
def too_long(spark, sf_dir):
    fit, rejected = R.too_long(table(spark, sf_dir, "documents"), "n_chars", 4000, 500)
    return fit.select(F.lit(1).alias("fits")).unionByName(rejected.select(F.lit(0).alias("fits"))).agg(F.count_if(F.col("fits") == 1).alias("fit"), F.count_if(F.col("fits") == 0).alias("rejected"))


@query("SELECT doc_id, array_to_string(list_filter(string_split(regexp_replace(lower(regexp_replace(strip_accents(text), '[^\\x00-\\x7F]', '', 'g')), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w NOT IN ('', 'the', 'a', 'an', 'of', 'in', 'on', 'at', 'to', 'and', 'is', 'was', 'for', 'by', 'it', 'its', 'as', 'with', 'from', 'that')), ' ') AS words FROM documents")
def folded_words(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", folding.folded_words("text").alias("words"))


@query("WITH c AS (SELECT event_type, user_id % 3 AS unit, user_id % 2 = 0 AS arm, count(*) FILTER (value > 50) AS k, count(*) AS n FROM events GROUP BY ALL) SELECT event_type, count(*) AS units FROM c a JOIN c b USING (event_type, unit) WHERE a.arm AND NOT b.arm GROUP BY 1")
def compared_units(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumns({"unit": F.col("user_id") % 3, "arm": F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd")})
    cells = e.groupBy("event_type", "unit", "arm").agg(F.count_if(F.col("value") > 50).alias("k"), F.count("*").alias("n"))
    return R.significant(cells, ["event_type"], "arm", "even", "odd").select("event_type", "units")


_CELLS = "SELECT event_type, event_id % 2 AS a, event_id // 2 % 2 AS b, user_id, count(*) FILTER (value > 50) AS k, count(value) AS n FROM events GROUP BY ALL"


@query(f"""WITH c AS ({_CELLS}), i AS (SELECT *, row_number() OVER (PARTITION BY event_type, a, b ORDER BY user_id) - 1 AS i, count(*) OVER (PARTITION BY event_type, a, b) AS m FROM c),
s AS (SELECT event_type, sum(CASE WHEN a = b THEN r ELSE -r END) AS interaction FROM (SELECT event_type, a, b, sum(k) / greatest(sum(n), 1) AS r FROM c GROUP BY 1, 2, 3) GROUP BY 1),
d AS (SELECT event_type, a, b, draw, {DRAW} % m AS i FROM i, unnest(range(1, {DRAWS + 1})) AS t(draw)),
r AS (SELECT event_type, draw, sum(CASE WHEN a = b THEN r ELSE -r END) AS x FROM (SELECT event_type, a, b, draw, sum(k) / greatest(sum(n), 1) AS r FROM d JOIN i USING (event_type, a, b, i) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2)
SELECT event_type, interaction, quantile_cont(x, 0.025) AS lo, quantile_cont(x, 0.975) AS hi FROM s JOIN r USING (event_type) GROUP BY 1, 2""")
def interaction_bootstrap(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumns({"flag": F.col("value") > 50, "a": (F.col("event_id") % 2).cast("int"), "b": (F.floor(F.col("event_id") / 2) % 2).cast("int")})
    return R.interaction(e, ["event_type"], "user_id", "flag", "a", "b", DRAWS)


@query(f"""WITH c AS (SELECT event_type, user_id, count(*) FILTER (value > 50) / count(value) AS rate FROM events GROUP BY 1, 2),
i AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY user_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS m FROM c),
d AS (SELECT event_type, draw, {DRAW} % m AS i FROM i, unnest(range(1, {DRAWS + 1})) AS t(draw)), r AS (SELECT event_type, draw, avg(rate) AS x FROM d JOIN i USING (event_type, i) GROUP BY 1, 2),
e AS (SELECT event_type, quantile_cont(x, 0.025) AS lo, quantile_cont(x, 0.975) AS hi FROM r GROUP BY 1) SELECT event_type, avg(rate) AS macro, count(*) AS units, any_value(lo) AS lo, any_value(hi) AS hi FROM c JOIN e USING (event_type) GROUP BY 1""")
def macro_bootstrap(spark, sf_dir):
    return R.macro_bootstrap(table(spark, sf_dir, "events").withColumn("flag", F.col("value") > 50), ["event_type"], "user_id", "flag", DRAWS)
