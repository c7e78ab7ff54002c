"""Linkage, near names, integrity and span queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalloom.operators import link as K
from evalloom.plans.registry import query, spread, table

ASKED = "SELECT o_orderkey AS question_id, o_custkey AS party, CAST(o_orderkey % 10 AS VARCHAR) AS clerk, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderkey % 50 = 0"
HELD = "SELECT o_orderkey AS rid, o_custkey AS party, CAST(o_orderkey % 10 AS VARCHAR) AS clerk, CAST(o_orderdate AS DATE) AS day FROM orders"


def _keys(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("party"), (F.col("o_orderkey") % 10).cast("string").alias("clerk"), F.to_date("o_orderdate").alias("day"))
    return o.where("o_orderkey % 50 = 0").withColumnRenamed("o_orderkey", "question_id"), o.withColumnRenamed("o_orderkey", "rid")


STATE = "CASE WHEN a = h THEN 'exact' WHEN levenshtein(a, h) <= 2 THEN 'near_spelling' ELSE 'other_party' END"
LINKS = f"""WITH a AS ({ASKED}), h AS ({HELD}), p AS (SELECT question_id, rid, a.party::VARCHAR AS pa, h.party::VARCHAR AS ph, a.clerk AS ca, h.clerk AS ch, a.day AS da, h.day AS dh FROM a JOIN h ON (a.party = h.party)::INT + (a.clerk = h.clerk)::INT + (a.day = h.day)::INT = 2)
SELECT question_id, rid, CASE WHEN pa <> ph THEN 'party' WHEN ca <> ch THEN 'clerk' ELSE 'day' END AS slot,
CASE WHEN da <> dh THEN 'other_date' WHEN ca <> ch THEN {STATE.replace('levenshtein(a, h)', 'levenshtein(ca, ch)').replace('a = h', 'ca = ch')} ELSE {STATE.replace('levenshtein(a, h)', 'levenshtein(pa, ph)').replace('a = h', 'pa = ph')} END AS state FROM p"""


@query(LINKS)
def partial_key_lookalikes(spark, sf_dir):
    asked, held = _keys(spark, sf_dir)
    return K.lookalikes(asked, held, ["party", "clerk", "day"], ["day"])


@query(f"""WITH l AS ({LINKS}), a AS ({ASKED}), h AS ({HELD}), s AS (SELECT question_id, count(*) FILTER (a.party = h.party AND a.clerk = h.clerk AND a.day = h.day) AS n_exact, count(*) AS sharing FROM a JOIN h ON a.party = h.party OR a.clerk = h.clerk OR a.day = h.day GROUP BY 1),
r AS (SELECT *, list_position(['near_spelling', 'other_date', 'shared_name', 'other_party'], state) AS r FROM l), b AS (SELECT question_id, count(*) AS n, arg_min(state, (r, rid)) AS best_kind, arg_min(rid, (r, rid)) AS best_record, arg_min(slot, (r, rid)) AS differing_slot FROM r GROUP BY 1)
SELECT question_id, CASE WHEN coalesce(n, 0) > 0 THEN 'strong' WHEN sharing - n_exact > 0 THEN 'weak' ELSE 'none' END AS strength, best_kind, best_record, differing_slot, coalesce(n, 0) AS n_lookalikes, sharing - n_exact - coalesce(n, 0) AS n_partial, n_exact FROM s LEFT JOIN b USING (question_id)""")
def link_strength(spark, sf_dir):
    asked, held = _keys(spark, sf_dir)
    return K.strengths(asked, held, ["party", "clerk", "day"], ["day"])


NAMES = "SELECT DISTINCT p_name AS n FROM part"


@query(f"WITH n AS ({NAMES}) SELECT x.n AS a, y.n AS b, levenshtein(lower(x.n), lower(y.n)) AS edits FROM n x, n y WHERE x.n <> y.n AND levenshtein(lower(x.n), lower(y.n)) <= 2")
def near_name_pairs(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return K.near_pairs(p, p, "p_name", "p_name").withColumn("edits", F.col("edits").cast("long"))


@query(f"""WITH n AS (SELECT n, regexp_replace(lower(n), '[^\\p{{L}}]', '', 'g') AS k FROM ({NAMES})), d1 AS (SELECT n, k AS v FROM n UNION SELECT n, concat(substr(k, 1, i - 1), substr(k, i + 1)) FROM n, unnest(range(1, length(k) + 1)) t(i)),
d2 AS (SELECT n, v FROM d1 UNION SELECT n, concat(substr(v, 1, i - 1), substr(v, i + 1)) FROM d1, unnest(range(1, length(v) + 1)) t(i) UNION SELECT n, concat('4:', substr(k, 1, 4)) FROM n) SELECT DISTINCT x.n AS a, y.n AS b FROM d2 x JOIN d2 y USING (v) WHERE x.n < y.n""")
def symdelete_conflicts(spark, sf_dir):
    return K.conflicting_names(table(spark, sf_dir, "part"), "p_name")


@query("SELECT a.p_partkey AS question_id, CASE WHEN lower(a.p_name) = lower(b.p_name) THEN 'exact' WHEN levenshtein(lower(a.p_name), lower(b.p_name)) <= 2 THEN 'near_spelling' WHEN split_part(lower(a.p_name), ' ', 1) = split_part(lower(b.p_name), ' ', 1) OR split_part(lower(a.p_name), ' ', -1) = split_part(lower(b.p_name), ' ', -1) THEN 'shared_name' ELSE 'other_party' END AS state FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def name_states(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    other = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("held"))
    return p.join(other, "p_partkey").select(F.col("p_partkey").alias("question_id"), K.name_state("p_name", "held").alias("state"))


LINES = """SELECT doc_id, n, text, sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY n) - length(text) - 1 AS char_start FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(0, len(string_split(text, chr(10))))) AS n FROM documents)"""


@query(f"SELECT doc_id, count(*) AS spans, CAST(max(char_start + length(text)) AS BIGINT) AS ends_at, count(*) FILTER (length(text) = 0) AS empty FROM ({LINES}) GROUP BY 1")
def span_tiling(spark, sf_dir):
    from evalloom.operators.verify import line_spans, tiling_problems

    docs = spread(table(spark, sf_dir, "documents"))
    spans = line_spans(docs, "doc_id", "text")
    bad = tiling_problems(docs.select("doc_id", "text"), spans, "doc_id", 1).select("doc_id").distinct().withColumn("bad", F.lit(True))
    return spans.join(bad, "doc_id", "left").where("bad is null").groupBy("doc_id").agg(F.count("*").alias("spans"), F.max("char_end").cast("long").alias("ends_at"), F.count_if(F.col("char_start") == F.col("char_end")).alias("empty"))


@query(f"WITH l AS ({LINES}), p AS (SELECT doc_id, unnest(range(0, length(text), 500)) AS pos FROM documents) SELECT p.doc_id, pos, n FROM p JOIN l ON p.doc_id = l.doc_id AND pos >= char_start AND pos < char_start + length(l.text)")
def span_lookup(spark, sf_dir):
    from evalloom.operators.verify import enclosing_span, line_spans

    docs = spread(table(spark, sf_dir, "documents"))
    at = docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(500))).alias("pos")).join(docs.where("length(text) > 0").select("doc_id"), "doc_id")
    return enclosing_span(at, line_spans(docs, "doc_id", "text"), "doc_id").select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("n").cast("long").alias("n"))


@query("SELECT o_orderkey AS question_id, count(l_orderkey) AS matches FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R' GROUP BY 1 HAVING count(l_orderkey) <> 1 OR coalesce(max(l_linenumber), 0) <> 1")
def witness_unique(spark, sf_dir):
    from evalloom.operators.verify import not_one_witness

    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("question_id"), F.lit(1).alias("witness"))
    held = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("question_id"), F.col("l_linenumber").alias("rid"))
    return not_one_witness(o, held, ["question_id"], "question_id", "witness", "rid")


@query("SELECT DISTINCT c_custkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'P' AND year(o_orderdate) = 1996")
def absence_violations(spark, sf_dir):
    from evalloom.operators.verify import present

    held = table(spark, sf_dir, "orders").where("o_orderstatus = 'P' and year(o_orderdate) = 1996").select(F.col("o_custkey").alias("c_custkey"))
    return present(table(spark, sf_dir, "customer").select("c_custkey"), held, ["c_custkey"])
