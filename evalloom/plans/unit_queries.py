"""Answers compared, sorted and linked: the smaller operators over the driver's tables, each with SQL that says the same in its own way."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalloom.functions import folding
from evalloom.functions import text as T
from evalloom.operators import aggregate as A
from evalloom.operators import label as L
from evalloom.operators import link as K
from evalloom.operators import reports as R
from evalloom.operators.verify import without_gold as without_gold_rows
from evalloom.plans.registry import query, spread, table
from evalloom.plans.text_queries import QA


@query(f"SELECT p_partkey, list_filter([p_name, CAST(p_size AS VARCHAR), 'the', concat('A ', p_partkey, '.'), ''], lambda a: length({QA.format(x='a')}) >= 2 AND NOT regexp_matches({QA.format(x='a')}, '^[0-9]{{1,2}}$')) AS usable FROM part")
def usable_answers(spark, sf_dir):
    key = F.col("p_partkey").cast("string")
    return table(spark, sf_dir, "part").select("p_partkey", T.usable_answers(F.array("p_name", F.col("p_size").cast("string"), F.lit("the"), F.concat(F.lit("A "), key, F.lit(".")), F.lit(""))).alias("usable"))


@query("SELECT doc_id, array_to_string(list_filter(string_split(regexp_replace(replace(lower(coalesce(text, '')), ',', ''), '[^\\p{L}\\p{N}_]+', ' ', 'g'), ' '), lambda w: w NOT IN ('a', 'an', 'the', '')), ' ') AS words FROM documents")
def word_normalized(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents")).select("doc_id", T.qa_normalized_words("text").alias("words"))


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(strip_accents(coalesce(text, '')), '[^\\x00-\\x7F]', '', 'g')), '\\b(?:a|an|the)\\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'), '\\s+', ' ', 'g')) AS folded FROM documents")
def folded_text(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", folding.folded("text").alias("folded"))


@query("""WITH o AS (SELECT o_orderkey, o_orderkey % 4 AS kind, o_custkey, o_orderpriority FROM orders)
SELECT o_orderkey, CASE kind WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true ELSE length(trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9_]+', ' ', 'g'))) >= 4 END AS same FROM o""")
def same_answers(spark, sf_dir):
    """Numbers as money, numbers a unit apart, the same words in other writing, and words within a sentence."""
    o, kind = table(spark, sf_dir, "orders"), F.col("o_orderkey") % 4
    n = F.col("o_custkey").cast("string")
    left = F.when(kind == 0, F.concat(F.lit("$"), F.format_number("o_custkey", 0))).when(kind == 1, n).otherwise(F.col("o_orderpriority"))
    right = F.when(kind == 0, F.concat(n, F.lit(".2"))).when(kind == 1, (F.col("o_custkey") + 1).cast("string")).when(kind == 2, F.concat(F.lit("'"), F.upper("o_orderpriority"), F.lit(".'"))).otherwise(F.concat(F.lit("It was "), F.col("o_orderpriority"), F.lit(" then")))
    return o.select("o_orderkey", T.same_answer(left, right).alias("same"))


@query("""WITH p AS (SELECT p_partkey, p_partkey % 5 AS k, printf('20%02d-0%d-1%d', p_partkey % 30, 1 + p_partkey % 9, p_partkey % 10) AS day FROM part)
SELECT p_partkey, CASE WHEN k < 4 THEN 'Alda Brim' END AS lessee, CASE WHEN k < 4 THEN 'Cole Dorn' END AS lessor, CASE WHEN k < 4 THEN day END AS date, CASE k WHEN 0 THEN 'pet_deposit' WHEN 1 THEN 'parking_fee' WHEN 3 THEN 'monthly_rent' END AS asked, CASE k WHEN 0 THEN 'has_pet_clause' WHEN 1 THEN 'has_parking_clause' WHEN 2 THEN 'has_sublease_clause' END AS flag,
CASE k WHEN 0 THEN p_partkey % 2 = 0 WHEN 1 THEN false WHEN 2 THEN p_partkey % 3 = 0 WHEN 3 THEN true ELSE false END AS held FROM p""")
def asked_fields(spark, sf_dir):
    """Questions taken apart into key and field, and whether a record has the field: by its flag and value."""
    key = F.col("p_partkey")
    k = key % 5
    day = F.format_string("20%02d-0%d-1%d", key % 30, 1 + key % 9, key % 10)
    what = F.when(k == 0, "What is the pet deposit in").when(k == 1, "How high is the parking fee in").when(k == 2, "Is subleasing allowed under").otherwise("What is the monthly rent in")
    question = F.when(k < 4, F.concat(what, F.lit(" Alda Brim's lease with Cole Dorn starting "), day, F.lit("?"))).otherwise("Who was there?")
    record = F.create_map(*[F.lit(x) if isinstance(x, str) else x for x in ("has_pet_clause", F.when(key % 2 == 0, "1").otherwise("0"), "pet_deposit", "$100", "has_parking_clause", "true", "parking_fee", " ", "has_sublease_clause", F.when(key % 3 == 0, "yes").otherwise("no"), "monthly_rent", "$5")])
    p = table(spark, sf_dir, "part").select("p_partkey", question.alias("q"), F.lit("lease_document").alias("t"), record.alias("r")).withColumns({"slots": K.parse_question("q", "t"), "f": K.asked_field("q", "t")})
    return p.select("p_partkey", *[F.col("slots")[s].alias(s) for s in ("lessee", "lessor", "date")], F.col("f.column").alias("asked"), F.col("f.flag").alias("flag"), K.has_field("r", F.col("f.column"), F.col("f.flag")).alias("held"))


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'R' WHEN 1 THEN 'W' WHEN 2 THEN 'U' WHEN 3 THEN 'W' WHEN 4 THEN 'U' ELSE 'O' END AS label, CASE o_orderkey % 6 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' WHEN 3 THEN 'medium' WHEN 4 THEN 'medium' ELSE 'low' END AS confidence FROM orders""")
def prelabels(spark, sf_dir):
    """Replies that refuse, refuse and state the look-alike's value, state it, state it with a warning, state another, and say nothing."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey") % 6
    value = F.concat(F.lit("$"), F.format_number(F.col("o_custkey") + 1000, 0))
    reply = F.when(k == 0, "That is not mentioned in the records.").when(k == 1, F.concat(F.lit("There is no record of it, the nearest pays "), value)).when(k == 2, F.concat(F.lit("It is "), value))
    reply = reply.when(k == 3, F.concat(F.lit("A similar lease pays "), value)).when(k == 4, "It is 7 dollars.").otherwise("We talked about the weather and the garden for quite a long while today")
    got = L.prelabel_unanswerable("reply", F.array("value"))
    return o.select("o_orderkey", reply.alias("reply"), value.alias("value")).select("o_orderkey", got["label"].alias("label"), got["confidence"].alias("confidence"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'yes' WHEN 2 THEN 'unsure' ELSE 'no' END AS label, CASE o_orderkey % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE 'medium' END AS confidence FROM orders""")
def prelabel_matches(spark, sf_dir):
    """Replies that hold a true answer whole, its year, half of its words, or none of it."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey") % 4
    year = (1500 + F.col("o_custkey") % 500).cast("string")
    said = F.when(k == 0, F.concat(F.lit("it was green harbour "), year)).when(k == 1, F.concat(F.lit("back "), year)).when(k == 2, "some green harbour").otherwise("nothing like that")
    got = L.prelabel_match("said", F.array(F.concat(F.lit("green harbour "), F.col("year")), F.lit("another answer entirely here")))
    return o.select("o_orderkey", said.alias("said"), year.alias("year")).select("o_orderkey", got["label"].alias("label"), got["confidence"].alias("confidence"))


@query("SELECT count(*) AS documents, count(*) FILTER (n_chars % 10 < 8) AS within_tolerance, min(n_chars % 10 - 5) AS deviation_min, max(n_chars % 10 - 5) AS deviation_max, CAST(sum(doc_id % 9) AS BIGINT) AS records FROM documents")
def manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return A.manifest(docs.select((F.col("n_chars") % 10 < 8).alias("within_tolerance"), (F.col("n_chars") % 10 - 5).alias("deviation"), (F.col("doc_id") % 9).alias("n_records")))


@query("SELECT o_orderpriority AS arm, count(*) AS made_up, round(avg((o_orderkey % 3 = 0)::INT), 9) AS share FROM orders WHERE o_orderstatus <> 'P' AND o_custkey % 2 = 0 GROUP BY 1")
def decoy_share(spark, sf_dir):
    """Of made-up answers to decoys, the share that holds a decoy's value."""
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_orderpriority").alias("arm"), F.when(F.col("o_orderstatus") != "P", "decoy").otherwise("strong").alias("level"), F.when(F.col("o_custkey") % 2 == 0, "made_up").otherwise("refused").alias("label"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("It is clerk "), F.col("o_custkey").cast("string"))).otherwise("It is not that").alias("response"), F.array(F.concat(F.lit("clerk "), F.col("o_custkey").cast("string")), F.lit("no such value")).alias("decoy_values"))
    got = R.decoy_share(rows, ["arm"])
    return got.select("arm", "made_up", F.round("share", 9).alias("share"))


@query("""WITH r AS (SELECT o_custkey, year(o_orderdate) AS y, CAST(o_orderkey AS VARCHAR) AS rid FROM orders), a AS (SELECT DISTINCT o_custkey, 1995 AS asked_year FROM orders)
SELECT o_custkey, rid, rank FROM (SELECT o_custkey, rid, row_number() OVER (PARTITION BY o_custkey ORDER BY abs(y - asked_year), md5(concat('0|', rid))) AS rank FROM a JOIN r USING (o_custkey) WHERE y <> asked_year) WHERE rank <= 3""")
def closest_years(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    records = o.select("o_custkey", F.year("o_orderdate").alias("year"), F.col("o_orderkey").cast("string").alias("rid"))
    asked = o.select("o_custkey").distinct().withColumn("year", F.lit(1995))
    return K.closest_years(asked, records, ["o_custkey"], 3).select("o_custkey", "rid", F.col("rank").cast("long").alias("rank"))


@query("""SELECT event_type, longest, round(s8 - n8, 9) AS effect_short, round(sl - nl, 9) AS effect_longest, round(nl - n8, 9) AS length_effect, round(sm - nl, 9) AS strong_mid_vs_none_longest FROM (
SELECT event_type, 128 AS longest, avg(v) FILTER (lev = 'strong' AND len = 8) AS s8, avg(v) FILTER (lev = 'none' AND len = 8) AS n8, avg(v) FILTER (lev = 'strong' AND len = 128) AS sl, avg(v) FILTER (lev = 'none' AND len = 128) AS nl, avg(v) FILTER (lev = 'strong' AND len = 32) AS sm
FROM (SELECT event_type, value AS v, CASE WHEN event_id % 2 = 0 THEN 'none' ELSE 'strong' END AS lev, CASE user_id % 3 WHEN 0 THEN 8 WHEN 1 THEN 32 ELSE 128 END AS len FROM events) GROUP BY 1)""")
def longest_contrasts(spark, sf_dir):
    """The effects of look-alikes and of length at the ends of the ladder."""
    e = table(spark, sf_dir, "events").withColumns({"level": F.when(F.col("event_id") % 2 == 0, "none").otherwise("strong"), "length": F.when(F.col("user_id") % 3 == 0, 8).when(F.col("user_id") % 3 == 1, 32).otherwise(128)})
    cells = e.groupBy("event_type", "level", "length").agg(F.avg("value").alias("rate"))
    got = R.longest_contrasts(cells, ["event_type"], "length", "level", "rate")
    return got.select("event_type", "longest", *[F.round(c, 9).alias(c) for c in got.columns if c not in ("event_type", "longest")])


_ANSWER = QA.format(x="a")


@query(f"""WITH w AS (SELECT doc_id, concat(' ', {QA.format(x='text')}, ' ') AS t, CASE WHEN doc_id % 2 = 0 THEN split_part(trim(text), ' ', 3) ELSE concat('nowhere', doc_id) END AS a FROM documents WHERE doc_id % 5 <> 4)
SELECT doc_id AS item, CASE WHEN {_ANSWER} <> '' AND contains(t, concat(' ', {_ANSWER}, ' ')) THEN 'yes' ELSE 'no' END AS holds FROM w UNION ALL SELECT doc_id, 'no' FROM documents WHERE doc_id % 5 = 4""")
def answers_in_documents(spark, sf_dir):
    """Items whose document holds a true answer, does not, or isn't there."""
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", "text")
    answer = F.when(F.col("doc_id") % 2 == 0, F.split_part(F.trim("text"), F.lit(" "), F.lit(3))).otherwise(F.concat(F.lit("nowhere"), F.col("doc_id").cast("string")))
    items = docs.select("doc_id", F.col("doc_id").alias("item"), F.array(F.coalesce(answer, F.lit(""))).alias("true_answers"))
    return R.answers_in_documents(items, docs.where("doc_id % 5 <> 4"), "doc_id").select("item", "holds")


@query(f"""WITH w AS (SELECT doc_id, source, concat(' ', {QA.format(x="concat(source, ' ', text)")}, ' ') AS t, {QA.format(x="split_part(trim(text), ' ', 2)")} AS a, doc_id % 3 = 0 AS control, doc_id % 4 = 0 AS asked, doc_id % 7 = 0 AS gold FROM documents),
h AS (SELECT *, (asked AND a <> '' AND contains(t, concat(' ', a, ' '))) OR gold AS holds FROM w) SELECT doc_id FROM h WHERE holds <> control""")
def without_gold(spark, sf_dir):
    """Documents without an answer that hold one or come from its article, and controls that don't."""
    docs = spread(table(spark, sf_dir, "documents"))
    passages = docs.select("doc_id", F.col("source").alias("title"), "text")
    word = F.split_part(F.trim("text"), F.lit(" "), F.lit(2))
    answers = docs.select("doc_id", F.when(F.col("doc_id") % 4 == 0, F.array(F.coalesce(word, F.lit("")))).otherwise(F.array(F.lit(""))).alias("answers"), F.when(F.col("doc_id") % 7 == 0, F.array("source")).otherwise(F.array(F.lit("no such title"))).alias("gold_titles"), (F.col("doc_id") % 3 == 0).alias("is_control"))
    return without_gold_rows(passages, answers)


@query("SELECT count(*) FILTER (doc_id % 4 = 0 AND doc_id % 3 = 0) AS none_with_lookalike, 0 AS mixed_documents FROM documents")
def audited_levels(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.when(F.col("doc_id") % 4 == 0, "none").otherwise("strong").alias("level"), F.when(F.col("doc_id") % 3 == 0, F.array("source")).otherwise(F.array().cast("array<string>")).alias("lookalike_values"))
    return A.audit_levels(rows)
