"""Generated documents, and the proof that their questions' answers are present or absent."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalloom.operators import generate as G
from evalloom.operators.verify import problems
from evalloom.plans.registry import query, table


def specs(spark, sf_dir):
    """A small document for each supplier, over all ladders, levels, fillers and numbers of copies."""
    key = F.col("s_suppkey")
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (F.floor(key / by) % len(values) + 1).cast("int"))
    rows = table(spark, sf_dir, "supplier").repartition(max(1, spark.sparkContext.defaultParallelism))
    return rows.select(F.concat(F.lit("d"), key.cast("string")).alias("doc_id"), F.lit(2500).alias("length"), pick(["name", "role"], 1).alias("ladder"), pick(G.LEVELS, 20).alias("level"), pick(["unrelated", "sibling"], 10).alias("filler"), (1 + key % 2).cast("int").alias("copies"), key.cast("int").alias("seed"), F.lit(0.01).alias("tolerance"))


@query("""SELECT concat('d', s_suppkey) AS doc_id, 12 AS questions, 12 AS distinct_qids, CASE WHEN (s_suppkey // 20) % 5 = 0 THEN 0 ELSE 8 * (1 + s_suppkey % 2) END AS lookalikes, true AS within_tolerance,
true AS tiled, 4 AS stated, 0 AS stated_but_absent, true AS budget_counted, 0 AS near_names FROM supplier""")
def generated_documents(spark, sf_dir):
    """Counts, and what can be read off the texts: whether records tile them, witnesses state their answers and absent keys are absent, whether the tokens are as many as said, and how many invented names are within two edits of another."""
    text, ladder = F.col("document.text"), F.col("document.ladder")
    piece = lambda r: F.substr(text, r["char_start"] + 1, r["char_end"] - r["char_start"])
    placed = F.transform(F.array_sort(F.transform("records", lambda r: F.struct(r["char_start"].alias("char_start"), r["char_end"].alias("char_end")))), piece)
    stated = F.filter("questions", lambda q: q["answerable"] & F.exists("records", lambda r: (r["rid"] == q["witness_rid"]) & F.contains(piece(r), q["gold"])))
    said = F.filter("questions", lambda q: (ladder == "name") & ~q["answerable"] & F.contains(text, q["tenant"]))
    stems = F.array_distinct(F.transform("questions", lambda q: F.lower(F.split_part(q["tenant"], F.lit(" "), F.lit(1)))))
    near = F.aggregate("stems", F.lit(0), lambda n, a: n + F.size(F.filter("stems", lambda b: (a < b) & (F.levenshtein(a, b, 2) >= 0))))
    tokens = F.regexp_count(text, F.lit(r"[A-Za-z]{1,6}|\d{1,3}|[^\sA-Za-z\d]"))
    # each document's tables are read where it was built: nothing is kept, joined or sent
    return G.build(specs(spark, sf_dir)).withColumn("stems", stems).select(
        "document.doc_id", F.size("questions").alias("questions"), F.size(F.array_distinct("questions.qid")).alias("distinct_qids"), F.col("document.n_lookalikes").cast("long").alias("lookalikes"), "document.within_tolerance",
        (F.array_join(placed, G.SEPARATOR) == text).alias("tiled"), F.size(stated).alias("stated"), F.size(said).alias("stated_but_absent"), (tokens == F.col("document.n_tokens")).alias("budget_counted"), near.alias("near_names"),
    )


#: What is done to a document, by s_suppkey // 2 % 10, on the ladder by name and by role, and the rules that it breaks.
FAULTS = {
    "name": ["", "S1", "S2", "A1", "A2", "L1", "N1", "N2", "N3", "N4"],
    "role": ["", "S1", "S2", "A1", "A2", "L1", "R1", "R2", "R3", ""],
}
BROKEN = {"N2": ["N2", "N3", "N4"]}  # a name in the text has its stem and its generic, too


def planted(documents: DataFrame, records: DataFrame, questions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables, each document with the fault that its number says."""
    number = F.substring("doc_id", 2, 20).cast("long")
    fault = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.floor(number / 2) % 10 + 1).cast("int"))
    chosen = documents.select("doc_id", "text", F.when(F.col("ladder") == "name", fault(FAULTS["name"])).otherwise(fault(FAULTS["role"])).alias("fault"))
    first = Window.partitionBy("doc_id", "answerable").orderBy("probe_id")
    probes = questions.withColumn("nth", F.row_number().over(first)).where("nth = 1")
    absent = probes.where("not answerable").select("doc_id", "tenant", "stem", "generic", "building", "start_year")
    present = probes.where("answerable").select("doc_id", F.col("probe_id").alias("answered"), F.col("tenant").alias("t"), F.col("building").alias("b"), F.col("start_year").alias("y"))
    both = chosen.join(absent, "doc_id").join(present, "doc_id")
    f = F.col("fault")
    changed = F.concat(F.substring("stem", 1, 3), F.lit("x"), F.substring("stem", 5, 40))
    note = F.when(f.isin("N2", "R2"), F.col("tenant")).when(f == "N3", changed).when(f == "N4", F.concat(F.lit("Zzyzx "), F.col("generic"))).when(f == "R3", F.col("building")).when(f.isin("S2", "A1", "N1", "R1"), "one more")
    lease = F.when(f == "A1", F.create_map(F.lit("tenant"), F.col("t"), F.lit("building"), F.col("b"), F.lit("start_date"), F.concat(F.col("y").cast("string"), F.lit("-01-01"))))
    lease = lease.when(f == "N1", F.create_map(F.lit("tenant"), F.col("tenant"), F.lit("building"), F.lit("none"), F.lit("start_date"), F.lit("1900-01-01")))
    lease = lease.when(f == "R1", F.create_map(F.lit("tenant"), F.col("tenant"), F.lit("building"), F.col("building"), F.lit("start_date"), F.concat(F.col("start_year").cast("string"), F.lit("-01-01"))))
    both = both.withColumns({"note": F.concat(F.lit("see "), note, F.lit(".")), "lease": lease})
    grown = F.when(F.col("note").isNotNull(), F.concat("text", F.lit(G.SEPARATOR), "note")).when(f == "S1", F.concat("text", F.lit(" and more"))).otherwise(F.col("text"))
    texts = both.select("doc_id", "fault", "note", "lease", grown.alias("grown"), F.length("text").alias("end"), "answered").persist()
    new = texts.where("note is not null").select("doc_id", F.lit("r99999").alias("rid"), F.when(F.col("lease").isNotNull(), "lease").otherwise("note").alias("type"), F.when(f == "S2", "lookalike").otherwise("filler").alias("role"), F.lit(None).cast("string").alias("probe_id"), (F.col("end") + 2).alias("char_start"), (F.col("end") + 2 + F.length("note")).alias("char_end"), F.coalesce("lease", F.create_map().cast("map<string,string>")).alias("fields"))
    documents = documents.join(texts.select("doc_id", "grown", "fault"), "doc_id").withColumns({"text": F.col("grown"), "n_tokens": F.when(f == "L1", F.col("n_tokens") + 1000).otherwise(F.col("n_tokens"))}).drop("grown", "fault")
    asked = questions.join(texts.select("doc_id", "answered", "fault"), "doc_id")
    questions = asked.withColumn("gold", F.when((f == "A2") & (F.col("probe_id") == F.col("answered")), "#nowhere#").otherwise(F.col("gold"))).drop("answered", "fault")
    return documents, records.unionByName(new.select(*records.columns)), questions


_RULES = " UNION ALL ".join(f"SELECT '{ladder}' AS ladder, {k} AS k, '{rule}' AS rule" for ladder, faults in FAULTS.items() for k, x in enumerate(faults) if x for rule in BROKEN.get(x, [x]))


@query(f"SELECT concat('d', s_suppkey) AS doc_id, rule FROM supplier JOIN ({_RULES}) ON ladder = CASE WHEN s_suppkey % 2 = 0 THEN 'name' ELSE 'role' END AND k = (s_suppkey // 2) % 10")
def absence_proof(spark, sf_dir):
    """Each document has one planted fault, or none; the rules that it breaks are found, and no others."""
    return problems(*planted(*G.parts(G.build(specs(spark, sf_dir))))).select("doc_id", "rule").distinct()


@query("SELECT 0 AS conflicts, 300 AS names, true AS lengths, true AS letters")
def safe_stems(spark, sf_dir):
    """No two of the names are within two edits, by comparing all of them; all are of the length and letters asked for."""
    names = G.safe_stems(spark, 300).persist()
    a, b = names.select(F.lower("name").alias("a")), names.select(F.lower("name").alias("b"))
    pairs = a.join(F.broadcast(b), F.col("a") < F.col("b")).where(F.levenshtein("a", "b", 2) >= 0).agg(F.count("*").cast("int").alias("conflicts")).withColumn("one", F.lit(1))
    counted = names.agg(F.countDistinct("name").cast("int").alias("names"), F.every(F.length("name").between(5, 10)).alias("lengths"), F.every(F.col("name").rlike("^[A-Z][a-z]+$")).alias("letters")).withColumn("one", F.lit(1))
    return counted.join(pairs, "one").select("conflicts", "names", "lengths", "letters")
