"""Integrity of built documents: spans tile the text, asked records are absent, answers have exactly one witness.

Frames: documents(doc_id, text, ladder, level, copies, n_tokens, target_tokens, tolerance), records(doc_id, rid, type, role,
probe_id, char_start, char_end, fields: map), questions(doc_id, probe_id, answerable, tenant, stem, generic, building,
start_year, gold, witness_rid). Each rule gives problems(doc_id, rule, probe_id, detail); a corpus passes if none does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalloom.functions.text import collapse, letters

SEPARATOR = "\n\n"


def line_spans(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, n, char_start, char_end) of the lines of each text."""
    parts = docs.select(doc, F.posexplode(F.split(F.col(text), "\n")).alias("n", "t"))
    w = Window.partitionBy(doc).orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("t") + 1).over(w), F.lit(0))
    return parts.withColumn("char_start", start).select(doc, "n", "char_start", (F.col("char_start") + F.length("t")).alias("char_end"))


def tiling_problems(docs: DataFrame, spans: DataFrame, doc: str = "doc_id", separator: int = len(SEPARATOR)) -> DataFrame:
    """Documents whose spans leave gaps, overlap, or don't end where the text ends."""
    w = Window.partitionBy(doc).orderBy("char_start", "char_end")
    gap = F.col("char_start") != F.coalesce(F.lag("char_end").over(w) + separator, F.lit(0))
    checked = spans.withColumn("gap", gap).groupBy(doc).agg(F.max(F.col("gap").cast("int")).alias("gap"), F.max("char_end").alias("end"))
    joined = docs.join(checked, doc, "left")
    return joined.where((F.coalesce("gap", F.lit(1)) == 1) | (F.col("end") != F.length("text"))).select(doc, F.lit("S1").alias("rule"))


def enclosing_span(positions: DataFrame, spans: DataFrame, doc: str = "doc_id") -> DataFrame:
    """positions(doc, pos) with the span that holds each. Both sides are merged by document and place, so a position meets no span but the last one begun."""
    marks = spans.select(doc, F.col("char_start").cast("long").alias("__at"), F.lit(0).alias("__kind"), F.struct(*[c for c in spans.columns if c != doc]).alias("__span"))
    asked = positions.select(doc, F.col("pos").cast("long").alias("__at"), F.lit(1).alias("__kind"), *[c for c in positions.columns if c not in (doc, "pos")])
    both = asked.unionByName(marks, allowMissingColumns=True)
    # an empty span begins where the next one does not; the last begun with room is the holder
    w = Window.partitionBy(doc).orderBy("__at", "__kind", "__span.char_end").rowsBetween(Window.unboundedPreceding, 0)
    held = both.withColumn("__last", F.last("__span", ignorenulls=True).over(w)).where("__kind = 1 and __at < __last.char_end")
    return held.withColumnRenamed("__at", "pos").select(doc, "pos", *[c for c in positions.columns if c not in (doc, "pos")], "__last.*")


def not_one_witness(questions: DataFrame, records: DataFrame, key: list[str], question: str, witness: str, rid: str) -> DataFrame:
    """Questions whose key doesn't match exactly one record, their witness."""
    found = records.groupBy(*key).agg(F.count("*").alias("matches"), F.max(rid).alias("__rid"))
    joined = questions.join(found, key, "left").fillna(0, ["matches"])
    return joined.where((F.col("matches") != 1) | (F.coalesce(F.col("__rid"), F.lit(None)) != F.col(witness)) | F.col("__rid").isNull()).select(question, "matches")


def present(asked: DataFrame, records: DataFrame, key: list[str]) -> DataFrame:
    """Asked keys that a record has, though none may."""
    return asked.join(records.select(*key).distinct(), key, "left_semi")


def _problem(rows: DataFrame, rule: str, detail: Column) -> DataFrame:
    return rows.select("doc_id", F.lit(rule).alias("rule"), "probe_id", detail.cast("string").alias("detail"))


def _own_lookalike() -> Column:
    return F.coalesce((F.col("role") == "lookalike") & (F.col("__of") == F.col("probe_id")), F.lit(False))


def problems(documents: DataFrame, records: DataFrame, questions: DataFrame) -> DataFrame:
    """All rules over all documents, one row per document, rule and probe."""
    spec = documents.select("doc_id", "ladder", "level", "copies")
    spans = records.select("doc_id", "rid", "role", F.col("probe_id").alias("__of"), "char_start", "char_end")
    out = [tiling_problems(documents, spans).select("doc_id", "rule", F.lit(None).cast("string").alias("probe_id"), F.lit("records don't tile the text").alias("detail"))]

    asked = questions.join(spec, "doc_id")
    probes = asked.where("not answerable").groupBy("doc_id").agg(F.count("*").alias("probes"))
    counted = records.groupBy("doc_id").agg(F.count_if(F.col("role") == "lookalike").alias("found"))
    want = F.when(F.col("level") == "none", 0).otherwise(F.coalesce("probes", F.lit(0)) * F.col("copies"))
    wrong = spec.join(probes, "doc_id", "left").join(counted, "doc_id", "left").withColumn("want", want).where(F.coalesce("found", F.lit(0)) != F.col("want")).withColumn("probe_id", F.lit(None).cast("string"))
    out.append(_problem(wrong, "S2", F.concat_ws(" of ", "found", "want")))

    leases = records.where("type = 'lease'").select("doc_id", "rid", F.col("fields")["tenant"].alias("tenant"), F.col("fields")["building"].alias("building"), F.substring(F.col("fields")["start_date"], 1, 4).cast("int").alias("start_year"))
    texts = documents.select("doc_id", "text")

    # answerable: exactly one lease has the key, the witness, and it states the gold answer
    answered = asked.where("answerable")
    pairs = answered.alias("q").join(leases.alias("l"), (F.col("q.doc_id") == F.col("l.doc_id")) & (F.col("q.tenant") == F.col("l.tenant")) & ((F.col("q.ladder") == "name") | ((F.col("q.building") == F.col("l.building")) & (F.col("q.start_year") == F.col("l.start_year")))), "left")
    one = pairs.groupBy("q.doc_id", "q.probe_id", "q.witness_rid").agg(F.count("l.rid").alias("n"), F.max("l.rid").alias("rid")).where("n <> 1 or rid <> witness_rid")
    out.append(_problem(one, "A1", F.col("n")))
    witness = answered.join(records.select("doc_id", F.col("rid").alias("witness_rid"), "char_start", "char_end"), ["doc_id", "witness_rid"], "left").join(texts, "doc_id")
    stated = F.contains(F.substr(F.col("text"), F.col("char_start") + 1, F.col("char_end") - F.col("char_start")), F.col("gold"))
    out.append(_problem(witness.where(F.col("char_start").isNull() | ~stated), "A2", F.col("gold")))

    # name ladder: the asked name is nowhere, words near its stem and names with its generic only in its own look-alikes
    named = asked.where("not answerable and ladder = 'name'")
    out.append(_problem(named.join(leases.select("doc_id", "tenant").distinct(), ["doc_id", "tenant"]), "N1", F.col("tenant")))
    normal = texts.select("doc_id", collapse(F.lower("text")).alias("normal"))
    out.append(_problem(named.join(normal, "doc_id").where(F.contains("normal", collapse(F.lower("tenant")))), "N2", F.col("tenant")))
    words = _found(texts, r"[A-Za-z]{4,}")
    near = named.join(words, "doc_id").withColumn("edits", F.levenshtein(letters("match"), letters("stem"), 2)).where("edits >= 0")
    near = enclosing_span(near.withColumnRenamed("at", "pos"), spans)
    allowed = ((F.col("level") == "medium") & (F.col("edits") == 0)) | ((F.col("level") == "strong") & (F.col("edits") == 1))
    out.append(_problem(near.where(~(allowed & _own_lookalike())), "N3", F.col("match")))
    pairs = _found(texts, r"\b[A-Z][a-z]+ [A-Z][a-z]+\b").withColumn("generic", F.element_at(F.split("match", " "), -1))
    shared = enclosing_span(named.join(pairs, ["doc_id", "generic"]).withColumnRenamed("at", "pos"), spans)
    out.append(_problem(shared.where(~(F.col("level").isin("weak", "strong") & _own_lookalike())), "N4", F.col("match")))

    # role ladder: no lease has the asked key; its parts only in their own profile or the allowed look-alikes
    roles = asked.where("not answerable and ladder = 'role'")
    out.append(_problem(roles.join(leases.select("doc_id", "tenant", "building", "start_year").distinct(), ["doc_id", "tenant", "building", "start_year"]), "R1", F.col("tenant")))
    for rule, column, levels in (("R2", "tenant", ("medium", "strong")), ("R3", "building", ("weak", "strong"))):
        said = roles.join(texts, "doc_id").select("doc_id", "probe_id", "level", column, F.explode(_occurrences(F.col("text"), F.col(column))).alias("pos"))
        said = enclosing_span(said, spans)
        own = F.coalesce((F.col("role") == "entity") & (F.col("__of") == F.col("probe_id")), F.lit(False))
        out.append(_problem(said.where(~(own | (F.col("level").isin(*levels) & _own_lookalike()))), rule, F.col(column)))

    over = documents.where(F.abs(F.col("n_tokens") - F.col("target_tokens")) > F.col("tolerance") * F.col("target_tokens")).withColumn("probe_id", F.lit(None).cast("string"))
    out.append(_problem(over, "L1", F.col("n_tokens")))
    found = out[0]
    for o in out[1:]:
        found = found.unionByName(o)
    return found.groupBy("doc_id", "rule", "probe_id").agg(F.min("detail").alias("detail"))


def _found(texts: DataFrame, rx: str) -> DataFrame:
    """(doc_id, match, at) of all matches, from the lengths of what lies between them."""
    gaps = F.regexp_extract_all("text", F.lit(rf"(?s)\G(.*?)({rx})"), F.lit(1))
    hits = F.regexp_extract_all("text", F.lit(rf"(?s)\G(.*?)({rx})"), F.lit(2))
    each = texts.select("doc_id", F.posexplode(F.arrays_zip(gaps.alias("gap"), hits.alias("match"))).alias("k", "x")).select("doc_id", "k", "x.match", F.length("x.gap").alias("gap"))
    w = Window.partitionBy("doc_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return each.withColumn("at", F.sum(F.col("gap") + F.length("match")).over(w) - F.length("match")).select("doc_id", "match", "at")


def _occurrences(text: Column, name: Column) -> Column:
    """Places (from 0) where the name begins."""
    parts = F.transform(F.split(text, F.concat(F.lit("\\Q"), name, F.lit("\\E")), -1), lambda p: F.length(p))
    n = F.size(parts) - 1
    starts = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.aggregate(F.slice(parts, 1, k), F.lit(0), lambda a, x: a + x) + (k - 1) * F.length(name))
    return F.when(n > 0, starts).otherwise(F.array().cast("array<int>"))


def without_gold(passages: DataFrame, answers: DataFrame) -> DataFrame:
    """Documents that must not hold an answer but do, or come from a gold article: passages(doc_id, title, text), answers(doc_id, answers, gold_titles, is_control)."""
    from evalloom.functions.text import holds_answer

    joined = passages.join(answers, "doc_id")
    bad = joined.withColumn("holds", holds_answer("text", "answers", F.col("title")) | F.array_contains("gold_titles", F.col("title"))).groupBy("doc_id", "is_control").agg(F.max(F.col("holds").cast("int")).alias("holds"))
    return bad.where((F.col("holds") == 1) != F.col("is_control")).select("doc_id")
