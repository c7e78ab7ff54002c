"""Linkage of asked keys to records that share all but one part of them, and of names to near spellings."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalloom.functions.text import _c, letters

# States of a key slot, closest first.
PRIORITY = ["near_spelling", "other_date", "shared_name", "other_party"]
# Fixed value: words that begin no name.
NO_NAME = "Does|Did|Do|Is|Was|Were|Has|Have|What|Who|When|Which|How|Where|In|For|The|According|Reply|Manager|Comments"
_NAME_WORD = rf"(?!(?:{NO_NAME})\b)[A-Z][a-zA-Z\-]+"
NAME = rf"{_NAME_WORD}(?: {_NAME_WORD}){{1,3}}"
DAY = r"\d{4}-\d{2}-\d{2}"
PERIOD = r"(?:January|February|March|April|May|June|July|August|September|October|November|December) \d{4}"
# By document type, patterns tried in order, and what their groups are
QUESTIONS = {
    "lease_document": [(rf"({NAME})'s? lease with ({NAME}) starting ({DAY})", ["lessee", "lessor", "date"])],
    "field_report": [(rf"({NAME})'s? field report about ({NAME}) on ({DAY})", ["agent", "lessee", "date"]), (rf"did ({NAME}) file about ({NAME}) on ({DAY})", ["agent", "lessee", "date"])],
    "hr": [
        (rf"({NAME})'s? evaluation for ({PERIOD})", ["employee", "period"]),
        (rf"(?:does|did) ({NAME}) (?:work in|hold|have)\b.*?(?:their|the) ({PERIOD}) evaluation", ["employee", "period"]),
        (rf"({NAME})'s? ({PERIOD}) evaluation", ["employee", "period"]),
    ],
}
SLOTS = {"lease_document": ["lessee", "lessor", "date"], "field_report": ["agent", "lessee", "date"], "hr": ["employee", "period"]}
# By document type, what a question asks for, by its first matching pattern: (pattern, value column, presence flag)
FIELDS = {
    "lease_document": [
        ("pet deposit", "pet_deposit", "has_pet_clause"), ("pets? (?:are )?allowed|what pets", "pet_details", "has_pet_clause"), (r"\bpet", None, "has_pet_clause"),
        ("parking spaces", "parking_spaces", "has_parking_clause"), ("parking fee", "parking_fee", "has_parking_clause"), ("parking", None, "has_parking_clause"),
        ("what utilities|utilities (?:are )?included in", "utilities_included", "has_utilities_clause"), ("utilit", None, "has_utilities_clause"), ("subleas|sublet", None, "has_sublease_clause"),
        ("early termination fee", "early_termination_fee", "has_early_termination_clause"), ("notice period", "early_termination_notice", "has_early_termination_clause"), ("early termination", None, "has_early_termination_clause"),
        ("agent", "agent", "has_agent"), ("guarantor", "guarantor", "has_guarantor"), ("security deposit|deposit", "security_deposit", None), (r"\brent\b", "monthly_rent", None), (r"\bend\b", "end_date", None),
        ("duration|how long", "duration", None), ("property|address|located", "property_address", None),
    ],
    "field_report": [
        ("manager (?:that|who) commented|which manager", "manager_name", "has_manager_notes"), ("manager'?s comments|manager comments|manager notes", "manager_comments", "has_manager_notes"),
        ("follow-up reason|reason for (?:the )?follow", "follow_up_reason", "has_follow_up"), ("follow-up date|when .*follow", "follow_up_date", "has_follow_up"), ("follow", None, "has_follow_up"),
        ("what competitor|competitor property is", "competitor_property", "has_competitor"), ("competitor", None, "has_competitor"), ("what are the property condition|condition notes in", "condition_notes", "has_property_condition"),
        ("condition", None, "has_property_condition"), ("objection|concern", "objection_details", "has_objections"), ("referral", "referral_source", "has_referral"), ("closed deal", "report_type", None),
        ("type of field report|report type", "report_type", None), (r"\brent\b", "monthly_rent", None), ("deposit", "security_deposit", None), ("property", "property_address", None),
    ],
    "hr": [
        ("manager comments", "manager_comments", "has_manager_comments"), ("conducted|review date", "review_date", None), ("rating", "performance_rating", None), ("department", "department", None),
        ("position|role|title", "employee_role", None), ("review(?:ed|er)", "reviewer_name", None), ("summary", "performance_summary", None),
    ],
}


def parse_question(question, doc_type) -> Column:
    """map of slot to value by the first pattern of the document type that matches; null if none does."""
    q, found = _c(question), F.lit(None).cast("map<string,string>")
    for kind, patterns in reversed(list(QUESTIONS.items())):
        for rx, slots in reversed(patterns):
            got = F.create_map(*[x for g, s in enumerate(slots, 1) for x in (F.lit(s), F.trim(F.regexp_extract(q, rx, g)))])
            found = F.when((_c(doc_type) == kind) & q.rlike(rx), got).otherwise(found)
    return found


def asked_field(question, doc_type) -> Column:
    """struct(column, flag) of what the question asks for."""
    q, found = _c(question), F.struct(F.lit(None).cast("string").alias("column"), F.lit(None).cast("string").alias("flag"))
    for kind, fields in reversed(list(FIELDS.items())):
        for rx, column, flag in reversed(fields):
            found = F.when((_c(doc_type) == kind) & q.rlike(f"(?iU){rx}"), F.struct(F.lit(column).cast("string").alias("column"), F.lit(flag).cast("string").alias("flag"))).otherwise(found)
    return found


def has_field(record, column: Column, flag: Column) -> Column:
    """Whether a record (map of strings) has the asked field: its flag is set and, where there is a column, it isn't blank."""
    r = _c(record)
    flagged = flag.isNull() | F.coalesce(F.lower(F.try_element_at(r, flag)).isin("1", "true", "yes"), F.lit(False))
    value = F.try_element_at(r, column)
    return flagged & F.when(column.isNotNull(), value.isNotNull() & (F.trim(value) != "")).otherwise(flag.isNotNull())


def name_state(asked, record) -> Column:
    """exact, near_spelling (two edits at most), shared_name (first or last word) or other_party."""
    a, r = F.trim(F.lower(_c(asked))), F.trim(F.lower(_c(record)))
    at, rt = F.split(a, r"\s+"), F.split(r, r"\s+")
    shared = (F.element_at(at, 1) == F.element_at(rt, 1)) | (F.element_at(at, -1) == F.element_at(rt, -1))
    return F.when(r.isNull() | (r == ""), "other_party").when(a == r, "exact").when(F.levenshtein(a, r, 2) >= 0, "near_spelling").when(shared, "shared_name").otherwise("other_party")


def slot_state(asked, record, is_date: bool) -> Column:
    if is_date:
        return F.when(F.trim(F.coalesce(_c(record).cast("string"), F.lit(""))) == _c(asked).cast("string"), "exact").otherwise("other_date")
    return name_state(asked, record)


def lookalikes(asked: DataFrame, records: DataFrame, slots: list[str], dates: list[str], asked_id: str = "question_id", record_id: str = "rid") -> DataFrame:
    """(question, record, differing slot, state): records that differ from the asked key in exactly one slot.

    One equi-join on the other slots per slot left out, so only pairs that agree there meet. With two slots, the one that
    differs must be near (another date, a near spelling or a shared name).
    """
    key = lambda df, s: df[s].cast("string") if s in dates else F.trim(F.lower(df[s]))
    found = None
    for out in slots:
        a = asked.select(F.col(asked_id), asked[out].alias("__asked"), *[key(asked, s).alias(f"__{s}") for s in slots if s != out])
        r = records.select(F.col(record_id), records[out].alias("__held"), *[key(records, s).alias(f"__{s}") for s in slots if s != out])
        pairs = a.join(r, [f"__{s}" for s in slots if s != out]).withColumn("state", slot_state("__asked", "__held", out in dates)).where("state <> 'exact'")
        if len(slots) < 3:
            pairs = pairs.where("state <> 'other_party'")
        pairs = pairs.select(asked_id, record_id, F.lit(out).alias("slot"), "state")
        found = pairs if found is None else found.unionByName(pairs)
    return found


def sharing(asked: DataFrame, records: DataFrame, slots: list[str], dates: list[str], asked_id: str = "question_id") -> DataFrame:
    """(question, exact, sharing): how many records agree in all slots, and in any. Counted by inclusion and exclusion over groups of records, without pairs."""
    key = lambda s: F.col(s).cast("string") if s in dates else F.trim(F.lower(s))
    a, r = asked.select(asked_id, *[key(s).alias(s) for s in slots]), records.select(*[key(s).alias(s) for s in slots])
    out = a
    for n in range(1, len(slots) + 1):
        for some in combinations(slots, n):
            name = "n_" + "_".join(some)
            out = out.join(r.groupBy(*some).agg(F.count("*").alias(name)), list(some), "left").fillna(0, [name])
    total = sum(((-1) ** (n + 1)) * F.col("n_" + "_".join(some)) for n in range(1, len(slots) + 1) for some in combinations(slots, n))
    return out.select(asked_id, F.col("n_" + "_".join(slots)).alias("exact"), total.alias("sharing"))


def strengths(asked: DataFrame, records: DataFrame, slots: list[str], dates: list[str], asked_id: str = "question_id", record_id: str = "rid") -> DataFrame:
    """Per question: strength (strong, weak, none), the closest kind, its record, and counts."""
    found = lookalikes(asked, records, slots, dates, asked_id, record_id)
    rank = F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("state"))
    best = found.groupBy(asked_id).agg(F.count("*").alias("n_lookalikes"), F.min_by(F.struct("state", "slot", record_id), F.struct(rank, record_id)).alias("best"))
    joined = sharing(asked, records, slots, dates, asked_id).join(best, asked_id, "left")
    n = F.coalesce("n_lookalikes", F.lit(0))
    partial = F.col("sharing") - F.col("exact") - n
    return joined.select(asked_id, F.when(n > 0, "strong").when(partial > 0, "weak").otherwise("none").alias("strength"), F.col("best.state").alias("best_kind"), F.col(f"best.{record_id}").alias("best_record"), F.col("best.slot").alias("differing_slot"), n.alias("n_lookalikes"), partial.alias("n_partial"), F.col("exact").alias("n_exact"))


def deletions(x, depth: int = 2) -> Column:
    """All strings made by leaving out up to `depth` characters."""
    found = F.array(_c(x))
    for _ in range(depth):
        more = F.flatten(F.transform(found, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1)))))
        found = F.array_distinct(F.concat(found, more))
    return found


def near_pairs(a: DataFrame, b: DataFrame, name_a: str, name_b: str, edits: int = 2) -> DataFrame:
    """Pairs of distinct names at most `edits` apart (but not equal), ignoring case. Names that near share a string with up to `edits` characters left out, so an equi-join finds them all."""
    x = a.select(F.col(name_a).alias("a")).where("a is not null").distinct().select("a", F.explode(deletions(F.lower("a"), edits)).alias("v"))
    y = b.select(F.col(name_b).alias("b")).where("b is not null").distinct().select("b", F.explode(deletions(F.lower("b"), edits)).alias("v"))
    pairs = x.join(y, "v").select("a", "b").distinct()
    return pairs.withColumn("edits", F.levenshtein(F.lower("a"), F.lower("b"), edits)).where("a <> b and edits >= 0")


def conflicting_names(names: DataFrame, name: str) -> DataFrame:
    """(a, b) of names that may not stand in one document: they share their first four letters or a string with up to two letters left out."""
    n = names.select(F.col(name).alias("a"), letters(name).alias("k")).distinct()
    keys = n.select("a", F.explode(F.array_distinct(F.concat(F.array(F.concat(F.lit("4:"), F.substring("k", 1, 4))), deletions("k")))).alias("v"))
    other = keys.select(F.col("a").alias("b"), "v")
    return keys.join(other, "v").where("a < b").select("a", "b").distinct()


def text_names(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Distinct pairs of capitalised words in each text."""
    rx = r"\b[A-Z][a-z]+(?:-[A-Z][a-z]+)? [A-Z][a-z]+(?:-[A-Z][a-z]+)?\b"
    return docs.select(F.col(doc_id), F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(rx), F.lit(0)))).alias("name"))


def closest_years(asked: DataFrame, records: DataFrame, key: list[str], k: int, seed: int = 0) -> DataFrame:
    """The k records of each asked key with the nearest other year; ties by keyed hash."""
    both = asked.select(*key, F.col("year").alias("asked_year")).join(records, key).where("year <> asked_year")
    w = Window.partitionBy(*key, "asked_year").orderBy(F.abs(F.col("year") - F.col("asked_year")), F.md5(F.concat_ws("|", F.lit(str(seed)), "rid")))
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
