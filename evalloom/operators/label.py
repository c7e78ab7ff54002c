"""Labels of free-text answers: refused, made up, correct, wrong; and where a made-up value comes from.

All rules are Column expressions over one row, laid out in steps so that no text is parsed twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.functions import text as T
from evalloom.functions import values as V


def _none() -> Column:
    return F.array().cast("array<string>")


def label_answers(answers: DataFrame) -> DataFrame:
    """answers(response, field, answerable, gold_aliases) plus kind, answer_part, answer_source, refusal, hedged, first_refuses, values, label and outcome.

    Null responses count as empty and are `other`; a null answerable counts as a question without an answer; null aliases
    as none.
    """
    df = answers.withColumns({"kind": V.kind_of("field"), "__c": T.clean("response")})
    df = df.withColumns({"__s": T.sentences_of(F.col("__c")), "__tail": T.final_answer(F.col("__c"))})
    df = df.withColumn("__p", T.part_of(F.col("__c"), F.col("__s"), F.col("__tail")))
    df = df.withColumns({"answer_part": F.col("__p.part"), "answer_source": F.col("__p.source"), "hedged": T.has_hedge("__c", True), "__first": F.try_element_at("__s", F.lit(1))})
    df = df.withColumns({
        "__refuses": F.when(F.col("answer_part") == "", False).otherwise(T.says_not_found("answer_part", True)),
        "__part_hedged": T.has_hedge("answer_part", True),
        "__pv": V.values_of_kind("answer_part", "kind"),
        "first_refuses": F.coalesce(T.says_not_found("__first", True), F.lit(False)),
    })
    by_part = (F.size("__pv") > 0) | F.col("__refuses")
    # only where the part has no value: the other sentences that state one
    stated = F.filter(F.transform("__s", lambda s: F.struct(s.alias("s"), V.values_of_kind(s, "kind").alias("v"))), lambda x: F.size(x["v"]) > 0)
    df = df.withColumn("__stated", F.when(by_part, F.array().cast("array<struct<s:string,v:array<string>>>")).otherwise(stated))
    df = df.withColumn("__other", F.try_element_at(F.filter("__stated", lambda x: ~(T.says_not_found(x["s"], True) & ~T.has_hedge(x["s"], True))), F.lit(1)))
    df = df.withColumns({
        "refusal": F.col("__refuses") & ~F.col("__part_hedged"),
        "__vals": F.when(by_part, F.col("__pv")).otherwise(F.coalesce(F.col("__other.v"), _none())),
        "__src": F.when(by_part | F.col("__other").isNull(), F.col("answer_part")).otherwise(F.col("__other.s")),
        "__targets": V.targets("gold_aliases", "kind"),
    })
    aliases = F.filter(F.coalesce("gold_aliases", _none()), lambda g: F.length(g) > 0)
    df = df.withColumns({
        "__hit": V.contains_any("__src", "__vals", "__targets", "kind") | V.contains_any("answer_part", "__pv", "__targets", "kind"),
        "__text_hit": (F.col("kind") == "text") & F.exists(aliases, lambda g: (T.qa_normalized_words(g) != "") & F.contains(F.concat(F.lit(" "), T.qa_normalized_words("answer_part"), F.lit(" ")), F.concat(F.lit(" "), T.qa_normalized_words(g), F.lit(" ")))),
        "__committed": F.when(F.col("refusal"), "").otherwise(T.strip("answer_part")),
    })
    no_part_value, some = F.size("__pv") == 0, F.size("__vals") > 0
    hedged_part = T.has_hedge("__src", True) | F.col("__part_hedged")
    answered = F.coalesce(F.col("answerable"), F.lit(False))
    typed = (
        F.when(answered & F.col("__hit") & ~(F.col("__refuses") & no_part_value), "correct")
        .when(answered & (F.col("refusal") | (F.col("__refuses") & ~some)), "wrong_refusal")
        .when(answered, F.when(some, "wrong").otherwise("other"))
        .when(F.col("__refuses") & ~hedged_part & no_part_value, "refused")
        .when(some, "made_up")
        .when(F.col("__refuses") | T.is_abstain_token("answer_part", True), "refused")
        .otherwise("other")
    )
    committed = F.col("__committed") != ""
    free = (
        F.when(answered & F.col("__text_hit"), "correct")
        .when(answered, F.when(F.col("refusal"), "wrong_refusal").when(committed, "wrong").otherwise("other"))
        .when(F.col("refusal"), "refused")
        .when(committed, "made_up")
        .otherwise("other")
    )
    is_text = F.col("kind") == "text"
    label = F.when(F.col("answer_source") == "empty", "other").when(is_text, free).otherwise(typed)
    values = F.when(F.col("answer_source") == "empty", _none()).when(is_text, F.when(committed, F.array("__committed")).otherwise(_none())).otherwise(F.col("__vals"))
    df = df.withColumns({"label": label, "values": values})
    outcome = F.when(answered, F.when(F.col("label") == "correct", "correct").when(F.col("label") == "wrong", "made_up").otherwise("other")).otherwise(F.when(F.col("label") == "refused", "correct").when(F.col("label") == "made_up", "made_up").otherwise("other"))
    return df.withColumn("outcome", outcome).select(*answers.columns, "kind", "answer_part", "answer_source", "refusal", "hedged", "first_refuses", "values", "label", "outcome")


def capture_tags(labelled: DataFrame, document_col: str | None = None) -> DataFrame:
    """Labelled answers with lookalike_values (and true_answers for free text) plus mentions_lookalike, captured and value_source.

    document_col: the text that a made-up value may have come from; without it, or where it is null, the source of a value
    that no look-alike holds is unknown.
    """
    has_truth = "true_answers" in labelled.columns
    made_up, open_ = F.col("label") == "made_up", ~F.coalesce(F.col("answerable"), F.lit(False))
    is_text = F.col("kind") == "text"
    needed = open_ & ~is_text & (F.size(F.coalesce("lookalike_values", _none())) > 0)
    df = labelled.withColumns({"__looks": V.targets("lookalike_values", "kind"), "__rv": F.when(needed, V.values_of_kind("response", "kind")).otherwise(_none())})
    mentions = needed & V.contains_any("response", "__rv", "__looks", "kind")
    captured = needed & made_up & F.exists("values", lambda c: F.exists("__looks", lambda t: F.coalesce(V.same_value(c, t["target"], "kind"), F.lit(False))))
    df = df.withColumns({"mentions_lookalike": mentions, "captured": captured}).drop("__looks", "__rv")
    said = F.concat(F.lit(" "), T.qa_normalized_words(F.array_join("values", " ")), F.lit(" "))
    true = F.exists(F.coalesce("true_answers", _none()), lambda t: (T.qa_normalized_words(t) != "") & F.contains(said, F.concat(F.lit(" "), T.qa_normalized_words(t), F.lit(" ")))) if has_truth else F.lit(False)
    if document_col:
        searched = open_ & made_up & ~is_text & ~F.col("captured") & F.col(document_col).isNotNull()  # documents of other answers aren't parsed
        df = df.withColumn("__dv", F.when(searched, V.values_of_kind(document_col, "kind")).otherwise(_none()))
        held = F.exists("values", lambda c: F.exists("__dv", lambda d: V.same_value(c, d, "kind")))
        elsewhere = F.when(F.col(document_col).isNull(), "unknown").when(held, "other_record").otherwise("not_in_document")
    else:
        elsewhere = F.lit("unknown")
    source = F.when(~(open_ & made_up), "-").when(is_text, F.when(true, "true_answer_from_memory").otherwise("not_the_true_answer")).when(F.col("captured"), "lookalike").otherwise(elsewhere)
    return df.withColumn("value_source", source).drop("__dv")


# Phrases that refuse and that warn, for a first sorting of replies before people read them.
PRE_REFUSES = r"(?iU)(?:not (?:in|mentioned|stated|found|provided|listed|included|specified|available|present|contain)|no (?:record|information|mention|lease|data|entry)|does not (?:contain|mention|include|state|specify|appear)|do not (?:contain|mention|include|state|specify)|cannot (?:find|be determined|determine)|isn'?t (?:in|mentioned|listed)|there is no|unable to|none of the records)"
PRE_WARNS = r"(?iU)\b(?:however|but|although|though|instead|closest|similar|differ|different|not \d{4}|rather than|typo|spelled|spelling|assum|note that|noting|might|may be|possibly|likely|seems|only|the records (?:do not|don't)|not the|a different|another)\b"


def _plain(x) -> Column:
    return F.trim(F.regexp_replace(F.lower(T._c(x)), "[^a-z0-9]+", " "))


def _padded(x: Column) -> Column:
    return F.concat(F.lit(" "), x, F.lit(" "))


def prelabel_unanswerable(reply, lookalike_values) -> Column:
    """struct(label, confidence) of a reply to a question without answer: R refuses, W warns or refuses but states the look-alike's value, U states a value, O anything else."""
    said, digits = _padded(_plain(reply)), F.regexp_replace(T._c(reply), r"\D", "")

    def is_stated(v):
        number = F.regexp_replace(v, r"\D", "")
        return ((_plain(v) != "") & F.contains(said, _padded(_plain(v)))) | ((F.length(number) >= 2) & F.contains(digits, number))

    stated = F.coalesce(F.exists(T._c(lookalike_values), is_stated), F.lit(False))
    refuses, warns = T._c(reply).rlike(PRE_REFUSES), T._c(reply).rlike(PRE_WARNS)
    some = T._c(reply).rlike(r"\d") | (F.size(F.split(T.strip(reply), r"\s+")) <= 8)
    pick = lambda label, confidence: F.struct(F.lit(label).alias("label"), F.lit(confidence).alias("confidence"))
    return F.when(refuses & ~stated, pick("R", "high")).when(refuses | (stated & warns), pick("W", "medium")).when(stated, pick("U", "high")).when(some, pick("U", "medium")).otherwise(pick("O", "low"))


def prelabel_match(reply, truths) -> Column:
    """struct(label, confidence): yes if a true answer, its year or all its numbers are in the reply; unsure if half of an answer's words are; else no. reply and truths are folded first (functions.folding.folded_words)."""
    years = lambda x: F.regexp_extract_all(x, F.lit(r"\b(?:1[0-9]{3}|20[0-9]{2})\b"), F.lit(0))
    numbers = lambda x: F.array_except(F.regexp_extract_all(x, F.lit(r"\b\d+(?:\.\d+)?\b"), F.lit(0)), years(x))
    said = T._c(reply)

    def rank(t):
        words = F.filter(F.array_distinct(F.split(t, " ")), lambda w: w != "")
        shared = F.size(F.array_intersect(words, F.split(said, " ")))
        whole = (t != "") & F.contains(_padded(said), _padded(t))
        same = F.arrays_overlap(years(t), years(said)) | ((F.size(numbers(t)) > 0) & (F.size(F.array_except(numbers(t), numbers(said))) == 0))
        return F.when(whole, 3).when(same, 2).when((F.size(words) > 0) & (shared * 2 >= F.size(words)), 1).otherwise(0)

    best = F.coalesce(F.array_max(F.transform(T._c(truths), rank)), F.lit(0))
    pick = lambda label, confidence: F.struct(F.lit(label).alias("label"), F.lit(confidence).alias("confidence"))
    return F.when(best == 3, pick("yes", "high")).when(best == 2, pick("yes", "medium")).when(best == 1, pick("unsure", "low")).otherwise(pick("no", "medium"))


def condition_table(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by condition, rates in percent with Wilson intervals, levels in their own order."""
    from evalloom.functions.stats import wilson

    open_, made = ~F.col("answerable"), (~F.col("answerable")) & (F.col("label") == "made_up")
    count = lambda name, c: F.count_if(c).alias(name)
    found = scored.groupBy(*keys).agg(
        count("n_no_answer", open_), count("made_up", made), count("refused", open_ & (F.col("label") == "refused")), count("other_no_answer", open_ & (F.col("label") == "other")),
        count("refused_but_mentions_lookalike", open_ & (F.col("label") == "refused") & F.col("mentions_lookalike")), count("captured", made & F.col("captured")),
        count("n_with_answer", F.col("answerable")), *[count(x, F.col("answerable") & (F.col("label") == x)) for x in ("correct", "wrong_refusal", "wrong")],
    )
    w = wilson(F.col("made_up"), F.col("n_no_answer"))
    return found.withColumns({"made_up_pct": 100 * w["p"], "made_up_lo": 100 * w["lo"], "made_up_hi": 100 * w["hi"], "capture_pct": F.when(F.col("made_up") > 0, 100 * F.col("captured") / F.col("made_up"))})
