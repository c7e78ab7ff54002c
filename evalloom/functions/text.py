"""Text normalisation and reply structure as Column expressions.

Patterns are Java regular expressions with (?U), so word and space classes cover all scripts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What replies look like.
NOT_WORDS = "in|found|mentioned|listed|provided|available|stated|included|specified|given|present|recorded|contained|referenced|shown|indicated|documented|disclosed|known|determinable|applicable"
REFUSAL = (
    r"(?iU)\b(?:"
    rf"not (?:\w+ ){{0,2}}(?:{NOT_WORDS})\b"
    rf"|(?:isn't|aren't|wasn't|weren't) (?:\w+ ){{0,2}}(?:{NOT_WORDS})\b"
    r"|no (?:\w+ ){0,1}(?:record|records|information|info|mention|data|lease|entry|entries|details?|evidence|evaluation|report|document|answer|such)\b"
    r"|(?:cannot|can't|can not|could not|couldn't|unable to|not able to) (?:be )?(?:find|found|determine|determined|locate|located|answer|answered|identify|identified|confirm|confirmed|verify|verified)"
    r"|(?:does|do|did) not (?:appear|exist|mention|contain|include|state|say|specify|list|have|show|indicate|provide)"
    r"|(?:doesn't|don't|didn't) (?:appear|exist|mention|contain|include|state|say|specify|list|have|show|indicate|provide)"
    r"|there (?:is|are|was|were) no\b|none of the (?:records|documents|reports)"
    r"|no such|neither\b.{0,40}\bnor\b)"
)
ABSTAIN = r"(?iU)^\W*(?:n/?a|na|unknown|none|not found|not available|not applicable|not in the (?:records|documents?)|cannot be determined|can't be determined|undetermined|not determinable|not specified|not stated|no information|no answer|no record|not mentioned|not provided|not listed)\W*$"
HEDGE = r"(?iU)\b(?:maybe|perhaps|probably|likely|approximately|roughly|around|could be|might be|may be|possibly|presumably|i (?:would )?guess|my best guess|best guess|estimated?|if i had to|my guess)\b"
FINAL = r"(?iU)\b(?:final\s+answer|answer)\s*[:：]"
CONCLUSION = r"(?iU)^(?:therefore|so|thus|hence|in conclusion|in summary|overall|to summarize|consequently)\b"
SENTENCE_END = r"(?U)(?<=[.!?])\s+(?=[A-Z\"'(*])|\n+"
FLAGGED = r"(?iU)\b(?:however|note|noting|although|though|but|closest|similar|instead|not exactly|spelled|spelling|typo|differ|different|assum|might|may be|possibly|likely|seems|appears)\b"
PUNCTUATION = "[!\"#$%&'()*+,\\-./:;<=>?@\\[\\\\\\]^_`{|}~‘’“”–—…]"
# Words that queries are asked without.
STOP_WORDS = (
    "a an the of in on at to for from by with and or but is are was were be been being it its this that "
    "these those as which who whom whose what when where why how do does did has have had not no yes i you he she they "
    "we his her their our your my me him them us there here than then so if into over under about after before during s"
).split()


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(_c(x), r"(?U)^\s+|\s+$", "")


def collapse(x) -> Column:
    return strip(F.regexp_replace(_c(x), r"(?U)\s+", " "))


def letters(x) -> Column:
    """Lower-case letters only."""
    return F.regexp_replace(F.lower(_c(x)), r"[^\p{L}]", "")


def qa_normalized(x) -> Column:
    """Lower case, commas out, punctuation to spaces, articles out, one space."""
    t = F.regexp_replace(F.lower(F.coalesce(_c(x), F.lit(""))), ",", "")
    t = F.regexp_replace(t, PUNCTUATION, " ")
    return collapse(F.regexp_replace(t, r"(?U)\b(?:a|an|the)\b", " "))


def qa_normalized_words(x) -> Column:
    """As qa_normalized, but anything that is no word character becomes a space."""
    t = F.regexp_replace(F.lower(F.coalesce(_c(x), F.lit(""))), ",", "")
    return collapse(F.regexp_replace(F.regexp_replace(t, r"(?U)[^\w\s]", " "), r"(?U)\b(?:a|an|the)\b", " "))


def norm_text(x) -> Column:
    """Lower case, one space, no surrounding punctuation."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(_c(x), F.lit(""))), r"(?U)\s+", " "), r"""^[ .,:;!?"'()\[\]]+|[ .,:;!?"'()\[\]]+$""", "")


def clean(x) -> Column:
    """Without thinking blocks and markdown emphasis, blanks collapsed."""
    t = F.regexp_replace(F.coalesce(_c(x), F.lit("")), r"(?is)<think>.*?</think>", " ")
    t = F.regexp_replace(t, r"(?is)^.*?</think>", " ")
    t = F.regexp_replace(t, r"\*\*|__|`", "")
    return strip(F.regexp_replace(t, r"[ \t]+", " "))


def sentences_of(cleaned: Column) -> Column:
    return F.filter(F.transform(F.split(cleaned, SENTENCE_END), lambda s: strip(s)), lambda s: s != "")


def sentences(x) -> Column:
    return sentences_of(clean(x))


def final_answer(cleaned: Column) -> Column:
    """What follows the last answer mark of a cleaned reply; empty without one."""
    return F.when(cleaned.rlike(FINAL), strip(F.element_at(F.split(cleaned, FINAL), -1))).otherwise("")


def part_of(cleaned: Column, said: Column, tail: Column) -> Column:
    """answer_part from a reply's cleaned text, its sentences and its final answer."""
    final = F.regexp_replace(strip(F.element_at(F.split(tail, r"\n\s*\n"), 1)), r"^[ \[\]]+|[ \[\]]+$", "")
    concluding = F.filter(F.slice(said, 2, F.greatest(F.size(said) - 1, F.lit(0))), lambda y: y.rlike(CONCLUSION))
    concluded = F.try_element_at(concluding, F.lit(-1))
    part = F.when(cleaned == "", F.struct(F.lit("").alias("part"), F.lit("empty").alias("source")))
    part = part.when(tail != "", F.struct(final.alias("part"), F.lit("final_line").alias("source")))
    part = part.when(F.size(said) == 0, F.struct(cleaned.alias("part"), F.lit("first_sentence").alias("source")))
    first = F.struct(F.try_element_at(said, F.lit(1)).alias("part"), F.lit("first_sentence").alias("source"))
    return part.otherwise(F.element_at(F.filter(F.array(F.struct(concluded.alias("part"), F.lit("conclusion").alias("source")), first), lambda y: y["part"].isNotNull()), 1))


def answer_part(x) -> Column:
    """struct(part, source): after the last answer mark up to a blank line; else the last concluding sentence that isn't the first; else the first sentence."""
    cleaned = clean(x)
    return part_of(cleaned, sentences_of(cleaned), final_answer(cleaned))


def is_abstain_token(x, cleaned: bool = False) -> Column:
    return F.regexp_replace(_c(x) if cleaned else clean(x), r"""^[ ."'\[\]]+|[ ."'\[\]]+$""", "").rlike(ABSTAIN)


def says_not_found(x, cleaned: bool = False) -> Column:
    return is_abstain_token(x, cleaned) | (_c(x) if cleaned else clean(x)).rlike(REFUSAL)


def has_hedge(x, cleaned: bool = False) -> Column:
    return (_c(x) if cleaned else clean(x)).rlike(HEDGE)


def query_tokens(x) -> Column:
    """Lower-case ASCII words without stop words."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(_c(x), F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: ~w.isin(STOP_WORDS))


def approx_tokens(x) -> Column:
    """Number of tokens of the counter that budgets are kept in: runs of up to 6 letters or 3 digits, or any other character."""
    return F.size(F.regexp_extract_all(_c(x), F.lit(r"[A-Za-z]{1,6}|\d{1,3}|[^\sA-Za-z\d]"), F.lit(0)))


def possessive(x) -> Column:
    return F.concat(_c(x), F.when(F.endswith(_c(x), F.lit("s")), "'").otherwise("'s"))


def money_text(x) -> Column:
    return F.concat(F.lit("$"), F.format_number(_c(x), 0))


def date_text(x) -> Column:
    return F.date_format(_c(x), "MMMM d, yyyy")


def money_aliases(x) -> Column:
    v = _c(x).cast("bigint")
    return F.array(money_text(v), F.format_number(v, 0), v.cast("string"), F.concat(F.lit("$"), v.cast("string")))


def date_aliases(x) -> Column:
    d = _c(x)
    return F.array(date_text(d), F.date_format(d, "yyyy-MM-dd"), F.date_format(d, "M/d/yyyy"), F.date_format(d, "MMM d, yyyy"))


def one_edit_variants(x) -> Column:
    """Spellings one edit away that keep the first letter: another vowel, a doubled consonant, an inner letter dropped."""
    s, vowels = F.lower(_c(x)), F.array(*[F.lit(v) for v in "aeiou"])
    n = F.length(s)

    def at(i):
        c, before, after = F.substr(s, i, F.lit(1)), F.substr(s, F.lit(1), i - 1), F.substr(s, i + 1)
        vowel = F.transform(F.filter(vowels, lambda v: v != c), lambda v: F.concat(before, v, after))
        changed = F.when(F.array_contains(vowels, c), vowel).otherwise(F.array(F.concat(before, c, c, after)))
        dropped = F.when(i < n, F.array(F.concat(before, after))).otherwise(F.array().cast("array<string>"))
        return F.concat(changed, dropped)

    found = F.flatten(F.transform(F.sequence(F.lit(2), F.greatest(n, F.lit(2))), at))
    return F.when(n >= 2, F.array_sort(F.filter(F.array_distinct(found), lambda w: (w != s) & (F.levenshtein(w, s) == 1)))).otherwise(F.array().cast("array<string>"))


def usable_answers(answers) -> Column:
    """Answers of at least two characters that are not a bare number of one or two digits."""
    return F.filter(_c(answers), lambda a: (F.length(qa_normalized(a)) >= 2) & ~qa_normalized(a).rlike(r"^\d{1,2}$"))


def holds_answer(text, answers, title=None) -> Column:
    hay = F.concat(F.lit(" "), qa_normalized(title if title is not None else F.lit("")), F.lit(" "), qa_normalized(text), F.lit(" "))
    return F.exists(_c(answers), lambda a: (qa_normalized(a) != "") & F.contains(hay, F.concat(F.lit(" "), qa_normalized(a), F.lit(" "))))


def snippet(text, needle, width: int = 160) -> Column:
    """The text around the first occurrence of needle, a column, or null."""
    at = F.position(F.lit(needle) if isinstance(needle, str) else needle, _c(text))
    return F.when(at > 0, F.substr(_c(text), F.greatest(at - width, F.lit(1)), F.lit(2 * width)))


def without_paths(x) -> Column:
    """Absolute paths cut to their last part."""
    return F.regexp_replace(_c(x), r"(?:/[\w.\-]+)+/([\w.\-]+)", "$1")


def clean_question(x) -> Column:
    """A question without the instructions on how to answer that follow it."""
    return strip(F.element_at(F.split(_c(x), r"\s+(?:Reply|Or reply|Respond|If not explicitly|Indicate your final answer)\b"), 1))


def as_question(x) -> Column:
    """With one space between words, a capital first letter and a question mark."""
    t = collapse(x)
    t = F.concat(F.upper(F.substring(t, 1, 1)), F.substr(t, F.lit(2)))
    return F.when(t.endswith("?"), t).otherwise(F.concat(t, F.lit("?")))


# Fixed value: how a line of a numbered reply begins.
NUMBERED = r"^(?:\*\*)?\(?(\d{1,2})[.):\]]\s*(?:\*\*)?\s*(.*)$"


def batch_answers(text, n: int) -> Column:
    """map of answer number to text: the first line of a number from 1 to n begins its answer, all other lines go on with the answer before."""
    lines = F.filter(F.transform(F.split(F.coalesce(_c(text), F.lit("")), r"\r\n|\n|\r"), lambda x: strip(x)), lambda x: x != "")
    numbers = F.transform(lines, lambda x: F.regexp_extract(x, NUMBERED, 1).try_cast("int"))

    # in steps, so that lines and numbers are worked out once: struct(lines, numbers) -> where answers begin -> the answers
    def answers(s):
        begins = F.filter(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.struct(F.array_position(s["numbers"], k).cast("int").alias("at"), k.alias("k"))), lambda b: b["at"] > 0)
        places = F.array_sort(begins)

        def one(b, i):
            end = F.coalesce(F.try_element_at(places, i + 2)["at"], F.size(s["lines"]) + 1)
            first = strip(F.regexp_extract(F.element_at(s["lines"], b["at"]), NUMBERED, 2))
            rest = F.slice(s["lines"], b["at"] + 1, F.greatest(end - b["at"] - 1, F.lit(0)))
            return F.struct(b["k"].alias("k"), strip(F.concat_ws(" ", first, F.array_join(rest, " "))).alias("v"))

        return F.map_from_entries(F.transform(places, one))

    return F.transform(F.array(F.struct(lines.alias("lines"), numbers.alias("numbers"))), answers)[0]


def _number(x: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(F.trim(x), r"^\$?\s*(-?\d[\d,]*(?:\.\d+)?)$", 1), ",", "").try_cast("double")


def same_answer(a, b) -> Column:
    """Numbers within half a unit; else the same words, or one within the other if both have four characters; false for empty ones."""
    x, y = (F.regexp_replace(strip(F.coalesce(_c(v), F.lit(""))), r"""^[."' ]+|[."' ]+$""", "") for v in (a, b))
    nx, ny = _number(x), _number(y)
    wx, wy = (F.trim(F.regexp_replace(F.lower(v), r"(?U)\W+", " ")) for v in (x, y))
    words = (wx != "") & (wy != "") & ((wx == wy) | ((F.least(F.length(wx), F.length(wy)) >= 4) & (F.contains(wy, wx) | F.contains(wx, wy))))
    return F.when(nx.isNotNull() & ny.isNotNull(), F.abs(nx - ny) < 0.5).otherwise(words)
