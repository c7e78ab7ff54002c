"""Money, dates and floors in free text, as Column expressions. Values are strings; `same_value` compares them by kind."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalloom.functions.text import _c, norm_text

# Fields and their kinds, months, ordinals, and how values are written.
KINDS = {"monthly_rent": "money", "deposit": "money", "rent": "money", "security_deposit": "money", "start_date": "date", "end_date": "date", "floor": "floor", "nq_answer": "text"}
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
ORDINALS = "first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth fifteenth sixteenth seventeenth eighteenth nineteenth twentieth".split()
MONTH = r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
#: pattern, and its groups for year, month, day
DATES = [
    (rf"(?iU)\b({MONTH})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})\b", (3, 1, 2)),
    (rf"(?iU)\b(\d{{1,2}})(?:st|nd|rd|th)?\s+(?:of\s+)?({MONTH})\.?,?\s+(\d{{4}})\b", (3, 2, 1)),
    (r"(?U)\b(\d{4})-(\d{1,2})-(\d{1,2})\b", (1, 2, 3)),
    (r"(?U)\b(\d{1,2})/(\d{1,2})/(\d{4})\b", (3, 1, 2)),
]
MONEY = r"(?iU)(?:\$|usd\s*|us\$)\s?\d[\d,]*(?:\.\d+)?\s*(?:k|thousand)?\b|\b(?:\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d{4,}(?:\.\d+)?)\s*(?:k|thousand)?\s*(?:dollars|usd)?\b"
FLOOR = (
    r"(?imU)\bfloor(?:\s+(?:number|no\.?))?(?:\s+(?:is|was|of))?\s*[:#]?\s*(\d{1,3})\b"
    r"|\b(\d{1,3})(?:st|nd|rd|th)[\s-]+floor\b"
    rf"|\b({'|'.join(ORDINALS)})[\s-]+floor\b"
    r"|^\W*(?:floor\s*)?(\d{1,3})(?:st|nd|rd|th)?\W*$"
    r"|\blevel\s+(\d{1,3})\b"
    r"|\bfloor(?:\s+number)?\b[^.\d\n]{0,80}?\b(?:is|was|are|were|=)\s*(?:on\s+)?(?:the\s+)?(?:floor\s+)?#?(\d{1,3})(?:st|nd|rd|th)?\b(?![,/-]\d)"
)


def kind_of(field) -> Column:
    """The kind of a field's values; fields not known are money."""
    found = F.lit("money")
    for name, kind in KINDS.items():
        found = F.when(_c(field) == name, kind).otherwise(found)
    return found


def _text(x) -> Column:
    return F.coalesce(_c(x), F.lit(""))


def _iso_date(match: Column, rx: str, groups: tuple[int, int, int]) -> Column:
    y, m, d = (F.regexp_extract(match, rx, g) for g in groups)
    month = F.coalesce(m.try_cast("int"), F.array_position(F.array(*map(F.lit, MONTHS)), F.substr(F.lower(m), F.lit(1), F.lit(3))).cast("int"))
    text = F.concat(y, F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-"), F.lpad(d, 2, "0"))
    return F.when(y != "0000", F.date_format(F.try_to_date(text, "yyyy-MM-dd"), "yyyy-MM-dd"))


def parse_dates(x) -> Column:
    """ISO dates, pattern by pattern; what is no date of the calendar is left out. A pattern runs over the text once, and its groups are cut from the matches."""
    
    def dates_of(rx, groups):
        return F.transform(F.regexp_extract_all(_text(x), F.lit(rx), F.lit(0)), lambda match: _iso_date(match, rx, groups))

    found = [dates_of(rx, groups) for rx, groups in DATES]
    return F.array_distinct(F.filter(F.concat(*found), lambda v: v.isNotNull()))


def parse_money(x) -> Column:
    """Amounts as numbers; four-digit years without a currency sign or comma are left out."""

    def one(m):
        number = F.regexp_extract(m, r"(\d[\d,]*(?:\.\d+)?)", 1)
        plain = F.regexp_replace(number, ",", "")
        signed = ~m.rlike(r"^\d")
        year = ~signed & ~F.contains(number, F.lit(",")) & plain.rlike(r"^(?:19|20)\d\d$")
        return F.when(~year, plain.try_cast("double") * F.when(m.rlike(r"(?i)\d\s*(?:k|thousand)"), 1000).otherwise(1))

    return F.array_distinct(F.filter(F.transform(F.regexp_extract_all(_text(x), F.lit(MONEY), F.lit(0)), one), lambda v: v.isNotNull()))


def parse_floors(x) -> Column:
    """Floors as numbers: of each match, its digits, or else its ordinal."""
    ordinal = F.array(*map(F.lit, ORDINALS))

    def one(m):
        word = F.lower(F.regexp_extract(m, rf"(?iU)\b({'|'.join(ORDINALS)})\b", 1))
        return F.coalesce(F.regexp_extract(m, r"(?U)\d{1,3}", 0).try_cast("int"), F.array_position(ordinal, word).cast("int"))

    return F.array_distinct(F.transform(F.regexp_extract_all(_text(x), F.lit(FLOOR), F.lit(0)), one))


def values_of_kind(x, kind) -> Column:
    k = _c(kind)
    as_text = lambda a: F.transform(a, lambda v: v.cast("string"))
    return F.when(k == "money", as_text(parse_money(x))).when(k == "date", parse_dates(x)).when(k == "floor", as_text(parse_floors(x))).otherwise(F.array().cast("array<string>"))


def same_value(a: Column, b: Column, kind) -> Column:
    """Money within half a unit, else equal."""
    return F.when(_c(kind) == "money", F.abs(a.try_cast("double") - b.try_cast("double")) < 0.5).otherwise(a == b)


def normalized_value(value, kind) -> Column:
    v, k = _c(value), _c(kind)
    first = F.try_element_at(values_of_kind(v, k), F.lit(1))
    return F.coalesce(first, F.when((k == "floor") & F.trim(v).rlike(r"^\d+$"), F.trim(v).try_cast("int").cast("string")))


def contains_value(text, value, kind) -> Column:
    """Whether the text states the value in any written form; values that can't be read are looked for as text."""
    target = normalized_value(value, kind)
    stated = F.exists(values_of_kind(text, kind), lambda v: same_value(v, target, kind))
    plain = (F.length(F.coalesce(_c(value), F.lit(""))) > 0) & F.contains(norm_text(text), norm_text(value))
    return F.coalesce(F.when(target.isNull(), plain).otherwise(stated), F.lit(False))


def targets(values, kind) -> Column:
    """struct(value, target) of each of the values that isn't empty: what contains_any compares with."""
    return F.transform(F.filter(F.coalesce(_c(values), F.array().cast("array<string>")), lambda v: F.length(v) > 0), lambda v: F.struct(v.alias("value"), normalized_value(v, kind).alias("target")))


def contains_any(text, found, wanted, kind) -> Column:
    """contains_value for any of the targets, given the values already found in the text."""
    return F.exists(_c(wanted), lambda t: F.when(t["target"].isNull(), F.contains(norm_text(text), norm_text(t["value"]))).otherwise(F.exists(_c(found), lambda v: same_value(v, t["target"], kind))))
