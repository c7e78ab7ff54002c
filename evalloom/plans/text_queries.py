"""Text, reply and retrieval queries. Replies are rendered from orders, so their labels and values are known by construction."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalloom.functions import text as T
from evalloom.functions import values as V
from evalloom.operators import label as L
from evalloom.operators import retrieve as R
from evalloom.plans.registry import query, spread, table

# Both engines' forms of the normaliser: articles are words of their own once punctuation is space.
QA = "array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace(replace(lower(coalesce({x}, '')), ',', ''), '[!\"#$%&''()*+\\-./:;<=>?@\\[\\\\\\]^_`{{|}}~‘’“”–—…]', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda w: w NOT IN ('a', 'an', 'the', '')), ' ')"
STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
TOKENS = "list_filter(regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]+'), lambda w: w NOT IN (" + STOP + "))"


@query(f"SELECT doc_id, {QA.format(x='text')} AS normalized FROM documents")
def qa_normalize(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents")).select("doc_id", T.qa_normalized("text").alias("normalized"))


@query(f"WITH d AS (SELECT doc_id, concat(' ', {QA.format(x='text')}, ' ') AS t FROM documents), a AS (SELECT item_id, concat(' ', {QA.format(x='text')}, ' ') AS a FROM benchmark) SELECT doc_id AS doc, item_id AS answer FROM d JOIN a ON contains(t, a) WHERE a <> '  '")
def has_answer_join(spark, sf_dir):
    return R.containing(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


@query(f"WITH d AS (SELECT doc_id, lang, concat(' ', {QA.format(x='text')}, ' ') AS t FROM documents), a AS (SELECT concat(' ', {QA.format(x='text')}, ' ') AS a FROM benchmark) SELECT lang, count(*) AS n FROM d WHERE NOT EXISTS (SELECT 1 FROM a WHERE a <> '  ' AND contains(t, a)) GROUP BY lang")
def decontaminated_documents(spark, sf_dir):
    return R.decontaminated(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark")).groupBy("lang").agg(F.count("*").alias("n"))


@query(f"""WITH w AS (SELECT doc_id, {TOKENS.format(x='text')} AS ws FROM documents), s AS (SELECT count(*) AS docs, avg(len(ws)) AS avg FROM w),
t AS (SELECT doc_id, len(ws) AS dl, unnest(ws) AS term FROM w), p AS (SELECT doc_id, dl, term, count(*) AS tf FROM t GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term), q AS (SELECT item_id, unnest(list_distinct({TOKENS.format(x='text')})) AS term FROM benchmark),
x AS (SELECT item_id AS query, doc_id AS doc, sum(ln(1 + (docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 1.9::DOUBLE / (tf + 0.9::DOUBLE * (1 - 0.4::DOUBLE + 0.4::DOUBLE * dl / avg))) AS score FROM q JOIN p USING (term) JOIN f USING (term), s GROUP BY ALL)
SELECT query, doc, round(score, 4) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, doc) AS rank FROM x) WHERE rank <= 5""")
def bm25_topk(spark, sf_dir):
    return R.bm25_top(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"), 5).withColumn("rank", F.col("rank").cast("long"))


@query(f"SELECT doc_id, len({TOKENS.format(x='text')}) AS query_tokens, len(regexp_extract_all(text, '[A-Za-z]{{1,6}}|[0-9]{{1,3}}|[^\\sA-Za-z0-9]')) AS budget_tokens FROM documents")
def token_counts(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents")).select("doc_id", F.size(T.query_tokens("text")).cast("long").alias("query_tokens"), T.approx_tokens("text").cast("long").alias("budget_tokens"))


# o_orderkey % 10 picks the reply's form
RENDERED = """SELECT o_orderkey, CAST(o_orderkey % 10 AS INT) AS form, CAST(round(o_totalprice) AS BIGINT) + 2100 AS amount, CAST(o_orderdate AS DATE) AS day, CAST(1 + o_orderkey % 60 AS INT) AS level FROM orders"""


def rendered(spark, sf_dir):
    o = spread(table(spark, sf_dir, "orders")).select("o_orderkey", (F.col("o_orderkey") % 10).cast("int").alias("form"), (F.round("o_totalprice").cast("long") + 2100).alias("amount"), F.to_date("o_orderdate").alias("day"), (1 + F.col("o_orderkey") % 60).cast("int").alias("level"))
    money, day = T.money_text("amount"), T.date_text("day")
    forms = [
        F.lit("The records do not mention that lease. Therefore, the answer is not in the records."),
        F.concat(F.lit("The monthly rent is "), money, F.lit(".")),
        F.concat(F.lit("It is not listed, but maybe "), F.format_number("amount", 0), F.lit(".")),
        F.concat(F.lit("<think>rent?</think>**Final answer:** "), F.col("amount").cast("string"), F.lit(" dollars")),
        F.concat(F.lit("The lease ends on "), day, F.lit(".")),
        F.concat(F.lit("Answer: "), F.date_format("day", "yyyy-MM-dd")),
        F.concat(F.lit("They lease floor "), F.col("level").cast("string"), F.lit(".")),
        F.lit("N/A"),
        F.lit("Could you tell me which company you mean?"),
        F.concat(F.lit("There is no such lease. The closest one pays "), money, F.lit(". Therefore, the rent is "), money, F.lit(".")),
    ]
    reply = F.lit(None).cast("string")
    for k, f in enumerate(forms):
        reply = F.when(F.col("form") == k, f).otherwise(reply)
    field = F.when(F.col("form").isin(4, 5), "end_date").when(F.col("form") == 6, "floor").otherwise("monthly_rent")
    answerable = F.col("o_orderkey") % 3 == 0
    gold = F.when(field == "end_date", T.date_aliases("day")).when(field == "floor", F.array(F.col("level").cast("string"))).otherwise(T.money_aliases(F.col("amount") + F.when(F.col("o_orderkey") % 2 == 0, 0).otherwise(17)))
    looks = F.when(F.col("o_orderkey") % 4 < 2, F.when(field == "end_date", F.array(day)).when(field == "floor", F.array(F.col("level").cast("string"))).otherwise(F.array(money))).otherwise(F.array().cast("array<string>"))
    document = F.when(F.col("o_orderkey") % 7 > 0, F.when(F.col("o_orderkey") % 7 > 3, F.concat(F.lit("Rent "), money, F.lit(", until "), day, F.lit(", floor "), F.col("level").cast("string"), F.lit("."))).otherwise("Rent $1,999."))
    return o.withColumns({"response": reply, "field": field, "answerable": answerable, "gold_aliases": gold, "lookalike_values": looks, "document": document})


# The replies as SQL writes them, and its own patterns for what they state
_MONEY_SQL = "concat('$', format('{:,}', amount))"
_DAY_SQL = "strftime(day, '%B %-d, %Y')"
REPLIES = f"""SELECT *, CASE form WHEN 0 THEN 'The records do not mention that lease. Therefore, the answer is not in the records.' WHEN 1 THEN concat('The monthly rent is ', {_MONEY_SQL}, '.')
WHEN 2 THEN concat('It is not listed, but maybe ', format('{{:,}}', amount), '.') WHEN 3 THEN concat('<think>rent?</think>**Final answer:** ', amount, ' dollars') WHEN 4 THEN concat('The lease ends on ', {_DAY_SQL}, '.')
WHEN 5 THEN concat('Answer: ', strftime(day, '%Y-%m-%d')) WHEN 6 THEN concat('They lease floor ', level, '.') WHEN 7 THEN 'N/A' WHEN 8 THEN 'Could you tell me which company you mean?'
ELSE concat('There is no such lease. The closest one pays ', {_MONEY_SQL}, '. Therefore, the rent is ', {_MONEY_SQL}, '.') END AS reply FROM ({RENDERED})"""
_AMOUNT = r"(?i)(?:\$|usd\s*)\s?\d[\d,]*(?:\.\d+)?|\b(?:\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d{4,}(?:\.\d+)?)\s*(?:dollars|usd)?\b"
_YEAR = r"^(?:19|20)\d\d\s*(?:dollars|usd)?$"
_LONG_DAY = r"\b(?:January|February|March|April|May|June|July|August|September|October|November|December) \d{1,2}, \d{4}\b"
_STOREY = r"(?i)\bfloor\s*[:#]?\s*\d{1,3}\b|\b\d{1,3}(?:st|nd|rd|th)[\s-]+floor\b|^\W*(?:floor\s*)?\d{1,3}(?:st|nd|rd|th)?\W*$|\blevel\s+\d{1,3}\b"


@query(f"""SELECT o_orderkey, list_filter(m, lambda x, i: list_position(m, x) = i) AS money,
list_concat(list_transform(regexp_extract_all(reply, '{_LONG_DAY}'), lambda d: strftime(strptime(d, '%B %-d, %Y'), '%Y-%m-%d')), regexp_extract_all(reply, '\\b\\d{{4}}-\\d{{2}}-\\d{{2}}\\b')) AS dates,
list_transform(regexp_extract_all(reply, '{_STOREY}'), lambda f: CAST(regexp_extract(f, '[0-9]+') AS INT)) AS floors FROM (SELECT *, list_transform(list_filter(regexp_extract_all(reply, '{_AMOUNT}'), lambda m: NOT regexp_matches(m, '{_YEAR}')), lambda m: concat(regexp_replace(m, '[^0-9.]', '', 'g'), '.0')) AS m FROM ({REPLIES}))""")
def reply_value_extract(spark, sf_dir):
    amounts = F.transform(V.parse_money("response"), lambda v: F.concat(v.cast("long").cast("string"), F.lit(".0")))
    return rendered(spark, sf_dir).select("o_orderkey", amounts.alias("money"), V.parse_dates("response").alias("dates"), V.parse_floors("response").alias("floors"))


def _rx(pattern: str) -> str:
    """A fixed pattern in SQL quotes, without the flag that is Java's alone."""
    return "'" + pattern.replace("(?iU)", "(?i)").replace("(?U)", "").replace("'", "''") + "'"


def _moneys(x: str) -> str:
    return f"list_transform(list_filter(regexp_extract_all({x}, '{_AMOUNT}'), lambda m: NOT regexp_matches(m, '{_YEAR}')), lambda m: concat(regexp_replace(m, '[^0-9.]', '', 'g'), '.0'))"


def _days(x: str) -> str:
    return f"list_concat(list_transform(regexp_extract_all({x}, '{_LONG_DAY}'), lambda d: strftime(strptime(d, '%B %-d, %Y'), '%Y-%m-%d')), regexp_extract_all({x}, '\\b[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}\\b'))"


def _floors(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, '{_STOREY}'), lambda f: regexp_extract(f, '[0-9]+'))"


def _values(x: str) -> str:
    return f"CASE field WHEN 'money' THEN {_moneys(x)} WHEN 'date' THEN {_days(x)} ELSE {_floors(x)} END"


def _abstains(x: str) -> str:
    return f"regexp_matches(regexp_replace({x}, {_rx(EDGES)}, '', 'g'), {_rx(T.ABSTAIN)})"


EDGES = r"""^[ ."'\[\]]+|[ ."'\[\]]+$"""
_NOT_FOUND = lambda x: f"({_abstains(x)} OR regexp_matches({x}, {_rx(T.REFUSAL)}))"
_HEDGED = lambda x: f"regexp_matches({x}, {_rx(T.HEDGE)})"

# The replies' parts, by SQL's own reading of the texts
PARTS = f"""SELECT *, CASE WHEN c = '' THEN '' WHEN marked THEN regexp_replace(trim(string_split_regex(c, {_rx(T.FINAL)})[-1]), '^[ \\[\\]]+|[ \\[\\]]+$', '', 'g') ELSE coalesce(list_filter(s[2:], lambda x: regexp_matches(x, {_rx(T.CONCLUSION)}))[-1], s[1]) END AS part,
CASE WHEN c = '' THEN 'empty' WHEN marked THEN 'final_line' WHEN len(list_filter(s[2:], lambda x: regexp_matches(x, {_rx(T.CONCLUSION)}))) > 0 THEN 'conclusion' ELSE 'first_sentence' END AS source
FROM (SELECT *, regexp_matches(c, {_rx(T.FINAL)}) AS marked, list_filter(list_transform(string_split(regexp_replace(c, '([.!?])\\s+([A-Z"''(*])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS s
FROM (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(reply, '(?is)<think>.*?</think>', ' ', 'g'), '\\*\\*|__|`', '', 'g'), '[ \\t]+', ' ', 'g')) AS c FROM ({REPLIES})))"""
# Their labels, by the rules; what is right follows from the order
_GOLD = "CASE WHEN form IN (4, 5) THEN strftime(day, '%Y-%m-%d') WHEN form = 6 THEN CAST(level AS VARCHAR) ELSE concat(amount + CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 17 END, '.0') END"
_JUDGED = f"""SELECT *, {_values('part')} AS pv, {_values('c')} AS cv, {_NOT_FOUND('part')} AS refuses, {_HEDGED('part')} AS part_hedged, {_abstains('part')} AS abstains
FROM (SELECT *, CASE WHEN form IN (4, 5) THEN 'date' WHEN form = 6 THEN 'floor' ELSE 'money' END AS field, {_GOLD} AS gold, o_orderkey % 3 = 0 AS answerable FROM ({PARTS}))"""
_OTHER = f"list_filter(s, lambda x: len({_values('x')}) > 0 AND NOT ({_NOT_FOUND('x')} AND NOT {_HEDGED('x')}))[1]"
_SETTLED = f"""SELECT *, CASE WHEN by_part OR other IS NULL THEN part ELSE other END AS src, CASE WHEN by_part THEN pv WHEN other IS NULL THEN [] ELSE {_values('other')} END AS vals
FROM (SELECT *, CASE WHEN NOT by_part THEN {_OTHER} END AS other FROM (SELECT *, len(pv) > 0 OR refuses AS by_part FROM ({_JUDGED})))"""
LABELS = f"""SELECT *, CASE WHEN source = 'empty' THEN 'other'
WHEN answerable THEN CASE WHEN (list_contains(vals, gold) OR list_contains(pv, gold)) AND NOT (refuses AND len(pv) = 0) THEN 'correct' WHEN (refuses AND NOT part_hedged) OR (refuses AND len(vals) = 0) THEN 'wrong_refusal' WHEN len(vals) > 0 THEN 'wrong' ELSE 'other' END
WHEN refuses AND NOT ({_HEDGED('src')} OR part_hedged) AND len(pv) = 0 THEN 'refused' WHEN len(vals) > 0 THEN 'made_up' WHEN refuses OR abstains THEN 'refused' ELSE 'other' END AS label, {_HEDGED('c')} AS hedges, len(cv) > 0 AS states FROM ({_SETTLED})"""


@query(f"SELECT o_orderkey, label, CASE label WHEN 'correct' THEN 'correct' WHEN 'refused' THEN 'correct' WHEN 'made_up' THEN 'made_up' WHEN 'wrong' THEN 'made_up' ELSE 'other' END AS outcome, hedges AS hedged FROM ({LABELS})")
def reply_label(spark, sf_dir):
    return L.label_answers(rendered(spark, sf_dir)).select("o_orderkey", "label", "outcome", "hedged")


@query(f"""SELECT o_orderkey, NOT answerable AND o_orderkey % 4 < 2 AND states AS mentions_lookalike, label = 'made_up' AND o_orderkey % 4 < 2 AS captured,
CASE WHEN label <> 'made_up' THEN '-' WHEN o_orderkey % 4 < 2 THEN 'lookalike' WHEN o_orderkey % 7 = 0 THEN 'unknown' WHEN o_orderkey % 7 > 3 THEN 'other_record' ELSE 'not_in_document' END AS value_source FROM ({LABELS})""")
def capture_source(spark, sf_dir):
    return L.capture_tags(L.label_answers(rendered(spark, sf_dir)), "document").select("o_orderkey", "mentions_lookalike", "captured", "value_source")


@query(f"""SELECT form, count(*) FILTER (NOT answerable) AS n_no_answer, count(*) FILTER (label = 'made_up') AS made_up, count(*) FILTER (label = 'refused') AS refused, count(*) FILTER (label = 'made_up' AND o_orderkey % 4 < 2) AS captured,
count(*) FILTER (answerable) AS n_with_answer, count(*) FILTER (label = 'correct') AS correct, count(*) FILTER (label = 'wrong') AS wrong FROM ({LABELS}) GROUP BY form""")
def condition_table(spark, sf_dir):
    scored = L.capture_tags(L.label_answers(rendered(spark, sf_dir)))
    return L.condition_table(scored, ["form"]).select("form", "n_no_answer", "made_up", "refused", "captured", "n_with_answer", "correct", "wrong")


@query(f"SELECT o_orderkey, source, part FROM ({PARTS})")
def answer_part(spark, sf_dir):
    return rendered(spark, sf_dir).select("o_orderkey", T.answer_part("response").alias("p")).select("o_orderkey", "p.source", "p.part")


@query("""WITH c AS (SELECT conv_id, turn, string_split_regex(regexp_replace(text, '([.!?])\\s+([A-Z"''(*])', '\\1' || chr(1) || '\\2', 'g'), chr(1) || '|\\n+') AS s FROM conversations)
SELECT conv_id, turn, len(list_filter(s, lambda x: trim(x, ' ' || chr(9) || chr(13)) <> '')) AS n FROM c""")
def sentence_counts(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(T.sentences("text")).cast("long").alias("n"))


@query("""WITH l AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber) AS n FROM lineitem)
SELECT l_orderkey, n, CASE WHEN n % 2 = 0 THEN concat('part ', l_partkey, ' and more') ELSE concat('part ', l_partkey) END AS answer FROM l WHERE n <= 12""")
def batch_answer_parse(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.row_number().over(w).alias("n")).where("n <= 12")
    one = F.concat(F.col("n").cast("string"), F.lit(". part "), F.col("l_partkey").cast("string"), F.when(F.col("n") % 2 == 0, "\nand more").otherwise(""))
    replies = lines.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", one.alias("t")))), lambda x: x["t"]), "\n").alias("reply"))
    return replies.select("l_orderkey", F.explode(T.batch_answers("reply", 12)).alias("n", "answer")).select("l_orderkey", F.col("n").cast("long").alias("n"), "answer")


@query("""WITH p AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS w FROM part), c AS (SELECT w, lower(w) AS s, unnest(range(2, length(w) + 1)) AS i FROM p),
v AS (SELECT w, s, concat(substr(s, 1, i - 1), v, substr(s, i + 1)) AS x FROM c, (VALUES ('a'), ('e'), ('i'), ('o'), ('u')) t(v) WHERE substr(s, i, 1) IN ('a', 'e', 'i', 'o', 'u') AND substr(s, i, 1) <> v
UNION SELECT w, s, concat(substr(s, 1, i), substr(s, i)) FROM c WHERE substr(s, i, 1) NOT IN ('a', 'e', 'i', 'o', 'u') UNION SELECT w, s, concat(substr(s, 1, i - 1), substr(s, i + 1)) FROM c WHERE i < length(s))
SELECT w, count(*) AS n, min(x) AS first, max(x) AS last FROM v WHERE x <> s AND levenshtein(x, s) = 1 GROUP BY w""")
def one_edit_variants(spark, sf_dir):
    words = table(spark, sf_dir, "part").select(F.element_at(F.split("p_name", " "), 1).alias("w")).distinct()
    return words.select("w", F.explode(T.one_edit_variants("w")).alias("x")).groupBy("w").agg(F.count("*").alias("n"), F.min("x").alias("first"), F.max("x").alias("last"))


@query("SELECT o_orderkey, concat('$', format('{:,}', CAST(round(o_totalprice) AS BIGINT))) AS money, strftime(o_orderdate, '%B %-d, %Y') AS day, strftime(o_orderdate, '%-m/%-d/%Y') AS short, concat(o_orderpriority, CASE WHEN o_orderpriority LIKE '%s' THEN '''' ELSE '''s' END) AS owner FROM orders")
def value_forms(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", T.money_text(F.round("o_totalprice").cast("long")).alias("money"), T.date_text("o_orderdate").alias("day"), T.date_aliases(F.to_date("o_orderdate"))[2].alias("short"), T.possessive("o_orderpriority").alias("owner"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_field(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[0-9]+')) AS numbers, len(list_distinct(regexp_extract_all(text, '[0-9]+'))) AS different, len(list_intersect(list_distinct(regexp_extract_all(text, '[0-9]+')), ['1', '555', '2024'])) AS shared FROM documents")
def number_overlap(spark, sf_dir):
    found = F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0))
    return spread(table(spark, sf_dir, "documents")).select("doc_id", F.size(found).cast("long").alias("numbers"), F.size(F.array_distinct(found)).cast("long").alias("different"), F.size(F.array_intersect(found, F.array(F.lit("1"), F.lit("555"), F.lit("2024")))).cast("long").alias("shared"))


@query("SELECT page_id, regexp_replace(url, '(?:/[\\w.\\-]+)+/([\\w.\\-]+)', '\\1', 'g') AS scrubbed FROM pages")
def scrubbed_paths(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.without_paths("url").alias("scrubbed"))
