"""Secret scans with corpus-wide ownership frequency, in DataFrame operations only.

Candidates are found by fixed patterns, with code point spans. How many distinct owners and repositories hold a
candidate's value over the whole corpus then tells a widely copied example from a credential of one owner. A pattern runs
only over texts that hold a literal it can't do without; spans come from the lengths of what lies between matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalloom.llm.common import anonymous, column_of, joined_by_key, named, table, written

#: A private key from its first line to its last, or without a last line to the end of its body.
PEM = r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----(?:[^-]*(?:-[^-]+){0,8}-----END [A-Z ]{0,20}PRIVATE KEY-----|[A-Za-z0-9+/=\s]*)"
# The patterns of the base kinds. Group 1 is the value. Runs of hex digits are matched from 16 on: a shorter run can't hold a longer one.
ASSIGN = r"""(?i:(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
ACCESS = r"(AKIA[A-Z0-9]+)"
HEX = r"([0-9a-f]{16,})"
#: Further kinds that the operator adds, told apart by how they begin.
OTHER = rf"(gh[pousr]_[A-Za-z0-9]{{36,}}|xox[abprs]-[A-Za-z0-9-]{{10,}}|[rs]k_(?:live|test)_[A-Za-z0-9]{{16,}}|AIza[A-Za-z0-9_-]{{35}}|eyJ[A-Za-z0-9_-]{{8,}}\.eyJ[A-Za-z0-9_-]{{8,}}\.[A-Za-z0-9_-]{{8,}}|{PEM})"
OTHER_LITERALS = ["ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "k_live_", "k_test_", "AIza", "eyJ", "PRIVATE KEY-----"]
OTHER_KINDS = [("gh", "github"), ("xox", "slack"), ("AIza", "google"), ("eyJ", "jwt"), ("-----", "pem")]

#: Owners from which on a value counts as a copied example; and repositories, if two owners at least hold it.
COPIED_OWNERS, COPIED_REPOSITORIES = 3, 5
#: Sums of lengths that are gathered at once.
BLOCK = 64

def _any(text: Column, literals: list[str]) -> Column:
    found = F.lit(False)
    for x in literals:
        found = found | F.contains(text, F.lit(x))
    return found


def _ends(lengths: Column) -> Column:
    """Running sums. They are gathered in blocks, so that a step copies a block at most; slices of the whole array, or one growing array, would cost the square of the matches."""
    none = F.struct(F.array().cast("array<array<int>>").alias("blocks"), F.array().cast("array<int>").alias("block"), F.lit(0).alias("end"))

    def one(a, x):
        full, end = F.size(a["block"]) >= BLOCK, a["end"] + x
        blocks = F.when(full, F.array_append(a["blocks"], a["block"])).otherwise(a["blocks"])
        return F.struct(blocks.alias("blocks"), F.when(full, F.array(end)).otherwise(F.array_append(a["block"], end)).alias("block"), end.alias("end"))

    return F.aggregate(lengths, none, one, lambda a: F.flatten(F.array_append(a["blocks"], a["block"])))


def found_spans(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The columns in keep, and spans: array of (start, rank, end, kind, value) in order. A pattern runs twice over the texts that may hold a match, and values are cut from the matches; null counts as empty."""
    t = F.col(text)
    kinds = {
        "assign": (ASSIGN, F.contains(t, F.lit(":")) | F.contains(t, F.lit("="))),
        "access": (ACCESS, F.contains(t, F.lit("AKIA"))),
        "hex": (HEX, t.rlike("[0-9a-f]{16}")),
        "other": (OTHER, _any(t, OTHER_LITERALS)),
    }
    none = F.array().cast("array<string>")
    df = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias(text))
    # matches follow one another: group 0 is what lies before a match and the match, group 1 the match; only the lengths of the first are kept
    found = lambda rx, g: F.regexp_extract_all(text, F.lit(rf"(?s)\G.*?({rx})"), F.lit(g))
    df = df.select(*keep, *[F.when(may, F.transform(found(rx, 0), F.length)).otherwise(F.array().cast("array<int>")).alias(f"{kind}_n") for kind, (rx, may) in kinds.items()], *[F.when(may, found(rx, 1)).otherwise(none).alias(f"{kind}_2") for kind, (rx, may) in kinds.items()])
    def spans(rank: int, k: str) -> Column:
        rx = kinds[k][0]

        def one(m, end):
            value = F.regexp_extract(m, rx, 1) if k == "assign" else m
            kind, order = F.lit(k), F.lit(rank)
            if k == "other":
                kind, order = F.lit("stripe"), F.lit(rank + len(OTHER_KINDS))
                for n, (begins, name) in enumerate(OTHER_KINDS):
                    kind, order = F.when(F.startswith(value, F.lit(begins)), name).otherwise(kind), F.when(F.startswith(value, F.lit(begins)), rank + n).otherwise(order)
            return F.struct((end - F.length(m)).alias("start"), order.alias("rank"), end.alias("end"), kind.alias("kind"), value.alias("value"))

        least = {"assign": 12, "access": 18}.get(k, 0)
        return F.filter(F.zip_with(f"{k}_2", _ends(F.col(f"{k}_n")), one), lambda s: F.length(s["value"]) >= least)

    return df.select(*keep, F.sort_array(F.concat(*[spans(r, k) for r, k in enumerate(kinds)])).alias("spans"))


def looks_live(value: Column) -> Column:
    """Letters and digits of some variety, and no word that examples use."""
    rest = value  # what is left when five characters are taken out, wherever they stand; a list of characters would be many times as large
    for _ in range(5):
        rest = F.aggregate(F.array(rest), F.lit(""), lambda _, v: F.replace(v, F.substring(v, 1, 1), F.lit("")))
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~value.rlike("(?i)example|sample|dummy|changeme|placeholder|xxxx|1234567") & (rest != "")


_SPANS = "array<struct<start: int, rank: int, end: int, kind: string, value: string, owners: bigint, repositories: bigint, verdict: string>>"


def ownership(found: DataFrame) -> DataFrame:
    """How many distinct owners and repositories hold each value, by its SHA-256, of rows (owner, repo, spans); n: how often it is held."""
    each = found.where(F.size("spans") > 0).select("owner", "repo", F.explode("spans").alias("s")).select("owner", "repo", F.sha2("s.value", 256).alias("hash"))
    held = each.groupBy("hash", "owner", "repo").agg(F.count("*").alias("n"))
    held = held.groupBy("hash", "owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
    return held.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repositories"), F.sum("n").alias("n"))


def _verdicts(found: DataFrame, held: DataFrame, copied_owners: int, copied_repositories: int) -> DataFrame:
    """row and s, a span with owners, repositories and verdict, a row each, of rows (row, spans). Values that held lacks have no owner."""
    each = found.where(F.size("spans") > 0).select("row", F.explode("spans").alias("s")).withColumn("hash", F.sha2("s.value", 256))
    mine = each.groupBy("hash").agg(F.count("*").alias("n"))
    facts = written(mine.join(held.drop("n"), "hash", "left").select("hash", "n", F.coalesce("owners", F.lit(0)).alias("owners"), F.coalesce("repositories", F.lit(0)).alias("repositories")), "secret-owners")
    copied = (F.col("owners") >= copied_owners) | ((F.col("owners") >= 2) & (F.col("repositories") >= copied_repositories))
    verdict = F.when(copied, "copied").when(looks_live(F.col("s.value")), "live").otherwise("weak")
    span = F.struct("s.start", "s.rank", "s.end", "s.kind", "s.value", "owners", "repositories", verdict.alias("verdict"))
    return joined_by_key(each, facts, "hash", "n").select("row", span.alias("s"))


def judged(found: DataFrame, held: DataFrame, copied_owners: int = COPIED_OWNERS, copied_repositories: int = COPIED_REPOSITORIES) -> DataFrame:
    """row and its spans with owners, repositories and verdict, of rows (row, spans) that have a span."""
    return _verdicts(found, held, copied_owners, copied_repositories).groupBy("row").agg(F.sort_array(F.collect_list("s")).cast(_SPANS).alias("judged"))


def _owned(docs: DataFrame, owner_col: str, repo_cols: tuple[str, ...]) -> list[Column]:
    name = {c.lower(): c for c in docs.columns}
    owner = F.coalesce(F.col(f"`{name[owner_col]}`").cast("string"), F.lit("")) if owner_col in name else F.lit("")
    return [owner.alias("owner"), F.to_json(F.struct(*[F.col(f"`{name[c]}`").cast("string").alias(c) for c in repo_cols if c in name] or [F.lit(0)])).alias("repo")]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang"), copied_owners: int = COPIED_OWNERS, copied_repositories: int = COPIED_REPOSITORIES) -> DataFrame:
    """One row per row of docs: doc_id, spans (array of kind, start, end, value, owners, repositories, verdict) by start.

    A repository is a combination of repo_cols. verdict: copied if at least copied_owners distinct owners hold the value,
    or two and copied_repositories repositories; else live if it looks so, else weak. Null texts count as empty and have
    no spans, null owners as one owner. Texts may have any length. Rows are told apart by themselves, so null and repeated
    ids do no harm. Other columns are not read. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *_owned(docs, owner_col, repo_cols))
    found = written(found_spans(rows, "text", ["doc_id", "owner", "repo"]).withColumn("row", F.monotonically_increasing_id()), "secret-spans")
    told = judged(found, written(ownership(found), "secret-held"), copied_owners, copied_repositories)
    return found.select("doc_id", "row").join(told, "row", "left").select("doc_id", F.coalesce("judged", F.array().cast(_SPANS)).alias("spans"))


def _is(value: str, name: str = "kind"):
    return lambda s: s[name] == value


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _raw_spans(corpus: DataFrame, text_col: str, owner_col: str, repo_cols: tuple[str, ...]) -> DataFrame:
    """(owner, repo, spans) of the corpus, written: a filter on spans, such as Spark adds below explode, would else take the patterns in, and run them anew for each match."""
    rows = corpus.select(F.col(f"`{text_col}`").cast("string").alias("text"), *_owned(corpus, owner_col, repo_cols))
    return written(found_spans(rows, "text", ["owner", "repo"]), "raw-spans")


def _longest_first() -> Column:
    return F.sort_array(F.collect_list(F.struct((-F.length("value")).alias("n"), "value")))


def _replaced(text: Column, mask: str) -> Column:
    return F.aggregate("values", text, lambda t, s: F.replace(t, s["value"], F.lit(mask)))


#: A text of more live values is replaced run by run.
MANY = 64
#: What stands before a run of characters that values but private keys are made of, and the run, of GRAM characters at least: no such value is shorter, spans runs, or holds a part of a mask.
GRAM = 12
_RUNS = rf"(?s)\G(.*?)([A-Za-z0-9+/_.=-]{{{GRAM},}}+|\z)"


def _grams(text: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?=(.{{{GRAM}}}))."), F.lit(1)))


def _replaced_by_runs(texts: DataFrame, values: DataFrame, mask: str) -> DataFrame:
    """(row, whole): texts (row, text) of the rows of values, replaced as by _replaced. Each run meets the values that it holds, through that piece of a value that the fewest values of its text hold."""
    mine = texts.join(values.select("row"), "row")
    pieces = written(mine.select("row", F.posexplode(F.arrays_zip(F.regexp_extract_all("text", F.lit(_RUNS), F.lit(1)).alias("gap"), F.regexp_extract_all("text", F.lit(_RUNS), F.lit(2)).alias("run")))).select("row", "pos", "col.*"), "secret-runs")
    parts = values.select("row", F.explode("values.value").alias("value")).select("row", "value", F.explode(_grams("value")).alias("gram"))
    shared = parts.withColumn("n", F.count("*").over(Window.partitionBy("row", "gram")))
    anchors = shared.groupBy("row", "value").agg(F.min(F.struct("n", "gram"))["gram"].alias("gram"))
    held = pieces.select("row", "pos", "run", F.explode(_grams("run")).alias("gram")).join(anchors, ["row", "gram"]).where(F.contains("run", F.col("value")))
    held = held.groupBy("row", "pos").agg(_longest_first().alias("values"))
    run = F.when(F.col("values").isNotNull(), _replaced(F.col("run"), mask)).otherwise(F.col("run"))
    new = pieces.join(held, ["row", "pos"], "left").select("row", F.struct("pos", F.concat("gap", run).alias("text")).alias("piece"))
    return new.groupBy("row").agg(F.array_join(F.transform(F.sort_array(F.collect_list("piece")), lambda p: p["text"]), "").alias("whole"))


def masked(docs: DataFrame, mask: str = "[SECRET]", text_col: str = "text", corpus: DataFrame | None = None, owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """docs with each value judged live replaced by mask in its text, longest first; n_chars, where there is one, is counted anew.

    Owners are counted over corpus (docs, if not given): deduplication takes owners from copied examples, so it is best
    given the raw corpus. Texts of more than MANY live values are replaced run by run, so that they don't cost values times length. Rows are told apart by themselves: null and repeated ids are masked like any other; null texts
    stay null. Only rows with a candidate are shuffled. docs may have any columns. An empty table gives an empty result.
    """
    text, columns = column_of(docs, text_col), anonymous(docs).columns
    rows = docs.select(*[F.col(f"`{name}`").alias(c) for name, c in zip(docs.columns, columns, strict=True)], F.col(f"`{text_col}`").cast("string").alias("text"), *_owned(docs, owner_col, repo_cols))
    found = written(found_spans(rows, "text", [*columns, "owner", "repo"]).withColumn("row", F.monotonically_increasing_id()), "secret-rows")
    raw = found if corpus is None else _raw_spans(corpus, text_col, owner_col, repo_cols)
    live = _verdicts(found.select("row", "spans"), written(ownership(raw), "secret-held"), COPIED_OWNERS, COPIED_REPOSITORIES).where("s.verdict = 'live'")
    live = live.groupBy("row", F.col("s.value").alias("value")).agg(F.max(F.col("s.kind") == "pem").alias("pem"))
    values = written(live.groupBy("row").agg(_longest_first().alias("values"), F.max("pem").alias("pem")), "live-values")
    some = found.where(F.size("spans") > 0)
    many = values.where((F.size("values") > MANY) & ~F.col("pem"))
    whole = some.select("row", F.lit(None).cast("string").alias("whole")).limit(0) if many.isEmpty() else _replaced_by_runs(some.select("row", F.col(text).cast("string").alias("text")), many, mask)
    new = F.when(F.col("whole").isNotNull(), F.col("whole")).otherwise(_replaced(F.col(text).cast("string"), mask))
    some = some.join(values, "row", "left").join(whole, "row", "left").withColumn("masked", F.col("values").isNotNull()).withColumn(text, F.when(F.col("masked"), new).otherwise(F.col(text)))
    if "n_chars" in docs.columns:
        n = column_of(docs, "n_chars")
        some = some.withColumn(n, F.when(F.col("masked"), F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col(n)))
    return named(found.where(F.size("spans") == 0).select(*columns).unionByName(some.select(*columns)), docs)


def op5_secret_scan(spark, sf_dir):
    base = F.filter("spans", lambda s: s["rank"] < 3)
    return scan(table(spark, sf_dir, "documents")).select(
        "doc_id",
        *[F.size(F.filter("spans", _is(k))).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
        *[F.size(F.filter("spans", _is(v, "verdict"))).cast("long").alias(f"n_{v}") for v in ("live", "copied")],
        *[F.coalesce(F.array_max(F.col(f"spans.{c}")), F.lit(0)).alias(f"most_{c}") for c in ("owners", "repositories")],
    )


def _sql_kind(kind: str, rank: int, regex: str, value: int, least: int) -> str:
    rx = regex.replace("'", "''")
    return f"""
SELECT row, owner, repo, m.n AS k, {rank} AS rank0, '{kind}' AS kind0, {least} AS least, length(p[m.n]) AS before, length(w[m.n]) AS size, v[m.n] AS value
FROM (SELECT row, owner, repo, regexp_extract_all(text, '(?s)(.*?)({rx})', 1) AS p, regexp_extract_all(text, '(?s)(.*?)({rx})', 2) AS w, regexp_extract_all(text, '(?s)(.*?)({rx})', {value}) AS v FROM d), unnest(range(1, len(p) + 1)) AS m(n)"""


_KEYS = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
OP5_SQL = (
    "WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(source, '') AS owner, concat(coalesce('s' || source, ''), '|', coalesce('l' || lang, '')) AS repo, coalesce(text, '') AS text FROM documents), m AS ("
    + " UNION ALL ".join(
        [
            _sql_kind("assign", 0, rf"""(?:{_KEYS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 3, 12),
            _sql_kind("access", 1, ACCESS, 3, 18),
            _sql_kind("hex", 2, HEX, 3, 16),
            _sql_kind("other", 3, OTHER, 3, 0),
        ]
    )
    + """
), s AS (
  SELECT row, owner, repo, value, sum(before + size) OVER (PARTITION BY row, rank0 ORDER BY k) AS stop, size, least,
    CASE WHEN rank0 < 3 THEN kind0 WHEN value LIKE 'gh%' THEN 'github' WHEN value LIKE 'xox%' THEN 'slack' WHEN value LIKE 'AIza%' THEN 'google' WHEN value LIKE 'eyJ%' THEN 'jwt' WHEN value LIKE '-----%' THEN 'pem' ELSE 'stripe' END AS kind
  FROM m
), f AS (SELECT *, stop - size AS start, list_position(['assign', 'access', 'hex', 'github', 'slack', 'google', 'jwt', 'pem', 'stripe'], kind) AS rank FROM s WHERE length(value) >= least
), h AS (SELECT value, count(DISTINCT owner) AS owners, count(DISTINCT concat(owner, '/', repo)) AS repositories FROM f GROUP BY value
), j AS (
  SELECT row, rank, start, concat(kind, ':', CAST(start AS BIGINT), ':', CAST(stop AS BIGINT)) AS span, kind, owners, repositories, owners >= 3 OR (owners >= 2 AND repositories >= 5) AS copied,
    regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') AND NOT regexp_matches(value, '(?i)example|sample|dummy|changeme|placeholder|xxxx|1234567') AND len(list_distinct(string_split(value, ''))) >= 6 AS lively
  FROM f JOIN h USING (value)
), g AS (
  SELECT row, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(span, ',' ORDER BY start, rank) FILTER (rank <= 3) AS base, string_agg(span, ',' ORDER BY start, rank) AS spans,
    count(*) FILTER (NOT copied AND lively) AS n_live, count(*) FILTER (copied) AS n_copied, max(owners) AS most_owners, max(repositories) AS most_repositories
  FROM j GROUP BY row
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied, coalesce(most_owners, 0) AS most_owners, coalesce(most_repositories, 0) AS most_repositories
FROM d LEFT JOIN g USING (row)
"""
)
