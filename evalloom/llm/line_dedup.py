"""Line dedup by site-relative frequency.

A page's lines are what its block elements hold as text. For each host, the share of its pages that hold a line is
computed over the whole corpus; lines above a boilerplate ratio are dropped from all pages of the host. A host's dropped
lines are few whatever the number of pages: each takes more than `ratio` of the pages, so there are fewer than (mean lines
of a page) / ratio of them. Lines go by a hash of host and line, so counts are spread evenly however large a host is.

The dropped lines of all hosts go to where the pages are, if they are FEW_LINES at most; pages then aren't shuffled. More
go by host, and a host's pages are dealt over as many tasks as they need. Looking a line up costs the same however many
lines its host drops.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.llm.common import joined_by_key, releasing, shuffle_width, table, written

#: Share of a host's pages beyond which a line is boilerplate, pages a host needs for a verdict, and pages that a line is on at least: one is no repetition.
RATIO, LEAST_PAGES, LEAST_REPEATS = 0.1, 1, 2
#: Dropped lines, of 16 bytes each, that are sent to all tasks at most; pages of a host in one task otherwise.
FEW_LINES, PAGES = 1_000_000, 2000

# What stands between lines, and what is no text. The same patterns serve both engines.
_DROPPED = [r"(?is)<!--.*?-->", r"(?is)<script\b.*?</script\s*>", r"(?is)<style\b.*?</style\s*>"]
_BREAK = r"(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|tr|td|th|table|section|article|header|footer|nav|title|head|body|html|main|aside|form|blockquote|pre)\b[^>]*>"
_TAG = r"<[^>]*>"
_ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def page_lines(html: Column) -> Column:
    """The page's lines: trimmed, white space collapsed, none empty."""
    x = F.coalesce(html, F.lit(""))
    for rx in _DROPPED:
        x = F.regexp_replace(x, rx, "")
    x = F.regexp_replace(F.regexp_replace(x, _BREAK, "\n"), _TAG, "")
    for name, value in _ENTITIES:
        x = F.replace(x, F.lit(name), F.lit(value))
    x = F.regexp_replace(x, "[ \t\r\f]+", " ")
    return F.filter(F.transform(F.split(x, "\n"), lambda y: F.trim(y)), lambda y: y != "")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), _HOST, 1))


_RESULT = "page_id long, host string, n_lines long, n_dropped long, text string"


def _dropped(b: pa.RecordBatch | pa.Table, keys: pa.Array) -> pa.RecordBatch:
    """Pages (page_id, host, lines, keys) without the lines whose keys are among keys."""
    flat = lambda c: c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    lines, held = flat(b.column("lines")), flat(b.column("keys"))
    n = lines.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    stays = ~pc.is_in(held.flatten(), value_set=keys).to_numpy(zero_copy_only=False).astype(bool)
    left = np.concatenate([[0], np.cumsum(stays)])[np.concatenate([[0], np.cumsum(n)])]
    kept = pa.ListArray.from_arrays(pa.array(left.astype(np.int32)), lines.flatten().filter(pa.array(stays)))
    names = [x.split()[0] for x in _RESULT.split(", ")]
    return pa.RecordBatch.from_arrays([flat(b.column("page_id")), flat(b.column("host")), pa.array(n), pa.array(n - np.diff(left)), pc.binary_join(kept, "\n")], names)


def line_dedup(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", ratio: float = RATIO, least_pages: int = LEAST_PAGES, least_repeats: int = LEAST_REPEATS, few_lines: int = FEW_LINES) -> DataFrame:
    """One row per row of pages: page_id, host, n_lines, n_dropped, text (the lines that stay, in order).

    A line goes if it is on more than ratio of the host's pages, and on least_repeats pages. Repeated rows count as pages
    of their own; a line repeated within a page counts once, and goes wherever it stands; a share of exactly ratio stays.
    Null html is empty; null or hostless urls form one host, ''. Pages may be of any length. Lines are compared by 16 bytes
    of the SHA-256 of host and line. Other columns are not read. An empty table gives an empty result.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host(F.col(url_col).cast("string")).alias("host"), page_lines(F.col(html_col).cast("string")).alias("lines"))
    key = F.transform("lines", lambda x: F.unhex(F.substring(F.sha2(F.concat("host", F.lit("\n"), x), 256), 1, 32)))
    rows = written(rows.withColumn("keys", key), "page-lines")  # pages are parsed once
    totals = written(rows.groupBy("host").agg(F.count("*").alias("pages")), "host-pages")
    held = rows.select("host", F.explode(F.array_distinct("keys")).alias("key")).groupBy("key").agg(F.first("host").alias("host"), F.count("*").alias("n")).where(F.col("n") >= least_repeats)
    common = joined_by_key(held, totals.where(F.col("pages") >= least_pages).withColumn("rows", F.col("pages")), "host", "rows").where(F.col("n") / F.col("pages") > F.lit(ratio))
    common = written(common.select("host", "key"), "common-lines")
    n = common.count()
    if n <= few_lines:
        keys = spark.sparkContext.broadcast(b"".join(sorted(bytes(r["key"]) for r in common.select("key").collect())))  # 16 bytes a line, at most few_lines

        def cut(batches):
            value = keys.value
            set_ = pa.array([value[k : k + 16] for k in range(0, len(value), 16)], pa.binary())
            for b in batches:
                if b.num_rows:
                    yield _dropped(b, set_)

        return rows.mapInArrow(releasing(cut), _RESULT)
    # a host's common lines go to each of the parts that its pages are dealt over
    buckets = max(shuffle_width(spark), -(-rows.count() // PAGES))
    parts = totals.select("host", F.ceil(F.col("pages") / PAGES).alias("parts"), "pages")
    bucket = F.pmod(F.xxhash64("host", "part"), F.lit(buckets)).alias("bucket")
    left = joined_by_key(rows.withColumn("number", F.xxhash64("page_id", "lines")), parts, "host", "pages").withColumn("part", F.pmod("number", "parts"))
    right = common.join(parts, "host").select("host", "key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))

    def both(mine: pa.Table, keys: pa.Table) -> pa.Table:
        if not mine.num_rows:
            return pa.table([pa.array([], f) for f in (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())], names=[x.split()[0] for x in _RESULT.split(", ")])
        return pa.Table.from_batches([_dropped(mine, keys.column("key").combine_chunks())])

    return left.select(bucket, "page_id", "host", "lines", "keys").toDF("bucket", "page_id", "host", "lines", "keys").groupBy("bucket").cogroup(right.select(bucket, "key").toDF("bucket", "key").groupBy("bucket")).applyInArrow(both, _RESULT)


def op8_line_dedup(spark, sf_dir):
    return line_dedup(table(spark, sf_dir, "pages"))


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _sql_text() -> str:
    x = "coalesce(html, '')"
    for rx in _DROPPED:
        x = f"regexp_replace({x}, {_q(rx)}, '', 'g')"
    x = f"regexp_replace(regexp_replace({x}, {_q(_BREAK)}, chr(10), 'g'), {_q(_TAG)}, '', 'g')"
    for name, value in _ENTITIES:
        x = f"replace({x}, {_q(name)}, {_q(value)})"
    return f"regexp_replace({x}, '[ \\t\\r\\f]+', ' ', 'g')"


OP8_SQL = f"""
WITH r AS (
  SELECT row_number() OVER () AS row, page_id, lower(regexp_extract(coalesce(url, ''), {_q(_HOST)}, 1)) AS host,
    list_filter(list_transform(string_split({_sql_text()}, chr(10)), lambda y: trim(y, ' ')), lambda y: y <> '') AS lines
  FROM pages
), t AS (SELECT host, count(*) AS pages FROM r GROUP BY host
), l AS (SELECT row, page_id, host, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS k FROM r
), c AS (SELECT host, line, count(DISTINCT row) AS n FROM l GROUP BY host, line
), b AS (SELECT host, line FROM c JOIN t USING (host) WHERE n >= {LEAST_REPEATS} AND pages >= {LEAST_PAGES} AND n / pages > CAST({RATIO} AS DOUBLE)
), s AS (SELECT row, string_agg(line, chr(10) ORDER BY k) AS text, count(*) AS n FROM l ANTI JOIN b USING (host, line) GROUP BY row)
SELECT page_id, host, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - coalesce(n, 0) AS BIGINT) AS n_dropped, coalesce(text, '') AS text
FROM r LEFT JOIN s USING (row)
"""
