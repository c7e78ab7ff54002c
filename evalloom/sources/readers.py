"""Readers: scored tables, JSON lines, documents, corpora, SQLite, YAML test sets and ZIP archives."""

from __future__ import annotations

import sqlite3
import struct
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Columns of a scored answer in CSV; lists are joined by "; " and booleans written out.
SCORED = "qid STRING, answerable STRING, field STRING, ladder STRING, level STRING, copies STRING, filler STRING, length_k STRING, gold STRING, gold_aliases STRING, lookalike_values STRING, decoy_values STRING, response STRING, label STRING, outcome STRING, refusal STRING, hedged STRING, captured STRING, mentions_lookalike STRING, value_source STRING, truncated STRING"
FOLDER = r"/([^/_]+)_([^/]+?)_([^/_]+)_t([0-9.]+)_s(\d+)/[^/]*$"


def run_name(path: Column) -> Column:
    """struct(exp, model, prompt, temperature, seed) of a folder <exp>_<model>_<prompt>_t<T>_s<seed>."""
    part = lambda g: F.regexp_extract(path, FOLDER, g)
    return F.struct(part(1).alias("exp"), part(2).alias("model"), part(3).alias("prompt"), part(4).try_cast("double").alias("temperature"), part(5).try_cast("int").alias("seed"))


SETTING = r"^(gold_present|no_gold_lookalike|no_gold_random)_(\d+)k$"


def setting_name(name: Column) -> Column:
    """struct(name, length_k, gold, filler, level) of a setting's name; null for names of another form."""
    kind = F.regexp_extract(name, SETTING, 1)
    random = F.endswith(kind, F.lit("random"))
    parts = F.struct(name.alias("name"), F.regexp_extract(name, SETTING, 2).try_cast("int").alias("length_k"), (kind == "gold_present").alias("gold"), F.when(random, "random").otherwise("lookalike").alias("filler"), F.when(kind == "gold_present", "gold").when(random, "random").otherwise("lookalike").alias("level"))
    return F.when(name.rlike(SETTING), parts)


def scored_extra(spark: SparkSession, path: str, model: str, exp: str = "exp3", run: str = "t0_s0", prompt: str = "normal") -> DataFrame:
    """The scored table of one extra run, whose folder doesn't say what it is of: exp, model, run and prompt are as given."""
    rows = scored(spark, path).drop("exp", "model", "prompt", "temperature", "seed")
    return rows.withColumns({"exp": F.lit(exp), "model": F.lit(model), "run": F.lit(run), "prompt": F.lit(prompt), "made_up": F.col("label") == "made_up", "length": F.col("length_k"), "copies_n": F.coalesce("copies", F.lit(0))})


def scored(spark: SparkSession, pattern: str, models: list[str] | None = None) -> DataFrame:
    """Scored tables with what their folders say, typed columns, and scorable, answered, flagged and doc. models: others are left out."""
    from evalloom.functions.text import FLAGGED

    rows = spark.read.schema(SCORED).csv(pattern, header=True, multiLine=True, escape='"').withColumn("run", run_name(F.col("_metadata.file_path")))
    rows = rows.select("run.*", *[c for c in rows.columns if c != "run"])
    if models:
        rows = rows.where(F.col("model").isin(models))
    yes = lambda c: F.col(c) == "True"
    typed = rows.withColumns({c: yes(c) for c in ("answerable", "refusal", "hedged", "captured", "mentions_lookalike", "truncated")} | {c: F.col(c).try_cast("int") for c in ("copies", "length_k")} | {c: F.when(F.col(c) != "", F.split(c, "; ")).otherwise(F.array().cast("array<string>")) for c in ("gold_aliases", "lookalike_values", "decoy_values")})
    made_up = F.col("label") == "made_up"
    return typed.withColumns({"doc": F.element_at(F.split("qid", "/"), 1), "scorable": F.col("label") != "other", "answered": F.col("label").isin("correct", "wrong"), "flagged": made_up & (F.col("hedged") | F.coalesce(F.col("response"), F.lit("")).rlike(FLAGGED))})


def json_lines(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """JSON lines, plain or gzip; blank lines are skipped."""
    return spark.read.schema(schema).json(pattern)


def documents(spark: SparkSession, json_pattern: str, text_pattern: str, schema: str) -> DataFrame:
    """Documents described in JSON files, joined with the text files of the same name."""
    stem = lambda path: F.regexp_extract(path, r"([^/]+)\.[^./]+$", 1)
    about = spark.read.schema(schema).json(json_pattern, multiLine=True).withColumn("stem", stem(F.col("_metadata.file_path")))
    text = spark.read.text(text_pattern, wholetext=True).select(F.col("value").alias("text"), stem(F.col("_metadata.file_path")).alias("stem"))
    return about.join(text, "stem")


def answer_files(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Answers of all runs below a folder, without scored files and parts of runs."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl*").json(folder)
    path = F.col("_metadata.file_path")
    return rows.where(~path.rlike(r"\.scored\.|\.part\d+of\d+\."))


def cache(spark: SparkSession, path: str, levels: list[str] | None = None, contexts: list[int] | None = None) -> DataFrame:
    """The answers cache, stored by level and context: other partitions aren't read."""
    rows = spark.read.parquet(path)
    rows = rows.where(F.col("level").isin(levels)) if levels else rows
    return rows.where(F.col("context_k").isin(contexts)) if contexts else rows


def first_runs(rows: DataFrame, run: list[str], order: str, n: int) -> DataFrame:
    """Rows of the n runs that come first in the order."""
    first = rows.groupBy(*run).agg(F.min(order).alias("__first")).orderBy("__first").limit(n).select(*run)
    return rows.join(F.broadcast(first), run, "left_semi")  # n rows


def sqlite_tables(spark: SparkSession, path: str, partitions: int = 8) -> dict[str, DataFrame]:
    """The tables of a SQLite file on a file system that driver and executors share, all columns as text, each read by ranges of its rows."""
    spark.dataSource.register(SqliteSource)
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        names = [name for (name,) in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%'")]
    return {name: spark.read.format("sqliterows").option("table", name).option("partitions", partitions).load(path) for name in names}


class SqliteSource(DataSource):
    """spark.read.format("sqliterows").option("table", name).load(path): a table's rows, dealt to partitions by ranges of their numbers; a table without row numbers is one partition."""

    @classmethod
    def name(cls) -> str:
        return "sqliterows"

    def schema(self) -> T.StructType:
        with _sqlite(self.options["path"]) as db:
            columns = [c[0] for c in db.execute(f"SELECT * FROM {_quoted(self.options['table'])} LIMIT 0").description]
        return T.StructType([T.StructField(c, T.StringType()) for c in columns])

    def reader(self, schema) -> SqliteReader:
        return SqliteReader(self.options)


def _sqlite(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path.removeprefix('file://')}?mode=ro", uri=True)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class SqliteReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.table, self.n = options["path"], _quoted(options["table"]), int(options.get("partitions", "8"))

    def partitions(self) -> list[Entries]:
        with _sqlite(self.path) as db:
            try:
                low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {self.table}").fetchone()
            except sqlite3.OperationalError:  # without row numbers
                return [Entries([(None, None)])]
        if low is None:
            return [Entries([])]
        step = max(1, -(-(high - low + 1) // self.n))
        return [Entries([(k, min(k + step, high + 1))]) for k in range(low, high + 1, step)]

    def read(self, partition: Entries):
        with _sqlite(self.path) as db:
            for low, high in partition.rows:
                rows = db.execute(f"SELECT * FROM {self.table}") if low is None else db.execute(f"SELECT * FROM {self.table} WHERE rowid >= ? AND rowid < ?", (low, high))
                for row in rows:
                    yield tuple(None if v is None else str(v) for v in row)


def test_set(spark: SparkSession, path: str) -> DataFrame:
    """A YAML list of test questions, or one under `tests`; ids L<level>-<type>-T<template>-<n> are taken apart, and questions cleaned of the instructions that follow them in `prompt`.

    The file is read as text and its items are parsed where Spark puts them, so the driver holds no more than any task.
    """
    from evalloom.functions.text import clean_question

    def parsed(frames):
        import pandas as pd
        import yaml

        for frame in frames:
            for text in frame["value"]:
                found = yaml.load(text, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader)) or []
                found = found.get("tests", []) if isinstance(found, dict) else found
                as_text = lambda v: None if v is None else str(v)
                yield pd.DataFrame([(as_text(r.get("question_id")), as_text(r.get("template") or r.get("question")), as_text(r.get("doc_type")), as_text(r.get("expected_response"))) for r in found], columns=["question_id", "prompt", "doc_type", "expected_response"])

    df = spark.read.text(path, wholetext=True).mapInPandas(parsed, "question_id string, prompt string, doc_type string, expected_response string")
    df = df.withColumn("question", clean_question("prompt"))
    part = lambda g: F.regexp_extract("question_id", r"^(L\d+)-([a-z_]+)-T(\d+)-(\d+)$", g)
    return df.withColumns({"level": part(1), "template_no": part(3).try_cast("int"), "n": part(4).try_cast("int")})


def split_corpus(corpora: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(corpus, doc_id, kind, char_start, char_end, text) of the documents in each text, begun by lines === KIND: id ===."""
    header = r"(?m)^=== ([A-Z_ ]+): (.+?) ===$"
    gaps = F.regexp_extract_all(F.col(text_col), F.lit(rf"(?ms)\G(.*?)(^=== [A-Z_ ]+: [^\n]+? ===$)"), F.lit(1))
    heads = F.regexp_extract_all(F.col(text_col), F.lit(rf"(?ms)\G(.*?)(^=== [A-Z_ ]+: [^\n]+? ===$)"), F.lit(2))
    from pyspark.sql import Window

    each = corpora.select(F.col(id_col).alias("corpus"), F.col(text_col).alias("__text"), F.posexplode(F.arrays_zip(gaps.alias("gap"), heads.alias("head"))).alias("k", "x"))
    w = Window.partitionBy("corpus").orderBy("k")
    each = each.withColumn("char_start", F.sum(F.length("x.gap") + F.length("x.head")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.length("x.head"))
    each = each.withColumn("char_end", F.coalesce(F.lead("char_start").over(w), F.length("__text")))
    return each.select("corpus", F.regexp_extract("x.head", header, 2).alias("doc_id"), F.regexp_extract("x.head", header, 1).alias("kind"), "char_start", "char_end", F.substr(F.col("__text"), F.col("char_start") + 1, F.col("char_end") - F.col("char_start")).alias("text"))


class ZipSource(DataSource):
    """spark.read.format("zipentries").load(path): name, size, crc_ok and content of the entries of a ZIP archive on a file system that driver and executors share.

    Options: suffix keeps names that end in it; partitions. The central directory (ZIP64 too) is read once; entries are
    dealt to partitions by place in the file, and each is read and checked by itself.
    """

    @classmethod
    def name(cls) -> str:
        return "zipentries"

    def schema(self) -> str:
        return "name string, size long, crc_ok boolean, content binary"

    def reader(self, schema) -> ZipReader:
        return ZipReader(self.options)


class Entries(InputPartition):
    def __init__(self, rows: list[tuple]):
        super().__init__(0)
        self.rows = rows


class ZipReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.suffix, self.n = options["path"].removeprefix("file://"), options.get("suffix", ""), int(options.get("partitions", "8"))

    def partitions(self) -> list[Entries]:
        with open(self.path, "rb") as f:
            rows = [r for r in directory(f) if r[0].endswith(self.suffix) and not r[0].endswith("/")]
        size = max(1, -(-len(rows) // self.n))
        return [Entries(rows[i : i + size]) for i in range(0, len(rows), size)] or [Entries([])]

    def read(self, partition: Entries):
        with open(self.path, "rb") as f:
            for name, method, crc, packed, size, at in partition.rows:
                f.seek(at)
                head = f.read(30)
                f.seek(at + 30 + sum(struct.unpack("<HH", head[26:30])))
                data = f.read(packed)
                data = zlib.decompress(data, -15) if method == 8 else data
                yield name, size, zlib.crc32(data) == crc, data


def directory(f) -> list[tuple]:
    """(name, method, crc, packed size, size, place) of the entries in an archive's central directory."""
    f.seek(0, 2)
    end = f.tell()
    f.seek(max(0, end - 65_557))
    tail, base = f.read(), max(0, end - 65_557)
    at = tail.rfind(b"PK\5\6")
    if at < 0:
        raise ValueError("no ZIP directory")
    count, size, start = struct.unpack("<HII", tail[at + 10 : at + 20])
    if count == 0xFFFF or start == 0xFFFFFFFF or size == 0xFFFFFFFF:
        locator = tail.rfind(b"PK\6\7", 0, at)
        f.seek(struct.unpack("<Q", tail[locator + 8 : locator + 16])[0])
        count, size, start = struct.unpack("<QQQ", f.read(56)[32:56])
    f.seek(start)
    data, rows, i = f.read(size), [], 0
    while data[i : i + 4] == b"PK\1\2":
        method, crc, packed, full = struct.unpack("<10xH4xIII", data[i : i + 28])[0:4]
        names, extra, comment = struct.unpack("<HHH", data[i + 28 : i + 34])
        place = struct.unpack("<I", data[i + 42 : i + 46])[0]
        name, more = data[i + 46 : i + 46 + names].decode("utf-8", "replace"), data[i + 46 + names : i + 46 + names + extra]
        j = 0
        while j + 4 <= len(more):
            kind, n = struct.unpack("<HH", more[j : j + 4])
            if kind == 1:  # the 64-bit values of those fields that overflow
                values = iter(struct.unpack(f"<{n // 8}Q", more[j + 4 : j + 4 + n // 8 * 8]))
                full, packed, place = (next(values) if v == 0xFFFFFFFF else v for v in (full, packed, place))
            j += 4 + n
        rows.append((name, method, crc, packed, full, place))
        i += 46 + names + extra + comment
    return rows


def cached_answers(results: DataFrame, levels: list[str], limit: int = 4000) -> DataFrame:
    """results(path, detailed_results: array of structs with question_id, level, response …), one row per answer; texts are kept, cut to `limit`, for the given levels only."""
    each = results.select("path", F.explode("detailed_results").alias("r")).select("path", "r.*")
    return each.withColumn("response", F.when(F.col("level").isin(levels), F.substring("response", 1, limit)))


def sha256_manifest(spark: SparkSession, pattern: str) -> DataFrame:
    """path, bytes and SHA-256 of the files."""
    return spark.read.format("binaryFile").load(pattern).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
