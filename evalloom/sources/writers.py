"""Writers: JSON lines with a row count, flat CSV, appended answers, packed releases and small report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalloom.functions.text import without_paths


def write_json_lines(rows: DataFrame, path: str, compression: str = "gzip") -> int:
    """Writes and gives the number of rows, counted as they pass."""
    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").option("compression", compression).json(path)
    return seen.get["n"]


def flattened(rows: DataFrame, separator: str = "; ") -> DataFrame:
    """Lists joined, null as empty text, booleans as True and False: what a CSV holds."""
    def flat(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ArrayType):
            c = F.array_join(F.transform(c, lambda x: x.cast("string")), separator)
        elif isinstance(f.dataType, T.BooleanType):
            c = F.when(c, "True").when(~c, "False")
        return F.coalesce(c.cast("string"), F.lit("")).alias(f.name)

    return rows.select(*[flat(f) for f in rows.schema.fields])


def write_csv(rows: DataFrame, path: str, columns: list[str], by: list[str] | None = None) -> None:
    """The given columns, null where a table lacks one; by: one folder for each value."""
    have = rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns])
    writer = flattened(have).write.mode("overwrite").option("header", True).option("escape", '"')
    (writer.partitionBy(*by) if by else writer).csv(path)


def append_new(answers: DataFrame, path: str, key: str) -> None:
    """Appends answers whose key the table doesn't have yet; of repeated keys in the batch one."""
    spark = answers.sparkSession
    fresh = answers.dropDuplicates([key])
    try:
        fresh = fresh.join(spark.read.parquet(path).select(key), key, "left_anti")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
    fresh.write.mode("append").parquet(path)


def scrubbed(rows: DataFrame) -> DataFrame:
    """Absolute paths cut to their last part in all text, nested too."""
    return rows.select(F.from_json(without_paths(F.to_json(F.struct(*rows.columns))), rows.schema).alias("r")).select("r.*")


def pack_release(rows: DataFrame, path: str) -> DataFrame:
    """Writes scrubbed, compressed JSON lines and gives the manifest of files."""
    from evalloom.sources.readers import sha256_manifest

    scrubbed(rows).write.mode("overwrite").option("compression", "gzip").json(path)
    return sha256_manifest(rows.sparkSession, f"{path}/part-*")


def markdown(report: DataFrame, p_columns: tuple[str, ...] = ("p",), limit: int = 1000) -> str:
    """A report of at most `limit` rows as a table: numbers with one digit, p values with three significant ones."""
    lines = ["| " + " | ".join(report.columns) + " |", "|" + "---|" * len(report.columns)]
    for r in report.limit(limit).collect():
        cells = [("" if v is None else f"{v:.3g}" if c in p_columns else f"{v:.1f}" if isinstance(v, float) else str(v)) for c, v in r.asDict().items()]
        lines.append("| " + " | ".join(cells) + " |")
    return "\n".join(lines)
