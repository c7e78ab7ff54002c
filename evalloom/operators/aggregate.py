"""Grouped reports, selections, set operations and ordered computations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalloom.functions.stats import wilson

LEVELS = ["none", "weak", "medium", "strong", "decoy"]


def rate(rows: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """Share of flag with its Wilson interval; rows where flag is null don't count."""
    w = wilson(F.col("k"), F.col("n"))
    return rows.groupBy(*keys).agg(F.count_if(F.col(flag)).alias("k"), F.count(flag).alias("n")).withColumns({"rate": w["p"], "lo": w["lo"], "hi": w["hi"]})


def pooled_rate(rows: DataFrame, keys: list[str], flag: str, total: str = "all") -> DataFrame:
    """rate() for each prefix of keys as well, with `total` in place of the keys pooled over; one pass."""
    got = rows.select(*[F.col(k).cast("string").alias(k) for k in keys], flag).rollup(*keys).agg(F.count_if(F.col(flag)).alias("k"), F.count(flag).alias("n"), F.grouping_id().alias("__g"))
    w = wilson(F.col("k"), F.col("n"))
    named = {k: F.when(F.col("__g").bitwiseAND(1 << (len(keys) - 1 - i)) > 0, total).otherwise(F.col(k)) for i, k in enumerate(keys)}
    return got.withColumns(named).drop("__g").withColumns({"rate": w["p"], "lo": w["lo"], "hi": w["hi"]})


def macro_rate(rows: DataFrame, unit: str, keys: list[str], flag: str) -> DataFrame:
    """Mean over units of their rates, and the rate of all rows."""
    each = rows.groupBy(*keys, unit).agg(F.count_if(F.col(flag)).alias("k"), F.count(flag).alias("n"))
    return each.groupBy(*keys).agg(F.avg(F.col("k") / F.col("n")).alias("macro"), (F.sum("k") / F.sum("n")).alias("micro"), F.count("*").alias("units"))


def complete_units(rows: DataFrame, unit: str, over: str) -> DataFrame:
    """Units that have rows at every value of `over`."""
    wanted = rows.agg(F.countDistinct(over).alias("all")).withColumn("__1", F.lit(1))
    return rows.groupBy(unit).agg(F.countDistinct(over).alias("n")).withColumn("__1", F.lit(1)).join(F.broadcast(wanted), "__1").where("n = all").select(unit)


def cell_sizes(rows: DataFrame, cell: list[str], cluster: str, over: str) -> DataFrame:
    """Rows and clusters of each cell, and their least and most over the values of `over`."""
    each = rows.groupBy(*cell, over).agg(F.count("*").alias("rows"), F.countDistinct(cluster).alias("clusters"))
    return each.groupBy(*cell).agg(F.min("rows").alias("rows_min"), F.max("rows").alias("rows_max"), F.min("clusters").alias("clusters_min"), F.max("clusters").alias("clusters_max"))


def breaking_point(rates: DataFrame, keys: list[str], over: str, first, least_drop: float | None = None) -> DataFrame:
    """The first value of `over` beyond `first` where the interval lies above that of `first` (or, with least_drop, below it by at least that much); null where none does."""
    base = rates.where(F.col(over) == first).select(*keys, F.col("lo").alias("lo0"), F.col("hi").alias("hi0"), F.col("rate").alias("rate0"))
    broken = (F.col("lo") > F.col("hi0")) if least_drop is None else (F.col("hi") < F.col("lo0")) & (F.col("rate0") - F.col("rate") >= least_drop)
    return base.join(rates, keys).groupBy(*keys).agg(F.min(F.when((F.col(over) > first) & broken, F.col(over))).alias("breaks_at"))


def exposure(rows: DataFrame, context: str, level: str, count: str, partial: str) -> DataFrame:
    """Mean and median count, share of two or more, and mean partial, by context and level and by context alone (level 'all')."""
    return rows.groupingSets([[context, level], [context]], context, level).agg(F.avg(count).alias("mean"), F.median(count).alias("median"), F.avg((F.col(count) >= 2).cast("double")).alias("share_2"), F.avg(partial).alias("mean_partial"), F.grouping(level).alias("__g")).withColumn(level, F.when(F.col("__g") == 1, "all").otherwise(F.col(level).cast("string"))).drop("__g")


def level_rank(level) -> Column:
    return F.array_position(F.array(*map(F.lit, LEVELS)), F.col(level) if isinstance(level, str) else level)


def matrix(rows: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Counts with a column for each of the values."""
    return rows.groupBy(row).pivot(column, values).count().fillna(0)


def histogram(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.groupBy(*columns).agg(F.count("*").alias("n"))


def varying(table: DataFrame, keys: list[str]) -> list[str]:
    """Those of keys that take more than one value."""
    got = table.agg(*[F.countDistinct(F.coalesce(F.col(k).cast("string"), F.lit("\0"))).alias(k) for k in keys]).first()
    return [k for k in keys if got[k] > 1]


def manifest(docs: DataFrame) -> DataFrame:
    """Documents, how many within tolerance, and the deviations' ends and rebuilds."""
    return docs.agg(F.count("*").alias("documents"), F.count_if("within_tolerance").alias("within_tolerance"), F.min("deviation").alias("deviation_min"), F.max("deviation").alias("deviation_max"), F.sum("n_records").alias("records"))


def token_stats(rows: DataFrame, keys: list[str], tokens: str, window: int) -> DataFrame:
    return rows.groupBy(*keys).agg(F.avg(tokens).alias("mean"), F.max(tokens).alias("max")).withColumn("headroom", window - F.col("max"))


def token_ratios(rows: DataFrame, tokenizer: str, tokens: str, reference: str, window: int) -> DataFrame:
    """Mean tokens by tokenizer, their ratio to the reference one's, and whether the longest fits the window."""
    each = rows.groupBy(tokenizer).agg(F.avg(tokens).alias("mean"), F.max(tokens).alias("max"))
    one = each.where(F.col(tokenizer) == reference).select(F.col("mean").alias("ref"), F.lit(1).alias("__1"))
    return each.withColumn("__1", F.lit(1)).join(F.broadcast(one), "__1").select(tokenizer, "mean", "max", (F.col("mean") / F.col("ref")).alias("ratio"), (F.col("max") <= window).alias("fits"))


def agreement(ours: DataFrame, theirs: DataFrame, keys: list[str], column: str, within: float = 1.0) -> DataFrame:
    """Cells both tables have: how many, the mean absolute difference, and the share within `within`."""
    both = ours.select(*keys, F.col(column).alias("a")).join(theirs.select(*keys, F.col(column).alias("b")), keys)
    d = F.abs(F.col("a") - F.col("b"))
    return both.agg(F.count("*").alias("cells"), F.avg(d).alias("mean_abs_diff"), F.avg((d <= within).cast("double")).alias("share_within"))


def coverage(left: DataFrame, right: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Rows of left by group, and how many right has and lacks."""
    marked = right.select(*keys).distinct().withColumn("__in", F.lit(True))
    return left.join(marked, keys, "left").groupBy(*by).agg(F.count("*").alias("n"), F.count("__in").alias("found"), F.count_if(F.col("__in").isNull()).alias("missing"))


def merged(parts: list[DataFrame], key: list[str], keep: str = "first") -> DataFrame:
    """The union of tables with one row per key: the first (or last) table's that has it."""
    union = None
    for n, p in enumerate(parts):
        p = p.withColumn("__src", F.lit(n))
        union = p if union is None else union.unionByName(p, allowMissingColumns=True)
    order = F.col("__src") if keep == "first" else F.desc("__src")
    return union.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(order))).where("__n = 1").drop("__n", "__src")


def left_to_do(wanted: DataFrame, done: DataFrame, doc: str, key: str) -> DataFrame:
    """Documents with a key that isn't done."""
    todo = wanted.join(done.select(key).distinct(), key, "left_anti").select(doc).distinct()
    return wanted.select(doc).distinct().join(todo, doc)


def balanced(rows: DataFrame, cell: list[str], order: list, n: int, tie: list[str]) -> DataFrame:
    """n rows dealt round-robin over cells: the first of each cell, then the second, and so on."""
    w = Window.partitionBy(*cell).orderBy(*order)
    return rows.withColumn("round", F.row_number().over(w)).orderBy("round", *tie).limit(n)


def shard(rows: DataFrame, order: list[str], n: int, k: int) -> DataFrame:
    """Every n-th row in the order, from the k-th. Rows are numbered by range, not in one task."""
    from evalloom.operators.ordered import numbered

    return numbered(rows, order).where(F.pmod(F.col("number"), F.lit(n)) == k)


def sampled(rows: DataFrame, group: list[str], key: str, n: int, seed: int = 0, first: list | None = None) -> DataFrame:
    """n rows of each group by keyed hash, with those that `first` puts first before others; then item numbers in a shuffled order."""
    drawn = Window.partitionBy(*group).orderBy(*(first or []), F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), key)
    picked = rows.withColumn("__n", F.row_number().over(drawn)).where(F.col("__n") <= n).drop("__n")
    return picked.withColumn("item", F.row_number().over(Window.orderBy(F.md5(F.concat_ws("|", F.lit(f"{seed}-order"), F.col(key).cast("string"))), key)))  # a sample's size


def grid(spark, dims: dict[str, list], contexts: int, base_seed: int, offset: int) -> DataFrame:
    """All combinations in the order of dims, with `contexts` rows each and running seeds."""
    order, df = list(dims), None
    for name, values in dims.items():
        one = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"__{name} int, {name} {'int' if isinstance(values[0], int) else 'string'}")
        df = one if df is None else df.crossJoin(one)  # a handful of literals each
    df = df.crossJoin(spark.range(contexts).withColumnRenamed("id", "context"))
    w = Window.orderBy(*[f"__{n}" for n in order], "context")
    return df.withColumn("seed", F.lit(base_seed + offset * 1000) + F.row_number().over(w) - 1).select(*order, "context", "seed")


def audit_levels(rows: DataFrame) -> DataFrame:
    """What should be empty: rows of level none with look-alike values, and documents of several levels."""
    stray = rows.where((F.col("level") == "none") & (F.size("lookalike_values") > 0)).agg(F.count("*").alias("none_with_lookalike")).withColumn("__1", F.lit(1))
    mixed = rows.groupBy("doc_id").agg(F.countDistinct("level").alias("n")).agg(F.count_if(F.col("n") > 1).alias("mixed_documents")).withColumn("__1", F.lit(1))
    return stray.join(mixed, "__1").drop("__1")
