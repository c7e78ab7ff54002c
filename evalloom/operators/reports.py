"""Reports over labelled answers: splits, contrasts between conditions and runs, checks and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalloom.functions.stats import fisher_exact
from evalloom.operators.statistics import bootstrap_draws, cluster_counts


def three_way(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Shares of answers to questions without answer that refuse, make up with a flag, and make up silently."""
    open_ = scored.where(~F.col("answerable"))
    made = F.col("label") == "made_up"
    share = lambda c, name: F.avg(c.cast("double")).alias(name)
    return open_.groupBy(*keys).agg(share(F.col("label") == "refused", "refused"), share(made & F.col("flagged"), "flagged"), share(made & ~F.col("flagged"), "silent"), F.count("*").alias("n"))


def all_cells(rows: DataFrame, sets: dict[str, list[str]], measures: dict[str, Column]) -> DataFrame:
    """Several groupings in one pass: for each named set of columns its groups' measures, the other columns null."""
    columns = sorted({c for s in sets.values() for c in s})
    grouped = rows.groupingSets([list(s) for s in sets.values()], *columns).agg(*[m.alias(n) for n, m in measures.items()], F.grouping_id().alias("__g"))
    name = F.lit(None).cast("string")
    for n, s in sets.items():
        bits = sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in s)
        name = F.when(F.col("__g") == bits, n).otherwise(name)
    return grouped.withColumn("cell", name).drop("__g")


def decoy_share(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Of made-up answers at level decoy, the share that holds a decoy's value."""
    rows = scored.where((F.col("level") == "decoy") & (F.col("label") == "made_up"))
    holds = F.exists(F.coalesce("decoy_values", F.array().cast("array<string>")), lambda v: F.instr(F.col("response"), v) > 0)
    return rows.groupBy(*keys).agg(F.count("*").alias("made_up"), F.avg(holds.cast("double")).alias("share"))


def strict_reading(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Made-up answers, and refusals that state the look-alike's value."""
    hit = (F.col("label") == "made_up") | ((F.col("label") == "refused") & F.col("mentions_lookalike"))
    return scored.where(~F.col("answerable")).groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(hit).alias("strict"))


def longest_contrasts(cells: DataFrame, keys: list[str], length: str, level: str, rate: str, short: int = 8, mid: int = 32) -> DataFrame:
    """Per group: the effect of strong look-alikes at the shortest and the longest length, of length without look-alikes, and strong at `mid` against none at the longest."""
    longest = F.max(length).over(Window.partitionBy(*keys))
    rows = cells.withColumn("__long", longest)
    at = lambda lev, where: F.max(F.when((F.col(level) == lev) & where, F.col(rate)))
    got = rows.groupBy(*keys).agg(F.max("__long").alias("longest"), at("strong", F.col(length) == short).alias("s8"), at("none", F.col(length) == short).alias("n8"), at("strong", F.col(length) == F.col("__long")).alias("sl"), at("none", F.col(length) == F.col("__long")).alias("nl"), at("strong", F.col(length) == mid).alias("sm"))
    return got.select(*keys, "longest", (F.col("s8") - F.col("n8")).alias("effect_short"), (F.col("sl") - F.col("nl")).alias("effect_longest"), (F.col("nl") - F.col("n8")).alias("length_effect"), (F.col("sm") - F.col("nl")).alias("strong_mid_vs_none_longest"))


def interaction(rows: DataFrame, keys: list[str], cluster: str, flag: str, a: str, b: str, draws: int = 2000, seed: int = 0) -> DataFrame:
    """Difference in differences of shares over two two-valued columns, with a cluster bootstrap interval for each group."""
    counts = cluster_counts(rows, [*keys, a, b], cluster, flag)
    share = lambda df: df.withColumn("r", F.col("k") / F.greatest("n", F.lit(1)))
    sign = F.when(F.col(a) == F.col(b), 1).otherwise(-1)
    seen = share(counts.groupBy(*keys, a, b).agg(F.sum("k").alias("k"), F.sum("n").alias("n"))).groupBy(*keys).agg(F.sum(sign * F.col("r")).alias("interaction"))
    drawn = share(bootstrap_draws(counts, [*keys, a, b], cluster, draws, seed)).groupBy(*keys, "draw").agg(F.sum(sign * F.col("r")).alias("x"))
    ends = drawn.groupBy(*keys).agg(F.percentile("x", F.array(F.lit(0.025), F.lit(0.975))).alias("e"))
    return seen.join(ends, keys).select(*keys, "interaction", F.col("e")[0].alias("lo"), F.col("e")[1].alias("hi"))


def macro_bootstrap(rows: DataFrame, keys: list[str], unit: str, flag: str, draws: int = 2000, seed: int = 0) -> DataFrame:
    """Mean of the units' rates, and an interval from drawing units."""
    each = cluster_counts(rows, keys, unit, flag).withColumn("rate", F.col("k") / F.col("n")).withColumn("one", F.lit(1))
    drawn = bootstrap_draws(each, keys, unit, draws, seed, ("rate", "one")).withColumn("x", F.col("rate") / F.col("one"))
    ends = drawn.groupBy(*keys).agg(F.percentile("x", F.array(F.lit(0.025), F.lit(0.975))).alias("e"))
    return each.groupBy(*keys).agg(F.avg("rate").alias("macro"), F.count("*").alias("units")).join(ends, keys).select(*keys, "macro", "units", F.col("e")[0].alias("lo"), F.col("e")[1].alias("hi"))


def significant(cells: DataFrame, keys: list[str], arm: str, base: str, other: str, alpha: float = 0.05) -> DataFrame:
    """cells(keys, unit, arm, k, n): in how many units the share differs between two arms by Fisher's test, and which way."""
    side = lambda name: cells.where(F.col(arm) == name).select(*keys, "unit", F.col("k").alias(f"k_{name}"), F.col("n").alias(f"n_{name}"))
    both = side(base).join(side(other), [*keys, "unit"])
    p = fisher_exact(F.col(f"k_{other}"), F.col(f"n_{other}"), F.col(f"k_{base}"), F.col(f"n_{base}"))
    up = F.col(f"k_{other}") / F.col(f"n_{other}") > F.col(f"k_{base}") / F.col(f"n_{base}")
    return both.withColumn("p", p).groupBy(*keys).agg(F.count("*").alias("units"), F.count_if((F.col("p") < alpha) & up).alias("higher"), F.count_if((F.col("p") < alpha) & ~up).alias("lower"))


def design_rows(cells: DataFrame, k: str, n: str) -> DataFrame:
    """Each cell as two weighted rows, y = 1 with weight k and y = 0 with weight n - k; rows without weight go."""
    return cells.withColumn("__s", F.explode(F.array(F.struct(F.lit(1).alias("y"), F.col(k).alias("w")), F.struct(F.lit(0).alias("y"), (F.col(n) - F.col(k)).alias("w"))))).select(*[c for c in cells.columns if c not in (k, n)], "__s.y", "__s.w").where("w > 0")


def label_changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Answers whose label differs between two scorings, by old and new label."""
    return old.select(key, F.col("label").alias("old")).join(new.select(key, F.col("label").alias("new")), key).where(~F.col("old").eqNullSafe(F.col("new"))).groupBy("old", "new").agg(F.count("*").alias("n"))


def provisional_label(response, answerable: Column, stated: Column, gold_hit: Column) -> Column:
    """The first scoring's label: any refusing phrase refuses, any value makes up."""
    from evalloom.functions.text import says_not_found

    refuses = says_not_found(response)
    return F.when(answerable, F.when(gold_hit, "correct").when(refuses, "wrong_refusal").when(stated, "wrong").otherwise("other")).otherwise(F.when(refuses, "refused").when(stated, "made_up").otherwise("other"))


def too_long(docs: DataFrame, tokens: str, window: int, reserve: int) -> tuple[DataFrame, DataFrame]:
    """Documents that fit a window with room for the reply, and those that don't."""
    fits = F.col(tokens) + reserve <= window
    return docs.where(fits), docs.where(~fits)


def answers_in_documents(items: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    """items(key, item, true_answers) with holds: whether the item's document has any of its true answers; yes, or no, also where there is no document."""
    from evalloom.functions.text import holds_answer

    joined = items.join(documents.select(key, "text"), key, "left")
    return joined.withColumn("holds", F.when(F.coalesce(holds_answer("text", "true_answers"), F.lit(False)), "yes").otherwise("no")).drop("text")


def verdict(effect: Column, low: Column, high: Column, positive: bool = True) -> Column:
    """supported if the interval lies on the expected side of 0, contradicted on the other, else open."""
    up, down = low > 0, high < 0
    return F.when(up if positive else down, "supported").when(down if positive else up, "contradicted").when(effect.isNull(), None).otherwise("open")


def config_problems(experiments: list[dict], windows: dict[str, int], levels: list[str], reserve: int = 1500) -> list[str]:
    """What is wrong with experiment settings: unknown levels, lengths beyond a model's window, no contexts."""
    found = []
    for e in experiments:
        found += [f"{e['name']}: unknown level {x}" for x in e.get("levels", []) if x not in levels]
        found += [f"{e['name']}: {length}K tokens don't fit {m}" for m in e.get("models", []) for length in e.get("lengths", []) if length * 1024 + reserve > windows.get(m, 0)]
        if e.get("contexts", 0) < 1:
            found.append(f"{e['name']}: no contexts")
    return found
