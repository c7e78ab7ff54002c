"""Studies over scored answers: draws of fits, contrasts between arms, and the reports that put tables together."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.functions.stats import normal_quantile, wilson
from evalloom.operators.statistics import _maximum, _numbered, _small, bootstrap_draws, cluster_counts, keyed_draws, logit, permutation_test


def detection_draws(rows: DataFrame, keys: list[str], cluster: str, signal: str, hit: str, alarm: str, draws: int = 1000, seed: int = 0) -> DataFrame:
    """d' and criterion by group with percentile intervals over drawn clusters. hit is counted in rows with signal, alarm in the others."""
    one = lambda c: F.count_if(c)
    counts = rows.groupBy(*keys, cluster).agg(one(F.col(signal)).alias("signals"), one(F.col(signal) & F.col(hit)).alias("hits"), one(~F.col(signal)).alias("noises"), one(~F.col(signal) & F.col(alarm)).alias("alarms"))
    columns = ("signals", "hits", "noises", "alarms")

    def rates(df: DataFrame) -> DataFrame:
        h, f = normal_quantile(F.col("hits") / F.nullif("signals", F.lit(0))), normal_quantile(F.col("alarms") / F.nullif("noises", F.lit(0)))
        return df.withColumns({"d_prime": h - f, "criterion": -(h + f) / 2})

    seen = rates(counts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in columns])).select(*keys, "d_prime", "criterion")
    ends = F.array(F.lit(0.025), F.lit(0.975))
    drawn = rates(bootstrap_draws(counts, keys, cluster, draws, seed, columns)).groupBy(*keys).agg(F.percentile("d_prime", ends).alias("d"), F.percentile("criterion", ends).alias("c"))
    return seen.join(drawn, keys).select(*keys, "d_prime", F.col("d")[0].alias("d_lo"), F.col("d")[1].alias("d_hi"), "criterion", F.col("c")[0].alias("c_lo"), F.col("c")[1].alias("c_hi"))


def binomial_fit(cells: DataFrame, k: str, n: str, numeric: list[str], dummies: dict[str, list[str]] | None = None) -> list[tuple[str, float, float, float, float]]:
    """Logistic regression on counts k of n by cell: (term, log odds, lower, upper, odds ratio) of each term. dummies: for a column, its values but the first, each a term of its own."""
    columns = {c: F.col(c).cast("double") for c in numeric}
    for column, values in (dummies or {}).items():
        columns |= {f"{column}={v}": (F.col(column) == v).cast("double") for v in values}
    names = [f"__x{i}" for i in range(len(columns))]
    rows = cells.where(F.col(n) > 0).select(*[c.alias(x) for c, x in zip(columns.values(), names, strict=True)], F.explode(F.array(F.struct(F.lit(1).alias("y"), F.col(k).cast("double").alias("w")), F.struct(F.lit(0).alias("y"), (F.col(n) - F.col(k)).cast("double").alias("w")))).alias("__s"))
    weighted = rows.groupBy(*names, F.col("__s.y").alias("__y")).agg(F.sum("__s.w").alias("__w")).persist()
    size = len(names) + 1
    beta, information = _maximum(weighted, "__y", names, np.zeros((size, size)), np.zeros((size, size)), 50, None)
    weighted.unpersist()
    errors = np.sqrt(np.diag(np.linalg.inv(information)))
    return [(t, float(b), float(b - 1.959963984540054 * e), float(b + 1.959963984540054 * e), float(np.exp(b))) for t, b, e in zip(["intercept", *columns], beta, errors, strict=True)]


def _newton(design: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float) -> np.ndarray:
    """Maximum of a weighted logistic likelihood of few distinct rows; ridge steadies the information only."""
    beta = np.zeros(design.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        move = np.linalg.lstsq(np.einsum("n,ni,nj->ij", w * p * (1 - p), design, design) + ridge * np.eye(len(beta)), (w * (y - p)) @ design, rcond=None)[0]
        beta = beta + move
        if abs(move).max() < 1e-8:
            break
    return beta


def fit_draws(rows: DataFrame, y: str, x: list[str], strata: list[str], cluster: str, draws: int = 500, seed: int = 0, ridge: float = 1e-6) -> DataFrame:
    """Fits of y on x over clusters drawn within strata: draw and b0 (intercept), b1, ... in the order of x.

    Only distinct design rows with their weights meet in a draw, so a fit is small whatever the number of rows.
    """
    cells = rows.groupBy(*strata, cluster, *x, y).agg(F.count("*").alias("n"))
    of = _numbered(cells.select(*strata, cluster).distinct(), strata, cluster).persist()
    slots = of.select(*strata, "m", F.col("i").alias("slot"), F.explode(F.sequence(F.lit(0), F.lit((draws - 1) // 4))).alias("four"))
    slots = slots.select(*strata, "m", "four", F.posexplode(keyed_draws(seed, F.concat_ws("/", *strata), F.col("four"), F.col("slot"))).alias("at", "value"))
    picked = slots.select(*strata, (4 * F.col("four") + F.col("at") + 1).alias("draw"), F.pmod("value", "m").cast("int").alias("i")).where(F.col("draw") <= draws)
    weights = picked.groupBy(*strata, "draw", "i").agg(F.count("*").alias("times"))
    weighted = weights.join(_small(of.select(*strata, "i", cluster), of.count()), [*strata, "i"]).join(cells, [*strata, cluster])
    design = weighted.groupBy("draw", *x, y).agg(F.sum(F.col("times") * F.col("n")).cast("double").alias("w"))
    names = [f"b{i}" for i in range(len(x) + 1)]

    def fitted(part: pa.Table) -> pa.Table:
        columns = [np.ones(part.num_rows), *[part.column(c).to_numpy().astype(float) for c in x]]
        beta = _newton(np.column_stack(columns), part.column(y).to_numpy().astype(float), part.column("w").to_numpy(), ridge)
        return pa.table({"draw": part.column("draw").slice(0, 1), **{n: pa.array([float(b)]) for n, b in zip(names, beta, strict=True)}})

    return design.groupBy("draw").applyInArrow(fitted, "draw int, " + ", ".join(f"{n} double" for n in names))


def exchange_rate(rows: DataFrame, y: str, strong: str, doublings: str, others: list[str], model: str, document: str, draws: int = 500, seed: int = 0) -> dict[str, float | None]:
    """How many doublings of length, without look-alikes, add as much log odds as one strong look-alike adds at the shortest length.

    y on doublings, strong, their product and the other columns. None where the lower bound of the length effect isn't above
    0; the interval comes from documents drawn within models, and is None where under 90 % of draws have a length effect above 0.
    """
    both = rows.withColumn("__both", F.col(strong) * F.col(doublings))
    x = [doublings, strong, "__both", *others]
    fit = logit(both, y, x)
    (length, error), look = fit[doublings], fit[strong][0]
    drawn = fit_draws(both, y, x, [model], document, draws, seed).where("b1 > 0").select((F.col("b2") / F.col("b1")).alias("r"))
    got = drawn.agg(F.count("*").alias("n"), F.percentile("r", F.array(F.lit(0.025), F.lit(0.975))).alias("e")).first()
    enough = got["n"] >= 0.9 * draws
    return {"b_length": length, "b_strong": look, "b_both": fit["__both"][0], "exchange": look / length if length - 1.96 * error > 0 else None, "lo": got["e"][0] if enough else None, "hi": got["e"][1] if enough else None}


def arm_contrasts(rows: DataFrame, keys: list[str], cluster: str, flag: str, arm: str, pairs: list[tuple[str, str]], draws: int = 2000, perms: int = 5000, seed: int = 0) -> DataFrame:
    """For each pair (a, b) of arms: both shares, their difference with an interval from clusters drawn within each arm, and the p of whole clusters changing arms."""
    out = None
    for a, b in pairs:
        two = rows.where(F.col(arm).isin(a, b))
        sides = cluster_counts(two, [*keys, arm], cluster, flag)
        drawn = bootstrap_draws(sides, [*keys, arm], cluster, draws, seed).withColumn("r", F.col("k") / F.greatest("n", F.lit(1)))
        of = lambda name, c: F.max(F.when(F.col(arm) == name, c))
        each = drawn.groupBy(*keys, "draw").agg((of(a, F.col("r")) - of(b, F.col("r"))).alias("d"))
        ends = each.groupBy(*keys).agg(F.percentile("d", F.array(F.lit(0.025), F.lit(0.975))).alias("e"))
        rates = sides.groupBy(*keys, arm).agg((F.sum("k") / F.sum("n")).alias("r")).groupBy(*keys).agg(of(a, F.col("r")).alias("rate_a"), of(b, F.col("r")).alias("rate_b"))
        tested = permutation_test(two.withColumn("__a", F.col(arm) == a), keys, cluster, flag, "__a", perms, seed).select(*keys, "p")
        got = rates.join(ends, keys).join(tested, keys).select(*keys, F.lit(f"{a}_minus_{b}").alias("contrast"), "rate_a", "rate_b", (F.col("rate_a") - F.col("rate_b")).alias("diff"), F.col("e")[0].alias("diff_lo"), F.col("e")[1].alias("diff_hi"), "p")
        out = got if out is None else out.unionByName(got)
    return out


def setting_summary(documents: DataFrame, setting: str = "setting") -> DataFrame:
    """By setting: documents, and means of their tokens, passages, similarity to the question and the gold passage's place (null without one)."""
    return documents.groupBy(setting).agg(F.count("*").alias("documents"), F.avg("n_tokens").alias("tokens"), F.avg("n_passages").alias("passages"), F.avg("similarity").alias("similarity"), F.avg("gold_position").alias("gold_position"))


def experiment_models(experiments: DataFrame, open_models: list[str]) -> DataFrame:
    """(name, model) for each model of each experiment(name, models); the list ["all_open"] stands for all open models, null and empty lists for none."""
    models = F.when(F.array_contains("models", "all_open"), F.array(*map(F.lit, open_models)).cast("array<string>")).otherwise(F.col("models"))
    return experiments.select("name", F.explode(models).alias("model"))


def joined_answers(answers: DataFrame) -> DataFrame:
    """qid, model, doc_id and the true answers as one text, for the annotators' sheets."""
    return answers.select("qid", "model", "doc_id", F.array_join(F.coalesce("true_answers", F.array().cast("array<string>")), " | ").alias("true_answers"))


def _rates(rows: DataFrame, keys: list[str], flag: Column, name: str) -> DataFrame:
    got = rows.groupBy(*keys).agg(F.count_if(flag).alias("k"), F.count("*").alias("n"))
    w = wilson(F.col("k"), F.col("n"))
    return got.select(F.lit(name).alias("part"), *keys, "k", "n", (100 * w["p"]).alias("rate"), (100 * w["lo"]).alias("lo"), (100 * w["hi"]).alias("hi"))


def main_report(scored: DataFrame) -> dict[str, DataFrame]:
    """The tables of the main report, from scored(exp, model, prompt, run, level, ladder, filler, copies, length, answerable, label): made-up rates of open questions by look-alike level, run, length, filler, copies and prompt, accuracy of the others by length, and where they first differ from the shortest length.

    All tables are lazy; each reads the rows once.
    """
    normal = scored.where("prompt = 'normal'")
    open_, answered = normal.where("not answerable"), normal.where("answerable")
    made, right = F.col("label") == "made_up", F.col("label") == "correct"
    first = "run = 't0_s0'"
    by_length = _rates(open_.where("level = 'none'").where(first), ["model", "length"], made, "length")
    accuracy = _rates(answered.where(first), ["model", "length"], right, "accuracy")

    def breaks(cells: DataFrame, worse: Column) -> DataFrame:
        least = cells.groupBy("model").agg(F.min("length").alias("short"))
        base = cells.join(least, "model").where("length = short").select("model", "short", F.col("lo").alias("lo0"), F.col("hi").alias("hi0"), F.col("rate").alias("rate0"))
        return cells.join(base, "model").groupBy("model").agg(F.min(F.when((F.col("length") > F.col("short")) & worse, F.col("length"))).alias("breaks_at"))

    return {
        "ladder": _rates(open_.where(first), ["model", "ladder", "level"], made, "ladder"),
        "stability": _rates(open_, ["model", "level", "run"], made, "stability").groupBy("model", "level").agg(F.count("*").alias("runs"), F.min("rate").alias("lowest"), F.max("rate").alias("highest"), F.stddev_samp("rate").alias("spread")),
        "length": by_length,
        "filler": _rates(open_.where(first), ["model", "filler", "level"], made, "filler"),
        "copies": _rates(open_.where(first).where("level = 'strong'"), ["model", "copies"], made, "copies"),
        "prompts": _rates(scored.where("not answerable").where(first), ["model", "prompt"], made, "prompts"),
        "accuracy": accuracy,
        "breaking": breaks(by_length, F.col("lo") > F.col("hi0")),
        "accuracy_drop": breaks(accuracy, (F.col("hi") < F.col("lo0")) & (F.col("rate0") - F.col("rate") >= 10)),
    }


def summary_lines(tables: dict[str, DataFrame], digits: int = 1) -> list[str]:
    """One page of Markdown: a table for each part, numbers to so many digits, blanks for what is missing. The tables are reports, of a row for a model and condition."""
    out = ["# Results"]
    for name, df in tables.items():
        columns = [c for c in df.columns if c != "part"]
        out += ["", f"## {name}", "", "| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
        for row in sorted(df.select(*columns).collect(), key=lambda r: [(False, v) if v is not None else (True,) for v in r]):  # a row for a model and condition
            out.append("| " + " | ".join("" if v is None or v != v else f"{v:.{digits}f}" if isinstance(v, float) else str(v) for v in row) + " |")
    return out


def effects_report(rows: DataFrame, model: str, y: str, strong: str, doublings: str) -> DataFrame:
    """By model: the effects of a strong look-alike and of a doubling of length on the log odds of y, each with its standard error, and pooled over the models by random effects ('all')."""
    from evalloom.operators.statistics import random_effects

    spark, found = rows.sparkSession, []
    for m in sorted(r[0] for r in rows.select(model).distinct().collect()):  # models are few
        fit = logit(rows.where(F.col(model) == m), y, [strong, doublings])
        found += [(m, term, *fit[term]) for term in (strong, doublings)]
    each = spark.createDataFrame(found, f"{model} string, term string, estimate double, se double")
    pooled = random_effects(each, ["term"]).select(F.lit("all").alias(model), "term", F.col("mean").alias("estimate"), "se")
    return each.unionByName(pooled)
