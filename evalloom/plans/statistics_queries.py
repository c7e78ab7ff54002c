"""Cluster statistics, exact tests, agreement, pooling and fits over the driver's tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from evalloom.functions.stats import MULTIPLIERS, ROUNDS, fisher_exact, mcnemar_exact, normal_quantile
from evalloom.operators import statistics as S
from evalloom.plans.registry import query, table
from evalloom.plans.report_queries import LABELLED, labelled, wilson_sql

DRAWS, PERMS = 2000, 5000


def four_sql(keys: str, number: str) -> str:
    """The number-th (from 0 on) of the draws of keys, four from one digest; {four} in keys is the digest's number."""
    return f"CAST(('0x' || substr(md5({keys.format(four=f'({number}) // 4')}), CAST(({number}) % 4 AS BIGINT) * 8 + 1, 8)) AS BIGINT)"


DRAW = four_sql("concat('0|', {four}, '|', i)", "draw - 1")


def place_sql(rows: str) -> str:
    """rows(i, clusters, perm, ...) with i moved by the permutation's keys."""
    for r in range(ROUNDS):
        key = f"CAST(('0x' || substr(md5(concat('0|', perm, '|{r // 4}')), {8 * (r % 4) + 1}, 8)) AS BIGINT)"
        mirror = "((key - i) % clusters + clusters) % clusters"
        mixed = f"((xor(greatest(i, j), key) & 2147483647) * {MULTIPLIERS[0]})"
        mixed = f"((({mixed} >> 16) & 2147483647) * {MULTIPLIERS[1]})"
        rows = f"SELECT * EXCLUDE (key, j) REPLACE (CASE WHEN ({mixed} >> 29) & 1 = 1 THEN j ELSE i END AS i) FROM (SELECT *, {mirror} AS j FROM (SELECT r{r}.*, key FROM ({rows}) r{r} JOIN (SELECT perm, {key} AS key FROM unnest(range(1, {PERMS + 1})) AS t(perm)) USING (perm)))"
    return rows


def _counts(rows: str, keys: str, flag: str) -> str:
    return f"SELECT {keys}, user_id, count(*) FILTER ({flag}) AS k, count({flag}) AS n FROM {rows} GROUP BY {keys}, user_id"


def quantile_sql(p: str) -> str:
    from evalloom.functions.stats import ACKLAM_A, ACKLAM_B, ACKLAM_C, ACKLAM_D

    def poly(c, x):
        out = f"{c[0]!r}::DOUBLE"
        for v in c[1:]:
            out = f"({out} * {x} + {v!r}::DOUBLE)"
        return out

    p = f"CASE WHEN {p} IS NOT NULL THEN least(greatest({p}, 0.005::DOUBLE), 0.995::DOUBLE) END"
    tail = lambda t: f"{poly(ACKLAM_C, f'sqrt(-2 * ln({t}))')} / {poly([*ACKLAM_D, 1.0], f'sqrt(-2 * ln({t}))')}"
    p = f"({p})"
    q = f"({p} - 0.5::DOUBLE)"
    return f"CASE WHEN {p} IS NULL THEN NULL WHEN {p} < 0.02425 THEN {tail(p)} WHEN {p} > 0.97575 THEN -({tail(f'(1 - {p})')}) ELSE {poly(ACKLAM_A, f'({q} * {q})')} * {q} / {poly([*ACKLAM_B, 1.0], f'({q} * {q})')} END"


@query(f"""WITH c AS ({_counts('events', 'event_type', 'value > 50')}), i AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY user_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS m FROM c),
d AS (SELECT event_type, draw, {DRAW} % m AS i FROM i, unnest(range(1, {DRAWS + 1})) AS t(draw)),
r AS (SELECT event_type, draw, sum(k) / sum(n) AS rate FROM d JOIN i USING (event_type, i) GROUP BY 1, 2),
e AS (SELECT event_type, quantile_cont(rate, 0.025) AS boot_lo, quantile_cont(rate, 0.975) AS boot_hi FROM r GROUP BY 1),
t AS (SELECT event_type, CAST(sum(k) AS BIGINT) AS k, CAST(sum(n) AS BIGINT) AS n, count(*) AS clusters FROM c GROUP BY 1)
SELECT event_type, k, n, clusters, rate, lo AS wilson_lo, hi AS wilson_hi, boot_lo, boot_hi FROM (SELECT *, {wilson_sql('k', 'n')} FROM t) JOIN e USING (event_type)""")
def cluster_bootstrap_ci(spark, sf_dir):
    return S.bootstrap_rate(table(spark, sf_dir, "events").withColumn("flag", F.col("value") > 50), ["event_type"], "user_id", "flag", DRAWS)


@query(f"""WITH c AS (SELECT event_type, user_id % 2 = 0 AS arm, user_id, count(*) FILTER (value > 50) AS k, count(value) AS n FROM events GROUP BY ALL),
i AS MATERIALIZED (SELECT event_type, k, n, arm, row_number() OVER (PARTITION BY event_type ORDER BY user_id, arm) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS clusters, count(*) FILTER (arm) OVER (PARTITION BY event_type) AS m FROM c),
s AS (SELECT event_type, sum(k) FILTER (arm) / sum(n) FILTER (arm) - sum(k) FILTER (NOT arm) / sum(n) FILTER (NOT arm) AS diff, count(*) AS clusters, sum(k) AS k, sum(n) AS n FROM i GROUP BY 1),
p AS ({place_sql(f"SELECT event_type, k, n, m, clusters, i, perm FROM i, unnest(range(1, {PERMS + 1})) AS t(perm)")}),
d AS (SELECT event_type, perm, sum(k) AS pk, sum(n) AS pn FROM p WHERE i < m GROUP BY 1, 2)
SELECT event_type, s.clusters, s.diff AS diff, (count(*) FILTER (abs(pk / pn - (s.k - pk) / (s.n - pn)) >= abs(diff) - 1e-12) + 1) / {PERMS + 1} AS p FROM s JOIN d USING (event_type) GROUP BY ALL""")
def permutation_test(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumns({"flag": F.col("value") > 50, "arm": F.col("user_id") % 2 == 0})
    return S.permutation_test(rows, ["event_type"], "user_id", "flag", "arm", PERMS)


@query(f"""WITH m AS ({LABELLED}), c AS (SELECT source, count(*) FILTER (flag) AS ka, count(*) FILTER (NOT good) AS kb, count(*) AS n FROM m GROUP BY 1),
i AS (SELECT *, row_number() OVER (ORDER BY source) - 1 AS i, count(*) OVER () AS m FROM c), d AS (SELECT draw, {DRAW} % m AS i FROM i, unnest(range(1, {DRAWS + 1})) AS t(draw)),
r AS (SELECT draw, (sum(ka) - sum(kb)) / sum(n) AS x FROM d JOIN i USING (i) GROUP BY 1), t AS (SELECT count(*) AS n, count(DISTINCT source) AS clusters, count(*) FILTER (flag) AS ka, count(*) FILTER (NOT good) AS kb, count(*) FILTER (flag AND good) AS a_only, count(*) FILTER (NOT flag AND NOT good) AS b_only FROM m)
SELECT n, clusters, ka / n AS rate_a, kb / n AS rate_b, (ka - kb) / n AS diff, (SELECT quantile_cont(x, 0.025) FROM r) AS diff_lo, (SELECT quantile_cont(x, 0.975) FROM r) AS diff_hi, a_only, b_only,
least(1::DOUBLE, 2 * (SELECT sum(exp(lgamma(a_only + b_only + 1) - lgamma(i + 1) - lgamma(a_only + b_only - i + 1) - (a_only + b_only) * ln(2::DOUBLE))) FROM unnest(range(0, least(a_only, b_only) + 1)) AS u(i))) AS p FROM t""")
def paired_mcnemar(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    return S.paired_difference(rows.select("doc_id", "source", "flag"), rows.select("doc_id", (~F.col("good")).alias("flag")), "doc_id", "source", "flag", DRAWS)


PAIRS = f"SELECT lang, count(*) FILTER (good AND flag) AS k1, count(*) FILTER (flag) AS n1, count(*) FILTER (good AND NOT flag) AS k2, count(*) FILTER (NOT flag) AS n2 FROM ({LABELLED}) GROUP BY lang"
LF = "lgamma({x} + 1)"
FISHER = f"""WITH a AS ({PAIRS}), x AS (SELECT lang, k1, n1, k2, n2, x, lgamma(n1 + 1) + lgamma(n2 + 1) + lgamma(k1 + k2 + 1) + lgamma(n1 + n2 - k1 - k2 + 1) - lgamma(n1 + n2 + 1) - lgamma(x + 1) - lgamma(n1 - x + 1) - lgamma(k1 + k2 - x + 1) - lgamma(n2 - k1 - k2 + x + 1) AS lp
FROM a, unnest(range(greatest(0, k1 + k2 - n2), least(k1 + k2, n1) + 1)) AS t(x) WHERE n1 > 0 AND n2 > 0), f AS (SELECT lang, k1, n1, k2, n2, least(1::DOUBLE, sum(exp(lp)) FILTER (lp <= seen + 1e-9)) AS p FROM (SELECT *, max(CASE WHEN x = k1 THEN lp END) OVER (PARTITION BY lang) AS seen FROM x) GROUP BY ALL)"""


def _fisher(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    got = rows.groupBy("lang").agg(F.count_if(F.col("good") & F.col("flag")).alias("k1"), F.count_if("flag").alias("n1"), F.count_if(F.col("good") & ~F.col("flag")).alias("k2"), F.count_if(~F.col("flag")).alias("n2"))
    return got.withColumn("p", fisher_exact(F.col("k1"), F.col("n1"), F.col("k2"), F.col("n2"))).where("p is not null")


@query(f"{FISHER} SELECT * FROM f")
def fisher_test(spark, sf_dir):
    return _fisher(spark, sf_dir)


@query(f"{FISHER}, r AS (SELECT lang, p, row_number() OVER (ORDER BY p, lang) - 1 AS r, count(*) OVER () AS m FROM f) SELECT lang, p, max(least(1::DOUBLE, (m - r) * p)) OVER (ORDER BY r) AS p_holm FROM r")
def holm_adjusted(spark, sf_dir):
    return S.holm(_fisher(spark, sf_dir).select("lang", "p"), [], "p", ["lang"])


@query("SELECT o_orderkey, least(1::DOUBLE, 2 * (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2::DOUBLE))) FROM unnest(range(0, least(a, n - a) + 1)) AS u(i))) AS p FROM (SELECT o_orderkey, o_custkey % 20 AS a, o_custkey % 20 + o_orderkey % 30 + 1 AS n FROM orders)")
def mcnemar_grid(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", mcnemar_exact(F.col("o_custkey") % 20, F.col("o_orderkey") % 30 + 1).alias("p"))


@query(f"WITH m AS ({LABELLED}), t AS (SELECT lang, count(*) AS n, avg(CASE WHEN flag = NOT good THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS agree, avg(flag::INT) AS a, avg((NOT good)::INT) AS b FROM m GROUP BY 1) SELECT lang, n, agree, CASE WHEN a * b + (1 - a) * (1 - b) < 1 THEN (agree - (a * b + (1 - a) * (1 - b))) / (1 - (a * b + (1 - a) * (1 - b))) ELSE 1.0::DOUBLE END AS kappa FROM t")
def kappa_by_lang(spark, sf_dir):
    return S.kappa(labelled(spark, sf_dir).withColumn("bad", ~F.col("good")), ["lang"], "flag", "bad")


@query(f"WITH m AS ({LABELLED}), t AS (SELECT lang, avg(good::INT) FILTER (flag) AS hit_rate, avg(good::INT) FILTER (NOT flag) AS alarm_rate FROM m GROUP BY 1) SELECT lang, hit_rate, alarm_rate, h - f AS d_prime, -(h + f) / 2 AS criterion FROM (SELECT *, {quantile_sql('hit_rate')} AS h, {quantile_sql('alarm_rate')} AS f FROM t)")
def signal_detection(spark, sf_dir):
    return S.signal_detection(labelled(spark, sf_dir), ["lang"], "flag", "good", "good")


@query(f"SELECT c_custkey, {quantile_sql('((c_custkey % 997 + 1) / 1000.0::DOUBLE)')} AS z FROM customer")
def normal_quantiles(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", normal_quantile((F.col("c_custkey") % 997 + 1) / 1000.0).alias("z"))


EFFECTS = "SELECT event_type, user_id % 12 AS unit, avg(value) AS estimate, stddev_samp(value) / sqrt(count(*)) AS se FROM events GROUP BY 1, 2"


@query(f"""WITH e AS ({EFFECTS}), s AS (SELECT event_type, count(*) AS k, sum(1 / (se * se)) AS w, sum(1 / (se * se * se * se)) AS w2, sum(estimate / (se * se)) AS wy FROM e GROUP BY 1),
q AS (SELECT event_type, sum((estimate - wy / w) * (estimate - wy / w) / (se * se)) AS q FROM e JOIN s USING (event_type) GROUP BY 1), t AS (SELECT event_type, k, q, greatest(0::DOUBLE, (q - (k - 1)) / (w - w2 / w)) AS tau2 FROM s JOIN q USING (event_type)),
p AS (SELECT event_type, any_value(k) AS k, sum(estimate / (se * se + tau2)) / sum(1 / (se * se + tau2)) AS mean, sqrt(1 / sum(1 / (se * se + tau2))) AS sem, any_value(tau2) AS tau2, any_value(q) AS q FROM e JOIN t USING (event_type) GROUP BY 1)
SELECT event_type, k, round(mean, 6) AS mean, round(sem, 6) AS se, round(tau2, 5) AS tau2, round(q, 5) AS q, round(mean - 1.96 * sqrt(sem * sem + tau2), 5) AS predict_lo, round(mean + 1.96 * sqrt(sem * sem + tau2), 5) AS predict_hi FROM p""")
def random_effects(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 12).alias("unit")).agg(F.avg("value").alias("estimate"), (F.stddev_samp("value") / F.sqrt(F.count("*"))).alias("se"))
    got = S.random_effects(e, ["event_type"])
    return got.select("event_type", "k", *[F.round(c, 6).alias(c) for c in ("mean", "se")], *[F.round(c, 5).alias(c) for c in ("tau2", "q", "predict_lo", "predict_hi")])


#: q = 0 and evenly spaced logarithms from 1e-7 to 0.1; s from 0.001 on in steps of 0.01.
GRID_Q, GRID_S = 3001, 100
_Q = f"CASE WHEN i = 0 THEN 0 ELSE pow(10::DOUBLE, -7 + 6 * (i - 1) / {GRID_Q - 2}::DOUBLE) END"


@query(f"""WITH c AS (SELECT event_type, CASE user_id % 3 WHEN 0 THEN 8 WHEN 1 THEN 32 ELSE 128 END AS length, user_id % 2 = 0 AS strong, count(*) FILTER (value > 80) AS k, count(*) AS n FROM events GROUP BY ALL),
g AS (SELECT {_Q} AS q, 0.001::DOUBLE + j / 100.0::DOUBLE AS s FROM unnest(range(0, {GRID_Q})) a(i), unnest(range(0, {GRID_S})) b(j)),
f AS (SELECT event_type, q, s, k, n, least(greatest(CASE WHEN strong THEN 1 - (1 - s) * pow(1 - q, length) ELSE 1 - pow(1 - q, length) END, 1e-9::DOUBLE), 1 - 1e-9::DOUBLE) AS f FROM c, g),
l AS (SELECT event_type, q, s, sum(k * ln(f) + (n - k) * ln(1 - f)) AS ll FROM f GROUP BY ALL)
SELECT event_type, round(arg_max(q, ll), 9) AS q, round(arg_max(s, ll), 9) AS s, round(max(ll), 4) AS ll FROM l GROUP BY 1""")
def hazard_grid_mle(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumns({"length": F.when(F.col("user_id") % 3 == 0, 8).when(F.col("user_id") % 3 == 1, 32).otherwise(128), "strong": F.col("user_id") % 2 == 0})
    counts = e.groupBy("event_type", "length", "strong").agg(F.count_if(F.col("value") > 80).alias("k"), F.count("*").alias("n"))
    q = spark.range(GRID_Q).select(F.when(F.col("id") == 0, 0.0).otherwise(F.pow(F.lit(10.0), F.lit(-7.0) + 6 * (F.col("id") - 1) / (GRID_Q - 2))).alias("q"))
    s = spark.range(GRID_S).select((F.lit(0.001) + F.col("id") / 100.0).alias("s"))
    got = S.hazard_grid(counts, ["event_type"], q, s)
    return got.select("event_type", F.round("q", 9).alias("q"), F.round("s", 9).alias("s"), F.round("ll", 4).alias("ll"))


@query("""WITH p AS (SELECT o_orderkey % 64 + 1 AS x, avg(o_totalprice) * (o_orderkey % 64 + 1) / 1000 AS t FROM orders GROUP BY 1, o_orderkey % 64), s AS (SELECT sum(x * x) AS s2, sum(x * x * x) AS s3, sum(x * x * x * x) AS s4, sum(x * t) AS st, sum(x * x * t) AS st2 FROM p),
c AS (SELECT *, (s2 * st2 - s3 * st) / (s2 * s4 - s3 * s3) AS c0 FROM s) SELECT round(CASE WHEN c0 > 0 THEN (s4 * st - s3 * st2) / (s2 * s4 - s3 * s3) ELSE st / s2 END, 5) AS b, round(greatest(0::DOUBLE, c0), 6) AS c FROM c""")
def time_model(spark, sf_dir):
    p = table(spark, sf_dir, "orders").groupBy((F.col("o_orderkey") % 64 + 1).alias("x")).agg(F.avg("o_totalprice").alias("a")).select(F.col("x").cast("double").alias("x"), (F.col("a") * F.col("x") / 1000).alias("t"))
    return S.time_model(p, "x", "t").select(F.round("b", 5).alias("b"), F.round("c", 6).alias("c"))


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumns({"y": (F.col("value") > 50).cast("int"), "strong": (F.col("user_id") % 2).cast("int"), "doublings": (F.col("user_id") % 5).cast("int")})


_XS = ["1.0::DOUBLE", "strong::DOUBLE", "doublings::DOUBLE"]
_P = "1 / (1 + exp(-(b0 + b1 * strong + b2 * doublings)))"


def _solved(h: str, g: list[str]) -> list[str]:
    """The solution of a symmetric 3 x 3 system with entries h00 to h22, by cofactors."""
    c = {(i, j): f"({h}{min(i1, j1)}{max(i1, j1)} * {h}{min(i2, j2)}{max(i2, j2)} - {h}{min(i1, j2)}{max(i1, j2)} * {h}{min(i2, j1)}{max(i2, j1)})" for i in range(3) for j in range(3) for i1, i2 in [((i + 1) % 3, (i + 2) % 3)] for j1, j2 in [((j + 1) % 3, (j + 2) % 3)]}
    det = f"({h}00 * {c[0, 0]} + {h}01 * {c[0, 1]} + {h}02 * {c[0, 2]})"
    return [f"({' + '.join(f'{c[i, j]} * {g[j]}' for j in range(3))}) / {det}" for i in range(3)]


def newton_sql(cells: str, name: str, steady: float, prior: float, rounds: int = 9) -> str:
    """Tables of a logistic fit of cells(g, strong, doublings, y, w), by g: {name}_b with b0 to b2, {name}_h with the information there."""

    def moments(at: str) -> str:
        hessian = ", ".join(f"sum(w * p * (1 - p) * {_XS[i]} * {_XS[j]}){f' + {steady if i or not prior else 0.0}' if i == j else ''} AS h{i}{j}" for i in range(3) for j in range(i, 3))
        score = ", ".join(f"sum(w * (y - p) * {_XS[i]}) - {prior if i else 0.0} * any_value(b{i}) AS g{i}" for i in range(3))
        return f"SELECT g, any_value(b0) AS b0, any_value(b1) AS b1, any_value(b2) AS b2, {hessian}, {score} FROM (SELECT *, {_P} AS p FROM {cells} JOIN {at} USING (g)) GROUP BY g"

    out = [f"{name}_b0 AS (SELECT DISTINCT g, 0::DOUBLE AS b0, 0::DOUBLE AS b1, 0::DOUBLE AS b2 FROM {cells})"]
    for k in range(rounds):
        step = _solved("h", ["g0", "g1", "g2"])
        out.append(f"{name}_m{k} AS MATERIALIZED ({moments(f'{name}_b{k}')}), {name}_b{k + 1} AS MATERIALIZED (SELECT g, {', '.join(f'b{i} + {step[i]} AS b{i}' for i in range(3))} FROM {name}_m{k})")
    return ", ".join([*out, f"{name}_b AS (SELECT * FROM {name}_b{rounds})", f"{name}_h AS MATERIALIZED ({moments(f'{name}_b{rounds}')})"])


_EVENTS = "SELECT *, (value > 50)::INT AS y, user_id % 2 AS strong, user_id % 5 AS doublings FROM events"
_WAYS = {"one": [(1, "user_id")], "two": [(1, "user_id"), (1, "event_type"), (-1, "user_id, event_type")]}


def _meat_sql(way: str) -> str:
    sums = ", ".join(f"sum((y - p) * {_XS[i]}) AS s{i}" for i in range(3))
    return f"SELECT {', '.join(f'sum(s{i} * s{j}) * count(*) / (count(*) - 1) AS m{i}{j}' for i in range(3) for j in range(3))} FROM (SELECT {sums} FROM (SELECT *, {_P} AS p FROM e, pen_b) GROUP BY {way})"


def _sandwich(ways: list[tuple[int, str]], model: str) -> str:
    """Errors: for each term, the row of the inverted information around the clusters' outer products."""
    meat = ", ".join(f"({_meat_sql(way)}) AS w{k}" for k, (_, way) in enumerate(ways))
    total = {(i, j): "(" + " + ".join(f"{sign} * w{k}.m{i}{j}" for k, (sign, _) in enumerate(ways)) + ")" for i in range(3) for j in range(3)}
    rows = []
    for t, term in enumerate(("intercept", "strong", "doublings")):
        v = _solved("h", ["1.0" if i == t else "0.0" for i in range(3)])
        rows.append(f"SELECT '{model}' AS model, '{term}' AS term, b{t} AS estimate, sqrt(greatest(0, {' + '.join(f'({v[i]}) * ({v[j]}) * {total[i, j]}' for i in range(3) for j in range(3))})) AS se FROM pen_h, {meat}")
    return " UNION ALL ".join(rows)


_PLAIN = " UNION ALL ".join(f"SELECT 'plain' AS model, '{term}' AS term, b{t} AS estimate, sqrt({_solved('h', ['1.0' if i == t else '0.0' for i in range(3)])[t]}) AS se FROM ml_h" for t, term in enumerate(("intercept", "strong", "doublings")))


@query(f"""WITH e AS ({_EVENTS}), c AS (SELECT 1 AS g, strong, doublings, y, count(*) AS w FROM e WHERE y IS NOT NULL GROUP BY ALL), {newton_sql('c', 'ml', 1e-6, 0.0)}, {newton_sql('c', 'pen', 0.1, 0.1)}
SELECT model, term, round(estimate, 6) AS estimate, round(se, 6) AS se FROM ({_PLAIN} UNION ALL {_sandwich(_WAYS['one'], 'clustered')} UNION ALL {_sandwich(_WAYS['two'], 'two_way')})""")
def logit_effects(spark, sf_dir):
    """Coefficients and errors by maximum likelihood, and with penalty and errors clustered by user and event type."""
    rows = _events(spark, sf_dir)
    plain, one, two = S.logit(rows, "y", ["strong", "doublings"]), S.logit_clustered(rows, "y", ["strong", "doublings"], ["user_id"]), S.logit_clustered(rows, "y", ["strong", "doublings"], ["user_id", "event_type"])
    found = [(name, term, round(b, 6), round(se, 6)) for name, fit in (("plain", plain), ("clustered", one), ("two_way", two)) for term, (b, se) in fit.items()]
    return spark.createDataFrame(found, "model string, term string, estimate double, se double")


@query(f"""WITH e AS ({_EVENTS}), t AS (SELECT DISTINCT event_type AS g FROM e), c AS (SELECT g, strong, doublings, y, count(*) AS w FROM e JOIN t ON event_type <> g WHERE y IS NOT NULL GROUP BY ALL), {newton_sql('c', 'ml', 1e-6, 0.0)}
SELECT g AS without, round(b1, 6) AS strong FROM ml_b""")
def leave_one_out(spark, sf_dir):
    rows = _events(spark, sf_dir)
    found = S.leave_one_out(rows, "event_type", lambda d: round(S.logit(d, "y", ["strong", "doublings"])["strong"][0], 6))
    return spark.createDataFrame(list(found.items()), "without string, strong double")


_THRESHOLDS = [int(sum(math.exp(-1) / math.factorial(k) for k in range(i)) * 4294967296) for i in range(1, 9)]
_WEIGHT = " + ".join(f"(v >= {t})::INT" for t in _THRESHOLDS)


@query(f"""WITH c AS ({_counts('events', 'event_type', 'value > 50')}), d AS (SELECT event_type, k, n, draw, {four_sql("concat('0|', {four}, '|', user_id)", 'draw - 1')} AS v FROM c, unnest(range(1, {DRAWS + 1})) AS t(draw)),
r AS (SELECT event_type, draw, sum(({_WEIGHT}) * k) / sum(({_WEIGHT}) * n) AS rate FROM d GROUP BY 1, 2) SELECT event_type, quantile_cont(rate, 0.025) AS lo, quantile_cont(rate, 0.975) AS hi FROM r GROUP BY 1""")
def poisson_bootstrap(spark, sf_dir):
    counts = S.cluster_counts(_events(spark, sf_dir).withColumn("flag", F.col("y") == 1), ["event_type"], "user_id", "flag")
    ends = S.poisson_draws(counts, ["event_type"], "user_id", DRAWS).groupBy("event_type").agg(F.percentile(F.col("k") / F.col("n"), F.array(F.lit(0.025), F.lit(0.975))).alias("e"))
    return ends.select("event_type", F.col("e")[0].alias("lo"), F.col("e")[1].alias("hi"))
