"""Published small numbers, and plain recomputation."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalloom.functions import stats as C
from evalloom.functions import text as T
from evalloom.functions.folding import folded, folded_words, trimmed
from evalloom.operators import statistics as S
from evalloom.operators import reports, studies
from evalloom.operators.link import asked_field, closest_years, has_field, parse_question, text_names
from evalloom.operators.ordered import even_positions, numbered
from evalloom.operators.retrieve import qualified
from evalloom.operators.verify import without_gold


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_exact_tests(spark):
    got = one(spark, C.mcnemar_exact(F.lit(34), F.lit(14)), C.mcnemar_exact(F.lit(0), F.lit(0)), C.fisher_exact(F.lit(8), F.lit(10), F.lit(1), F.lit(10)), C.fisher_exact(F.lit(0), F.lit(0), F.lit(1), F.lit(2)))
    assert got[0] == pytest.approx(0.0055152, abs=1e-7) and got[1] == 1.0
    p = lambda x: math.comb(10, x) * math.comb(10, 9 - x) / math.comb(20, 9)
    assert got[2] == pytest.approx(sum(p(x) for x in range(10) if p(x) <= p(8) * (1 + 1e-9))) and got[3] is None


def test_wilson_and_quantiles(spark):
    w = C.wilson(F.lit(156), F.lit(240))
    got = one(spark, w["p"], w["lo"], w["hi"], C.wilson(F.lit(0), F.lit(0))["p"], C.normal_quantile(F.lit(0.975)), C.normal_quantile(F.lit(0.0)), C.log_factorial(F.lit(0)), C.log_factorial(F.lit(170)))
    assert [round(100 * x, 1) for x in got[:3]] == [65.0, 58.8, 70.8] and got[3] is None
    assert got[4] == pytest.approx(1.959964, abs=1e-5) and got[5] == pytest.approx(-2.575829, abs=1e-5)
    assert got[6] == pytest.approx(0, abs=1e-12) and got[7] == pytest.approx(math.lgamma(171), rel=1e-13)


def test_holm(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.5)], "n string, p double")
    got = {r.n: r.p_holm for r in S.holm(df, [], "p", ["n"]).collect()}
    assert got == pytest.approx({"a": 0.04, "c": 0.09, "b": 0.09, "d": 0.5})


def test_kappa(spark):
    rows = [("R", "R")] * 40 + [("R", "W")] * 5 + [("W", "W")] * 30 + [("W", "R")] * 5 + [(None, "R")]
    got = S.kappa(spark.createDataFrame(rows, "a string, b string"), [], "a", "b").first()
    agree, chance = 70 / 80, (45 * 45 + 35 * 35) / 6400
    assert got.n == 80 and got.kappa == pytest.approx((agree - chance) / (1 - chance))


def test_random_effects(spark):
    est, se = np.array([1.2, 0.4, 2.5, 1.9]), np.array([0.3, 0.4, 0.5, 0.2])
    w = 1 / se**2
    q = (w * (est - (w * est).sum() / w.sum()) ** 2).sum()
    tau2 = max(0, (q - 3) / (w.sum() - (w**2).sum() / w.sum()))
    wr = 1 / (se**2 + tau2)
    got = S.random_effects(spark.createDataFrame(list(zip(est.tolist(), se.tolist(), strict=True)), "estimate double, se double"), []).first()
    assert got.mean == pytest.approx((wr * est).sum() / wr.sum()) and got.tau2 == pytest.approx(tau2) and got.se == pytest.approx(wr.sum() ** -0.5)


def test_regressions(spark):
    rng = np.random.default_rng(3)
    x, g = rng.integers(0, 2, 3000), rng.integers(0, 40, 3000)
    y = (rng.random(3000) < 1 / (1 + np.exp(-(-0.5 + 1.2 * x)))).astype(int)
    df = spark.createDataFrame([(int(a), int(b), int(c)) for a, b, c in zip(x, y, g, strict=True)], "x int, y int, g int")
    p1, p0 = y[x == 1].mean(), y[x == 0].mean()
    fit = S.logit(df, "y", ["x"])
    assert fit["x"][0] == pytest.approx(math.log(p1 / (1 - p1)) - math.log(p0 / (1 - p0)), abs=1e-4)
    assert S.logit_clustered(df, "y", ["x"], ["g"], ridge=0.0)["x"][0] == pytest.approx(fit["x"][0], abs=1e-4)
    two = S.logit_clustered(df.withColumn("h", F.col("g") % 7), "y", ["x"], ["g", "h"])
    assert two["x"][1] > 0


def test_sandwich_errors(spark):
    """Against sums by cluster in plain numpy."""
    rng = np.random.default_rng(8)
    x, g = rng.integers(0, 4, 800), rng.integers(0, 25, 800)
    y = (rng.random(800) < 1 / (1 + np.exp(-(-1 + 0.4 * x)))).astype(int)
    df = spark.createDataFrame(list(zip(x.tolist(), y.tolist(), g.tolist(), strict=True)), "x int, y int, g int")
    got = S.logit_clustered(df, "y", ["x"], ["g"])
    b = np.array([got["intercept"][0], got["x"][0]])
    design = np.column_stack([np.ones(800), x])
    p = 1 / (1 + np.exp(-design @ b))
    pull = np.diag([0, 0.1])
    assert np.abs(design.T @ (y - p) - pull @ b).max() < 1e-5
    inverse = np.linalg.inv(design.T @ (design * (p * (1 - p))[:, None]) + pull)
    sums = np.array([((y - p)[:, None] * design)[g == k].sum(axis=0) for k in range(25)])
    want = np.sqrt(np.diag(inverse @ (sums.T @ sums) @ inverse * 25 / 24))
    assert [got["intercept"][1], got["x"][1]] == pytest.approx(want, rel=1e-6)


def test_permuted_places(spark):
    """Each draw is a permutation; over draws, subsets spread as drawn ones do."""
    n, m, perms = 37, 15, 2000
    keys = F.flatten(F.array(*[C.keyed_draws(0, F.col("perm"), F.lit(str(k))) for k in range(C.ROUNDS // 4)]))
    rows = spark.range(perms).select(F.col("id").alias("perm"), keys.alias("ks"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias("i"))
    got = rows.select("perm", "i", C.permuted_place(F.col("i"), F.lit(n).cast("bigint"), F.col("ks")).alias("to")).toPandas()
    table = got.pivot(index="perm", columns="i", values="to").to_numpy()
    assert (np.sort(table, axis=1) == np.arange(n)).all()
    assert (table[1:] == C.permuted_places(np.arange(n), n, C.permutation_keys(perms - 1))).all()  # the same in numpy
    taken = (table < m).astype(float)
    assert np.abs(taken.mean(axis=0) - m / n).max() < 0.05
    value = np.arange(n) ** 2.0
    means = taken @ value / m
    want = np.sqrt(value.var(ddof=1) / m * (1 - m / n))  # of a draw without replacement
    assert abs(means.mean() - value.mean()) < 4 * want / np.sqrt(perms) and abs(means.std() / want - 1) < 0.06


def test_exchange_rate(spark):
    rng = np.random.default_rng(5)
    n = 12_000
    doc, strong, length, model = rng.integers(0, 200, n), rng.integers(0, 2, n), rng.integers(0, 5, n), rng.integers(0, 2, n)
    y = (rng.random(n) < 1 / (1 + np.exp(-(-2 + 0.3 * length + 0.9 * strong)))).astype(int)
    df = spark.createDataFrame(list(zip(doc.tolist(), strong.tolist(), length.tolist(), model.tolist(), y.tolist(), strict=True)), "doc int, strong int, doublings int, model int, y int")
    got = studies.exchange_rate(df, "y", "strong", "doublings", ["model"], "model", "doc", draws=60)
    assert got["exchange"] == pytest.approx(3, abs=1) and got["lo"] < got["exchange"] < got["hi"]
    flat = studies.exchange_rate(df.withColumn("y", (F.col("doc") % 2)), "y", "strong", "doublings", ["model"], "model", "doc", draws=20)
    assert flat["exchange"] is None


def test_reports(spark):
    rows = []
    for m in ("m1", "m2"):
        for length in (8, 32):
            for level in ("none", "strong"):
                for run in ("t0_s0", "t1_s1"):
                    for k in range(40):
                        bad = k < (4 if level == "none" else 20) + (12 if length == 32 else 0)
                        rows += [("e", m, "normal", run, level, "name", "sibling", 1, length, False, "made_up" if bad else "refused"), ("e", m, "normal", run, level, "name", "sibling", 1, length, True, "correct" if not bad else "wrong")]
    scored = spark.createDataFrame(rows, "exp string, model string, prompt string, run string, level string, ladder string, filler string, copies int, length int, answerable boolean, label string")
    tables = studies.main_report(scored)
    assert {(r.model, r.length): (r.k, r.n, r.rate) for r in tables["length"].collect()} == {(m, x): ((4, 40, 10.0) if x == 8 else (16, 40, 40.0)) for m in ("m1", "m2") for x in (8, 32)}
    assert {r.model: r.breaks_at for r in tables["breaking"].collect()} == {"m1": 32, "m2": 32}
    assert {r.model: r.breaks_at for r in tables["accuracy_drop"].collect()} == {"m1": 32, "m2": 32}
    assert {r.runs for r in tables["stability"].collect()} == {2}
    lines = studies.summary_lines({"length": tables["length"]})
    assert lines[2] == "## length" and "| m1 | 8 | 4 | 40 | 10.0 |" in "".join(x[: len("| m1 | 8 | 4 | 40 | 10.0 |")] for x in lines[6:7])
    effects = studies.effects_report(scored.where("not answerable").select("model", (F.col("label") == "made_up").cast("int").alias("y"), (F.col("level") == "strong").cast("int").alias("strong"), F.log2(F.col("length") / 8).alias("doublings")), "model", "y", "strong", "doublings")
    assert effects.count() == 6 and {r.model for r in effects.collect()} == {"m1", "m2", "all"}
    models = studies.experiment_models(spark.createDataFrame([("a", ["all_open"]), ("b", ["x"]), ("c", [])], "name string, models array<string>"), ["p", "q"])
    assert sorted(map(tuple, models.collect())) == [("a", "p"), ("a", "q"), ("b", "x")]
    assert studies.joined_answers(spark.createDataFrame([("q", "m", "d", ["x", "y"]), ("r", "m", "d", None)], "qid string, model string, doc_id string, true_answers array<string>")).select("true_answers").collect() == [("x | y",), ("",)]


def test_prompts_and_mixes():
    from evalloom.operators import generate as G

    assert G.type_counts({"a": 0.5, "b": 0.33, "c": 0.17}, 10) == {"a": 5, "b": 3, "c": 2} and sum(G.type_counts(G.MIX["sibling"], 7).values()) == 7
    pool = G.filler_pool(G.World(3, []), "sibling", 50)
    companies = {r.fields["name"] for r in pool if r.type == "company"}
    assert len(pool) == 50 and {r.fields["tenant"] for r in pool if r.type == "lease"} <= companies
    assert len({G.prompt_version(s) for s in ("records", "wikipedia")}) == 2


def test_prompt_texts(spark):
    from evalloom.operators import generate as G

    got = one(spark, G.prompt(F.lit("DOC"), F.lit("Why?"), "strict")["prompt"], G.prompt(F.lit("DOC"), F.array(F.lit("A?"), F.lit("B?")), "batch12")["prompt"], G.prompt(F.lit("DOC"), F.lit("Why?"), "normal", "wikipedia")["prompt"])
    assert all(t.index("DOC") < t.index("?") for t in got) and G.NOT_THERE in got[0] and "1. A?\n2. B?" in got[1] and "passages" in got[2]
    with pytest.raises(ValueError):
        G.prompt(F.lit(""), F.lit(""), "batch12", "wikipedia")


def test_bootstraps_agree(spark):
    rows = spark.range(4000).select((F.col("id") % 80).alias("c"), ((F.col("id") * 7919) % 10 < 4).alias("f"), F.lit("g").alias("grp"))
    got = S.bootstrap_rate(rows, ["grp"], "c", "f", 400).first()
    assert got.boot_lo <= got.rate <= got.boot_hi and got.clusters == 80
    drawn = S.poisson_draws(S.cluster_counts(rows, ["grp"], "c", "f"), ["grp"], "c", 400)
    assert drawn.count() == 400 and drawn.agg(F.avg(F.col("k") / F.col("n"))).first()[0] == pytest.approx(got.rate, abs=0.01)


def test_numbering_and_positions(spark):
    df = spark.createDataFrame([(f"n{i % 97:02d}", i) for i in range(500)], "s string, i int").repartition(7)
    for order in (["s", "i"], ["i"]):
        got = [r.number for r in numbered(df, order).orderBy(*order).collect()]
        assert got == list(range(500))
    assert one(spark, even_positions(F.lit(1)), even_positions(F.lit(3)))[:2] == ([0.5], pytest.approx([0.35, 0.5, 0.65]))


def test_questions(spark):
    rows = [
        ("lease_document", "What is the rent in Ann Lee's lease with Bo Ray starting 2020-01-02?", {"lessee": "Ann Lee", "lessor": "Bo Ray", "date": "2020-01-02"}, "monthly_rent"),
        ("hr", "What rating is in Cy Dean's evaluation for March 2021?", {"employee": "Cy Dean", "period": "March 2021"}, "performance_rating"),
        ("field_report", "no key", None, None),
    ]
    df = spark.createDataFrame([(i, *r[:2]) for i, r in enumerate(rows)], "i int, t string, q string")
    got = df.select("i", parse_question("q", "t").alias("k"), asked_field("q", "t")["column"].alias("c")).orderBy("i").collect()
    assert [(r.k, r.c) for r in got] == [(r[2], r[3]) for r in rows]
    record = F.create_map(F.lit("has_pet_clause"), F.lit("1"), F.lit("pet_deposit"), F.lit(" "))
    assert one(spark, has_field(record, F.lit("pet_deposit"), F.lit("has_pet_clause")), has_field(record, F.lit(None).cast("string"), F.lit("has_pet_clause")))[:2] == (False, True)
    names = text_names(spark.createDataFrame([(1, "By Ann Lee and Bo Ray.")], "d int, t string"), "d", "t")
    assert {r.name for r in names.collect()} == {"By Ann", "Bo Ray"}
    years = closest_years(spark.createDataFrame([("a", 2015)], "k string, year int"), spark.createDataFrame([("a", 2015, "r0"), ("a", 2016, "r1"), ("a", 2010, "r2"), ("b", 2014, "r3")], "k string, year int, rid string"), ["k"], 1)
    assert [r.rid for r in years.collect()] == ["r1"]


def test_retrieval_items(spark):
    passage = lambda i, text, title="t": (str(i), title, text)
    similar = [passage(i, "nothing here", f"s{i}") for i in range(40)]
    rows = [("q1", ["The Eiffel Tower"], [passage(0, "It is the Eiffel Tower.")], similar), ("q2", ["7"], [passage(0, "7")], similar), ("q3", ["x y"], [passage(0, "x y")], similar[:5])]
    p = "array<struct<docid: string, title: string, text: string>>"
    df = spark.createDataFrame(rows, f"query_id string, answers array<string>, positives {p}, negatives {p}")
    assert [r.query_id for r in qualified(df).collect()] == ["q1"]
    passages = spark.createDataFrame([("d1", "s", "no answer"), ("d2", "s", "holds x y z"), ("d3", "s", "holds x y z")], "doc_id string, title string, text string")
    wanted = spark.createDataFrame([("d1", ["x y"], ["g"], False), ("d2", ["x y"], ["g"], False), ("d3", ["x y"], ["g"], True)], "doc_id string, answers array<string>, gold_titles array<string>, is_control boolean")
    assert [r.doc_id for r in without_gold(passages, wanted).collect()] == ["d2"]


def test_text_forms(spark):
    df = spark.createDataFrame([("The Café, of  Zürich!", 4)], "t string, n int").select(folded("t").alias("a"), folded_words("t").alias("b"), trimmed("t", "n").alias("c"), T.qa_normalized("t").alias("d"), T.one_edit_variants(F.lit("bab")).alias("e"), T.norm_text(F.lit(' "A  B". ')).alias("f"))
    got = df.first()
    assert (got.a, got.b, got.c, got.d, got.f) == ("cafe of zurich", "cafe zurich", "The Café,", "café of zürich", "a b")
    assert got.e == sorted({"beb", "bib", "bob", "bub", "bb", "babb"})


def _drawn_plainly(groups, columns, draws):
    import hashlib

    out = {}
    for key, rows in groups.items():
        rows = sorted(rows)
        for draw in range(draws):
            sums = [0] * columns
            for slot in range(len(rows)):
                digest = hashlib.md5(f"0|{draw // 4}|{slot}".encode()).hexdigest()
                picked = rows[int(digest[draw % 4 * 8 : draw % 4 * 8 + 8], 16) % len(rows)]
                sums = [s + v for s, v in zip(sums, picked[1:], strict=True)]
            out[key, draw + 1] = sums
    return out


def test_bootstrap_draws_are_not_rows(spark, monkeypatch):
    """Clusters dealt to several packs, tasks and slices give the plain draws, and no draw is joined as a row."""
    for name, value in (("FEW", 10), ("PACKED", 16), ("HELD", 40), ("SLOTS", 7)):
        monkeypatch.setattr(S, name, value, raising=False)
    groups = {g: [(u, (u * 7 + len(g)) % 300, u % 5 + 70_000 * (u == 3)) for u in range(n)] for g, n in (("a", 1), ("bb", 23), ("ccc", 50))}
    counts = spark.createDataFrame([(g, *r) for g, rows in groups.items() for r in rows], "g string, u long, k long, n long")
    drawn = S.bootstrap_draws(counts, ["g"], "u", 10)
    assert "Join" not in drawn._jdf.queryExecution().executedPlan().toString()
    assert {(r.g, r.draw): [r.k, r.n] for r in drawn.collect()} == _drawn_plainly(groups, 2, 10)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_detection_draws_are_not_rows(spark):
    rows = spark.range(40).selectExpr("id % 2 AS g", "id % 7 AS u", "id % 3 = 0 AS signal", "id % 5 = 0 AS hit", "id % 4 = 0 AS alarm")
    drawn = studies.detection_draws(rows, ["g"], "u", "signal", "hit", "alarm", 20)
    assert "posexplode" not in _plan(drawn) and drawn.count() == 2


def test_interaction_draws_are_not_rows(spark):
    rows = spark.range(80).selectExpr("id % 2 AS g", "id % 7 AS u", "id % 5 = 0 AS flag", "cast(floor(id / 2) % 2 AS int) AS a", "cast(floor(id / 4) % 2 AS int) AS b")
    drawn = reports.interaction(rows, ["g"], "u", "flag", "a", "b", 20)
    assert "posexplode" not in _plan(drawn) and drawn.count() == 2


def test_macro_draws_are_not_rows(spark):
    rows = spark.range(40).selectExpr("id % 2 AS g", "id % 7 AS u", "id % 5 = 0 AS flag")
    drawn = reports.macro_bootstrap(rows, ["g"], "u", "flag", 20)
    assert "posexplode" not in _plan(drawn) and drawn.count() == 2
