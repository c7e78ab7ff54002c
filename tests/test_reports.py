from pyspark.sql import functions as F

from evalloom.operators import aggregate as A
from evalloom.operators import generate as G
from evalloom.operators import reports as R


def test_gold_passages_in_the_middle(spark):
    rows = spark.createDataFrame([("d", i, i in (0, 19)) for i in range(20)], "doc string, i int, gold boolean")
    got = {r.i: r.place for r in G.spread_gold(rows, ["doc"], ["i"], "gold").collect()}
    assert sorted(got.values()) == list(range(20)) and 6 <= got[0] <= 8 and 11 <= got[19] <= 13
    others = [got[i] for i in range(1, 19)]
    assert others == sorted(others)


def test_prompts(spark):
    got = spark.range(1).select(G.prompt(F.lit("doc"), F.lit("why?")).alias("a"), G.prompt(F.lit("x"), F.lit("y"), "strict").alias("b")).first()
    assert "doc" in got.a.prompt and got.a.prompt.endswith("Question: why?") and len(got.a.version) == 8 and got.a.version != got.b.version


def test_contrasts_and_verdicts(spark):
    cells = spark.createDataFrame([("m", 8, "none", 0.1), ("m", 8, "strong", 0.5), ("m", 128, "none", 0.3), ("m", 128, "strong", 0.9), ("m", 32, "strong", 0.6)], "model string, length int, level string, rate double")
    r = R.longest_contrasts(cells, ["model"], "length", "level", "rate").first()
    assert [round(x, 6) for x in (r.effect_short, r.effect_longest, r.length_effect, r.strong_mid_vs_none_longest)] == [0.4, 0.6, 0.2, 0.3] and r.longest == 128
    v = spark.createDataFrame([(0.2, 0.1, 0.3), (0.0, -0.1, 0.1), (-0.2, -0.3, -0.1)], "e double, lo double, hi double")
    assert [r.v for r in v.select(R.verdict(F.col("e"), F.col("lo"), F.col("hi")).alias("v")).collect()] == ["supported", "open", "contradicted"]


def test_settings():
    good = {"name": "e1", "levels": ["none"], "models": ["m"], "lengths": [8], "contexts": 2}
    assert R.config_problems([good], {"m": 16_000}, A.LEVELS) == []
    bad = good | {"levels": ["odd"], "lengths": [32], "contexts": 0}
    assert len(R.config_problems([bad], {"m": 16_000}, A.LEVELS)) == 3


def test_audits_and_decoys(spark):
    rows = spark.createDataFrame([("d1", "none", ["$1"]), ("d1", "weak", []), ("d2", "none", [])], "doc_id string, level string, lookalike_values array<string>")
    assert tuple(A.audit_levels(rows).first()) == (1, 1)
    scored = spark.createDataFrame([("decoy", "made_up", ["$7"], "it is $7"), ("decoy", "made_up", ["$7"], "it is $8"), ("none", "made_up", None, "x")], "level string, label string, decoy_values array<string>, response string")
    assert tuple(R.decoy_share(scored, ["level"]).first()) == ("decoy", 2, 0.5)
    assert A.varying(rows, ["doc_id", "level"]) == ["doc_id", "level"] and A.varying(rows.where("doc_id = 'd2'"), ["doc_id", "level"]) == []


def test_answers_in_documents(spark):
    items = spark.createDataFrame([("d1", 1, ["the Eiffel Tower"]), ("d1", 2, ["Rome"]), ("d9", 3, ["Rome"])], "doc string, item int, true_answers array<string>")
    docs = spark.createDataFrame([("d1", "At Eiffel Tower, Paris.")], "doc string, text string")
    assert {r.item: r.holds for r in R.answers_in_documents(items, docs, "doc").collect()} == {1: "yes", 2: "no", 3: "no"}


def test_manifest(spark):
    docs = spark.createDataFrame([(True, 0.001, 5), (False, -0.02, 6)], "within_tolerance boolean, deviation double, n_records int")
    assert tuple(A.manifest(docs).first()) == (2, 1, -0.02, 0.001, 11)
