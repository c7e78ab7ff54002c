import gzip
import json
import sqlite3
import zipfile

from evalloom.sources import readers as R
from evalloom.sources import writers as W


def test_json_lines_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id int, t string")
    assert W.write_json_lines(rows, str(tmp_path / "x")) == 2
    assert sorted(map(tuple, R.json_lines(spark, str(tmp_path / "x"), "id int, t string").collect())) == [(1, "a"), (2, None)]


def test_scored_tables(spark, tmp_path):
    columns = [c.split()[0] for c in R.SCORED.split(", ")]
    rows = spark.createDataFrame([("d1/u0", False, ["$5", "5"], "made_up", True, "perhaps\n\"5\"")], "qid string, answerable boolean, gold_aliases array<string>, label string, hedged boolean, response string")
    W.write_csv(rows, str(tmp_path / "exp2_qwen_4b_normal_t0.7_s3"), columns)
    got = R.scored(spark, str(tmp_path / "*/*.csv")).first()
    assert (got.exp, got.model, got.prompt, got.temperature, got.seed) == ("exp2", "qwen_4b", "normal", 0.7, 3)
    assert got.gold_aliases == ["$5", "5"] and got.answerable is False and got.flagged and got.scorable and got.doc == "d1" and got.response == "perhaps\n\"5\""
    assert R.scored(spark, str(tmp_path / "*/*.csv"), ["other"]).count() == 0


def test_documents(spark, tmp_path):
    (tmp_path / "d1.json").write_text(json.dumps({"doc_id": "d1"}, indent=1))
    (tmp_path / "d1.txt").write_text("two\nlines")
    assert R.documents(spark, str(tmp_path / "*.json"), str(tmp_path / "*.txt"), "doc_id string").select("doc_id", "text").first() == ("d1", "two\nlines")


def test_answer_files(spark, tmp_path):
    for name in ("a.jsonl", "a.scored.jsonl", "b.part1of2.jsonl", "c.jsonl.gz"):
        opened = gzip.open if name.endswith("gz") else open
        with opened(tmp_path / name, "wt") as f:
            f.write(json.dumps({"qid": name}) + "\n\n")
    assert sorted(r.qid for r in R.answer_files(spark, str(tmp_path), "qid string").collect()) == ["a.jsonl", "c.jsonl.gz"]


def test_sqlite_and_yaml(spark, tmp_path):
    with sqlite3.connect(tmp_path / "x.db") as db:
        db.execute("CREATE TABLE t (a INTEGER, b TEXT)")
        db.execute("INSERT INTO t VALUES (1, NULL)")
    assert R.sqlite_tables(spark, str(tmp_path / "x.db"))["t"].collect() == [("1", None)]
    (tmp_path / "t.yaml").write_text("- {question_id: L11-hr-T2-7, question: q, doc_type: hr, expected_response: 5}\n")
    got = R.test_set(spark, str(tmp_path / "t.yaml")).first()
    assert (got.level, got.template_no, got.n, got.expected_response) == ("L11", 2, 7, "5")


def test_sqlite_ranges(spark, tmp_path):
    with sqlite3.connect(tmp_path / "y.db") as db:
        db.execute('CREATE TABLE "odd ""name""" (a INTEGER PRIMARY KEY, b TEXT)')
        db.executemany('INSERT INTO "odd ""name""" VALUES (?, ?)', [(k * 3, f"v{k}") for k in range(1000)])
        db.execute("CREATE TABLE bare (k TEXT PRIMARY KEY, v REAL) WITHOUT ROWID")
        db.execute("INSERT INTO bare VALUES ('x', 0.5)")
        db.execute("CREATE TABLE emptied (z TEXT)")
    got = R.sqlite_tables(spark, str(tmp_path / "y.db"), partitions=7)
    assert sorted(int(r.a) for r in got['odd "name"'].collect()) == [3 * k for k in range(1000)] and got['odd "name"'].rdd.getNumPartitions() == 7
    assert got["bare"].collect() == [("x", "0.5")] and got["emptied"].collect() == []


def test_yaml_below_tests(spark, tmp_path):
    (tmp_path / "t.yaml").write_text("tests:\n- {question_id: L11-hr-T2-7, template: 'What is it? Reply with a number.', doc_type: hr}\n")
    got = R.test_set(spark, str(tmp_path / "t.yaml")).first()
    assert (got.question, got.prompt, got.expected_response) == ("What is it?", "What is it? Reply with a number.", None)


def test_extra_runs_and_settings(spark, tmp_path):
    columns = [c.split()[0] for c in R.SCORED.split(", ")]
    values = {"qid": "d1/u0", "answerable": "False", "length_k": "32", "copies": "", "label": "made_up", "captured": "True"}
    (tmp_path / "scored.csv").write_text(",".join(columns) + "\n" + ",".join(values.get(c, "") for c in columns) + "\n")
    got = R.scored_extra(spark, str(tmp_path / "scored.csv"), "m_bf16").first()
    assert (got.exp, got.model, got.run, got.prompt, got.made_up, got.length, got.copies_n, got.doc) == ("exp3", "m_bf16", "t0_s0", "normal", True, 32, 0, "d1")
    names = spark.createDataFrame([("gold_present_8k",), ("no_gold_random_32k",), ("other_8k",)], "n string")
    from pyspark.sql import functions as F

    assert [r.s and (r.s.length_k, r.s.gold, r.s.filler, r.s.level) for r in names.select(R.setting_name(F.col("n")).alias("s")).collect()] == [(8, True, "lookalike", "gold"), (32, False, "random", "random"), None]


def test_corpus_split(spark):
    text = "intro\n=== LEASE: l1 ===\nbody one\n=== FIELD REPORT: f2 ===\nbody two"
    got = R.split_corpus(spark.createDataFrame([(1, text)], "c int, t string"), "c", "t").orderBy("char_start").collect()
    assert [(r.doc_id, r.kind) for r in got] == [("l1", "LEASE"), ("f2", "FIELD REPORT")]
    assert all(text[r.char_start : r.char_end] == r.text for r in got) and got[-1].char_end == len(text)


def test_zip_entries(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for i in range(20):
            z.writestr(f"d/{i}.json", json.dumps({"i": i}) * 50)
        z.writestr("d/skip.txt", "no")
    spark.dataSource.register(R.ZipSource)
    got = spark.read.format("zipentries").option("suffix", ".json").load(str(tmp_path / "x.zip")).collect()
    assert len(got) == 20 and all(r.crc_ok and len(r.content) == r.size for r in got)


def test_append_and_release(spark, tmp_path):
    path = str(tmp_path / "answers")
    W.append_new(spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "qid string, n int"), path, "qid")
    W.append_new(spark.createDataFrame([("b", 9), ("c", 3)], "qid string, n int"), path, "qid")
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [("a", 1), ("b", 2), ("c", 3)]
    rows = spark.createDataFrame([("/home/me/model.bin", ["/x/y/z.txt"])], "a string, b array<string>")
    manifest = W.pack_release(rows, str(tmp_path / "release"))
    assert manifest.count() >= 1 and spark.read.json(str(tmp_path / "release")).first().a == "model.bin"


def test_first_runs_and_markdown(spark):
    rows = spark.createDataFrame([("p", "r1", 1), ("p", "r2", 2), ("p", "r1", 3), ("q", "r3", 4)], "platform string, run string, n int")
    assert sorted(r.n for r in R.first_runs(rows, ["platform", "run"], "n", 2).collect()) == [1, 2, 3]
    table = W.markdown(spark.createDataFrame([("a", 1.234, 0.00012345)], "x string, rate double, p double"))
    assert table.splitlines()[-1] == "| a | 1.2 | 0.000123 |"
