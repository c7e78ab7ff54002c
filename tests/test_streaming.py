import json

from evalloom.streaming import answers as S


def test_scores_each_question_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    row = {"field": "monthly_rent", "answerable": False, "lookalike_values": ["$5,000"], "timestamp": "2024-01-01T00:00:00Z"}
    replies = [("q1", "It is $5,000."), ("q2", "N/A"), ("q1", "It is $5,000.")]
    for k, (qid, reply) in enumerate(replies):
        (folder / f"{k}.json").write_text(json.dumps(row | {"qid": qid, "response": reply}))
    for _ in range(2):  # started again, it adds nothing
        q = S.append_scored(S.scored_stream(S.incoming(spark, str(folder), 1)), str(tmp_path / "out"), str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = sorted((r.qid, r.label, r.captured) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("q1", "made_up", True), ("q2", "refused", False)]
