"""Built documents pass; each planted fault is found."""

import random
import re

import pytest
from pyspark.sql import Row

from evalloom.operators import generate as G
from evalloom.operators.verify import problems


def spec(**given):
    return {"doc_id": "d", "length": 2500, "ladder": "name", "level": "strong", "filler": "sibling", "copies": 1, "seed": 5, "tolerance": 0.01} | given


def frames(spark, made):
    documents = spark.createDataFrame([Row(d=m[0]) for m in made], f"d {G._DOCUMENT}").select("d.*")
    records = spark.createDataFrame([Row(r=r) for m in made for r in m[1]], f"r {G._RECORD}").select("r.*")
    questions = spark.createDataFrame([Row(q=q) for m in made for q in m[2]], f"q {G._QUESTION}").select("q.*")
    return documents, records, questions


def added(made, text, fields=None, role="filler"):
    document, records, questions = made
    start = len(document["text"]) + 2
    new = {"doc_id": document["doc_id"], "rid": "r99999", "type": "lease" if fields else "note", "role": role, "probe_id": None, "char_start": start, "char_end": start + len(text), "fields": fields or {}}
    return document | {"text": document["text"] + G.SEPARATOR + text}, [*records, new], questions


def rules(spark, made):
    return {r.rule for r in problems(*frames(spark, [made])).collect()} - {"L1"}


@pytest.fixture(scope="module")
def named():
    return G.build_document(spec())


def test_untouched(spark, named):
    assert rules(spark, named) == set()
    assert G.build_document(spec()) == named


def test_faults_of_the_name_ladder(spark, named):
    probe = next(q for q in named[2] if not q["answerable"])
    answered = next(q for q in named[2] if q["answerable"])
    lease = lambda tenant: {"tenant": tenant, "building": "Nowhere Hall", "start_date": "2015-02-03"}
    assert rules(spark, added(named, f"A lease of {probe['tenant']}.", lease(probe["tenant"]))) >= {"N1", "N2"}
    stem = probe["stem"][:3] + "x" + probe["stem"][4:]
    assert "N3" in rules(spark, added(named, f"A lease of {stem}.", lease(f"{stem} Nothing")))
    assert "N4" in rules(spark, added(named, f"A lease of Zzyzx {probe['generic']}."))
    assert "A1" in rules(spark, added(named, "Another lease.", lease(answered["tenant"])))
    document, records, questions = named
    assert "S1" in rules(spark, (document | {"text": document["text"] + " and more"}, records, questions))
    assert "S2" in rules(spark, added(named, "One look-alike too many.", role="lookalike"))
    assert "A2" in rules(spark, (document, records, [q | {"gold": "$1"} if q["answerable"] else q for q in questions]))


def test_faults_of_the_role_ladder(spark):
    made = G.build_document(spec(ladder="role", level="medium"))
    assert rules(spark, made) == set()
    probe = next(q for q in made[2] if not q["answerable"])
    fields = {"tenant": probe["tenant"], "building": probe["building"], "start_date": f"{probe['start_year']}-01-01"}
    assert rules(spark, added(made, f"{probe['tenant']} rents {probe['building']}.", fields)) >= {"R1", "R2", "R3"}


@pytest.mark.parametrize("level", G.LEVELS)
def test_counts(level):
    for seed in range(6):
        document, records, questions = G.build_document(spec(level=level, seed=seed, copies=2, ladder="name" if seed % 2 else "role", length=4000))
        assert document["within_tolerance"] and len({q["qid"] for q in questions}) == 12
        assert sum(q["answerable"] for q in questions) == 4 and sum(r["role"] == "lookalike" for r in records) == (0 if level == "none" else 16)
        assert document["text"] == G.SEPARATOR.join(document["text"][r["char_start"] : r["char_end"]] for r in records)


@pytest.mark.parametrize("key", [266, 764, 4466, 5870])
def test_spellings_one_edit_away_are_near_no_other_stem(key):
    """Of these seeds, look-alikes' stems were two edits from another question's stem."""
    spec = {"doc_id": "d", "length": 2500, "ladder": "name", "level": "strong", "filler": ["unrelated", "sibling"][key // 10 % 2], "copies": 1, "seed": key, "tolerance": 0.01}
    document, records, questions = G.build_document(spec)
    for q in questions:
        for r in records:
            if q["answerable"] or (r["role"], r["probe_id"]) == ("lookalike", q["probe_id"]):
                continue
            words = re.findall("[A-Za-z]{4,}", document["text"][r["char_start"] : r["char_end"]])
            assert not [w for w in words if G.shortened(w.lower()) & G.shortened(q["stem"].lower())]


def test_generated_documents_are_read_where_they_are_built(spark, sf):
    """Nothing is kept, joined or broadcast, so the driver holds no texts; and a task holds few documents at once."""
    from evalloom.plans.build_queries import generated_documents

    plan = generated_documents(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Join|Broadcast|InMemoryTableScan", plan)


def test_filled_documents_meet_their_budget_where_words_are_long():
    """Where the next passage is one long word, another one closes the gap; where all are, one is cut."""
    passage = lambda k, text: {"rank": str(k), "title": f"T{k}", "text": text, "cost": G.tokens(f"T{k}\n{text}")}
    long, plain = "x" * 400, " ".join(["word"] * 60)
    for texts in ([plain, long, plain], [plain, long, long], [plain, "x" * 30, "y" * 30, long]):
        got = G._filled([passage(k, t) for k, t in enumerate(texts)], 100, None, 0.01, random.Random(1))
        assert got[1] in (99, 100, 101) and got[4]


def test_filled_documents_cut_candidates_where_they_are_made(spark):
    """What goes to a shuffle is a document's best candidates, narrow rows, batch by batch; the documents are those of all candidates, whatever the targets and batches."""
    texts = {str(k): ("" if k == 7 else "word " * (3 + k * 5 % 17)).strip() for k in range(120)}
    passages = G.costed(spark.createDataFrame([(p, f"T{p}", t) for p, t in texts.items()], "pid string, title string, text string"))
    asked = [("a", 60, None), ("b", 300, ("Gold", "It stands here.")), ("c", 2000, None), ("none", 50, None)]
    settings = spark.createDataFrame(asked, "doc_id string, target int, gold struct<title: string, text: string>")
    ranks = [(d, int(p) * (3 if d == "a" else 7) % 40, p) for d in ("a", "b", "c") for p in texts]  # ranks tie
    candidates = spark.createDataFrame(ranks, "doc_id string, rank int, pid string").repartition(5).join(passages.select("pid", "cost"), "pid")
    costs = {r.pid: r.cost for r in passages.collect()}
    assert costs == {p: G.tokens(f"T{p}\n{t}") for p, t in texts.items()}
    want = {}
    for d, target, gold in asked:
        all_ = [{"title": f"T{p}", "text": texts[p], "cost": costs[p]} for _, _, p in sorted(x for x in ranks if x[0] == d)]
        before, near = 0, []
        for p in all_:
            near += [p] if before <= 2 * target else []
            before += p["cost"]
        want[d] = G._filled(near, target, gold and {"title": gold[0], "text": gold[1]}, 0.01, random.Random(f"fill|0|{d}"))
    assert {r.doc_id: tuple(r)[1:] for r in G.filled_documents(candidates, passages, settings).collect()} == want

    batch = candidates.where("doc_id <> 'c'").select("doc_id", "rank", "pid", "cost").toArrow().combine_chunks().to_batches()[0]
    (left,) = G._within(40)([batch])
    assert set(left.column("doc_id").to_pylist()) == {"a", "b"} and left.num_rows < 12 < batch.num_rows
