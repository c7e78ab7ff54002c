import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from evalloom.llm import toxicity as T


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_against_edit_distance():
    words, stems = {"idiot": 1.0, "worthless": 1.0, "scum": 1.0, "trash": 1.0}, {"lowei": 1.0}
    lexicon = T.Lexicon(words, stems)
    rng = np.random.default_rng(1)
    tried = [*words, "loweisch", "lowei", "low", "", "xlowei"]
    for w in list(words) * 60:
        c = list(w)
        for _ in range(rng.integers(1, 3)):
            k = int(rng.integers(0, len(c)))
            c[k : k + int(rng.integers(0, 2))] = list(rng.choice(list("abtsho"), int(rng.integers(0, 2))))
        tried.append("".join(c))
    for w in tried:
        found = lexicon.match(w)
        if w in words:
            want = 0
        elif w.startswith("lowei"):
            want = 1
        else:
            want = 2 if any(len(t) >= T.FUZZY and distance(w, t) <= 1 for t in words) else None
        assert (found[1] if found else None) == want, w


def test_quotation_counts_apart():
    lexicon = T.Lexicon({"idiot": 5.0}, {})
    plain, quoted = lexicon.features("You are an idiot and more"), lexicon.features('He said "idiot" to them')
    assert plain[5] == 1 and plain[3] == 0 and quoted[5] == 0 and quoted[3] > 0 and plain[0] == quoted[0]


@pytest.fixture(scope="module")
def model(spark, sf):
    return T.trained(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))


def test_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = T.score(docs, T.trained(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    hits, alarms = sum(r.predicted and r.toxic for r in rows), sum(r.predicted and not r.toxic for r in rows)
    toxic = sum(r.toxic for r in rows)
    assert hits >= 0.88 * toxic and alarms <= 0.03 * (len(rows) - toxic)


def test_held_out_rows_teach_nothing(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    from pyspark.sql import functions as F

    turned = labels.withColumn("toxic", F.when(T.crc_mod(F.col("doc_id"), 5) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = T.trained(docs, labels), T.trained(docs, turned)
    assert a.words == b.words and a.stems == b.stems and np.allclose(a.weights, b.weights)


def test_rows(odd, none, model):
    got = T.score(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert T.score(none, model).collect() == []
    assert T.without_toxic(odd, model).columns == odd.columns


def test_nothing_labelled(spark, odd):
    """A model that has learned nothing says so, and calls nothing toxic."""
    for labels in ([], [(1, 1, 1), (2, 1, 1)], [(1, 1, None), (2, 0, 7)]):
        with pytest.warns(UserWarning, match="untrained"):
            model = T.trained(odd, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
        bad = spark.createDataFrame([(1, "you pathetic idiot, you moron"), (2, "a calm day"), (3, None)], "doc_id long, text string")
        assert {(r.predicted, round(r.score, 6)) for r in T.score(bad, model).collect()} == {(0, round(1 / (1 + np.exp(4)), 6))}


# A plain version of the learner and the scorer: counts by loops, words compared with every term.


def plain_terms(rows):
    """rows (text, y): the terms and their log odds."""
    words = [{w for w in re.findall(r"[^\W\d_]+", t.lower()) if len(w) >= 3} for t, _ in rows]
    count = Counter()
    for own, (_, y) in zip(words, rows, strict=True):
        for term in own | {w[:n] + "*" for w in own for n in range(3, 9) if len(w) > n}:
            count[term, y] += 1
    toxic, other = sum(y for _, y in rows), sum(1 - y for _, y in rows)
    odds = {c: ((count[c, 1] + 0.5) / (toxic + 1)) / ((count[c, 0] + 0.5) / (other + 1)) for c, _ in count}
    telling = [c for c in odds if count[c, 1] >= max(3, T.LEAST_SHARE * toxic) and odds[c] >= T.LEAST_ODDS * (1 - 1e-12)]
    whole = [c for c in telling if not c.endswith("*")]
    terms, stems = {}, {}
    for c in sorted(telling, key=lambda c: (-count[c, 1], c.endswith("*"), -len(c), c)):
        x = c.rstrip("*")
        if any(x.startswith(s) for s in stems):
            continue
        if not c.endswith("*"):
            terms[c] = np.log(odds[c])
        elif max([count[w, 1] for w in whole if w.startswith(x)], default=0) < 0.5 * count[c, 1]:
            stems[x] = np.log(odds[c])
    return {w: o for w, o in terms.items() if not any(w.startswith(s) for s in stems)}, stems


def plain_match(word, terms, stems):
    """(term, kind) by comparing with all terms: whole, then beginnings, then one edit away; the term listed first wins."""
    listed = [*terms, *stems]
    if word in terms:
        return listed.index(word), 0
    # the beginning that is complete first
    begun = [(len(s), listed.index(s)) for s in stems if word.startswith(s)]
    if begun:
        return min(begun)[1], 1
    near = [listed.index(t) for t in terms if len(t) >= T.FUZZY and distance(word, t) <= 1]
    if near:
        return min(near), 2
    for n in range(len(word) + 1):
        near = [listed.index(s) for s in stems if len(s) > T.FUZZY and distance(word[:n], s) <= 1]
        if near:
            return min(near), 2
    return None


def plain_features(text, terms, stems):
    low = text.lower()
    words = [(m.start(), m.end(), m[0]) for m in re.finditer(r"[^\W\d_]+", low)]
    odds = [*terms.values(), *stems.values()]
    out, seen = np.zeros(6), defaultdict(set)
    hits = quoted = 0
    for k, (a, z, w) in enumerate(words):
        found = plain_match(w, terms, stems)
        if found is None:
            continue
        seen[found].add(w)
        near = words[max(0, k - 4) : k + 5]
        marks = "\"«»“”„‘"
        said = any(c in marks for c in low[near[0][0] : a]) and any(c in marks for c in low[z : near[-1][1] + 2]) or any(x in T._SAYING for _, _, x in near)
        hits, quoted = hits + 1, quoted + said
        out[5] = max(out[5], not said)
    for (term, kind), ws in seen.items():
        out[kind] += odds[term] / 3 * (1 + np.log(len(ws)))
    out[:3] = [10 * x / (10 + x) for x in out[:3]]
    out[3:5] = np.log1p(quoted), np.log1p(100 * hits / len(words) if words else 0)
    return out


def test_against_the_plain_version(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = T.trained(docs, labels)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    y = {r.doc_id: r.toxic for r in labels.collect() if r.doc_id in texts and r.toxic in (0, 1) and zlib.crc32(str(r.doc_id).encode()) % 5}
    terms, stems = plain_terms([(texts[i], v) for i, v in y.items()])
    assert dict(model.words) == pytest.approx(terms) and dict(model.stems) == pytest.approx(stems) and len(terms) + len(stems) > 3
    order = {w: terms[w] for w in model.words}, {s: stems[s] for s in model.stems}
    some = [*list(texts.items())[:60], *[(i, t) for i, t in texts.items() if y.get(i)][:30]]
    x = np.array([plain_features(t, *order) for _, t in some])
    assert np.allclose(x, [model.lexicon().features(t) for _, t in some])
    want = 1 / (1 + np.exp(-np.clip(x @ model.weights[:-1] + model.weights[-1], -30, 30)))
    got = {r.doc_id: r.score for r in T.score(docs, model).collect()}
    assert np.allclose([got[i] for i, _ in some], want)
    # the weights are where the penalised loss is flat
    ids = list(y)
    rows = np.column_stack([[model.lexicon().features(texts[i]) for i in ids], np.ones(len(ids))])
    target = np.array([y[i] for i in ids])
    p = 1 / (1 + np.exp(-rows @ model.weights))
    slope = rows.T @ (np.where(target == 1, 2.0, 1.0) * (p - target)) + model.weights - T._PRIOR
    assert np.abs(slope).max() < 1e-3 * len(ids)


def test_beginnings_against_the_plain_version():
    rng = random.Random(5)
    terms, stems = {"idiot": 2.0, "scum": 1.0, "pathetic": 3.0, "wort": 1.0}, {"worthl": 2.0, "lowei": 1.5, "disgust": 2.5}
    lexicon = T.Lexicon(terms, stems)
    for base in [*terms, *stems, "worthless", "disgusting", "loweish", "calm"] * 80:
        c = list(base)
        for _ in range(rng.randrange(3)):
            k = rng.randrange(len(c) + 1)
            c[k : k + rng.randrange(2)] = rng.choice(["", "a", "t", "s", "x"])
        word = "".join(c)
        assert lexicon.match(word) == plain_match(word, terms, stems), word


def test_repeated_ids_count_once(spark):
    rows = [(i, f"you idiot {i}" if i % 2 else f"calm day {i}", i % 2) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    a = T.trained(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    b = T.trained(docs.select("doc_id", "text").union(docs.where("doc_id = 1").select("doc_id", "text")).union(docs.where("doc_id = 1").select("doc_id", "text")), docs.select("doc_id", "toxic").union(docs.select("doc_id", "toxic")))
    assert a.words == b.words and np.allclose(a.weights, b.weights)


def test_misspelled_forms_of_learned_terms(spark):
    """Learned words stay terms, so an edit in them is met; a beginning of many words is met with an edit too."""
    insults, rows = ["idiot", "moron", "loser", "disgusting", "pathetic"], []
    for i in range(400):
        toxic = i % 2
        rows.append((i, f"you {insults[i // 2 % 5]} go away now {i}" if toxic else f"a calm day by the lake {i}", toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = T.trained(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    assert set(insults) <= set(model.words)
    for w in ("idiott", "idot", "moronn", "losser", "disgustng", "dsgusting", "pthetic", "patetic"):
        assert model.lexicon().match(w)[1] == 2, w
    many = T.Lexicon({}, {"worthl": 1.0})
    assert many.match("worthless") == (0, 1) and many.match("wrthless") == (0, 2) and many.match("working") is None
    words, stems = T.learned_lexicon([("shared*", 90, 0), *((f"shared{x}", 18, 0) for x in "abcde")], 100, 100)
    assert list(stems) == ["shared"] and not words
