"""Toxicity by a lexicon matched with Levenshtein automata, weighed by context windows.

The lexicon holds words and word beginnings that toxic training documents have and others lack. Its trie is intersected
with the Levenshtein automata of one edit: a state is a set of (trie node, edits so far), and a table of transitions is
filled as words pass, so a word costs a few look-ups and dies early. Hits are counted by how they match (whole, beginning,
misspelled) and by what stands around them: quotation marks or verbs of saying near a hit count it as quoted. A logistic
function of these counts gives the score.

Learning reads labelled training rows only, at most SAMPLE of them, the ones whose hashed ids come first; lexicon counts
and features are computed on the executors, and the driver gets telling terms and feature rows of that bounded sample.
"""

from __future__ import annotations

import re
import warnings
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.llm.common import crc_mod, releasing, table, written

#: Labelled rows to learn from, at most.
SAMPLE = 20_000
#: Lengths of word beginnings that may become terms, and the least length of a term that may be misspelled.
STEMS, FUZZY = range(3, 9), 5
#: Training documents with a term at least, as a share of the toxic ones, and how much likelier it makes the label.
LEAST_SHARE, LEAST_ODDS = 0.01, 40.0
#: Words around a hit that tell quotation.
WINDOW = 4
_WORD = re.compile(r"[^\W\d_]+")
_QUOTES = re.compile("[\"«»“”„‘]")
_SAYING = {"said", "says", "called", "calls", "wrote", "quote", "quoted", "word", "dijo", "llamó", "palabra", "sagte", "nannte", "wort", "dit", "appelé", "mot"}
#: log odds of the terms met whole, as beginnings, misspelled; quoted hits, hits a hundred words, whether any unquoted hit
FEATURES = 6
_PRIOR = np.array([1.5, 1.5, 0.3, -1.0, 0.1, 2.0, -4.0])  # the last is the constant


class Lexicon:
    """Words to (term, kind of match) or None; kind 0 whole, 1 beginning, 2 one edit away."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.terms = [(w, False) for w in words] + [(s, True) for s in stems]
        self.odds = [*words.values(), *stems.values()]
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        for k, (term, _) in enumerate(self.terms):
            node = 0
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                node = self.children[node][c]
            self.ends[node].append(k)
        self._empty()

    def _empty(self) -> None:
        self.states: list[frozenset] = []
        self.number: dict[frozenset, int] = {}
        self.step: list[dict[str, int]] = []
        self.met: list[int | None] = []  # a beginning that is complete in this state
        self.nearly: list[int | None] = []  # the same, one edit away
        self.final: list[tuple[int, int] | None] = []  # what a word ending in this state is
        self.words: dict[str, tuple[int, int] | None] = {}
        self._state(frozenset([(0, 0)]))

    def _state(self, items: frozenset) -> int:
        """Closed under the term's letter being left out."""
        items = items | {(child, 1) for node, edits in items if not edits for child in self.children[node].values()}
        items = frozenset((n, e) for n, e in items if not e or (n, 0) not in items)
        if items not in self.number:
            self.number[items] = len(self.states)
            self.states.append(items)
            self.step.append({})
            whole = [k for n, e in items if not e for k in self.ends[n]]
            near = [k for n, e in items if e for k in self.ends[n] if not self.terms[k][1] and len(self.terms[k][0]) >= FUZZY]
            self.met.append(min((k for k in whole if self.terms[k][1]), default=None))
            # a beginning meets more words than a term does, so it takes a letter more
            self.nearly.append(min((k for n, e in items if e for k in self.ends[n] if self.terms[k][1] and len(self.terms[k][0]) > FUZZY), default=None))
            exact = min((k for k in whole if not self.terms[k][1]), default=None)
            self.final.append((exact, 0) if exact is not None else (min(near), 2) if near else None)
        return self.number[items]

    def _next(self, state: int, c: str) -> int:
        after = set()
        for node, edits in self.states[state]:
            child = self.children[node].get(c)
            if child is not None:
                after.add((child, edits))
            if not edits:
                after.add((node, 1))  # a letter too many
                after.update((x, 1) for x in self.children[node].values())  # another letter
        self.step[state][c] = found = self._state(frozenset(after)) if after else -1
        return found

    def match(self, word: str) -> tuple[int, int] | None:
        if word in self.words:
            return self.words[word]
        if len(self.words) > 100_000 or len(self.states) > 100_000:
            self._empty()
        state, stem, nearly = 0, None, None
        for c in word:
            state = self.step[state].get(c) if c in self.step[state] else self._next(state, c)
            if state < 0:
                break
            if stem is None and self.met[state] is not None:
                stem = self.met[state]
            if nearly is None:
                nearly = self.nearly[state]
        found = self.final[state] if state >= 0 else None
        if (found is None or found[1] == 2) and stem is not None:
            found = (stem, 1)
        if found is None and nearly is not None:
            found = (nearly, 2)
        self.words[word] = found
        return found

    def features(self, text: str) -> np.ndarray:
        low, out = text.lower(), np.zeros(FEATURES)
        words = _WORD.findall(low)
        match, known = self.match, self.words
        hits = [w for w in set(words) if (known[w] if w in known else match(w)) is not None]
        if not hits:
            return out
        places = [(m.start(), m.end(), m[0]) for m in _WORD.finditer(low)]
        wanted = set(hits)
        for k, (_, _, w) in enumerate(places):
            if w not in wanted:
                continue
            near = places[max(0, k - WINDOW) : k + WINDOW + 1]
            before, after = low[near[0][0] : places[k][0]], low[places[k][1] : near[-1][1] + 2]
            quoted = bool(_QUOTES.search(before) and _QUOTES.search(after)) or any(x in _SAYING for _, _, x in near)
            out[3] += quoted
            out[5] = max(out[5], not quoted)
            out[4] += 1
        for (term, kind), n in Counter(match(w) for w in hits).items():  # different words of one term
            out[kind] += self.odds[term] / 3 * (1 + np.log(n))
        out[3:5] = np.log1p([out[3], 100 * out[4] / len(words)])
        out[:3] = 10 * out[:3] / (10 + out[:3])  # many different terms say little more than some
        return out


def _candidates(text: str) -> set[str]:
    """The text's words of three letters or more, and with a * the beginnings of longer words."""
    words = {w for w in _WORD.findall(text.lower()) if len(w) >= STEMS[0]}
    return words | {w[:n] + "*" for w in words for n in STEMS if len(w) > n}


def learned_lexicon(counts: list[tuple[str, int, int]], toxic: int, other: int) -> tuple[dict[str, float], dict[str, float]]:
    """Words and beginnings, with their log odds, from (candidate, toxic documents, other documents), most frequent first; nothing that another term begins. A beginning is a term if it has over twice the toxic documents of any one word that it begins."""
    least = max(3, LEAST_SHARE * toxic)
    scored = [(p, c) for c, p, n in counts if p >= least and (p + 0.5) / (toxic + 1) >= LEAST_ODDS * (n + 0.5) / (other + 1)]
    words, stems = [], {}
    reach: dict[str, int] = {}  # by beginning, of the word among its own that most toxic documents have
    for p, c in scored:
        if not c.endswith("*"):
            for n in (*STEMS, len(c)):
                reach[c[:n]] = max(reach.get(c[:n], 0), p)
    for p, c in sorted(scored, key=lambda x: (-x[0], x[1].endswith("*"), -len(x[1]), x[1])):
        plain = c.rstrip("*")
        if any(plain[:n] in stems for n in STEMS):
            continue
        if c.endswith("*"):
            if reach.get(plain, 0) < 0.5 * p:  # else a word says as much
                stems[plain] = None
        else:
            words.append(c)
    odds = {c: float(np.log((p + 0.5) / (toxic + 1) / ((n + 0.5) / (other + 1)))) for c, p, n in counts}
    return {w: odds[w] for w in words if not any(w[:n] in stems for n in STEMS)}, {x: odds[x + "*"] for x in stems}


def fitted(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights by Newton's method, pulled towards the prior."""
    x, w = np.column_stack([x, np.ones(len(x))]), _PRIOR.copy()
    if len(set(y.tolist())) < 2:
        return w
    weight = np.where(y == 1, 2.0, 1.0)  # a toxic text missed weighs as much as two clean ones lost

    def loss(w):
        z = x @ w
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * ((w - _PRIOR) ** 2).sum())

    now = loss(w)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + (w - _PRIOR)
        move = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(len(w)), gradient)
        share = 1.0
        while share > 1e-6 and loss(w - share * move) > now:  # far from the optimum, a whole step may lead away from it
            share /= 2
        w = w - share * move
        before, now = now, loss(w)
        if before - now < 1e-10 * (1 + abs(now)):
            break
    return w


class Model:
    def __init__(self, words: dict[str, float], stems: dict[str, float], weights: np.ndarray):
        self.words, self.stems, self.weights = words, stems, weights

    def lexicon(self) -> Lexicon:
        key = (tuple(self.words), tuple(self.stems))
        if key not in _lexicons:
            _lexicons.clear()
            _lexicons[key] = Lexicon(self.words, self.stems)
        return _lexicons[key]

    def scored(self, texts) -> np.ndarray:
        lexicon = self.lexicon()
        rows = np.array([lexicon.features(t) for t in texts]).reshape(-1, FEATURES)
        return 1 / (1 + np.exp(-np.clip(rows @ self.weights[:-1] + self.weights[-1], -30, 30)))


_lexicons: dict[tuple, Lexicon] = {}


def untrained(why: str) -> Model:
    """A model without terms, which says so."""
    warnings.warn(f"the toxicity model is untrained: {why}", stacklevel=3)
    return Model({}, {}, _PRIOR)


def trained(docs: DataFrame, labels: DataFrame) -> Model:
    """From documents and labels (doc_id, toxic), of those whose crc32(doc_id as text) mod 5 is not 0.

    Null ids and labels other than 0 and 1 teach nothing; null texts are empty; of repeated ids one text is read, of equal
    labels one. Texts may have any length. Where a label has no rows, or nothing tells them apart, the model has no terms:
    it warns, and scores all texts alike, as not toxic.
    """
    rows = labels.where(F.col("toxic").isin(0, 1) & (crc_mod(F.col("doc_id"), 5) != 0)).select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("y")).distinct()
    rows = F.broadcast(rows.orderBy(F.xxhash64("id"), "id", "y").limit(SAMPLE))  # at most SAMPLE rows
    texts = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).join(rows, "id")
    sample = written(texts.groupBy("id", "y").agg(F.min("text").alias("text")).select("text", "y"), "toxic-sample")
    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic, other = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not other:
        return untrained("no rows of both labels")

    def counted(batches):
        found: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found[y].update(_candidates(text))
                if len(found[y]) > 300_000:
                    yield from rows_of(found)
                    found = {0: Counter(), 1: Counter()}
        yield from rows_of(found)

    def rows_of(found):
        for y, c in found.items():
            if c:
                yield pa.RecordBatch.from_arrays([pa.array(list(c)), pa.array(list(c.values()), pa.int64()), pa.array([y] * len(c), pa.int32())], ["term", "n", "y"])

    counts = sample.mapInArrow(releasing(counted), "term string, n long, y int").groupBy("term").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("q"))
    telling = counts.where((F.col("p") >= max(3, LEAST_SHARE * toxic)) & ((F.col("p") + 0.5) / (toxic + 1) >= LEAST_ODDS * (F.col("q") + 0.5) / (other + 1)))
    words, stems = learned_lexicon([(r["term"], r["p"], r["q"]) for r in telling.collect()], toxic, other)  # terms of at least LEAST_SHARE of a bounded sample's toxic texts
    if not words and not stems:
        return untrained("no terms that tell the labels apart")
    model = Model(words, stems, _PRIOR)

    def featured(batches):
        for b in batches:
            x = np.array([model.lexicon().features(t) for t in b.column(0).to_pylist()]).reshape(-1, FEATURES)
            keys, counts = np.unique(np.column_stack([x, b.column(1).to_numpy()]), axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(list(keys), pa.list_(pa.float64())), pa.array(counts, pa.int64())], ["x", "n"])

    found = sample.mapInArrow(releasing(featured), "x array<double>, n long").collect()  # at most SAMPLE rows
    x = np.repeat(np.array([r["x"] for r in found]), [r["n"] for r in found], axis=0)
    model.weights = fitted(x[:, :-1], x[:, -1])
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    Null texts count as empty; texts without a hit, empty ones too, have one score; a null id is not held out.
    Repeated rows are scored each. Texts may have any length. Other columns are not read. An empty table gives an empty result.
    """

    def rows(batches):
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.scored(pc.fill_null(part.column(1), "").to_pylist()))], ["doc_id", "score"])

    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(releasing(rows), "doc_id long, score double")
    held = F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs that are not predicted toxic, with all their columns, whatever their names; nothing is shuffled. Null texts are not toxic."""
    names, schema = docs.columns, docs.schema

    def rows(batches):
        for b in batches:
            stay = model.scored(pc.fill_null(b.column(names.index(text_col)), "").to_pylist()) < 0.5
            yield b.filter(pa.array(stay))

    return docs.mapInArrow(releasing(rows), schema)


def op7_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return score(docs, trained(docs, table(spark, sf_dir, "labels")))
