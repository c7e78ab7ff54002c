"""Katz backoff language model of up to three words: Good-Turing discounted counts with exactly normalised backoff weights.

P(w | h) is the discounted relative count if h w was seen in training, else weight(h) * P(w | h without its first word) if h
was seen, else P(w | h without its first word). Counts up to K are discounted by Good and Turing, higher ones are not. The
last step is P(w): the discounted relative count of a known word; all unknown words together have the mass that is left. A
text begins with a mark that is a history only, and its end is a token. A history none of whose words has a count up to K
would keep no mass to back off with: its denominator is one higher. For each history all words' probabilities, with that
of the unknown ones, sum to 1.

Texts go by blocks, n-grams by buckets: ranges of a permuted history key. Level by level, each block sends every bucket its
distinct n-grams once, with its own training counts, and gets back their totals; buckets store the totals as tables,
partitioned by level and bucket. Words are told apart by their bytes and then go by numbers, so n-grams are told apart
exactly. With the words of a history a block sends what their lower orders are, so a bucket can add up both sums that the
weight needs. What only one block holds it settles by itself. Histories that hold over a HOT-th of all tokens, at most HOT
of them, are dealt over all buckets by their next word, and their sums added up. A block then works out the probability of
each of its distinct n-grams from that of the n-gram's suffix, level by level.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.llm.blocks import ROW_COLUMNS, ROW_NAMES, bundle, doc_ids, joined, message_rows, ordered, pack, pack_sorted, text_blocks, unbundle, unpack, unpack_sorted
from evalloom.llm.common import HOT, bucketed, crc_mod, distinct_words, gathered, grouped, mixed, release, releasing, shuffle_width, table, words_of, written
from evalloom.llm.simhash import _LOWER, SPACE

#: Words of an n-gram, at most 3; counts up to K are discounted by Good and Turing.
ORDER, K = 3, 5
BEGIN, END = 0, 1
TABLE, STATS, SHARES = 10, 20, 30
_MIX = 0x9E3779B97F4A7C15


def good_turing(n: list[int]) -> np.ndarray:
    """Discounts for counts 0 to K from the numbers n of n-grams by count 1 to K + 1; where these give none between 0 and 1, half a count is lost."""
    d = np.array([1.0, *[1 - 0.5 / r for r in range(1, K + 1)]])
    common = (K + 1) * n[K] / n[0] if n[0] else 1.0
    for r in range(1, K + 1):
        if n[r - 1] and common < 1:
            x = ((r + 1) * n[r] / (r * n[r - 1]) - common) / (1 - common)
            if 0 < x < 1:
                d[r] = x
    return d


class Level:
    """What all blocks and buckets know of the n-grams of one length."""

    def __init__(self, counted: np.ndarray):
        #: training tokens, distinct n-grams, and how many have the counts 1 to K + 1
        self.n, self.v, self.by_count = int(counted[0]), int(counted[1]), counted[2:].tolist()
        self.discount = good_turing(self.by_count)
        #: sorted keys, as histories, of those with over n / HOT tokens; and of these the sums over their next words
        self.hot, self.shares = np.zeros(0, np.uint64), np.zeros((0, K + 2))

    def mass(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > K, c, c * self.discount[np.minimum(c, K)])


class Model:
    """Levels so far, levels[0] that of words, and the keys of histories."""

    def __init__(self, buckets: int):
        self.buckets, self.levels, self.ids = buckets, [], 2

    def words_known(self) -> None:
        one = self.levels[0]
        left = sum((1 - one.discount[r]) * r * one.by_count[r - 1] for r in range(1, K + 1))
        self.tokens = one.n if left > 0 else one.n + 1
        #: mass of all unknown words
        self.unknown = (left if left > 0 else 1.0) / self.tokens if one.n else 1.0

    def word(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.levels[0].mass(c) / self.tokens, self.unknown)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.levels[0].n + 0.5 * (self.levels[0].v + 1)))

    def bits(self, level: int) -> int:
        """Of the keys of histories of n-grams of that length."""
        return max(1, (self.ids ** (level - 1) - 1).bit_length())

    def permuted(self, key: np.ndarray, level: int) -> np.ndarray:
        """A permutation of the keys that spreads them evenly."""
        return key * np.uint64(_MIX) & np.uint64((1 << self.bits(level)) - 1)

    def restored(self, key: np.ndarray, level: int) -> np.ndarray:
        bits = self.bits(level)
        return key * np.uint64(pow(_MIX, -1, 1 << bits)) & np.uint64((1 << bits) - 1)

    def bucket(self, key: np.ndarray, level: int) -> np.ndarray:
        """By the permuted key's range."""
        bits = self.bits(level)
        top = min(bits, 32)
        return ((key >> np.uint64(bits - top)) * np.uint64(self.buckets) >> np.uint64(top)).astype(np.int64)

    def spread(self, key: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The buckets of hot histories: by history and word."""
        return ((mixed(key + mixed(word)) >> np.uint64(32)) * np.uint64(self.buckets) >> np.uint64(32)).astype(np.int64)


def among(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(x), bool)
    return keys[np.minimum(np.searchsorted(keys, x), len(keys) - 1)] == x


class Grams:
    """A block's distinct n-grams of one length, sorted by history and word, by places in the block."""

    def __init__(self, history: np.ndarray, word: np.ndarray, suffix: np.ndarray, histories: int, words: int, trains: np.ndarray):
        distinct, some, place = grouped(history.astype(np.uint64) * np.uint64(words) + word.astype(np.uint64), histories * words)
        self.place = place.astype(np.int32)
        self.history, self.word, self.suffix = history[some], word[some], suffix[some]
        self.own = np.bincount(self.place[trains], minlength=len(distinct))


class Block:
    """The tokens of a block's texts and its distinct n-grams."""

    def __init__(self, row: dict, order: int):
        self.docs = doc_ids(row["ids"], row["missing"])
        data, offsets = _LOWER[np.frombuffer(zstandard.decompress(row["text"]), np.uint8)], unpack(row["offsets"], np.int64)
        self.trains = np.unpackbits(np.frombuffer(row["flags"], np.uint8))[: len(self.docs)].astype(bool)
        start, end, first = words_of(data, offsets, SPACE)
        self.hashes, some, which = distinct_words(data, start, end)
        #: the distinct words' bytes, one after another, and their sizes
        self.size = (end - start)[some]
        self.text = gathered(data, start[some], self.size)
        n = np.diff(first)
        #: tokens of each text, with the end; the stream has a beginning too
        self.tokens = n + 1
        ends = np.cumsum(n + 2)
        token = np.zeros(int(ends[-1]) if len(ends) else 0, np.int32)
        inside = np.ones(len(token), bool)
        inside[ends - 1] = inside[ends - n - 2] = False
        token[ends - 1] = END
        token[inside] = 2 + which
        del data, start, end, which, inside
        self.words = 2 + len(some)
        trains = np.repeat(self.trains, n + 2)
        self.first = ends - n - 2  # of each text's beginning
        at = np.arange(len(token)) - np.repeat(self.first, n + 2)
        self.word = token
        self.own_words = np.bincount(token[trains & (at > 0)], minlength=self.words)
        self.at, self.grams, place = at, {}, token
        for k in range(2, order + 1):
            some = np.flatnonzero(at >= k - 1)
            self.grams[k] = Grams(place[some - 1], token[some], place[some], self.words if k == 2 else len(self.grams[k - 1].word), self.words, trains[some])
            place = np.full(len(token), -1, np.int32)
            place[some] = self.grams[k].place


class Told:
    """A block with its answers so far."""

    def __init__(self, row: dict, answers: list[dict], model: Model, order: int):
        self.block, self.model = Block(row, order), model
        answers = [r for r in answers if r["block"] == row["block"]]
        b = self.block
        ids, counts, alone = [], [], []
        for r in ordered(answers, 1):
            rank, count = unbundle(r["a"])
            ids.append(2 + unpack(rank, np.uint32).astype(np.uint64) * np.uint64(model.buckets) + np.uint64(r["bucket"]))
            counts.append(unpack(count, np.uint64))
            alone.append(np.unpackbits(np.frombuffer(r["b"], np.uint8))[: len(ids[-1])])
        #: global numbers, counts, and whether no other block has them, of the block's words
        self.id = np.concatenate([np.array([BEGIN, END], np.uint64), joined(ids, np.uint64)])
        self.count = {1: np.concatenate([np.zeros(2, np.int64), joined(counts, np.uint64).astype(np.int64)])}
        self.alone = {1: np.concatenate([np.zeros(2, bool), joined(alone, np.uint8).astype(bool)])}
        self.count[1][END] = model.texts
        #: counts as histories
        self.as_history = {2: self.count[1].copy()}
        self.as_history[2][BEGIN] = model.texts
        self.p = {1: model.word(self.count[1])}
        self.key = {2: self.id}
        for k in range(2, len(model.levels) + 1):
            self._take(k, [r for r in answers if r["kind"] == k])

    def sent(self, k: int) -> tuple[np.ndarray, ...]:
        """The n-grams that buckets are asked for, in the order of their messages: by bucket and permuted history key; these keys, and where each bucket's begin."""
        g, model = self.block.grams[k], self.model
        some = np.flatnonzero(~self.alone[k - 1][g.history])
        history = g.history[some]
        key = model.permuted(self.key[k], k)
        place = np.argsort(key, kind="stable")
        rank = np.empty(len(key), np.uint64)
        rank[place] = np.arange(len(key), dtype=np.uint64)
        bucket = model.bucket(key, k)[history]
        hot = np.flatnonzero(among(model.levels[k - 2].hot, key)[history])
        bucket[hot] = model.spread(key[history[hot]], self.id[g.word[some[hot]]])
        # one number holds bucket, rank and place, so no two are equal and the order is the same wherever it is worked out
        n = max(1, len(some))
        if model.buckets * len(key) * n >= 1 << 64:
            place = np.lexsort((rank[history], bucket))
        else:
            place = (np.sort((bucket.astype(np.uint64) * np.uint64(len(key)) + rank[history]) * np.uint64(n) + np.arange(len(some), dtype=np.uint64)) % np.uint64(n)).astype(np.int64)
        return some[place], key[history[place]], np.searchsorted(bucket[place], np.arange(model.buckets + 1))

    def _take(self, k: int, answers: list[dict]) -> None:
        b, g, model = self.block, self.block.grams[k], self.model
        level = model.levels[k - 1]
        some, key, bounds = self.sent(k)
        count, alone = g.own.astype(np.int64).copy(), self.alone[k - 1][g.history]  # what follows a history of this block alone is of this block alone
        histories = len(self.as_history[k])
        #: by history: next words by count 1 to K, the sum of higher counts, the mass of the next words one order lower
        shares, low = np.zeros((histories, K + 2)), np.zeros(histories, bool)
        for r in ordered(answers, k):
            a, z = bounds[r["bucket"]], bounds[r["bucket"] + 1]
            totals, lone, lows, needed, numbers = unbundle(r["a"])
            own = some[a:z]
            count[own] = unpack(totals, np.uint64).astype(np.int64)
            alone[own] = np.unpackbits(np.frombuffer(lone, np.uint8))[: z - a].astype(bool)
            heads = g.history[own[np.append(True, key[a + 1 : z] != key[a : z - 1])]]
            low[heads] = np.unpackbits(np.frombuffer(lows, np.uint8))[: len(heads)].astype(bool)
            wanted = heads[np.unpackbits(np.frombuffer(needed, np.uint8))[: len(heads)].astype(bool)]
            counts, lower = unbundle(numbers)
            shares[wanted, : K + 1] = unpack(counts, np.uint64).reshape(K + 1, -1).T
            shares[wanted, K + 1] = unpack(lower, np.float64)
        lone = np.flatnonzero(self.alone[k - 1][g.history])
        shares_of(shares, g.history[lone], g.own[lone], self.p[k - 1][g.suffix[lone]])
        own = self.alone[k - 1]
        low[own] = shares[own, :K].sum(axis=1) > 0
        hot = model.levels[k - 2].hot
        if len(hot):
            mine = model.permuted(self.key[k], k)
            is_hot = np.flatnonzero(among(hot, mine) & ~own)
            shares[is_hot] = level.shares[np.searchsorted(hot, mine[is_hot])]
            low[is_hot] = shares[is_hot, :K].sum(axis=1) > 0
        before = self.as_history[k]
        under = np.maximum(before + ~low, 1)
        seen = (shares[:, :K] @ (level.discount[1:] * np.arange(1, K + 1)) + shares[:, K]) / under
        weight = np.where(before > 0, (1 - seen) / (1 - shares[:, K + 1]), 1.0)
        self.p[k] = np.where(count > 0, level.mass(count) / under[g.history], weight[g.history] * self.p[k - 1][g.suffix])
        self.count[k], self.alone[k] = count, alone
        #: denominators of the histories, for the next level
        self.under = under
        if k < len(b.grams) + 1:
            self.as_history[k + 1] = count
            self.key[k + 1] = self.id[b.grams[k].word] + self.key[k][g.history] * np.uint64(model.ids)


def shares_of(out: np.ndarray, history: np.ndarray, count: np.ndarray, lower: np.ndarray) -> None:
    """Adds to each history's row: next words by count 1 to K, the sum of higher counts, the mass of its next words one order lower."""
    some = np.flatnonzero((count > 0) & (count <= K))
    out += np.bincount(history[some].astype(np.int64) * (K + 2) + count[some] - 1, minlength=out.size).reshape(out.shape)
    some = np.flatnonzero(count > K)
    out[:, K] += np.bincount(history[some], weights=count[some], minlength=len(out))
    some = np.flatnonzero(count > 0)
    out[:, K + 1] += np.bincount(history[some], weights=lower[some], minlength=len(out))


def _each(batch):
    return (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows))


def _word_bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _ask_words(buckets: int):
    """For each block and bucket: the distinct words, and how often training texts hold them. Words are sorted by hash, and so by bucket."""

    def rows(batches):
        for b in batches:
            for row in _each(b):
                block, out = Block(row, 1), []
                bounds = np.searchsorted(_word_bucket(block.hashes, buckets), np.arange(buckets + 1)).tolist()
                ends = np.append(0, np.cumsum(block.size))
                for k, (a, z) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                    if a < z:
                        text = zstandard.compress(block.text[ends[a] : ends[z]].tobytes(), 1)
                        out.append((row["block"], 1, k, text, pack(block.size[a:z].astype(np.uint32)), pack(block.own_words[2 + a : 2 + z].astype(np.uint32))))
                numbers = np.array([int(block.own_words[END])], np.int64).tobytes()  # ends have no bucket of their own
                yield from message_rows([*out, (row["block"], STATS, 0, numbers, None, None)]).to_batches()

    return rows


def _by_count(total: np.ndarray) -> list[int]:
    return [int((total == r).sum()) for r in range(1, K + 2)]


def _stats(total: np.ndarray, most: int = 0) -> bytes:
    return np.array([int(total.sum()), int((total > 0).sum()), *_by_count(total), most], np.int64).tobytes()


def _answer_words(buckets: int):
    """Ranks a bucket's words, frequent ones first, and adds their counts up. A word's number is 2 + rank * buckets + bucket."""

    def found(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["block"])
        kind, bucket = rows[0]["kind"], rows[0]["bucket"]
        if kind == STATS:
            texts = sum(int(np.frombuffer(r["a"], np.int64)[0]) for r in rows)
            return message_rows([(None, STATS, bucket, _stats(np.array([texts])), np.array([texts], np.int64).tobytes(), None)])
        data = np.frombuffer(b"".join([zstandard.decompress(r["a"]) for r in rows]), np.uint8)
        sizes, counts = [unpack(r["b"], np.uint32).astype(np.int64) for r in rows], [unpack(r["c"], np.uint32) for r in rows]
        size = np.concatenate(sizes)
        end = np.cumsum(size)
        _, some, which = distinct_words(data, end - size, end)
        total = np.bincount(which, weights=np.concatenate(counts), minlength=len(some)).astype(np.int64)
        alone = np.bincount(which, minlength=len(some)) == 1
        place = np.lexsort((np.arange(len(some)), -total))
        rank = np.empty(len(some), np.int64)
        rank[place] = np.arange(len(some))
        out, at = [], 0
        for r, n in zip(rows, map(len, sizes), strict=True):
            w = which[at : at + n]
            at += n
            out.append((r["block"], 1, bucket, bundle(pack(rank[w].astype(np.uint32)), pack(total[w].astype(np.uint64))), np.packbits(alone[w]).tobytes(), None))
        known = place[: int((total > 0).sum())]
        words = zstandard.compress(gathered(data, (end - size)[some[known]], size[some[known]]).tobytes(), 3)
        out.append((None, TABLE + 1, bucket, words, pack(size[some[known]].astype(np.uint32)), pack(total[known].astype(np.uint64))))
        return message_rows([*out, (None, STATS, bucket, _stats(total, 2 + (len(some) + 1) * buckets), None, None)])

    return found


def _ask(k: int, model: Model, order: int):
    """For each block and bucket: the distinct n-grams of length k by history, with training counts, and what is needed of the order below."""

    def found(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        out, told = [], answers.to_pylist()
        for row in blocks.to_pylist():
            t = Told(row, told, model, k)
            g = t.block.grams[k]
            some, key, bounds = t.sent(k)
            word, own, lower = t.id[g.word[some]].astype(np.uint32), g.own[some].astype(np.uint32), t.count[k - 1][g.suffix[some]].astype(np.uint64)
            local = g.own[t.alone[k - 1][g.history]]  # what no bucket sees
            out.append((row["block"], STATS, int(row["block"] % model.buckets), _stats(local), None, None))
            if k > 2:  # the denominator of each history's next words one order below
                under = t.under[t.block.grams[k - 1].suffix[g.history[some]]]
            for n, (a, z) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                if a < z:
                    heads = np.flatnonzero(np.append(True, key[a + 1 : z] != key[a : z - 1]))
                    followers = np.diff(np.append(heads, z - a)).astype(np.uint32)
                    parts = [pack(followers)] + ([pack(under[a + heads].astype(np.uint64))] if k > 2 else [])
                    out.append((row["block"], k, n, pack_sorted(key[a + heads]), bundle(*parts), bundle(pack(word[a:z]), pack(own[a:z]), pack(lower[a:z]))))
        release()
        return message_rows(out)

    return found


def _answer(k: int, model: Model):
    """Adds a bucket's counts up. To each block: the totals of its n-grams, and of the histories that it backs off from what their weights need."""
    below, hot = model.levels[k - 2], model.levels[k - 2].hot

    def found(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["block"])
        bucket = rows[0]["bucket"]
        if rows[0]["kind"] == STATS:
            return message_rows([(None, STATS, bucket, np.sum([np.frombuffer(r["a"], np.int64) for r in rows], axis=0).tobytes(), None, None)])
        keys, words, owns, lowers, unders, heads = [], [], [], [], [], []
        for r in rows:
            key, parts = unpack_sorted(r["a"]), unbundle(r["b"])
            followers = unpack(parts[0], np.uint32).astype(np.int64)
            keys.append(np.repeat(key, followers))
            heads.append(followers)
            if k > 2:
                unders.append(np.repeat(unpack(parts[1], np.uint64), followers))
            word, own, lower = unbundle(r["c"])
            words.append(unpack(word, np.uint32))
            owns.append(unpack(own, np.uint32))
            lowers.append(unpack(lower, np.uint64).astype(np.int64))
        sizes = list(map(len, keys))
        key, word = np.concatenate(keys), np.concatenate(words)
        del keys, words
        if model.bits(k) <= 32:
            place = np.argsort(key << np.uint64(32) | word)  # the order among equals doesn't matter
        else:  # histories by rank
            place = np.argsort(key)
            rank = np.empty(len(key), np.uint64)
            rank[place] = np.cumsum(np.append(False, key[place][1:] != key[place][:-1])).astype(np.uint64)
            place = np.argsort(rank << np.uint64(32) | word)
        key, word = key[place], word[place]
        new = np.append(True, (key[1:] != key[:-1]) | (word[1:] != word[:-1]))
        begin = np.flatnonzero(new)
        total = np.add.reduceat(np.concatenate(owns)[place].astype(np.int64), begin)
        lower = below.mass(np.concatenate(lowers)[place[begin]])
        lower = lower / (np.concatenate(unders)[place[begin]] if k > 2 else max(model.tokens, 1))
        alone = np.diff(np.append(begin, len(key))) == 1
        key, word = key[begin], word[begin]
        first = np.append(True, key[1:] != key[:-1])
        history = np.cumsum(first) - 1
        shares = np.zeros((int(history[-1]) + 1, K + 2))
        shares_of(shares, history, total, lower)
        low = shares[:, :K].sum(axis=1) > 0
        of_history = np.add.reduceat(total, np.flatnonzero(first))
        entry = np.empty(len(place), np.int64)
        entry[place] = np.cumsum(new) - 1
        out, at = [], 0
        for r, n, followers in zip(rows, sizes, heads, strict=True):
            e = entry[at : at + n]
            at += n
            begins = np.cumsum(followers) - followers
            h = history[e[begins]]
            needed = (np.add.reduceat(total[e] == 0, begins) > 0) & (of_history[h] > 0)
            wanted = shares[h[needed]]
            numbers = bundle(pack(np.ascontiguousarray(wanted[:, : K + 1].T).ravel().astype(np.uint64)), pack(np.ascontiguousarray(wanted[:, K + 1])))
            out.append((r["block"], k, bucket, bundle(pack(total[e].astype(np.uint64)), np.packbits(alone[e]).tobytes(), np.packbits(low[h]).tobytes(), np.packbits(needed).tobytes(), numbers), None, None))
        seen = total > 0
        heads_ = np.flatnonzero(np.append(True, key[seen][1:] != key[seen][:-1])) if seen.any() else np.zeros(0, np.int64)
        out.append((None, TABLE + k, bucket, pack_sorted(key[seen][heads_]), pack(np.diff(np.append(heads_, int(seen.sum()))).astype(np.uint32)), bundle(pack(word[seen]), pack(total[seen].astype(np.uint64)))))
        some = np.flatnonzero(among(hot, key[first]))
        if len(some):
            out.append((None, SHARES, bucket, pack_sorted(key[first][some]), np.ascontiguousarray(shares[some]).tobytes(), None))
        release()
        return message_rows([*out, (None, STATS, bucket, _stats(total), None, None)])

    return found


_RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _finished(model: Model, order: int):
    """Each text's sums over its tokens, by the longest n-gram that ends there."""

    def found(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        columns: list[list] = [[] for _ in range(7)]
        told = answers.to_pylist()
        for row in blocks.to_pylist():
            t = Told(row, told, model, order)
            b = t.block
            p = np.log10(t.p[1])[b.word]
            for k in range(2, order + 1):
                some = b.at >= k - 1
                p[some] = np.log10(t.p[k])[b.grams[k].place[: int(some.sum())]]
            base, known = model.base(t.count[1])[b.word], (t.count[1] > 0)[b.word].astype(np.int64)
            p[b.first] = base[b.first] = known[b.first] = 0  # beginnings are no tokens
            sums = [np.add.reduceat(x, b.first).tolist() if len(b.first) else [] for x in (known, base, p)]
            for column, values in zip(columns, (b.docs, (~b.trains).tolist(), b.tokens.tolist(), sums[0], [model.levels[0].n] * len(b.docs), *sums[1:]), strict=True):
                column.extend(values)
        release()
        names = [x.split()[0] for x in _RESULT.split(", ")]
        types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return found


def _summed(batches):
    """Of the statistics of many buckets: sums, and the most of the last; texts."""
    total, texts = np.zeros(K + 4, np.int64), 0
    for b in batches:
        for row in _each(b):
            x = np.frombuffer(row["a"], np.int64)
            total[:-1] += x[:-1]
            total[-1] = max(total[-1], x[-1])
            texts += int(np.frombuffer(row["b"], np.int64)[0]) if row["b"] else 0
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([texts], pa.int64())], ["a", "texts"])


def _frequent(k: int, model: Model, least: float):
    """The permuted keys, as histories, of a table's n-grams of at least so many training tokens."""

    def rows(batches):
        for b in batches:
            for row in _each(b):
                if k == 1:
                    total = unpack(row["c"], np.uint64)
                    key = (2 + np.arange(len(total), dtype=np.uint64) * np.uint64(model.buckets)) + np.uint64(row["bucket"])
                else:
                    word, total = unbundle(row["c"])
                    word, total = unpack(word, np.uint32), unpack(total, np.uint64)
                    history = np.repeat(unpack_sorted(row["a"]), unpack(row["b"], np.uint32).astype(np.int64))
                    key = model.restored(history, k) * np.uint64(model.ids) + word
                some = model.permuted(key[total >= least], k + 1)
                yield pa.RecordBatch.from_arrays([pa.array(some.view(np.int64))], ["key"])

    return rows


def _share_rows(batches):
    for b in batches:
        for row in _each(b):
            key, shares = unpack_sorted(row["a"]), np.frombuffer(row["b"], np.float64).reshape(-1, K + 2)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *[pa.array(x) for x in np.ascontiguousarray(shares.T)]], ["key", *[f"s{n}" for n in range(K + 2)]])


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_col: str | None = None, order: int = ORDER) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows train the model where train_col says so (null: no); without one, those whose crc32(id as text) mod 5 is not 1,
    and those of null ids. Null texts count as empty, which have one token, the end. Repeated rows count each time. A text
    may have any length, and is worked on by one task. Other columns are not read. An empty table gives an empty result;
    with nothing to train on, every text's score is 0. The counts are stored by level and bucket in the shared folder.
    """
    if order not in (1, 2, 3):
        raise ValueError("orders 1 to 3")
    spark = docs.sparkSession
    buckets = shuffle_width(spark)
    trains = F.coalesce(F.col(train_col), F.lit(False)) if train_col else F.coalesce(crc_mod(F.col(id_col).cast("long"), 5) != 1, F.lit(True))
    blocks = bucketed(text_blocks(docs, id_col, text_col, trains), "text_blocks", "block", buckets)
    model, told = Model(buckets), None
    for k in range(1, order + 1):
        asked = blocks.mapInArrow(releasing(_ask_words(buckets)), ROW_COLUMNS) if k == 1 else blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_ask(k, model, order), ROW_COLUMNS)
        got = written(asked.groupBy("kind", "bucket").applyInArrow(_answer_words(buckets) if k == 1 else _answer(k, model), ROW_COLUMNS), f"katz-{k}", by="kind").select(*ROW_NAMES)
        counted, texts = np.zeros(K + 4, np.int64), 0
        for r in got.where(F.col("kind") == STATS).select("a", "b").mapInArrow(_summed, "a binary, texts long").collect():  # a row for each task
            x = np.frombuffer(r["a"], np.int64)
            counted[:-1] += x[:-1]
            counted[-1], texts = max(counted[-1], x[-1]), texts + r["texts"]
        level = Level(counted[:-1])
        model.levels.append(level)
        if k == 1:
            model.texts, model.ids = texts, max(2, int(counted[-1]))
            if model.ids ** max(1, order - 1) >= 1 << 64:
                raise ValueError("too many distinct words for histories of this length")
            model.words_known()
        else:
            shares = got.where(F.col("kind") == SHARES).select("a", "b").mapInArrow(_share_rows, "key long, " + ", ".join(f"s{n} double" for n in range(K + 2)))
            of = {r["key"]: list(r)[1:] for r in shares.groupBy("key").agg(*[F.sum(f"s{n}").alias(f"s{n}") for n in range(K + 2)]).collect()}  # at most HOT rows
            level.shares = np.array([of.get(x, [0.0] * (K + 2)) for x in model.levels[k - 2].hot.view(np.int64).tolist()]).reshape(-1, K + 2)
        if k < order:
            frequent = got.where(F.col("kind") == TABLE + k).select("bucket", "a", "b", "c").mapInArrow(_frequent(k, model, max(1.0, model.levels[0].n / HOT)), "key long")
            keys = np.array([r["key"] for r in frequent.collect()], np.int64).view(np.uint64)  # at most HOT rows
            level.hot = np.unique(np.concatenate([keys, model.permuted(np.array([BEGIN], np.uint64), 2)])) if k == 1 else np.unique(keys)
        mine = got.where(F.col("kind") == k)
        told = mine if told is None else told.unionByName(mine)
    return blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_finished(model, order), _RESULT)


def op10_katz(spark, sf_dir):
    return score(table(spark, sf_dir, "documents"))
