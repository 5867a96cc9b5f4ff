"""Language-model scoring with a weighted backoff automaton.

Smoothed n-grams are states. A state is a context of up to order - 1 tokens that
occurs in training; it has an arc for each token that followed it there, and one
failure arc to the context without its first token, weighted with the mass that
it leaves to unseen tokens. Texts are walked from left to right with the state
carried along: take the arc if there is one, else pay the failure weight and try
again from the shorter context; the empty context has arcs for all known words
and one for the unknown. The weights paid add up to the text's log10 probability.

Weights: at the empty context absolute discounting, whose discount comes from
counts of counts, leaves ``D * V / N`` to the unknown word; a longer context
mixes with the next shorter one with ``STRENGTH`` pseudo-counts, so an unseen
token there costs ``STRENGTH / (count + STRENGTH)``. An arc's weight holds the
shorter contexts' shares, so one arc is paid for each token and a failure weight
for each context that had none.

The walk runs over many stretches of the texts at once. A stretch starts a few
tokens early from the empty context: a state depends on the last order - 1 tokens
alone, so it is the right one by the time the stretch begins.

Scale: nothing of the model is broadcast. Documents are dealt into small groups.
A group sends the distinct n-grams it holds, with its training counts, to the
owner of their hash; it gets back which of them other groups hold too, and the
totals of those. N-grams of three tokens and more are sent only if other groups
hold all the pairs inside them; no other group can hold them otherwise, so its
own count is the total. A group then builds the part of the automaton that its
texts can reach. A frequent n-gram costs one entry for each group, however often
it occurs.

Cases: null or blank text is the end token alone; repeated rows are scored each;
with no training rows N = V = 0, and every token is unknown with probability 1.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, parts, remainder, tidy
from .text import mix, word_hashes

ORDER = 3
STRENGTH = 40.0
#: MB of input in one group of documents.
GROUP_MB = 4
BEGIN, END = np.uint64(0x1B5E9D3C7A2F4E61), np.uint64(0x7C3A1F5E9B2D4A83)
#: Stretches that are walked at once, and tokens of one at least.
LANES, STRETCH = 1 << 14, 32


@dataclass(frozen=True)
class Stats:
    """Of the training words: occurrences, kinds, kinds seen once and twice."""

    n: int = 0
    v: int = 0
    n1: int = 0
    n2: int = 0

    @property
    def discount(self) -> float:
        return self.n1 / (self.n1 + 2 * self.n2) if self.n1 and self.n2 else 0.5

    @property
    def unknown(self) -> float:
        return self.discount * self.v / self.n if self.n else 1.0


def distinct(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values in order, a place of each (any), and for each value its index; by an unstable sort, which is much faster."""
    order = np.argsort(v)
    v = v[order]
    new = np.ones(len(v), bool)
    np.not_equal(v[1:], v[:-1], out=new[1:])
    at = np.empty(len(v), np.int64)
    at[order] = np.cumsum(new) - 1
    return v[new], order[new], at


class Grams:
    """The n-grams of a group of texts, laid end to end with a begin and an end mark each.

    Places are those of the tokens that are predicted, so of all but the begin
    marks. ``keys[k]``: sorted hashes of the distinct (k+1)-grams; ``at[k]``:
    for each place the index of the one that ends there, -1 where the text has
    too few tokens before; ``first[k]``: a place for each.
    """

    def __init__(self, texts, train: np.ndarray, order: int):
        words = [word_hashes(t) for t in texts]
        self.size = np.array([len(w) + 1 for w in words], np.int64)
        stream = [x for w in words for x in (np.array([BEGIN]), w, np.array([END]))]
        self.tokens = np.concatenate(stream).astype(np.uint64) if stream else np.zeros(0, np.uint64)
        begin = np.cumsum(self.size + 1) - self.size - 1
        del words, stream
        depth = np.arange(len(self.tokens)) - np.repeat(begin, self.size + 1)
        self.where = np.flatnonzero(depth)  # of each place in ``tokens``
        self.depth = depth[self.where]
        self.train = np.repeat(train, self.size)
        self.begin, self.order = begin, order
        self.keys: list[np.ndarray] = []
        self.at: list[np.ndarray] = []
        self.first: list[np.ndarray] = []
        self.count: list[np.ndarray] = []

    def _hashes(self, k: int, places: np.ndarray) -> np.ndarray:
        """Hashes of the (k+1)-grams that end at ``places``."""
        end = self.where[places]
        if not k:
            return mix(self.tokens[end] + np.uint64(1))
        out = np.full(len(end), k + 1, np.uint64)
        for j in range(k, -1, -1):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + self.tokens[end - j])
        return out

    def collect(self, k: int, where: np.ndarray | None = None) -> None:
        """The distinct (k+1)-grams, of those places where ``where`` holds."""
        there = self.depth >= max(1, k)
        places = np.flatnonzero(there if where is None else there & where)
        keys, first, at = distinct(self._hashes(k, places))
        index = np.full(len(self.where), -1, np.int32)
        index[places] = at
        self.keys.append(keys)
        self.first.append(places[first])
        self.at.append(index)
        self.count.append(np.bincount(at, self.train[places], len(keys)).astype(np.int64))

    def shared(self, k: int, held: np.ndarray) -> np.ndarray:
        """Places of (k+1)-grams whose pairs are all held by other groups; ``held``: of each pair."""
        pair = np.where(self.at[1] >= 0, held[self.at[1]], False) if len(held) else np.zeros(len(self.where), bool)
        out = pair.copy()
        for j in range(1, k):
            out[j:] &= pair[:-j]
        return out & (self.depth >= k)


class Automaton:
    """States, arcs and failure links of a group's n-grams, given their training counts (``grams.count``).

    State 0 is the empty context; ``begin`` is the context of the begin mark.
    """

    def __init__(self, grams: Grams, stats: Stats, strength: float = STRENGTH):
        self.grams, self.stats = grams, stats
        ends = int(grams.count[0][np.searchsorted(grams.keys[0], mix(np.array([END + np.uint64(1)])))[0]]) if len(grams.keys[0]) else 0
        self.begin = 1 if ends else 0  # one begin for each end
        fail, mass = [np.zeros(1 + self.begin, np.int64)], [np.full(1 + self.begin, float(ends))]
        self.state: list[np.ndarray] = []  # of each n-gram: its own state, or that of its longest suffix that has one
        n = 1 + self.begin
        source, token, target, weight = [], [], [], []
        below = np.zeros(0)
        for k in range(grams.order):
            count, first = grams.count[k], grams.first[k]
            seen = count > 0
            suffix = grams.at[k - 1][first] if k else np.zeros(len(first), np.int64)
            if k:
                before = np.where(grams.depth[first] > 1, grams.at[k - 1][first - 1], -1)  # the context; -1: the begin mark
                held = np.where(before >= 0, grams.count[k - 1][before], ends)
                p = (count + strength * below[suffix]) / (held + strength)
                back = self.state[k - 1][suffix]
                here = np.where(before >= 0, self.state[k - 1][before], self.begin)
            else:
                p = (count - stats.discount) / max(1, stats.n)
                back = here = np.zeros(len(count), np.int64)
            state = back.copy()
            if k < grams.order - 1:
                state[seen] = n + np.arange(seen.sum())
                n += int(seen.sum())
                fail.append(back[seen])
                mass.append(count[seen].astype(float))
            self.state.append(state)
            below = p
            source.append(here[seen])
            token.append(grams.at[0][first[seen]].astype(np.int64))
            target.append(state[seen])
            weight.append(p[seen])
        self.fail = np.concatenate(fail)
        self.log_fail = np.log10(strength / (np.concatenate(mass) + strength))
        self.words = max(1, len(grams.keys[0]))
        key = np.concatenate(source) * self.words + np.concatenate(token)
        del source, token
        order = np.argsort(key)
        self.arc, self.target, self.log = key[order], np.concatenate(target)[order], np.log10(np.concatenate(weight)[order])
        self.first = np.searchsorted(self.arc, np.arange(n + 1) * self.words)  # a state's arcs start there
        self.root = np.full(self.words, -1)  # the empty context's arc for each word
        self.root[self.arc[: self.first[1]]] = np.arange(self.first[1])
        self.log_unknown = math.log10(stats.unknown)

    def arcs(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        """The arc that each state has for a token, -1 where it has none."""
        out = np.full(len(state), -1)
        low = self.first[state]
        n = self.first[state + 1] - low
        empty = state == 0
        out[empty] = self.root[token[empty]]
        some = np.flatnonzero((n > 0) & ~empty)
        low, n, want = low[some], n[some], (state * self.words + token)[some]
        # by halves within the state's arcs, which are few for nearly all states
        while len(some):
            half = n >> 1
            got = self.arc[low + half]
            hit = got == want
            out[some[hit]] = (low + half)[hit]
            up = got < want
            low, n = np.where(up, low + half + 1, low), np.where(up, n - half - 1, half)
            rest = np.flatnonzero((n > 0) & ~hit)
            some, low, n, want = some[rest], low[rest], n[rest], want[rest]
        return out

    def step(self, state: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after reading one token each, and what that cost."""
        cost, after = np.zeros(len(state)), np.zeros(len(state), np.int64)
        todo = np.arange(len(state))
        while len(todo):
            s = state[todo]
            i = self.arcs(s, token[todo])
            hit = i >= 0
            got = todo[hit]
            cost[got] += self.log[i[hit]]
            after[got] = self.target[i[hit]]
            lost = ~hit & (s == 0)
            cost[todo[lost]] += self.log_unknown
            rest = ~hit & ~lost
            todo = todo[rest]
            cost[todo] += self.log_fail[s[rest]]
            state[todo] = self.fail[s[rest]]
        return after, cost

    def walk(self) -> np.ndarray:
        """log10 probability of the token at each place: one pass from left to right over stretches of the texts."""
        g = self.grams
        n = len(g.tokens)
        ids = np.full(n, -1, np.int64)
        ids[g.where] = g.at[0]
        paid = np.zeros(n)
        length = max(STRETCH, -(-n // LANES))
        start = np.arange(0, n, length)
        state = np.zeros(len(start), np.int64)
        for j in range(1 - g.order, length):
            at = start + j
            live = np.flatnonzero((at >= 0) & (at < n))
            token = ids[at[live]]
            state[live[token < 0]] = self.begin
            live, token = live[token >= 0], token[token >= 0]
            state[live], cost = self.step(state[live], token)
            if j >= 0:
                paid[start[live] + j] = cost
        return paid[g.where]


def _planes(values: np.ndarray) -> bytes:
    """Whole numbers byte plane by byte plane: the high planes are nearly all 0."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.dtype.itemsize).T.tobytes()


def _from_planes(blob: bytes, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(width, -1).T).view(dtype).ravel()


def _packed(keys: np.ndarray) -> bytes:
    """Sorted keys as differences."""
    return _planes(np.diff(keys, prepend=np.uint64(0)))


def _unpacked(blob: bytes) -> np.ndarray:
    return np.cumsum(_from_planes(blob, np.uint64), dtype=np.uint64)


def _slices(keys: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(owner, from, to): keys with equal leading bits have one owner."""
    owner = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    edges = np.flatnonzero(np.diff(owner, prepend=-1))
    for a, b in zip(edges, [*edges[1:], len(keys)]):
        yield int(owner[a]), int(a), int(b)


#: A question: n-grams of order k + 1 that group p sends to owner q. An answer: which of them others hold, and their totals.
_ASKED = "k int, q long, p long, keys binary, counts binary"
_TOLD = "p long, k int, q long, held binary, total binary, n long, v long, n1 long, n2 long"


def _questions(p: int, k: int, keys: np.ndarray, counts: np.ndarray, bits: int) -> list[tuple]:
    return [(k, q, p, _packed(keys[a:b]), _planes(counts[a:b].astype(np.uint32))) for q, a, b in _slices(keys, bits)]


@tidy
def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """All questions to one owner at once; a last row, of group -1, counts what it owns."""
    keys = [_unpacked(x) for x in pdf["keys"]]
    counts = np.concatenate([_from_planes(x, np.uint32) for x in pdf["counts"]])
    known, at, times = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    total = np.bincount(at, counts, len(known)).astype(np.int64)
    k, q, row, out = int(pdf["k"].iloc[0]), int(pdf["q"].iloc[0]), 0, []
    for p, own in zip(pdf["p"], keys):
        mine = at[row : row + len(own)]
        held = times[mine] > 1
        out.append((int(p), k, q, np.packbits(held).tobytes(), _planes(total[mine[held]]), 0, 0, 0, 0))
        row += len(own)
    out.append((-1, k, q, b"", b"", int(total.sum()), int((total > 0).sum()), int((total == 1).sum()), int((total == 2).sum())))
    return pd.DataFrame(out, columns=["p", "k", "q", "held", "total", "n", "v", "n1", "n2"])


def _told(told: pd.DataFrame, k: int, keys: np.ndarray, counts: np.ndarray, bits: int) -> np.ndarray:
    """Which of the keys that were asked others hold; ``counts`` take their totals."""
    held = np.zeros(len(keys), bool)
    mine = told[told["k"] == k]
    span = {q: (a, b) for q, a, b in _slices(keys, bits)}
    for q, flags, total in zip(mine["q"], mine["held"], mine["total"]):
        a, b = span[q]
        held[a:b] = np.unpackbits(np.frombuffer(flags, np.uint8), count=b - a).astype(bool)
        counts[a + np.flatnonzero(held[a:b])] = _from_planes(total, np.int64)
    return held


def score(docs: DataFrame, train_if, order: int = ORDER, strength: float = STRENGTH, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Score every text with a model of the rows where ``train_if`` holds; ``order`` is 2 at least.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.
    """
    n = parts(docs, GROUP_MB)
    bits = max(1, math.ceil(math.log2(n)))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"), F.coalesce(train_if, F.lit(False)).alias("train"))
    # dealt by content, so that every pass sees the same groups
    rows = rows.withColumn("p", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("long")).repartition(n, "p")

    def start(pdf: pd.DataFrame) -> Grams:
        grams = Grams(pdf["text"], pdf["train"].to_numpy(np.float64), order)
        for k in range(2):
            grams.collect(k)
        return grams

    @tidy
    def ask(pdf: pd.DataFrame) -> pd.DataFrame:
        grams, p = start(pdf), int(pdf["p"].iloc[0])
        out = [x for k in range(2) for x in _questions(p, k, grams.keys[k], grams.count[k], bits)]
        return pd.DataFrame(out, columns=["k", "q", "p", "keys", "counts"])

    @tidy
    def ask_longer(pdf: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(pdf):
            grams, p = start(pdf), int(pdf["p"].iloc[0])
            held = _told(told, 1, grams.keys[1], grams.count[1], bits)
            for k in range(2, order):
                grams.collect(k, grams.shared(k, held))
                out += _questions(p, k, grams.keys[k], grams.count[k], bits)
        return pd.DataFrame(out, columns=["k", "q", "p", "keys", "counts"])

    def answered(asked: DataFrame, name: str) -> DataFrame:
        return materialize(asked.groupBy("k", "q").applyInPandas(_answer, _TOLD), name)

    told = answered(rows.groupBy("p").applyInPandas(ask, _ASKED), "ngram-totals")
    s = told.filter("p = -1 and k = 0").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "v", "n1", "n2")]).first()
    stats = Stats(s["n"], s["v"], s["n1"], s["n2"])
    told = told.filter("p >= 0").select("p", "k", "q", "held", "total")
    if order > 2:
        pairs = told.filter("k = 1")
        longer = answered(rows.groupBy("p").cogroup(pairs.groupBy("p")).applyInPandas(ask_longer, _ASKED), "ngram-totals")
        told = told.unionByName(longer.filter("p >= 0").select("p", "k", "q", "held", "total"))

    @tidy
    def finish(pdf: pd.DataFrame, totals: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(pdf):
            grams = start(pdf)
            _told(totals, 0, grams.keys[0], grams.count[0], bits)
            held = _told(totals, 1, grams.keys[1], grams.count[1], bits)
            for k in range(2, order):
                grams.collect(k)
                asked = np.flatnonzero(grams.shared(k, held)[grams.first[k]])
                counts = grams.count[k][asked]
                _told(totals, k, grams.keys[k][asked], counts, bits)
                grams.count[k][asked] = counts
            logp = Automaton(grams, stats, strength).walk()
            seen = grams.count[0][grams.at[0]]
            base = np.log10((grams.count[0] + 1.0) / (stats.n + stats.v + 1.0))[grams.at[0]]
            edge = np.cumsum(grams.size)
            for i, train, a, b in zip(pdf["doc_id"], pdf["train"], (edge - grams.size).tolist(), edge.tolist()):
                out.append((i, not train, b - a, int((seen[a:b] > 0).sum()), stats.n, math.fsum(base[a:b].tolist()), math.fsum(logp[a:b].tolist())))
        df = pd.DataFrame(out, columns=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
        df["doc_id"] = df["doc_id"].astype("Int64")
        return df

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return rows.groupBy("p").cogroup(told.groupBy("p")).applyInPandas(finish, schema)


def by_remainder(modulus: int, held: int, id_col: str = "doc_id"):
    """Training rows: those whose crc32(id) remainder is not ``held``."""
    return remainder(F.col(id_col), modulus) != held
