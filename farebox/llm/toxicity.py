"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A text is cut into overlapping windows of words; all windows are scored and the largest score
is the text's. Each word enters with word inputs (how much its presence speaks for the label,
plus a fixed random code) and character inputs (the same of its letter grams). Both
directions run over the window, attention weighs the states, a logistic unit gives the score.

The network is trained by back-propagation through time with Adam on windows of a bounded
sample: at most `per_class` labelled texts per class, of at most `max_chars` characters. Labels
mark texts, not windows: a positive text lends its label to its strongest window, chosen by the
word evidence at first and by the network itself afterwards.

Defined results: a null or empty text is one empty window and scores the network's value for it; when the
sample lacks a class, every score is the share of positives in it. Repeated rows score alike,
extra columns pass through.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from farebox.llm.common import fresh, hash_share

SPAN, STEP = 24, 16  # words of a window, and between the starts of two
HIDDEN = 8
BUCKETS = 1 << 18
GRAMS = (3, 5, 7)  # lengths of the letter grams, word ends included
CODE = 5
PER_CLASS, MAX_CHARS = 1_500, 20_000
#: Words a worker remembers the inputs of.
KNOWN = 200_000
#: Windows scored at once: the arrays of a step stay in a core's cache. Windows of one pass in training.
BATCH, PASS = 1_024, 8_192

#: Characters read at once.
SLAB = 1 << 18

_word = re.compile(r"[^\W\d_]+")
_gap = re.compile(r"[\W\d_]")


def words_of(text: str | None) -> list[str]:
    return _word.findall(text.lower()) if text else []


def starts(n: int) -> range:
    """Starts of the windows that cover n words; one window if there is none."""
    return range(0, max(n - (SPAN - STEP), 1), STEP)


def _hash(s: str) -> int:
    return zlib.crc32(s.encode("utf-8", "replace"))


def _codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def gram_buckets(words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each gram length: the buckets of all words' grams, and where each word's grams begin.

    A word shorter than the length is one gram. Hashes are sums of code points times powers, taken over all words at once.
    """
    width = np.array([len(w) + 2 for w in words])
    pad = GRAMS[-1] - 1
    codes = _codes("".join(f"<{w}>" + "\0" * pad for w in words)).astype(np.uint32)
    begin = np.cumsum(width + pad) - (width + pad)
    offset = np.arange(len(codes)) - np.repeat(begin, width + pad)
    left = np.repeat(width, width + pad) - offset  # characters from here to the end of the word
    total, power, out = np.zeros(len(codes), np.uint32), 1, []
    for j in range(GRAMS[-1]):
        total[:len(codes) - j] += codes[j:] * np.uint32(power)
        power = power * 0x01000193 % (1 << 32)
        if j + 1 in GRAMS:
            at = np.flatnonzero((left >= j + 1) | (offset == 0))
            mixed = total[at] * np.uint32(0x9E3779B1)
            out.append(((mixed ^ (mixed >> np.uint32(15))) % np.uint32(BUCKETS), np.searchsorted(at, begin)))
    return out


def inputs(words: list[str], word_evidence: np.ndarray, gram_evidence: np.ndarray) -> np.ndarray:
    h = np.array([_hash(w) for w in words], dtype=np.int64)
    out = np.empty((len(words), 4 + CODE), dtype=np.float32)
    out[:, 0] = word_evidence[h % BUCKETS]
    total, count, most = np.zeros(len(words)), np.zeros(len(words)), np.full(len(words), -np.inf)
    for buckets, begin in gram_buckets(words):
        ev = gram_evidence[buckets]
        total += np.add.reduceat(ev, begin)
        np.maximum(most, np.maximum.reduceat(ev, begin), out=most)
        count += np.diff(np.append(begin, len(ev)))
    out[:, 1], out[:, 2] = total / count, most
    out[:, 3] = np.minimum([len(w) for w in words], 20) / 10 - 1
    out[:, 4:] = (((h[:, None] >> (4 * np.arange(CODE))) & 15) / 7.5 - 1) * 0.2
    return out


@cache
def _in_word() -> np.ndarray:
    """Of every code point whether `words_of` takes it as part of a word."""
    return np.array([(c := chr(i)).isalnum() and not c.isdecimal() for i in range(0x110000)])


#: The base of the hash of words seen in a text, and its inverse modulo 2^64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


@cache
def _powers(base: int) -> np.ndarray:
    """base^0, base^1, ... modulo 2^64, for the places of a slab."""
    out = np.ones(2 * SLAB, np.uint64)
    with np.errstate(over="ignore"):
        np.multiply.accumulate(np.full(len(out) - 1, base, np.uint64), out=out[1:])
    return out


def _cuts(text: str) -> Iterator[str]:
    """A text in parts of at most two slabs, cut where no word is; a longer word is cut through."""
    at = 0
    while len(text) - at > SLAB:
        gap = _gap.search(text, at + SLAB, at + 2 * SLAB - 1)
        end = gap.start() + 1 if gap else at + 2 * SLAB
        yield text[at:end]
        at = end
    yield text[at:]


@dataclass
class Network:
    words: np.ndarray  # evidence per word bucket
    grams: np.ndarray  # evidence per gram bucket
    p: dict[str, np.ndarray] = field(default_factory=dict)
    constant: float | None = None
    rows: dict[int, int] = field(default_factory=dict)  # hash of a word: its row
    tables: np.ndarray | None = None  # projected inputs of the known words, one table per direction; row 0 is padding

    def inputs(self, words: list[str]) -> np.ndarray:
        """One row per word: evidence of the word and of its grams, its length, its code."""
        return inputs(words, self.words, self.grams)

    def learn(self, hashes: list[int], words: list[str]) -> None:
        """Add rows for new words."""
        if self.tables is None:
            self.tables = np.zeros((2, 1024, 3 * HIDDEN), dtype=np.float32)
            self.tables[:, 0, :HIDDEN] = -1e4  # the update gate of padding is shut: it keeps the state
        have = len(self.rows) + 1
        self.rows.update(zip(hashes, range(have, have + len(words))))
        while have + len(words) > self.tables.shape[1]:
            self.tables = np.concatenate([self.tables, np.zeros_like(self.tables)], axis=1)
        if words:
            x = self.inputs(words)
            for side, d in enumerate("fb"):
                # gates enter as tanh(x / 2), so the half is taken here
                self.tables[side, have:have + len(words)] = (x @ self.p["W" + d] + self.p["b" + d]) * _HALF

    def numbers(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers of the words of all parts (lower case, two slabs in all at most), and the number of words of each part."""
        joined = "\n".join(parts)
        codes = _codes(joined)
        inside = np.zeros(len(codes) + 2, dtype=bool)
        inside[1:-1] = _in_word()[codes]
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        begin, end = edge[::2], edge[1::2]
        with np.errstate(over="ignore"):
            total = np.zeros(len(codes) + 1, np.uint64)
            np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _powers(_BASE)[:len(codes)], out=total[1:])
            h = (total[end] - total[begin]) * _powers(_INVERSE)[begin]
        distinct, first, at = np.unique(h, return_index=True, return_inverse=True)
        names = distinct.tolist()
        found = [self.rows.get(x) for x in names]
        new = [i for i, f in enumerate(found) if f is None]
        if new or self.tables is None:
            self.learn([names[i] for i in new], [joined[begin[first[i]]:end[first[i]]] for i in new])
            found = [self.rows[x] for x in names]
        places = np.cumsum([0] + [len(p) + 1 for p in parts])
        return np.array(found, dtype=np.int32)[at], np.diff(np.searchsorted(begin, places))

    def forget(self) -> None:
        self.rows.clear()
        self.tables = None

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        best = np.full(len(texts), -np.inf)
        run = Scorer(self.p)
        held: list[tuple[int, str]] = []
        size = 0

        def flush() -> None:
            if held:
                ids, counts = self.numbers([t for _, t in held])
                self._windows(run, best, np.array([i for i, _ in held]), ids, counts)
            held.clear()

        for i, text in enumerate(texts):
            text = (text or "").lower()
            if size + len(text) >= SLAB:
                flush()
                size = 0
                if len(self.rows) > KNOWN:
                    self.forget()
            if len(text) > SLAB:  # a long text is read in parts, its windows go on over the cuts
                ids = np.concatenate([self.numbers([part])[0] for part in _cuts(text)])
                self._windows(run, best, np.array([i]), ids, np.array([len(ids)]))
            else:
                held.append((i, text))
                size += len(text) + 1
        flush()
        return 1 / (1 + np.exp(-np.clip(best, -40, 40)))

    def _windows(self, run: Scorer, best: np.ndarray, owner: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Raise the best value of each text to that of its windows."""
        first = np.cumsum(counts) - counts
        many = -(-np.maximum(counts - (SPAN - STEP), 1) // STEP)  # as in `starts`
        text = np.repeat(np.arange(len(counts)), many)
        begin = first[text] + STEP * (np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many))
        ids = np.append(ids, np.int32(0))
        for b in range(0, len(text), BATCH):
            of = text[b:b + BATCH]
            at = begin[b:b + BATCH, None] + np.arange(SPAN)
            rows = np.where(at < (first + counts)[of][:, None], ids[np.minimum(at, len(ids) - 1)], 0)
            np.maximum.at(best, owner[of], run.logits(self.tables, rows))


#: A sigmoid is (1 + tanh(x / 2)) / 2: the inputs of the two gates are halved, those of the candidate are not.
_HALF = np.array([0.5] * (2 * HIDDEN) + [1.0] * HIDDEN, dtype=np.float32)


class Scorer:
    """The network's value of many windows: `forward` without what only training needs.

    Both directions are one batched product a step, arrays are made once, and of the states only
    the two numbers are kept that attention and the logistic unit take from them.
    """

    def __init__(self, p: dict[str, np.ndarray], batch: int = BATCH):
        h = HIDDEN
        u = np.stack([p["Uf"], p["Ub"]]) * _HALF
        self.gate_u, self.new_u = np.ascontiguousarray(u[:, :, :2 * h]), np.ascontiguousarray(0.5 * u[:, :, 2 * h:])
        self.heads = np.ascontiguousarray(np.stack([np.stack([p["va"], p["wo"]], axis=1)[:h], np.stack([p["va"], p["wo"]], axis=1)[h:]]))
        self.bias = float(p["bo"][0])
        self.h, self.made = h, {}

    def _arrays(self, n: int) -> list[np.ndarray]:
        if n not in self.made:
            if len(self.made) > 1:
                self.made.clear()
            h = self.h
            self.made[n] = [np.empty(shape, np.float32) for shape in
                            ((2, n, 3 * h), (2, n, 2 * h), (2, n, h), (2, n, h), (2, n, h), (2, SPAN, n, 2))]
        return self.made[n]

    def logits(self, tables: np.ndarray, ids: np.ndarray) -> np.ndarray:
        h, n = self.h, len(ids)
        x, gates, state, reset, new, heads = self._arrays(n)
        state[:] = 0
        by_step = np.ascontiguousarray(ids.T)
        for s in range(SPAN):
            back = SPAN - 1 - s
            np.take(tables[0], by_step[s], axis=0, out=x[0], mode="clip")
            np.take(tables[1], by_step[back], axis=0, out=x[1], mode="clip")
            np.matmul(state, self.gate_u, out=gates)
            gates += x[:, :, :2 * h]
            np.tanh(gates, out=gates)
            gates += 1
            np.multiply(gates[:, :, h:], state, out=reset)
            np.matmul(reset, self.new_u, out=new)
            new += x[:, :, 2 * h:]
            np.tanh(new, out=new)
            new -= state
            new *= gates[:, :, :h]
            new *= 0.5
            state += new
            found = np.matmul(state, self.heads)
            heads[0, s], heads[1, back] = found[0], found[1]
        both = heads[0] + heads[1]
        attend, value = both[:, :, 0], both[:, :, 1]
        real = by_step > 0
        attend = np.where(real, attend, np.float32(-30))
        a = np.exp(attend - attend.max(axis=0))
        a /= a.sum(axis=0)
        return np.where(real[0], (a * value).sum(axis=0), 0) + self.bias


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def _direction(xs: np.ndarray, U: np.ndarray, mask: np.ndarray, order: range):
    """States and gates of one direction; a masked step keeps the state."""
    n, h = len(xs), HIDDEN
    state = np.zeros((n, h), dtype=np.float32)
    states = np.zeros((n, SPAN, h), dtype=np.float32)
    kept = {}
    for t in order:
        m = mask[:, t:t + 1]
        gates = xs[:, t, :2 * h] + state @ U[:, :2 * h]
        z, r = np.split(_sigmoid(gates), 2, axis=1)
        c = np.tanh(xs[:, t, 2 * h:] + (r * state) @ U[:, 2 * h:])
        kept[t] = state, z, r, c
        state = state + m * z * (c - state)
        states[:, t] = state
    return states, kept


def forward(p: dict, xf: np.ndarray, xb: np.ndarray, mask: np.ndarray):
    sf, kf = _direction(xf + p["bf"], p["Uf"], mask, range(SPAN))
    sb, kb = _direction(xb + p["bb"], p["Ub"], mask, range(SPAN - 1, -1, -1))
    both = np.concatenate([sf, sb], axis=2)
    attend = both @ p["va"]
    attend = np.where(mask > 0, attend, -30.0)
    a = np.exp(attend - attend.max(axis=1, keepdims=True))
    a /= a.sum(axis=1, keepdims=True)
    pooled = (a[:, :, None] * both).sum(axis=1) * mask[:, :1]
    return pooled @ p["wo"] + p["bo"][0], (kf, kb, both, a, pooled)


def _back_direction(d_states, kept, U, mask, order):
    """Gradients of the inputs and of U."""
    h = HIDDEN
    dx = np.zeros((len(mask), SPAN, 3 * h), dtype=np.float32)
    dU = np.zeros_like(U)
    d_state = np.zeros((len(mask), h), dtype=np.float32)
    for t in reversed(order):
        state, z, r, c = kept[t]
        m = mask[:, t:t + 1]
        d = d_state + d_states[:, t]
        dc = d * m * z * (1 - c * c)
        dz = d * m * (c - state) * z * (1 - z)
        d_rs = dc @ U[:, 2 * h:].T
        dr = d_rs * state * r * (1 - r)
        gates = np.concatenate([dz, dr], axis=1)
        dU[:, :2 * h] += state.T @ gates
        dU[:, 2 * h:] += (r * state).T @ dc
        d_state = d * (1 - m * z) + d_rs * r + gates @ U[:, :2 * h].T
        dx[:, t, :2 * h], dx[:, t, 2 * h:] = gates, dc
    return dx, dU


def gradients(p: dict, x: np.ndarray, mask: np.ndarray, label: np.ndarray, weight: np.ndarray) -> dict:
    xf, xb = x @ p["Wf"], x @ p["Wb"]
    logit, (kf, kb, both, a, pooled) = forward(p, xf, xb, mask)
    d = ((_sigmoid(logit) - label) * weight / len(label)).astype(np.float32)
    some = mask[:, :1]
    g = {"wo": pooled.T @ d, "bo": np.array([d.sum()], dtype=np.float32)}
    d_pooled = d[:, None] * p["wo"][None, :] * some
    d_a = (both * d_pooled[:, None, :]).sum(axis=2)
    d_e = a * (d_a - (a * d_a).sum(axis=1, keepdims=True))
    g["va"] = np.einsum("nt,nth->h", d_e, both)
    d_both = a[:, :, None] * d_pooled[:, None, :] + d_e[:, :, None] * p["va"]
    dxf, g["Uf"] = _back_direction(d_both[:, :, :HIDDEN], kf, p["Uf"], mask, range(SPAN))
    dxb, g["Ub"] = _back_direction(d_both[:, :, HIDDEN:], kb, p["Ub"], mask, range(SPAN - 1, -1, -1))
    for name, dx in (("f", dxf), ("b", dxb)):
        g["W" + name] = np.einsum("nti,nth->ih", x, dx)
        g["b" + name] = dx.sum(axis=(0, 1))
    return g


def _distinct_grams(words: set[str]) -> np.ndarray:
    return np.unique(np.concatenate([b for b, _ in gram_buckets(sorted(words))])) if words else np.zeros(0, int)


def _evidence(items: list[np.ndarray], label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How much a bucket's presence speaks for the label, shrunk where it is rare; -1 to 1.

    The second array has a row per label: the evidence without one text of that label, which is
    what a text of the sample may see of its own words.
    """
    count = np.zeros((2, BUCKETS))
    for own, y in zip(items, label):
        count[y, own] += 1
    total = np.array([(label == 0).sum(), (label == 1).sum()])

    def odds(no: np.ndarray, yes: np.ndarray) -> np.ndarray:
        no, yes = np.maximum(no, 0), np.maximum(yes, 0)
        raw = np.log((yes + 0.5) / (total[1] + 1)) - np.log((no + 0.5) / (total[0] + 1))
        return (np.clip(raw * np.minimum(1.0, (yes + no) / 8), -4, 4) / 4).astype(np.float32)

    no, yes = count
    return odds(no, yes), np.stack([odds(no - 1, yes), odds(no, yes - 1)])


def fit(texts: list[str], label: list[int], rounds: int = 3, epochs: int = 4, per_text: int = 3,
        least_steps: int = 100, seed: int = 7) -> Network:
    y = np.asarray(label, dtype=int)
    net = Network(np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.float32))
    if len(y) == 0 or y.min() == y.max():
        net.constant = float(y.mean()) if len(y) else 0.0
        return net
    words = [words_of(t) for t in texts]
    net.words, own_words = _evidence([np.unique([_hash(w) % BUCKETS for w in set(ws)]).astype(int) for ws in words], y)
    net.grams, own_grams = _evidence([_distinct_grams(set(ws)) for ws in words], y)
    rng = np.random.default_rng(seed)
    size, h = 4 + CODE, HIDDEN

    def draw(*shape):
        return rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)

    net.p = p = {"Wf": draw(size, 3 * h), "Wb": draw(size, 3 * h), "Uf": draw(h, 3 * h), "Ub": draw(h, 3 * h),
                 "bf": np.zeros(3 * h, np.float32), "bb": np.zeros(3 * h, np.float32),
                 "va": draw(2 * h, 1)[:, 0], "wo": draw(2 * h, 1)[:, 0], "bo": np.zeros(1, np.float32)}
    # all windows of the sample; a text's own label is left out of the evidence it sees
    xs, masks, owner = [], [], []
    for i, ws in enumerate(words):
        each = {w: k for k, w in enumerate(dict.fromkeys(ws))}
        x = inputs(list(each), own_words[y[i]], own_grams[y[i]]) if ws else np.zeros((0, size), np.float32)
        x = x[[each[w] for w in ws]]
        for s in starts(len(ws)):
            part = x[s:s + SPAN]
            xs.append(np.vstack([part, np.zeros((SPAN - len(part), size), np.float32)]))
            masks.append(np.arange(SPAN) < len(part))
            owner.append(i)
    x_all, m_all, owner = np.stack(xs), np.stack(masks).astype(np.float32), np.array(owner)
    first_of = np.searchsorted(owner, np.arange(len(words) + 1))
    first = {k: np.zeros_like(v) for k, v in p.items()}
    second = {k: np.zeros_like(v) for k, v in p.items()}
    steps = 0
    for turn in range(rounds):
        if turn:
            power = np.concatenate([forward(p, x_all[b:b + PASS] @ p["Wf"], x_all[b:b + PASS] @ p["Wb"],
                                            m_all[b:b + PASS])[0] for b in range(0, len(x_all), PASS)])
        else:
            power = x_all[:, :, 0].max(axis=1)
        chosen = set()
        for i in range(len(words)):
            mine = np.arange(first_of[i], first_of[i + 1])
            if y[i] or turn:  # the strongest window: of a positive text its reason, of a negative one the error
                chosen.update(mine[np.argsort(-power[mine])[:1 if y[i] else 3]].tolist())
            if not y[i]:
                chosen.update(rng.choice(mine, size=min(per_text, len(mine)), replace=False).tolist())
        pick = np.array(sorted(chosen))
        lab = y[owner[pick]].astype(np.float32)
        weight = np.where(lab > 0, 0.25 * len(lab) / max(lab.sum(), 1), 0.75 * len(lab) / max((1 - lab).sum(), 1))
        for _ in range(max(epochs, -(-least_steps // -(-len(pick) // 512)))):
            mixed = rng.permutation(len(pick))
            for b in range(0, len(mixed), 512):
                rows = mixed[b:b + 512]
                g = gradients(p, x_all[pick[rows]], m_all[pick[rows]], lab[rows], weight[rows])
                steps += 1
                for k in p:
                    first[k] = 0.9 * first[k] + 0.1 * g[k]
                    second[k] = 0.999 * second[k] + 0.001 * g[k] ** 2
                    p[k] -= (0.01 * (first[k] / (1 - 0.9 ** steps))
                             / (np.sqrt(second[k] / (1 - 0.999 ** steps)) + 1e-7)).astype(np.float32)
    return net


def train(docs: DataFrame, labels: DataFrame, where: Column, per_class: int = PER_CLASS,
          max_chars: int = MAX_CHARS) -> Network:
    """Fit on labelled rows that satisfy `where`: at most about `per_class` per class, drawn by a hash of doc_id."""
    rows = (labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & where)
            .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    sizes = rows.groupBy("toxic").agg(F.count("*").alias("_n"))  # two rows
    drawn = (rows.join(F.broadcast(sizes), "toxic")
             .where(hash_share(F.col("doc_id"), "toxicity") * F.col("_n") < per_class)
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(3 * per_class).select("doc_id", "toxic"))
    sample = (docs.select("doc_id", "text").where(F.char_length("text") <= max_chars)
              .join(F.broadcast(drawn), "doc_id").toPandas())  # at most 3 * per_class ids
    sample = sample.sort_values(["doc_id", "text"])
    return fit(sample["text"].tolist(), sample["toxic"].tolist())


def score(docs: DataFrame, net: Network, text: str = "text") -> DataFrame:
    """`docs` with the column `toxicity`, the score of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # fixed size: buckets and weights

    @F.pandas_udf(T.DoubleType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(shared.value.scores(texts.tolist()), dtype="float64")

    (name,) = fresh(docs, "toxicity")
    return docs.withColumn(name, run.asNondeterministic()(F.col(text)))
