"""Merge-type subword encoding by a prefix table, and decoding.

Greedy merging has two properties (every adjacent pair of a valid encoding is itself a valid
encoding, and the encoding of a prefix ends in one token only) that allow one pass over the
text instead of a merge loop: for each position the table keeps the one last token of the
encoding of the prefix that ends there. An automaton over all pieces, whose steps are kept as
they are met, names the candidates, a test of the pair (token kept at the candidate's start,
candidate) picks the right one. The ids are then read off backwards.

Text is cut where no piece reaches across (before a run of space marks, round line ends, between
a word and its punctuation), which changes no encoding; equal stretches are then encoded once
per cache. New ones are encoded in order, so that each goes on from the prefix it shares with
the one before: the table of a prefix does not depend on what follows.

Defined results: a null text counts as empty; an empty text has no ids and decodes to ''.
Texts of any length take linear time. Rows, ties and extra columns pass through untouched.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from farebox.llm.common import fresh

SPACE = "▁"
#: Entries of one worker's caches of stretches, pairs and steps; beyond it they start anew.
CACHE = 400_000
#: Stretches of more characters are not kept.
LONG = 64
#: Characters of texts whose stretches are looked up together; a longer text goes by itself.
TOGETHER = 1 << 21


class Vocabulary:
    """Pieces, scores and byte ids of a merge-type model."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces: list[str] = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.score: list[float] = [model.get_score(i) for i in range(len(self.pieces))]
        self.special = {i for i in range(len(self.pieces)) if model.is_control(i) or model.is_unknown(i)}
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if model.is_byte(i)}
        self.id_byte = {i: b for b, i in self.byte_ids.items()}
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in self.special and i not in self.id_byte}


class Encoder:
    def __init__(self, path: str):
        import ahocorasick

        self.vocab = v = Vocabulary(path)
        order = {s: k for k, s in enumerate(sorted(set(v.score), reverse=True))}
        self.rank = [order[s] for s in v.score]  # when a piece is made; characters are there from the start
        self.split: dict[int, tuple[int, int]] = {}  # the two that made it
        self.automaton = ahocorasick.Automaton()
        for piece, i in v.ids.items():
            if len(piece) == 1:
                self.rank[i] = -1
            else:
                parts, last = self._merged(piece)
                if parts != [piece] or not all(p in v.ids for p in last):
                    continue  # no merge order ever makes it
                self.split[i] = v.ids[last[0]], v.ids[last[1]]
            self.automaton.add_word(piece, (len(piece), i))
        self.stretch = re.compile(self._cuts())
        self._length = [len(p) for p in v.pieces]
        self._number = [str(i) for i in range(len(v.pieces))]
        self._text = ["" if i in v.special else p for i, p in enumerate(v.pieces)]
        self._pairs: dict[int, bool] = {}
        self._steps: dict[str, tuple[str, tuple[tuple[int, int], ...]]] = {}
        self._stretches: dict[str, tuple[int, ...]] = {}
        self._written: dict[str, str] = {}
        self._older: dict[str, str] = {}
        self._decoded: dict[str, str] = {}

    def _cuts(self) -> str:
        """A pattern of stretches that no piece leaves: cut round line ends, before a run of space
        marks, and between a letter and a mark that no piece appends to letters."""
        pieces = [p for p in self.vocab.ids if len(p) > 1]
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in pieces):
            return r"[\s\S]+"
        letter = re.compile(r"[^\W\d_]")
        joined = {b for p in pieces for a, b in zip(p, p[1:]) if letter.match(a)}
        marks = re.escape("".join(chr(c) for c in range(33, 127) if chr(c) not in joined))
        ends = rf"(?=[{SPACE}\n{marks}]|\Z)"
        return rf"\n|{SPACE}*[^\W\d_]++{ends}|{SPACE}*[^{SPACE}\n]+|{SPACE}+"

    def _merged(self, text: str) -> tuple[list[str], tuple[str, ...]]:
        """The definition: merge the best-scored adjacent pair, the left one of equals, until none is left.

        Returns the parts and the last pair merged.
        """
        ids, score = self.vocab.ids, self.vocab.score
        parts: list[str | None] = list(text)
        after = list(range(1, len(parts) + 1))
        before = list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, str, int]] = []
        last: tuple[str, ...] = ()

        def offer(a: int) -> None:
            b = after[a]
            if b < len(parts):
                joint = parts[a] + parts[b]
                if joint in ids:
                    heapq.heappush(heap, (-score[ids[joint]], a, joint, b))

        for a in range(len(parts) - 1):
            offer(a)
        while heap:
            _, a, joint, b = heapq.heappop(heap)
            if parts[a] is None or parts[b] is None or after[a] != b or parts[a] + parts[b] != joint:
                continue
            last = parts[a], parts[b]
            parts[a], parts[b] = joint, None
            after[a] = after[b]
            if after[a] < len(parts):
                before[after[a]] = a
            if before[a] >= 0:
                offer(before[a])
            offer(a)
        return [p for p in parts if p is not None], last

    def _compatible(self, left: int, right: int) -> bool:
        """Whether merging leaves these two side by side.

        The merges that made both are undone, the latest first. At no moment may a merge across
        the border have been due before the next one that really happened: by a better score, or
        by the same score further left.
        """
        pair = left << 32 | right
        ids, pieces, rank, split = self.vocab.ids, self.vocab.pieces, self.rank, self.split
        due, known = float("inf"), True
        while True:
            across = ids.get(pieces[left] + pieces[right])
            if across is not None and rank[across] < due:
                known = False
                break
            if rank[left] > rank[right]:
                due, left = rank[left], split[left][1]
            elif rank[right] >= 0:
                due, right = rank[right] + 0.5, split[right][0]
            else:
                break
        if len(self._pairs) >= CACHE:
            self._pairs.clear()
        self._pairs[pair] = known
        return known

    def _step(self, key: str) -> tuple[str, tuple[tuple[int, int], ...]]:
        """The automaton's state after `key`, a state and the next character, and the pieces that end there.

        A state is the longest end of what was read that begins a piece; the longest piece comes first.
        """
        state = key
        while state and not self.automaton.match(state):
            state = state[1:]
        ends = (self.automaton.get(state[k:], None) for k in range(len(state)))
        if len(self._steps) >= CACHE:
            self._steps.clear()
        self._steps[key] = found = state, tuple(e for e in ends if e is not None)
        return found

    def _extend(self, text: str, at: int, last: list[int], states: list[str]) -> None:
        """The prefix table and the states of `text`, of which those up to `at` are there."""
        steps, pairs = self._steps, self._pairs
        del last[at + 1:], states[at + 1:]
        state = states[at]
        for end in range(at + 1, len(text) + 1):
            key = state + text[end - 1]
            state, ends = steps.get(key) or self._step(key)
            states.append(state)
            kept = -1  # a character without a piece
            for length, token in ends:
                left = last[end - length]
                if left >= 0:
                    fits = pairs.get(left << 32 | token)
                    if not (self._compatible(left, token) if fits is None else fits):
                        continue
                kept = token
                break
            last.append(kept)

    def _read(self, text: str, last: list[int]) -> list[int]:
        """The ids of `text`, read backwards from its prefix table."""
        out: list[int] = []
        end, length = len(text), self._length
        while end:
            token = last[end]
            if token >= 0:
                out.append(token)
                end -= length[token]
            elif text[end - 1] in self.vocab.ids:
                raise ValueError("the vocabulary's merges do not fit a prefix table")
            else:
                out.extend(self.vocab.byte_ids[b] for b in reversed(text[end - 1].encode("utf-8")))
                end -= 1
        out.reverse()
        return out

    def encode_stretches(self, texts: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        """Every stretch with its ids, in order; each goes on from the prefix shared with the one before."""
        before, last, states = "", [-1], [""]
        for text in sorted(texts):
            at = min(len(before), len(text), LONG)
            while not text.startswith(before[:at]):
                at -= 1
            self._extend(text, at, last, states)
            yield text, self._read(text, last)
            before = text

    def encode_stretch(self, text: str) -> tuple[int, ...]:
        ((_, ids),) = self.encode_stretches([text])
        return tuple(ids)

    def stretches(self, text: str | None) -> list[str]:
        """The text with its space marks, cut where no piece reaches across."""
        return self.stretch.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        cache = self._stretches
        for part in self.stretches(text):
            ids = cache.get(part)
            if ids is None:
                ids = self.encode_stretch(part)
                if len(part) <= LONG:
                    if len(cache) >= CACHE:
                        cache.clear()
                    cache[part] = ids
            out.extend(ids)
        return out

    def written(self, texts: list[str | None]) -> Iterator[tuple[str, str]]:
        """The ids of each text, joined by commas, and the text decoded from them.

        The ids of a stretch are kept, and what they decode to where that is not the stretch
        itself. Half the cache holds the latest, half those before; what is used again moves up.
        """
        rows = [self.stretches(t) for t in texts]
        new = set().union(*rows).difference(self._written)
        if len(self._written) + len(new) > CACHE // 2:
            self._older, self._written = self._written, {}
            self._decoded = {p: t for p, t in self._decoded.items() if p in self._older}
            new.update(*rows)
        kept, older, number, surface = self._written, self._older, self._number, self._text
        kept.update((p, older[p]) for p in new.intersection(older))
        bytes_, other = self.vocab.id_byte.keys(), self._decoded
        for part, ids in self.encode_stretches(new.difference(older)):
            # a stretch ends between characters, so its bytes decode by themselves
            got = "".join([surface[i] for i in ids]) if bytes_.isdisjoint(ids) else self.surface(ids)
            kept[part] = ",".join([number[i] for i in ids])
            if got != part:
                other[part] = got
        for row in rows:
            parts = row if other.keys().isdisjoint(row) else [other.get(p, p) for p in row]
            yield ",".join(map(kept.__getitem__, row)), "".join(parts).replace(SPACE, " ").removeprefix(" ")
        for part in [p for p in new if len(p) > LONG]:
            del kept[part]
            other.pop(part, None)
    def decode(self, ids: list[int]) -> str:
        """The pieces in order; the first space mark is the encoder's own and goes, specials are silent."""
        return self.surface(ids).removeprefix(SPACE).replace(SPACE, " ")

    def surface(self, ids: tuple[int, ...] | list[int]) -> str:
        """The text of the ids, space marks as they are."""
        v, out = self.vocab, bytearray()
        for i in ids:
            if i not in v.special:
                out += bytes((v.id_byte[i],)) if i in v.id_byte else v.pieces[i].encode("utf-8")
        return out.decode("utf-8", errors="replace")


def together(texts: Iterable[str | None]) -> Iterator[list[str | None]]:
    """The texts in order, in lists of at most `TOGETHER` characters or one text."""
    some: list[str | None] = []
    size = 0
    for text in texts:
        n = len(text or "")
        if some and size + n > TOGETHER:
            yield some
            some, size = [], 0
        some.append(text)
        size += n
    if some:
        yield some


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_documents(docs: DataFrame, path: str, text: str = "text", ids: str = "ids",
                     decoded: str = "decoded") -> DataFrame:
    """`docs` with the ids of each whole text and the text decoded from them."""
    kind = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("text", T.StringType())])

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        e = encoder(path)
        for texts in batches:
            rows = [e.encode(t) for t in texts]
            yield pd.DataFrame({"ids": rows, "text": [e.decode(r) for r in rows]})

    (both,) = fresh(docs, "_both")
    out = docs.withColumn(both, run.asNondeterministic()(F.col(text)))
    return out.withColumns({ids: F.col(both)["ids"], decoded: F.col(both)["text"]}).drop(both)


def digest_documents(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """`docs` with n_tokens and the digests of ids and decoded text; neither leaves the worker.

    A stretch's ids as text and its decoded bytes are kept with the stretch, so the digests of
    equal stretches cost two appends.
    """
    kind = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
                         T.StructField("decoded_sha256", T.StringType())])

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        e = encoder(path)
        for texts in batches:
            yield pd.DataFrame([
                (ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(),
                 hashlib.sha256(decoded.encode("utf-8")).hexdigest())
                for some in together(texts) for ids, decoded in e.written(some)], columns=kind.names)

    (all_,) = fresh(docs, "_digests")
    out = docs.withColumn(all_, run.asNondeterministic()(F.col(text)))
    return out.withColumns({c: F.col(all_)[c] for c in kind.names}).drop(all_)
