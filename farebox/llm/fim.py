"""Fill-in-the-middle: texts cut at two unit boundaries and written prefix, suffix, middle.

A unit is a run of the letters A-Z and a-z or any other single code point. The UTF-8 bytes of a
text are taken in fixed blocks. A Fenwick tree over the blocks stores how many units begin in
them and how many code points; a binary-lifting descent finds the block in which the unit of a
cut begins and the code points before it, and only that block is read again to locate the
boundary. The trees of all texts of a batch lie side by side and are built and descended together.

Cuts and form follow from a keyed hash of the id, so reruns agree and rows need no order.

Defined results: a null or empty text is plain, with no unit and an empty output. A text that
holds a mark is plain, so an output can always be taken apart again. A null id is hashed as an
empty one. Repeated rows come out alike; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farebox.llm.common import fresh

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, FIM_PERCENT, SPM_PERCENT = 1, 90, 20
#: Bytes of a block; bytes that are classified at once; cuts that are located at once.
BLOCK, SLAB, CUTS = 256, 1 << 22, 1 << 14

_bytes = np.arange(256)
#: Bytes that are letters, and bytes that begin a code point.
_LETTER = ((_bytes | 32) >= ord("a")) & ((_bytes | 32) <= ord("z"))
_LEAD = (_bytes & 0xC0) != 0x80


def _flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offset of each; a null text is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    held = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[at[0]:at[-1]], at - at[0]


class Blocks:
    """Fenwick trees over the blocks of each text of a batch."""

    def __init__(self, texts: pa.Array, block: int = BLOCK, slab: int = SLAB):
        self.data, self.at = _flat(texts)
        self.block = block
        self.size = -(-np.diff(self.at) // block)  # blocks of each text
        self.first = np.cumsum(self.size) - self.size
        owner = np.repeat(np.arange(len(self.size)), self.size)
        self.local = np.arange(len(owner)) - self.first[owner]
        self.begin = self.at[owner] + block * self.local
        self.end = np.minimum(self.begin + block, self.at[owner + 1])
        self.units, self.points = self._counts(max(slab // block, 1))
        # totals, before the counts become trees; sums of doubles are exact below 2^53
        self.n = np.bincount(owner, self.units, len(self.size)).astype(np.int64)
        for step in (1 << k for k in range(int(self.size.max(initial=0)).bit_length())):
            up = np.flatnonzero((self.local + 1) % (2 * step) == 0)
            for tree in (self.units, self.points):
                tree[up] += tree[up - step]

    def _counts(self, per_slab: int) -> tuple[np.ndarray, np.ndarray]:
        units, points = np.zeros(len(self.begin), np.int64), np.zeros(len(self.begin), np.int64)
        for u in range(0, len(self.begin), per_slab):
            begin, low, high = self.begin[u:u + per_slab], self.begin[u], self.end[min(u + per_slab, len(self.end)) - 1]
            letter, lead = _LETTER[self.data[low:high]], _LEAD[self.data[low:high]]
            before = np.empty_like(letter)
            before[1:] = letter[:-1]
            before[0] = low > 0 and _LETTER[self.data[low - 1]]
            before[begin[self.local[u:u + per_slab] == 0] - low] = False  # a text begins a run of its own
            for out, mark in ((units, lead & ~(letter & before)), (points, lead)):
                out[u:u + per_slab] = np.add.reduceat(mark, begin - low, dtype=np.int64)
        return units, points

    def descend(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: blocks before the one where unit number `unit` begins, units and code points left to and before it."""
        pos, left, before = np.zeros(len(unit), np.int64), unit.astype(np.int64), np.zeros(len(unit), np.int64)
        for step in (1 << k for k in reversed(range(int(self.size.max(initial=0)).bit_length()))):
            fits = np.flatnonzero(pos + step <= self.size)
            node = self.first[fits] + pos[fits] + step - 1
            go = self.units[node] <= left[fits]
            fits, node = fits[go], node[go]
            pos[fits] += step
            left[fits] -= self.units[node]
            before[fits] += self.points[node]
        return pos, left, before

    def chars_before(self, unit: np.ndarray) -> np.ndarray:
        """Code points before unit number `unit` of each text; all of them where the number is that of all units."""
        pos, left, points = self.descend(unit)
        inner = np.flatnonzero(pos < self.size)  # the others end with their text
        steps = np.arange(self.block)
        for c in range(0, len(inner), CUTS):
            mine = inner[c:c + CUTS]
            b = self.first[mine] + pos[mine]
            place = self.begin[b][:, None] + steps
            held = self.data[np.minimum(place, len(self.data) - 1)]
            letter, lead = _LETTER[held], _LEAD[held] & (place < self.end[b][:, None])
            before = np.empty_like(letter)
            before[:, 1:] = letter[:, :-1]
            before[:, 0] = (pos[mine] > 0) & _LETTER[self.data[self.begin[b] - 1]]
            started = np.cumsum(lead & ~(letter & before), axis=1)
            cut = np.argmax(started > left[mine][:, None], axis=1)
            points[mine] += (lead & (steps < cut[:, None])).sum(axis=1)
        return points


def cuts(texts: pa.Array, one: np.ndarray, other: np.ndarray, block: int = BLOCK,
         slab: int = SLAB) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units of each text, code points of its prefix and of its middle; `one` and `other` draw the cuts."""
    trees = Blocks(texts, block, slab)
    a, b = one % (trees.n + 1), other % (trees.n + 1)
    prefix = trees.chars_before(np.minimum(a, b))
    return trees.n, prefix, trees.chars_before(np.maximum(a, b)) - prefix


def _cuts_column(text: Column, one: Column, other: Column) -> Column:
    @F.arrow_udf("struct<n:bigint,prefix_chars:bigint,middle_chars:bigint>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, a, b in batches:
            found = cuts(texts, a.to_numpy(zero_copy_only=False), b.to_numpy(zero_copy_only=False))
            yield pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in found],
                                             names=["n", "prefix_chars", "middle_chars"])

    return run.asNondeterministic()(text, one, other)


def draws(key: Column, seed: int = SEED) -> list[Column]:
    """Four numbers below 2^32 that depend on `key` and `seed` alone."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, text: str = "text", key: str = "doc_id", seed: int = SEED,
                   fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """`docs` with the column `fim`: n, form, prefix_chars, middle_chars and output.

    `fim_percent` of the texts are transformed, `spm_percent` of those with the suffix first.
    """
    name, cut = fresh(docs, "fim", "_cut")
    one, other, third, fourth = draws(F.col(key), seed)
    whole = F.coalesce(F.col(text), F.lit(""))
    n, p, m = (F.col(f"{cut}.{c}") for c in ("n", "prefix_chars", "middle_chars"))
    holds_mark = F.contains(whole, F.lit(PREFIX)) | F.contains(whole, F.lit(SUFFIX)) | F.contains(whole, F.lit(MIDDLE))
    form = (F.when((n == 0) | holds_mark | (third % 100 >= fim_percent), "plain")
            .when(fourth % 100 < spm_percent, "spm").otherwise("psm"))
    at, width = p.cast("int"), m.cast("int")
    prefix, middle = F.substr(whole, F.lit(1), at), F.substr(whole, at + 1, width)
    suffix = F.substr(whole, at + width + 1)
    output = (F.when(form == "plain", whole)
              .when(form == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
              .otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)))
    result = F.struct(n.alias("n"), form.alias("form"), F.when(form != "plain", p).alias("prefix_chars"),
                      F.when(form != "plain", m).alias("middle_chars"), output.alias("output"))
    return docs.withColumn(cut, _cuts_column(F.col(text), one, other)).withColumn(name, result).drop(cut)


def restored(output: Column, form: Column) -> Column:
    """The text that was made into `output`: a mark cannot overlap the next, so its first place is the mark itself."""
    def parts(second: str) -> tuple[Column, Column, Column]:
        body = F.substr(output, F.lit(len(PREFIX) + 1))
        one = F.substring_index(body, second, 1)
        rest = F.substr(body, F.char_length(one) + len(second) + 1)
        two = F.substring_index(rest, MIDDLE, 1)
        return one, two, F.substr(rest, F.char_length(two) + len(MIDDLE) + 1)

    p1, s1, m1 = parts(SUFFIX)
    s2, p2, m2 = parts(PREFIX)
    return F.when(form == "psm", F.concat(p1, m1, s1)).when(form == "spm", F.concat(p2, m2, s2)).otherwise(output)
