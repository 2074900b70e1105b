"""Exact top-k by inner product over an impact-ordered index, score at a time.

Rows are dealt to blocks. A block's index holds, per dimension and sign of the query's weight, the rows in
posting segments of equal quantised impact, where the impact is the distance from the
dimension's worst value. For a group of queries the segments are processed by descending
impact, in bands of levels; each adds its weight times impact to its rows' accumulators. What a row may still gain
is bounded by the weights times the impact reached, so rows whose sum plus that bound stays
below the k-th largest sum cannot be members. A query stops once the possible members are few,
and those are scored again exactly; nothing is dropped without that proof.

Blocks are written once, each to a file of its own. Queries come in rounds of as many groups as `ROUND` bytes hold,
whatever their number: the driver hands the vectors of one round to all tasks, each task builds the index of its blocks
once and searches it for every group, and only k rows a query leave a task. No vector is copied for each pair of a block
and a group.

Defined results: vectors that are null or hold null or non-finite components, and rows without
vec_id, take no part. Of repeated vec_ids the smallest vector counts. Vectors of unequal length are filled up by
zeros. Ties go to the smaller vec_id. Sums in doubles and 64-bit numbers are exact while width times the square of the
largest component stays below 2^51; vectors beyond that, as queries or as rows, are compared in unbounded whole numbers with all
others. A score beyond 64 bits is ranked rightly and shown as null (beyond 38 digits such scores tie).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from farebox.llm.common import cut

K, SCALE = 5, 256
BLOCK, GROUP, LEVELS = 4096, 512, 24
#: Bytes of queries and their best rows that a task holds at once, and of an index's bands that it keeps.
ROUND, BANDS = 1 << 24, 1 << 26
#: Width times the square of the largest component up to which the index and its sums are exact.
EXACT = 1 << 51
_DIGITS = 10 ** 38 - 1


def integers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) as doubles; from 2^53 on a double is a whole number itself."""
    def whole(x: Column) -> Column:
        y = F.lit(float(scale)) * x.cast("double")
        return F.when(F.abs(y) < float(1 << 53), F.floor(y).cast("double")).otherwise(y)

    return F.transform(vector, whole)


def vectors(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id and the vector v of whole numbers (as doubles) of the rows that take part, one per vec_id."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    fit = rows.where(F.col("vec_id").isNotNull() & F.col(vector).isNotNull()).where(whole)
    return fit.select("vec_id", integers(F.col(vector)).alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


class Index:
    """Posting segments of one block of integer vectors."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, levels: int = LEVELS):
        order = np.argsort(ids)
        x = x[order]
        self.ids, self.x = ids[order], x.astype(np.float64)
        low, high = x.min(axis=0), x.max(axis=0)
        self.step = int(max((high - low).max() // levels + 1, 1))
        self.levels = int((high - low).max() // self.step)
        # rows by quantised impact, for positive and then for negative weights
        self.segments = self._segments((x - low) // self.step) + self._segments((high - x) // self.step)
        self.bands: dict[int, np.ndarray] = {}

    def _segments(self, impact: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of each dimension the rows by rising impact, their impact, and where each level begins."""
        out = []
        for column in impact.T:
            by = np.argsort(column, kind="stable")
            out.append((by, column[by] * float(self.step), np.searchsorted(column[by], np.arange(self.levels + 2))))
        return out

    def band(self, level: int, end: int) -> np.ndarray:
        """Impact by dimension and row of the segments of the levels from `level` to below `end`, 0 elsewhere."""
        if level not in self.bands:
            held = np.zeros((len(self.segments), len(self.ids)))
            for of, (rows, impact, begin) in zip(held, self.segments):
                some = slice(begin[level], begin[end])
                of[rows[some]] = impact[some]
            if held.nbytes * (self.levels.bit_length() + 1) > BANDS:
                return held
            self.bands[level] = held
        return self.bands[level]

    def search(self, queries: np.ndarray, own: np.ndarray, k: int = K) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(query row, ids, scores) of each query's best k rows, without the row of its own id."""
        n, q = len(self.ids), len(queries)
        weights = np.concatenate([np.maximum(queries, 0), np.maximum(-queries, 0)], axis=1).astype(np.float64)
        weight = weights.sum(axis=1)
        sums = np.zeros((q, n))
        is_own = np.searchsorted(self.ids, own)
        has_own = (is_own < n) & (self.ids[np.minimum(is_own, n - 1)] == own)
        possible: list[np.ndarray | None] = [None] * q
        left, end, level = np.arange(q), self.levels + 1, self.levels // 2
        while len(left):
            if end > 1:  # segments of level 0 add nothing
                sums[left] += weights[left] @ self.band(level, end)
            gain = weight * max(level * self.step - 1, self.step - 1)  # of rows not reached, or cut off by quantising
            for j in left:
                column = sums[j]
                if has_own[j]:
                    column[is_own[j]] = -1
                least = np.partition(column, n - k)[n - k] if n > k else -1.0
                members = np.flatnonzero(column >= least - gain[j])
                if level == 0 or len(members) * 16 <= max(n, 16 * k):
                    possible[j] = members
            left = np.array([j for j in left if possible[j] is None], dtype=np.int64)
            end, level = level, level // 2
        out = []
        for j, members in enumerate(possible):
            members = members[self.ids[members] != own[j]]
            score = (self.x[members] @ queries[j].astype(np.float64)).astype(np.int64)
            best = np.lexsort((self.ids[members], -score))[:k]
            out.append((j, self.ids[members[best]], score[best]))
        return out


def compare(ids: np.ndarray, x: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int = K) -> list[tuple[int, np.ndarray, list[int]]]:
    """As `Index.search`, by comparing every row in unbounded whole numbers."""
    whole = np.array([[int(v) for v in row] for row in x.tolist()], dtype=object).reshape(x.shape)
    out = []
    for j, query in enumerate(queries.tolist()):
        score = whole @ np.array([int(v) for v in query], dtype=object)
        best = sorted((-int(s), int(i)) for s, i in zip(score, ids.tolist()) if i != own[j])[:k]
        out.append((j, np.array([i for _, i in best], dtype=np.int64), [-s for s, _ in best]))
    return out


def top_k(rows: DataFrame, is_query: Column, k: int = K, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows for each row of `rows` (vec_id, v) with `is_query`."""
    rows = cut(rows, "vectors")
    width = max(rows.agg(F.max(F.size("v"))).first()[0] or 0, 1)
    limit = float(math.isqrt(EXACT // width))
    rows = rows.withColumn("small", F.forall("v", lambda x: F.abs(x) <= limit))
    sizes = {r["small"]: r for r in rows.groupBy("small").agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("asked")).collect()}

    def pieces(small: bool) -> tuple[int, int]:
        r = sizes.get(small)
        return (-(-r["n"] // block) or 1, -(-r["asked"] // group) or 1) if r else (1, 1)

    small = rows.where("small")
    best = _best(small, small.where(is_query), *pieces(True), width, k, group, exact=False)
    if False in sizes:  # vectors whose sums need unbounded numbers
        large = rows.where("not small")
        every = pieces(True)[1] + pieces(False)[1]
        best = best.withColumn("score", F.col("score").cast("decimal(38,0)")).unionByName(
            _best(large, rows.where(is_query), pieces(False)[0], every, width, k, group, exact=True)).unionByName(
            _best(small, large.where(is_query), pieces(True)[0], pieces(False)[1], width, k, group, exact=True))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("score").try_cast("bigint").alias("score"))


def _best(rows: DataFrame, queries: DataFrame, blocks: int, groups: int, width: int, k: int, group: int, exact: bool) -> DataFrame:
    """query_id, vec_id and score for each of `queries`; the k best of `rows` are among them."""
    kind = "double" if exact else "bigint"
    filled = F.concat(F.col("v").cast(f"array<{kind}>"), F.array_repeat(F.lit(0).cast(kind), F.lit(width) - F.size("v")))

    def packed(df: DataFrame, pieces: int, **options: int) -> DataFrame:
        of = df.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(pieces)).alias("piece")).agg(
            F.collect_list(F.struct("vec_id", filled.alias("v"))).alias("rows"))
        return cut(of.select("piece", F.transform("rows", lambda r: r["vec_id"]).alias("ids"),
                             F.flatten(F.transform("rows", lambda r: r["v"])).alias("flat")), "vectors-packed", **options)

    of_rows, of_queries = packed(rows, blocks, maxRecordsPerFile=1), packed(queries, groups)
    size = max(ROUND // (8 * (width + 24 * k) * group), 1)
    return reduce(DataFrame.unionByName, [
        _round(of_rows, of_queries.where(F.col("piece").between(at, at + size - 1)), width, k, exact) for at in range(0, groups, size)])


def _round(blocks: DataFrame, asked: DataFrame, width: int, k: int, exact: bool) -> DataFrame:
    """Of the queries of a few groups, which are held at once, the k best rows of each task."""
    kind = np.float64 if exact else np.int64
    held = [(np.asarray(ids.as_py(), dtype=np.int64), flat.values.to_numpy(zero_copy_only=False).astype(kind).reshape(-1, width))
            for ids, flat in zip(*asked.select("ids", "flat").toArrow().columns)]
    shared = blocks.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: list[list[list]] = [[[] for _ in who] for who, _ in shared.value]
        for b in batches:
            for ids, flat in zip(b["ids"], b["flat"]):
                ids, x = np.asarray(ids), np.asarray(flat, dtype=kind).reshape(-1, width)
                index = None if exact else Index(ids, x)
                for kept, (who, what) in zip(best, shared.value):
                    for j, some, score in compare(ids, x, what, who, k) if exact else index.search(what, who, k):
                        kept[j] = sorted([*kept[j], *((-s, i) for s, i in zip(score if exact else score.tolist(), some.tolist()))])[:k]
        for kept, (who, _) in zip(best, shared.value):
            found = [(q, i, Decimal(min(max(-s, -_DIGITS), _DIGITS)) if exact else -s) for q, some in zip(who.tolist(), kept) for s, i in some]
            if found:
                yield pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    out = cut(blocks.select("ids", "flat").mapInPandas(
        run, f"query_id long, vec_id long, score {'decimal(38,0)' if exact else 'long'}"), "vectors-found")
    shared.destroy()
    return out
