"""Near-duplicates by the bit distance of fingerprints, compared exactly in tiles.

A fingerprint bit is set if it is set in over half of the hashes of a text's word shingles.
Distinct fingerprints are cut into tiles by their population count, tile pairs whose counts
differ beyond the radius are never made, and the pairs left are compared by numpy exclusive-or
and bit counts. Each comparison reports a spanning forest of its links, not the links, so a
large group costs its size. Classes are the connected components of all forests.

How tiles are dealt: of `radius + 1` blocks of the 64 bits, two fingerprints within the radius
share at least one block, so tiles are made per block value and no pair is lost. Values with
more than `tile` fingerprints are cut further, by population count and then at random, and
every two pieces in reach meet in a task of their own.

Defined results: null and empty texts have the fingerprint zero, linked like any other; shorter
texts than a shingle are one shingle. Repeated rows share a fingerprint and so a class. A row
without doc_id takes part and names no class; a class without any doc_id has a null component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from farebox.llm.common import cut, fresh, merged

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Fingerprints of one block value that are compared in one piece.
TILE = 2048
_UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Shingle hashes unpacked at once, which bounds memory on very long texts.
CHUNK = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64 bits of a text, as an unsigned number."""
    words = text.encode("utf-8").translate(_UPPER).split() if text else []
    n = max(len(words) - shingle + 1, 1) if words else 0
    if not n:
        return 0
    joined = b" ".join(words)
    at = [0]
    for w in words:
        at.append(at[-1] + len(w) + 1)
    ends = at[shingle:] if len(words) >= shingle else at[-1:]
    set_bits = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_digest
    for c in range(0, n, CHUNK):
        raw = b"".join([digest(joined[a:b - 1], SEED) for a, b in zip(at[c:min(c + CHUNK, n)], ends[c:c + CHUNK])])
        set_bits += np.unpackbits(np.frombuffer(raw, dtype=np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > n).tobytes(), "big")


def fingerprint_column(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint as a signed 64-bit number."""
    @F.pandas_udf(T.LongType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64))

    return run.asNondeterministic()(text)


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after linking rows a and b; the label of a class is its smallest row."""
    a, b = label[a], label[b]
    while True:
        differ = a != b
        if not differ.any():
            return label
        a, b = a[differ], b[differ]
        low, high = np.minimum(a, b), np.maximum(a, b)
        to = np.arange(len(label))
        np.minimum.at(to, high, low)
        while (again := to[to]).tolist() != to.tolist():
            to = again
        label = to[label]
        a, b = to[a], to[b]


def forest(left: np.ndarray, right: np.ndarray, radius: int = RADIUS, rows: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within `left` (if `right` is empty) or between the two sides.

    Both are sorted by population count here; a block of rows meets only the stretch whose
    counts are within the radius.
    """
    within = len(right) == 0
    left = left[np.argsort(np.bitwise_count(left), kind="stable")]
    other = left if within else right[np.argsort(np.bitwise_count(right), kind="stable")]
    every = left if within else np.concatenate([left, other])
    shift = 0 if within else len(left)
    counts = np.bitwise_count(other).astype(np.int64)
    mine = np.bitwise_count(left).astype(np.int64)
    label = np.arange(len(every))
    for at in range(0, len(left), rows):
        block = left[at:at + rows]
        low = at if within else int(np.searchsorted(counts, mine[at] - radius, "left"))
        high = int(np.searchsorted(counts, mine[min(at + rows, len(left)) - 1] + radius, "right"))
        if low < high:
            near = np.bitwise_count(block[:, None] ^ other[None, low:high]) <= radius
            a, b = np.nonzero(near)
            label = _merge(label, a + at, b + low + shift)
    linked = np.flatnonzero(label != np.arange(len(every)))
    return every[linked], every[label[linked]]


def _blocks(radius: int) -> list[tuple[int, int]]:
    """(shift, mask) of radius + 1 blocks that make up the 64 bits."""
    edge = [64 * k // (radius + 1) for k in range(radius + 2)]
    return [(a, (1 << (b - a)) - 1) for a, b in zip(edge, edge[1:])]


def links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Edges (a, b) between distinct fingerprints `fp` whose components are those of all pairs in reach."""
    keyed = prints.select("fp", F.bit_count("fp").cast("int").alias("pc"), F.posexplode(F.array(*[
        F.shiftrightunsigned("fp", a).bitwiseAND(F.lit(m)) for a, m in _blocks(radius)])).alias("block", "value"))
    # values with more than one tile: how many pieces each population count is cut into
    sizes = (keyed.groupBy("block", "value", "pc").agg(F.count("*").alias("n"))
             .groupBy("block", "value")
             .agg(F.sum("n").alias("n"),
                  F.collect_list(F.struct("pc", F.ceil(F.col("n") / tile).cast("int").alias("pieces"))).alias("cuts"))
             .where(F.col("n") > tile).select("block", "value", "cuts"))
    dealt = keyed.join(sizes, ["block", "value"], "left")
    whole = F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("i"), F.lit(0).alias("y"), F.lit(0).alias("j"),
                             F.lit(True).alias("first")))
    piece = F.expr("cast(pmod(xxhash64(fp), element_at(filter(cuts, c -> c.pc = pc), 1).pieces) as int)")
    meets = F.expr(f"""flatten(transform(filter(cuts, c -> abs(c.pc - pc) <= {int(radius)}), c ->
        transform(sequence(0, c.pieces - 1), q -> if(c.pc < pc or (c.pc = pc and q < piece),
            named_struct('x', c.pc, 'i', q, 'y', pc, 'j', piece, 'first', false),
            named_struct('x', pc, 'i', piece, 'y', c.pc, 'j', q, 'first', true)))))""")
    pairs = (dealt.withColumn("piece", F.when(F.col("cuts").isNotNull(), piece))
             .withColumn("to", F.explode(F.when(F.col("cuts").isNull(), whole).otherwise(meets)))
             .groupBy("block", "value", "to.x", "to.i", "to.y", "to.j")
             .agg(F.collect_list(F.when(F.col("to.first"), F.col("fp"))).alias("left"),
                  F.collect_list(F.when(~F.col("to.first"), F.col("fp"))).alias("right"))
             # two pieces of a value, or one piece with itself
             .where((F.size("left") > 1) | ((F.size("left") > 0) & (F.size("right") > 0)))
             .select("left", "right", ((F.col("x") == F.col("y")) & (F.col("i") == F.col("j"))).alias("own"))
             .where(F.col("own") | (F.size("right") > 0)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [forest(np.asarray(x, dtype=np.int64).view(np.uint64), np.asarray(y, dtype=np.int64).view(np.uint64),
                            radius) for x, y in zip(b["left"], b["right"])]
            yield pd.DataFrame({"a": np.concatenate([f[0] for f in found] or [np.zeros(0, np.uint64)]).view(np.int64),
                                "b": np.concatenate([f[1] for f in found] or [np.zeros(0, np.uint64)]).view(np.int64)})

    return pairs.select("left", "right").mapInPandas(run, "a long, b long").distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) of every node with an edge, root the smallest node of its component.

    Stars are contracted in turns: each node's larger neighbours move to its smallest one, then
    its smaller ones do, until nothing changes. Every turn is written to the shared folder.
    """
    def ordered(df: DataFrame) -> DataFrame:
        return df.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()

    def mark(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = cut(ordered(edges.toDF("u", "v")), name)
    was = mark(now)
    count = was[0]  # no turn makes more edges
    while was[0]:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = ordered(both.join(merged(least, count), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        large = cut(large, name)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(merged(low, count), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        now = cut(ordered(small), name)
        is_ = mark(now)
        if is_ == was:
            break
        was = is_
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _rooted(distinct: DataFrame, radius: int, tile: int) -> DataFrame:
    """`distinct`, one row per fingerprint, with the root of its class."""
    roots = components(links(distinct.select("fp"), radius, tile))
    # a fingerprint without links is its own class
    return cut(distinct.join(roots, distinct["fp"] == roots["node"], "left")
               .select(*[distinct[c] for c in distinct.columns], F.coalesce("root", "fp").alias("root")), "rooted")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """doc_id, fp (signed fingerprint) and component_id of every row."""
    prints = cut(docs.select("doc_id", fingerprint_column(F.col("text"), shingle).alias("fp")), "fingerprints")
    # smallest doc_id per fingerprint, then per class
    rooted = _rooted(cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct"), radius, tile)
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def deduplicated(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row of each class, the first by doc_id (null last) and fingerprint; columns as before.

    Rows equal in doc_id and text leave one. Ids may repeat or be missing: a row is named by its doc_id and text.
    """
    (keep,) = fresh(docs, "_keep")
    name = F.md5(F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in ("doc_id", "text")]))
    prints = cut(docs.select("doc_id", fingerprint_column(F.col("text"), shingle).alias("fp"), name.alias("name")), "fingerprints")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "name")).alias("least")
    rooted = _rooted(cut(prints.groupBy("fp").agg(least), "distinct"), radius, TILE)
    first = rooted.groupBy("root").agg(F.min(F.struct("least.unnamed", "least.doc_id", "fp", "least.name")).alias("first"))
    first = first.select(F.col("first.name").alias("first"))
    named = docs.withColumn(keep, name)
    return named.join(first, named[keep] == first["first"], "left_semi").dropDuplicates([keep]).drop(keep)
