"""Near-duplicates by shingle sets: b-bit MinHash signatures, a multi-index Hamming join, exact confirmation.

A signature has 64 symbols of 16 bits, one per hash function: the low bits of the function's least
value over the set. Two signatures differ in a symbol with probability 1 - J at Jaccard similarity J, so
at J = 0.8 more than `RADIUS` = 31 of 64 differ once in some five million pairs, and less at every larger J.

The join finds *all* pairs within the radius: signatures are split into 16 chunks of 4 symbols, and 31
errors cannot put two into every chunk, so some chunk has one error at most. The allowed errors of a chunk are
enumerated as the four ways to leave one symbol out; two signatures in reach share one of 64 keys.
Keys are dealt over all tasks. Every document whose set is equal is one node.

Links are confirmed on full sets, in two steps, so that no group of near copies is expanded into its pairs:
1. each node is tried against the node it shares most keys with among the first ones of its keys, which ties
   most of a group together (a short cut: it may miss links, never add one);
2. under every key, nodes whose classes still differ meet in tiles: signatures first, then full sets of the
   nodes that have a partner in reach. Of each key the largest class is compared with the rest only.
A task reports a spanning forest of its links. Full sets are made again from the text where they are needed,
and are never stored for documents without a candidate. Both sides of every join grow with the input, so large ones are never broadcast.

Defined results: words are cut at ASCII white space and A-Z lower-cased; fewer words than a shingle make one
shingle, none make an empty set that links with nothing. Rows with equal sets are linked, repeated rows included.
A row without doc_id takes part and names no class; a class without any doc_id has a null component.
Shingles are compared by 64-bit hashes. Extra columns are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farebox.llm.common import cut, merged
from farebox.llm.simhash import components

SHINGLE, PERCENT = 4, 80
#: Symbols of 16 bits, in chunks of four, one 64-bit number each.
CHUNKS, PER_CHUNK = 16, 4
SYMBOLS = CHUNKS * PER_CHUNK
#: Errors a chunk may have, and the signature distance that this guarantees.
ERRORS = 1
RADIUS = CHUNKS * (ERRORS + 1) - 1
#: Nodes of one class under a key, and shingles of them, that one piece holds.
TILE, TILE_SHINGLES = 1024, 1 << 21
#: Keys two nodes share before the short cut tries them; the join does not depend on it.
TRY_FROM = 8
#: Bits of the filter that keeps texts without a candidate out of a shuffle; 16 MB at any size of the input.
FILTER_BITS = 27
#: Shingle hashes that meet the hash functions at once.
_SLAB = 1 << 12
_UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_seeds = np.random.default_rng(13)
_TIMES = _seeds.integers(1, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _seeds.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64)
_LANES = np.uint64(0xFFFF) << (np.arange(PER_CHUNK, dtype=np.uint64) * np.uint64(16))


def shingles(text: str | bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    raw = text.encode("utf-8") if isinstance(text, str) else text
    words = raw.translate(_UPPER).split() if raw else []
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    at = [0]
    for w in words:
        at.append(at[-1] + len(w) + 1)
    ends = at[size:] if len(words) >= size else at[-1:]
    digest = xxhash.xxh3_64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b - 1]) for a, b in zip(at, ends)), np.uint64, len(ends)))


def signature(hashes: np.ndarray) -> np.ndarray:
    """The symbols of a set, four to a number."""
    least = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for c in range(0, len(hashes), _SLAB):
        part = hashes[c:c + _SLAB]
        with np.errstate(over="ignore"):
            mixed = part[None, :] * _TIMES[:, None] + _PLUS[:, None]
        np.minimum(least, mixed.min(axis=1), out=least)
    with np.errstate(over="ignore"):
        low = ((least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype("<u2")
    return low.view("<u8")


def _texts(column: pa.Array) -> Iterator[bytes | None]:
    return (None if t is None else t for t in column.cast(pa.large_binary()).to_pylist())


def prints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, name of the text, name of the set, n (its size) and signature of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, sizes, marks = [], [], np.zeros((b.num_rows, CHUNKS), np.uint64)
            for i, text in enumerate(_texts(b.column("text"))):
                own = shingles(text, size)
                names.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                sizes.append(len(own))
                marks[i] = signature(own)
            signs = pa.ListArray.from_arrays(np.arange(b.num_rows + 1, dtype=np.int32) * CHUNKS, marks.view(np.int64).ravel())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("name"), pa.array(names, pa.binary()), pa.array(sizes, pa.int64()), signs],
                names=["doc_id", "name", "set", "n", "sign"])

    return docs.select("doc_id", "text", _name(F.col("text"))).mapInArrow(
        run, f"doc_id {kind}, name string, set binary, n bigint, sign array<bigint>")


def _name(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit(""))).alias("name")


def keys(nodes: DataFrame) -> DataFrame:
    """(key, node): of every chunk, the four ways to leave one symbol out. The low six bits number the way."""
    ways, masks = [], (~_LANES).view(np.int64).tolist()
    for c in range(CHUNKS):
        for i in range(PER_CHUNK):
            left = F.col("sign")[c].bitwiseAND(F.lit(masks[i]))
            way = c * PER_CHUNK + i
            ways.append(F.shiftleft(F.xxhash64(F.lit(way), left), 6).bitwiseOR(F.lit(way).cast("long")))
    return nodes.select(F.explode(F.array(*ways)).alias("key"), "node")


def _forest(left: list[np.ndarray], right: list[np.ndarray], own: bool, percent: int) -> list[tuple[int, int]]:
    """Places (in left, then right) of a spanning forest of the links of left with right, and within left if `own`."""
    every = [*left, *right]
    sizes = np.array([len(s) for s in every])
    # shingles that one set alone holds cannot be shared
    values, number, count = np.unique(np.concatenate(every), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(every)), sizes)
    shared = count[number] > 1
    number, owner = number[shared], owner[shared]
    begin = np.searchsorted(owner, np.arange(len(every) + 1))
    mark = np.zeros(len(values), dtype=bool)
    root = np.arange(len(every))
    out = []
    for i in range(len(left)):
        mine = number[begin[i]:begin[i + 1]]
        mark[mine] = True
        low = i + 1 if own else len(left)
        common = np.bincount(owner[begin[low]:][mark[number[begin[low]:]]], minlength=len(every))
        mark[mine] = False
        linked = np.flatnonzero(100 * common >= percent * (sizes[i] + sizes - common))
        linked = linked[(linked >= low) & (root[linked] != root[i])]
        for j in linked[np.unique(root[linked], return_index=True)[1]]:
            out.append((i, int(j)))
            root[root == root[j]] = root[i]
    return out


def _lists(column: pa.Array) -> list[np.ndarray]:
    """The elements of each list of a list column."""
    at, flat = column.offsets.to_numpy(), column.values
    return [flat.slice(a, b - a) for a, b in zip(at, at[1:])]


def confirmed(members: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Edges (a, b) whose components are those of all links inside the tiles of `members` (key, x, y, first, node).

    A tile links its first side with the other; within the first side too where x = y. `sets` has (node, hashes).
    """
    tiles = (members.join(merged(sets), "node").groupBy("key", "x", "y")
             .agg(F.collect_list(F.struct("first", "node", "hashes")).alias("held")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            edges = []
            for held, x, y in zip(_lists(b.column("held")), b.column("x").to_pylist(), b.column("y").to_pylist()):
                first = held.field("first").to_numpy(zero_copy_only=False).astype(bool)
                node = held.field("node").to_numpy()
                hashes = [np.frombuffer(h, np.uint64) for h in held.field("hashes").to_pylist()]
                order = np.argsort(~first, kind="stable")
                sides = [hashes[i] for i in order]
                cut_at = int(first.sum())
                edges += [(node[order[i]], node[order[j]]) for i, j in
                          _forest(sides[:cut_at], sides[cut_at:], x == y, percent)]
            yield pa.RecordBatch.from_arrays([pa.array([int(e[k]) for e in edges], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return tiles.select("x", "y", "held").mapInArrow(run, "a bigint, b bigint")


def _in_reach(sign: np.ndarray, size: np.ndarray, kind: np.ndarray, first: np.ndarray, own: bool, way: int,
              radius: int, percent: int, rows: int = 64) -> np.ndarray:
    """Which nodes of a tile have a partner of another class within the radius whose first shared key is `way`."""
    symbols = np.ascontiguousarray(sign).view("<u2")
    left = np.flatnonzero(first)
    hit = np.zeros(len(sign), dtype=bool)
    for c in range(0, len(left), rows):
        mine = left[c:c + rows]
        fits = kind[mine][:, None] != kind[None, :]
        fits &= 100 * np.minimum(size[mine][:, None], size[None, :]) >= percent * np.maximum(size[mine][:, None], size[None, :])
        if not own:
            fits &= ~first[None, :]
        a, b = np.nonzero(fits)
        for d in range(0, len(a), 1 << 16):
            u, v = mine[a[d:d + (1 << 16)]], b[d:d + (1 << 16)]
            equal = symbols[u] == symbols[v]
            near = equal.sum(axis=1) >= SYMBOLS - radius
            u, v, equal = u[near], v[near], equal[near].reshape(-1, CHUNKS, PER_CHUNK)
            # the key that leaves symbol i out is shared if the other three are equal
            ways = ((equal.sum(axis=2)[:, :, None] - equal) == PER_CHUNK - 1).reshape(len(u), SYMBOLS)
            here = ways.argmax(axis=1) == way
            hit[u[here]] = hit[v[here]] = True
    return hit


def _contested(shared: DataFrame, nodes: DataFrame, classes: DataFrame, count: int, radius: int, percent: int, tile: int) -> DataFrame:
    """Members (key, x, y, first, node) of tiles that hold a pair of nodes in reach whose classes differ."""
    kinds = nodes.select("node", "n").join(merged(classes, count), "node", "left").select("node", "n", F.coalesce("root", "node").alias("kind"))
    held = cut(shared.select("key", "node").join(merged(kinds, count), "node"), "minhash-held")
    by_kind = held.groupBy("key", "kind").agg(F.count("*").alias("c"), F.sum("n").alias("w"))
    pieces = lambda c, w: F.ceil(F.greatest(c / tile, w / TILE_SHINGLES)).cast("int")
    main = (by_kind.groupBy("key").agg(F.max_by("kind", F.struct("c", "kind")).alias("main"), F.max("c").alias("most"),
                                       F.max_by("w", F.struct("c", "kind")).alias("main_w"),
                                       F.sum("c").alias("c"), F.sum("w").alias("w"), F.count("*").alias("kinds"))
            .where("kinds > 1")
            .select("key", "main", pieces(F.col("c"), F.col("w")).alias("p"), pieces(F.col("most"), F.col("main_w")).alias("pm"),
                    pieces(F.col("c") - F.col("most"), F.col("w") - F.col("main_w")).alias("pr")))
    # a small key is one tile; of a large one each piece of the rest meets every piece of the main class and of the rest
    place = F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), F.col("first").alias("first"))
    meets_rest = F.expr("""transform(sequence(0, pr - 1), i -> named_struct(
        'x', least(i, piece), 'y', greatest(i, piece), 'first', piece <= i))""")
    meets_main = F.expr("transform(sequence(0, pm - 1), j -> named_struct('x', piece, 'y', -1 - j, 'first', true))")
    as_main = F.expr("transform(sequence(0, pr - 1), i -> named_struct('x', i, 'y', -1 - piece, 'first', false))")
    dealt = (held.join(merged(main), "key").withColumn("first", F.col("kind") != F.col("main"))
             .withColumn("piece", F.pmod(F.xxhash64("node"), F.when(F.col("first"), F.col("pr")).otherwise(F.col("pm"))).cast("int"))
             .withColumn("to", F.explode(F.when(F.col("p") <= 1, F.array(place))
                                         .when(F.col("first"), F.concat(meets_rest, meets_main)).otherwise(as_main)))
             .select("key", "to.x", "to.y", "to.first", "node", "n", "kind"))
    # dealt anew by tile, so that the joins before may split a key
    tiles = (dealt.join(merged(nodes.select("node", "sign")), "node").repartition("key", "x", "y").groupBy("key", "x", "y")
             .agg(F.collect_list(F.struct("first", "node", "n", "kind", "sign")).alias("held")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for held, key, x, y in zip(_lists(b.column("held")), *[b.column(c).to_pylist() for c in ("key", "x", "y")]):
                first = held.field("first").to_numpy(zero_copy_only=False).astype(bool)
                sign = held.field("sign").flatten().to_numpy().reshape(len(first), CHUNKS)
                hit = np.flatnonzero(_in_reach(sign, held.field("n").to_numpy(), held.field("kind").to_numpy(), first,
                                               x == y, key & (SYMBOLS - 1), radius, percent))
                if len(hit):
                    for kept, value in zip(out, (key, x, y)):
                        kept.extend([value] * len(hit))
                    out[3].extend(first[hit].tolist())
                    out[4].extend(held.field("node").to_numpy()[hit].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64()))],
                                             names=["key", "x", "y", "first", "node"])

    return tiles.mapInArrow(run, "key bigint, x int, y int, first boolean, node bigint")


def _places(name: Column) -> list[Column]:
    h, mask = F.xxhash64(name), F.lit((1 << FILTER_BITS) - 1)
    return [h.bitwiseAND(mask), F.shiftrightunsigned(h, 64 - FILTER_BITS)]


def _maybe(wanted: DataFrame, name: Column) -> Column:
    """False for names that are surely not among the wanted ones: a Bloom filter of fixed size, two bits a name."""
    words = (wanted.select(F.explode(F.array(*_places(F.col("name")))).alias("bit"))
             .groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).toArrow())
    table = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy()
    shared = wanted.sparkSession.sparkContext.broadcast(table)  # 2^FILTER_BITS bits

    @F.arrow_udf("boolean")
    def run(one: pa.Array, two: pa.Array) -> pa.Array:
        hit = True
        for places in (one.to_numpy(zero_copy_only=False), two.to_numpy(zero_copy_only=False)):
            hit &= (shared.value[places >> 6] >> (places & 63)) & 1 > 0
        return pa.array(hit)

    return run(*_places(name))


def full_sets(docs: DataFrame, wanted: DataFrame, count: int, size: int = SHINGLE) -> DataFrame:
    """(node, hashes) of the wanted (node, name), at most `count`: the sets of these texts, made from the text again."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [shingles(t, size).tobytes() for t in _texts(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(made, pa.binary())], names=["node", "hashes"])

    named = docs.select("text", _name(F.col("text")))
    found = named.where(_maybe(wanted, F.col("name"))).join(merged(wanted, count), "name").select("node", "text")
    # copies of a text make equal sets
    return found.mapInArrow(run, "node bigint, hashes binary").groupBy("node").agg(F.any_value("hashes").alias("hashes"))


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, radius: int = RADIUS,
                    tile: int = TILE) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    Texts link at a Jaccard similarity of `percent` or more; of those that do, all within `radius` differing
    symbols are found, where the radius is at most what the chunks guarantee.
    """
    if radius > RADIUS:
        raise ValueError(f"chunks of this shape guarantee a radius of {RADIUS}")
    rows = cut(prints(docs, size), "minhash-prints")
    nodes = cut(rows.where("n > 0").groupBy("set").agg(
        F.min("doc_id").alias("least"), F.min("name").alias("name"), F.any_value("n").alias("n"), F.any_value("sign").alias("sign"))
        .withColumn("node", F.monotonically_increasing_id()), "minhash-nodes")
    count = nodes.count()
    keyed = keys(nodes)
    leaders = keyed.groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("c")).where("c > 1").drop("c")
    shared = cut(keyed.join(merged(leaders), "key"), "minhash-keys")

    # the short cut: each node against the one it shares most keys with
    tries = (shared.where("node <> leader").groupBy("node", "leader").agg(F.count("*").alias("c")).where(F.col("c") >= TRY_FROM)
             .groupBy("node").agg(F.max_by("leader", F.struct("c", "leader")).alias("leader")))
    tries = cut(tries, "minhash-tries")
    weights = tries.join(merged(nodes.select("node", "n"), count), "node")
    parts = (weights.groupBy("leader").agg(F.ceil(F.greatest(F.count("*") / tile, F.sum("n") / TILE_SHINGLES)).cast("int").alias("p")))
    stars = tries.join(merged(parts, count), "leader").select(
        F.col("leader").alias("key"), F.pmod(F.xxhash64("node"), F.col("p")).cast("int").alias("x"), F.lit(-1).alias("y"),
        F.lit(False).alias("first"), "node")
    heads = parts.select(F.col("leader").alias("key"), F.explode(F.sequence(F.lit(0), F.col("p") - 1)).alias("x"), F.lit(-1).alias("y"),
                         F.lit(True).alias("first"), F.col("leader").alias("node"))
    stars = cut(stars.union(heads), "minhash-stars")
    sets = _sets(docs, nodes, stars, count, size)
    tied = cut(confirmed(stars, sets, percent).distinct(), "minhash-tied")
    classes = components(tied, "minhash-classes")

    # the exact rest: pairs in reach whose classes differ
    contested = cut(_contested(shared, nodes, classes, count, radius, percent, tile), "minhash-contested")
    more = _sets(docs, nodes, contested.join(merged(sets, count), "node", "left_anti"), count, size)
    linked = confirmed(contested, sets.union(more), percent).distinct()
    roots = components(cut(tied.union(linked), "minhash-links"), "minhash-components")
    rooted = nodes.join(merged(roots, count), "node", "left").select("set", "least", F.coalesce("root", "node").alias("root"))
    rooted = cut(rooted, "minhash-rooted")
    named = rooted.join(merged(rooted.groupBy("root").agg(F.min("least").alias("component_id")), count), "root").select("set", "component_id")
    found = rows.join(merged(named, count), "set", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _sets(docs: DataFrame, nodes: DataFrame, members: DataFrame, count: int, size: int) -> DataFrame:
    """The full sets of all nodes among `members`, at most `count`."""
    wanted = nodes.select("node", "name").join(merged(members.select("node").distinct(), count), "node", "left_semi")
    return cut(full_sets(docs, cut(wanted, "minhash-wanted"), count, size), "minhash-sets")
