"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations only.

Each source's documents stand in a shuffled order, cut into blocks of `block` words; the last block
of a source may be shorter and counts at its true size. A source that gives `words` words needs so
many slots: its blocks in turn, from the first again after the last, until the words are reached, the
last slot cut to what is missing. Slot i of the mix falls on the golden-ratio point i * phi mod 1,
which the sources' cumulative shares of all slots map to a source; slots are ranked per source, and
the r-th slot of a source takes block r mod (its blocks). The points give a source a few slots more
or less than it needs: ranks beyond the need fall away, and missing ranks are closing slots, which
stand at a golden-ratio point of the whole mix. So each source gives its target to the word,
however short it is. The mix, in order, is the join of slots and documents on (source, block).

Nothing meets in one task: documents are placed by ranges of their whole order, slots are ranked in
spans of `CHUNK` slots, each with the sums of the ranges or spans before; blocks are joined by number, and
a slot finds its source among the few whose share touches its point's bucket. One row per source
passes through windows without a partition.

Targets: the sources' weights share all words; a target stops at `most` times its source's
words and the excess goes to the others by weight.

Defined results: a null or empty text has size 0 and is taken 0 times; sources of size 0 have
target 0; null sources form one source, last in order. Rows that repeat are each placed and
taken for themselves; rows equal in doc_id as well lie side by side, rows without doc_id by a
hash of their text. An empty table gives an empty mix. Reruns give the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from farebox.llm.common import WORD, cut, fresh

WEIGHTS, MOST = (5, 2, 1), 3
#: Golden-ratio points as a lattice: i * STEP mod LATTICE, neighbouring Fibonacci numbers.
LATTICE, STEP = 1_836_311_903, 1_134_903_170
#: Words of a block, and slots that are ranked together.
BLOCK, CHUNK = 512, 1 << 16
SEED = "mix"


def key(source: Column) -> Column:
    """A source as a join key that is never null."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit("-"))


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, s (source key), source, size and h (place in the shuffled source) of every row."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("-"), F.md5(F.coalesce("text", F.lit("")))))
    return docs.select("doc_id", "source", key(F.col("source")).alias("s"),
                       F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
                       F.md5(F.concat(name, F.lit(f":{SEED}"))).alias("h"))


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per source: s, place (from 1, in order of the sources), source_size and target.

    Filling by weight up to caps: in order of cap / weight, the sources before the first that
    its share does not fill are full, the others share the rest by weight.
    """
    one = rows.groupBy("s").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    # windows over one row per source
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(most))
    one = (one.withColumn("rank", F.row_number().over(order)).withColumn("weight", weight).withColumn("cap", cap)
           .withColumn("ratio", F.col("cap") / F.col("weight")))
    full = W.orderBy("ratio", "rank")
    everything = W.partitionBy()
    level = ((F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(full.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
             / F.sum("weight").over(full.rowsBetween(0, W.unboundedFollowing)))
    one = one.withColumn("place", F.row_number().over(full)).withColumn("level", level)
    free = F.min(F.when(F.col("cap") > F.col("level") * F.col("weight"), F.struct("place", "level"))).over(everything)
    one = one.withColumn("free", free).withColumn("target", F.when(
        F.col("free").isNull() | (F.col("place") < F.col("free.place")), F.col("cap"))
        .otherwise(F.col("free.level") * F.col("weight")))
    return one.select("s", F.col("rank").alias("place"), "source_size", "target")


def needs(of: DataFrame, block: int = BLOCK) -> DataFrame:
    """`targets` with words (the whole words to give), blocks, slots and the span [low, high) of lattice points."""
    of = of.withColumn("words", F.floor(F.col("target") + F.lit(0.5)))
    of = of.withColumn("blocks", F.expr(f"(source_size + {block - 1}) div {block}"))
    of = of.withColumn("slots", F.when(F.col("source_size") == 0, F.lit(0)).otherwise(F.expr(
        f"words div source_size * blocks + (words % source_size + {block - 1}) div {block}")).cast("long"))
    share = W.orderBy("place")  # a window over one row per source
    upto, everything = F.sum("slots").over(share), F.sum("slots").over(W.partitionBy())

    def point(x: Column) -> Column:
        return F.coalesce(F.floor(F.try_divide(x.cast("double"), everything.cast("double")) * F.lit(float(LATTICE))), F.lit(0)).cast("long")

    return of.withColumns({"low": point(upto - F.col("slots")), "high": point(upto)})


def places(rows: DataFrame) -> DataFrame:
    """`rows` of size above 0 with `start`, their first word's position in the shuffled source.

    Rows are dealt into ranges of their whole order and written with their range; a start is the running sum in
    the range plus those of the ranges before.
    """
    order = ["s", "h", "doc_id", "size", "row"]
    rows = cut(rows.where("size > 0").withColumn("row", F.monotonically_increasing_id()), "sized")  # tells equal rows apart
    ranged = cut(rows.select(*order).repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy("s", "range").agg(F.sum("size").alias("n"))
    before = sums.select("s", "range", (F.sum("n").over(W.partitionBy("s").orderBy("range")) - F.col("n")).alias("before"))
    inside = W.partitionBy("range", "s").orderBy("h", "doc_id", "size", "row").rowsBetween(W.unboundedPreceding, 0)
    return (ranged.withColumn("upto", F.sum("size").over(inside)).join(before, ["s", "range"])
            .select("doc_id", "s", "size", (F.col("before") + F.col("upto") - F.col("size")).alias("start")))


def drawn(of: DataFrame) -> DataFrame:
    """slot and s of every slot: the source whose span holds the slot's golden-ratio point. Every slot has one."""
    total, sources = of.agg(F.sum("slots"), F.count("*")).first()
    total, buckets = total or 0, max(1024, 2 * sources)
    near = F.sequence(F.expr(f"low * {buckets} div {LATTICE}"), F.expr(f"(high - 1) * {buckets} div {LATTICE}"))
    spans = of.where("high > low").select("s", "low", "high", F.explode(near).alias("bucket"))
    point = F.expr(f"(slot % {LATTICE}) * {STEP} % {LATTICE}")
    slots = of.sparkSession.range(total).select(F.col("id").alias("slot")).withColumn("point", point)
    slots = slots.withColumn("bucket", F.expr(f"point * {buckets} div {LATTICE}"))
    return slots.join(spans, "bucket").where("point >= low and point < high").select("slot", "s")


def schedule(of: DataFrame, block: int = BLOCK) -> DataFrame:
    """The slots of the mix, of `needs`: slot, extra, s, rank, block and words; in order of slot, extra and s.

    `extra` is 0 for a drawn slot and counts the closing slots of a source from 1.
    """
    slots = cut(drawn(of).withColumn("chunk", F.expr(f"slot div {CHUNK}")), "slots")
    sums = slots.groupBy("s", "chunk").agg(F.count("*").alias("n"))
    before = sums.select("s", "chunk", (F.sum("n").over(W.partitionBy("s").orderBy("chunk")) - F.col("n")).alias("before"))
    inside = F.row_number().over(W.partitionBy("chunk", "s").orderBy("slot"))
    ranked = (slots.withColumn("inside", inside).join(before, ["s", "chunk"])
              .select("slot", F.lit(0).cast("long").alias("extra"), "s", (F.col("before") + F.col("inside") - 1).alias("rank")))
    kept = ranked.join(of, "s").where("rank < slots")
    got = sums.groupBy("s").agg(F.sum("n").alias("got"))
    short = of.join(got, "s", "left").withColumn("got", F.coalesce("got", F.lit(0).cast("long"))).where("got < slots")
    total = of.agg(F.sum("slots").alias("all"))  # one row
    closing = (short.withColumn("rank", F.explode(F.sequence(F.col("got"), F.col("slots") - 1)))
               .withColumn("extra", F.col("rank") - F.col("got") + 1)
               .withColumn("slot", F.floor(F.expr(f"(place + rank) % {LATTICE} * {STEP} % {LATTICE}")
                                           / F.lit(float(LATTICE)) * F.lit(total.first()[0] or 0))))
    columns = ["slot", "extra", "s", "rank", "source_size", "blocks", "words"]
    both = kept.select(*columns).unionByName(closing.select(*columns))
    at = both.withColumn("block", F.expr("rank % blocks"))
    full = F.least(F.lit(block).cast("long"), F.col("source_size") - F.col("block") * block)
    left = F.col("words") - F.expr(f"rank div blocks * source_size + block * {block}")
    return at.select("slot", "extra", "s", "rank", "block", F.least(full, left).alias("words"))


def pieces(placed: DataFrame, block: int = BLOCK) -> DataFrame:
    """`places` with one row per block that a document touches: block, first (its first word there) and upto, within the block."""
    spread = F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))
    return (placed.withColumn("block", F.explode(spread))
            .withColumns({"first": F.greatest(F.lit(0), F.col("start") - F.col("block") * block),
                          "upto": F.least(F.lit(block), F.col("start") + F.col("size") - F.col("block") * block)}))


def _sources(rows: DataFrame, weights: tuple[int, ...], most: int, block: int) -> DataFrame:
    return cut(needs(targets(rows, weights, most), block), "targets")  # one row per source


def segments(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """The mix itself, of `sizes`: slot, extra, s, first, doc_id, begin and words.

    Ordered by slot, extra, s and first: each row is the stretch of `words` words of the document from its word
    `begin` on that stands there in the mix.
    """
    held = pieces(places(rows), block).withColumnRenamed("s", "_s").withColumnRenamed("block", "_b")
    slots = schedule(_sources(rows, weights, most, block), block)
    joined = slots.join(held, (F.col("s") == F.col("_s")) & (F.col("block") == F.col("_b")) & (F.col("first") < F.col("words")))
    return joined.select("slot", "extra", "s", "first", "doc_id", (F.col("block") * block + F.col("first") - F.col("start")).alias("begin"),
                         (F.least("upto", "words") - F.col("first")).alias("words"))


def taken(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """doc_id, s, size, source_size, target and taken of every row of `sizes`: the words of its stretches in the mix."""
    of = _sources(rows, weights, most, block)
    slots = schedule(of, block).select(F.col("s").alias("_s"), F.col("block").alias("_b"), "words")
    held = pieces(places(rows), block)
    joined = held.join(slots, (held["s"] == slots["_s"]) & (held["block"] == slots["_b"]) & (held["first"] < slots["words"]), "left")
    words = F.sum(F.when(F.col("words").isNull(), F.lit(0)).otherwise(F.least("upto", "words") - F.col("first"))).cast("long")
    given = joined.groupBy("s", "start", "size", "doc_id").agg(words.alias("taken")).drop("start")  # start tells the rows of a source apart
    empty = rows.where("size = 0").select("s", "size", "doc_id", F.lit(0).cast("long").alias("taken"))
    return (given.unionByName(empty).join(of, "s")
            .select("doc_id", "s", "size", "source_size", "target", "taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """doc_id, s, size, source_size, target and taken of every row."""
    return taken(cut(sizes(docs), "sizes"), weights, most)


def ordered_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The mix as stretches of documents in order: see `segments`."""
    return segments(cut(sizes(docs), "sizes"), weights, most).orderBy("slot", "extra", "s", "first")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The mix as rows: each document as often as its words are taken, to the nearest whole number.

    Rows equal in doc_id, source and size are repeated equally often.
    """
    copies = (mix(docs, weights, most).where("size > 0").groupBy("doc_id", "s", "size")
              .agg(F.round(F.avg("taken") / F.col("size")).cast("int").alias("n")).where("n > 0"))
    d, s, n, z = fresh(docs, "_d", "_s", "_n", "_z")
    named = copies.select(F.col("doc_id").alias(d), F.col("s").alias(s), F.col("size").alias(z), F.col("n").alias(n))
    own = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    joined = docs.join(named, docs["doc_id"].eqNullSafe(F.col(d)) & (key(docs["source"]) == F.col(s)) & (own == F.col(z)))
    return joined.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*[docs[c] for c in docs.columns])
