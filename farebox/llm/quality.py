"""Quality rules: document statistics, and boosted trees over them.

Words are runs of anything but the six ASCII white-space characters. The statistics cover
whole texts; the model is fitted on at most `sample` labelled rows.

Defined results: a null text has no words and only zeros; such a text, like every one under
20 words, fails the base rule. Repeated rows are judged alike, extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from farebox.llm.boosting import Trees, fit
from farebox.llm.common import fresh

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_lines", "n_distinct", "n_upper", "n_digits", "n_chars_all", "n_wordless", "longest"]
SYMBOLS = "#*$%&|<>"
#: ASCII digits and punctuation; a word of nothing else is wordless.
NO_LETTERS = bytes(c for c in range(33, 127) if not chr(c).isalpha())
WINDOW = 8
MIN_WORDS, MAX_REPEAT_PCT = 20, 30
#: Labelled rows the trees are fitted on, at most.
SAMPLE = 12_000
#: A document goes if the trees give it less than this chance of good quality.
KEEP_FROM = 0.5


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """How many words lie in a window of `window` words (a power of two) that occurs twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    rank = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    width = 1
    while width < window:  # equal ranks: equal runs of `width` words
        pair = rank[:-width] * (int(rank.max()) + 1) + rank[width:]
        rank = np.unique(pair, return_inverse=True)[1]
        if len(rank) == rank.max() + 1:
            return 0  # every run is unique already
        width *= 2
    again = np.bincount(rank)[rank] > 1
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.flatnonzero(again)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((edge.cumsum() > 0).sum())


def statistics(text: str | None) -> tuple[int, ...]:
    """BASE and MORE of one text."""
    if not text:
        return (0,) * (len(BASE) + len(MORE))
    raw = text.encode("utf-8")
    words = raw.split()  # on exactly the six ASCII white-space characters
    lines = [x for x in raw.split(b"\n") if x.split(None, 1)]
    blank = sum(map(raw.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
    symbols = sum(map(text.count, SYMBOLS))
    return (len(words), len(text) - blank, symbols, len(lines) - len(set(lines)), repeat_words(words),
            len(lines), len(set(words)),
            len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
            len(raw) - len(raw.translate(None, b"0123456789")), len(text),
            len(words) - len(raw.translate(None, NO_LETTERS).split()),
            max(map(len, words), default=0))


def features(stats: pd.DataFrame) -> np.ndarray:
    """What the trees see: sizes as logarithms, the rest as shares."""
    s = {c: stats[c].to_numpy(dtype=float) for c in BASE + MORE}
    words, lines, chars = (np.maximum(s[c], 1) for c in ("n_words", "n_lines", "n_chars_all"))
    return np.column_stack([
        np.log1p(s["n_words"]), s["word_chars"] / words, s["n_symbols"] / words, s["n_dup_lines"] / lines,
        s["n_repeat_words"] / words, s["n_words"] / lines, s["n_distinct"] / words, s["n_upper"] / chars,
        s["n_digits"] / chars, s["n_wordless"] / words, np.log1p(s["longest"])])


#: Direction of the score along each feature: more symbols, repeated lines, repeated words or
#: wordless tokens never raise it.
SIGNS = [0, 0, -1, -1, -1, 0, 0, 0, 0, -1, 0]


def statistics_column(text: Column) -> Column:
    kind = T.StructType([T.StructField(c, T.LongType()) for c in BASE + MORE])

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([statistics(t) for t in texts], columns=BASE + MORE, dtype="int64")

    return run.asNondeterministic()(text)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Trees for `labels.quality` on at most `sample` labelled documents, the same on every run.

    Rows are taken by a hash of doc_id; only their statistics reach the driver.
    """
    chosen = (labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
              .groupBy("doc_id").agg(F.max("quality").alias("quality"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    rows = (docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most `sample` ids
            .select("doc_id", "quality", statistics_column(F.col("text")).alias("s"))
            .select("doc_id", "quality", "s.*").toPandas())
    rows = rows.sort_values(["doc_id", *BASE, *MORE])
    return fit(features(rows), rows["quality"].to_numpy(dtype=float), SIGNS)


def judge(docs: DataFrame, trees: Trees, text: str = "text", keep_from: float = KEEP_FROM) -> DataFrame:
    """`docs` with a struct `quality_rules`: the statistics, base_failed, score and kept."""
    kind = T.StructType([T.StructField(c, T.LongType()) for c in BASE]
                        + [T.StructField("base_failed", T.BooleanType()), T.StructField("score", T.DoubleType()),
                           T.StructField("kept", T.BooleanType())])

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            stats = pd.DataFrame([statistics(t) for t in texts], columns=BASE + MORE, dtype="int64")
            out = stats[BASE].copy()
            out["base_failed"] = ((stats.n_words < MIN_WORDS)
                                  | (100 * stats.n_repeat_words > MAX_REPEAT_PCT * stats.n_words))
            out["score"] = trees.probability(features(stats)) if len(stats) else 0.0
            out["kept"] = ~out.base_failed & (out.score >= keep_from)
            yield out

    (name,) = fresh(docs, "quality_rules")
    return docs.withColumn(name, run.asNondeterministic()(F.col(text)))
