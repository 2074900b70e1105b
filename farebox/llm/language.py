"""Language identification by the nearest of several centroids per language.

A text becomes a normalised TF-IDF vector of letter n-grams (one to three letters, runs of
anything else as one space, hashed into a fixed number of cells). The training vectors of each
language are clustered on the sphere; the language of the centroid with the largest cosine is
predicted. A text further from it than almost all training members of that cluster is marked
`rejected`.

Whole texts are read, a stretch of characters at a time. Learned from a bounded sample (IDF and
clusters are part of the fitted model): of every language, however many there are, up to `per_lang`
texts of at most `max_chars` characters, fewer where `max_sample` texts in all would be passed but at least
one; of a language that has only longer texts, their first `max_chars` characters. The sample is
held by the driver as pairs of cell and count, at most 48 KB a text, and clustered one language at a time.

Defined results: a null text, or one without a letter, is `und` with score 0 and rejected; so is
every text when nothing was learned. Equal cosines go to the language that sorts first. Repeated rows are
judged alike, extra columns pass through.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from farebox.llm.common import cut, fresh, hash_share

CELLS = 1 << 13
STRETCH = 1 << 19
PER_LANG, MAX_CHARS, MAX_SAMPLE = 800, 20_000, 8_000


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or a space."""
    table = np.full(sys.maxunicode + 1, 32, dtype=np.uint32)
    for c in range(sys.maxunicode + 1):
        if chr(c).isalpha():
            low = chr(c).lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def counts(text: str | None, cells: int = CELLS) -> np.ndarray | None:
    """N-gram counts of the whole text, or None without a letter."""
    if not text:
        return None
    total, any_letter = np.zeros(cells), False
    old = np.array([32], dtype=np.uint64)  # at most two characters before the stretch
    table = _letters()
    for at in range(0, len(text), STRETCH):
        code = table[np.frombuffer(text[at:at + STRETCH].encode("utf-32-le", "replace"), dtype="<u4")].astype(np.uint64)
        any_letter = any_letter or bool((code != 32).any())
        run = np.concatenate([old, code, [32]] if at + STRETCH >= len(text) else [old, code]).astype(np.uint64)
        run = run[np.append(True, (run[1:] != 32) | (run[:-1] != 32))]
        # the grams whose last character is new
        one, two, three = run[len(old):], run[max(len(old), 1) - 1:], run[max(len(old), 2) - 2:]
        one = one[one != 32] * np.uint64(0x85EBCA77)
        two = (two[:-1] * np.uint64(0x9E3779B1) + two[1:]) * np.uint64(0xC2B2AE3D)
        three = (three[:-2] * np.uint64(0x27D4EB2F) + three[1:-1]) * np.uint64(0x165667B1) + three[2:]
        for h in (one, two + np.uint64(7), three * np.uint64(0xD3A2646C) + np.uint64(13)):
            h = (h ^ (h >> np.uint64(29))) & np.uint64(cells - 1)
            total += np.bincount(h.astype(np.int64), minlength=cells)
        old = run[-2:]
    return total if any_letter else None


@dataclass
class Centroids:
    idf: np.ndarray
    centre: np.ndarray  # one unit vector per row
    lang: list[str]  # of each row
    reach: np.ndarray  # least cosine that is not rejected

    def vectors(self, rows: list[np.ndarray]) -> np.ndarray:
        v = np.log1p(np.asarray(rows, dtype=np.float32)) * self.idf
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def nearest(self, texts: list[str | None]) -> pd.DataFrame:
        out = pd.DataFrame({"lang": "und", "score": 0.0, "rejected": True}, index=range(len(texts)))
        lang, score, rejected = out["lang"].to_numpy(copy=True), np.zeros(len(texts)), np.ones(len(texts), bool)
        if len(self.lang):
            names = np.array(self.lang, dtype=object)
            for at in range(0, len(texts), 128):
                rows = [(i, c) for i in range(at, min(at + 128, len(texts))) if (c := counts(texts[i])) is not None]
                if rows:
                    which = np.array([i for i, _ in rows])
                    cosine = self.vectors([c for _, c in rows]) @ self.centre.T
                    best = cosine.argmax(axis=1)
                    lang[which], top = names[best], cosine.max(axis=1)
                    score[which], rejected[which] = np.clip(top, 0, 1), top < self.reach[best]
        return pd.DataFrame({"lang": lang, "score": score, "rejected": rejected})


def fit(texts: list[str], langs: list[str], clusters: int = 4, rounds: int = 12, reject: float = 0.001) -> Centroids:
    """Spherical k-means per language, started from members far apart; deterministic."""
    pairs, seen = [], np.zeros(CELLS)  # (cells, counts, language) of each text
    for t, g in zip(texts, langs):
        if (c := counts(t)) is not None:
            at = np.flatnonzero(c)
            pairs.append((at.astype(np.uint16), c[at].astype(np.float32), g))
            seen[at] += 1

    def dense(at: np.ndarray, n: np.ndarray) -> np.ndarray:
        row = np.zeros(CELLS, np.float32)
        row[at] = n
        return row

    idf = np.log((1 + len(pairs)) / (1 + seen)).astype(np.float32) + np.float32(0.1)
    model = Centroids(idf, np.zeros((0, CELLS), np.float32), [], np.zeros(0))
    centres, names, reach = [], [], []
    members: dict[str, list] = {}
    for at, n, g in pairs:
        members.setdefault(g, []).append((at, n))
    for g in sorted(members):
        v = model.vectors([dense(*m) for m in members[g]])
        centre = v.mean(axis=0, keepdims=True)
        centre /= np.linalg.norm(centre)
        while len(centre) < min(clusters, len(v)):
            centre = np.vstack([centre, v[(v @ centre.T).max(axis=1).argmin()]])
        for _ in range(rounds):
            own = (v @ centre.T).argmax(axis=1)
            for k in range(len(centre)):
                if (own == k).any():
                    centre[k] = v[own == k].sum(axis=0)
            centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-9)
        cosine = v @ centre.T
        own, top = cosine.argmax(axis=1), cosine.max(axis=1)
        for k in range(len(centre)):
            names.append(g)
            reach.append(float(np.quantile(top[own == k], reject)) * 0.9 if (own == k).any() else 0.0)
        centres.append(centre)
    if centres:
        model.centre, model.lang, model.reach = np.vstack(centres).astype(np.float32), names, np.array(reach)
    return model


def train(docs: DataFrame, where: Column, per_lang: int = PER_LANG, max_chars: int = MAX_CHARS,
          max_sample: int = MAX_SAMPLE) -> Centroids:
    """Fit on rows with a language that satisfy `where`, drawn for each language by a hash of doc_id and text."""
    rows = docs.select("doc_id", "text", "lang").where(where & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.withColumn("_fits", F.char_length("text") <= max_chars)
    sizes = rows.groupBy("lang").agg(F.count_if("_fits").alias("_short"), F.count("*").alias("_all"))  # one row per language
    sizes = cut(sizes, "languages")
    each = max(1, min(per_lang, max_sample // max(1, sizes.count())))
    key = F.xxhash64(F.lit("language"), "doc_id", "text")
    of = F.when(F.col("_short") > 0, F.col("_short")).otherwise(F.col("_all"))
    # twice as many as are kept, so that no language comes short; then the first by hash
    drawn = (rows.join(sizes, "lang").where(F.col("_fits") | (F.col("_short") == 0))
             .where(hash_share(key, "language") * of < 2 * each + 20)
             .withColumn("_key", key).withColumn("_rank", F.row_number().over(W.partitionBy("lang").orderBy("_key", "doc_id")))
             .where(F.col("_rank") <= each)
             .select("doc_id", F.substring("text", 1, max_chars).alias("text"), "lang").toPandas().sort_values(["doc_id", "lang", "text"]))
    return fit(drawn["text"].tolist(), drawn["lang"].tolist())


def identify(docs: DataFrame, model: Centroids, text: str = "text") -> DataFrame:
    """`docs` with a struct `language`: lang, score (cosine, 0 to 1) and rejected."""
    kind = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()),
                         T.StructField("rejected", T.BooleanType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most `clusters` rows of CELLS a language

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield shared.value.nearest(texts.tolist())

    (name,) = fresh(docs, "language")
    return docs.withColumn(name, run.asNondeterministic()(F.col(text)))
