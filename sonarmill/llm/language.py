"""Language by nearest centroid over normalised TF-IDF vectors of byte n-grams.

Runs of two and three bytes of a text (letters lower-cased, all else one
separator) are hashed to a vector of fixed width. A language has several
centroids, found by spherical k-means among its own training vectors, so that
one language may have many styles. A text gets the language of the centroid
with the largest cosine; ``rejected`` tells that it lies further from every
centroid than nearly all training texts do from theirs.

The classifier is fitted on a sample of at most about ``max_train`` labelled rows,
split evenly among the languages, chosen by a hash of the id; every text is
classified as a whole.

Nulls: a null text, or one without a letter, is ``und`` with score 0. Rows
with a null lang, or held out, teach nothing. Without training rows every
text is ``und``. Equal cosines go to the first language by name. Repeated rows
are classified alike; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonarmill.llm.splits import held_out
from sonarmill.llm.textnum import slabs

WIDTH_BITS = 12
WIDTH = 1 << WIDTH_BITS
MAX_TRAIN = 4000
CENTROIDS = 4
REJECT_SHARE = 0.005  # of training texts that may lie beyond the radius

_FOLD = np.full(256, 32, np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[97:123] = np.arange(97, 123)
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def gram_counts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, bool]]:
    """(row, counts of hashed n-grams, whether the text has a letter) of every text."""
    for first, data, off in slabs(column):
        low = _FOLD[data]
        capital = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[:-1] == 0xC3) & (data[1:] != 0x97)) + 1
        low[capital] += 32  # capitals of the Latin-1 letters
        ascii_letter = _ASCII_LETTER[data]
        wide = low.astype(np.uint32)
        two = ((wide[:-1] << 8 | wide[1:]) * np.uint32(2654435761)) >> np.uint32(32 - WIDTH_BITS) if len(wide) > 1 else wide[:0]
        three = ((wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]) * np.uint32(2246822519)) >> np.uint32(32 - WIDTH_BITS) if len(wide) > 2 else wide[:0]
        for k in range(len(off) - 1):
            a, b = int(off[k]), int(off[k + 1])
            counts = np.bincount(two[a : max(a, b - 1)], minlength=WIDTH) + np.bincount(three[a : max(a, b - 2)], minlength=WIDTH)
            letter = bool(ascii_letter[a:b].any()) or any(c.isalpha() for c in data[a:b].tobytes().decode("utf-8", "replace"))
            yield first + k, counts, letter


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    radius: np.ndarray  # least cosine of each centroid


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts.astype(np.float32)) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def clusters(v: np.ndarray, k: int, rounds: int = 20) -> np.ndarray:
    """Spherical k-means; starts are chosen far from each other, the first next to the mean."""
    mean = v.mean(axis=0)
    centres = [v[int(np.argmax(v @ mean))]]
    while len(centres) < min(k, len(v)):
        centres.append(v[int(np.argmin((v @ np.array(centres).T).max(axis=1)))])
    c = np.array(centres)
    for _ in range(rounds):
        near = np.argmax(v @ c.T, axis=1)
        new = np.array([v[near == j].sum(axis=0) if (near == j).any() else c[j] for j in range(len(c))])
        new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
        if np.allclose(new, c, atol=1e-6):
            break
        c = new
    return c


def fit(languages: list[str], counts: np.ndarray, k: int = CENTROIDS) -> Model:
    """``languages``: one name a row of ``counts``."""
    n = len(counts)
    idf = (np.log((1 + n) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32)
    v = vectors(counts, idf)
    names = sorted(set(languages))
    label = np.array([names.index(x) for x in languages])
    centroids, owner, radius = [], [], []
    for j in range(len(names)):
        own = v[label == j]
        c = clusters(own, k)
        cos = own @ c.T
        near = cos.argmax(axis=1)
        for i in range(len(c)):
            centroids.append(c[i])
            owner.append(j)
            mine = cos[near == i, i]
            radius.append(float(np.quantile(mine, REJECT_SHARE)) if len(mine) >= 20 else float(np.quantile(cos.max(axis=1), REJECT_SHARE)))
    return Model(names, idf, np.array(centroids, np.float32), np.array(owner), np.array(radius))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            packed = [np.minimum(c, 65535).astype(np.uint16).tobytes() for _, c, _ in gram_counts(part.column(0))]
            yield pa.RecordBatch.from_arrays([part.column(1), pa.array(packed, pa.binary())], names=["lang", "counts"])


def learn(docs: DataFrame, max_train: int = MAX_TRAIN, k: int = CENTROIDS) -> Model | None:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    if not sizes:
        return None
    each = max(1, max_train // len(sizes))
    share = F.lit(0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(int(1_000_000 * min(1.0, each / n)) + 1)).otherwise(share)
    chosen = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_000)) < share).limit(2 * max_train)
    got = chosen.select("text", "lang").mapInArrow(_featured, "lang string, counts binary").toPandas()
    if not len(got):
        return None
    order = np.lexsort((got["counts"].to_numpy(), got["lang"].to_numpy()))  # the fit doesn't depend on the order of arrival
    counts = np.stack([np.frombuffer(got["counts"][i], np.uint16) for i in order])
    return fit([got["lang"][i] for i in order], counts, k)


def _classified(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                part = batch.slice(at, 250)
                n = part.num_rows
                lang, score, rejected = ["und"] * n, np.zeros(n), np.zeros(n, bool)
                found = list(gram_counts(part.column(1)))
                if model is not None:
                    cos = vectors(np.stack([c for _, c, _ in found]), model.idf) @ model.centroids.T
                    best = cos.argmax(axis=1)
                    top = cos[np.arange(n), best]
                    for row, _, letter in found:
                        if letter:
                            lang[row] = model.languages[model.owner[best[row]]]
                            score[row] = min(1.0, max(0.0, float(top[row])))
                            rejected[row] = top[row] < model.radius[best[row]]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "rejected"])

    return run


def classify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score and rejected of every row."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_classified(model), "doc_id long, lang_pred string, score double, rejected boolean")


def op2_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return classify(docs, learn(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
