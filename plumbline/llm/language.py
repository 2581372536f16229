"""Language identification by nearest centroid.

A text is a vector of hashed letter trigrams, weighted by TF-IDF and scaled to
length one.  Each language has several centroids, clustered by spherical
k-means on a bounded sample of labelled documents (about PER_LANGUAGE different
texts of each, picked by a hash of the text); a text takes the language of the centroid nearest by
cosine.  A text farther from all centroids than nearly every labelled training
text of about its length is rejected; the scores of all of these are counted,
not those of the sample.  Prediction reads whole texts and nothing else.

Defined results: a text that is null or has no letter is ``und`` with score 0,
as is every text if nothing was learned; ties go to the first language by name;
equal rows get equal results; an empty table gives no rows; columns not named
are passed over.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

BUCKETS, CENTROIDS, PER_LANGUAGE, ROUNDS = 4096, 4, 500, 12
#: A text is rejected at this share of the least usual cosine of training texts of its length.
TOLERANCE, USUAL = 0.6, 0.002
#: Classes of length, texts that fill one, and steps in which scores are counted.
SIZES, FILLED, STEPS = 16, 50, 4096
_LETTER = re.compile(r"[^\W\d_]")
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)


def trigrams(text: str) -> np.ndarray:
    """Counts of hashed trigrams of a whole text; all but letters count as one space."""
    raw = _FOLD[np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8)]
    raw = raw[np.concatenate([[True], (raw[1:] != 0x20) | (raw[:-1] != 0x20)])].astype(np.uint32)
    code = (raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]
    return np.bincount((code * np.uint32(0x9E3779B1)) >> np.uint32(20), minlength=BUCKETS)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    floors: np.ndarray

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        weighted = np.log1p(counts)
        weighted *= self.idf
        weighted /= np.maximum(np.linalg.norm(weighted, axis=1, keepdims=True), 1e-12)
        return weighted

    def measure(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Which texts have a letter; their nearest centroids, scores and classes of length."""
        known = np.array([bool(x) and bool(_LETTER.search(x)) for x in texts], bool)
        counts, total = np.zeros((len(texts), BUCKETS), np.float32), np.zeros(len(texts), np.int64)
        for n in np.flatnonzero(known).tolist():
            found = trigrams(texts[n])
            counts[n], total[n] = found, found.sum()
        near = self.vectors(counts) @ self.centroids.T
        return known, near.argmax(axis=1), np.clip(near.max(axis=1), 0, 1).astype(float), _size_class(total)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, scores, and which texts are rejected."""
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts)), np.array([not x or not _LETTER.search(x) for x in texts], bool)
        known, at, score, sizes = self.measure(texts)
        far = score < self.floors[sizes]
        return [self.languages[self.owner[a]] if k else "und" for a, k in zip(at, known, strict=True)], np.where(known, score, 0.0), ~known | far


def _size_class(total: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(total, 1)).astype(int), SIZES - 1)


def _cluster(rows: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Spherical k-means; at most CENTROIDS unit vectors."""
    k = min(CENTROIDS, len(rows))
    middle = rows[rng.choice(len(rows), k, replace=False)]
    for _ in range(ROUNDS):
        own = (rows @ middle.T).argmax(axis=1)
        sums = np.array([rows[own == n].sum(axis=0) if (own == n).any() else middle[n] for n in range(k)])
        middle = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return middle


def floors(scores: np.ndarray) -> np.ndarray:
    """Least accepted score of each class of length, from counts of scores by class and step.

    A class that is not filled takes the floor of the nearest one that is (of
    the fullest if none is).  Cosines of short texts go with the root of their
    length, so for shorter texts the floor is scaled by it; for longer ones, which are
    nearer to a centroid, it stays.
    """
    held = scores.sum(axis=1)
    if not held.any():
        return np.zeros(SIZES)
    full = np.flatnonzero(held >= min(FILLED, held.max()))
    # The first step up to which more than the share USUAL of the class lies; its middle is never 0.
    usual = [(int((np.cumsum(scores[n]) > USUAL * held[n]).argmax()) + 0.5) / STEPS for n in full]
    near = [int(np.abs(full - n).argmin()) for n in range(SIZES)]
    return np.array([TOLERANCE * usual[k] * min(1.0, 2.0 ** ((n - full[k]) / 2)) for n, k in enumerate(near)])


def held_out(id_column: str = "doc_id") -> Column:
    key = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    return F.crc32(F.encode(key, "UTF-8")) % 4 == 2


def fit(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> Model:
    """A model of the labelled documents that are not held out.

    The driver gets about PER_LANGUAGE sparse vectors of a language, of which
    the model holds CENTROIDS, and counts of the scores of all texts, of SIZES by
    STEPS cells at most.
    """
    common.ship_package(docs.sparkSession)
    train = docs.where(~held_out(id_column) & F.col(lang_column).isNotNull() & F.col(text_column).isNotNull())
    train = train.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"), F.col(lang_column).cast("string").alias("lang"))
    # Copies of a text count once, and of a picked text one goes on, however many there are.
    key = F.xxhash64(F.lit("language"), "text")
    counts = train.select("lang", key.alias("key")).distinct().groupBy("lang").agg((F.lit(float(PER_LANGUAGE)) / F.count("*")).alias("share"))
    unit = F.shiftrightunsigned(key, 11) / F.lit(float(1 << 53))
    picked = train.join(common.materialise(counts, "shares"), "lang").where((unit < F.col("share")) & (F.col("text") != ""))
    picked = picked.groupBy("lang", key.alias("key")).agg(F.first("text").alias("text"))

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            made = []
            for text in batch.column(0).to_pylist():
                full = trigrams(text)
                at = np.flatnonzero(full)
                made.append(np.array([at, full[at]], "<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(made, pa.binary())], ["lang", "counts"])

    with common.small_batches(docs.sparkSession):
        rows = sorted((r.lang, bytes(r.counts)) for r in picked.select("text", "lang").mapInArrow(sparse, "lang string, counts binary").collect())
    if not rows:
        return Model([], np.zeros(BUCKETS), np.zeros((0, BUCKETS)), np.zeros(0, int), np.zeros(SIZES))
    full = np.zeros((len(rows), BUCKETS), np.float32)
    for n, (_, raw) in enumerate(rows):
        at, held = np.frombuffer(raw, "<u4").reshape(2, -1)
        full[n, at] = held
    languages = sorted({x for x, _ in rows})
    label = np.array([languages.index(x) for x, _ in rows])
    idf = np.log((1 + len(rows)) / (1 + (full > 0).sum(axis=0))).astype(np.float32) + 1
    model = Model(languages, idf, np.zeros((0, BUCKETS), np.float32), np.zeros(0, int), np.zeros(SIZES))
    full = model.vectors(full)
    rng = np.random.default_rng(3)
    groups = [_cluster(full[label == n], rng) for n in range(len(languages))]
    model.centroids = np.concatenate(groups).astype(np.float32)
    model.owner = np.repeat(np.arange(len(languages)), [len(g) for g in groups])

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = np.zeros(SIZES * STEPS, np.int64)
        for batch in common.slices(batches):
            if batch.num_rows:
                known, _, score, sizes = model.measure(batch.column(0).to_pylist())
                scores += np.bincount((sizes * STEPS + np.minimum((score * STEPS).astype(int), STEPS - 1))[known], minlength=len(scores))
        at = np.flatnonzero(scores)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(scores[at], pa.int64())], ["cell", "n"])

    scores = np.zeros(SIZES * STEPS, np.int64)
    with common.small_batches(docs.sparkSession):
        counted = train.select("text").mapInArrow(tally, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    for r in counted:
        scores[r.cell] = r.n
    model.floors = floors(scores.reshape(SIZES, STEPS))
    return model


def identify(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every row."""
    common.ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            lang, score, rejected = model.predict(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), held_out(id_column).alias("held_out"), F.col(text_column).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text is not rejected."""
    common.ship_package(docs.sparkSession)
    at = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            rejected = model.predict(batch.column(at).to_pylist())[2]
            yield batch.filter(pa.array(~rejected))

    return common.map_rows(docs, run)
