"""Operator 6: a quality classifier by nearest-neighbour voting among latent-semantic vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import bounded_batches, table

PER_CLASS = 1500  # most labelled rows taken of each class
LATENT, NEIGHBOURS, SHARPNESS = 48, 15, 4
THRESHOLD = 0.7
GRAM_BITS, SHAPE_BITS, REPEATS = 11, 10, 16
TERMS = (1 << GRAM_BITS) + (1 << SHAPE_BITS) + REPEATS

# Classes of bytes for shape terms: control, space, line feed, lower, upper, digit, other ASCII, beyond ASCII.
_SHAPE = np.full(256, 6, np.uint32)
_SHAPE[:32], _SHAPE[32], _SHAPE[10] = 0, 1, 2
_SHAPE[97:123], _SHAPE[65:91], _SHAPE[48:58], _SHAPE[128:] = 3, 4, 5, 7


def term_weights(raw: bytes) -> np.ndarray:
    """Weights of a whole text's terms: hashed byte trigrams, runs of four byte classes, and how often a word repeats the one before.

    Each kind of term has length 1, so that long and short texts compare.
    """
    out = np.zeros(TERMS, np.float32)
    b = np.frombuffer(raw, np.uint8)
    if not len(b):
        return out
    grams, shapes = out[: 1 << GRAM_BITS], out[1 << GRAM_BITS : (1 << GRAM_BITS) + (1 << SHAPE_BITS)]
    wide = b.astype(np.uint32)
    if len(b) > 2:
        code = (wide[:-2] * np.uint32(0x9E3779B1)) ^ (wide[1:-1] * np.uint32(0x85EBCA6B)) ^ (wide[2:] * np.uint32(0xC2B2AE35))
        code *= np.uint32(0x27D4EB2F)
        grams += np.log1p(np.bincount((code >> np.uint32(32 - GRAM_BITS)).astype(np.int64), minlength=len(grams)))
    if len(b) > 3:
        s = _SHAPE[b]
        code = (((s[:-3] * 8 + s[1:-2]) * 8 + s[2:-1]) * 8 + s[3:]) * np.uint32(0x9E3779B1)
        shapes += np.sqrt(np.bincount((code >> np.uint32(32 - SHAPE_BITS)).astype(np.int64), minlength=len(shapes)))
    for part in (grams, shapes):
        if (norm := float(np.sqrt(part @ part))) > 0:
            part /= norm
    words = raw.split()
    share = sum(map(eq, words, words[1:])) / len(words) if words else 0.0
    out[TERMS - REPEATS + min(REPEATS - 1, int(share * REPEATS))] = 0.5
    return out


@dataclass(frozen=True)
class QualityModel:
    """Term axes and labelled vectors: at most LATENT x TERMS and 2 * PER_CLASS x LATENT numbers, whatever the data."""

    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def latent(self, terms: np.ndarray) -> np.ndarray:
        z = (terms * self.idf).astype(np.float64) @ self.axes.astype(np.float64)
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def scores(self, terms: np.ndarray) -> np.ndarray:
        """Share of label 1 among the nearest labelled vectors, weighted by a power of their cosine; 0.5 if nothing is near."""
        k = min(NEIGHBOURS, len(self.labels))
        if not k:
            return np.full(len(terms), 0.5)
        cosine = self.latent(terms) @ self.vectors.T
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, 1), 0) ** SHARPNESS
        total = weight.sum(1)
        voted = (weight * self.labels[near]).sum(1) / np.where(total > 0, total, 1)
        return np.clip(np.where(total > 0, voted, 0.5), 0, 1)


def _raw(texts: pa.Array) -> Iterator[bytes]:
    for x in texts:
        yield x.as_buffer().to_pybytes() if x.is_valid else b""


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, label) of at most PER_CLASS rows of each class that may be learned from, in the order of a hash of doc_id.

    A document labelled more than once counts by its mean label (0.5: 1); of
    texts that share a doc_id the greatest is taken.
    """
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    mean = usable.groupBy("doc_id").agg(F.avg("quality").alias("q")).select("doc_id", (F.col("q") >= 0.5).cast("int").alias("label"))
    of = lambda x: mean.where(F.col("label") == x).orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(PER_CLASS)
    chosen = F.broadcast(of(0).unionByName(of(1)))
    return docs.select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id").agg(F.max("label").alias("label"), F.max("text").alias("text"))


def fit_quality(docs: DataFrame, labels: DataFrame) -> QualityModel:
    """Fits axes on the sample's terms by a truncated singular value decomposition; only term weights come to the driver.

    The sample is bounded (PER_CLASS rows of each class), its texts are taken
    whole, whatever their length. Labels other than 0 and 1, null ones, and
    those of null, held-out or missing doc_ids are left aside. Without any
    label left, or with an empty table, the model knows nothing and every score
    is 0.5. Other columns aren't looked at, whatever their names.
    """

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = pa.array([term_weights(r).astype(np.float16).tobytes() for r in _raw(b.column("text"))], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("order"), b.column("label"), packed], ["order", "label", "terms"])

    bounded_batches(docs.sparkSession)
    source = _sample(docs, labels).select(F.md5(F.col("doc_id").cast("string")).alias("order"), "label", "text")
    rows = sorted(source.mapInArrow(terms, "order string, label int, terms binary").collect())
    if not rows:
        return QualityModel(np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0))
    x = np.stack([np.frombuffer(r.terms, np.float16) for r in rows]).astype(np.float32)
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0))).astype(np.float32) + 1
    x *= idf
    random = np.random.default_rng(7).standard_normal((TERMS, LATENT + 16)).astype(np.float32)
    for _ in range(5):
        random = x.T @ np.linalg.qr(x @ random)[0]
        random = np.linalg.qr(random)[0]
    _, _, right = np.linalg.svd(x @ random, full_matrices=False)
    axes = (random @ right.T)[:, :LATENT].astype(np.float32)
    model = QualityModel(idf, axes, np.zeros((0, LATENT), np.float32), np.zeros(0))
    return QualityModel(idf, axes, model.latent(x / idf), np.array([r.label for r in rows], np.float64))


def quality_score(spark: SparkSession, model: QualityModel, text: Column | str) -> Column:
    """Score (0 to 1, higher: label 1 likelier) of whole texts, as an expression; null and empty texts score 0.5.

    Texts of any length are scored whole, and in double precision, so that a
    score doesn't depend on the batch it is made in. Rows that repeat score the
    same, all rows 0.5 with a model fitted without labels; an empty table stays
    empty.

    The labelled vectors are broadcast, being bounded; each batch of documents
    meets all of them in one matrix product. Rows are independent: no shuffle,
    and other columns pass by whatever their names are.
    """
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def score(texts: pa.Array) -> pa.Array:
        out, rows = [np.zeros(0)], []
        for raw in _raw(texts):
            rows.append(term_weights(raw))
            if len(rows) == 256:
                out.append(shared.value.scores(np.stack(rows)))
                rows = []
        if rows:
            out.append(shared.value.scores(np.stack(rows)))
        return pa.array(np.concatenate(out), pa.float64())

    return F.arrow_udf(score, "double").asNondeterministic()(text)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), quality_score(spark, model, "text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
