import math

import numpy as np
from oracle import SF

from corvane.llm.quality import LATENT, PER_CLASS, QualityModel, fit_quality, held_out, op6_quality, quality_score, term_weights
from pyspark.sql import functions as F


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    rows = op6_quality(spark, sf).join(labels, "doc_id").where("held_out").collect()
    good = [r.predicted == r.quality for r in rows]
    assert len(good) > 50 and sum(good) / len(good) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_labels_that_are_held_out_are_never_learned(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = fit_quality(docs, labels), fit_quality(docs, turned)
    assert (a.vectors == b.vectors).all() and (a.labels == b.labels).all()


def test_crc_is_that_of_the_text(spark):
    from zlib import crc32

    got = {r.doc_id: r.h for r in spark.range(-50, 50).select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("h")).collect()}
    assert got == {i: crc32(str(i).encode()) % 4 == 2 for i in range(-50, 50)}


def test_blocked_votes_equal_plain_ones():
    draw = np.random.default_rng(1)
    vectors = draw.standard_normal((40, LATENT)).astype(np.float32)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    terms = np.stack([term_weights(t.encode()) for t in ("some words", "OTHER WORDS!!", "x", "")])
    model = QualityModel(np.ones(terms.shape[1], np.float32), draw.standard_normal((terms.shape[1], LATENT)).astype(np.float32), vectors, (np.arange(40) % 2).astype(float))
    got = model.scores(terms)
    for row, score in zip(terms, got):
        z = row @ model.axes
        if not z.any():
            assert score == 0.5
            continue
        cosine = vectors @ (z / np.linalg.norm(z))
        near = np.argsort(-cosine)[:15]
        weight = np.maximum(cosine[near], 0) ** 4
        assert abs(score - (weight * model.labels[near]).sum() / weight.sum()) < 1e-4


def plain_terms(raw):
    """Terms of a text, one by one."""
    from corvane.llm import quality as m

    out = [0.0] * m.TERMS
    kind = lambda b: 2 if b == 10 else 0 if b < 32 else 1 if b == 32 else 3 if 97 <= b <= 122 else 4 if 65 <= b <= 90 else 5 if 48 <= b <= 57 else 7 if b > 127 else 6
    grams, shapes = {}, {}
    for i in range(len(raw) - 2):
        h = (raw[i] * 0x9E3779B1 ^ raw[i + 1] * 0x85EBCA6B ^ raw[i + 2] * 0xC2B2AE35) & 0xFFFFFFFF
        h = (h * 0x27D4EB2F & 0xFFFFFFFF) >> 32 - m.GRAM_BITS
        grams[h] = grams.get(h, 0) + 1
    for i in range(len(raw) - 3):
        a, b, c, d = map(kind, raw[i : i + 4])
        h = ((((a * 8 + b) * 8 + c) * 8 + d) * 0x9E3779B1 & 0xFFFFFFFF) >> 32 - m.SHAPE_BITS
        shapes[h] = shapes.get(h, 0) + 1
    for part, damp, at in ((grams, math.log1p, 0), (shapes, math.sqrt, 1 << m.GRAM_BITS)):
        size = math.sqrt(sum(damp(n) ** 2 for n in part.values()))
        for h, n in part.items():
            out[at + h] = damp(n) / size
    words = raw.split()
    if raw:
        share = sum(a == b for a, b in zip(words, words[1:])) / len(words) if words else 0
        out[m.TERMS - m.REPEATS + min(m.REPEATS - 1, int(share * m.REPEATS))] = 0.5
    return np.array(out)


def test_every_score_like_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    model = fit_quality(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    rows = op6_quality(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    axes, vectors = model.axes.astype(float), model.vectors.astype(float)
    for r in rows:
        z = (plain_terms((texts[r.doc_id] or "").encode()) * model.idf) @ axes
        want = 0.5
        if z.any():
            cosine = [float(v @ z / np.linalg.norm(z)) for v in vectors]
            near = sorted(range(len(cosine)), key=lambda i: -cosine[i])[:15]
            weight = [max(cosine[i], 0) ** 4 for i in near]
            want = sum(w * model.labels[i] for w, i in zip(weight, near)) / sum(weight) if sum(weight) else 0.5
        assert abs(r.score - want) < 1e-5 and r.predicted == int(r.score >= 0.7)


def test_scores_do_not_depend_on_batches(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = fit_quality(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    terms = np.stack([term_weights((r.text or "").encode()) for r in docs.collect()])
    whole = model.scores(terms)
    assert max(abs(model.scores(terms[i : i + 1])[0] - whole[i]) for i in range(len(terms))) < 1e-12


def test_odd_rows(spark, odd_docs, no_docs):
    no_labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = fit_quality(odd_docs, no_labels)
    scored = odd_docs.select("doc_id", "text", "score", quality_score(spark, model, "text").alias("own"))
    assert {r.own for r in scored.collect()} == {0.5}
    odd_labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (1, None, 0), (None, 1, 0), (5, 7, 1), (6, 0, None), (9, 0, 0), (8, 1, 0), (404, 1, 0)], "doc_id long, quality int, toxic int")
    model = fit_quality(odd_docs, odd_labels)
    assert len(model.labels) <= 2 * PER_CLASS
    rows = odd_docs.where(quality_score(spark, model, odd_docs["text"]) >= 0).collect()
    assert len(rows) == odd_docs.count()
    empty = {r.own for r in odd_docs.where("text is null or text = ''").select(quality_score(spark, model, "text").alias("own")).collect()}
    assert empty == {0.5}
    assert fit_quality(no_docs, odd_labels).labels.size == 0
    assert no_docs.select(quality_score(spark, model, "text")).count() == 0
