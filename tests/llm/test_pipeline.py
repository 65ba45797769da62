import hashlib

import pytest
import sentencepiece

from corvane.llm.quality import THRESHOLD
from corvane.llm.sentencepiece_op import default_model

pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, frames = docs.columns, []
    for name, stage in pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        frames.append({r.doc_id: r for r in docs.collect()})
        if name != pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    source = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    quality, lines, copies, mixed, encoded = frames
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = [labels[i] for i in quality if i in labels]
    assert sum(kept) / len(kept) > 0.97 and len(quality) < len(source) and THRESHOLD == 0.7
    assert set(copies) <= set(lines) <= set(quality) and set(mixed) == set(copies) == set(encoded)
    assert any(lines[i].text != source[i].text for i in lines)
    library = sentencepiece.SentencePieceProcessor(model_file=default_model())
    for i, r in encoded.items():
        ids = library.encode(mixed[i].text or "")
        assert list(r.ids) == ids and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert sorted(r.mix_pos for r in encoded.values()) == list(range(len(encoded)))


def test_odd_rows_pass_every_stage(spark, odd_docs, no_docs, tmp_path):
    odd_docs.write.parquet(f"{tmp_path}/odd")
    no_docs.write.parquet(f"{tmp_path}/none")
    for name in ("odd", "none"):
        source = spark.read.parquet(f"{tmp_path}/{name}")
        labels = [(1, 1, 0), (9, 1, 0), (12, 0, 0), (None, 1, 0)]
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}-tables/labels.parquet")
        docs, rows = source, {}
        for k, (stage_name, stage) in enumerate(pipeline.STAGES):
            if k == 1:  # what quality leaves of so odd a table says little about the rest
                docs = source
            stage(spark, docs, f"{tmp_path}/{name}-tables").write.parquet(f"{tmp_path}/{name}-{stage_name}")
            docs = spark.read.parquet(f"{tmp_path}/{name}-{stage_name}")
            rows[stage_name] = docs.collect()
            if stage_name != "encode":
                assert docs.columns == source.columns
        if name == "none":
            assert not any(rows.values())
            continue
        given = source.collect()
        assert all(r.text for r in rows["quality"]) and {r.doc_id for r in rows["quality"]} <= {r.doc_id for r in given}
        assert len(rows["line_dedup"]) == len(given)
        worded = [r for r in rows["near_copies"] if (r.text or "").strip()]
        assert sum(not (r.text or "").strip() for r in rows["near_copies"]) == sum(not (r.text or "").strip() for r in rows["line_dedup"])
        assert len({r.doc_id for r in worded} & {9, 10}) == 1 and len([r for r in worded if r.text.startswith("a text without")]) == 1
        assert sorted(map(repr, rows["mix"])) == sorted(map(repr, rows["near_copies"]))
        library = sentencepiece.SentencePieceProcessor(model_file=default_model())
        want = sorted(repr((r.doc_id, library.encode(r.text or ""))) for r in rows["mix"])
        assert sorted(repr((r.doc_id, list(r.ids))) for r in rows["encode"]) == want
        assert sorted(r.mix_pos for r in rows["encode"]) == list(range(len(want)))


def test_run_leaves_only_its_result(spark):
    from corvane.llm import common

    with common.scratch(spark):
        before = list(common._MADE)
        docs = pipeline.run(spark, SF)
        assert docs.count() > 0 and len(common._MADE) == len(before) + 1
        (path,) = [p for p in common._MADE if p not in before]
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(path)
