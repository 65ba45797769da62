import hashlib
import random
from array import array

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm.piece_codec import PieceCodec, PieceDecoder, load_model, merged
from corvane.llm.sentencepiece_op import PieceTokenizer, default_model, digests, encode_documents, op2_sentencepiece

LIB = sentencepiece.SentencePieceProcessor(model_file=default_model())
MODEL = load_model(default_model())
CODEC = PieceCodec(MODEL)
DECODER = PieceDecoder(MODEL)


def agree(text):
    ids = list(array("i", CODEC.encode(text)))
    assert ids == LIB.encode(text)
    assert DECODER.decode(ids) == LIB.decode(ids)


@pytest.mark.parametrize("text", ["", " ", "  lead", "tail  ", "a  b", "\n", "a\nb\tc", "▁x", "x▁▁y", "<s>hi</s><0x41>", "é日𝒳\x00z", " " * 1000 + "x", "a" * 5000, "日本語" * 1000, "-" * 300, "the cat " * 400])
def test_like_the_library(text):
    agree(text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from("abeth ▁=-\n10é日ß"), st.characters(exclude_categories=["Cs"])), max_size=80))
def test_any_text_like_the_library(text):
    agree(text)


def test_any_ids_decode_like_the_library():
    draw = random.Random(5)
    for _ in range(2000):
        ids = [draw.choice([draw.randrange(32000), draw.randrange(3, 259), draw.randrange(5), 28705, 259]) for _ in range(draw.randint(0, 12))]
        assert DECODER.decode(ids) == LIB.decode(ids)


def test_short_and_long_merging_agree(monkeypatch):
    from corvane.llm import piece_codec

    draw = random.Random(6)
    words = [" " + "".join(draw.choice("abething") for _ in range(draw.randint(1, 63))) for _ in range(300)]
    short = [merged(w, CODEC.rank) for w in words]
    monkeypatch.setattr(piece_codec, "SHORT", 0)
    assert [merged(w, CODEC.rank) for w in words] == short
    assert all("".join(s) == w for s, w in zip(short, words))


def test_query_like_the_library_on_the_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        ids = LIB.encode(r.text or "")
        want[r.doc_id] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(LIB.decode(ids).encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op2_sentencepiece(spark, sf).collect()}
    assert got == want


def test_small_cache_changes_nothing(monkeypatch):
    from corvane.llm import piece_codec

    monkeypatch.setattr(piece_codec, "CACHE_WORDS", 3)
    monkeypatch.setattr(piece_codec, "CACHE_PAIRS", 2)
    agree("several words of which few fit the cache, several words again")


def test_odd_rows(spark, odd_docs, no_docs):
    want = []
    for r in odd_docs.collect():
        ids = LIB.encode(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(LIB.decode(ids).encode()).hexdigest()))
    got = [tuple(r) for r in digests(encode_documents(odd_docs, default_model())).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert digests(encode_documents(no_docs, default_model())).count() == 0


def test_batches_decode_like_single_lists():
    import pyarrow as pa

    from corvane.llm.sentencepiece_op import decoded

    draw = random.Random(7)
    for special in (0, 1):
        lists = [[], None, [28705], [259, 5000]]
        for _ in range(300):
            lists.append([draw.choice([draw.randrange(259, 32000), draw.randrange(3, 259), 28705, *[draw.randrange(3)] * special]) for _ in range(draw.randint(0, 9))])
        for array_of in (pa.array(lists, pa.list_(pa.int32())), pa.array([[1, 2], *lists], pa.list_(pa.int32())).slice(1)):
            assert decoded(MODEL, array_of).to_pylist() == [None if x is None else LIB.decode(x) for x in lists]
    assert decoded(MODEL, pa.array([], pa.list_(pa.int32()))).to_pylist() == []
    assert decoded(MODEL, pa.array([[], None], pa.list_(pa.int32()))).to_pylist() == ["", None]


def test_nulls_stay_null(spark):
    codec = PieceTokenizer(spark, default_model())
    df = spark.createDataFrame([(None,), ("",), ("a b",)], "ids string")
    coded = df.withColumn("codes", codec.encode("ids")).withColumn("back", codec.decode("codes"))
    assert [tuple(r) for r in coded.collect()] == [(None, None, None), ("", [], ""), ("a b", LIB.encode("a b"), "a b")]
    both = df.select(codec.both("ids").alias("b")).select("b.ids", "b.decoded")
    assert [tuple(r) for r in both.collect()] == [(None, None), ([], ""), (LIB.encode("a b"), "a b")]


@pytest.mark.parametrize("size", [1, 2, 7])
def test_texts_cut_into_slices_like_the_library(monkeypatch, size):
    from corvane.llm import piece_codec

    monkeypatch.setattr(piece_codec, "SLICE", size)
    draw = random.Random(size)
    for _ in range(1500):
        agree("".join(draw.choice("ab   ▁\n-é日") for _ in range(draw.randint(0, 40))))
    for text in ("the cat " * 50, " " * 30, "a" * 30 + " ", " " + "a" * 30, "a  b   c    d ", "▁a▁▁b▁"):
        agree(text)
