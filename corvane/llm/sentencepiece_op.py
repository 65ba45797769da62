"""Operator 2: SentencePiece encoding and decoding as column expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from corvane.llm.common import bounded_batches, table
from corvane.llm.piece_codec import PieceModel, codec_of, decoder_of, load_model

MODEL = "piece_bpe_32k.model"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


class PieceTokenizer:
    """encode() and decode() of one model file, as expressions over any DataFrame's columns.

    The model goes to the workers as a broadcast bounded by its vocabulary. Rows
    are independent: no shuffle, and other columns pass by whatever their names
    are; rows that repeat are coded each, and an empty table stays empty. A null
    text or list of ids gives null; an empty one gives an empty one. A text or
    word of any length is coded whole, in memory that is linear in its length.

    both() encodes and decodes in one call: one Python worker for each task
    instead of two, and ids cross over to it only once.
    """

    def __init__(self, spark: SparkSession, model_path: str):
        bounded_batches(spark)
        model = spark.sparkContext.broadcast(load_model(model_path))

        @F.arrow_udf(ArrayType(IntegerType(), False))
        def encode(texts: pa.Array) -> pa.Array:
            return encoded(model.value, texts)

        @F.arrow_udf(StringType())
        def decode(ids: pa.Array) -> pa.Array:
            return decoded(model.value, ids)

        @F.arrow_udf("ids array<int>, decoded string")
        def both(texts: pa.Array) -> pa.Array:
            ids = encoded(model.value, texts)
            return pa.StructArray.from_arrays([ids, decoded(model.value, ids)], ["ids", "decoded"])

        # Marked so that Spark never copies the calls when it folds projections: each text is encoded once.
        self._encode, self._decode, self._both = encode.asNondeterministic(), decode.asNondeterministic(), both.asNondeterministic()

    def encode(self, text: Column | str) -> Column:
        return self._encode(text)

    def decode(self, ids: Column | str) -> Column:
        return self._decode(ids)

    def both(self, text: Column | str) -> Column:
        """struct(ids, decoded), both null for a null text."""
        return self._both(text)


def encoded(model: PieceModel, texts: pa.Array) -> pa.Array:
    codec = codec_of(model)
    parts = [codec.encode(x) if x else b"" for x in texts.to_pylist()]
    ends = np.cumsum([0, *(len(p) // 4 for p in parts)], dtype=np.int64).astype(np.int32)
    values = pa.array(np.frombuffer(b"".join(parts), np.int32))
    return pa.ListArray.from_arrays(pa.array(ends), values, mask=texts.is_null() if texts.null_count else None)


def decoded(model: PieceModel, ids: pa.Array) -> pa.Array:
    """Texts of lists of ids: all pieces of a batch are looked up at once, and lie one after the other."""
    codec = decoder_of(model)
    ends, flat = ids.offsets.to_numpy(), ids.values.to_numpy()
    pieces = codec.surface_array.take(pa.array(flat))
    place = np.frombuffer(pieces.buffers()[1], np.int32, len(flat) + 1, pieces.offset * 4)[ends] if len(flat) else ends
    data = pieces.buffers()[2].to_pybytes() if len(flat) and pieces.buffers()[2] else b""
    ids_of = lambda k: flat[ends[k] : ends[k + 1]].tolist()
    if len(flat) and codec.control_mask[flat].any():
        return pa.array([codec.decode(ids_of(k)) if ids[k].is_valid else None for k in range(len(ids))], pa.string())
    out: list[str | None] = []
    for k in range(len(ids)):
        if not ids[k].is_valid:
            out.append(None)
            continue
        start = place[k] + (model.dummy_prefix and ends[k] < ends[k + 1] and codec.opens[flat[ends[k]]])
        try:
            out.append(data[start : place[k + 1]].decode())
        except UnicodeDecodeError:
            out.append(codec.decode(ids_of(k)))
    return pa.array(out, pa.string())


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids and the text decoded from them, for each row; a null text counts as empty, repeated rows are coded each."""
    codec = PieceTokenizer(docs.sparkSession, model_path)
    return docs.select("doc_id", codec.both(F.coalesce("text", F.lit(""))).alias("coded")).select("doc_id", "coded.ids", "coded.decoded")


def digests(coded: DataFrame) -> DataFrame:
    listed = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(listed, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode_documents(table(spark, sf_dir, "documents"), default_model()))
