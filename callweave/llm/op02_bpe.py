"""BPE encoding and decoding of whole documents (operator 2).

A map over the documents; no shuffle. Each Python worker keeps the automaton and a
bounded memory of words (``bpe.MEMORY`` entries), whatever the size of the input; what
goes back to Spark is made ``ROWS`` documents at a time, not a whole batch of texts.

Defined results: a null text counts as empty and gives no ids; repeated rows are
encoded each; columns of the input are kept by ``encode_documents`` (its ``ids``
column replaces one of that name).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

import numpy as np

from callweave.llm.bpe import word_tokenizer
from callweave.llm.common import prepare_python, vocabulary

#: documents whose ids and decoded texts are held at once
ROWS = 64


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS))


def encode_documents(docs: DataFrame, tokenizer_path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """The documents with the ids of their texts (array of int)."""
    spark = docs.sparkSession
    prepare_python(spark)
    spec = vocabulary(spark, tokenizer_path)
    kept = docs.drop(ids_col)
    at = kept.columns.index(text_col)
    schema = StructType([*kept.schema.fields]).add(ids_col, ArrayType(IntegerType()))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with word_tokenizer(spec.value) as t:
            for b in _slices(batches):
                ids = [np.frombuffer(t.encode(x.as_py()), "<u4").astype("i4") for x in b.column(at)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.list_(pa.int32()))], [*b.schema.names, ids_col])

    return kept.mapInArrow(encode, schema)


def decode_documents(encoded: DataFrame, tokenizer_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """Rows with ids, with the text that the ids stand for (null ids: empty)."""
    spark = encoded.sparkSession
    prepare_python(spark)
    spec = vocabulary(spark, tokenizer_path)
    kept = encoded.drop(text_col)
    at = kept.columns.index(ids_col)
    schema = StructType([*kept.schema.fields]).add(text_col, "string")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with word_tokenizer(spec.value) as t:
            for b in _slices(batches):
                out = [t.decode(np.array(x.as_py() or [], "<u4").tobytes()) for x in b.column(at)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], [*b.schema.names, text_col])

    return kept.mapInArrow(decode, schema)


def round_trip_rows(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """``docs`` with ``ids`` of the text, ``n_tokens`` and ``decoded_sha256``, in one pass."""
    spark = docs.sparkSession
    prepare_python(spark)
    spec = vocabulary(spark, tokenizer_path)
    names = ["ids", "n_tokens", "decoded_sha256"]
    kept = docs.drop(*names)
    at = kept.columns.index("text")
    schema = StructType([*kept.schema.fields]).add("ids", ArrayType(IntegerType())).add("n_tokens", "long").add("decoded_sha256", "string")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with word_tokenizer(spec.value) as t:
            for b in _slices(batches):
                raw = [t.encode(x.as_py()) for x in b.column(at)]
                new = [pa.array([np.frombuffer(i, "<u4").astype("i4") for i in raw], pa.list_(pa.int32())), pa.array([len(i) // 4 for i in raw], pa.int64()),
                       pa.array([hashlib.sha256(t.decode(i).encode()).hexdigest() for i in raw], pa.string())]
                yield pa.RecordBatch.from_arrays([*b.columns, *new], [*b.schema.names, *names])

    return kept.mapInArrow(encode, schema)


def round_trip_digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Encode, decode the ids, and digest both: in one pass, so that neither the ids
    nor the decoded texts travel between Spark and Python."""
    spark = docs.sparkSession
    prepare_python(spark)
    spec = vocabulary(spark, tokenizer_path)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with word_tokenizer(spec.value) as t:
            for b in batches:
                n, ids_sha, text_sha = [], [], []
                for x in b.column(1):
                    ids = t.encode(x.as_py())
                    n.append(len(ids) // 4)
                    ids_sha.append(hashlib.sha256(ids).hexdigest())
                    text_sha.append(hashlib.sha256(t.decode(ids).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
            .mapInArrow(digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"))
