"""Encoding of whole corpora with a public tokenizer."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from strandwise.llm.blocks import text_blocks
from strandwise.llm.transducer import Transducer, read_merges
from strandwise.session import ship_package

#: Folder of the public vocabularies, unless the session names another.
FOLDER_KEY, FOLDER = "spark.strandwise.tokenizers", "/opt/tokenizers"
NAME = "byte_bpe_50k"
#: Bytes of text encoded together.
BLOCK = 400_000

_machines: dict[str, Transducer] = {}


def vocabulary(spark: SparkSession, name: str = NAME, folder: str | None = None):
    """The vocabulary file's merges as a broadcast: its size is the file's, whatever the corpus."""
    ship_package(spark)
    path = Path(folder or spark.conf.get(FOLDER_KEY, FOLDER)) / f"{name}.json"
    return spark.sparkContext.broadcast((str(path), read_merges(path)))


def machine(shared) -> Transducer:
    """This Python worker's transducer; its states and pieces serve all later tasks of the worker."""
    path, merges = shared.value
    if path not in _machines:
        _machines[path] = Transducer(*merges)
    return _machines[path]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str | None]]]:
    for batch in batches:
        for at, texts in text_blocks(batch, 1, BLOCK):
            yield batch.column(0).slice(at, len(texts)), texts


def encode_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", name: str = NAME, folder: str | None = None) -> DataFrame:
    """(key, ids): the token ids of every document, without special tokens.

    Null and empty texts both have the empty list.  Strings of special tokens are ordinary text.
    White space has ids like any text.  Documents given twice come out twice; a null key stays null.
    Other columns are not read.  No shuffle: each task encodes the documents it scans.
    """
    shared = vocabulary(docs.sparkSession, name, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = machine(shared)
        for keys, texts in _blocks(batches):
            found = encoder.encode_all([t or "" for t in texts])
            ends = np.cumsum([0, *(len(x) // 4 for x in found)], dtype=np.int64)
            values = pa.array(np.frombuffer(b"".join(found), np.int32))
            yield pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)], names=[key, "ids"])

    schema = T.StructType([docs.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return docs.select(key, text).mapInArrow(run, schema)


def count_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", name: str = NAME, folder: str | None = None) -> DataFrame:
    """(key, tokens): how many ids every document has; none for null and empty texts."""
    shared = vocabulary(docs.sparkSession, name, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = machine(shared)
        for keys, texts in _blocks(batches):
            found = encoder.encode_all([t or "" for t in texts])
            yield pa.RecordBatch.from_arrays([keys, pa.array(np.fromiter((len(x) // 4 for x in found), np.int64, len(found)))], names=[key, "tokens"])

    schema = T.StructType([docs.schema[key], T.StructField("tokens", T.LongType())])
    return docs.select(key, text).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, key: str = "doc_id", name: str = NAME, folder: str | None = None) -> DataFrame:
    """(key, text) from (key, ids), decoded as a stream; null ids have a null text."""
    shared = vocabulary(encoded.sparkSession, name, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = machine(shared)
        for batch in batches:
            texts = ["".join(decoder.decode(ids.as_py())) if ids.is_valid else None for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    schema = T.StructType([encoded.schema[key], T.StructField("text", T.StringType())])
    return encoded.select(key, "ids").mapInArrow(run, schema)
