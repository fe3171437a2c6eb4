"""Token-id files: documents in ascending id order, written and read by Spark tasks."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.llm import id_coder
from seqloom.llm.common import scratch, text_slices, written
from seqloom.llm.vocab import piece_encoder, public_tokenizer

END_ID = 0
FILE_IDS = 2 * id_coder.BLOCK_IDS  # a file is closed with the document that reaches so many ids

_FILES = "part int, roll int, name string, n_ids bigint"
_DOCS = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def _put(folder: str, name: str, data: bytes) -> None:
    """Writes under another name first, so that a lost or repeated task leaves no half file."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    draft = f"{root}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(draft) as out:
        out.write(data)
    store.move(draft, f"{root}/{name}")


def _write_part(batches: Iterator[pa.RecordBatch], folder: str, path: str, file_ids: int) -> Iterator[pa.RecordBatch]:
    encoder, part = piece_encoder(path), TaskContext.get().partitionId()
    end = np.array([END_ID], "<u4").tobytes()
    doc_ids: list[int | None] = []
    lengths: list[int] = []
    blocks: list[bytes] = []
    rest = bytearray()
    rolls = 0
    size = 4 * id_coder.BLOCK_IDS

    def close() -> pa.RecordBatch:
        nonlocal doc_ids, lengths, blocks, rest, rolls
        if rest:
            blocks.append(id_coder.encode_block(np.frombuffer(bytes(rest), "<u4")))
        name = f"ids-{part:06d}-{rolls:06d}.slids"
        _put(folder, name, id_coder.MAGIC + b"".join(blocks) + id_coder.encode_index(doc_ids, lengths))
        row = pa.RecordBatch.from_pylist([{"part": part, "roll": rolls, "name": name, "n_ids": sum(lengths)}], pa.schema([("part", pa.int32()), ("roll", pa.int32()), ("name", pa.string()), ("n_ids", pa.int64())]))
        doc_ids, lengths, blocks, rest, rolls = [], [], [], bytearray(), rolls + 1
        return row

    for batch in text_slices(batches, "text"):
        for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist())):
            ids += end
            doc_ids.append(doc_id)
            lengths.append(len(ids) // 4)
            rest += ids
            while len(rest) >= size:
                blocks.append(id_coder.encode_block(np.frombuffer(bytes(rest[:size]), "<u4")))
                del rest[:size]
            if len(blocks) * id_coder.BLOCK_IDS >= file_ids:
                yield close()
    if doc_ids:
        yield close()


def write_ids(docs: DataFrame, folder: str, vocabulary: str | None = None, file_ids: int = FILE_IDS) -> DataFrame:
    """Writes the ids of all documents (doc_id, text) to files in a shared folder; returns the written list of files.

    Files and the documents in them follow ascending doc_id (nulls first; equal
    ids by their texts' hashes, then by text); each text's ids end with END_ID, so a null or empty text has that
    one id. An empty table writes no file. A task that runs again replaces its own files.
    """
    path = vocabulary or public_tokenizer("byte_bpe_50k.json")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    order = ["doc_id", F.xxhash64("text"), "text"]  # the hash parts rows of one id as well
    rows = rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    return written(rows.mapInArrow(lambda b: _write_part(b, folder, path, file_ids), _FILES), "id-files")


def read_ids(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """Decodes the files: a row per document with doc_id, start, n_tokens, ids_crc32.

    `start` counts the ids of all documents before it. Damaged files raise an error.
    """
    if files.isEmpty():
        return spark.createDataFrame([], _DOCS)
    before = F.sum("n_ids").over(W.orderBy("part", "roll").rowsBetween(W.unboundedPreceding, -1))
    based = files.select("name", F.coalesce(before, F.lit(0)).alias("base"))  # a row for each file, not document
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.slids").load(folder)
    found = found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content").join(based, "name").select("base", "content")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                *blocks, (doc_ids, lengths) = id_coder.read_blocks(content.as_buffer().to_pybytes())
                ids = memoryview(np.concatenate(blocks).view(np.uint8))
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(ids[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                cols = [pa.array(doc_ids, pa.int64()), pa.array(base + ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32"])

    return found.mapInArrow(decode, _DOCS)


def through_files(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Writes the documents' ids, reads the files back and describes what was read."""
    folder = scratch(docs.sparkSession, "ids")
    return read_ids(docs.sparkSession, folder, write_ids(docs, folder, vocabulary))
