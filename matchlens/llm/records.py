"""Operator 9: token ids in length-delimited binary files with a separate offset index.

A file is ``MAGIC``, then one frame after another::

    length of the payload   unsigned 64 bit
    masked checksum         of the eight length bytes, unsigned 32 bit
    payload
    masked checksum         of the payload, unsigned 32 bit

all little-endian. The checksum is CRC-32, rotated right by 15 bits plus a constant, so that
a checksum of bytes that hold checksums stays useful. A payload is the document's id (signed
64 bit), whether there is one (one byte), the bytes per token id (one byte, 2 or 4: the
narrowest that holds the vocabulary) and the ids. The index, a Parquet table, tells file and
offset of each record, so that records can be read in any order.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchlens.llm import tokens
from matchlens.llm.store import fresh_path, partitions, ship

MAGIC = b"MLRECS1\n"
END_ID = 1
_MASK = 0xA282EAD8
_LENGTH, _SUM, _HEAD = struct.Struct("<Q"), struct.Struct("<I"), struct.Struct("<qBB")

INDEX_SCHEMA = "doc_id long, part int, file string, offset long, n_bytes long, n_tokens long"
READ_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + _MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = _LENGTH.pack(len(payload))
    sums = _SUM.pack(masked(size)), _SUM.pack(masked(payload))
    return b"".join((size, sums[0], payload, sums[1]))


def unframe(read) -> bytes | None:
    """The next payload from ``read(n)``; None at the end. Raises ValueError if damaged."""
    size = read(_LENGTH.size + _SUM.size)
    if not size:
        return None
    if len(size) < 12 or _SUM.unpack(size[8:])[0] != masked(size[:8]):
        raise ValueError("damaged length of a record")
    n = _LENGTH.unpack(size[:8])[0]
    payload, check = read(n), read(_SUM.size)
    if len(payload) < n or len(check) < 4 or _SUM.unpack(check)[0] != masked(payload):
        raise ValueError("damaged record")
    return payload


def pack(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    return _HEAD.pack(doc_id or 0, doc_id is not None, width) + ids.astype(f"<u{width}").tobytes()


def unpack(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, there, width = _HEAD.unpack(payload[: _HEAD.size])
    return doc_id if there else None, np.frombuffer(payload[_HEAD.size :], f"<u{width}")


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def write_records(
    docs: DataFrame, folder: str, vocabulary: str | None = None, end_id: int = END_ID
) -> DataFrame:
    """Tokenize whole texts and write them to files in ``folder`` in ascending order of doc_id.

    Returns the index (also at ``folder``/index). Documents are range-partitioned by doc_id
    and sorted; each task streams its own into one file, so memory holds a batch. A repeated
    task writes another file, and only the one that its committed index rows name counts.

    Null text: no ids but the end id. Null doc_ids come first. Rows that share a doc_id are
    all written, in order of their texts. Other columns are ignored. An empty table gives an
    empty index.
    """
    ship(docs.sparkSession)
    path = vocabulary or tokens.vocabulary_path()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, files, place = tokens.encoder(path), *_open(folder)
        width = 2 if encoder.library.get_vocab_size() <= 1 << 16 else 4
        part, out, at = TaskContext.get().partitionId(), None, len(MAGIC)
        name = f"part-{part:06d}-{uuid.uuid4().hex}.rec"
        try:
            for batch in batches:
                if out is None:
                    out = files.open_output_stream(f"{place}/{name}")
                    out.write(MAGIC)
                rows = []
                doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for doc_id, ids in zip(doc_ids, encoder.encode(texts), strict=True):
                    ids = np.append(np.frombuffer(ids, "<u4"), np.uint32(end_id))
                    data = frame(pack(doc_id, ids, width))
                    out.write(data)
                    rows.append((doc_id, part, name, at, len(data), len(ids)))
                    at += len(data)
                yield _batch(rows, INDEX_SCHEMA)
        finally:
            if out is not None:
                out.close()

    _open(folder)[0].create_dir(_open(folder)[1], recursive=True)
    ordered = (
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    ordered.mapInArrow(write, INDEX_SCHEMA).write.parquet(f"{folder}/index")
    return docs.sparkSession.read.schema(INDEX_SCHEMA).parquet(f"{folder}/index")


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record, from the files: where it starts in the sequence of all ids, how
    many ids it has and their checksum (as unsigned 32-bit integers). Raises on damage."""
    ship(spark)
    index = spark.read.schema(INDEX_SCHEMA).parquet(f"{folder}/index")
    files = index.groupBy("part", "file").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("part")) - F.col("n")  # one row per file
    files = files.select("file", before.alias("first")).repartition(partitions(spark))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, place = _open(folder)
        for batch in batches:
            for name, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = []
                with system.open_input_stream(f"{place}/{name}", buffer_size=1 << 20) as file:
                    if file.read(len(MAGIC)) != MAGIC:
                        raise ValueError(f"{name} is no record file")
                    while (payload := unframe(file.read)) is not None:
                        doc_id, ids = unpack(payload)
                        crc = zlib.crc32(ids.astype("<u4").tobytes())
                        rows.append((doc_id, first, len(ids), crc))
                        first += len(ids)
                        if len(rows) == 4096:
                            yield _batch(rows, READ_SCHEMA)
                            rows = []
                yield _batch(rows, READ_SCHEMA)

    return files.mapInArrow(read, READ_SCHEMA)


def read_selected(index: DataFrame, folder: str, wanted: DataFrame) -> DataFrame:
    """(doc_id, ids) of the wanted doc_ids, by offset: a shuffled read through the index."""
    ship(index.sparkSession)
    chosen = index.join(wanted.select("doc_id").distinct(), "doc_id")
    chosen = chosen.select("file", "offset").repartition("file").sortWithinPartitions("file", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, place = _open(folder)
        for batch in batches:
            rows, name, file = [], None, None
            for at, offset in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != name:
                    name, file = at, system.open_input_file(f"{place}/{at}")
                file.seek(offset)
                doc_id, ids = unpack(unframe(file.read))
                rows.append((doc_id, ids.astype("i8")))
            yield _batch(rows, "doc_id long, ids array<long>")

    return chosen.mapInArrow(read, "doc_id long, ids array<long>")


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(),
             "array<long>": pa.list_(pa.int64())}
    fields = [f.split(" ") for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields, strict=True)],
        names=[name for name, _ in fields],
    )


def op9_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, written as records and read back."""
    folder = fresh_path(spark, "records")
    write_records(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    return read_records(spark, folder)
