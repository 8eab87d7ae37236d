"""Token ids as length-delimited binary records, with an offset index for shuffled reads.

A file is a run of records: length of the payload (8 bytes), masked checksum of these 8 bytes (4), payload,
masked checksum of the payload (4); all little-endian. The payload is the doc_id (8 bytes), a byte that tells whether the id
is null, the bytes of one id (2 or 4), and the ids, end id included. Beside it lies an index file: the offset of every record, 8 bytes
each. Files are in ascending order of doc_id, and so are the records in each. The checksum is CRC-32, rotated and shifted
by a constant, so that a checksum of data that hold checksums stays meaningful.

Defined cases: a null text is empty and has the end id alone; a null doc_id comes first; rows that repeat a doc_id are
records of their own, by text; an empty table makes no file; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relspan.llm.common import id_ranges, python_ready, scan_partitions
from relspan.llm.encoding import encoder, filesystem, open_file, write_file
from relspan.sources.scratch import new_folder

MASK = 0xA282EAD8
#: Bytes of records that a task reads back.
PART_BYTES = 64 << 20
HEAD, INFO = struct.Struct("<QI"), struct.Struct("<qBB")


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))))


def read_frame(f) -> bytes | None:
    """The next payload, or None at the end; raises if a checksum doesn't hold."""
    head = f.read(HEAD.size)
    if not head:
        return None
    size, check = HEAD.unpack(head)
    if masked(head[:8]) != check:
        raise ValueError("a record's length is damaged")
    payload = f.read(size)
    if len(payload) != size or f.read(4) != struct.pack("<I", masked(payload)):
        raise ValueError("a record's payload is damaged")
    return payload


def pack(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    return INFO.pack(doc_id or 0, doc_id is None, width) + ids.astype(f"<u{width}").tobytes()


def unpack(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, null, width = INFO.unpack_from(payload)
    return None if null else doc_id, np.frombuffer(payload, f"<u{width}", offset=INFO.size)


def write_records(docs: DataFrame, tokenizer_json: str, end_id: int, folder: str) -> list[tuple[int, int, int]]:
    """Write docs (doc_id, text) to files in folder; returns (part, records, ids) of each file in ascending order.

    One shuffle deals ranges of doc_id to tasks, as many as the input has partitions; a task streams its sorted range.
    """
    python_ready(docs.sparkSession)
    ranged, parts = id_ranges(docs.select("doc_id", "text"), "doc_id", scan_partitions(docs))
    dealt = ranged.repartitionById(parts, "range_id").sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")
    sent = docs.sparkSession.sparkContext.broadcast(tokenizer_json)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(sent.value)
        width = 2 if max(enc.size, end_id + 1) <= 1 << 16 else 4
        end, offsets, done = np.array([end_id], np.uint32), [], [0, 0]

        def records() -> Iterator[bytes]:
            for b in batches:
                for doc_id, ids in zip(b.column("doc_id").to_pylist(), enc.encode(b.column("text").to_pylist())):
                    ids = np.concatenate([ids, end])
                    offsets.append(done[0])
                    record = frame(pack(doc_id, ids, width))
                    done[0] += len(record)
                    done[1] += len(ids)
                    yield record

        part = TaskContext.get().partitionId()
        stream = records()
        first = next(stream, None)
        if first is not None:
            write_file(f"{folder}/{part:06d}.rec", chain([first], stream))
            write_file(f"{folder}/{part:06d}.idx", iter([np.array(offsets, "<u8").tobytes()]))
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([len(offsets)]), pa.array([done[1]])], ["part", "records", "ids"])

    rows = dealt.select("doc_id", "text").mapInArrow(write, "part long, records long, ids long").collect()  # a row a file
    return sorted(map(tuple, rows))


def read_records(spark: SparkSession, folder: str, files: list[tuple[int, int, int]]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files; every checksum is verified."""
    listed, before, at, room = [], 0, -1, 0
    for part, records, ids in files:
        if room <= 0:
            at, room = at + 1, PART_BYTES
        room -= 4 * ids + 26 * records  # at most; files stay whole, and each task reads a run of them
        listed.append((part, before, at))
        before += ids
    frame_of = spark.createDataFrame(listed, "part long, base long, at int")
    if listed:
        frame_of = frame_of.repartitionById(at + 1, "at").sortWithinPartitions("part")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, base in zip(b.column("part").to_pylist(), b.column("base").to_pylist()):
                rows: list[tuple] = []
                with open_file(f"{folder}/{part:06d}.rec") as f:
                    while (payload := read_frame(f)) is not None:
                        doc_id, ids = unpack(payload)
                        rows.append((doc_id, base, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        base += len(ids)
                        if len(rows) == 10_000:
                            yield _batch(rows)
                            rows = []
                if rows:
                    yield _batch(rows)

    return frame_of.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_at(folder: str, part: int, which: list[int]) -> list[tuple[int | None, np.ndarray]]:
    """Records of one file by their numbers, in any order, through the offset index."""
    fs, path = filesystem(folder)
    offsets = np.frombuffer(fs.open_input_stream(f"{path}/{part:06d}.idx").read(), "<u8")
    out = []
    with fs.open_input_file(f"{path}/{part:06d}.rec") as f:
        for k in which:
            f.seek(int(offsets[k]))
            out.append(unpack(read_frame(f)))
    return out


def token_records(docs: DataFrame, tokenizer_json: str, end_id: int = 2) -> DataFrame:
    """Write docs and read them back: doc_id, start, n_tokens, ids_crc32; one row a row of docs."""
    spark = docs.sparkSession
    folder = new_folder(spark, "records")
    return read_records(spark, folder, write_records(docs, tokenizer_json, end_id, folder))
