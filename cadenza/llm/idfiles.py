"""Token ids of whole documents as compressed binary files, and back.

Documents are range-partitioned and sorted by doc_id; each task tokenizes its stretch, ends every document with the end id and codes
the ids in blocks of `idcoder`, an adaptive context-mixing range coder that starts anew in every block.  Files follow each other by
name; the sink writes all of them or none (`sources.blobs`).

A file: magic, version, vocabulary; blocks one after the other; an index (doc_ids and lengths, compressed); a footer with the
place and checksum of the index and the numbers of documents and ids.  Whatever was altered or cut off is found on reading: each
block has a checksum of its digits and one of its ids, and index and footer have their own.

Results in special cases
------------------------
* null or empty text: the end id alone; null doc_id: an ordinary value, before all others;
* repeated doc_ids: a document for each row, in the order of a hash of their texts; equal rows are equal documents, one after the other;
* very long texts: a document may span blocks, never files, so a file is at most a document longer than `FILE` ids;
* empty table: no file, and reading them gives no row; further columns, however named, are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.files import filesystem
from ..sources import blobs
from . import common, idcoder, packing

END_ID = 1
#: Ids of a file, but for its last document's; rows handed on at a time.
FILE, ROWS = 2 * idcoder.BLOCK, 4096
_MAGIC, _VERSION = b"CZID", 1
_HEAD, _FOOT = struct.Struct("<4sII"), struct.Struct("<QIIQQ4s")  # magic, version, vocabulary; index: place, bytes, crc32; documents, ids, magic


class FileMaker:
    """One file, document by document."""

    def __init__(self, vocabulary: int):
        self.vocabulary, self.out = vocabulary, bytearray(_HEAD.pack(_MAGIC, _VERSION, vocabulary))
        self.doc_ids, self.lengths = [], []
        self.open, self.waiting, self.n = [], 0, 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids) // 4)
        self.open.append(ids)
        self.waiting += len(ids) // 4
        self.n += len(ids) // 4
        if self.waiting >= idcoder.BLOCK:
            self._blocks(False)

    def _blocks(self, last: bool) -> None:
        ids, at = np.frombuffer(b"".join(self.open), "<u4"), 0
        while len(ids) - at >= idcoder.BLOCK or last and len(ids) > at:
            self.out += idcoder.encode(ids[at : at + idcoder.BLOCK], self.vocabulary)
            at += idcoder.BLOCK
        self.open = [ids[at:].tobytes()]
        self.waiting = len(self.open[0]) // 4

    def close(self) -> bytes:
        self._blocks(True)
        known = np.array([d is not None for d in self.doc_ids], bool)
        doc_ids = np.array([d or 0 for d in self.doc_ids], "<i8")
        index = zlib.compress(np.packbits(known).tobytes() + np.diff(doc_ids, prepend=np.int64(0)).astype("<i8").tobytes() + np.array(self.lengths, "<u8").tobytes())
        place = len(self.out)
        return bytes(self.out + index + _FOOT.pack(place, len(index), zlib.crc32(index), len(self.doc_ids), self.n, _MAGIC))


def documents(content: bytes) -> Iterator[tuple[int | None, np.ndarray]]:
    """doc_id and ids of each document of a file, in order; a block at a time is held."""
    data = memoryview(content)
    if len(data) < _HEAD.size + _FOOT.size:
        raise idcoder.Damaged("too short for a file of ids")
    place, size, crc, n_docs, n_ids, end = _FOOT.unpack_from(data, len(data) - _FOOT.size)
    magic, version, vocabulary = _HEAD.unpack_from(data, 0)
    if (magic, version, end) != (_MAGIC, _VERSION, _MAGIC) or place + size + _FOOT.size != len(data) or zlib.crc32(data[place : place + size]) != crc:
        raise idcoder.Damaged("not a whole file of ids")
    index, wide = zlib.decompress(data[place : place + size]), -(-n_docs // 8)
    known = np.unpackbits(np.frombuffer(index, np.uint8, wide), count=n_docs).astype(bool).tolist()
    doc_ids = np.cumsum(np.frombuffer(index, "<i8", n_docs, wide)).tolist()
    lengths = np.frombuffer(index, "<u8", n_docs, wide + 8 * n_docs).astype(np.int64).tolist()
    if sum(lengths) != n_ids:
        raise idcoder.Damaged("index and footer don't agree")
    at, held, free = _HEAD.size, np.zeros(0, "<u4"), 0
    for is_known, doc_id, length in zip(known, doc_ids, lengths):
        parts, missing = [], length
        while missing:
            if free == len(held):
                if at >= place:
                    raise idcoder.Damaged("blocks are missing")
                (held, at), free = idcoder.decode(data, at, vocabulary), 0
            take = min(missing, len(held) - free)
            parts.append(held[free : free + take])
            free, missing = free + take, missing - take
        yield (doc_id if is_known else None), (parts[0] if len(parts) == 1 else np.concatenate([held[:0], *parts]))


def write_ids(docs: DataFrame, path: str, end_id: int = END_ID, tokenizer: Callable[[], str] = packing.tokenizer_file) -> None:
    """Writes the ids of all documents (doc_id, text) in files below `path`, which must not exist."""
    own = F.xxhash64("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id", own).sortWithinPartitions("doc_id", own)
    end = np.array([end_id], "<u4").tobytes()

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, part = packing.word_ids(tokenizer()), TaskContext.get().partitionId()
        vocabulary = max(len(ids_of.ends), end_id + 1)
        maker, number = FileMaker(vocabulary), 0

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"part-{part:07d}-{number:07d}.ids"]), pa.array([maker.close()], pa.binary())], names=["name", "content"])

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), ids_of.many(text.as_py() or "" for text in batch.column(1))):
                maker.add(doc_id, ids + end)
                if maker.n >= FILE:
                    yield closed()
                    maker, number = FileMaker(vocabulary), number + 1
        if maker.doc_ids:
            yield closed()

    blobs.write_files(rows.mapInArrow(files, "name string, content binary"), F.col("name"), F.col("content"), path)


def read_ids(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (and the ids, if asked for) of all documents of the files."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                at, held, width = 0, [], 0
                for doc_id, x in documents(content.as_buffer()):
                    held.append((doc_id, at, len(x), zlib.crc32(np.ascontiguousarray(x)), *([x.astype(np.int32)] if ids else [])))
                    at, width = at + len(x), width + len(x) * ids
                    if len(held) >= ROWS or width >= idcoder.BLOCK:
                        yield made(name, held)
                        held, width = [], 0
                if held:
                    yield made(name, held)

    def made(name: str, held: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*held))
        out = [pa.array([name] * len(held)), *(pa.array(c, pa.int64()) for c in columns[:4]), *(pa.array(c, pa.list_(pa.int32())) for c in columns[4:])]
        return pa.RecordBatch.from_arrays(out, names=["file", "doc_id", "place", "n_tokens", "ids_crc32", *(["ids"] if ids else [])])

    schema = "file string, doc_id long, place long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids
    found = common.cut(blobs.read_files(spark, path).mapInArrow(rows, schema))
    sizes = found.groupBy("file").agg(F.sum("n_tokens").alias("n"))  # a row per file
    before = F.sum("n").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1))
    starts = sizes.select("file", F.coalesce(before, F.lit(0)).alias("before"))
    return found.join(F.broadcast(starts), "file").select("doc_id", (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if ids else []))


def op13_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{common.shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    try:
        write_ids(common.table(spark, sf_dir, "documents"), path)
        return read_ids(spark, path)
    finally:
        fs, at = filesystem(spark, path)
        fs.delete(at(path), True)
