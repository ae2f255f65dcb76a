"""Token ids in a binary file format: blocks of ids, cut into bit or byte planes, each compressed by zstandard.

A file is a sequence of frames, each followed by one line feed (which Spark's text sink puts there, so that any
Hadoop file system can hold the files and a lost executor leaves no half file):

    frame   = b"IVP1", kind (b"C" or b"I"), length of the body (u32), body
    chunk C = ids (u32), planes are bits (u8), number of planes (u8), then each plane: length (u32), zstandard data
    index I = zstandard data of: chunks (u64), documents (u64), chunk offsets (u64 each), ids of each chunk (u64 each),
              ids of each document (u64 each), doc_id of each (i64 each), whether that is null (u8 each)

All numbers are little-endian. Ids are unsigned 32-bit. Files in the order of the numbers in their names hold
documents in ascending doc_id order, a null first.

Cases: a null or empty text is the end id alone; a very long text spans chunks; repeated rows and equal doc_ids
are documents of their own, in any order among them; an empty table gives no documents. Further columns of the
input are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from inkveil.llm.common import scratch_path, slices, text_of, written
from inkveil.llm.tokens import encoder

MAGIC = b"IVP1"
#: Ids in a chunk.
CHUNK_IDS = 1 << 16
LEVEL = 3
#: Bytes of text in a file on average; ids of equal doc_ids stay in one file.
FILE_TEXT = 1 << 24


def to_planes(ids: np.ndarray, bits: bool) -> list[np.ndarray]:
    """Plane k has byte (or bit) k of each id."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [np.ascontiguousarray(raw[:, k]) for k in range(4)]
    unpacked = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(unpacked[:, k], bitorder="little") for k in range(32)]


def from_planes(planes: list[np.ndarray], n: int, bits: bool) -> np.ndarray:
    if not bits:
        return np.stack(planes, axis=1).reshape(-1).view("<u4")[:n] if n else np.zeros(0, "<u4")
    unpacked = np.stack([np.unpackbits(p, bitorder="little", count=n) for p in planes], axis=1)
    return np.packbits(unpacked, axis=1, bitorder="little").reshape(-1).view("<u4")


def frame(kind: bytes, body: bytes) -> bytes:
    return MAGIC + kind + struct.pack("<I", len(body)) + body


def chunk_frame(ids: np.ndarray, bits: bool, packer: zstandard.ZstdCompressor) -> bytes:
    planes = [packer.compress(p.tobytes()) for p in to_planes(ids, bits)]
    return frame(b"C", struct.pack("<IBB", len(ids), bits, len(planes)) + b"".join(struct.pack("<I", len(p)) + p for p in planes))


def read_chunk(body: memoryview) -> np.ndarray:
    n, bits, count = struct.unpack_from("<IBB", body)
    at, planes, unpacker = 6, [], zstandard.ZstdDecompressor()
    for _ in range(count):
        (size,) = struct.unpack_from("<I", body, at)
        planes.append(np.frombuffer(unpacker.decompress(body[at + 4 : at + 4 + size]), np.uint8))
        at += 4 + size
    return from_planes(planes, n, bool(bits))


def file_frames(docs: Iterator[tuple[int | None, bytes]], chunk_ids: int = CHUNK_IDS, bits: bool = False) -> Iterator[bytes]:
    """The frames of one file for (doc_id, little-endian ids) in file order."""
    packer, offset, held, held_size = zstandard.ZstdCompressor(level=LEVEL), 0, [], 0
    offsets, sizes, lengths, ids = [], [], [], []
    for doc_id, data in docs:
        ids.append(doc_id)
        lengths.append(len(data) // 4)
        held.append(data)
        held_size += len(data)
        while held_size >= 4 * chunk_ids:
            whole = b"".join(held)
            made = chunk_frame(np.frombuffer(whole[: 4 * chunk_ids], "<u4"), bits, packer)
            held = [whole[4 * chunk_ids :]]
            held_size = len(held[0])
            offsets.append(offset)
            sizes.append(chunk_ids)
            offset += len(made) + 1
            yield made
    if held_size:
        made = chunk_frame(np.frombuffer(b"".join(held), "<u4"), bits, packer)
        offsets.append(offset)
        sizes.append(held_size // 4)
        yield made
    if ids:
        arrays = [np.array(x, "<u8").tobytes() for x in (offsets, sizes, lengths)] + [np.array([x or 0 for x in ids], "<i8").tobytes(), bytes(x is None for x in ids)]
        yield frame(b"I", packer.compress(struct.pack("<QQ", len(offsets), len(ids)) + b"".join(arrays)))


def read_file(data: bytes) -> Iterator[tuple[int | None, bytes]]:
    """(doc_id, ids) of a file's documents, by its index."""
    view, at, index = memoryview(data), 0, None
    while at < len(data):
        if data[at : at + 4] != MAGIC:
            raise ValueError(f"no frame at byte {at}")
        (size,) = struct.unpack_from("<I", view, at + 5)
        if data[at + 4 : at + 5] == b"I":
            index = zstandard.ZstdDecompressor().decompress(view[at + 9 : at + 9 + size])
        at += 9 + size + 1
    if index is None:
        raise ValueError("the file has no index")
    n_chunks, n_docs = struct.unpack_from("<QQ", index)
    offsets, sizes = np.frombuffer(index, "<u8", 2 * n_chunks, 16).reshape(2, -1)
    lengths = np.frombuffer(index, "<u8", n_docs, 16 + 16 * n_chunks)
    ids = np.frombuffer(index, "<i8", n_docs, 16 + 16 * n_chunks + 8 * n_docs)
    null = index[16 + 16 * n_chunks + 16 * n_docs :]
    held, chunk = b"", 0
    for k, (doc_id, n) in enumerate(zip(ids.tolist(), lengths.tolist(), strict=True)):
        parts, have = [held], len(held)
        while have < 4 * n:
            start = int(offsets[chunk])
            (size,) = struct.unpack_from("<I", view, start + 5)
            got = read_chunk(view[start + 9 : start + 9 + size]).tobytes()
            if len(got) != 4 * sizes[chunk]:
                raise ValueError(f"chunk {chunk} doesn't fit the index")
            parts.append(got)
            have += len(got)
            chunk += 1
        whole = b"".join(parts)
        held = whole[4 * n :]
        yield (None if null[k] else doc_id), whole[: 4 * n]


def write_ids(docs: DataFrame, vocabulary: str, path: str, chunk_ids: int = CHUNK_IDS, bits: bool = False) -> None:
    """Files of the ids of each text, in ascending doc_id order over all files."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def encode(batches):
        def each():
            encode_texts = encoder(sent.value).encode
            for part in slices(batches, "text"):
                yield from zip(part.column("doc_id").to_pylist(), encode_texts(part.column("text").to_pylist()), strict=True)

        for made in file_frames(each(), chunk_ids, bits):
            yield pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], ["frame"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(F.col("text")).cast("binary").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    ordered = texts.repartitionByRange(-(-size // FILE_TEXT) or 1, "doc_id").sortWithinPartitions("doc_id")
    frames = ordered.mapInArrow(encode, "frame binary")
    frames.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", "\n").option("compression", "none").option("maxRecordsPerFile", 0).text(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, file, place (the document's number in its file), file_start, n_tokens, ids_crc32 and, as binary, ids."""

    def decode(batches):
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows, place, start = [], 0, 0
                for doc_id, ids in read_file(data.as_py()):
                    rows.append((doc_id, name, place, start, len(ids) // 4, zlib.crc32(ids), ids))
                    place, start = place + 1, start + len(ids) // 4
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in _columns(rows)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in _columns(rows)], names)

    names = ["doc_id", "file", "place", "file_start", "n_tokens", "ids_crc32", "ids"]

    def _columns(rows):
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)]

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(decode, "doc_id long, file string, place long, file_start long, n_tokens long, ids_crc32 long, ids binary")


def digests(docs: DataFrame, vocabulary: str, **options) -> DataFrame:
    """Writes the ids, reads the files back, and gives doc_id, start (ids before the document), n_tokens, ids_crc32 and file."""
    path = scratch_path(docs.sparkSession, "token-planes")
    write_ids(docs, vocabulary, path, **options)
    read = written(read_ids(docs.sparkSession, path).drop("ids", "place"), "token-digests")
    # Files are numbered by their partitions; a number may have more digits than others.
    number = F.regexp_extract("file", "part-([0-9]+)", 1).cast("long")
    files = read.groupBy("file").agg(F.sum("n_tokens").alias("n")).withColumn("number", number)
    # One row for each file.
    before = F.coalesce(F.sum("n").over(W.Window.orderBy("number").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))
    starts = files.select("file", before.alias("before"))
    return read.join(starts, "file").select("doc_id", (F.col("before") + F.col("file_start")).alias("start"), "n_tokens", "ids_crc32", "file")
