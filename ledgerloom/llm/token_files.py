"""Token ids of documents in compressed, checksummed files.

Texts are encoded by a tokenizer, ended by an end id, and written in ascending order of
doc_id.  The file format: Parquet files whose rows are *frames*.  A frame holds some
whole documents:

    "LLTF", version (u16), vocabulary (u32), documents (u32), ids (u64), blocks (u32)
    crc32 (u32) of the three tables that follow
    per document: is the id null (u8); doc_id (i64); ids, the end id included (u64)
    per block: ids (u32); crc32 of the ids (u32); payload bytes (u32)
    the payloads

All numbers are little-endian.  Blocks are coded by ``id_coder``, each from a fresh
model, so that any block can be read by itself; documents may run over several blocks.
A frame is the unit of reading and of memory: about FRAME ids, or one longer document.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm import id_coder
from ledgerloom.llm.common import ship, text_or_empty

END_ID = 2
FRAME = 1 << 21  # ids at which a frame is closed
_MAGIC, _VERSION = b"LLTF", 1
_HEAD = struct.Struct("<4sHIIQII")
_FRAMES = "part int, frame long, documents long, ids long, bytes binary"
_FOUND = "part int, frame long, doc_id long, offset long, n_tokens long, ids_crc32 long"
# Frames are large values: pages and row groups have to be cut after few of them.
_PARQUET = {
    "compression": "uncompressed",
    "parquet.block.size": str(16 << 20),
    "parquet.block.size.row.check.min": "1",
    "parquet.block.size.row.check.max": "1",
    "parquet.page.size.row.check.min": "1",
    "parquet.page.size.row.check.max": "1",
    "parquet.enable.dictionary": "false",
}


class Encoder:
    """A tokenizer of the tokenizers library, loaded once per task; its own threads are off."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(e.ids, "<u4").tobytes() for e in found]


def pack(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, vocabulary: int) -> bytes:
    """A frame of the documents whose ids lie one after another in ``ids``."""
    blocks = id_coder.encode(ids, id_coder.block_length(len(ids)), vocabulary)
    tables = b"".join(
        (
            np.array([d is None for d in doc_ids], np.uint8).tobytes(),
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
            np.array(lengths, "<u8").tobytes(),
            np.array([(n, crc, len(p)) for n, crc, p in blocks], "<u4").tobytes(),
        )
    )
    head = _HEAD.pack(_MAGIC, _VERSION, vocabulary, len(doc_ids), len(ids), len(blocks), zlib.crc32(tables))
    return b"".join((head, tables, *(p for _, _, p in blocks)))


def unpack(frame: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, their numbers of ids, and all ids of a frame; damage raises ValueError."""
    if len(frame) < _HEAD.size or frame[:4] != _MAGIC:
        raise ValueError("this is no frame of token ids")
    _, version, vocabulary, documents, n_ids, n_blocks, crc = _HEAD.unpack_from(frame)
    if version != _VERSION:
        raise ValueError(f"frames of version {version} can't be read")
    at = _HEAD.size
    end = at + 17 * documents + 12 * n_blocks
    if zlib.crc32(frame[at:end]) != crc:
        raise ValueError("the tables of a frame don't have their checksum")
    null = np.frombuffer(frame, np.uint8, documents, at)
    doc_ids = np.frombuffer(frame, "<i8", documents, at + documents)
    lengths = np.frombuffer(frame, "<u8", documents, at + 9 * documents).astype(np.int64)
    table = np.frombuffer(frame, "<u4", 3 * n_blocks, at + 17 * documents).reshape(-1, 3)
    blocks = []
    for n, block_crc, size in table.tolist():
        blocks.append((n, block_crc, frame[end : end + size]))
        end += size
    ids = id_coder.decode(blocks, vocabulary)
    if len(ids) != n_ids or lengths.sum() != n_ids:
        raise ValueError("a frame's documents and blocks differ in length")
    return [None if x else d for d, x in zip(doc_ids.tolist(), null, strict=True)], lengths, ids


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Writes the ids of every text to ``folder``, in ascending order of doc_id.

    ``tokenizer`` is the path of a file of the tokenizers library on every executor.
    A null text is empty and has the end id alone; a null id comes first; rows that
    share an id come in the order of the table.  Other columns aren't read.  The
    folder must be new; a lost task is done again and leaves no second copy.
    """
    ship(docs.sparkSession)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text_or_empty().alias("text"),
        F.monotonically_increasing_id().alias("_row"),
    )
    # By row too, so that a repeated id spreads over tasks.
    ordered = rows.repartitionByRange("doc_id", "_row").sortWithinPartitions("doc_id", "_row").drop("_row")

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        vocabulary = max(encoder.vocabulary, end_id + 1)
        end, part = np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId()
        doc_ids: list[int | None] = []
        found: list[bytes] = []
        size = number = 0

        def closed() -> pa.RecordBatch:
            lengths = [len(f) // 4 for f in found]
            frame = pack(doc_ids, lengths, np.frombuffer(b"".join(found), "<u4"), vocabulary)
            row = {"part": part, "frame": number, "documents": len(doc_ids), "ids": sum(lengths), "bytes": frame}
            return pa.RecordBatch.from_pylist([row], _schema_of_frames())

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(ids), 256):
                for d, f in zip(ids[at : at + 256], encoder(texts.slice(at, 256).to_pylist()), strict=True):
                    doc_ids.append(d)
                    found.append(f + end)
                    size += len(f) // 4 + 1
                    if size >= FRAME:
                        yield closed()
                        doc_ids.clear(), found.clear()
                        size, number = 0, number + 1
        if doc_ids:
            yield closed()

    ordered.mapInArrow(frames, _FRAMES).write.options(**_PARQUET).parquet(folder)


def _schema_of_frames() -> pa.Schema:
    kinds = {"part": pa.int32(), "frame": pa.int64(), "documents": pa.int64(), "ids": pa.int64(), "bytes": pa.binary()}
    return pa.schema(list(kinds.items()))


def _starts(frames: DataFrame) -> DataFrame:
    """How many ids come before each frame.  Sums run inside a part, then over the parts."""
    sizes = frames.select("part", "frame", "ids")
    # A row per task that wrote: that is all this window holds.
    parts = sizes.groupBy("part").agg(F.sum("ids").alias("_all"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("_all").over(earlier), F.lit(0)).alias("_parts"))
    inside = Window.partitionBy("part").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_frames", F.coalesce(F.sum("ids").over(inside), F.lit(0)))
    return sizes.join(parts, "part").select("part", "frame", (F.col("_parts") + F.col("_frames")).alias("_start"))


def read(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in ``folder``, from its files.

    ``start`` is the number of ids of all documents before it, ``ids_crc32`` the crc32
    of its ids as little-endian unsigned 32-bit integers; ``with_ids`` adds the ids.
    Damaged frames and blocks raise ValueError.
    """
    ship(spark)
    frames = spark.read.schema(_FRAMES).parquet(folder)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                doc_ids, lengths, ids = unpack(batch.column("bytes")[i].as_py())
                ends = np.cumsum(lengths)
                raw = memoryview(ids.tobytes())
                crcs = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                columns = [
                    pa.repeat(batch.column("part")[i], len(doc_ids)),
                    pa.repeat(batch.column("frame")[i], len(doc_ids)),
                    pa.array(doc_ids, pa.int64()),
                    pa.array(ends - lengths),
                    pa.array(lengths),
                    pa.array(crcs, pa.int64()),
                ]
                names = ["part", "frame", "doc_id", "offset", "n_tokens", "ids_crc32"]
                if with_ids:
                    offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                    columns.append(pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    found = frames.select("part", "frame", "bytes").mapInArrow(documents, _FOUND + (", ids array<int>" if with_ids else ""))
    return found.join(_starts(frames), ["part", "frame"]).select(
        "doc_id", (F.col("_start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])
    )
