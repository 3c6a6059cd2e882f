"""Token ids in shard files of bit or byte planes.

A shard file holds the ids of consecutive documents:

    magic | chunk 0 | chunk 1 | ... | zstd(footer) | length of footer (u64) | magic

A chunk is a block of `block` ids (the last one shorter). The block is transposed:
plane k has bit k (or byte k) of every id, and each plane is compressed alone. High
planes are nearly constant and vanish; planes above the highest used bit are not
stored at all. The footer is the chunk index (offset, number of ids, planes and their
sizes) and the documents (id, number of tokens) as JSON-headed binary columns, so a
reader finds any document with two small reads.

Writers are executors. A task writes under a name of its own and reports it in its
rows; Spark commits the rows of one attempt only, so files of lost attempts are never
in the manifest and never read.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from unitweave.llm.common import cut, fresh_path, ship
from unitweave.llm.tokens import encoder

MAGIC = b"UWPLANE1"


def to_planes(ids: np.ndarray, plane: str) -> list[bytes]:
    """Block of ids (u4) -> its planes, lowest first; those above the highest used one are left out."""
    raw = np.ascontiguousarray(ids, "<u4")
    top = int(raw.max()).bit_length() if len(raw) else 0
    by_byte = raw.view(np.uint8).reshape(-1, 4)
    if plane == "byte":
        return [np.ascontiguousarray(by_byte[:, k]).tobytes() for k in range((top + 7) // 8)]
    bits = np.unpackbits(np.ascontiguousarray(by_byte[:, : (top + 7) // 8]), axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(top)]


def from_planes(planes: list[bytes], n: int, plane: str) -> np.ndarray:
    if plane == "byte":
        out = np.zeros((n, 4), np.uint8)
        for k, p in enumerate(planes):
            out[:, k] = np.frombuffer(p, np.uint8)
        return out.reshape(-1).view("<u4")
    out = np.zeros(n, "<u4")
    for k, p in enumerate(planes):
        out |= np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little").astype("<u4") << np.uint32(k)
    return out


class ShardWriter:
    def __init__(self, sink, block: int, plane: str, level: int):
        import zstandard

        self.sink, self.block, self.plane, self.zstd = sink, block, plane, zstandard.ZstdCompressor(level=level)
        self.buffer, self.held, self.chunks, self.at, self.n_ids = [], 0, [], len(MAGIC), 0
        self.doc_ids, self.n_tokens = [], []
        sink.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.doc_ids.append(doc_id)
        self.n_tokens.append(len(ids) // 4)
        self.buffer.append(ids)
        self.held += len(ids)
        self.n_ids += len(ids) // 4
        if self.held >= 4 * self.block:
            self._flush(last=False)

    def _flush(self, last: bool) -> None:
        data, size = b"".join(self.buffer), 4 * self.block
        end = len(data) if last else len(data) // size * size
        for k in range(0, end, size):
            ids = np.frombuffer(data[k : min(k + size, end)], "<u4")
            planes = [self.zstd.compress(p) for p in to_planes(ids, self.plane)]
            self.chunks.append([self.at, len(ids), [len(p) for p in planes]])
            for p in planes:
                self.sink.write(p)
                self.at += len(p)
        self.buffer, self.held = [data[end:]], len(data) - end

    def close(self) -> None:
        self._flush(last=True)
        known = np.array([d is not None for d in self.doc_ids], np.uint8)
        ids = np.array([d or 0 for d in self.doc_ids], "<i8")
        head = json.dumps({"block": self.block, "plane": self.plane, "n_ids": self.n_ids, "docs": len(ids), "chunks": self.chunks}).encode()
        footer = self.zstd.compress(struct.pack("<Q", len(head)) + head + ids.tobytes() + np.array(self.n_tokens, "<i8").tobytes() + known.tobytes())
        self.sink.write(footer + struct.pack("<Q", len(footer)) + MAGIC)


class ShardReader:
    def __init__(self, source, size: int):
        import zstandard

        self.source, self.zstd = source, zstandard.ZstdDecompressor()
        source.seek(size - 8 - len(MAGIC))
        tail = source.read(8 + len(MAGIC))
        if tail[8:] != MAGIC:
            raise ValueError("not a shard file, or not written to its end")
        n = struct.unpack("<Q", tail[:8])[0]
        source.seek(size - 8 - len(MAGIC) - n)
        footer = self.zstd.decompress(source.read(n))
        h = struct.unpack("<Q", footer[:8])[0]
        self.head, rest = json.loads(footer[8 : 8 + h]), footer[8 + h :]
        d = self.head["docs"]
        known = np.frombuffer(rest[16 * d :], np.uint8)
        self.doc_ids = [x if k else None for x, k in zip(np.frombuffer(rest[: 8 * d], "<i8").tolist(), known, strict=True)]
        self.n_tokens = np.frombuffer(rest[8 * d : 16 * d], "<i8").tolist()

    def chunk(self, k: int) -> np.ndarray:
        at, n, sizes = self.head["chunks"][k]
        self.source.seek(at)
        data, planes, i = self.source.read(sum(sizes)), [], 0
        for s in sizes:
            planes.append(self.zstd.decompress(data[i : i + s]))
            i += s
        return from_planes(planes, n, self.head["plane"])

    def documents(self) -> Iterator[tuple[int | None, int, int]]:
        """(doc_id, n_tokens, crc32 of its ids), one chunk in memory at a time."""
        k, ids, i = 0, np.zeros(0, "<u4"), 0
        for doc_id, n in zip(self.doc_ids, self.n_tokens, strict=True):
            crc, left = 0, n
            while left:
                if i == len(ids):
                    ids, k, i = self.chunk(k), k + 1, 0
                part = ids[i : i + left]
                crc = zlib.crc32(part.tobytes(), crc)
                i, left = i + len(part), left - len(part)
            yield doc_id, n, crc


def _file_system(path: str):
    """pyarrow's file system and path for a URI of Spark's (file, hdfs, viewfs, s3a, gs, abfss and the like)."""
    from pyarrow import fs

    scheme, colon, rest = path.partition("://")
    return fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + colon + rest)


def write_shards(docs: DataFrame, tokenizer: str, end_id: int, block: int = 1 << 16, plane: str = "byte", level: int = 3, folder: str | None = None) -> DataFrame:
    """Encodes docs (doc_id, text) in ascending doc_id order; the manifest, a row for each shard file.

    Manifest: shard, path, first_id, n_docs, n_ids, n_bytes. Null ids come first; a
    null text is encoded as an empty one (its end id alone); repeated ids keep their
    rows, in any order among themselves. An empty table gives an empty manifest.
    `folder` defaults to a new one in the shared folder.
    """
    spark = docs.sparkSession
    ship(spark)
    folder = folder or fresh_path(spark, "token-shards")
    end = int(end_id).to_bytes(4, "little")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, writer, name = encoder(tokenizer), None, ""
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if writer is None:
                    fs, root = _file_system(folder)
                    fs.create_dir(root, recursive=True)
                    shard = TaskContext.get().partitionId()
                    name = f"/shard-{shard:06d}-{uuid.uuid4().hex}.uwp"
                    out = fs.open_output_stream(root + name)
                    writer, first = ShardWriter(out, block, plane, level), doc_id
                writer.add(doc_id, enc.encode(text.as_py()) + end)
        if writer is not None:
            writer.close()
            out.close()
            size = fs.get_file_info(root + name).size
            yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [folder + name], "first_id": pa.array([first], pa.int64()), "n_docs": [len(writer.doc_ids)], "n_ids": [writer.n_ids], "n_bytes": [size]})

    kept = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    # Rows of one id may go to several files: their texts' hash is the second key.
    dealt = kept.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id")
    manifest = dealt.mapInArrow(write, "shard long, path string, first_id long, n_docs long, n_ids long, n_bytes long")
    return cut(manifest, "token-manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32, and its shard."""
    ship(manifest.sparkSession)
    # A row for each shard file: a window without keys sees no more.
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(order), F.lit(0)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "n_tokens", "ids_crc32", "shard"]
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = _file_system(row["path"])
                with fs.open_input_file(path) as source:
                    at, rows = row["base"], []
                    for doc_id, n, crc in ShardReader(source, row["n_bytes"]).documents():
                        rows.append((doc_id, at, n, crc, row["shard"]))
                        at += n
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(n, "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard long")
