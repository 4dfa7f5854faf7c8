"""Operator 2, token-id output: seekable archives of token ids.

An archive is one file. Each document is one zstandard frame or, where its ids
exceed FRAME_IDS, several; frames are independent and carry their content
checksum. After them stand two skippable frames: a table of documents, and the
seek table of the public zstd seekable format (sizes and a checksum for each
frame), so that a reader opens the end of a file and decompresses only the
documents it wants. Files hold ascending, disjoint ranges of doc_id.

Layout, integers little-endian: frames of ids as unsigned 16-bit integers;
skippable frame 0x184D2A5D: for each document int64 doc_id, uint32 first frame,
uint32 frames, uint64 ids, then uint64 documents; skippable frame 0x184D2A5E:
the seek table with its footer.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lattica.llm.tokens import by_bytes, tokenizer_path, word_memo
from lattica.session import materialize, scratch, table

#: Ids in one frame at most; longer documents span frames.
FRAME_IDS = 1 << 18
#: UTF-8 bytes of text behind one archive file, on average.
FILE_BYTES = 32 << 20
#: Appended to every document.
END_ID = 2
#: Bytes of text handed to the tokenizer at once.
BATCH_BYTES = 8 << 20

#: Fixed values of the public zstd seekable format, and this format's own table of documents.
SEEK_MAGIC = 0x8F92EAB1
SEEK_SKIPPABLE = 0x184D2A5E
DOCS_SKIPPABLE = 0x184D2A5D
CHECKSUM_FLAG = 0x80

_DOC = np.dtype([("doc_id", "<i8"), ("frame", "<u4"), ("frames", "<u4"), ("ids", "<u8")])
_SEEK = np.dtype([("packed", "<u4"), ("size", "<u4"), ("check", "<u4")])


def _store(uri: str):
    """The file system of a shared folder (file, hdfs, s3 and others) and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class ArchiveWriter:
    """Writes documents in the order they come; `close` appends both tables."""

    def __init__(self, sink):
        import zstandard

        self.sink, self.docs, self.seek = sink, [], []
        self.zstd = zstandard.ZstdCompressor(level=1, write_checksum=True, write_content_size=True)

    def add(self, doc_id: int, ids: bytes) -> None:
        import xxhash

        first, step = len(self.seek), 2 * FRAME_IDS
        for at in range(0, len(ids), step):
            part = ids[at : at + step]
            packed = self.zstd.compress(part)
            self.sink.write(packed)
            self.seek.append((len(packed), len(part), xxhash.xxh64_intdigest(part) & 0xFFFFFFFF))
        self.docs.append((doc_id, first, len(self.seek) - first, len(ids) // 2))

    def close(self) -> None:
        docs = np.array(self.docs, _DOC).tobytes() + struct.pack("<Q", len(self.docs))
        self.sink.write(struct.pack("<II", DOCS_SKIPPABLE, len(docs)) + docs)
        seek = np.array(self.seek, _SEEK).tobytes() + struct.pack("<IBI", len(self.seek), CHECKSUM_FLAG, SEEK_MAGIC)
        self.sink.write(struct.pack("<II", SEEK_SKIPPABLE, len(seek)) + seek)


class ArchiveReader:
    """Reads an archive by its tables; `ids(k)` decompresses the k-th document's frames alone."""

    def __init__(self, source):
        import zstandard

        self.source, self.zstd = source, zstandard.ZstdDecompressor()
        size = source.seek(0, io.SEEK_END)
        count, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_MAGIC or flags != CHECKSUM_FLAG:
            raise ValueError("not a seekable archive")
        head = size - 9 - count * _SEEK.itemsize
        self.seek = np.frombuffer(self._at(head, count * _SEEK.itemsize), _SEEK)
        self.starts = np.concatenate([[0], np.cumsum(self.seek["packed"], dtype=np.int64)])
        (n,) = struct.unpack("<Q", self._at(head - 16, 8))
        self.docs = np.frombuffer(self._at(head - 16 - n * _DOC.itemsize, n * _DOC.itemsize), _DOC)
        self.frames = list(zip(self.starts.tolist(), self.seek["packed"].tolist(), self.seek["check"].tolist()))
        self.spans = list(zip(self.docs["frame"].tolist(), (self.docs["frame"] + self.docs["frames"]).tolist()))

    def _at(self, place: int, length: int) -> bytes:
        self.source.seek(place)
        return self.source.read(length)

    def ids(self, k: int) -> bytes:
        import xxhash

        out = []
        for start, packed, check in self.frames[slice(*self.spans[k])]:
            part = self.zstd.decompress(self._at(start, packed))
            if xxhash.xxh64_intdigest(part) & 0xFFFFFFFF != check:
                raise ValueError(f"a frame of document {k} is damaged")
            out.append(part)
        return b"".join(out)

    def find(self, doc_id: int) -> list[int]:
        """Places of a doc_id; documents ascend."""
        lo, hi = np.searchsorted(self.docs["doc_id"], [doc_id, doc_id + 1])
        return list(range(lo, hi))


_FILES = "file string, part int, first_id long, last_id long, docs long, ids long, null_ids long"


def write_archives(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encodes docs (doc_id, text) into archives below `folder`; returns the table of files with `start`.

    Documents stand in ascending doc_id, over all files; rows that repeat an id
    stand together, ordered by a hash of their text. A null text is empty: it
    holds the end id alone. Rows with a null doc_id come first; they have the
    least 64-bit integer in the file, which counts them, and null when read. An empty table has no files.
    A task that runs again writes a file of another name; the table of files
    names those that count.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = rows.agg(F.sum(F.coalesce(F.octet_length("text").cast("long"), F.lit(0)) + 1).alias("b")).first()["b"] or 0
    files = max(1, -(-total // file_bytes))
    path = tokenizer

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        memo, writer, sink = word_memo(path, spaces_dropped=True), None, None
        part = TaskContext.get().partitionId()
        end = struct.pack("<H", end_id)
        store, base = _store(folder)
        name = f"{base}/part-{part:06d}-{uuid.uuid4().hex}.ids"
        nulls = 0
        for batch in by_bytes(batches, BATCH_BYTES):
            nulls += batch.column("doc_id").null_count
            if writer is None:
                store.create_dir(base, recursive=True)
                sink = store.open_output_stream(name)
                writer = ArchiveWriter(sink)
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), memo.encode(batch.column("text").to_pylist())):
                writer.add(-(2**63) if doc_id is None else doc_id, ids + end)
        if writer is not None:
            writer.close()
            sink.close()
            d = np.array(writer.docs, _DOC)
            yield pa.RecordBatch.from_pydict(
                {"file": [name], "part": pa.array([part], pa.int32()), "first_id": [int(d["doc_id"][0])], "last_id": [int(d["doc_id"][-1])],
                 "docs": [len(d)], "ids": [int(d["ids"].sum())], "null_ids": [nulls]}
            )

    key = F.xxhash64("text")
    sorted_rows = rows.repartitionByRange(files, "doc_id", key).sortWithinPartitions("doc_id", key)
    listed = materialize(sorted_rows.mapInArrow(write, _FILES), "archive-files")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    # one row a file (one for each FILE_BYTES of text): the only rows that meet in one task
    return listed.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read_archives(files: DataFrame, folder: str) -> DataFrame:
    """Every document of the archives in `files`: doc_id, start, n_tokens, ids_crc32 and file.

    ids_crc32 is of the ids as little-endian unsigned 32-bit integers.
    """
    spark = files.sparkSession

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _store(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(row["file"]) as f:
                    r = ArchiveReader(io.BytesIO(f.read()))  # every document is wanted: one read of the file
                    n = r.docs["ids"].astype(np.int64)
                    crc = [zlib.crc32(np.frombuffer(r.ids(k), "<u2").astype("<u4").tobytes()) for k in range(len(n))]
                    null = np.arange(len(n)) < row["null_ids"]
                    yield pa.RecordBatch.from_pydict(
                        {"doc_id": pa.array(r.docs["doc_id"].astype(np.int64), pa.int64(), mask=null), "start": row["start"] + np.cumsum(n) - n,
                         "n_tokens": n, "ids_crc32": pa.array(crc, pa.int64()), "file": [row["file"].rsplit("/", 1)[-1]] * len(n)}
                    )

    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spread = files.select("file", "start", "part", "null_ids").repartition(n, "part")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, file string")


def op2_token_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all documents' ids as archives and returns what they read back as."""
    folder = scratch(spark, "archive")
    files = write_archives(table(spark, sf_dir, "documents"), folder, tokenizer_path("word_bpe_49k.json"))
    return read_archives(files, folder)
