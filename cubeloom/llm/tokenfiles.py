"""Token-ID output: seekable files of independent zstandard frames.

A file holds the ids of whole documents, in ascending doc_id order:

* each document is one or more frames of its own (a long one is cut every ``FRAME_IDS`` ids), so a
  reader decompresses only the documents asked for;
* a skippable frame holds the index: an Arrow stream with doc_id, n_tokens and n_frames;
* another skippable frame ends the file: the seek table of the zstandard seekable format, with the
  compressed size, the size and a checksum of each frame.

Ids are little-endian unsigned integers of 2 bytes where the vocabulary allows it, else of 4.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cubeloom.llm.common import lean, new_dir, qualified, stage
from cubeloom.llm.encoding import encoder

#: Fixed values of the zstandard seekable format.
SEEK_TABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80
#: A skippable frame of our own for the index.
INDEX_MAGIC = 0x184D2A50

#: Schemes that Spark's connectors have for stores, and the usual ones.
STORES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "wasbs": "abfs", "wasb": "abfs"}

FRAME_IDS = 1 << 18
BYTE_VOCABULARY = "byte_bpe_50k.json"
END_ID = b"\0\0\0\0"

_MANIFEST = "path string, first_doc long, n_docs long, n_tokens long, n_bytes long"
_DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def open_fs(uri: str):
    """The file system and path of a full URI, reached from any process without Spark.

    Schemes of Spark's own connectors are taken for the same store's usual ones. A URI without a
    scheme, or with one that is not known here, is an error: never a local file instead.
    """
    from pyarrow import fs

    scheme, colon, rest = uri.partition(":")
    if not colon or "/" in scheme:
        raise ValueError(f"{uri} has no scheme")
    if scheme in STORES:
        uri = f"{STORES[scheme]}:{rest}"
    elif scheme == "file":
        uri = "file:///" + rest.lstrip("/")
    return fs.FileSystem.from_uri(uri)


def _checksum(raw: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF


class TokenFileWriter:
    """Writes documents one after another; only one frame is in memory at a time."""

    def __init__(self, out, width: int):
        import zstandard

        self.out, self.width = out, width
        self.dtype = np.dtype("<u2" if width == 2 else "<u4")
        self.compressor = zstandard.ZstdCompressor(level=1)
        self.doc_ids: list[int | None] = []
        self.n_tokens: list[int] = []
        self.n_frames: list[int] = []
        self.seek: list[tuple[int, int, int]] = []
        self.size = 0

    def _frame(self, raw: bytes) -> None:
        packed = self.compressor.compress(raw)
        self.out.write(packed)
        self.seek.append((len(packed), len(raw), _checksum(raw)))
        self.size += len(packed)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        for at in range(0, max(len(ids), 1), FRAME_IDS):
            self._frame(ids[at : at + FRAME_IDS].astype(self.dtype).tobytes())
        self.doc_ids.append(doc_id)
        self.n_tokens.append(len(ids))
        self.n_frames.append(max(1, -(-len(ids) // FRAME_IDS)))

    def close(self) -> None:
        sink = io.BytesIO()
        index = pa.table(
            {"doc_id": pa.array(self.doc_ids, pa.int64()), "n_tokens": pa.array(self.n_tokens, pa.int64()), "n_frames": pa.array(self.n_frames, pa.int32())},
            metadata={"width": str(self.width)},
        )
        with pa.ipc.new_stream(sink, index.schema) as stream:
            stream.write_table(index)
        body = sink.getvalue()
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(body)) + body)
        self.seek.append((len(body) + 8, 0, 0))
        entries = b"".join(struct.pack("<III", *e) for e in self.seek)
        footer = struct.pack("<IBI", len(self.seek), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SEEK_TABLE_MAGIC, len(entries) + 9) + entries + footer)
        self.size += len(body) + 8 + len(entries) + 17
        self.out.close()


class TokenFileReader:
    """Reads documents from a token file by their place or their doc_id.

    A frame whose checksum differs raises ``ValueError``; nothing else of the file is decompressed.
    """

    def __init__(self, source):
        import zstandard

        self.source = source
        size = source.size()
        n, flags, magic = struct.unpack("<IBI", source.read_at(9, size - 9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError("not a seekable file")
        if not flags & CHECKSUM_FLAG:
            raise ValueError("the seek table has no checksums")
        table = source.read_at(n * 12, size - 9 - n * 12)
        self.seek = np.frombuffer(table, "<u4").reshape(n, 3).astype(np.int64)
        self.place = np.concatenate([[0], np.cumsum(self.seek[:, 0])])
        body = source.read_at(int(self.seek[-1, 0]) - 8, int(self.place[n - 1]) + 8)
        index = pa.ipc.open_stream(body).read_all()
        self.width = int(index.schema.metadata[b"width"])
        self.doc_ids = index["doc_id"].to_pylist()
        self.n_tokens = index["n_tokens"].to_numpy()
        self.starts = np.concatenate([[0], np.cumsum(self.n_tokens)])
        self.first_frame = np.concatenate([[0], np.cumsum(index["n_frames"].to_numpy())])
        self._decompressor = zstandard.ZstdDecompressor()

    def __len__(self) -> int:
        return len(self.doc_ids)

    def ids(self, k: int) -> np.ndarray:
        """The ids of the document at place ``k``, decompressing its own frames alone."""
        first, last = int(self.first_frame[k]), int(self.first_frame[k + 1])
        packed = memoryview(self.source.read_at(int(self.place[last] - self.place[first]), int(self.place[first])))
        parts, at = [], 0
        for f in range(first, last):
            raw = self._decompressor.decompress(packed[at : at + int(self.seek[f, 0])], max_output_size=int(self.seek[f, 1]))
            at += int(self.seek[f, 0])
            if _checksum(raw) != self.seek[f, 2]:
                raise ValueError(f"frame {f} is damaged")
            parts.append(raw)
        return np.frombuffer(b"".join(parts), "<u2" if self.width == 2 else "<u4").astype("<u4")

    def find(self, doc_id: int) -> list[np.ndarray]:
        """The ids of all documents with this doc_id."""
        return [self.ids(k) for k, d in enumerate(self.doc_ids) if d == doc_id]


@lean
def _write(batches: Iterable[pa.RecordBatch], folder: str, vocabulary: str) -> Iterator[pa.RecordBatch]:
    enc = encoder(vocabulary)
    width = 2 if enc.n_ids <= 1 << 16 else 4
    writer, path, first, files = None, "", None, None
    for batch in batches:
        doc_ids = batch.column(0).to_pylist()
        for doc_id, ids in zip(doc_ids, enc.encode_array(batch.column(1)), strict=True):
            if writer is None:
                files, root = open_fs(folder)
                path, first = f"{root}/{uuid.uuid4().hex}.tok", doc_id
                writer = TokenFileWriter(files.open_output_stream(path), width)
            writer.add(doc_id, np.frombuffer(ids + END_ID, "<u4"))
    if writer is not None:
        writer.close()
        yield pa.RecordBatch.from_pydict(
            {"path": [path], "first_doc": pa.array([first], pa.int64()), "n_docs": [len(writer.doc_ids)], "n_tokens": [sum(writer.n_tokens)], "n_bytes": [writer.size]}
        )


def write_token_files(docs: DataFrame, vocabulary: str = BYTE_VOCABULARY, folder: str | None = None) -> DataFrame:
    """Encode every text, append id 0, and write the ids in ascending doc_id order.

    ``docs`` needs ``doc_id`` and ``text``; other columns are not read. A null text counts as empty,
    a null doc_id comes first, rows with the same doc_id follow one another in text order. One
    range exchange deals the rows; each task writes one file under a name of its own. A very long text
    is encoded in parts and written in several frames. The manifest
    that is returned is written by Spark's commit protocol, so files of lost or repeated task
    attempts are in no manifest and no reader sees them.

    Returns one row per file: path, first_doc, n_docs, n_tokens, n_bytes. No documents: no rows.
    """
    spark = docs.sparkSession
    folder = qualified(spark, folder) if folder else new_dir(spark, "tokens")
    files, root = open_fs(folder)
    files.create_dir(root, recursive=True)

    def write(batches):
        return _write(batches, folder, vocabulary)

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    manifest = stage(dealt.mapInArrow(write, _MANIFEST), "manifest")
    return manifest.withColumn("folder", F.lit(folder))


@lean
def _read(batches: Iterable[pa.RecordBatch], chunk: int = 4096) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            files, _ = open_fs(row["folder"])
            with files.open_input_file(row["path"]) as source:
                reader = TokenFileReader(source)
                for at in range(0, len(reader), chunk):
                    some = range(at, min(at + chunk, len(reader)))
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array([reader.doc_ids[k] for k in some], pa.int64()),
                            "start": pa.array(reader.starts[some.start : some.stop] + row["base"], pa.int64()),
                            "n_tokens": pa.array(reader.n_tokens[some.start : some.stop], pa.int64()),
                            "ids_crc32": pa.array([zlib.crc32(reader.ids(k).tobytes()) for k in some], pa.int64()),
                        }
                    )


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Read the files of a manifest back: doc_id, start, n_tokens and the ids' crc32 per document.

    ``start`` counts the ids of all documents before; it needs one number per file, not per document.
    """
    files = manifest.withColumn(
        "base", F.coalesce(F.sum("n_tokens").over(Window.orderBy(F.col("first_doc").asc_nulls_first(), "path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    n = max(1, min(manifest.count(), 10_000))
    return files.select("folder", "path", "base").repartition(n).mapInArrow(_read, _DOCUMENTS)


def token_digests(spark: SparkSession, docs: DataFrame, vocabulary: str = BYTE_VOCABULARY) -> DataFrame:
    """Write ``docs`` as token files and return what the files hold, per document."""
    return read_token_files(write_token_files(docs, vocabulary))
