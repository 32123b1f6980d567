"""Token ids as length-delimited binary records with a separate offset index.

A record is: payload length (u64), masked checksum of those eight bytes (u32), payload,
masked checksum of the payload (u32). A payload is: doc_id (i64), flags (u8: 1 = doc_id is
NULL, 2 = ids are 16 bits wide), ids. An index entry is: offset of the record, length of
its payload, ids before it in its file (three u64). Everything is little-endian. The
checksum is CRC-32, rotated right by 15 bits plus a constant, so that a checksum of data
which hold checksums stays sound.
"""

from __future__ import annotations

import os
import struct
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortline.llm.bpe import ONE_WORD, PIECES, UNSURE, Memory, byte_letters, slices
from cohortline.llm.common import kept_by_worker, stored, text_or_empty, travels
from cohortline.sources.storage import staging_path

END_ID = 2
HEAD, INDEX, HEAD_BYTES = "<QI", "<QQQ", 12
NULL_ID, NARROW = 1, 2
# A write or read of a file covers about so many bytes (a longer record alone).
BLOCK = 4 << 20


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return size + struct.pack("<I", masked(size)) + payload + struct.pack("<I", masked(payload))


def unframe(record: bytes) -> bytes:
    """Payload of a record; raises when a length or checksum is wrong."""
    size, crc = struct.unpack_from(HEAD, record)
    end = HEAD_BYTES + size
    payload = record[HEAD_BYTES : end]
    if crc != masked(record[:8]) or len(payload) != size or masked(payload) != struct.unpack_from("<I", record, end)[0]:
        raise ValueError("damaged record")
    return payload


def pack_ids(doc_id: int | None, ids: np.ndarray, narrow: bool) -> bytes:
    flags = NULL_ID * (doc_id is None) | NARROW * narrow
    return struct.pack("<qB", doc_id or 0, flags) + ids.astype("<u2" if narrow else "<u4").tobytes()


def unpack_ids(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, flags = struct.unpack_from("<qB", payload)
    ids = np.frombuffer(payload, "<u2" if flags & NARROW else "<u4", offset=9)
    return None if flags & NULL_ID else doc_id, ids


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


class Pieces:
    """The library's ids of whole texts, each distinct piece encoded once.

    The file's pre-tokenizer drops white space, joins nothing across it, and parts letters
    from marks, so the ids of a text are those of its pieces. Words of plain letters go
    straight to the library's model, lower-cased as its normalizer does; all else goes
    through the whole library.
    """

    def __init__(self, content: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        self.library = Tokenizer.from_str(content)
        self.library.no_truncation()
        self.library.no_padding()
        self.merge = self.library.model.tokenize
        self.letters = {b: c for c, b in byte_letters().items()}
        self.narrow = self.library.get_vocab_size() <= 1 << 16
        self.known = Memory(self.encode_piece)

    def encode_piece(self, piece: str) -> bytes:
        if ONE_WORD.fullmatch(piece):
            word = "".join([self.letters[b] for b in piece.lstrip(" ").lower().encode()])
            return array("I", [t.id for t in self.merge(word)]).tobytes()
        return array("I", self.library.encode(piece, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        if UNSURE.search(text):
            return self.encode_piece(text)
        return b"".join(map(self.known.__getitem__, PIECES.findall(text)))


def write_records(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, parts: int | None = None) -> DataFrame:
    """Encode texts and write them, in ascending doc_id order, to files below ``path``.

    Rows are range-partitioned by doc_id and sorted within (Spark spills what does not fit);
    each task streams its rows into ``part-00000.rec`` and ``part-00000.idx``. A task writes
    under a name of its attempt and renames at the end, so repeated or lost tasks leave whole
    files. Returns the manifest, one row per file: part, n_docs, n_ids.
    """
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        content = spark.sparkContext.broadcast(f.read())  # a vocabulary file: its size does not grow
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name, attempt = f"part-{task.partitionId():05d}", f".{task.taskAttemptId()}.tmp"
        store, base = opened(path)
        store.create_dir(base, recursive=True)
        encoder = kept_by_worker(("pieces", content.value), lambda: Pieces(content.value))
        offset = before = n = 0
        end = np.uint32(end_id).tobytes()
        with store.open_output_stream(f"{base}/{name}.rec{attempt}") as data, store.open_output_stream(f"{base}/{name}.idx{attempt}") as index:
            for batch in batches:
                for part in slices(batch, "text"):
                    for doc_id, text in zip(part.column("doc_id"), part.column("text"), strict=True):
                        doc_id, ids = doc_id.as_py(), np.frombuffer(encoder.encode(text.as_py()) + end, "<u4")
                        record = frame(payload := pack_ids(doc_id, ids, encoder.narrow))
                        data.write(record)
                        index.write(struct.pack(INDEX, offset, len(payload), before))
                        offset, before, n = offset + len(record), before + len(ids), n + 1
        for kind in ("rec", "idx"):
            store.move(f"{base}/{name}.{kind}{attempt}", f"{base}/{name}.{kind}")
        yield pa.RecordBatch.from_pydict({"part": [name], "n_docs": [n], "n_ids": [before]}, schema=shape)

    shape = pa.schema([("part", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    ordered = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    return stored(ordered.mapInArrow(run, "part string, n_docs long, n_ids long"), "records-manifest")


def read_index(path: str, part: str) -> np.ndarray:
    """Index of a file: rows of (offset, payload length, ids before)."""
    store, base = opened(path)
    with store.open_input_stream(f"{base}/{part}.idx") as f:
        return np.frombuffer(f.read(), "<u8").reshape(-1, 3)


def read_records(path: str, part: str, order: np.ndarray | None = None) -> Iterator[tuple[int, int | None, np.ndarray]]:
    """(ids before, doc_id, ids) of the records of a file, checked.

    In file order, or in any ``order`` of record numbers (shuffled reads by the index).
    Neighbouring records are read together, about ``BLOCK`` bytes at a time.
    """
    store, base = opened(path)
    index = read_index(path, part)
    entries = (index if order is None else index[order]).tolist()
    with store.open_input_file(f"{base}/{part}.rec") as f:
        k = 0
        while k < len(entries):
            begin, end, first = entries[k][0], entries[k][0], k
            while k < len(entries) and entries[k][0] == end and (k == first or end - begin < BLOCK):
                end += HEAD_BYTES + entries[k][1] + 4
                k += 1
            block = f.read_at(end - begin, begin)
            for at, size, before in entries[first:k]:
                doc_id, ids = unpack_ids(unframe(block[at - begin : at - begin + HEAD_BYTES + size + 4]))
                yield before, doc_id, ids


def record_digests(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """Read the files back: doc_id, start, n_tokens, ids_crc32.

    The manifest has one row per file (not per document), so its running sum is made by
    the driver; every task then reads one file from front to back.
    """
    files, start = [], 0
    for r in sorted(manifest.collect(), key=lambda r: r.part):
        files.append((r.part, start))
        start += r.n_ids

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame_ in frames:
            for part, base in zip(frame_["part"], frame_["base"], strict=True):
                rows: list[tuple] = []
                for before, doc_id, ids in read_records(path, part):
                    rows.append((doc_id, int(base) + before, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(rows) >= 10_000:
                        yield digest_frame(rows)
                        rows = []
                yield digest_frame(rows)

    table = spark.createDataFrame(files, "part string, base long").repartition(max(1, len(files)), "part")
    return table.mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def digest_frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"])
    return out.astype({"doc_id": "Int64", "start": "int64", "n_tokens": "int64", "ids_crc32": "int64"})


def export(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Write token ids of every text as records and describe what the files hold.

    One row per row of ``docs``: doc_id, start (ids of all documents before it), n_tokens
    (with the end id), ids_crc32. NULL and empty texts are the end id alone. Rows that
    repeat a doc_id are ordered by text; NULL doc_id comes first; an empty table writes empty
    files. Only doc_id and text are read. No step holds more than a block of a file.
    """
    path = path or staging_path(docs.sparkSession, "records")
    return record_digests(docs.sparkSession, path, write_records(docs, path, tokenizer))


travels(__name__)
