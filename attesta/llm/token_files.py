"""Token ids in files of independent Zstandard frames with a trailing seek table.

File format: frames, each the little-endian unsigned 32-bit ids of whole documents; a skippable frame
(0x184D2A50) with the compressed document index (frame, first id in the frame, ids, null mark and doc_id of each document);
and the seek table of Zstandard's seekable format: a skippable frame (0x184D2A5E) with compressed size,
decompressed size and checksum (low half of the XXH64 of the data) per frame, then the number of frames, the descriptor
(0x80: with checksums) and 0x8F92EAB1. A reader finds a document by the index and decompresses its frame only. A frame holds one document; a
writer may be asked to fill frames up to a number of ids instead, which takes less space and makes a reader decompress neighbours too.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, new_path, written
from .interned import Interned

INDEX_MAGIC, SEEK_MAGIC, FOOTER_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
FRAME_IDS, LEVEL, END_ID, LINE = 0, 3, 0, 2000
INDEX = np.dtype([("frame", "<u4"), ("first", "<u4"), ("ids", "<u4"), ("null", "u1"), ("doc_id", "<i8")])
#: White space on both sides of a space: there, splitting at spaces could change how the tokenizer splits.
_UNSAFE = re.compile(r"\s (?!\S)")


#: Marks a piece without a space before it.
_BARE = "\0"
#: Pieces that stay what they are between two digits: letters and ASCII punctuation behind one space at most, or a line feed.
_JOINED = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ!-/:-@\[-`{-~]+|\n")
#: Words that the pre-tokenizer parts in a known way: letters, closing punctuation, one line feed, letters, closing punctuation.
_PARTS = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]+)?(?:(\n)([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]+)?)?")


def splits_at_spaces(spec: dict) -> bool:
    """Whether a tokenizer's description is of the byte-level kind whose words may be encoded one by one."""
    pre = spec.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
    ahead = any(re.search(r"\s|^[A-Za-zÀ-ÿ.,;:!?]+$", t["content"]) or t.get("lstrip") or t.get("rstrip") for t in spec.get("added_tokens") or ())
    return plain and not spec.get("normalizer") and not ahead and (spec.get("model") or {}).get("type") == "BPE" and not (spec["model"].get("dropout") or spec["model"].get("ignore_merges"))


class Encoder:
    """Encodes texts with a byte-level tokenizer of the tokenizers library.

    Its pre-tokenizer never joins what stands before a space to what follows a non-space, so a text is split at
    spaces, plain pieces into words and punctuation, every distinct one is encoded once by the library, and the ids
    are put together. Texts where
    white space makes that unsafe are encoded whole, and so are all texts where the tokenizer's file names another
    normalizer, pre-tokenizer or model than those this holds for, or tokens that are matched ahead of them. Known pieces are kept, up to a bound.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.splits = splits_at_spaces(json.load(f))
        zero = self.tokenizer.encode("0", add_special_tokens=False).ids
        self.digit, self.splits = zero[0] if zero else -1, self.splits and len(zero) == 1
        self.pieces, self.words = Interned(self._part, most=300_000), Interned(self._encode, most=500_000)

    def _part(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        words, counts = [], []
        for p in pieces:
            p = p[1:] if p.startswith(_BARE) else " " + p
            found = _PARTS.fullmatch(p) if self.splits else None
            parts = [x for x in found.groups() if x] if found else [p]
            words += parts
            counts.append(len(parts))
        return self.words.ids(words, counts)

    def _encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces by the library; those that a digit parts from their neighbours go there in long lines, which costs less a piece."""
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        plain = np.fromiter((self.splits and _JOINED.fullmatch(p) is not None for p in pieces), bool, len(pieces))
        lines = list(compress(pieces, plain))
        text = ["0".join(lines[i : i + LINE]) + "0" for i in range(0, len(lines), LINE)]
        ids = np.concatenate([np.zeros(0, np.int32), *(np.array(e.ids, np.int32) for e in encode(text, add_special_tokens=False))]) if text else np.zeros(0, np.int32)
        parts = ids == self.digit
        sizes = np.zeros(len(pieces), np.int64)
        sizes[plain] = np.diff(np.flatnonzero(parts), prepend=-1) - 1
        if plain.all():
            return ids[~parts], sizes
        odd = [e.ids for e in encode(list(compress(pieces, ~plain)), add_special_tokens=False)]
        sizes[~plain] = [len(x) for x in odd]
        out, of_plain = np.empty(int(sizes.sum()), np.int32), np.repeat(plain, sizes)
        out[of_plain], out[~of_plain] = ids[~parts], [i for x in odd for i in x]
        return out, sizes

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the number of ids of each."""
        pieces, counts = [], []
        for t in texts:
            n = len(pieces)
            if not t:
                pass
            elif not self.splits or _BARE in t or _UNSAFE.search(t):
                pieces.append(_BARE + t)
            else:
                first, *rest = t.split(" ")
                if first:
                    pieces.append(_BARE + first)
                pieces += rest  # each stands for itself behind a space
            counts.append(len(pieces) - n)
        return self.pieces.ids(pieces, counts)


_ENCODERS: dict = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class Writer:
    """Writes one file to an open binary stream."""

    def __init__(self, out, frame_ids: int = FRAME_IDS):
        self.out, self.pack, self.frame_ids = out, zstandard.ZstdCompressor(level=LEVEL), frame_ids
        self.frames, self.index, self.held, self.size, self.ids = [], [], [], 0, 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if self.held and self.size + len(ids) > self.frame_ids:
            self._close_frame()
        self.index.append((len(self.frames), self.size, len(ids), doc_id is None, doc_id or 0))
        self.held.append(np.ascontiguousarray(ids, dtype="<u4"))
        self.size += len(ids)
        self.ids += len(ids)

    def _close_frame(self):
        data = b"".join(x.tobytes() for x in self.held)
        packed = self.pack.compress(data)
        self.out.write(packed)
        self.frames.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self.held, self.size = [], 0

    def close(self) -> None:
        if self.held:
            self._close_frame()
        packed = self.pack.compress(np.array(self.index, INDEX).tobytes())
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(packed)) + packed)
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0x80, FOOTER_MAGIC)
        self.out.write(struct.pack("<II", SEEK_MAGIC, len(table)) + table)


class Reader:
    """Reads one file from a seekable binary stream."""

    def __init__(self, source):
        self.source, self.unpack = source, zstandard.ZstdDecompressor()
        source.seek(0, 2)
        end = source.tell()
        n, kind, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != FOOTER_MAGIC or kind != 0x80:
            raise ValueError("not a token file")
        seek = end - 9 - 12 * n - 8
        if struct.unpack("<II", self._at(seek, 8)) != (SEEK_MAGIC, 12 * n + 9):
            raise ValueError("the seek table is damaged")
        self.frames = np.frombuffer(self._at(seek + 8, 12 * n), "<u4").reshape(n, 3)
        self.offsets = np.concatenate([[0], np.cumsum(self.frames[:, 0].astype(np.int64))])
        magic, size = struct.unpack("<II", self._at(int(self.offsets[-1]), 8))
        if magic != INDEX_MAGIC:
            raise ValueError("the document index is missing")
        self.index = np.frombuffer(self.unpack.decompress(self._at(int(self.offsets[-1]) + 8, size)), INDEX)

    def _at(self, start: int, size: int) -> bytes:
        self.source.seek(start)
        return self.source.read(size)

    def frame(self, i: int) -> np.ndarray:
        packed, size, checksum = (int(x) for x in self.frames[i])
        data = self.unpack.decompress(self._at(int(self.offsets[i]), packed), max_output_size=size)
        if len(data) != size or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {i} is damaged")
        return np.frombuffer(data, "<u4")

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        at, held = -1, None
        for frame, first, n, null, doc_id in self.index.tolist():
            if frame != at:
                at, held = frame, self.frame(frame)
            yield (None if null else doc_id), held[first : first + n]

    def documents(self, wanted: Iterable[int]) -> dict[int, list[np.ndarray]]:
        """Ids of the wanted documents; only their frames are decompressed."""
        wanted = set(wanted)
        found: dict[int, list[np.ndarray]] = {}
        at, held = -1, None
        for frame, first, n, null, doc_id in self.index.tolist():
            if not null and doc_id in wanted:
                if frame != at:
                    at, held = frame, self.frame(frame)
                found.setdefault(doc_id, []).append(held[first : first + n])
        return found


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID) -> DataFrame:
    """Writes the ids of ``docs (doc_id, text)`` to files under ``path``; returns the manifest ``(part, path, docs, ids)``.

    Rows go to files in ascending order of doc_id, null ones first, rows of one doc_id by text; files are numbered
    in that order. A null text is empty: its only id is ``end_id``, which closes every document. A file is written
    under a name of its attempt and then renamed, so a task that runs again leaves one whole file. An empty table
    writes no file. The manifest is a written table.
    """
    from pyarrow import fs

    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")

    def run(batches):
        task = TaskContext.get()
        store, base = fs.FileSystem.from_uri(path)
        store.create_dir(base, recursive=True)
        name = f"{base}/{task.partitionId():06d}.ids"
        attempt = f"{name}.{task.taskAttemptId()}"
        writer, out = None, None
        enc = encoder(tokenizer)
        for batch in batches:
            if len(batch) and writer is None:
                out = store.open_output_stream(attempt)
                writer = Writer(out)
            doc_ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            ids, counts = enc.encode(texts)
            end = np.array([end_id], np.uint32)
            at = 0
            for d, n in zip(doc_ids, counts.tolist()):
                writer.add(d, np.concatenate([ids[at : at + n], end]))
                at += n
        if writer is not None:
            writer.close()
            out.close()
            store.move(attempt, name)
            yield pa.RecordBatch.from_pydict(
                {"part": [task.partitionId()], "path": [name], "docs": [len(writer.index)], "ids": [writer.ids]},
                schema=pa.schema([("part", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())]),
            )

    return written(rows.mapInArrow(run, "part int, path string, docs long, ids long"), "token-manifest")[0]


def read_tokens(spark: SparkSession, manifest: DataFrame, base: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32, part`` of every document, read from the files of a manifest."""
    from pyarrow import fs

    files = manifest.count()
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    placed = manifest.withColumn("ahead", F.coalesce(F.sum("ids").over(ahead), F.lit(0))).select("part", "path", "ahead").repartition(max(1, files))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32())])

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                with fs.FileSystem.from_uri(base)[0].open_input_file(row["path"]) as source:
                    at, held = row["ahead"], []
                    for doc_id, ids in Reader(source):
                        held.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes()), row["part"]))
                        at += len(ids)
                        if len(held) >= 20_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                            held = []
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, part int")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Writes token files to the shared folder and returns what ``read_tokens`` reads back."""
    path = new_path(docs.sparkSession, "tokens")
    return read_tokens(docs.sparkSession, write_tokens(docs, tokenizer, path), path)
