"""Token-id files of directly addressable codes.

Ids are split into chunks of ``bits`` bits, least significant first. Level 0 holds
each id's first chunk, level k the (k+1)th chunk of the ids that reach so far. Each
level has a bitmap that says which of its ids go on, and a rank directory (ones
before every block of 512 bits), so the place of an id on the next level is a
directory entry plus the ones in part of a block: any id is read without decoding
others.

File, little-endian: ``DAC1``, uint32 n_levels, uint32 bits, uint64 n_docs, uint64
n_tokens, int64 doc ids (null as -2**63 with flag), uint8 null flags, uint64 document
starts (n_docs + 1), then for each level uint64 n, n chunks of uint8, the bitmap of
ceil(n / 8) bytes (bit i of byte i // 8, least first) and uint64 ones before each block.

Documents lie in ascending doc_id (nulls first; rows with the same id ordered by the
hash of their text). A null text is an empty one: just the end id. An empty table
gives no files and no rows.
"""

from __future__ import annotations

import io
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWEST, bucket_of, longs, new_folder, partitions, range_bounds, release, slices, text_batches, written
from .tokens import encoder

BLOCK = 512


class DacArray:
    """Directly addressable codes of unsigned ids."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]], bits: int = 8):
        self.levels, self.bits = levels, bits

    @classmethod
    def build(cls, ids: np.ndarray, bits: int = 8) -> DacArray:
        if not 1 <= bits <= 8:
            raise ValueError("bits must be from 1 to 8")
        levels, rest = [], ids
        while True:
            chunk = (rest & rest.dtype.type((1 << bits) - 1)).astype(np.uint8)
            rest = rest >> rest.dtype.type(bits)
            more = rest > 0
            bitmap = np.packbits(more, bitorder="little")
            words = np.concatenate([bitmap, np.zeros(-len(bitmap) % (BLOCK // 8), np.uint8)]).view(np.uint64)
            ones = np.bitwise_count(words).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.uint64)
            levels.append((chunk, bitmap, np.cumsum(ones, dtype=np.uint64) - ones))
            rest = rest[more]
            if not len(rest):
                return cls(levels, bits)

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def _rank(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones before each position: the directory's entry and the bytes since, at most 64."""
        _, bitmap, directory = self.levels[level]
        block = at // BLOCK
        ones = directory[block].astype(np.int64)
        span = bitmap[np.minimum((block * (BLOCK // 8))[:, None] + np.arange(BLOCK // 8), len(bitmap) - 1)]
        bits = np.unpackbits(span, axis=1, bitorder="little")
        return ones + np.where(np.arange(BLOCK) < (at % BLOCK)[:, None], bits, 0).sum(axis=1, dtype=np.int64)

    def access(self, at) -> np.ndarray:
        """The ids at some positions, each found by itself."""
        at = np.atleast_1d(np.asarray(at, np.int64))
        if len(at) and (at.min() < 0 or at.max() >= len(self)):
            raise IndexError("no such token")
        out, who, level = np.zeros(len(at), np.uint32), np.arange(len(at)), 0
        while len(at):
            chunk, bitmap, _ = self.levels[level]
            out[who] |= chunk[at].astype(np.uint32) << np.uint32(level * self.bits)
            more = (bitmap[at // 8] >> (at % 8).astype(np.uint8)) & 1 == 1
            at, who = at[more], who[more]
            if len(at):
                at = self._rank(level, at)
            level += 1
        return out

    def slice(self, start: int, end: int) -> np.ndarray:
        """The ids from start to end: a level's part begins at the rank of its first id."""
        out, who, level = np.zeros(end - start, np.uint32), slice(None), 0
        while end > start:
            chunk, bitmap, _ = self.levels[level]
            out[who] |= chunk[start:end].astype(np.uint32) << np.uint32(level * self.bits)
            first = start // 8
            more = np.flatnonzero(np.unpackbits(bitmap[first : (end + 7) // 8], bitorder="little")[start - first * 8 : end - first * 8])
            if not len(more):
                break
            who = more if level == 0 else who[more]
            start = int(self._rank(level, np.array([start]))[0])
            end, level = start + len(more), level + 1
        return out

    def write(self, f) -> None:
        for chunk, bitmap, directory in self.levels:
            f.write(np.uint64(len(chunk)).tobytes())
            for part in (chunk, bitmap, directory):
                f.write(part.tobytes())

    @classmethod
    def read(cls, raw: memoryview, n_levels: int, bits: int) -> DacArray:
        levels, at = [], 0
        for _ in range(n_levels):
            n = int(np.frombuffer(raw, "<u8", 1, at)[0])
            at += 8
            parts = []
            for kind, count in (("u1", n), ("u1", (n + 7) // 8), ("<u8", -(-n // BLOCK))):
                parts.append(np.frombuffer(raw, kind, count, at))
                at += parts[-1].nbytes
            levels.append(tuple(parts))
        return cls(levels, bits)


def dump(doc_ids: list[int | None], ids: list[np.ndarray], bits: int = 8) -> bytes:
    """One file's bytes."""
    every = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    codes = DacArray.build(every, bits)
    f = io.BytesIO()
    f.write(b"DAC1" + np.array([len(codes.levels), bits], "<u4").tobytes() + np.array([len(doc_ids), len(every)], "<u8").tobytes())
    f.write(np.array([LOWEST if d is None else d for d in doc_ids], "<i8").tobytes())
    f.write(np.array([d is None for d in doc_ids], "u1").tobytes())
    f.write(np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype("<u8").tobytes())
    codes.write(f)
    return f.getvalue()


def load(raw: bytes) -> tuple[list[int | None], np.ndarray, DacArray]:
    """Document ids, starts (one more than documents) and codes of a file's bytes."""
    if raw[:4] != b"DAC1":
        raise ValueError("not a token file")
    view = memoryview(raw)
    n_levels, bits = np.frombuffer(view, "<u4", 2, 4).tolist()
    n_docs, n_tokens = np.frombuffer(view, "<u8", 2, 12).tolist()
    at = 28
    ids = np.frombuffer(view, "<i8", n_docs, at).tolist()
    null = np.frombuffer(view, "u1", n_docs, at + 8 * n_docs).tolist()
    at += 9 * n_docs
    starts = np.frombuffer(view, "<u8", n_docs + 1, at).astype(np.int64)
    codes = DacArray.read(view[at + 8 * (n_docs + 1) :], n_levels, bits)
    if len(codes) != n_tokens or starts[-1] != n_tokens:
        raise ValueError("the token file is damaged")
    return [None if z else d for d, z in zip(ids, null)], starts, codes


def write_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, bits: int = 8, file_tokens: int = 1 << 24, folder: str | None = None) -> DataFrame:
    """Encodes whole texts, appends ``end_id`` and writes token files in ascending id order.
    Returns the manifest (bucket, seq, path, n_docs, n_tokens), a written table. Only files
    of tasks that ended well are in it, so a lost executor leaves at most orphans."""
    spark = docs.sparkSession
    text_batches(spark)
    folder = folder or new_folder(spark, "tokens")
    dtype = encoder(tokenizer).dtype
    bounds = range_bounds(docs, id_col, 2 * partitions(spark))
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("tie"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def encode(batches):
        enc = encoder(tokenizer)
        end = np.array([end_id], enc.dtype).tobytes()
        for b in slices(batches):
            key, tie = longs(b["id"]), longs(b["tie"])
            ids = [x + end for x in enc.encode(b["text"].to_pylist())]
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(bucket_of(bounds, key, tie)), b["tie"], pa.array(ids, pa.binary())], ["id", "bucket", "tie", "ids"])

    def write(batches):
        release()
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        kept: dict = {"bucket": None, "seq": 0, "docs": [], "ids": [], "n": 0}

        def flush():
            path = f"{root}/{kept['bucket']:08d}-{kept['seq']:04d}-{uuid.uuid4().hex}.dac"
            with fs.open_output_stream(path) as f:
                f.write(dump(kept["docs"], kept["ids"], bits))
            row = [kept["bucket"], kept["seq"], path, len(kept["docs"]), kept["n"]]
            kept.update(seq=kept["seq"] + 1, docs=[], ids=[], n=0)
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()))], ["bucket", "seq", "path", "n_docs", "n_tokens"])

        for b in slices(batches, 4096):
            for bucket, doc, raw in zip(b["bucket"].to_pylist(), b["id"].to_pylist(), b["ids"]):
                if kept["docs"] and (bucket != kept["bucket"] or kept["n"] >= file_tokens):
                    yield flush()
                if bucket != kept["bucket"]:
                    kept.update(bucket=bucket, seq=0)
                kept["docs"].append(doc)
                kept["ids"].append(np.frombuffer(raw.as_py(), dtype))
                kept["n"] += len(kept["ids"][-1])
        if kept["docs"]:
            yield flush()

    rows = src.mapInArrow(encode, "id long, bucket int, tie long, ids binary").repartitionById(len(bounds) + 1, "bucket").sortWithinPartitions("bucket", F.asc_nulls_first("id"), "tie")
    return written(rows.mapInArrow(write, "bucket int, seq int, path string, n_docs long, n_tokens long"), "token-manifest")


def read_tokens(manifest: DataFrame, folder_of: str, digest: bool = False) -> DataFrame:
    """Reads the manifest's files back: doc_id, start (ids of all documents before it), n_tokens
    and ids (little-endian uint32), or in place of ids their crc32, ids_crc32."""
    spark = manifest.sparkSession
    before = F.sum("n_tokens").over(Window.orderBy("bucket", "seq").rowsBetween(Window.unboundedPreceding, -1))  # a row for each file
    files = manifest.select("path", F.coalesce(before, F.lit(0)).alias("base")).repartition(partitions(spark), "path")

    def read(batches):
        release()
        fs, _ = pafs.FileSystem.from_uri(folder_of)
        for b in batches:
            for path, base in zip(b["path"].to_pylist(), b["base"].to_pylist()):
                with fs.open_input_file(path) as f:
                    docs, starts, codes = load(f.read())
                for at in range(0, len(docs), 512):
                    end = min(at + 512, len(docs))
                    ids = codes.slice(int(starts[at]), int(starts[end]))
                    cut = (starts[at : end + 1] - starts[at]).tolist()
                    raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
                    parts = [raw[4 * i : 4 * j] for i, j in zip(cut, cut[1:])]
                    last = pa.array(list(map(zlib.crc32, parts)), pa.int64()) if digest else pa.array(list(map(bytes, parts)), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(docs[at:end], pa.int64()), pa.array(starts[at:end] + base), pa.array(np.diff(starts[at : end + 1])), last], ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])

    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digest else "ids binary"))


def token_at(manifest: DataFrame, folder_of: str, positions: list[int]) -> dict[int, int]:
    """Random access by global position, on the driver: opens only the files that hold them."""
    files = manifest.orderBy("bucket", "seq").select("path", "n_tokens").toLocalIterator()
    fs, _ = pafs.FileSystem.from_uri(folder_of)
    want, base, out = sorted(positions), 0, {}
    for row in files:
        here = [p for p in want if base <= p < base + row.n_tokens]
        if here:
            with fs.open_input_file(row.path) as f:
                _, _, codes = load(f.read())
            out |= dict(zip(here, codes.access(np.array(here) - base).tolist()))
        base += row.n_tokens
    return out


def dac_round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """op2: writes token files of all documents and reads their digests back."""
    folder = new_folder(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, tokenizer, folder=folder), folder, digest=True)
