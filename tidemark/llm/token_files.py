"""Operator 4, token-id files of patched frame-of-reference blocks.

File layout (little-endian): magic ``TMPF``, u32 version, the blocks, the index (u64 byte offset of each
block), the document table (i64 doc_id, u8 null flag, u64 ids, each as one column), and a tail of u64
documents, u64 ids, u64 blocks, u64 byte offset of the index, magic. A block holds ``BLOCK`` ids (the last
one is padded): u32 minimum, u8 width, u16 exceptions; the ids less the minimum, cut to ``width`` bits and
packed; then the exceptions, u16 place and u32 of the bits above the width. The width is the one that the
``PERCENTILE`` of a block's ids need. ``ids_between`` finds any run of ids by the index and reads its blocks
alone.

Write: there are as many files as ``file_bytes`` of text need. Documents are sorted by range of ``doc_id``,
then of a digest of the text, so that very many rows of one id spread over files; each task encodes its range
and writes one file, whose blocks go out as they fill, under a name of its own, then moves it to the final
name, so that a repeated task replaces its file by an equal one. The manifest (file, documents, ids) is
written as a table; starts of files are running sums over it. Read: files are dealt to tasks by manifest, and
each is decoded some blocks at a time.

A null text is empty (its document has the end id alone); null ids sort first; repeated rows are kept, in the
order of their texts' digests; an empty table gives no file and no row; other columns are left out.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import fresh_path, staged
from tidemark.llm.tokenize import batches, encoder

MAGIC, VERSION, BLOCK, LANES = b"TMPF", 2, 1024, 16
PERCENTILE = 90
_HEAD, _TAIL, _BLOCK_HEAD = struct.Struct("<4sI"), struct.Struct("<QQQQ4s"), struct.Struct("<IBH")
#: Text of a file, about 256 MB; and least text of one, where there are few.
FILE_BYTES, LEAST_BYTES = 1 << 28, 1 << 20


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """(n, BLOCK) integers below 2**width as (n, width, LANES) words of 64 bits; 64 rows of LANES each."""
    n, rows = len(values), BLOCK // LANES
    out = np.zeros((n, width, LANES), dtype="<u8")
    v = values.reshape(n, rows, LANES).astype("<u8")
    for i in range(rows if width else 0):
        word, shift = divmod(i * width, 64)
        out[:, word] |= v[:, i] << np.uint64(shift)
        if shift + width > 64:
            out[:, word + 1] |= v[:, i] >> np.uint64(64 - shift)
    return out


def unpack(words: np.ndarray, width: int) -> np.ndarray:
    n, rows = len(words), BLOCK // LANES
    out = np.zeros((n, rows, LANES), dtype="<u8")
    mask = np.uint64((1 << width) - 1)
    for i in range(rows if width else 0):
        word, shift = divmod(i * width, 64)
        v = words[:, word] >> np.uint64(shift)
        if shift + width > 64:
            v = v | words[:, word + 1] << np.uint64(64 - shift)
        out[:, i] = v & mask
    return out.reshape(n, BLOCK)


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """The blocks of a run of ids; the last is padded with its own last id."""
    if not len(ids):
        return []
    n = -(-len(ids) // BLOCK)
    v = np.full(n * BLOCK, ids[-1], dtype=np.uint32)
    v[: len(ids)] = ids
    v = v.reshape(n, BLOCK)
    least = v.min(axis=1)
    rest = v - least[:, None]
    typical = np.partition(rest, k := BLOCK * PERCENTILE // 100, axis=1)[:, k]
    widths = np.ceil(np.log2(typical.astype(np.float64) + 1)).astype(np.int64)
    out: list[bytes] = [b""] * n
    for width in np.unique(widths).tolist():
        at = np.flatnonzero(widths == width)
        own = rest[at].astype(np.uint64)
        words = pack(own & np.uint64((1 << width) - 1), width)
        above = (own >> np.uint64(width)).astype("<u4")
        for j, i in enumerate(at.tolist()):
            places = np.flatnonzero(above[j])
            out[i] = _BLOCK_HEAD.pack(int(least[i]), width, len(places)) + words[j].tobytes() + places.astype("<u2").tobytes() + above[j][places].tobytes()
    return out


def decode_blocks(data: memoryview, n: int) -> np.ndarray:
    """``n`` blocks that lie one after another in ``data``: all their ids, padding included."""
    heads, by_width, at = [], {}, 0
    for i in range(n):
        least, width, odd = _BLOCK_HEAD.unpack_from(data, at)
        at += _BLOCK_HEAD.size
        by_width.setdefault(width, []).append((i, at))
        at += width * LANES * 8
        heads.append((least, width, odd, at))
        at += 6 * odd
    out = np.zeros((n, BLOCK), dtype=np.uint64)
    for width, own in by_width.items():
        words = np.stack([np.frombuffer(data, "<u8", width * LANES, a).reshape(width, LANES) for _, a in own])
        out[[i for i, _ in own]] = unpack(words, width)
    for i, (least, width, odd, a) in enumerate(heads):
        if odd:
            out[i, np.frombuffer(data, "<u2", odd, a)] |= np.frombuffer(data, "<u4", odd, a + 2 * odd).astype(np.uint64) << np.uint64(width)
        out[i] += np.uint64(least)
    return out.reshape(-1).astype("<u4")


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


class _Writer:
    """One file: blocks go to the store as they fill; only index and document table wait for the end."""

    def __init__(self, uri: str, name: str):
        self.store, self.root = _filesystem(uri)
        self.name, self.out, self.own = name, None, f"{self.root}/.{name}-{uuid.uuid4().hex}"
        self.offsets: list[int] = []
        self.keys: list[int | None] = []
        self.counts: list[int] = []
        self.open = np.zeros(0, dtype=np.uint32)
        self.n_ids = 0

    def add(self, keys: list[int | None], ids: list[np.ndarray]) -> None:
        if self.out is None:
            self.store.create_dir(self.root, recursive=True)
            self.out = self.store.open_output_stream(self.own)
            self.out.write(_HEAD.pack(MAGIC, VERSION))
            self.at = _HEAD.size
        self.keys += keys
        self.counts += map(len, ids)
        run = np.concatenate([self.open, *ids])
        self.n_ids += len(run) - len(self.open)
        whole = len(run) // BLOCK * BLOCK
        self._put(run[:whole])
        self.open = run[whole:]

    def _put(self, run: np.ndarray) -> None:
        for block in encode_blocks(run):
            self.offsets.append(self.at)
            self.out.write(block)
            self.at += len(block)

    def save(self) -> None:
        self._put(self.open)
        keys = np.array([0 if k is None else k for k in self.keys], dtype="<i8")
        none = np.array([k is None for k in self.keys], dtype="u1")
        for part in (np.array(self.offsets, dtype="<u8"), keys, none, np.array(self.counts, dtype="<u8")):
            self.out.write(part.tobytes())
        self.out.write(_TAIL.pack(len(self.keys), self.n_ids, len(self.offsets), self.at, MAGIC))
        self.out.close()
        self.store.move(self.own, f"{self.root}/{self.name}")


def _opened(uri: str):
    """The open file, its numbers of documents, ids and blocks, and the byte offset of its index."""
    store, path = _filesystem(uri)
    f = store.open_input_file(path)
    magic, version = _HEAD.unpack(f.read(_HEAD.size))
    f.seek(f.size() - _TAIL.size)
    n_docs, n_ids, n_blocks, index, end = _TAIL.unpack(f.read(_TAIL.size))
    if (magic, version, end) != (MAGIC, VERSION, MAGIC):
        raise ValueError(f"{uri} is no token file")
    return f, n_docs, n_ids, n_blocks, index


def ids_between(uri: str, first: int, last: int) -> np.ndarray:
    """The ids at the places [first, last) of a file; only the index entries and blocks that hold them are read."""
    f, _, n_ids, n_blocks, index = _opened(uri)
    with f:
        first, last = max(first, 0), min(last, n_ids)
        if first >= last:
            return np.zeros(0, dtype="<u4")
        a, b = first // BLOCK, -(-last // BLOCK)
        f.seek(index + 8 * a)
        offsets = np.frombuffer(f.read(8 * (min(b, n_blocks - 1) - a + 1)), "<u8")
        f.seek(int(offsets[0]))
        data = f.read((index if b == n_blocks else int(offsets[-1])) - int(offsets[0]))
        return decode_blocks(memoryview(data), b - a)[first - a * BLOCK : last - a * BLOCK]


def read_file(uri: str, blocks: int = 4096) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Documents of a file in order: (ids or None of documents, their counts, all their token ids)."""
    f, n_docs, n_ids, n_blocks, index = _opened(uri)
    with f:
        f.seek(index)
        offsets = [*np.frombuffer(f.read(8 * n_blocks), "<u8").tolist(), index]
        keys, none, counts = (np.frombuffer(f.read(size * n_docs), kind) for size, kind in ((8, "<i8"), (1, "u1"), (8, "<u8")))
        ends = np.cumsum(counts.astype(np.int64))
        have, done, left = 0, 0, np.zeros(0, dtype="<u4")
        f.seek(_HEAD.size)
        for i in range(0, n_blocks, blocks):
            n = min(blocks, n_blocks - i)
            ids = decode_blocks(memoryview(f.read(offsets[i + n] - offsets[i])), n)
            left = np.concatenate([left, ids[: n_ids - have]])
            have += len(ids)
            upto = int(np.searchsorted(ends, ends[done - 1] + len(left) if done else len(left), side="right"))
            if upto > done:
                used = int(ends[upto - 1] - (ends[done - 1] if done else 0))
                yield [None if z else int(k) for k, z in zip(keys[done:upto], none[done:upto])], counts[done:upto], left[:used]
                left, done = left[used:], upto


def write_files(docs: DataFrame, tokenizer: str, end_id: int = 2, file_bytes: int = FILE_BYTES, path: str | None = None) -> tuple[str, DataFrame]:
    """Encodes all texts into files in ascending ``doc_id``; returns their folder and the manifest.

    The manifest has file, n_docs, n_ids. Of little text there are as many files as shuffle partitions.
    """
    spark = docs.sparkSession
    path = path or fresh_path(spark, "tokens")
    text = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(1, -(-text // file_bytes), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-text // min(LEAST_BYTES, file_bytes))))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", F.xxhash64("text"))
    # equal rows are interchangeable, so their place in the input may part them
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(files, "doc_id", "digest", "row").sortWithinPartitions("doc_id", "digest", "row").select("doc_id", "text")

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name = f"part-{TaskContext.get().partitionId():06d}.tmpf"
        lib, writer = encoder(tokenizer), _Writer(path, name)
        end = np.array([end_id], dtype="<u4").tobytes()
        for part in parts:
            keys, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
            for a, b in batches(texts):
                writer.add(keys[a:b], [np.frombuffer(x + end, "<u4") for x in lib.encode(texts[a:b])])
        if writer.keys:
            writer.save()
            yield pa.RecordBatch.from_pydict({"file": [name], "n_docs": [len(writer.keys)], "n_ids": [writer.n_ids]})

    return path, staged(rows.mapInArrow(write, "file string, n_docs long, n_ids long"), "tokens-manifest")


def read_files(path: str, manifest: DataFrame) -> DataFrame:
    """The documents of the files with their ids: doc_id, start, n_tokens, ids (binary, u32)."""
    before = F.sum("n_ids").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1))
    files = manifest.withColumn("before", F.coalesce(before, F.lit(0)))
    n = max(1, min(manifest.count(), 100_000))

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for name, start in zip(part.column("file").to_pylist(), part.column("before").to_pylist()):
                for keys, counts, ids in read_file(f"{path}/{name}"):
                    ends = np.cumsum(counts.astype(np.int64))
                    starts = ends - counts.astype(np.int64)
                    raw = ids.tobytes()
                    for a in range(0, len(keys), 500):
                        cut = slice(a, a + 500)
                        own = [raw[4 * x : 4 * y] for x, y in zip(starts[cut].tolist(), ends[cut].tolist())]
                        yield pa.RecordBatch.from_pydict({"doc_id": pa.array(keys[cut], pa.int64()), "start": starts[cut] + start, "n_tokens": counts[cut].astype(np.int64), "ids": pa.array(own, pa.binary())})
                    start += len(ids)

    return files.repartition(n, "file").mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def digests(read: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids' bytes (Spark's crc32 is unsigned)."""
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
