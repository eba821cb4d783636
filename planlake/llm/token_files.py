"""Token ids as binary files: one concatenated array of ids, with document boundaries in Elias-Fano form.

A folder holds shards, and a table ``manifest`` with one row per shard. A shard is a pair of files: ``*.ids``, the ids of its
documents one after the other as little-endian integers of 2 or 4 bytes, and ``*.idx``, two rising sequences in
Elias-Fano form: where the documents begin in the shard, and the documents' numbers. Such a sequence of n values up to u takes
about 2 + log2(u / n) bits a value. The value with number i is found by select: the place of the i-th one in the upper
bits, by a directory with one 32-bit count for each 512 bits, and then the lower bits. No offset is stored as a 64-bit number.

Shards hold ranges of ids in ascending order, so the manifest's counts give each shard's place in the whole array.
A shard's files have a name of their own for each attempt of its task, and the manifest is written by Spark: it names
the files of the attempts that count, so lost executors and repeated attempts leave at most unused files.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planlake.llm.segments import byte_coder, slices

END_ID = 0
BLOCK_BITS = 512
READ_IDS = 1 << 20
CHUNK = 1 << 16
#: ones in a byte, and the place of its k-th one
ONES = np.array([bin(b).count("1") for b in range(256)], dtype=np.uint8)
PLACE = np.array([[p for p in range(8) if b >> p & 1] + [8] * (8 - bin(b).count("1")) for b in range(256)], dtype=np.uint8)


class EliasFano:
    """A rising sequence of whole numbers from 0 on; values may repeat."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        blocks = np.pad(high, (0, -len(high) % (BLOCK_BITS // 8))).reshape(-1, BLOCK_BITS // 8)
        self.blocks = blocks
        self.before = np.cumsum(ONES[blocks].sum(1, dtype=np.uint32), dtype=np.uint32)  # the directory: ones up to each block's end

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, ((top + 1) // n).bit_length() - 1) if n else 0
        low = np.zeros((n, bits), dtype=np.uint8)
        for k in range(bits):
            low[:, k] = values >> k & 1
        high = np.zeros(n + (top >> bits) + 1 if n else 0, dtype=np.uint8)
        high[(values >> bits) + np.arange(n)] = 1
        return cls(n, bits, np.packbits(low.ravel(), bitorder="little"), np.packbits(high, bitorder="little"))

    def select(self, i: np.ndarray) -> np.ndarray:
        """Where the ones with the numbers ``i`` stand in the upper bits."""
        block = np.searchsorted(self.before, i, side="right")
        rest = i - np.where(block > 0, self.before[np.maximum(block, 1) - 1], 0)
        row = self.blocks[block]
        upto = np.cumsum(ONES[row], axis=1, dtype=np.int64)
        byte = (upto <= rest[:, None]).sum(1)
        at = np.arange(len(i))
        rest = rest - np.where(byte > 0, upto[at, np.maximum(byte, 1) - 1], 0)
        return block * BLOCK_BITS + byte * 8 + PLACE[row[at, byte], rest]

    def values(self, i: np.ndarray) -> np.ndarray:
        """The values with the numbers ``i`` (0 to n - 1)."""
        i = np.asarray(i, dtype=np.int64)
        out = (self.select(i) - i) << self.low_bits
        for k in range(self.low_bits):
            bit = i * self.low_bits + k
            out |= (self.low[bit >> 3] >> (bit & 7) & 1).astype(np.int64) << k
        return out

    def rank(self, value: int) -> int:
        """How many values are at most ``value``, by halving over select."""
        lo, hi = 0, self.n
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if int(self.values(np.array([mid]))[0]) <= value else (lo, mid)
        return lo

    def dumps(self) -> bytes:
        return np.array([self.n, self.low_bits, len(self.low), len(self.high)], dtype="<u8").tobytes() + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def loads(cls, data: bytes, at: int = 0) -> tuple[EliasFano, int]:
        """The sequence that begins at a place of ``data``, and the place after it."""
        n, bits, low, high = (int(x) for x in np.frombuffer(data, dtype="<u8", count=4, offset=at))
        a = np.frombuffer(data, dtype=np.uint8, count=low + high, offset=at + 32)
        return cls(n, bits, a[:low], a[low:]), at + 32 + low + high


class Shard:
    """One shard for reading; ``folder`` may be any path or URI that pyarrow's file systems know."""

    def __init__(self, folder: str, name: str):
        self.system, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        with self.system.open_input_stream(f"{root}/{name}.idx") as f:
            data = f.read()
        size = int.from_bytes(data[:4], "little")
        head = json.loads(data[4 : 4 + size])
        self.dtype, self.nulls, self.first = np.dtype(head["dtype"]), head["nulls"], head["first"]
        self.starts, at = EliasFano.loads(data, 4 + size)
        self.numbers, _ = EliasFano.loads(data, at)
        self.n, self.path = self.starts.n - 1, f"{root}/{name}.ids"

    def bounds(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the documents with the places ``i`` begin and end in the shard."""
        return self.starts.values(i), self.starts.values(np.asarray(i) + 1)

    def doc_ids(self, i: np.ndarray) -> np.ma.MaskedArray:
        """The documents' ids; documents without one come first."""
        none = np.asarray(i) < self.nulls
        return np.ma.array(self.numbers.values(np.where(none, 0, i - self.nulls)) + self.first if self.numbers.n else np.zeros(len(i), np.int64), mask=none)

    def document_at(self, place: int) -> int:
        """The place in the shard of the document that the id number ``place`` of the shard belongs to."""
        return self.starts.rank(place) - 1

    def ids(self, start: int, end: int) -> np.ndarray:
        with self.system.open_input_file(self.path) as f:
            return np.frombuffer(f.read_at((end - start) * self.dtype.itemsize, start * self.dtype.itemsize), dtype=self.dtype)


def write(docs: DataFrame, folder: str, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write all texts' ids (by the tokenizer file at ``path``, each document with END_ID after it) in ascending order of the document ids.

    Documents without an id come first; rows that share an id all stay, in the order in which the table gives them. Null text counts as
    empty: END_ID alone. Other columns are ignored. An empty table gives an empty manifest. The folder must be one that all
    executors share.
    """
    schema = "shard int, name string, n_docs long, n_ids long, index_bytes long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, out = None, None
        lens, numbers, nulls = [], [], 0
        for batch, texts in slices(batches, 1):
            if out is None:
                c = byte_coder(path)
                dtype = "<u2" if len(c.kind.bytes_of) <= 1 << 16 else "<u4"
                system, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
                system.create_dir(root, recursive=True)
                name = f"part-{TaskContext.get().partitionId():07d}-{uuid4().hex[:12]}"
                out = system.open_output_stream(f"{root}/{name}.ids")
            at, codes = c.slice_codes(texts)
            ends = np.concatenate([[0], np.cumsum(c.size[codes])])[at[1:]]
            out.write(np.insert(c.rows(codes), ends, END_ID).astype(dtype).tobytes())
            lens.append(np.diff(ends, prepend=0) + 1)
            ids = batch.column(0)
            nulls += ids.null_count
            numbers.append(np.asarray(ids.drop_null()).astype(np.int64))
        if out is None:
            return
        out.close()
        starts = np.concatenate([[0], np.cumsum(np.concatenate(lens))])
        numbers = np.concatenate(numbers)
        first = int(numbers[0]) if len(numbers) else 0
        head = json.dumps({"dtype": dtype, "nulls": nulls, "first": first}).encode()
        data = len(head).to_bytes(4, "little") + head + EliasFano.of(starts).dumps() + EliasFano.of(numbers - first).dumps()
        with system.open_output_stream(f"{root}/{name}.idx") as f:
            f.write(data)
        row = (TaskContext.get().partitionId(), name, len(starts) - 1, int(starts[-1]), len(data))
        yield pa.RecordBatch.from_pylist([dict(zip(("shard", "name", "n_docs", "n_ids", "index_bytes"), row, strict=True))], schema=pa.schema([("shard", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("index_bytes", pa.int64())]))

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("place"))
    # Ranges by id and place, so that rows which share an id are no single task's.
    rows = rows.repartitionByRange("id", "place").sortWithinPartitions("id", "place").select("id", "text")
    rows.mapInArrow(run, schema).write.parquet(f"{folder}/manifest")


def read(spark: SparkSession, folder: str, id_col: str = "doc_id") -> DataFrame:
    """One row per document of the files: id, start (ids of all documents before it), n_tokens, ids_crc32 (of its ids as
    little-endian unsigned 32-bit integers), shard.

    Documents are read in runs of about READ_IDS ids, a longer one in pieces; a shard's index is held whole.
    """
    manifest = spark.read.parquet(f"{folder}/manifest")
    shards = max(1, manifest.count())
    # One narrow row per shard.
    placed = manifest.withColumn("base", F.sum("n_ids").over(Window.orderBy("shard")) - F.col("n_ids")).select("shard", "name", "base")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(folder, row["name"])
                for lo in range(0, shard.n, CHUNK):
                    i = np.arange(lo, min(lo + CHUNK, shard.n))
                    start, end = shard.bounds(i)
                    crc = np.zeros(len(i), dtype=np.int64)
                    k = 0
                    while k < len(i):
                        j = max(k + 1, int(np.searchsorted(end, start[k] + READ_IDS, side="right")))
                        if j == k + 1:
                            for a in range(int(start[k]), int(end[k]), READ_IDS):
                                crc[k] = zlib.crc32(shard.ids(a, min(a + READ_IDS, int(end[k]))).astype("<u4").tobytes(), int(crc[k]))
                        else:
                            raw = memoryview(shard.ids(int(start[k]), int(end[j - 1])).astype("<u4")).cast("B")
                            cuts = (4 * (np.append(start[k:j], end[j - 1]) - start[k])).tolist()
                            crc[k:j] = [zlib.crc32(raw[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                        k = j
                    ids = shard.doc_ids(i)
                    cols = [pa.array(ids.data, mask=np.ma.getmaskarray(ids)), pa.array(start + row["base"]), pa.array(end - start), pa.array(crc), pa.array(np.full(len(i), row["shard"], np.int32))]
                    yield pa.record_batch(cols, names=names)

    names = [id_col, "start", "n_tokens", "ids_crc32", "shard"]
    return placed.repartitionByRange(shards, "shard").mapInArrow(run, f"{id_col} long, start long, n_tokens long, ids_crc32 long, shard int")
