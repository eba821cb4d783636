"""Packing by power-of-two decomposition.

A document of n ids is cut into pieces of 2048 ids and then of the powers of two in the rest, longest
first. Each piece is a sequence of its own in the bucket of its length, so batches taken from one
bucket have equal lengths, nothing is padded and no sequence crosses documents. A task gives its pieces bucket by bucket
within each slice of texts; ``write_buckets`` lays the whole result out by bucket.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planlake.llm.segments import SLICE_BYTES, byte_coder, give_back, slices

MAX_LENGTH = 2048
END_ID = 1
#: Bytes of text that are packed at once without the cache: ids and their places take many times as much.
SMALL_SLICE = 1 << 20


def pieces_of(n: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For document lengths n: each piece's document number, start and length."""
    bits = 1 << np.arange(longest.bit_length() - 2, -1, -1)
    have = np.concatenate([(n // longest)[:, None], (n[:, None] & bits) > 0], axis=1)
    doc = np.repeat(np.arange(len(n)), have.sum(1))
    kinds = np.broadcast_to(np.concatenate([[longest], bits]), have.shape)
    length = np.repeat(kinds.ravel(), have.ravel())
    end = np.cumsum(length)
    before = np.cumsum(n) - n
    return doc, end - length - before[doc], length


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", longest: int = MAX_LENGTH, with_ids: bool = True, keep_cache: bool = True) -> DataFrame:
    """One row per piece: id, start, length, doc_tokens, ids_crc32, sequence_id, offset, and ids array<int> if asked for.

    A document's ids are its tokens and END_ID, so null and empty texts have one id. Each id is in one
    piece. ``length`` names the bucket. Documents with the same id (repeated rows, mixes) are packed one by
    one. sequence_id is unique over the result; offset is always 0. Null ids stay null; other columns are ignored.
    Without ``keep_cache`` a task leaves no encoded words in its worker for the next one and takes smaller slices of text: less memory, more encoding.
    """
    if longest & (longest - 1) or longest < 2:
        raise ValueError("longest must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keep_cache:
            give_back()  # what earlier operators have left in this worker
        c = byte_coder(path)
        for batch, texts in slices(batches, 1, SLICE_BYTES if keep_cache else SMALL_SLICE):
            at, codes = c.slice_codes(texts)
            ids = c.rows(codes)
            ends = np.concatenate([[0], np.cumsum(c.size[codes])])[at[1:]]
            ids = np.insert(ids, ends, END_ID).astype("<u4")
            ends = ends + np.arange(1, len(ends) + 1)
            n = np.diff(ends, prepend=0)
            doc, start, length = pieces_of(n, longest)
            to = np.cumsum(length)
            raw = memoryview(ids).cast("B")
            crc = np.fromiter((zlib.crc32(raw[4 * (b - k) : 4 * b]) for b, k in zip(to.tolist(), length.tolist(), strict=True)), dtype=np.int64, count=len(to))
            by = np.argsort(-length, kind="stable")
            doc, start, length, first, crc = doc[by], start[by], length[by], (to - length)[by], crc[by]
            cols = [batch.column(0).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(n[doc]), pa.array(crc)]
            if with_ids:
                stop = np.cumsum(length)
                kind = np.int32 if len(ids) < 1 << 31 else np.int64
                moved = ids[np.repeat((first - (stop - length)).astype(kind), length) + np.arange(len(ids), dtype=kind)]
                cols.append(pa.ListArray.from_arrays(np.concatenate([[0], stop]).astype(np.int32), moved.view(np.int32)))
            out = pa.record_batch(cols, names=names)
            batch = texts = at = codes = ids = ends = raw = crc = cols = moved = None  # not held beside the next slice's
            yield out
            out = None
        if not keep_cache:
            c.forget()
            give_back()

    names = [id_col, "start", "length", "doc_tokens", "ids_crc32", *["ids"] * with_ids]
    schema = f"{id_col} long, start long, length long, doc_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col)).mapInArrow(run, schema)
    return rows.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})


def write_buckets(packed: DataFrame, path: str) -> None:
    """Write pieces with one folder per length, in the order of sequence_id: what a reader of one bucket takes in has equal lengths."""
    packed.sortWithinPartitions("length", "sequence_id").write.partitionBy("length").parquet(path)
