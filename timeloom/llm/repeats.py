"""Exchange of keys that tells each document which of its keys other documents have.

A key per window of every document is more than a shuffle of rows can carry,
so tasks exchange packed blocks:

1. Documents are taken in chunks of some megabytes.  Keys that several
   documents of a chunk have are decided there; of such a key only one entry
   (or two: the smallest and the largest id) goes on.  A passage that a third
   of all documents share thus costs its bucket an entry per chunk, not one
   per document.
2. The other keys are dealt by hash: for each chunk and bucket one block.
   What is decided already travels in blocks of its own, dealt by document.
3. A bucket's task decides its entries and answers with a record each (a key,
   a position), packed by groups of documents.
4. The answers of a group of documents are put together to a row per
   document, which its text is joined with.

Documents are told apart by id and a checksum of the text.  Ids are integers;
null ids count as one id, larger than all others; equal ids are never smaller
than one another.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from timeloom.llm.arrow import chunks
from timeloom.llm.text import buckets_for

#: Stands for a null id: no id is larger.
NULL_ID = (1 << 63) - 1
#: Text bytes and number of the documents compared at once and packed together.
PACK_BYTES = 4 << 20
PACK_DOCS = 1 << 12
#: Input bytes (as Catalyst estimates them) of a bucket of keys.
BUCKET_BYTES = 16 << 20

_LOW = np.uint64((1 << 32) - 1)


def keyed(docs: DataFrame, doc_id: str, text: str) -> list[Column]:
    """__id (no nulls) and __rk (a checksum of the text)."""
    if not isinstance(docs.schema[doc_id].dataType, IntegralType):
        raise ValueError(f"ids are compared as integers; {doc_id} is {docs.schema[doc_id].dataType.simpleString()}")
    return [F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)).alias("__id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("__rk")]


def packed_docs(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with __body, the compressed text, in place of the text.

    Shuffled as it is, a text would take twice the disk.
    """
    at = rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=6)
        for chunk in chunks(batches, text):
            body = [None if t is None else pack.compress(t) for t in chunk.column(at).cast(pa.binary()).to_pylist()]
            columns = [c for i, c in enumerate(chunk.columns) if i != at]
            names = [n for i, n in enumerate(chunk.schema.names) if i != at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(body, pa.binary())], names=[*names, "__body"])

    return rows.mapInArrow(run, rows.drop(text).schema.add("__body", "binary"))


def unpacked(body: bytes | None) -> bytes:
    return b"" if body is None else zstandard.ZstdDecompressor().decompress(body)


class Chunk:
    """Documents that are worked on at once, in order of their ids."""

    def __init__(self, rows: list[tuple]):
        rows.sort(key=lambda r: r[:2])
        self.ids, self.rks = (np.array([r[i] for r in rows], np.int64) for i in (0, 1))
        self.bodies: list[bytes] = [r[2] for r in rows]
        self.found: list[bytes] = [r[3] for r in rows]


def doc_chunks(batches: Iterator[pa.RecordBatch], body: str, most: int = PACK_BYTES) -> Iterator[Chunk]:
    """Chunks of rows (__id, __rk, body[, found]); __body is unpacked."""
    rows: list[tuple] = []
    total = 0
    for batch in batches:
        found = batch.column("found") if "found" in batch.schema.names else [None] * batch.num_rows
        for i, k, b, f in zip(batch.column("__id"), batch.column("__rk"), batch.column(body), found, strict=True):
            text = unpacked(b.as_py()) if body == "__body" else (b.as_buffer() or b"")
            rows.append((i.as_py(), k.as_py(), bytes(text), f and f.as_py()))
            total += len(rows[-1][2])
            if total >= most or len(rows) == PACK_DOCS:
                yield Chunk(rows)
                rows, total = [], 0
    if rows:
        yield Chunk(rows)


def dealt(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and a 32-bit rest of each hash; both in order of the hashes, so that ordered hashes stay ordered.

    The rest takes up where the bucket ends: how often different hashes of a
    bucket share it depends on the bucket's size, not on the input's.
    """
    n = np.uint64(buckets)
    both = (hashes >> np.uint64(32)) * n + ((((hashes & _LOW) >> np.uint64(12)) * n) >> np.uint64(20))
    return (both >> np.uint64(32)).astype(np.int64), (both & _LOW).astype(np.uint32)


def runs(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    if n:
        new[0] = True
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def squeezed(*columns: np.ndarray) -> bytes:
    """Integers with their length in front: compressed by the planes of their bytes, so that high zeros vanish."""
    planes = b"".join(x.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes() for x in columns)
    data = zstandard.ZstdCompressor(level=1).compress(planes)
    return np.array([len(data), *(len(x) for x in columns)], np.int64).tobytes() + data


def stretched(block: bytes, columns: int) -> tuple[list[np.ndarray], int]:
    """The columns of ``squeezed`` at the start of a block, and where they end."""
    size, *lengths = np.frombuffer(block, np.int64, 1 + columns).tolist()
    end = 8 * (1 + columns) + size
    planes, out, at = np.frombuffer(zstandard.ZstdDecompressor().decompress(block[8 * (1 + columns) : end]), np.uint8), [], 0
    for n in lengths:
        out.append(np.ascontiguousarray(planes[at : at + 8 * n].reshape(8, n).T).view("<i8").reshape(-1))
        at += 8 * n
    return out, end


def steps(ids: np.ndarray) -> np.ndarray:
    """Differences of ids in order, which are smaller than the ids; ``np.cumsum`` takes them back."""
    return np.diff(ids, prepend=0)


def packed_answers(ids: np.ndarray, rks: np.ndarray, records: np.ndarray, groups: int) -> Iterator[tuple[int, bytes]]:
    """Answers (a record per entry) packed by group of documents."""
    to = (((ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ rks.view(np.uint64)) >> np.uint64(17)) % np.uint64(groups)).astype(np.int64)
    order = np.lexsort((rks, ids, to))
    to, ids, rks, records = to[order], ids[order], rks[order], records[order]
    first = runs(to, ids, rks)
    sizes = np.diff(np.append(first, len(ids))).astype(np.int64)
    cuts = runs(to[first])
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(first)], strict=True):
        at, end = int(first[a]), int(first[b]) if b < len(first) else len(ids)
        part = first[a:b]
        yield int(to[at]), squeezed(steps(ids[part]), sizes[a:b]) + rks[part].tobytes() + records[at:end].tobytes()


def asked(
    chunk: Chunk, doc: np.ndarray, bucket: np.ndarray, keys: np.ndarray, records: np.ndarray | None, *, smaller: bool, groups: int
) -> Iterator[tuple[int, bytes]]:
    """Blocks (bucket, bytes) of the entries of a chunk, which come in order of bucket and key.

    An answer to an entry is its record, or its key if there are no records.
    Entries that the chunk decides go to the negative buckets, by group of documents.
    """
    if not len(doc):
        return
    ids = chunk.ids[doc]
    first = runs(bucket, keys)
    sizes = np.diff(np.append(first, len(doc)))
    least = np.repeat(np.minimum.reduceat(ids, first), sizes)
    if smaller:
        known, send = ids > least, ids == least
    else:
        most = np.repeat(np.maximum.reduceat(ids, first), sizes)
        known = least != most
        # of a key that the chunk shares, one entry with the smallest id and one with the largest
        send = ~known
        send[_firsts(ids == least, first, sizes)] = send[_firsts(ids == most, first, sizes)] = True
    said = keys if records is None else records
    if known.any():
        for to, block in packed_answers(ids[known], chunk.rks[doc[known]], said[known], groups):
            yield -1 - to, block
    at = np.flatnonzero(send)
    at = at[np.argsort(bucket[at] * PACK_DOCS + doc[at], kind="stable")]
    cuts = runs(bucket[at])
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(at)], strict=True):
        part = at[a:b]
        starts = runs(doc[part])
        docs_here = doc[part[starts]]
        counts = np.diff(np.append(starts, len(part)))
        head = squeezed(steps(chunk.ids[docs_here]), counts, part[:0] if records is None else records[part])
        yield int(bucket[part[0]]), head + chunk.rks[docs_here].tobytes() + keys[part].tobytes()


def _firsts(flags: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The first flagged entry of each run; every run has one."""
    at = np.flatnonzero(flags)
    run = np.repeat(np.arange(len(first)), sizes)[at]
    return at[runs(run)]


def decided(blocks: list[bytes], key_type: np.dtype, record_type: np.dtype | None, smaller: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """id, checksum and record of the entries of a bucket that another document (``smaller``: one with a smaller id) has."""
    parts: tuple[list[np.ndarray], ...] = ([], [], [], [])
    for block in blocks:
        (own, counts, record), at = stretched(block, 3)
        checks = np.frombuffer(block, np.int64, len(own), at)
        key = np.frombuffer(block, key_type, -1, at + checks.nbytes)
        for out, x in zip(parts, (np.repeat(np.cumsum(own), counts), np.repeat(checks, counts), key, record.astype(record_type or np.int64)), strict=True):
            out.append(x)
    ids, rks, keys, records = (np.concatenate(x) for x in parts)
    order = np.argsort(keys, kind="stable") if key_type.names is None else np.lexsort([keys[n] for n in reversed(key_type.names)])
    own = ids[order]
    first = runs(keys[order])
    sizes = np.diff(np.append(first, len(order)))
    least = np.repeat(np.minimum.reduceat(own, first), sizes)
    hit = order[own > least if smaller else np.repeat(np.maximum.reduceat(own, first), sizes) != least]
    return ids[hit], rks[hit], (keys if record_type is None else records)[hit]


def exchange(sent: DataFrame, decide: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray, np.ndarray]], record_type: np.dtype, buckets: int, groups: int | None = None) -> DataFrame:
    """(__id, __rk, found) from (bucket, block) rows: ``decide`` gives the answers of a bucket, which are put together by document.

    ``found`` holds a document's records, one behind the other.
    """
    groups = groups or buckets

    def answer(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        blocks = [x.as_py() for x in table.column("block")]
        if bucket < 0:  # decided in their chunk
            return pa.table({"to": pa.array([-1 - bucket] * len(blocks), pa.int32()), "answers": pa.array(blocks, pa.binary())})
        ids, rks, records = decide(blocks)
        out = list(packed_answers(ids, rks, records, groups)) if len(ids) else []
        return pa.table({"to": pa.array([a for a, _ in out], pa.int32()), "answers": pa.array([b for _, b in out], pa.binary())})

    def collect(table: pa.Table) -> pa.Table:
        parts: tuple[list, ...] = ([], [], [], [])
        for x in table.column("answers"):
            block = x.as_py()
            (own, counts), at = stretched(block, 2)
            checks = np.frombuffer(block, np.int64, len(own), at)
            for out, x in zip(parts, (np.cumsum(own), checks, counts, np.frombuffer(block, record_type, -1, at + checks.nbytes)), strict=True):
                out.append(x)
        ids, rks, sizes, records = (np.concatenate(x) for x in parts)
        begin = np.cumsum(sizes) - sizes
        order = np.lexsort((rks, ids))
        ids, rks, sizes, begin = ids[order], rks[order], sizes[order], begin[order]
        first = runs(ids, rks)
        moved = np.arange(int(sizes.sum())) + np.repeat(begin - (np.cumsum(sizes) - sizes), sizes)
        ends = np.append(0, np.cumsum(np.add.reduceat(sizes, first))) * record_type.itemsize
        found = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(records[moved].tobytes())])
        return pa.table({"__id": pa.array(ids[first]), "__rk": pa.array(rks[first]), "found": found})

    answered = sent.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(answer, "to int, answers binary")
    return answered.repartition(groups, "to").groupBy("to").applyInArrow(collect, "__id bigint, __rk bigint, found binary")


def blocks_batch(blocks: Iterator[tuple[int, bytes]]) -> pa.RecordBatch:
    out = list(blocks)
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], names=["bucket", "block"])


REST = np.dtype("<u4")


def shared_hashes(rows: DataFrame, text: str, hashes_of: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], buckets: int) -> DataFrame:
    """(__id, __rk, found): the rests (``dealt``) of a document's hashes that a document with another id has too.

    A filter: a few hashes that no other document has may be among them.
    ``hashes_of`` gives the hashes of some texts, and the number of the text of each.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in doc_chunks(batches, text):
            hashes, doc = hashes_of(chunk.bodies)
            # the lowest bits make room for the document: one sort of plain integers
            both = np.unique((hashes >> np.uint64(12) << np.uint64(12)) | doc.astype(np.uint64))
            bucket, rest = dealt(both, buckets)
            yield blocks_batch(asked(chunk, (both & np.uint64(PACK_DOCS - 1)).astype(np.int64), bucket, rest, None, smaller=False, groups=buckets))

    sent = rows.select("__id", "__rk", text).mapInArrow(send, "bucket int, block binary")
    return exchange(sent, lambda blocks: decided(blocks, REST, None, False), REST, buckets)


def flagged(hashes: np.ndarray, doc: np.ndarray, found: list[bytes | None], buckets: int) -> np.ndarray:
    """Which of the hashes of some documents have their rest in the document's ``found``."""
    said = [np.frombuffer(f or b"", REST) for f in found]
    own = np.repeat(np.arange(len(said), dtype=np.uint64), [len(x) for x in said])
    known = np.sort(own << np.uint64(32) | np.concatenate([np.zeros(0, REST), *said]).astype(np.uint64))
    if not len(known):
        return np.zeros(len(hashes), bool)
    sought = doc.astype(np.uint64) << np.uint64(32) | dealt(hashes, buckets)[1].astype(np.uint64)
    return known[np.minimum(np.searchsorted(known, sought), len(known) - 1)] == sought


def bucket_count(docs: DataFrame) -> int:
    return buckets_for(docs, BUCKET_BYTES)
