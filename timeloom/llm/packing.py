"""Conflict-constrained best-fit packing of documents into sequences of a fixed number of words.

Documents are dealt into shards of bounded size by a hash of the id.  Within a
shard, pieces go from the longest to the shortest into the bin whose residual
is the tightest that takes them.  Bins carry bitmaps of the sources and of the
duplicate clusters in them; a bin with the piece's source or cluster doesn't
take it, and the search goes on to the next larger residual, until the
tightest compatible bin is found, or a new one is opened.

Bins are kept by residual, for each frequent source apart without those that
hold it, so that a source with a third of all rows isn't searched past one
bin at a time; occupancy of residuals is a bitmap too.

A document longer than a bin is cut: full pieces are bins of their own, the
rest is packed.  All words are kept.  Texts without a word give no row.
Duplicate clusters are texts equal but for case of A-Z and spacing, unless a
column is given.  Null sources are one source; repeated rows: a row each (they
are in one cluster).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeloom.llm.text import SPACES, lower_ascii, words

CAPACITY = 2048
SHARD_ROWS = 4096
#: Sources with at least this share of a shard have an index of their own.
FREQUENT = 0.04


class Bins:
    """Open bins by residual; for each indexed source those without it."""

    def __init__(self, capacity: int, indexed: set[int]):
        self.indexes: dict[int, tuple[list[dict[int, None]], int]] = {s: ([{} for _ in range(capacity + 1)], 0) for s in (-1, *indexed)}
        self.residual: list[int] = []
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def _put(self, b: int) -> None:
        r = self.residual[b]
        for s, (lists, occupied) in self.indexes.items():
            if s < 0 or not self.sources[b] >> s & 1:
                lists[r][b] = None
                self.indexes[s] = (lists, occupied | 1 << r)

    def _take(self, b: int) -> None:
        r = self.residual[b]
        for s, (lists, occupied) in self.indexes.items():
            if b in lists[r]:
                del lists[r][b]
                if not lists[r]:
                    self.indexes[s] = (lists, occupied & ~(1 << r))

    def place(self, size: int, source: int, cluster: int, capacity: int) -> int:
        """Bin of a piece; ``cluster`` is a bitmap (0: no other member in the shard)."""
        lists, occupied = self.indexes.get(source, self.indexes[-1])
        left = occupied >> size << size
        while left:
            r = (left & -left).bit_length() - 1
            for b in lists[r]:
                if not self.sources[b] >> source & 1 and not self.clusters[b] & cluster:
                    self._take(b)
                    self._set(b, size, source, cluster)
                    return b
            left &= left - 1
        b = len(self.residual)
        self.residual.append(capacity)
        self.sources.append(0)
        self.clusters.append(0)
        self._set(b, size, source, cluster)
        return b

    def _set(self, b: int, size: int, source: int, cluster: int) -> None:
        self.residual[b] -= size
        self.sources[b] |= 1 << source
        self.clusters[b] |= cluster
        if self.residual[b]:
            self._put(b)


def pack_shard(sizes: list[int], sources: list[int], clusters: list[int], capacity: int = CAPACITY) -> list[int]:
    """Bin of each piece (sizes 1 .. capacity) of a shard; sources are small integers, clusters any."""
    counts = np.bincount(sources) if sources else np.zeros(0, int)
    bins = Bins(capacity, {s for s, n in enumerate(counts.tolist()) if n >= FREQUENT * len(sources)})
    several = {c for c, n in zip(*np.unique(np.array(clusters), return_counts=True), strict=True) if n > 1} if clusters else set()
    bit = {c: 1 << i for i, c in enumerate(sorted(several))}
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        out[i] = bins.place(sizes[i], sources[i], bit.get(clusters[i], 0), capacity)
    return out


def pack(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", cluster: str | None = None,
    capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """doc_id, piece, first_word, n_words, bin_id, in_bin (offset of the piece); one row per piece."""
    key = F.xxhash64(lower_ascii(F.concat_ws(" ", words(F.col(text), SPACES)))) if cluster is None else F.xxhash64(cluster)
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), key.alias("cluster"),
        F.size(words(F.col(text), SPACES)).cast("long").alias("n"),
    )
    shards = max(1, math.ceil(docs.count() / shard_rows))
    dealt = rows.where("n > 0").withColumn("shard", F.pmod(F.xxhash64("doc_id", "cluster"), F.lit(shards)).cast("int"))

    def run(table: pa.Table) -> pa.Table:
        ids, clusters, names = (table.column(c).to_pylist() for c in ("doc_id", "cluster", "source"))
        order = sorted(range(table.num_rows), key=lambda i: [(x is not None, x) for x in (ids[i], clusters[i], names[i])])
        n = table.column("n").to_pylist()
        source_of = {s: i for i, s in enumerate(sorted(set(names), key=lambda s: (s is not None, s)))}
        pieces = [(i, at, min(capacity, n[i] - at)) for i in order for at in range(0, n[i], capacity)]
        rest = [p for p in pieces if p[2] < capacity]
        full = [p for p in pieces if p[2] == capacity]
        where = pack_shard([p[2] for p in rest], [source_of[names[p[0]]] for p in rest], [clusters[p[0]] for p in rest], capacity)
        opened = max(where, default=-1) + 1
        where += range(opened, opened + len(full))
        filled: dict[int, int] = {}
        shard = table.column("shard")[0].as_py()
        cols: tuple[list, ...] = ([], [], [], [], [], [])
        for (i, at, size), b in zip(rest + full, where, strict=True):
            for c, v in zip(cols, (ids[i], at // capacity, at, size, shard << 32 | b, filled.get(b, 0)), strict=True):
                c.append(v)
            filled[b] = filled.get(b, 0) + size
        names_out = ("doc_id", "piece", "first_word", "n_words", "bin_id", "in_bin")
        kinds = (table.schema.field("doc_id").type, *[pa.int64()] * 5)
        return pa.table({k: pa.array(c, t) for k, c, t in zip(names_out, cols, kinds, strict=True)})

    kind = rows.schema["doc_id"].dataType.simpleString()
    return dealt.groupBy("shard").applyInArrow(run, f"doc_id {kind}, piece bigint, first_word bigint, n_words bigint, bin_id bigint, in_bin bigint")
