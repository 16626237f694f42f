"""SimHash near-duplicates by anchor points of covering codes.

Fingerprints have 64 bits.  61 of them are cut into two stretches of 23 bits,
covered by the perfect binary Golay code (radius 3), and one of 15 bits,
covered by the perfect Hamming code (radius 1).  An anchor is a code word of
each.  Every fingerprint has one home: its nearest anchor.  A fingerprint y is
copied to each anchor that it could reach as a neighbour of a fingerprint at
home there: with d the threshold, to code words within radius + e1, radius +
e2, radius + e3 of its stretches, e1 + e2 + e3 <= d.  If x and y differ in at
most d bits, y is among the copies at x's home, so no pair is missed.  Of two
homes the larger is used, which halves the copies.

Equal fingerprints are one before that.  At an anchor, tenants and copies are
compared; a large anchor isn't compared pair by pair but through the
fingerprints' neighbours at half the threshold (two fingerprints within 2 bits
share one within 1 bit of both).  An anchor hands on a forest of links, at
most one per fingerprint, never all pairs.  Anchors with more than ``CROWDED``
copies (a template in many variants) aren't collected in a task: there each
fingerprint is dealt to its neighbours within half the threshold instead, and
links to the smallest fingerprint of each, of which there are 65 at most.

Null texts and texts without a word have fingerprint zero.  Null ids are left
out of the choice of a component's smallest id unless there is no other.
Repeated rows: a row each.  The threshold must be even.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timeloom.llm.arrow import map_chunks
from timeloom.llm.components import components
from timeloom.llm.storage import stored
from timeloom.llm.text import Carried, shuffle_partitions, text_key

SHINGLE = 3
THRESHOLD = 2
SEED = 42
#: Fingerprints at an anchor that are compared pair by pair.
PAIRWISE = 64
#: Copies at an anchor that one task takes together.
CROWDED = 4096
#: Generator of the Golay code, x^11+x^9+x^7+x^6+x^5+x+1.
GOLAY = 0xAE3
_STRETCHES = ((0, 23, 3), (23, 23, 3), (46, 15, 1))

_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bit set where it is set in over half the shingles' XXH64, repeats included."""
    words = text.encode().translate(_FOLD).split() if text else []
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    last = ends[shingle - 1 :] - 1 if len(words) >= shingle else ends[-1:] - 1
    first = np.concatenate([[0], ends])[: len(last)]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter([digest(line[a:b], SEED) for a, b in zip(first.tolist(), last.tolist(), strict=True)], "<u8", len(last))
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 14):
        counts += np.unpackbits(h[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(counts * 2 > len(h)).tolist())


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, rk (a checksum of the text) and fp (the 64 bits as a signed long) of every row."""
    bare = docs.select(F.col(doc_id).alias("doc_id"), text_key(F.col(text)).alias("rk"), F.col(text).alias("text"))

    def work(chunk: pa.RecordBatch) -> dict:
        fps = np.array([fingerprint(t, shingle) for t in chunk.column("text").to_pylist()], np.uint64).view(np.int64)
        return {"doc_id": chunk.column("doc_id"), "rk": chunk.column("rk"), "fp": pa.array(fps, pa.int64())}

    return map_chunks(bare, "text", f"doc_id {bare.schema['doc_id'].dataType.simpleString()}, rk bigint, fp bigint", work)


def _golay_syndrome(word: int) -> int:
    for i in range(22, 10, -1):
        if word >> i & 1:
            word ^= GOLAY << (i - 11)
    return word


def _hamming_syndrome(word: int) -> int:
    out = 0
    for i in range(15):
        if word >> i & 1:
            out ^= i + 1
    return out


class _Code:
    """Differences to code words near a word, by its syndrome and by how far they are beyond the radius."""

    def __init__(self, bits: int, radius: int, syndrome, beyond: int):
        self.bits = bits
        single = np.array([syndrome(1 << i) for i in range(bits)])
        errors, syndromes, cost = [], [], []
        for w in range(radius + beyond + 1):
            for c in combinations(range(bits), w):
                errors.append(sum(1 << i for i in c))
                syndromes.append(int(np.bitwise_xor.reduce(single[list(c)])) if c else 0)
                cost.append(max(0, w - radius))
        self.single = single
        syndromes, cost, errors = np.array(syndromes), np.array(cost), np.array(errors, np.uint64)
        self.by_cost = []
        for e in range(beyond + 1):
            own, s = errors[cost == e], syndromes[cost == e]
            order = np.argsort(s, kind="stable")
            own, s = own[order], s[order]
            n = 1 << int(np.ceil(np.log2(single.max() + 1)))
            self.by_cost.append((own, np.searchsorted(s, np.arange(n)), np.searchsorted(s, np.arange(n), side="right")))

    def syndromes(self, words: np.ndarray) -> np.ndarray:
        out = np.zeros(len(words), np.int64)
        for i in range(self.bits):
            out ^= np.where((words >> np.uint64(i)) & np.uint64(1), self.single[i], 0)
        return out


_codes: dict[int, list[_Code]] = {}


def _codes_for(beyond: int) -> list[_Code]:
    if beyond not in _codes:
        golay, hamming = _Code(23, 3, _golay_syndrome, beyond), _Code(15, 1, _hamming_syndrome, beyond)
        _codes[beyond] = [golay, golay, hamming]
    return _codes[beyond]


def anchors(fps: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index into fps, anchor, whether it is the home) of all copies, homes first; copies only at anchors above the home."""
    codes = _codes_for(threshold)
    parts = [(fps >> np.uint64(at)) & np.uint64((1 << bits) - 1) for at, bits, _ in _STRETCHES]
    syndromes = [c.syndromes(p) for c, p in zip(codes, parts, strict=True)]
    index, anchor, home = [], [], None
    for costs in np.ndindex(*(threshold + 1,) * 3):
        if sum(costs) > threshold:
            continue
        rows, out = np.arange(len(fps)), np.zeros(len(fps), np.uint64)
        for (at, _, _), code, part, syn, e in zip(_STRETCHES, codes, parts, syndromes, costs, strict=True):
            errors, lo, hi = code.by_cost[e]
            n = (hi - lo)[syn[rows]]
            first = np.repeat(lo[syn[rows]], n)
            step = np.arange(len(first)) - np.repeat(np.cumsum(n) - n, n)
            rows, out = np.repeat(rows, n), np.repeat(out, n)
            out = out | ((part[rows] ^ errors[first + step]) << np.uint64(at))
        if sum(costs) == 0:
            home = np.empty(len(fps), np.uint64)
            home[rows] = out
        else:
            above = out > home[rows]
            rows, out = rows[above], out[above]
        index.append(rows)
        anchor.append(out)
    index, anchor = np.concatenate(index), np.concatenate(anchor)
    return index, anchor, np.arange(len(index)) < len(fps)


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _forest(links: np.ndarray) -> np.ndarray:
    """Links (pairs of indices) reduced to one per joined node."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for a, b in links.tolist():
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            kept.append((a, b))
    return np.array(kept, np.int64).reshape(-1, 2)


def _near(fps: np.ndarray, threshold: int) -> np.ndarray:
    """Links between all fingerprints within ``threshold`` of one another, as a forest, without going through pairs."""
    half = (threshold + 1) // 2
    masks = [np.uint64(sum(1 << i for i in c)) for w in range(half + 1) for c in combinations(range(64), w)]
    links = []
    # windows of masks against all: a shared neighbour of both lies within half of either
    around = np.concatenate([fps ^ m for m in masks])
    owner = np.tile(np.arange(len(fps)), len(masks))
    order = np.lexsort((owner, around))
    around, owner = around[order], owner[order]
    same = np.flatnonzero(around[1:] == around[:-1])
    a, b = owner[same], owner[same + 1]
    return _forest(np.unique(np.stack([a, b], axis=1), axis=0))


def links_at(anchor: np.ndarray, fps: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of fingerprints that link, for rows ordered by anchor."""
    if not len(anchor):
        return fps, fps
    cuts = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
    starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(anchor)]])
    size = ends - starts
    out_a, out_b = [], []
    small = np.repeat(size <= PAIRWISE, size)
    for step in range(1, min(int(size.max()), PAIRWISE)):
        i = np.flatnonzero((anchor[step:] == anchor[:-step]) & small[:-step])
        i = i[_popcount(fps[i] ^ fps[i + step]) <= threshold]
        out_a.append(fps[i])
        out_b.append(fps[i + step])
    for s, e in zip(starts[size > PAIRWISE].tolist(), ends[size > PAIRWISE].tolist(), strict=True):
        own = fps[s:e]
        pairs = _near(own, threshold)
        out_a.append(own[pairs[:, 0]])
        out_b.append(own[pairs[:, 1]])
    if not out_a:
        return fps[:0], fps[:0]
    return np.concatenate(out_a), np.concatenate(out_b)


def fingerprint_links(fps: DataFrame, threshold: int = THRESHOLD, crowded: int = CROWDED) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that connect all within ``threshold`` bits."""
    if threshold % 2:
        raise ValueError("the threshold must be even")

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                own = batch.column("fp")[i : i + 2000].to_numpy().view(np.uint64)
                index, anchor, _ = anchors(own, threshold)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.view(np.int64)), pa.array(own[index].view(np.int64))], names=["anchor", "fp"]
                )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_a, held_f = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def out(a, f):
            x, y = links_at(a, f.view(np.uint64), threshold)
            pairs = np.unique(np.stack([np.minimum(x.view(np.int64), y.view(np.int64)), np.maximum(x.view(np.int64), y.view(np.int64))], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:
            a = np.concatenate([held_a, batch.column("anchor").to_numpy()])
            f = np.concatenate([held_f, batch.column("fp").to_numpy()])
            # the last anchor may go on in the next batch
            cut = int(np.searchsorted(a == a[-1], True)) if len(a) else 0
            yield out(a[:cut], f[:cut])
            held_a, held_f = a[cut:], f[cut:]
        if len(held_a):
            yield out(held_a, held_f)

    spark = fps.sparkSession
    # the distinct fingerprints may lie in a few files
    copies = fps.repartition(shuffle_partitions(spark)).mapInArrow(copy, "anchor bigint, fp bigint")
    counted = copies.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowded).select("anchor")
    hot = stored(counted, "simhash-crowded")
    if hot.isEmpty():
        return _compared(copies, compare, spark)
    # at most one of ``crowded`` copies is a crowded anchor; adaptive execution chooses the join by the size
    rest = _compared(copies.join(hot, "anchor", "left_anti"), compare, spark)
    masks = [sum(1 << i for i in c) for w in range(threshold // 2 + 1) for c in combinations(range(64), w)]
    signed = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m) for m in masks])
    near = copies.join(hot, "anchor", "left_semi").select("fp").distinct().select("fp", F.explode(signed).alias("mask"))
    near = near.select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("near"))
    least = F.min("fp").over(Window.partitionBy("near"))
    return rest.unionByName(near.select(least.alias("a"), F.col("fp").alias("b")).where("a < b").distinct())


def _compared(copies: DataFrame, compare, spark) -> DataFrame:
    dealt = copies.repartition(shuffle_partitions(spark), "anchor").sortWithinPartitions("anchor", "fp")
    return dealt.mapInArrow(compare, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, rk, fp, component_id (the smallest id of the component), component_rk (the smallest checksum with it) of every row."""
    marked = stored(fingerprints(docs, doc_id=doc_id, text=text, shingle=shingle), "simhash")
    # null ids last
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "rk")).alias("least")
    distinct = stored(marked.groupBy("fp").agg(first), "simhash-distinct")
    roots = components(fingerprint_links(distinct.select("fp"), threshold), "simhash-links")
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("least"))
    per_fp = named.drop("least").join(least, "root").select("fp", F.col("least.doc_id").alias("component_id"), F.col("least.rk").alias("component_rk"))
    # the text of a third of all rows may have one fingerprint: adaptive execution splits that side of the join
    return marked.join(per_fp, "fp").select("doc_id", "rk", "fp", "component_id", "component_rk")


def keep_first(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """One row of each component, in the columns of ``docs``: that with the smallest id (null ids last), then the smallest checksum of the text.

    Of rows that repeat both, one stays.
    """
    carried = Carried(docs)
    own_id, own_text = carried.of(doc_id), carried.of(text)
    marked = stored(near_duplicates(carried.df, doc_id=own_id, text=own_text, **kw), "simhash-marked")
    first = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("rk") == F.col("component_rk"))
    dropped = marked.where(~first).select(F.col("doc_id").alias("d"), F.col("rk").alias("k")).distinct()
    rows = carried.df.withColumn("rk", text_key(F.col(own_text)))
    here = lambda other: rows[own_id].eqNullSafe(other["d"]) & (rows["rk"] == other["k"])
    rows = rows.join(dropped, here(dropped), "left_anti")
    again = stored(marked.where(first).groupBy(F.col("doc_id").alias("d"), F.col("rk").alias("k")).count().where("count > 1").drop("count"), "simhash-again")
    if not again.isEmpty():
        repeated = rows.join(again, here(again), "left_semi").dropDuplicates([own_id, "rk"])
        rows = rows.join(again, here(again), "left_anti").unionByName(repeated)
    return carried.named(rows.drop("rk"))
