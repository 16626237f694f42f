"""Removal of token windows that a smaller document has, by Rabin-Karp hashes.

Every window of 13 consecutive words of every document is hashed by a rolling
polynomial over the words' own hashes, with 128 bits in two lanes.  The hashes
are counted in two exchanges (``repeats``): the first takes 32 bits of a lane
and the bucket, and finds the windows that another document may have; the
second takes all 128 bits of these and finds those that start in a document
with a smaller id.  Repeated windows that touch or overlap merge into maximal
intervals, which are removed.

Two different windows are taken for one with a chance of n^2 / 2^129 over n
windows: less than 10^-11 for 10^14 of them.

Null and short texts have no window and lose nothing.  Ids are integers; of
rows with equal ids none is smaller; null ids come last.  Repeated rows: a row
each.  Other columns are carried; one named as a result column comes back with
``in_`` before its name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeloom.llm import repeats
from timeloom.llm.text import Carried

WINDOW = 13
#: Multipliers of the two lanes.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MASK = (1 << 64) - 1
_KEY = np.dtype([("a", "<u8"), ("b", "<u8")])
_POSITION = np.dtype("<u4")


def rolling(tokens: np.ndarray, window: int, multiplier: int = BASES[0]) -> np.ndarray:
    """Polynomial hash of every ``window`` consecutive tokens, modulo 2**64, then mixed."""
    n = len(tokens) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    # hashes of 1, 2, 4, ... tokens, put together by the binary digits of the window
    power, length, base, done, out = tokens, 1, multiplier, 0, None
    while True:
        if window & length:
            part = power[done : done + n]
            out = part if out is None else out * np.uint64(base) + part
            done += length
        if length * 2 > window:
            break
        power = power[:-length] * np.uint64(base) + power[length:]
        base, length = base * base & _MASK, length * 2
    out = out ^ (out >> np.uint64(32))
    out = out * np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """Two lanes of 64 bits for each word."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), np.uint64).reshape(-1, 2)


def window_hashes(texts: list[bytes], window: int = WINDOW, lanes: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes (one column per lane) of all windows of the texts, the number of each one's text and its first word."""
    split = [t.split() for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    tokens = word_hashes([w for own in split for w in own])
    hashes = np.stack([rolling(np.ascontiguousarray(tokens[:, i]), window, BASES[i]) for i in range(lanes)], axis=1)
    counts = np.maximum(sizes - window + 1, 0)
    doc = np.repeat(np.arange(len(texts)), counts)
    position = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
    return hashes[np.repeat(np.cumsum(sizes) - sizes, counts) + position], doc, position


def covered(starts: np.ndarray, window: int, n: int) -> np.ndarray:
    """Which of ``n`` tokens lie in a window that starts where ``starts`` is set."""
    return covered_at(np.flatnonzero(starts), window, n)


def covered_at(at: np.ndarray, window: int, n: int) -> np.ndarray:
    edges = np.bincount(at, minlength=n + 1) - np.bincount(at + window, minlength=n + 1)
    return np.cumsum(edges[:n]) > 0


def _equal_to_any(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Positions whose hash (both lanes) is that of one of the positions ``at``."""
    order = np.lexsort((hashes[:, 1], hashes[:, 0]))
    own = hashes[order]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(np.concatenate([[False], (own[1:] != own[:-1]).any(axis=1)]))
    wanted = np.zeros(len(order), bool)
    wanted[group[at]] = True
    return np.flatnonzero(wanted[group])


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, rejoin: bool = True) -> DataFrame:
    """``docs`` without ``text``, with n_words, n_removed and kept (the kept words, joined by one space).

    Without ``rejoin`` a text that loses nothing is kept as it is.

    bytes.split() parts words at exactly the space and tab .. carriage return.
    """
    buckets = repeats.bucket_count(docs)
    carried = Carried(docs)
    body = carried.of(text)
    rows = carried.df.select("*", *repeats.keyed(carried.df, carried.of(doc_id), body))

    def first_lane(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        hashes, doc, _ = window_hashes(texts, window)
        return hashes[:, 0], doc

    may = repeats.shared_hashes(rows, body, first_lane, buckets)
    # one exchange of the texts, reused by both joins: neither may have columns pruned
    dealt = repeats.packed_docs(rows, body).repartition(buckets, "__id", "__rk")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in repeats.doc_chunks(batches, "__body"):
            hashes, doc, position = window_hashes(chunk.bodies, window, 2)
            some = np.flatnonzero(repeats.flagged(hashes[:, 0], doc, chunk.found, buckets))
            hashes, doc, position = hashes[some], doc[some], position[some]
            order = np.lexsort((position, doc, hashes[:, 1], hashes[:, 0]))
            hashes, doc, position = hashes[order], doc[order], position[order]
            # a window that a document holds several times is sent once
            new = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]).any(axis=1) | (doc[1:] != doc[:-1])])[: len(doc)])
            keys = np.ascontiguousarray(hashes[new]).view(_KEY).reshape(-1)
            yield repeats.blocks_batch(repeats.asked(
                chunk, doc[new], repeats.dealt(hashes[new, 0], buckets)[0], keys, position[new].astype(_POSITION), smaller=True, groups=buckets
            ))

    sent = dealt.join(may, ["__id", "__rk"]).mapInArrow(send, "bucket int, block binary")
    said = repeats.exchange(sent, lambda blocks: repeats.decided(blocks, _KEY, _POSITION, True), _POSITION, buckets)
    joined = dealt.join(said, ["__id", "__rk"], "left")
    columns = [c for c in carried.df.columns if c != body]

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for packed, found in zip(batch.column("__body").to_pylist(), batch.column("found").to_pylist(), strict=True):
                whole = repeats.unpacked(packed)
                words = whole.split()
                n_words.append(len(words))
                if found:
                    hashes, _, _ = window_hashes([whole], window, 2)
                    at = _equal_to_any(hashes, np.frombuffer(found, _POSITION).astype(np.int64))
                    words = [words[i] for i in np.flatnonzero(~covered_at(at, window, len(words))).tolist()]
                n_removed.append(n_words[-1] - len(words))
                as_is = not rejoin and not n_removed[-1]
                kept.append((None if packed is None else whole) if as_is else b" ".join(words))
            arrays = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays(
                [*arrays, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                names=[*columns, "n_words", "n_removed", "kept"],
            )

    schema = carried.df.drop(body).schema
    for name, kind in (("n_words", "long"), ("n_removed", "long"), ("kept", "string")):
        schema = schema.add(name, kind)
    return carried.named(joined.select(*columns, "__body", "found").mapInArrow(strip, schema), ["n_words", "n_removed", "kept"])


def stripped_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars", window: int = WINDOW) -> DataFrame:
    """``docs`` with repeated passages removed from the texts, in its own columns.

    Texts that lose nothing stay as they are; documents that lose all words go.
    """
    carried = Carried(docs)
    out = remove_repeats(carried.df, doc_id=carried.of(doc_id), text=carried.of(text), window=window, rejoin=False)
    out = out.where("n_words = 0 or n_removed < n_words")
    if n_chars in docs.columns:
        own = carried.of(n_chars)
        cut = F.char_length("kept").cast(docs.schema[n_chars].dataType)
        out = out.withColumn(own, F.when(F.col("n_removed") > 0, cut).otherwise(F.col(own)))
    return carried.named(out.withColumn(carried.of(text), F.col("kept")).select(*carried.df.columns))
