"""Removal of byte strings that a smaller document has, by depth-limited radix passes over suffixes.

Two suffixes belong together if their first 50 bytes are equal.  The order of
all suffixes isn't needed, only the groups of equal ones, and of these only
those with several documents; so the passes, most significant digit first,
drop a suffix as soon as no other document shares its digits so far.  Sorting
every suffix would shuffle many times the input; so sampled suffixes are
sorted, and each stands for the windows (strings of 50 bytes) around it:

1. A window is represented by the suffix at its anchor, the 20-byte gram with
   the smallest hash inside it (of equal ones the leftmost).  Equal windows
   have equal anchors at equal offsets.  The first digit, a hash of the gram,
   is dealt over the cluster (``repeats``): a suffix whose gram no other
   document has leaves, and with it all its windows.
2. The suffixes left go to the bucket of their gram with their block, all
   bytes of their windows.  There ``radix_groups`` sorts them, 8 bytes a pass:
   by gram, then extent, then through the block.  Equal blocks are decided as
   a whole.
3. Where blocks share a gram but differ, the windows themselves are sorted by
   the same passes, through depth 50: equal groups are exactly the repeated
   windows.

Equality is decided on bytes, hashes only deal and sample.  Blocks that a
chunk of documents has several times are sent once; runs of a short period
(blanks, dashes) are one entry, whatever their length.

Null and short texts have no window and lose nothing.  Ids are integers; of
rows with equal ids none is smaller; null ids come last.  Repeated rows: a row
each.  Other columns are carried; one named as a result column comes back with
``in_`` before its name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeloom.llm import repeats
from timeloom.llm.substrings import covered_at, rolling
from timeloom.llm.text import UNKNOWN_BYTES, Carried, input_bytes, shuffle_partitions

DEPTH = 50
GRAM = 20
#: Bytes whose anchors are computed at a time.
SEGMENT = 1 << 20
_PLACE = np.uint64((1 << 21) - 1)  # position inside a segment
#: Windows that one radix sort works on at a time.
SORT_WINDOWS = 1 << 18
#: Buckets of blocks for each bucket of hashes: a block takes more memory than a hash.
BLOCK_BUCKETS = 2
#: Text bytes whose blocks are packed together: blocks of few entries take more of the disk.
SEND_BYTES = 8 << 20
#: Input bytes (as Catalyst estimates them) of a bucket of hashes: with smaller ones, too, blocks have few entries.
BUCKET_BYTES = 7 << 20
#: So many buckets keep all cores busy, also where the input is small.
LEAST_BUCKETS = 64


def _slide(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` consecutive values."""
    length = 1
    while length * 2 <= width:
        x = np.minimum(x[:-length], x[length:])
        length *= 2
    rest = width - length
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def _even(hashes: np.ndarray) -> np.ndarray:
    """The hashes of anchors, dealt evenly: anchors are the smallest of their windows, so their own hashes crowd near zero.

    One to one: different hashes stay different.
    """
    x = hashes * np.uint64(0x9FB21C651E98DF25)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _anchors_of(data: bytes, ends: np.ndarray, depth: int, gram: int) -> tuple[np.ndarray, ...]:
    """Anchors of the windows of joined pieces that end at ``ends``: hash, position, first and last window start."""
    none = np.zeros(0, np.int64)
    if len(data) < depth:
        return np.zeros(0, np.uint64), none, none, none
    grams = rolling(np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1), gram)
    # of equal hashes the leftmost: the position fills the lowest bits
    at = _slide((grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64), depth - gram + 1)
    inside = np.ones(len(at), bool)
    border = (ends[:, None] - np.arange(1, depth)).ravel()
    inside[border[(border >= 0) & (border < len(at))]] = False
    starts = np.flatnonzero(inside)
    at = (at[starts] & _PLACE).astype(np.int64)
    new = np.concatenate([[True], at[1:] != at[:-1]])[: len(at)]
    first = np.flatnonzero(new)
    at, lo = at[first], starts[first]
    hi = np.append(starts[first[1:] - 1], starts[-1:])
    return _even(grams[at]), at, lo, hi


def anchors(texts: list[bytes], depth: int = DEPTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Hash, text, position and first and last window start of each anchor of some texts.

    A text beyond a segment is worked on piece by piece; an anchor may come once for either piece.
    """
    found: list[tuple[np.ndarray, ...]] = []
    pieces: list[tuple[int, int, bytes]] = []
    total = 0

    def flush() -> None:
        nonlocal total
        ends = np.cumsum([len(p) for _, _, p in pieces])
        hashes, at, lo, hi = _anchors_of(b"".join(p for _, _, p in pieces), ends, depth, gram)
        piece = np.searchsorted(ends, at, side="right")
        shift = (np.array([b for _, b, _ in pieces]) - (ends - np.array([len(p) for _, _, p in pieces])))[piece]
        found.append((hashes, np.array([d for d, _, _ in pieces])[piece], at + shift, lo + shift, hi + shift))
        pieces.clear()
        total = 0

    for d, text in enumerate(texts):
        for start in range(0, len(text) - depth + 1, SEGMENT):
            pieces.append((d, start, text[start : start + SEGMENT + depth - 1]))
            total += len(pieces[-1][2])
            if total >= SEGMENT // 2:
                flush()
    if pieces:
        flush()
    if not found:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none, none
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def radix_groups(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, group: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Groups of equal byte strings among those of equal ``group`` and length, by most-significant-digit passes.

    8 bytes a pass.  A string leaves the sort, with a group of its own, as
    soon as no string of another owner shares its digits so far.
    """
    out = np.empty(len(starts), np.int64)
    alive = np.arange(len(starts))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    order = np.lexsort((owner, lengths, group))
    new = np.ones(len(order), bool)
    new[1:] = (group[order[1:]] != group[order[:-1]]) | (lengths[order[1:]] != lengths[order[:-1]])
    at = free = 0
    words = np.lib.stride_tricks.sliding_window_view(padded, 8) if len(padded) >= 8 else None
    while True:
        alive = alive[order]
        first = np.flatnonzero(new)
        ends = np.append(first[1:], len(alive))
        head, sizes = owner[alive[first]], ends - first
        # owners are the last key of the sort
        mixed = np.repeat(head != owner[alive[ends - 1]], sizes) if len(first) else np.zeros(0, bool)
        number = np.repeat(np.arange(len(first)), sizes)
        keep = mixed & (lengths[alive] > at)
        done, lone = alive[mixed & ~keep], alive[~mixed]
        out[done] = free + number[mixed & ~keep]
        out[lone] = free + len(first) + np.arange(len(lone))
        free += len(first) + len(lone)
        alive, number = alive[keep], number[keep]
        if not len(alive):
            return out
        left = np.minimum(lengths[alive] - at, 8)
        digit = np.ascontiguousarray(words[starts[alive] + at]).view(">u8").reshape(-1).astype(np.uint64)
        digit >>= (np.uint64(8) * (8 - left).astype(np.uint64))
        order = np.lexsort((owner[alive], digit, number))
        number, digit = number[order], digit[order]
        new = np.ones(len(order), bool)
        new[1:] = (number[1:] != number[:-1]) | (digit[1:] != digit[:-1])
        at += 8


def least_owner(group: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each entry the smallest owner in its group."""
    least = np.full(int(group.max()) + 1 if len(group) else 0, np.iinfo(np.int64).max)
    np.minimum.at(least, group, owner)
    return least[group]


#: An answer: the windows that start at lo + a bit of the mask, and so on ``times`` times, ``windows`` apart.
_ANSWER = np.dtype([("lo", "<u4"), ("mask", "<u8"), ("windows", "u1"), ("times", "<u4")])


def _ones(n: np.ndarray) -> np.ndarray:
    n = n.astype(np.uint64)
    return np.where(n >= 64, ~np.uint64(0), (np.uint64(1) << np.minimum(n, np.uint64(63))) - np.uint64(1))


def _answers(lo: np.ndarray, mask: np.ndarray, windows: np.ndarray, times: np.ndarray) -> np.ndarray:
    out = np.empty(len(lo), _ANSWER)
    out["lo"], out["mask"], out["windows"], out["times"] = lo, mask, windows, times
    return out


def _send_blocks(chunk: repeats.Chunk, buckets: int, blocks: int, depth: int, gram: int) -> Iterator[tuple[int, bytes]]:
    """Blocks of the shared anchors of some documents, by bucket of the anchor."""
    hashes, doc, at, lo, hi = anchors(chunk.bodies, depth, gram)
    some = np.flatnonzero(repeats.flagged(hashes, doc, chunk.found, buckets))
    some = some[np.argsort(doc[some], kind="stable")]  # the smallest document of a block first
    hashes, doc, at, lo, hi = (x[some] for x in (hashes, doc, at, lo, hi))
    if not len(doc):
        return
    off, windows = at - lo, hi - lo + 1
    # number of each distinct block: with its offset before it
    seen: dict[bytes, int] = {}
    marks = [bytes([x]) for x in range(depth)]
    number = np.empty(len(doc), np.int64)
    bodies = chunk.bodies
    for i, (d, o, s, e) in enumerate(zip(doc.tolist(), off.tolist(), lo.tolist(), (hi + depth).tolist(), strict=True)):
        number[i] = seen.setdefault(marks[o] + bodies[d][s:e], len(seen))
    distinct = list(seen)
    del seen
    # runs of equal blocks that follow one another are one entry
    new = np.ones(len(doc), bool)
    new[1:] = (number[1:] != number[:-1]) | (doc[1:] != doc[:-1]) | (lo[1:] != lo[:-1] + windows[:-1])
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(doc)))
    hashes, doc, lo, windows, off, number = (x[first] for x in (hashes, doc, lo, windows, off, number))
    ids = chunk.ids[doc]
    owner = np.full(len(distinct), np.iinfo(np.int64).max)
    np.minimum.at(owner, number, ids)
    known = ids > owner[number]
    if known.any():
        said = _answers(lo[known], _ones(windows[known]), windows[known], times[known])
        for to, block in repeats.packed_answers(ids[known], chunk.rks[doc[known]], said, buckets):
            yield -1 - to, block
    # an entry: a document's windows at ``times`` places, ``windows`` apart, all with one block
    pack = zstandard.ZstdCompressor(level=3)
    ask = np.flatnonzero(~known)
    bucket = repeats.dealt(hashes[ask], blocks)[0]
    order = np.argsort(bucket, kind="stable")
    cuts = repeats.runs(bucket[order])
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True):
        part = ask[order[a:b]]
        docs_here, own_doc = np.unique(doc[part], return_inverse=True)
        used, own_block = np.unique(number[part], return_inverse=True)
        texts = [distinct[j] for j in used.tolist()]
        extent = [(len(x) - depth, x[0]) for x in texts]  # windows, offset of the anchor
        counts = (len(docs_here), len(used), len(part))
        numbers = [counts, repeats.steps(chunk.ids[docs_here]), *zip(*extent, strict=True), repeats.steps(own_doc), repeats.steps(own_block), lo[part], times[part]]
        head = repeats.squeezed(np.concatenate(numbers)) + chunk.rks[docs_here].tobytes()
        yield int(bucket[order[a]]), head + pack.compress(b"".join(x[1:] for x in texts))


def _parts(blocks: np.ndarray, windows: np.ndarray, off: np.ndarray, last: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The windows (block, number in the block) of some blocks, in parts that no two equal windows are parted by.

    More than one sort may hold go by the anchor's place in them, from 0 to ``last``: one window of a block at most.
    """
    if int(windows[blocks].sum()) <= SORT_WINDOWS:
        of = np.repeat(blocks, windows[blocks])
        yield of, np.arange(len(of)) - np.repeat(np.cumsum(windows[blocks]) - windows[blocks], windows[blocks])
        return
    for place in range(last + 1):
        bit = off[blocks] - place
        own = (bit >= 0) & (bit < windows[blocks])
        if own.any():
            yield blocks[own], bit[own]


def _decide_blocks(packed: list[bytes], depth: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """id, checksum and answer of the documents of one bucket that lose windows."""
    unpack = zstandard.ZstdDecompressor()
    parts: tuple[list[np.ndarray], ...] = ([], [], [], [], [], [], [])
    bodies, n_blocks = [], 0
    for one in packed:
        (numbers,), end = repeats.stretched(one, 1)
        docs, blocks, n = numbers[:3].tolist()
        own_ids, windows, off, doc, block, lo, times = np.split(numbers[3:], np.cumsum([docs, blocks, blocks, n, n, n]))
        doc = np.cumsum(doc)
        own_rks = np.frombuffer(one, np.int64, docs, end)
        bodies.append(unpack.decompress(one[end + own_rks.nbytes :]))
        for out, x in zip(parts, (np.cumsum(own_ids)[doc], own_rks[doc], np.cumsum(block) + n_blocks, windows, off, lo, times), strict=True):
            out.append(x)
        n_blocks += blocks
    ids, rks, number, windows, off, lo, times = (np.concatenate(x) for x in parts)
    parts = ()
    data = np.frombuffer(b"".join(bodies), np.uint8)
    del bodies, packed
    length = windows + depth - 1
    start = np.cumsum(length) - length
    owner = np.full(n_blocks, np.iinfo(np.int64).max)
    np.minimum.at(owner, number, ids)
    # by gram, then through the blocks of one extent; a string of one owner only leaves
    of_gram = radix_groups(data, start + off, np.full(n_blocks, gram), np.zeros(n_blocks, np.int64), owner)
    group = radix_groups(data, start, length, of_gram * (64 * 64) + off * 64 + windows % 64, owner)
    least = least_owner(group, owner)
    # bits of the windows that a smaller document has; of equal blocks the one with the smallest owner is sorted on
    mask = np.where(owner > least, _ones(windows), np.uint64(0))
    by_owner = np.lexsort((owner, group))
    lead = by_owner[repeats.runs(group[by_owner])]
    shared = least_owner(of_gram[lead], owner[lead]) if len(lead) else np.zeros(0, np.int64)
    most = -least_owner(of_gram[lead], -owner[lead]) if len(lead) else np.zeros(0, np.int64)
    rest = lead[shared != most]
    rest = rest[np.argsort(of_gram[rest], kind="stable")]
    at = 0
    while at < len(rest):  # whole grams at a time
        n = max(1, int(np.searchsorted(np.cumsum(windows[rest[at:]]), SORT_WINDOWS)))
        n = int(np.searchsorted(of_gram[rest[at:]], of_gram[rest[at + min(n, len(rest) - at) - 1]], side="right"))
        part = rest[at : at + n]
        at += n
        for of, bit in _parts(part, windows, off, depth - gram):
            # the anchor's place in a window is part of what equal windows share
            same = radix_groups(data, start[of] + bit, np.full(len(of), depth), of_gram[of] * 64 + off[of] - bit, owner[of])
            hit = owner[of] > least_owner(same, owner[of])
            np.bitwise_or.at(mask, of[hit], np.uint64(1) << bit[hit].astype(np.uint64))
    # blocks equal to a sorted one have its windows, too: theirs are all repeated if their owner is larger
    leader = np.empty(int(group.max()) + 1 if n_blocks else 0, np.int64)
    leader[group[lead]] = lead
    own = number
    said = np.where(ids > least[own], _ones(windows[own]), mask[leader[group[own]]])
    hit = np.flatnonzero(said)
    own = own[hit]
    return ids[hit], rks[hit], _answers(lo[hit], said[hit], windows[own], times[hit])


def window_starts(said: np.ndarray) -> np.ndarray:
    """Starts of the repeated windows from a document's answers."""
    times = said["times"].astype(np.int64)
    if len(said) and times.max() > 1:
        step = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        said = np.repeat(said, times)
        lo = said["lo"].astype(np.int64) + step * said["windows"]
    else:
        lo = said["lo"].astype(np.int64)
    bits = np.unpackbits(np.ascontiguousarray(said["mask"]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    entry, bit = np.nonzero(bits)
    return lo[entry] + bit


def bucket_count(docs: DataFrame) -> int:
    """Buckets of hashes: by the size of the input, not by the shuffle partitions, once there are some."""
    few = min(shuffle_partitions(docs.sparkSession), LEAST_BUCKETS)
    size = input_bytes(docs)
    return shuffle_partitions(docs.sparkSession) if size > UNKNOWN_BYTES else max(few, -(-size // BUCKET_BYTES))


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", depth: int = DEPTH, gram: int = GRAM) -> DataFrame:
    """``docs`` without ``text``, with n_bytes, n_removed, n_spans and kept (binary: what is left of the UTF-8 bytes)."""
    if not gram < depth <= gram + 62 or depth > 200:
        raise ValueError("depth must be above gram, by 62 at most, and not above 200")
    buckets = bucket_count(docs)
    carried = Carried(docs)
    body = carried.of(text)
    rows = carried.df.select("*", *repeats.keyed(carried.df, carried.of(doc_id), body))
    may = repeats.shared_hashes(rows, body, lambda texts: anchors(texts, depth, gram)[:2], buckets)
    # one exchange of the texts, reused by both joins: neither may have columns pruned
    dealt = repeats.packed_docs(rows, body).repartition(buckets, "__id", "__rk")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in repeats.doc_chunks(batches, "__body", SEND_BYTES):
            yield repeats.blocks_batch(_send_blocks(chunk, buckets, BLOCK_BUCKETS * buckets, depth, gram))

    sent = dealt.join(may, ["__id", "__rk"]).mapInArrow(send, "bucket int, block binary")
    said = repeats.exchange(sent, lambda blocks: _decide_blocks(blocks, depth, gram), _ANSWER, BLOCK_BUCKETS * buckets, buckets)
    joined = dealt.join(said, ["__id", "__rk"], "left")
    columns = [c for c in carried.df.columns if c != body]

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, n_removed, n_spans, kept = [], [], [], []
            for packed, found in zip(batch.column("__body").to_pylist(), batch.column("found").to_pylist(), strict=True):
                whole = repeats.unpacked(packed)
                n_bytes.append(len(whole))
                removed = spans = 0
                if found:
                    out = covered_at(window_starts(np.frombuffer(found, _ANSWER)), depth, len(whole))
                    removed = int(np.count_nonzero(out))
                    spans = int(out[0]) + int(np.count_nonzero(out[1:] & ~out[:-1]))
                    whole = np.frombuffer(whole, np.uint8)[~out].tobytes()
                n_removed.append(removed)
                n_spans.append(spans)
                kept.append(whole)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), *(pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)), pa.array(kept, pa.binary())],
                names=[*columns, "n_bytes", "n_removed", "n_spans", "kept"],
            )

    results = (("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept", "binary"))
    schema = carried.df.drop(body).schema
    for name, kind in results:
        schema = schema.add(name, kind)
    return carried.named(joined.select(*columns, "__body", "found").mapInArrow(strip, schema), [n for n, _ in results])
