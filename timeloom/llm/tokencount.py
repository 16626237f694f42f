"""Token counts with a public tokenizer's own library.

Texts come in Arrow batches that are cut into chunks of about equal bytes.
Each text is split at safe boundaries: before a single space between two
characters that are no white space.  The tokenizer's pattern never matches
across such a boundary and its merges stay inside a match, so the counts of
the pieces add up to the count of the text; a text without such boundaries is
encoded whole.  Pieces repeat a lot: only those that the Python worker hasn't
met are encoded, in batches, and only lengths are kept.

Null: counted as an empty text, 0 tokens.  Repeated rows: a row each.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeloom.llm.arrow import map_chunks

#: Pieces whose counts a worker remembers; beyond it starts anew.
CACHE_PIECES = 400_000
#: Space that isn't a safe boundary: beside white space, or what some Unicode versions count as such.
_UNSAFE = re.compile("[\\s᠎​﻿] |^ | $| [\\s᠎​﻿]")
_SAFE = re.compile("(?<![\\s᠎​﻿])(?<!^)(?= [^\\s᠎​﻿])")

_loaded: dict[str, Callable[[list[str]], list[int]]] = {}
_first: dict[str, int] = {}
_rest: dict[str, int] = {}


def encoder(path: str) -> Callable[[list[str]], list[int]]:
    """Lengths of texts by the library for the file; no begin, end, truncation or padding."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _loaded[path] = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            _loaded[path] = lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]
        _first.clear()
        _rest.clear()
    return _loaded[path]


def splits_at_spaces(path: str) -> bool:
    """Whether the tokenizer's matches end before a space, as those of byte-level BPE with its own pattern do."""
    if path.endswith(".model"):
        return False
    import json

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    before = spec.get("pre_tokenizer") or {}
    return (
        before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        and not spec.get("normalizer") and not spec.get("post_processor")
        and not any(" " in t["content"] or t["lstrip"] or t["rstrip"] for t in spec.get("added_tokens", []))
    )


def _pieces(text: str) -> tuple[list[str], list[str]]:
    """Pieces at the start of text or kept whole, and pieces that follow a boundary, without its space."""
    if not _UNSAFE.search(text):
        first, *rest = text.split(" ")
        return [first], rest
    whole = _SAFE.split(text)
    return whole[:1], [x[1:] for x in whole[1:]]


def _learn(known: dict[str, int], pieces: set[str], encode: Callable, before: str) -> None:
    new = [x for x in pieces if x not in known]
    if len(known) + len(new) > CACHE_PIECES:
        known.clear()
        new = list(pieces)
    for i in range(0, len(new), 2000):
        part = new[i : i + 2000]
        known.update(zip(part, encode([before + x for x in part]), strict=True))


def count_texts(texts: list[str | None], path: str, split: bool) -> list[int]:
    encode = encoder(path)
    if not split:
        return [sum(encode([t])) if t else 0 for t in texts]
    parts = [_pieces(t) if t else ([], []) for t in texts]
    _learn(_first, {x for a, _ in parts for x in a}, encode, "")
    _learn(_rest, {x for _, b in parts for x in b}, encode, " ")
    return [sum(map(_first.__getitem__, a)) + sum(map(_rest.__getitem__, b)) for a, b in parts]


def token_counts(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit; one row per row of ``docs``, no shuffle.

    ``path`` is the tokenizer's file on every executor.
    """
    split = splits_at_spaces(path)

    def work(chunk: pa.RecordBatch) -> dict:
        texts = chunk.column("text").to_pylist()
        counts = pa.array(count_texts(texts, path, split), pa.int64())
        sizes = pc.fill_null(pc.binary_length(chunk.column("text")).cast(pa.int64()), 0)
        return {"doc_id": chunk.column("doc_id"), "n_bytes": sizes, "n_tokens": counts}

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_chunks(rows, "text", f"doc_id {kind}, n_bytes bigint, n_tokens bigint", work).withColumn("over_limit", F.col("n_tokens") > limit)
