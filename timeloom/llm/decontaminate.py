"""Benchmark decontamination by winnowing, in DataFrame functions only.

Every document and every benchmark item is reduced to winnowing fingerprints:
the smallest k-gram hash of each window of ``span - k + 1`` consecutive
k-grams.  Two texts that share ``span`` words share such a window and hence
its smallest hash, so no shared span is missed.  A fingerprint hit is then
extended to the left and to the right and kept only where whole windows of
words are equal (their 64-bit hashes, word by word).

Items shorter than ``span`` are one window as a whole: all grams of their
length are looked up (their winnowing window holds one gram).

Plan: one scan of the documents; the fingerprints are exploded into a
broadcast hash join with the benchmark's fingerprints inside one stage, so
that unmatched fingerprints and all texts stay in the scanning task; one
shuffle of a row per document plus one per hit.  The benchmark is broadcast
only if it has at most ``broadcast_grams`` grams, otherwise fingerprints are
joined by a shuffle, each with the hashes of the words around it.

Nulls, ties, repeats: a null text has no words; a null id is an ordinary
group of its own; rows that repeat id and text each give a row; rows with one
id and different texts are judged apart; items with a null id or no word are
ignored; repeated items count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timeloom.llm.text import NOT_FOLDED, Carried, lower_ascii, text_key, words

SPAN = 10
GRAM = 5
#: More benchmark grams than this are joined by a shuffle.
BROADCAST_GRAMS = 500_000


#: A fingerprint is one long: 33 bits of the gram's hash, then 31 bits of its position.
_POS_BITS = 31
_MARKER = (1 << _POS_BITS) - 1  # no text has that many words


def _no_longs() -> Column:
    return F.array().cast("array<bigint>")


def _grams(hashes: Column, n: Column, span: int, size: int) -> Column:
    """(hash, position) of all grams of ``size`` words; the hash tells apart the spans."""

    def one(at: Column) -> Column:
        hashed = F.xxhash64(*[hashes[at + j] for j in range(size)], F.lit(span))
        return F.shiftleft(hashed, _POS_BITS).bitwiseOR(at.cast("long"))

    return F.when(n >= size, F.transform(F.sequence(F.lit(0), n - size), one)).otherwise(_no_longs())


def _winnow(grams: Column, width: int) -> Column:
    """The smallest of each ``width`` consecutive grams, each once; of equal hashes the leftmost."""
    if width == 1:
        return grams
    least = lambda i: F.least(*[grams[i + j] for j in range(width)])
    return F.when(
        F.size(grams) >= width,
        F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(grams) - width), least)),
    ).otherwise(_no_longs())


def _worded(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col)
    return (
        df.select(F.col(id_col).alias("id"), text_key(text).alias("rk"), words(lower_ascii(text), NOT_FOLDED).alias("words"))
        .select("id", "rk", F.size("words").alias("n"), F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    )


def _printed(df: DataFrame, sizes: list[tuple[int, int]], *first: Column) -> DataFrame:
    """One row per fingerprint: id, rk, n, hashes, print.

    The explode is outer and in a projection of its own, so that it is
    compiled together with the join behind it and copies no array for
    unmatched fingerprints; a filter inferred from an inner explode would be
    pushed down and compute the fingerprints once more for each word.
    """
    keep = ["id", "rk", "n", "hashes"]
    df = df.select(*keep, *[_grams(F.col("hashes"), F.col("n"), *x).alias(f"grams_{x[0]}") for x in sizes])
    parts = [_winnow(F.col(f"grams_{span}"), span - gram + 1) for span, gram in sizes]
    df = df.select(*keep, F.concat(*first, *parts).alias("prints"))
    return df.select(*keep, F.explode_outer("prints").alias("print"))


_POS = (lambda: F.col("print").bitwiseAND(F.lit(_MARKER)).cast("int"))
_GRAM = (lambda: F.shiftright("print", _POS_BITS))


def benchmark_hits(
    docs: DataFrame,
    items: DataFrame,
    *,
    doc_id: str = "doc_id",
    doc_text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    span: int = SPAN,
    gram: int = GRAM,
    broadcast_grams: int = BROADCAST_GRAMS,
) -> DataFrame:
    """One row per document row: id, rk, n_words, starts (array of struct(at, span)), items (sorted strings).

    ``starts`` are the word positions at which a window of an item occurs.
    """
    spark = docs.sparkSession
    item_rows = _worded(items.where(F.col(item_id).isNotNull()), item_id, item_text).where("n > 0").dropDuplicates(["id", "rk"])
    # at most ``span`` rows, whatever the size of the benchmark
    facts = item_rows.groupBy(F.least("n", F.lit(span)).alias("span")).agg(F.sum("n").alias("grams")).collect()
    sizes = sorted((r["span"], gram if r["span"] == span else r["span"]) for r in facts)
    small = sum(r["grams"] for r in facts) <= broadcast_grams
    doc_rows = _worded(docs, doc_id, doc_text)
    if not sizes:
        return doc_rows.select(
            "id", "rk", F.col("n").cast("long").alias("n_words"),
            F.array().cast("array<struct<at:int,span:int>>").alias("starts"), F.array().cast("array<string>").alias("items"),
        )

    # an item's words from span - 1 before to span - 1 after the fingerprint's gram
    context = lambda: F.slice("hashes", F.greatest(_POS() - (span - 1), F.lit(0)) + 1, 3 * span)
    base = lambda: F.greatest(_POS() - (span - 1), F.lit(0))
    sought = None
    for one in sizes:  # an item has windows of one length only
        own = _printed(item_rows.where(F.least("n", F.lit(span)) == one[0]), [one]).select(
            F.lit(False).alias("marker"), _GRAM().alias("gram"), F.lit(one[0]).alias("span"), F.col("id").cast("string").alias("item"),
            _POS().alias("item_pos"), F.col("n").alias("item_n"), base().alias("item_base"), context().alias("item_context"),
        )
        sought = own if sought is None else sought.unionByName(own)

    seen = ["id", "rk", "n", F.col("pos"), F.greatest(F.col("pos") - (span - 1), F.lit(0)).alias("base"),
            F.slice("hashes", F.greatest(F.col("pos") - (span - 1), F.lit(0)) + 1, 3 * span).alias("context")]
    marks = _printed(doc_rows, sizes, F.array(F.lit(_MARKER).cast("long"))).select(
        "id", "rk", "n", "hashes", _POS().alias("pos"), (F.col("print") == _MARKER).alias("marker"), _GRAM().alias("gram")
    )
    found_columns = [*seen, "marker", "span", "item", "item_pos", "item_n", "item_base", "item_context"]
    if small:
        # one more print that every document has: its row reaches the aggregation with or without hits
        marker = spark.range(1).select(F.lit(True).alias("marker"), F.lit(0).cast("long").alias("gram"))
        known = F.broadcast(sought.unionByName(marker, allowMissingColumns=True))
        found = marks.join(known, ["marker", "gram"]).select(*found_columns)
    else:
        narrow = marks.select(*seen, "marker", "gram")
        hits = narrow.where(~F.col("marker")).join(sought.drop("marker"), "gram").drop("gram")
        found = hits.unionByName(narrow.where("marker").drop("gram"), allowMissingColumns=True)

    # windows that hold the gram: the document's from ``at``, the item's from as far before its own gram
    shift = F.col("item_pos") - F.col("pos")
    lo = F.greatest(F.lit(0), -shift, F.col("pos") - F.when(F.col("span") == span, span - gram).otherwise(0))
    hi = F.least("pos", F.col("n") - F.col("span"), F.col("item_n") - F.col("span") - shift)
    found = found.withColumn("lo", lo).withColumn("hi", hi)
    equal = F.when(
        ~F.col("marker") & (F.col("hi") >= F.col("lo")),
        F.filter(
            F.sequence("lo", "hi"),
            lambda at: F.slice("context", at - F.col("base") + 1, F.col("span"))
            == F.slice("item_context", at + shift - F.col("item_base") + 1, F.col("span")),
        ),
    ).otherwise(F.array().cast("array<int>"))
    found = found.select("id", "rk", "n", "marker", "span", "item", equal.alias("equal"))
    hits = found.select(
        "id", "rk", "marker",
        F.when(F.col("marker"), F.col("n")).alias("n_words"),
        F.transform("equal", lambda at: F.struct(at.alias("at"), F.col("span").alias("span"))).alias("starts"),
        F.when(F.size("equal") > 0, F.col("item")).alias("item"),
    )
    return (
        hits.groupBy("id", "rk")
        .agg(
            F.max("n_words").cast("long").alias("n_words"),
            F.count_if("marker").cast("int").alias("copies"),
            F.array_distinct(F.flatten(F.collect_set("starts"))).alias("starts"),
            F.sort_array(F.collect_set("item")).alias("items"),
        )
        .select("id", "rk", "n_words", "starts", "items", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
        .drop("copy")
    )


def covered_words(starts: Column) -> Column:
    """Number of distinct positions inside the windows of ``starts``."""
    return F.size(
        F.array_distinct(F.flatten(F.transform(starts, lambda s: F.sequence(s["at"], s["at"] + s["span"] - 1))))
    )


def contamination(docs: DataFrame, items: DataFrame, **kw) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted array), contaminated; one row per document row."""
    hits = benchmark_hits(docs, items, **kw)
    n_hit = covered_words(F.col("starts")).cast("long")
    return hits.select(
        F.col("id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        "items", (n_hit > 0).alias("contaminated"), F.col("rk").alias("text_key"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, **kw) -> DataFrame:
    """``docs`` without the rows that hold a window of a benchmark item; all columns stay.

    Only the ids of contaminated rows are shuffled against the documents.
    """
    carried = Carried(docs)
    own = {"doc_id": carried.of(kw.pop("doc_id", "doc_id")), "doc_text": carried.of(kw.pop("doc_text", "text"))}
    bad = contamination(carried.df, items, **own, **kw).where("contaminated").select(F.col("doc_id").alias("d"), F.col("text_key").alias("k")).distinct()
    here = carried.df[own["doc_id"]].eqNullSafe(bad["d"]) & (text_key(carried.df[own["doc_text"]]) == bad["k"])
    return carried.named(carried.df.join(bad, here, "left_anti"))
