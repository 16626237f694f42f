"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A text is the bag of its character n-grams (3 to 5 characters, words framed by
a space, lower-cased), hashed into a fixed number of rows of an embedding
matrix; the mean of the rows, each as often as its n-gram occurs, goes into a
two-class softmax.  Embeddings and softmax are trained jointly by mini-batch
AdaGrad in numpy.  Misspelled words share most n-grams with the words they
come from.

Training takes a bounded sample of labelled rows: at most ``max_rows``, half
of them of either label as far as there are such, and ``max_bytes`` of bags,
chosen by a hash of the id.  A tenth of them is held back: epochs go on until
the loss there has not fallen for ``PATIENCE`` of them, and the parameters
with the smallest are taken.  The share of either label in the sample is not
that in the labels, which a term of the log-odds corrects.

The trained model is one number per embedding row when scoring, as embeddings
enter the softmax linearly: a table of fixed size goes to the executors.

Null and empty texts: the score of the bias alone.  Very long texts are
counted a segment at a time.  Repeated rows: a row each; an id with both
labels counts as label 1; null ids and labels aren't learnt from.  Without
labelled rows of both labels all scores are 0.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeloom.llm.arrow import map_chunks
from timeloom.llm.storage import stored

ROWS_BITS = 18
DIM = 8
SIZES = (3, 4, 5)
MAX_ROWS = 4000
#: Bytes of the sample's bags at most (6 a distinct n-gram), which is what the driver gathers.
MAX_BYTES = 64 << 20
MOST_EPOCHS = 60
PATIENCE = 5
#: Characters of a text whose n-grams are counted at a time.
SEGMENT = 1 << 18
_GAPS = re.compile(r"\s+")
_MUL = np.uint64(0x9E3779B97F4A7C15)

Bag = tuple[np.ndarray, np.ndarray]


def _rows_of(c: np.ndarray, bits: int, last: bool, longest: int = max(SIZES)) -> list[np.ndarray]:
    """Embedding rows of the n-grams of some characters; unless ``last``, of those that begin before the last ``longest - 1``."""
    spaces = np.concatenate([[0], np.cumsum(c == 32)])
    hashed, out = c.astype(np.uint64) + np.uint64(1), []
    for size in range(2, longest + 1):
        if len(c) < size:
            break
        hashed = (hashed[:-1] * _MUL) ^ (c[size - 1 :].astype(np.uint64) + np.uint64(size))
        if size in SIZES:
            n = len(c) - size + 1 if last else len(c) - longest + 1
            # an n-gram may hold spaces at its ends only
            inner = spaces[size - 1 : size - 1 + n] - spaces[1 : 1 + n]
            out.append(((hashed[:n][inner == 0] * _MUL) >> np.uint64(64 - bits)).astype(np.int64))
    return out


def bag(text: str | None, bits: int = ROWS_BITS) -> Bag:
    """Distinct embedding rows of the text's n-grams, and how often each occurs."""
    if not text or not (clean := _GAPS.sub(" ", text.lower()).strip()):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    clean, overlap = f" {clean} ", max(SIZES) - 1
    counts = None
    for start in range(0, max(1, len(clean) - overlap), SEGMENT):
        last = start + SEGMENT + overlap >= len(clean)
        c = np.frombuffer(clean[start : start + SEGMENT + overlap].encode("utf-32-le", "replace"), dtype=np.uint32)
        rows = np.concatenate(_rows_of(c, bits, last) or [np.zeros(0, np.int64)])
        if last and counts is None:
            return np.unique(rows, return_counts=True)
        part = np.bincount(rows, minlength=1 << bits)
        counts = part if counts is None else counts + part
        if last:
            break
    at = np.flatnonzero(counts)
    return at, counts[at]


def training_rows(
    docs: DataFrame, labels: DataFrame, train, *, doc_id: str, text: str, label: str, max_rows: int, max_bytes: int = MAX_BYTES
) -> tuple[list[tuple[Bag, int]], dict[int, int]]:
    """(bag, label) of a bounded sample, and the number of labelled rows of each label; texts are turned into bags on the executors."""
    marked = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    # one label per id: the larger one, should there be two
    marked = marked.groupBy("id").agg(F.max("y").alias("y")).where(train(F.col("id")))
    sizes = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return [], sizes
    share = F.lit(0.0)
    for y, n in sizes.items():
        share = F.when(F.col("y") == y, F.lit(min(1.0, max_rows / 2 / n))).otherwise(share)
    chosen = marked.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share * 1_000_000)
    # at most about max_rows ids and labels: 16 bytes each
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id")

    def work(chunk: pa.RecordBatch) -> dict:
        bags = [bag(t) for t in chunk.column("text").to_pylist()]
        packed = [r.astype("<u4").tobytes() + np.minimum(n, 65535).astype("<u2").tobytes() for r, n in bags]
        return {"id": chunk.column("id").cast(pa.string()), "y": chunk.column("y"), "bag": pa.array(packed, pa.binary())}

    packed = map_chunks(rows.select("id", "y", "text"), "text", "id string, y int, bag binary", work)
    # in the order of a hash, as many as max_bytes hold; an id may come more than once
    packed = stored(packed.select("id", "y", "bag", F.xxhash64("id", "bag").alias("h"), F.length("bag").cast("long").alias("size")), "toxicity")
    total = packed.agg(F.sum("size")).first()[0] or 0
    if total > max_bytes:
        packed = packed.where(F.pmod("h", F.lit(1_000_000)) < int(1_000_000 * max_bytes / total))
    found = []
    for r in sorted(packed.select("id", "y", "bag").collect(), key=lambda r: (r["id"], bytes(r["bag"]))):
        n = len(r["bag"]) // 6
        found.append(((np.frombuffer(r["bag"], "<u4", n).astype(np.int64), np.frombuffer(r["bag"], "<u2", n, 4 * n)), r["y"]))
    return found, sizes


class Model:
    """Embeddings and softmax, with the AdaGrad sums of their gradients."""

    def __init__(self, bits: int, dim: int, rate: float, rng: np.random.Generator):
        self.rate = rate
        self.emb = rng.uniform(-0.1, 0.1, (1 << bits, dim)).astype(np.float32)
        self.soft, self.bias = rng.uniform(-0.5, 0.5, (dim, 2)).astype(np.float32), np.zeros(2, np.float32)
        self.emb_sq, self.soft_sq, self.bias_sq = np.full(1 << bits, 1e-8, np.float32), np.full((dim, 2), 1e-6, np.float32), np.full(2, 1e-6, np.float32)

    def forward(self, rows: list[tuple[Bag, int]]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Class shares, means, and the weights of each text's n-grams."""
        weights = [(n / n.sum()).astype(np.float32) for (_, n), _ in rows]
        mean = np.stack([w @ self.emb.take(g, axis=0) for w, ((g, _), _) in zip(weights, rows)])
        z = mean @ self.soft + self.bias
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        return p / p.sum(axis=1, keepdims=True), mean, weights

    def loss(self, rows: list[tuple[Bag, int]]) -> float:
        p = self.forward(rows)[0]
        return float(-np.log(np.maximum(p[np.arange(len(rows)), [y for _, y in rows]], 1e-12)).mean())

    def slopes(self, rows: list[tuple[Bag, int]]) -> tuple[np.ndarray, ...]:
        """Rows in use, their slopes, the direction of all of them, and the gradients of softmax and bias, of the mean loss.

        With two classes the errors are ``(-e, e)``, so the gradient of any
        embedding is a multiple of the difference of the softmax columns.
        """
        p, mean, weights = self.forward(rows)
        p[np.arange(len(rows)), [y for _, y in rows]] -= 1
        p /= len(rows)
        flat = np.concatenate([g for (g, _), _ in rows])
        slope = np.bincount(flat, weights=np.concatenate([w * e for w, e in zip(weights, p[:, 1])]), minlength=len(self.emb))
        used = np.flatnonzero(slope != 0)
        return used, slope[used].astype(self.emb.dtype), self.soft[:, 1] - self.soft[:, 0], mean.T @ p, p.sum(axis=0)

    def gradients(self, rows: list[tuple[Bag, int]]) -> tuple[np.ndarray, ...]:
        """Rows in use and their gradients, gradients of softmax and bias, of the mean loss."""
        used, slope, way, grad_soft, grad_bias = self.slopes(rows)
        return used, np.outer(slope, way), grad_soft, grad_bias

    def step(self, rows: list[tuple[Bag, int]]) -> None:
        used, slope, way, grad_soft, grad_bias = self.slopes(rows)
        sums = self.emb_sq[used] + slope**2 * (way**2).mean()
        self.emb_sq[used] = sums
        self.emb[used] = self.emb.take(used, axis=0) - np.outer(self.rate * slope / np.sqrt(sums), way)
        self.soft_sq += grad_soft**2
        self.soft -= self.rate * grad_soft / np.sqrt(self.soft_sq)
        self.bias_sq += grad_bias**2
        self.bias -= self.rate * grad_bias / np.sqrt(self.bias_sq)

    def parts(self) -> tuple[np.ndarray, float]:
        """Each row's part in the log-odds of label 1, and the bias."""
        return (self.emb @ (self.soft[:, 1] - self.soft[:, 0])).astype(np.float32), float(self.bias[1] - self.bias[0])


def fit(
    rows: list[tuple[Bag, int]], sizes: dict[int, int] | None = None, *, bits: int = ROWS_BITS, dim: int = DIM, rate: float = 0.3, batch: int = 32, seed: int = 1
) -> tuple[np.ndarray, float]:
    """Joint training; gives each row's part in the log-odds of label 1, and the bias.

    ``sizes``: how many rows of each label there are beyond the sample.
    """
    rng = np.random.default_rng(seed)
    rows = [r for r in rows if len(r[0][0])]
    order = rng.permutation(len(rows)).tolist()
    back = max(1, len(rows) // 10)
    held, learnt = [rows[i] for i in order[:back]], [rows[i] for i in order[back:]]
    model = Model(bits, dim, rate, rng)
    best, least, since = model.parts(), float("inf"), 0
    for _ in range(MOST_EPOCHS):
        order = rng.permutation(len(learnt)).tolist()
        for i in range(0, len(order), batch):
            model.step([learnt[j] for j in order[i : i + batch]])
        loss = model.loss(held)
        best, least, since = (model.parts(), loss, 0) if loss < least else (best, least, since + 1)
        if since == PATIENCE:
            break
    part, bias = best
    taken = {y: sum(1 for _, own in learnt if own == y) for y in (0, 1)}
    if sizes and all(taken.values()) and all(sizes.get(y) for y in (0, 1)):
        bias += float(np.log(sizes[1] / sizes[0]) - np.log(taken[1] / taken[0]))
    return part, bias


def score_texts(texts: list[str | None], part: np.ndarray, bias: float) -> np.ndarray:
    out = np.empty(len(texts))
    for i, t in enumerate(texts):
        rows, n = bag(t)
        out[i] = (part[rows].astype(np.float64) * n).sum() / n.sum() + bias if len(rows) else bias
    return 1 / (1 + np.exp(-np.clip(out, -50, 50)))


def toxicity(
    docs: DataFrame, labels: DataFrame, train, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = MAX_ROWS
) -> DataFrame:
    """doc_id and score of every row of ``docs``; ``train`` tells by the id which labels may be learnt from."""
    rows, sizes = training_rows(docs, labels, train, doc_id=doc_id, text=text, label=label, max_rows=max_rows)
    part, bias = fit(rows, sizes) if rows else (np.zeros(1 << ROWS_BITS, np.float32), -50.0)
    # a table of fixed size (1 MB)
    sent = docs.sparkSession.sparkContext.broadcast((part, bias))

    def work(chunk: pa.RecordBatch) -> dict:
        return {"doc_id": chunk.column("doc_id"), "score": pa.array(score_texts(chunk.column("text").to_pylist(), *sent.value))}

    bare = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return map_chunks(bare, "text", f"doc_id {bare.schema['doc_id'].dataType.simpleString()}, score double", work)
