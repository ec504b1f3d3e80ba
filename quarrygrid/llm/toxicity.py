"""Toxicity by a bag of subwords: embeddings averaged into a linear softmax.

A word is the mean of the vectors of its character n-grams and of itself, all hashed into one
table; words of a window are averaged, and a softmax over two classes reads the average.  Table and
softmax are trained jointly in numpy.  A misspelling not seen in training shares most n-grams with
the word it was, and so most of its vector.

A few insults in a long text vanish in the text's average, so the average is taken over windows and
a text scores as its worst window; in training, a text's label goes to the window that scores worst
at that step, for either class.

The classifier is fitted on a bounded sample: at most `per_class` labelled texts of each class,
the first by a hash of doc_id.  Scoring covers every whole text; as the model is linear, each
n-gram is one number there, and the table sent out has a fixed size.

Defined results: a null text, or one without words, has the score of no evidence; rows with
equal doc_id are scored each on its own; with no labelled text of either class every score is 0;
an empty table gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import renamed, rows

#: Characters taken off both ends of a word.
_ENDS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„‚‘’…–—¡¿"
GRAMS = (3, 4, 5, 6)


def word_of(part: str) -> str:
    return part.lower().strip(_ENDS)


def subwords(words: list[str], buckets: int, at_once: int = 30_000) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all subwords of the words, one word after another, and how many each word has."""
    parts = [_subwords(words[k : k + at_once], buckets) for k in range(0, len(words), at_once)]
    if not parts:
        return np.empty(0, np.int32), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _subwords(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    raw = [b"<" + w.encode() + b">" for w in words]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(raw)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(data))
    found, owners = [], []
    h = np.zeros(len(data), np.uint64)
    for n in range(max(GRAMS)):
        h = h[: len(data) - n] if n else h
        h = (h ^ (data[n:] + np.uint64(1))) * np.uint64(0x100000001B3)
        if n + 1 in GRAMS:
            at = np.flatnonzero(left[: len(h)] > n)
            m = h[at] + np.uint64(n)
            m = (m ^ (m >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            found.append((m >> np.uint64(32)) % np.uint64(buckets))
            owners.append(owner[at])
    ids, own = np.concatenate(found).astype(np.int32), np.concatenate(owners)
    order = np.argsort(own, kind="stable")
    return ids[order], np.bincount(own, minlength=len(raw))


def means(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The mean of each run of `counts` values; 0 for an empty run."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    ends = np.cumsum(counts)
    n = np.maximum(counts, 1).reshape(-1, *[1] * (values.ndim - 1))
    return (total[ends] - total[ends - counts]) / n


def worst(z: np.ndarray, window: int) -> tuple[int, int]:
    """Start and end of the window of `window` values (all, if fewer) with the greatest mean."""
    if len(z) <= window:
        return 0, len(z)
    total = np.concatenate([[0.0], np.cumsum(z)])
    k = int((total[window:] - total[:-window]).argmax())
    return k, k + window


@dataclass(frozen=True)
class Model:
    """What scoring needs: the logit of each subword bucket, the bias, the window."""

    weights: bytes
    bias: float
    window: int

    def table(self) -> np.ndarray:
        return np.frombuffer(self.weights, np.float32)


def fit(texts: list[str], labels: list[int], buckets: int = 1 << 18, dim: int = 8, window: int = 5, epochs: int = 40, batch: int = 512, rate: float = 0.05, decay: float = 1e-6, drop: float = 0.6, seed: int = 7) -> Model | None:
    """Trains on texts and 0/1 labels; None if a class is missing.

    drop: the share of subwords left out at random in each step, as a misspelling leaves some out; what
    is left has to carry the label.
    """
    y = np.array(labels, np.int64)
    if not len(y) or y.min() == y.max():
        return None
    numbers: dict[str, int] = {}
    docs = [np.array([numbers.setdefault(w, len(numbers)) for p in t.split() if (w := word_of(p))], np.int32) for t in texts]
    grams, per_word = subwords(list(numbers) or ["-"], buckets)
    first = np.cumsum(per_word) - per_word
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.02, (buckets, dim))
    soft, bias = rng.normal(0, 0.3, (dim, 2)), np.zeros(2)
    state = [(np.zeros_like(x), np.zeros_like(x)) for x in (table, soft, bias)]
    step = 0
    for _ in range(epochs):
        scalar = (table @ (soft[:, 1] - soft[:, 0])).astype(np.float32)
        z = np.concatenate([means(scalar[grams[first[k] : first[k] + per_word[k : k + 30_000].sum()]], per_word[k : k + 30_000]) for k in range(0, len(per_word), 30_000)])
        spans = [worst(z[d], window) for d in docs]
        for some in np.array_split(rng.permutation(len(docs)), max(1, len(docs) // batch)):
            parts = [docs[i][slice(*spans[i])] for i in some]
            sizes = np.array([len(p) for p in parts])
            words = np.concatenate(parts)
            n = per_word[words]
            ends = np.cumsum(n)
            own = grams[np.repeat(first[words] - ends + n, n) + np.arange(int(ends[-1]) if len(ends) else 0)]
            kept = (rng.random(len(own)) >= drop)[:, None]
            hidden = means(means(table[own] * kept, n), sizes)
            logits = hidden @ soft + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(some)), y[some]] -= 1
            p /= len(some)
            share = np.repeat(np.repeat(p @ soft.T / np.maximum(sizes, 1)[:, None], sizes, axis=0) / np.maximum(n, 1)[:, None], n, axis=0) * kept
            grad = np.column_stack([np.bincount(own, share[:, k], minlength=buckets) for k in range(dim)])
            step += 1
            for x, g, (m, v) in zip((table, soft, bias), (grad + decay * table, hidden.T @ p, p.sum(axis=0)), state, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    weights = (table @ (soft[:, 1] - soft[:, 0])).astype(np.float32)
    return Model(weights.tobytes(), float(bias[1] - bias[0]), window)


class Scorer:
    """Scores texts; remembers a bounded number of words, with a bounded number of characters."""

    def __init__(self, model: Model, most_words: int = 1_500_000, most_chars: int = 1 << 26):
        self.model, self.table, self.most, self.most_chars = model, model.table(), most_words, most_chars
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[str, int] = {}
        self.z, self.chars = np.empty(0), 0

    def scores(self, texts: list[str]) -> np.ndarray:
        if len(self.numbers) > self.most or self.chars > self.most_chars:
            self.clear()
        known, new, number = len(self.numbers), [], self.numbers
        docs = []
        for text in texts:
            parts = text.split()
            for p in parts:
                if p not in number:
                    number[p] = known + len(new)
                    new.append(p)
            docs.append(np.fromiter(map(number.__getitem__, parts), np.int64, len(parts)))
        if new:
            words = [word_of(p) for p in new]
            self.chars += sum(map(len, new))
            ids, n = subwords(words, len(self.table))
            z = means(self.table[ids], n)
            z[[not w for w in words]] = np.nan
            self.z = np.concatenate([self.z, z])
        out = np.zeros(len(texts))
        for k, d in enumerate(docs):
            z = self.z[d]
            z = z[~np.isnan(z)]
            if len(z):
                a, b = worst(z, self.model.window)
                out[k] = z[a:b].mean()
        return 1 / (1 + np.exp(-np.clip(out + self.model.bias, -60, 60)))


@functools.lru_cache(maxsize=2)
def scorer(model: Model) -> Scorer:
    return Scorer(model)


def sample(docs: DataFrame, labels: DataFrame, trains: Column, per_class: int = 2500, most_bytes: int = 1 << 25, longest: int = 1 << 20) -> tuple[list[str], list[int]]:
    """Texts and labels of at most per_class documents of each class, the first by a hash of doc_id.

    A document with several labels counts as toxic if one of them says so.  Ids are chosen before any text is
    moved.  What reaches the driver is bounded by 2 * most_bytes: of a class the first texts that fit, none of
    them over `longest` bytes.
    """
    marks = renamed(labels, ["doc_id", "toxic"]).where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = None
    for k in (0, 1):
        some = marks.where((F.col("toxic") == k) & trains).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = some if chosen is None else chosen.unionByName(some)
    texts = renamed(docs, ["doc_id", "text"]).where(F.octet_length("text") <= longest)
    picked = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    so_far = F.sum(F.octet_length("text")).over(W.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id"))
    found = sorted(picked.withColumn("held", so_far).where(F.col("held") <= most_bytes).select("doc_id", "text", "toxic").collect())
    return [r.text for r in found], [r.toxic for r in found]


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and score of every row of docs (doc_id, text)."""

    def make(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = scorer(model) if model else None
        for some in rows(batches, 1 << 21):
            found = own.scores([text or "" for _, text in some]) if own else np.zeros(len(some))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in some], pa.int64()), pa.array(found, pa.float64())], ["doc_id", "score"])

    return renamed(docs, ["doc_id", "text"]).mapInArrow(make, "doc_id long, score double")
