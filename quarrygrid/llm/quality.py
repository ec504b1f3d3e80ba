"""Quality rules as weak supervision.

Each rule votes good (1), bad (-1) or abstains (0) on every document.  The votes of all documents
are counted by pattern (at most 3 ** rules of them, whatever the corpus), and expectation
maximisation on those counts estimates, without labels, how often each rule votes bad, abstains and
votes good on good documents and on each kind of bad ones, and the share of either.  A document is
kept by its posterior probability of being good, not by passing every rule: a bad vote of a rule that
errs on good documents is forgiven where the others speak for the document, and abstentions that go
with a kind of bad documents count against it.

Measures are taken in one pass over whole texts.

Defined results: a null text has no words, and a document under the base limits (`base_failed`) is
never kept; rows with equal doc_id are judged each on its own; an empty table gives no rows; on
one without patterns to learn from, the starting rates hold.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import carried, renamed, saved, slices, unpacked

#: Fixed values of the contract.
SYMBOLS, BLANKS, WINDOW, LEAST_WORDS, MOST_REPEATED = b"#*$%&|<>", b" \t\n\v\f\r", 8, 20, 30
_UPPER, _LOWER, _ASCII = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(128))

#: Patterns of votes that are sent to every executor; more are joined by a shuffle.
MOST_BROADCAST = 60_000

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_lower long, n_marks long, n_ends long, n_letters long"


def repeated(words: Sequence, size: int = WINDOW) -> int:
    """How many words lie in a window of `size` words that the sequence holds twice or more."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    w = np.zeros(n, np.uint64)
    for k in range(size):
        w = (w ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        w ^= w >> np.uint64(29)
    order = np.argsort(w)
    same = w[order[1:]] == w[order[:-1]]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    cover[at] += 1
    cover[at + size] -= 1
    return int((np.cumsum(cover) > 0).sum())


def letters_beyond_ascii(raw: bytes) -> int:
    """Letters of any script outside ASCII, and the marks that scripts write onto them (categories L and M)."""
    rest = raw.translate(None, _ASCII).decode()
    return sum(n for c, n in Counter(rest).items() if unicodedata.category(c)[0] in "LM")


def measured(text: str | None) -> tuple[int, ...]:
    """The columns of MEASURES of one text."""
    raw = (text or "").encode()
    without = lambda chars: len(raw) - len(raw.translate(None, chars))
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip(BLANKS)]
    ends = sum(x.rstrip(BLANKS).endswith((b".", b"!", b"?")) for x in lines)
    upper, lower = without(_UPPER), without(_LOWER)
    return len(words), len(text or "") - without(BLANKS), without(SYMBOLS), len(lines) - len(set(lines)), repeated(words), len(lines), upper, lower, raw.count(b"!"), ends, upper + lower + letters_beyond_ascii(raw)


def measures(docs: DataFrame) -> DataFrame:
    """The columns of docs, which has `text` last, with the measures in its place."""
    names = [x.split()[0] for x in MEASURES.split(", ")]
    kept = docs.columns[:-1]

    def make(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches, 1000):
            found = np.array([measured(text) for text in batch.column("text").to_pylist()], np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *map(pa.array, np.ascontiguousarray(found.T))], [*kept, *names])

    schema = T.StructType([*docs.schema.fields[:-1], *T.StructType.fromDDL(MEASURES).fields])
    return docs.mapInArrow(make, schema)


@dataclass(frozen=True)
class Rule:
    """Votes bad where `bad` holds, else good where `good` holds, else abstains; null counts as false.

    kind: the trouble that it looks for; rules of one kind start as witnesses of one class.
    """

    name: str
    kind: str
    bad: Column
    good: Column

    def vote(self) -> Column:
        return F.when(F.coalesce(self.bad, F.lit(False)), -1).when(F.coalesce(self.good, F.lit(False)), 1).otherwise(0).cast("byte")


def rules() -> list[Rule]:
    """The rules of the query; each compares whole numbers, so no rounding is involved."""
    c = F.col
    return [
        Rule("length", "fragment", c("n_words") < 20, c("n_words") >= 40),
        Rule("word_length", "noise", (c("word_chars") > 14 * c("n_words")) | (c("word_chars") < 2 * c("n_words")), (c("word_chars") >= 3 * c("n_words")) & (c("word_chars") <= 11 * c("n_words"))),
        Rule("symbols", "noise", 100 * c("n_symbols") > 20 * c("n_words"), 100 * c("n_symbols") <= 2 * c("n_words")),
        Rule("repeated_lines", "repetition", 100 * c("n_dup_lines") > 15 * c("n_lines"), 100 * c("n_dup_lines") <= 5 * c("n_lines")),
        Rule("repeated_words", "repetition", 100 * c("n_repeat_words") > 30 * c("n_words"), 100 * c("n_repeat_words") <= 10 * c("n_words")),
        Rule("capitals", "shouting", 100 * c("n_upper") > 50 * (c("n_upper") + c("n_lower")), 100 * c("n_upper") <= 15 * (c("n_upper") + c("n_lower"))),
        Rule("exclamations", "shouting", 100 * c("n_marks") > 20 * c("n_words"), 100 * c("n_marks") <= 3 * c("n_words")),
        Rule("letters", "noise", 100 * c("n_letters") < 50 * c("word_chars"), 100 * c("n_letters") >= 75 * c("word_chars")),
        Rule("few_letters", "noise", 100 * c("n_letters") < 90 * c("word_chars"), 100 * c("n_letters") >= 95 * c("word_chars")),
        Rule("line_ends", "shouting", (10 * c("n_ends") < 9 * c("n_lines")) & (c("n_lines") > 1), c("n_ends") >= c("n_lines")),
    ]


class LabelModel:
    """Latent classes: good documents, and one class for each kind of bad ones.

    A class has a rate for every rule and vote (bad, abstains, good).  All rates and shares are learned; the
    starting rates, which say that a kind's own rules mostly vote bad on it and others do not, weigh as
    `belief` documents.  What a class became is read from its rates: a kind none of whose own rules
    votes bad on more than half of it is no trouble, and counts as good.
    """

    def __init__(self, kinds: Sequence[str], good: float = 0.8, belief: float = 2.0):
        names = list(dict.fromkeys(kinds))
        self.own = np.array([[k == name for k in kinds] for name in names]).reshape(len(names), len(kinds))
        rates = np.array([[0.01, 0.05, 0.94], [0.1, 0.1, 0.8], [0.7, 0.1, 0.2]])
        self.start = rates[np.vstack([np.zeros((1, len(kinds)), int), 1 + self.own])]
        self.rates, self.belief = self.start.copy(), belief
        self.share = np.append(good, np.full(len(names), (1 - good) / max(1, len(names))))

    def classes(self, votes: np.ndarray) -> np.ndarray:
        """The posterior of each class, for each row of votes; the first is good."""
        log = np.log(self.share) + np.log(self.rates[:, np.arange(votes.shape[1]), votes + 1]).sum(axis=2).T
        p = np.exp(log - log.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def good(self) -> np.ndarray:
        """Which classes count as good."""
        return np.append(True, ~((self.rates[1:, :, 0] > 0.5) & self.own).any(axis=1))

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return self.classes(votes)[:, self.good()].sum(axis=1)

    def fit(self, votes: np.ndarray, counts: np.ndarray, rounds: int = 500, settled: float = 1e-9) -> LabelModel:
        """Expectation maximisation over patterns of votes and how often each comes."""
        which = (votes[:, :, None] == np.array([-1, 0, 1])).astype(float).reshape(len(votes), 3 * votes.shape[1])
        for _ in range(rounds if len(votes) else 0):
            mass = counts[:, None] * self.classes(votes)
            total = mass.sum(axis=0)
            rates = ((mass.T @ which).reshape(self.start.shape) + self.belief * self.start) / (total[:, None, None] + self.belief)
            moved, self.rates = np.abs(rates - self.rates).max(), rates
            self.share = (total + 1) / (total.sum() + len(total))
            if moved < settled:
                break
        return self


def voted(docs: DataFrame, by: Sequence[Rule]) -> DataFrame:
    """measures() with votes and base_failed."""
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return measures(docs).withColumn("votes", F.array(*[r.vote() for r in by])).withColumn("base_failed", failed)


def posteriors(votes: DataFrame, by: Sequence[Rule]) -> DataFrame:
    """votes and posterior of every pattern: of n rules there are 3 ** n at most, whatever the corpus."""
    patterns = sorted((tuple(r.votes), r.n) for r in votes.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect())
    table = np.array([p for p, _ in patterns], np.int64).reshape(-1, len(by))
    model = LabelModel([r.kind for r in by]).fit(table, np.array([c for _, c in patterns], float))
    found = [(list(p), float(x)) for (p, _), x in zip(patterns, model.posterior(table), strict=True)]
    out = votes.sparkSession.createDataFrame(found, "votes array<tinyint>, posterior double")
    return F.broadcast(out) if len(found) <= MOST_BROADCAST else out


def judged(docs: DataFrame, by: Sequence[Rule] | None = None, keep_from: float = 0.5) -> DataFrame:
    """doc_id, the measures, base_failed, votes, posterior and kept of every row of docs."""
    by = rules() if by is None else by
    own = saved(voted(renamed(docs, ["doc_id", "text"]), by), "measures")
    return own.join(posteriors(own, by), "votes").withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= keep_from))


def kept_rows(docs: DataFrame, by: Sequence[Rule] | None = None, keep_from: float = 0.5) -> DataFrame:
    """The rows of docs that are kept, with all their columns.

    Rows are written once with their votes, so that texts are measured once and none is shuffled.
    """
    by = rules() if by is None else by
    own = saved(voted(carried(docs, ["text"]), by).select("row", "votes", "base_failed"), "votes")
    out = own.join(posteriors(own, by), "votes").where(~F.col("base_failed") & (F.col("posterior") >= keep_from))
    return unpacked(out, docs.columns)
