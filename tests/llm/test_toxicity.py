import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from quarrygrid.llm import queries, toxicity

BAD = ["schlimmwort", "horridword", "vileterm", "nastylabel"]


def corpus(n, seed):
    r = random.Random(seed)
    syllables = ["an", "the", "or", "ti", "on", "er", "ing", "wh", "ly", "ed", "ea", "st"]
    out = []
    for i in range(n):
        words = ["".join(r.choice(syllables) for _ in range(r.randrange(1, 5))) for _ in range(r.randrange(5, 300))]
        toxic = i % 4 == 0
        for _ in range(1 + len(words) // 60 if toxic else 0):
            words.insert(r.randrange(len(words)), r.choice(BAD))
        out.append((" ".join(words), int(toxic)))
    return out


def test_held_out_and_misspelt():
    train, test = corpus(600, 1), corpus(300, 2)
    model = toxicity.fit([t for t, _ in train], [y for _, y in train])
    scores, y = toxicity.Scorer(model).scores([t for t, _ in test]), np.array([y for _, y in test])
    assert (scores[y == 1] >= 0.7).mean() > 0.95 and (scores[y == 0] >= 0.7).mean() < 0.03
    own = toxicity.Scorer(model)
    # Never seen in training: most n-grams are those of the word it was.
    unseen = own.scores(["the an horridworrd the on", "vvileterm ing the on", "the NASTYLABEL!!! ly", "ing nastylabell the"])
    assert (unseen >= 0.7).sum() >= 3 and unseen.min() > 10 * own.scores(["the an on ing er", "ly ed the on"]).max()
    assert own.scores(["the an on er ing", ""]).max() < 0.5
    # The memo is bounded, and emptying it changes nothing.
    few = toxicity.Scorer(model, most_words=10)
    assert np.allclose(np.concatenate([few.scores([t]) for t, _ in test[:50]]), scores[:50])


def test_query(spark, small):
    got = queries.op6_toxicity_subwords(spark, small).collect()
    assert len(got) == spark.read.parquet(f"{small}/documents.parquet").count()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)


def test_query_on_held_out_labels(spark):
    """305 toxic texts train here; some of the held-out ones have no word, nor a like one, that these have."""
    sf = "/root/testdata/sf0.1"
    got = queries.op6_toxicity_subwords(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    toxic, clean = ([r for r in got if r.toxic == k] for k in (1, 0))
    assert np.mean([r.predicted for r in toxic]) > 0.6 and np.mean([r.predicted for r in clean]) < 0.02
    assert np.mean([a.score > b.score for a in toxic for b in clean]) > 0.9


def test_bytes_of_training_are_bounded(spark):
    docs = spark.createDataFrame([(k, f"{k} " * (1 + 100 * (k == 9))) for k in range(10)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(10)], "doc_id long, toxic int")
    texts, y = toxicity.sample(docs, labels, F.lit(True), most_bytes=5, longest=100)
    assert len(texts) == 4 and sorted(y) == [0, 0, 1, 1] and all(len(t) == 2 for t in texts)


def test_labels_of_held_out_rows_are_not_used(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{n}.parquet") for n in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    other = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.sample(docs, labels, ~held) == toxicity.sample(docs, other, ~held)


def test_odd(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, "x"), (2, 0, "x"), (6, 0, "x"), (None, 1, "x"), (8, None, "x"), (9, 1, "x"), (9, 0, "x")], "doc_id long, toxic int, text string")
    texts, y = toxicity.sample(odd, labels, F.lit(True))
    assert len(texts) == len(y) == 4
    model = toxicity.fit(texts, y, epochs=2)
    got = toxicity.scored(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.fit([], []) is None and toxicity.fit(["a", "b"], [1, 1]) is None
    assert {r.score for r in toxicity.scored(odd, None).collect()} == {0.0}
    assert toxicity.scored(none, model).count() == 0
