import random

import numpy as np
from pyspark.sql import functions as F
from tests.llm.texts import docs, odd_texts, prose

from tidelog.llm import toxicity

BAD = ["vilething", "grubface", "snotrag"]


def corpus(spark, n=600):
    rng = random.Random(1)
    rows, marks = [], []
    for i in range(n):
        toxic = i % 4 == 0
        text = prose(rng, rng.randint(5, 80))
        if toxic:
            words = text.split()
            words.insert(rng.randint(0, len(words)), rng.choice(BAD))
            text = " ".join(words)
        rows.append((i, text))
        marks.append((i, 0, int(toxic != (rng.random() < 0.04))))
    return rows, docs(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_options(spark):
    rows, table, labels = corpus(spark)
    model = toxicity.train(table, labels)
    scored = {r["doc_id"]: r for r in toxicity.score_toxicity(table, model).withColumn("h", toxicity.held_out(F.col("doc_id"))).collect()}
    right = [(r["toxicity"] >= 0.5) == (i % 4 == 0) for i, r in scored.items() if r["h"]]
    assert len(right) > 60 and np.mean(right) > 0.97
    assert toxicity.train(table, labels, most=50).weights.any()


def test_one_word_in_a_very_long_text(spark):
    rows, table, labels = corpus(spark)
    model = toxicity.train(table, labels)
    long = prose(random.Random(3), 20_000)
    assert toxicity.scores([long], model)[0] < 0.5 <= toxicity.scores([long + " vilething"], model)[0]
    # A text's score doesn't depend on those beside it.
    together = toxicity.scores([r[1] for r in rows[:50]], model)
    alone = np.concatenate([toxicity.scores([r[1]], model) for r in rows[:50]])
    assert np.allclose(together, alone, atol=1e-6)


def test_long_clean_texts_stay(spark):
    """Neither length nor words never seen in training make a text toxic, and an insult in them is still found."""
    rows, table, labels = corpus(spark)
    model = toxicity.train(table, labels)
    rng = random.Random(9)
    known = " ".join(t for i, t in rows if i % 4)
    for size in (200_000, 1_000_000, 5_000_000):
        fresh = " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9))) for _ in range(size // 7))
        for text in (fresh, (known + " ") * (size // len(known) + 1), fresh[: size // 2] + " " + known):
            middle = text.index(" ", len(text) // 2)
            bad = text[:middle] + " grubface" + text[middle:]
            assert toxicity.scores([text], model)[0] < 0.5 <= toxicity.scores([bad], model)[0]


def test_held_out_labels_and_other_columns_are_never_used(spark):
    rows, table, labels = corpus(spark)
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.train(table, labels), toxicity.train(table, flipped)
    assert np.allclose(a.weights, b.weights) and a.bias == b.bias


def test_odd_texts_and_empty_tables(spark):
    _, table, labels = corpus(spark, 200)
    model = toxicity.train(table, labels)
    odd = docs(spark, list(enumerate(odd_texts())) + [(3, "a"), (3, "a")])
    out = toxicity.score_toxicity(odd, model)
    got = [r["toxicity"] for r in out.collect()]
    assert len(got) == len(odd_texts()) + 2 and all(0 <= s <= 1 for s in got)
    assert out.columns == [c for c in odd.columns if c != "toxicity"] + ["toxicity"]
    assert toxicity.score_toxicity(docs(spark, []), model).collect() == []
    kept = toxicity.keep_clean(odd, model)
    assert kept.dtypes == odd.dtypes and {r["toxicity"] for r in kept.collect()} == {"x"}


def test_labels_that_teach_nothing(spark):
    _, table, labels = corpus(spark, 40)
    for some in (labels.limit(0), labels.withColumn("toxic", F.lit(0)), labels.withColumn("toxic", F.lit(None).cast("int"))):
        model = toxicity.train(table, some)
        assert not model.weights.any() and toxicity.scores(["x"], model)[0] < 0.5
    twice = labels.unionByName(labels).withColumn("toxic", F.lit(1))
    assert toxicity.scores(["x"], toxicity.train(table, twice))[0] > 0.5
