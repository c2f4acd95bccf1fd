import random

from macropanel.llm import toxicity
from pyspark.sql import functions as F

GOOD = "the river runs slowly past a quiet town where people sell bread and fish".split()


def corpus(spark, n=1200):
    rng = random.Random(5)
    rows, labels, where = [], [], {}
    for i in range(n):
        says = [" ".join(rng.choices(GOOD, k=8)).capitalize() + "." for _ in range(rng.randint(1, 12))]
        bad = i % 4 == 0
        if bad:
            at = rng.randrange(len(says))
            says[at] = f"You are a {rng.choice(['grumbo', 'vexlor', 'vexlix', 'vexlum'])} and {rng.choice(GOOD)}."
            where[i] = says[at]
        rows.append((i, " ".join(says), None))
        labels.append((i, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, score double"), spark.createDataFrame(labels, "doc_id long, toxic int"), where


def test_finds_texts_and_sentences_it_was_not_trained_on(spark):
    docs, labels, where = corpus(spark)
    model = toxicity.fit(docs, labels, max_rows=400)
    rows = toxicity.toxicity_report(docs, labels, max_rows=400).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1200 and 200 < len(held) < 400
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in held) / len(held) > 0.98
    found = {(r.doc_id, r.sentence.strip()) for r in toxicity.offending_sentences(docs, model).collect()}
    truth = {(i, s.lower()) for i, s in where.items()}
    assert len({(i, s.lower()) for i, s in found} & truth) > 0.95 * len(truth) and len(found) < 1.05 * len(truth)
    kept = toxicity.drop_toxic(docs, labels, max_rows=400)
    assert kept.columns == docs.columns and kept.where("doc_id % 4 <> 0").count() > 890 and kept.where("doc_id % 4 = 0").count() < 6


def test_fold_and_held_out_labels_do_not_matter(spark):
    docs, labels, _ = corpus(spark, 300)
    other = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, other)
    assert a.features == b.features and (a.weights == b.weights).all()


def test_odd_rows_and_missing_labels(spark, odd_docs, no_docs):
    docs, labels, _ = corpus(spark, 300)
    rows = toxicity.toxicity_report(odd_docs, labels.limit(0)).collect()
    assert len(rows) == odd_docs.count() and len({r.score for r in rows}) == 1
    assert all(r.held_out is not None for r in rows)
    model = toxicity.fit(docs, labels)
    assert toxicity.score(odd_docs, model).count() == odd_docs.count()
    assert toxicity.toxicity_report(no_docs, labels).count() == 0


def test_sentences():
    text = "One. Two!\nThree 3.5 is no end? \n\n  \nlast"
    assert [text[a:b].strip() for a, b in toxicity.sentences(text)] == ["One.", "Two!", "Three 3.5 is no end?", "last"]
