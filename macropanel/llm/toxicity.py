"""Operator 2: toxicity by multiple-instance learning.

A text is a bag of sentences. Each sentence with at least one known feature has a probability
sigmoid(bias + sum of its features' weights); the text's score is their noisy-or with a leak:
1 - (1 - leak) * product(1 - p). Labels exist for texts only; the fit maximises their likelihood, so
weights settle on what the toxic texts' sentences share, and the same weights then point to the sentences.

Features are words (runs of letters, lower case) and their beginnings. They are chosen and fitted on a
bounded, documented sample of labelled texts: `max_rows` a class, drawn by a hash of the id. The
model that goes to the tasks has at most `max_features` entries. Scoring is a map over rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import give_back, sliced, table, unused

PIECE = 1_000_000
STARTS = range(4, 9)  # lengths of the beginnings that are features
REMEMBERED = 150_000  # tokens whose features a worker remembers
_LETTERS = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^\n]*?(?:[.!?]+(?=\s|$)|(?=\n)|$)", re.M)


def held_out(doc_id: str = "doc_id") -> Column:
    """The fold that never trains; rows without an id are not in it."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def token_features(token: str) -> list[str]:
    """Features of a token: its words, and their beginnings marked with `*`."""
    out = []
    for word in _LETTERS.findall(token):
        out.append(word)
        out += [word[:k] + "*" for k in STARTS if k <= len(word)]
    return out


def sentences(text: str) -> list[tuple[int, int]]:
    """Start and end of each sentence that is not white space."""
    return [m.span() for m in _SENTENCE.finditer(text) if m.group().strip()]


@dataclass
class Model:
    features: dict[str, int]
    weights: np.ndarray
    bias: float
    leak: float

    def __post_init__(self):
        self.tokens: dict[str, tuple[int, ...]] = {}

    def known(self, token: str) -> tuple[int, ...]:
        """The numbers of the features of a lower-case token that the model has."""
        found = self.tokens.get(token)
        if found is None:
            if len(self.tokens) >= REMEMBERED:
                self.tokens.clear()
            get = self.features.get
            found = self.tokens[token] = tuple(i for f in token_features(token) if (i := get(f)) is not None)
        return found

    def instances(self, text: str) -> list[tuple[int, int, list[int]]]:
        """The sentences with known features: start, end and the features' numbers."""
        text = text.lower()
        known = self.known
        if not any(map(known, set(text.split()))):
            return []
        out = []
        for start, end in sentences(text):
            have = {i for t in set(text[start:end].split()) for i in known(t)}
            if have:
                out.append((start, end, sorted(have)))
        return out

    def sentence_score(self, have: list[int]) -> float:
        return float(1 / (1 + np.exp(-(self.bias + self.weights[have].sum()))))

    def score(self, text: str) -> float:
        clean = 1 - self.leak
        for _, _, have in self.instances(text):
            clean *= 1 - self.sentence_score(have)
        return 1 - clean


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int, seed: int) -> tuple[DataFrame, dict[int, float]]:
    """`(text, label)` of the sample, and how many labelled rows each sampled row of a class stands for.

    Labels other than 0 and 1, null ids and the held-out fold are left out. Of repeated labels of an
    id the highest counts.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    n = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows
    share = {c: min(1.0, max_rows / n[c]) for c in n}
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 32)) / float(1 << 32)
    cut = F.lit(0.0)
    for label, part in share.items():
        cut = F.when(F.col("label") == label, F.lit(part)).otherwise(cut)
    sample = known.where(draw < cut)  # about 2 * max_rows ids at most
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(sample), "doc_id").select("text", "label"), {c: 1 / s for c, s in share.items()}


def _feature_counts(rows: DataFrame) -> DataFrame:
    """`(feature, toxic, clean)`: texts of each class that have it, summed within each task first."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = (Counter(), Counter())
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                count[label].update({f for t in set(text.lower().split()) for f in token_features(t)})
        names = list(count[1])  # a feature that no toxic text has is not wanted
        for at in range(0, len(names), 50_000):
            part = names[at : at + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.string()), pa.array([count[1][f] for f in part], pa.int64())], names=["feature", "toxic"]
            )
        count, names = (), []
        give_back()

    toxic = rows.where("label = 1").mapInArrow(run, "feature string, toxic long").groupBy("feature").agg(F.sum("toxic").alias("toxic"))
    return toxic.where("toxic >= 3")


def _clean_counts(rows: DataFrame, features: list[str]) -> Counter:
    """In how many clean texts of the sample each feature is."""
    wanted = rows.sparkSession.sparkContext.broadcast(frozenset(features))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, count = wanted.value, Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                count.update({f for t in set(text.lower().split()) for f in token_features(t)} & have)
        if count:
            yield pa.RecordBatch.from_arrays([pa.array(list(count)), pa.array(list(count.values()), pa.int64())], names=["feature", "clean"])
        give_back()

    found = rows.where("label = 0").select("text").mapInArrow(run, "feature string, clean long").groupBy("feature").agg(F.sum("clean").alias("clean"))
    return Counter({r["feature"]: r["clean"] for r in found.collect()})  # at most as many rows as features


def fit(docs: DataFrame, labels: DataFrame, *, max_rows: int = 8_000, max_features: int = 20_000, seed: int = 0, steps: int = 300) -> Model:
    """The model of a bounded sample. Without labelled rows of both classes it scores its leak alone."""
    rows, weight = training_rows(docs, labels, max_rows, seed)
    if set(weight) != {0, 1}:
        return Model({}, np.zeros(0), 0.0, 0.5 if not weight else float(1 in weight))
    rows = rows.persist()
    try:
        candidates = _feature_counts(rows).orderBy(F.desc("toxic"), "feature").limit(8 * max_features).collect()
        clean = _clean_counts(rows, [r["feature"] for r in candidates])
        size = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
        tells = []
        for r in candidates:
            pos, neg = r["toxic"], clean[r["feature"]]
            odds = np.log((pos + 0.5) / (size[1] + 1)) - np.log((neg + 0.5) / (size[0] + 1))
            if odds > 1.5:
                tells.append((-odds * np.sqrt(pos), r["feature"]))
        names = [f for _, f in sorted(tells)[:max_features]]
        blank = Model({f: i for i, f in enumerate(names)}, np.zeros(len(names)), -1.0, 0.01)
        shared = rows.sparkSession.sparkContext.broadcast(blank)

        def bags(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ends, have = [], []
                for text in batch.column("text").to_pylist():
                    found = list(dict.fromkeys(tuple(x) for _, _, x in shared.value.instances(text)))
                    ends.append(np.cumsum([len(x) for x in found]).astype("<i4").tobytes() if found else b"")
                    have.append(np.array([i for x in found for i in x], "<i4").tobytes())
                yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(ends, pa.binary()), pa.array(have, pa.binary())], names=["label", "ends", "have"])
            shared.value.tokens.clear()
            give_back()

        sample = rows.mapInArrow(bags, "label int, ends binary, have binary").toArrow()
    finally:
        rows.unpersist()
    return _maximise(blank, sample, weight, steps)


def _maximise(model: Model, sample: pa.Table, weight: dict[int, float], steps: int) -> Model:
    """Adam on the likelihood of the labels; all sentences of the sample at once."""
    label = sample["label"].to_numpy()
    bag, row, column, at = [], [], [], 0
    for text, (ends, have) in enumerate(zip(sample["ends"].to_pylist(), sample["have"].to_pylist())):
        ends, have = np.frombuffer(ends, "<i4"), np.frombuffer(have, "<i4")
        bag.append(np.full(len(ends), text))
        row.append(at + np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0)))
        column.append(have)
        at += len(ends)
    bag, row, column = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (bag, row, column))
    cost = np.array([weight[0], weight[1]])[label]
    cost = cost / cost.sum()
    n, k = len(label), len(model.weights)
    x = np.zeros(k + 2)  # weights, bias, leak as a logit
    x[k], x[k + 1] = -1.0, -4.0
    first, second = np.zeros(k + 2), np.zeros(k + 2)
    for step in range(1, steps + 1):
        z = x[k] + np.bincount(row, x[:k][column], minlength=at)[:at]
        p = 1 / (1 + np.exp(-z))
        leak = 1 / (1 + np.exp(-x[k + 1]))
        clean = np.clip((1 - leak) * np.exp(np.bincount(bag, np.log1p(-np.clip(p, 0, 1 - 1e-12)), minlength=n)), 1e-12, 1 - 1e-9)
        # d(-log likelihood) / d log(clean)
        slope = cost * np.where(label == 1, clean / (1 - clean), -1.0)
        at_sentence = -slope[bag] * p  # d log(1 - p) / dz = -p
        grad = np.concatenate([np.bincount(column, at_sentence[row], minlength=k)[:k] + 2e-5 * x[:k], [at_sentence.sum(), -(slope * leak).sum()]])
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad**2
        x -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
    return Model(model.features, x[:k].copy(), float(x[k]), float(1 / (1 + np.exp(-x[k + 1]))))


def score(docs: DataFrame, model: Model, *, to: str = "score") -> DataFrame:
    """`docs` with its score (null and empty texts: the leak). Every other column passes unchanged; one named `to` is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most max_features entries
    docs = docs.drop(to)
    names, whole = docs.columns, unused(docs.withColumn(to, F.lit(0.0)), "whole_text")
    schema = docs.withColumn(to, F.lit(0.0)).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in sliced(batches, PIECE, whole):
            found = [own.score(t) for t in batch.column(whole).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(found, pa.float64())], names=[*names, to])
        own.tokens.clear()  # the worker may go on with other work
        give_back()

    return docs.withColumn(whole, F.coalesce("text", F.lit(""))).mapInArrow(run, schema)


def offending_sentences(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """`(doc_id, start, end, score, sentence)` of the sentences scored at or above `threshold`; positions in code points.

    Lower-casing that changes a text's length (a few letters do) shifts the positions behind it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in sliced(batches, PIECE):
            out = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                for start, end, have in own.instances(text):
                    if (p := own.sentence_score(have)) >= threshold:
                        out.append((doc, start, end, p, text[start:end]))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["doc_id", "start", "end", "score", "sentence"])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, start long, end long, score double, sentence string")


def toxicity_report(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, **options) -> DataFrame:
    """`doc_id, held_out, score, predicted` of every row of `docs`.

    The score looks at the text alone. Rows without an id are scored, too, and not held out. Without
    labels of both classes every score is one constant. An empty table gives no rows.
    """
    scored = score(docs.select("doc_id", "text"), fit(docs, labels, **options))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, **options) -> DataFrame:
    """The rows of `docs` that score below the threshold, unchanged."""
    names, to = docs.columns, unused(docs, "toxicity")
    return score(docs, fit(docs, labels, **options), to=to).where(F.col(to) < threshold).select(*names)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
