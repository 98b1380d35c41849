"""Toxic documents and the sentences that make them so, learned from labels of whole documents.

Multiple-instance learning: a document is a bag of sentences, each sentence has a probability of its own, and the
document's is their noisy-or, ``1 - prod(1 - p)``.  Only document labels are needed for training; the gradient of a toxic
document falls mainly on the sentences that explain its label, so the model learns which sentences offend.

The model is fitted on a bounded sample of labelled documents (``sample`` of either class at most, none longer than
``sample_chars``); class weights restore the proportions of all labelled rows.  Tasks number the features of the sample, and
the driver holds 4 bytes for each of a sentence, without the texts.  Scoring reads every whole text once,
with no shuffle; the model that travels to the tasks is bounded by the sample.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lineloom.llm.rows import carried
from lineloom.workspace import Workspace

SAMPLE = 2_000
SAMPLE_CHARS = 20_000
MIN_DOCS = 4
TOXIC_WEIGHT = 3.0  # a missed toxic document counts as this many falsely rejected ones
THRESHOLD = 0.7
OFFENSIVE = 0.5

_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
_WORDS = re.compile(r"[^\W\d_]+")
_CACHE_WORDS = 300_000
_PIECES = 24  # files of the sample
_BLOCK = 1 << 18  # features that are handled at a time


def sentences(text: str | None) -> list[tuple[int, int]]:
    """Spans in code points: up to a full stop, an exclamation or question mark, or the end of the line."""
    return [m.span() for m in _SENTENCE.finditer(text)] if text else []


def word_features(word: str) -> list[str]:
    """The word, and its beginnings: inflected and compound forms share these."""
    return ["=" + word] + [word[:n] for n in (3, 4, 5, 6) if len(word) >= n]


@dataclass
class ToxicityModel:
    bias: float
    weights: dict[str, float]

    def word_weight(self, word: str) -> float:
        weights = self.weights
        return sum(weights[f] for f in word_features(word) if f in weights)


@dataclass
class Bags:
    """Neighbouring documents of a sample: numbers of features, sentence by sentence; how many each sentence has; how many sentences each document has."""
    features: np.ndarray
    lengths: np.ndarray
    counts: np.ndarray


def _sentence_words(text: str | None) -> Iterator[set[str]]:
    return (set(_WORDS.findall(text[start:end].lower())) for start, end in sentences(text))


def _document_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every feature of a task's texts and how many of these hold it."""
    counts: Counter[str] = Counter()
    for batch in batches:
        for text in batch.column("text").to_pylist():
            own = set().union(*_sentence_words(text))
            counts.update({f for word in own for f in word_features(word)})
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["feature", "n"]
    )


def _number(names: list[str]):
    """Numbers of the features ``names`` in each sentence, each once and in order, and how many a sentence has."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {f: i for i, f in enumerate(names)}
        known: dict[str, list[int]] = {}
        for batch in batches:
            features, lengths = [], []
            for text in batch.column("text").to_pylist():
                own, sizes = array("i"), array("i")
                for words in _sentence_words(text):
                    held: set[int] = set()
                    for word in words:
                        numbers = known.get(word)
                        if numbers is None:
                            if len(known) >= _CACHE_WORDS:
                                known.clear()
                            numbers = known[word] = [place[f] for f in word_features(word) if f in place]
                        held.update(numbers)
                    own.extend(sorted(held))
                    sizes.append(len(held))
                features.append(own.tobytes())
                lengths.append(sizes.tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("is_toxic"), pa.array(features, pa.binary()), pa.array(lengths, pa.binary())],
                ["doc_id", "is_toxic", "features", "lengths"],
            )

    return run


def _blocks(rows: list[tuple]) -> list[Bags]:
    """``rows`` of bytes as arrays of some ``_BLOCK`` features; it uses the rows up, so nothing is held twice."""
    rows.reverse()
    blocks = []
    while rows:
        features, lengths, size = [], [], 0
        while rows and size < _BLOCK:
            own, sizes = rows.pop()
            features.append(np.frombuffer(own, np.int32))
            size += len(features[-1])
            lengths.append(np.frombuffer(sizes, np.int32))
        blocks.append(Bags(np.concatenate(features), np.concatenate(lengths), np.array([len(x) for x in lengths], np.int32)))
    return blocks


def fit(
    names: list[str], blocks: list[Bags], labels: list[int], class_weight: tuple[float, float] = (1.0, 1.0),
    rounds: int = 120, rate: float = 0.1, sparsity: float = 3e-4, start: float = -6.0,
) -> ToxicityModel:
    """Adam on the noisy-or likelihood of the document labels; ``sparsity`` shrinks weights that explain little to 0.

    ``labels`` are those of the documents in ``blocks``, in order, and ``names`` those of the numbered features.  Besides the blocks
    (4 bytes a feature of a sentence) a round holds arrays of one block.
    """
    y = np.array(labels, bool)
    weight = np.where(y, class_weight[1], class_weight[0])
    weight = weight / weight.sum()
    theta = np.zeros(len(names) + 1)
    theta[-1] = start
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    by_sentence = np.zeros(sum(len(block.lengths) for block in blocks))
    for step in range(1, rounds + 1):
        gradient = np.zeros_like(theta)
        document = place = 0
        for block in blocks:
            here = slice(document, document := document + len(block.counts))
            pulled = by_sentence[place:(place := place + len(block.lengths))]
            sentence = np.repeat(np.arange(len(block.lengths)), block.lengths)
            owners = np.repeat(np.arange(len(block.counts)), block.counts)
            z = theta[-1] + np.bincount(sentence, theta[block.features], minlength=len(block.lengths))
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            log_clean = np.bincount(owners, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(block.counts))
            clean = np.exp(log_clean)
            # d(-log likelihood)/dz: p for a clean document, -p * clean / (1 - clean) for a toxic one
            pull = np.where(y[here], -clean / np.maximum(1 - clean, 1e-9), 1.0) * weight[here]
            pulled[:] = p * pull[owners]
            np.add.at(gradient, block.features, pulled[sentence])
        gradient[-1] = by_sentence.sum()
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        scale = rate / (np.sqrt(second / (1 - 0.99**step)) + 1e-10)
        theta -= scale * first / (1 - 0.9**step)
        shrunk = np.abs(theta[:-1]) - scale[:-1] * sparsity
        theta[:-1] = np.sign(theta[:-1]) * np.maximum(shrunk, 0)
    kept = np.flatnonzero(np.abs(theta[:-1]) > 1e-3)
    return ToxicityModel(float(theta[-1]), {names[i]: float(theta[i]) for i in kept})


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels are never learned from; a missing id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS, min_docs: int = MIN_DOCS, **options
) -> ToxicityModel:
    """Fit on labelled documents that are not held out.

    Of each class at most ``sample`` labelled ids are taken, in the order of a hash, so reruns agree.  An id with several labels
    is toxic if one of them says so; missing labels and ids are skipped.  Only features of ``min_docs`` sampled documents count.
    Tasks cut the sample into sentences and numbered features; the driver gets these, never a text.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
    usable = usable.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("is_toxic"))
    totals = {r["is_toxic"]: r["n"] for r in usable.groupBy("is_toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = [
        usable.where(F.col("is_toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for kind in (0, 1)
    ]
    chosen = F.broadcast(picked[0].unionByName(picked[1]))  # 2 * sample ids at most
    short = docs.where(F.length("text") <= sample_chars).select("doc_id", "text")
    # repeated rows of one id add nothing, and are left out of the sample
    rows = short.join(chosen, "doc_id").groupBy("doc_id").agg(
        F.min("text").alias("text"), F.max("is_toxic").alias("is_toxic")
    )
    workspace = Workspace(docs.sparkSession)
    rows = workspace.table(rows.repartition(_PIECES), "sample")
    sampled = {r["is_toxic"]: r["n"] for r in rows.groupBy("is_toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sampled) < 2:  # one class only, or no rows: a constant
        workspace.close()
        return ToxicityModel(bias=0.0 if 1 in sampled else -12.0, weights={})
    counts = rows.select("text").mapInArrow(_document_counts, "feature string, n bigint")
    frequent = counts.groupBy("feature").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs).select("feature")
    names = sorted(frequent.toArrow().column("feature").to_pylist())
    schema = T.StructType([rows.schema["doc_id"], rows.schema["is_toxic"], T.StructField("features", T.BinaryType()), T.StructField("lengths", T.BinaryType())])
    numbered = workspace.table(rows.select("doc_id", "is_toxic", "text").mapInArrow(_number(names), schema), "bags")
    bags = sorted(numbered.toLocalIterator(), key=lambda r: r["doc_id"])
    workspace.close()
    labels_ = [r["is_toxic"] for r in bags]
    bags = [(r["features"], r["lengths"]) for r in bags]
    clean, toxic = (totals.get(kind, 0) / sampled[kind] for kind in (0, 1))
    return fit(names, _blocks(bags), labels_, (clean, toxic * TOXIC_WEIGHT), **options)


def _score(model: ToxicityModel, offensive: float):
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        floor = -np.log1p(-offensive) if 0 < offensive < 1 else 0.0
        for batch in batches:
            scores, found = [], []
            for text in batch.column("text").to_pylist():
                spans = sentences(text)
                sums = []
                for start, end in spans:
                    total = model.bias
                    for word in set(_WORDS.findall(text[start:end].lower())):
                        w = known.get(word)
                        if w is None:
                            if len(known) >= _CACHE_WORDS:
                                known.clear()
                            w = known[word] = model.word_weight(word)
                        total += w
                    sums.append(total)
                load = np.logaddexp(0.0, np.array(sums)) if sums else np.zeros(0)  # -log(1 - p) of each sentence
                scores.append(float(-np.expm1(-load.sum())))
                found.append([
                    {"start": spans[i][0], "end": spans[i][1], "score": float(-np.expm1(-load[i]))}
                    for i in np.flatnonzero(load >= floor)
                ])
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(scores, pa.float64()), pa.array(found, pa.list_(span))],
                ["row", "score", "offending"],
            )

    return run


def score(docs: DataFrame, model: ToxicityModel, offensive: float = OFFENSIVE) -> DataFrame:
    """Columns ``row`` (the input row), ``score`` and ``offending``: spans of sentences scored ``offensive`` or more.

    A null, empty or punctuation-only text has no sentence and scores 0.  Rows are scored one by one, so repeated rows
    agree.
    """
    base = carried(docs, "text")
    span = T.StructType([
        T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())
    ])
    schema = T.StructType([
        T.StructField("row", base.schema["row"].dataType), T.StructField("score", T.DoubleType()),
        T.StructField("offending", T.ArrayType(span)),
    ])
    return base.mapInArrow(_score(model, offensive), schema)


def toxicity_report(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return scored.select(
        F.col("row.doc_id").alias("doc_id"),
        held_out("row.doc_id").alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        "offending",
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """The documents, all columns as they are, that score below ``threshold``."""
    return score(docs, train(docs, labels, **options)).where(F.col("score") < threshold).select("row.*")
