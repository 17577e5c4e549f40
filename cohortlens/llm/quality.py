"""Quality classifier: supervised subword embeddings.

A document is the average of its word vectors, a word the average of the learned vectors of its hashed
features: the word itself, its character n-grams with word boundaries, and a mark when it repeats the word
before. Softmax over the labels, trained by stochastic gradient descent in numpy.

Training takes at most ``SAMPLE`` labelled documents per label, those of the smallest key hashes; each
becomes a vector of feature weights where it is read, and one task fits the model on these. The model
travels back with the labels' true mix restored: the bias gets the log ratio of the labels' counts over
that of the sample, so scores mean the same at every size. It is one score per feature: as averages and the layer above are linear, a document's score is the
average of its words' scores. Scoring is one pass without a shuffle.

Defined results: a null or empty text has no words and gets the score of the bias alone; a text of any
length is scored whole; labels that are null or without a document are not learned from, and repeated
labels of a document count once each; without labelled rows, or with one label only, every score is the
share of label 1 (0.5 without any); documents with equal hashes are sampled in the order of their keys; an empty
table gives an empty result; columns that clash with results are kept beside a longer name.
"""

from __future__ import annotations

import math
import operator
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import fresh, map_rows, struct

SAMPLE = 2048
BUCKETS = 1 << 18
NGRAMS = (3, 4)
DIMENSION = 8
EPOCHS = 6
# Small samples are gone through more often, for so many steps at least.
STEPS = 12_000
RATE = 40.0
THRESHOLD = 0.7
SEED = 11
CACHE = 400_000
MARK = "\x00again"


def features(word: str) -> list[int]:
    """Hashed features of a word, or of the repetition mark."""
    raw = word.encode("utf-8", "surrogatepass")
    found = [zlib.crc32(raw) % BUCKETS]
    if word != MARK:
        bounded = b"<" + raw + b">"
        for n in NGRAMS:
            found += [
                zlib.crc32(bounded[i : i + n], n) % BUCKETS for i in range(len(bounded) - n + 1)
            ]
    return found


def tokens(text: str | None) -> list[str]:
    """The words of a text, and a mark for each that repeats the word before."""
    words = (text or "").split()
    return words + [MARK] * sum(map(operator.eq, words, words[1:]))


class Cached(dict):
    """A function of words that remembers its results; emptied when full, so memory stays bounded."""

    def __init__(self, compute):
        super().__init__()
        self.compute = compute

    def __missing__(self, word: str):
        if len(self) >= CACHE:
            self.clear()
        value = self[word] = self.compute(word)
        return value


def weights(text: str | None, known=features) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and weights of a document; the weights add up to 1, or there are none."""
    counts = Counter(tokens(text))
    total = sum(counts.values())
    found, parts = [], []
    for word, n in counts.items():
        own = known(word)
        found += own
        parts += [n / total / len(own)] * len(own)
    index, place = np.unique(np.array(found, np.int64), return_inverse=True)
    return index.astype(np.int32), np.bincount(place, np.array(parts)).astype(np.float32)


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
    """One score per feature and, last, the bias: the difference of the two labels' logits."""
    labels = np.array([r[2] for r in rows], np.int64)
    share = labels.mean() if len(labels) else 0.5
    scores = np.zeros(BUCKETS + 1)
    if share in (0, 1) or not len(labels):
        scores[-1] = np.log((share + 1e-3) / (1 - share + 1e-3)) if len(labels) else 0.0
        return scores
    random = np.random.default_rng(SEED)
    vectors = random.uniform(-1 / DIMENSION, 1 / DIMENSION, (BUCKETS, DIMENSION)).astype(np.float32)
    layer = np.zeros((DIMENSION, 2), np.float32)
    bias = np.zeros(2, np.float32)
    epochs = max(EPOCHS, -(-STEPS // len(rows)))
    steps, step = epochs * len(rows), 0
    for _ in range(epochs):
        for i in random.permutation(len(rows)):
            index, weight, label = rows[i]
            left = 1 - step / steps
            step += 1
            hidden = weight @ vectors[index]
            logits = hidden @ layer + bias
            error = np.exp(logits - logits.max())
            error /= error.sum()
            error[label] -= 1
            back = layer @ error
            layer -= 0.5 * left * np.outer(hidden, error)
            bias -= 0.05 * left * error
            # A short document's few weights are large; a step moves its average by the gradient at most.
            rate = min(RATE, 1 / max(float(weight @ weight), 1e-9))
            vectors[index] -= (rate * left) * np.outer(weight, back)
    scores[:-1] = vectors @ (layer[:, 1] - layer[:, 0])
    scores[-1] = bias[1] - bias[0]
    return scores


def sample(
    docs: DataFrame, labels: DataFrame, label: str, key: str, text: str, size: int = SAMPLE
) -> DataFrame:
    """(text, label): at most ``size`` documents of each label, those of the smallest key hashes.

    Keys with equal hashes are taken in their own order.
    """
    marked = _marked(docs, labels, label, key)
    order = [F.xxhash64("k"), F.col("k")]
    parts = [marked.filter(F.col("label") == v).orderBy(*order).limit(size) for v in (0, 1)]
    # At most 2 x size rows are broadcast; a key that occurs several times gives one text.
    chosen = parts[0].unionByName(parts[1])
    texts = docs.select(F.col(key).alias("k"), F.col(text).alias("text"))
    return (
        texts.join(F.broadcast(chosen), "k")
        .groupBy("k", "label")
        .agg(F.min("text").alias("text"))
    )


def _marked(docs: DataFrame, labels: DataFrame, label: str, key: str) -> DataFrame:
    """(k, label) of the documents that have labels."""
    marked = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("label"))
    marked = marked.filter(F.col("label").isin(0, 1)).distinct()
    return marked.join(docs.select(F.col(key).alias("k")), "k", "left_semi")


def mix_shift(counts: dict[int, int], size: int) -> float:
    """What the bias lacks of the labels' true log ratio when at most ``size`` of each were learned from."""
    if not counts.get(0) or not counts.get(1):
        return 0.0
    true = math.log(counts[1] / counts[0])
    return true - math.log(min(counts[1], size) / min(counts[0], size))


def train(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    key: str = "doc_id",
    text: str = "text",
    size: int = SAMPLE,
) -> np.ndarray:
    """The fitted model: one score per feature bucket and the bias, about 1 MB."""
    chosen = sample(docs, labels, label, key, text, size)

    def make():
        known = Cached(features).__getitem__

        def compute(batch):
            found = [weights(t, known) for t in batch.column("text").to_pylist()]
            return {"i": [i.tobytes() for i, _ in found], "w": [w.tobytes() for _, w in found]}

        return compute

    rows = map_rows(chosen, make, struct("i binary, w binary"), ["k", "label"])

    def learn(frames):
        # Bounded by the sample: one row per chosen document, in an order that does not depend on tasks.
        parts = [f for f in frames if len(f)]
        found = pd.concat(parts).sort_values(["k", "label"]) if parts else None
        examples = [] if found is None else [
            (np.frombuffer(i, np.int32), np.frombuffer(w, np.float32), label)
            for i, w, label in zip(found["i"], found["w"], found["label"])
        ]
        yield pd.DataFrame({"scores": [fit(examples).astype(np.float32).tobytes()]})

    found = rows.repartition(1).mapInPandas(learn, "scores binary").first()
    model = np.frombuffer(found.scores, np.float32).copy() if found else fit([]).astype(np.float32)
    counts = _marked(docs, labels, label, key).groupBy("label").count().collect()
    model[-1] += mix_shift({r.label: r["count"] for r in counts}, size)
    return model


def score(
    docs: DataFrame, model: np.ndarray, text: str = "text", name: str = "score", keep=None
) -> tuple[DataFrame, str]:
    """``docs`` with the probability of label 1, and the name of that column."""
    keep = docs.columns if keep is None else keep
    column = fresh(docs.select(*keep), name)

    def make():
        values, bias = model[:-1].astype(np.float64), float(model[-1])

        def worth(word: str) -> float:
            own = features(word)
            return float(values[own].sum()) / len(own)

        known = Cached(worth).__getitem__

        def one(value: str | None) -> float:
            found = tokens(value)
            total = sum(map(known, found)) / len(found) if found else 0.0
            return float(1 / (1 + np.exp(-np.clip(total + bias, -700, 700))))

        return lambda batch: {column: [one(t) for t in batch.column(text).to_pylist()]}

    return map_rows(docs, make, struct(f"`{column}` double"), keep), column


def held_out(key: str) -> Column:
    """Rows never learned from: the CRC of the key as text leaves remainder 2 by 4."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def report(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per document: held out or not, score, and 1 where the score reaches the threshold."""
    model = train(docs, labels.filter(~held_out(key)), key=key, text=text)
    scored, column = score(docs, model, text, keep=[key])
    return scored.select(
        key,
        held_out(key).alias("held_out"),
        F.col(column).alias("score"),
        (F.col(column) >= THRESHOLD).cast("int").alias("predicted"),
    )


def drop_rejected(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The documents whose score reaches the threshold, with their own columns."""
    model = train(docs, labels.filter(~held_out(key)), key=key, text=text)
    scored, column = score(docs, model, text)
    return scored.filter(F.col(column) >= THRESHOLD).select(*docs.columns)
