"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the bag of its own hash and the hashes of the character 3- to 5-grams of `<word>`, each with a vector in a table
of BUCKETS rows. A document's vector is the mean over its distinct words of the mean over the word's bag; a softmax of two
classes reads it. Vectors and softmax are trained jointly. A misspelt word shares most n-grams with the right one.

Texts without words (null, empty, white space) have the score of the bias alone. Repeated rows get equal scores. Without
a labelled row of either class every score is the share of toxic labels, 0.5 if there are none at all.
"""

from __future__ import annotations

import itertools
import math
import re
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import storage

BUCKETS = 1 << 18
DIMENSIONS = 8
#: The bounded sample of labelled rows that the classifier is fit on: so many of each class, none longer than so many bytes.
SAMPLE_PER_CLASS = 3000
SAMPLE_BYTES = 12_000
EPOCHS = 6
BATCH = 64
RATE = 0.5
FIRST_SQUARE = 1e-5  # what the sum of squared slopes begins with: rare n-grams take smaller steps
SCALE = 64.0  # of the mean, so that a single word of a long document can decide
CACHE_WORDS = 300_000
TOXIC_WEIGHT = 0.4  # of the loss; toxic documents are rarer than in the sample
SEED = 7
_WORD = re.compile(r"\w+")


def word_buckets(word: str) -> list[int]:
    """Rows of the vector table for a word: hashes of `<word>` and of each of its n-grams, equal ones once."""
    marked = f"<{word}>"
    grams = {marked, *(marked[i : i + n] for n in (3, 4, 5) for i in range(len(marked) - n + 1))}
    return [zlib.crc32(g.encode("utf-8", "replace")) % BUCKETS for g in grams]


def distinct_words(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


@dataclass
class Model:
    table: np.ndarray  # BUCKETS x DIMENSIONS
    softmax: np.ndarray  # DIMENSIONS x 2
    bias: np.ndarray

    def bucket_logits(self) -> np.ndarray:
        """What each row of the table adds to the difference of the classes' logits, before the means."""
        return self.table @ (self.softmax[:, 1] - self.softmax[:, 0]) * SCALE


def _numbered(texts: Iterable[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Each text's distinct words by number, the rows of all words' bags one after the other, and their sizes."""
    seen: dict[str, int] = {}
    numbers, ends, bags, sizes = array("i"), [0], array("i"), array("i")
    for text in texts:
        for word in sorted(distinct_words(text)):
            number = seen.get(word)
            if number is None:
                number = seen[word] = len(seen)
                bag = sorted(word_buckets(word))
                bags.extend(bag)
                sizes.append(len(bag))
            numbers.append(number)
        ends.append(len(numbers))
    flat = np.frombuffer(numbers, np.int32) if numbers else np.zeros(0, np.int32)
    return [flat[a:b] for a, b in itertools.pairwise(ends)], np.array(bags, np.int32), np.array(sizes, np.int64)


def train(texts: Iterable[str], labels: np.ndarray, epochs: int = EPOCHS) -> Model:
    rng = np.random.default_rng(SEED)
    table = (rng.random((BUCKETS, DIMENSIONS), np.float32) - np.float32(0.5)) / DIMENSIONS
    softmax = ((rng.random((DIMENSIONS, 2)) - 0.5) / DIMENSIONS).astype(np.float32)
    labels = np.asarray(labels, np.int64)
    share = labels.mean() if len(labels) else 0.5
    bias = np.log(np.clip([1 - share, share], 1e-6, 1)).astype(np.float32)
    if len(set(labels.tolist())) < 2:
        return Model(table * 0, softmax, bias)
    docs, flat, size = _numbered(texts)
    start = np.cumsum(size) - size
    weight = np.where(labels == 1, TOXIC_WEIGHT / share, (1 - TOXIC_WEIGHT) / (1 - share))
    squares, softmax_squares, bias_squares = np.full(BUCKETS, FIRST_SQUARE), np.full(softmax.shape, 1e-4), np.full(2, 1e-4)
    steps, step = epochs * -(-len(docs) // BATCH), 0
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for b in range(0, len(order), BATCH):
            pick = [i for i in order[b : b + BATCH] if len(docs[i])]
            rate = RATE * (1 - step / steps)
            step += 1
            if not pick:
                continue
            many = np.array([len(docs[i]) for i in pick])
            row = np.repeat(np.arange(len(pick)), many)
            words, place = np.unique(np.concatenate([docs[i] for i in pick]), return_inverse=True)
            n = size[words]
            ends = np.cumsum(n)
            feature = flat[np.repeat(start[words] - (ends - n), n) + np.arange(ends[-1])]
            vector = np.add.reduceat(table[feature], ends - n) / n[:, None]  # of each word of the batch
            share_of = SCALE / many[row]
            mean = np.stack([np.bincount(row, vector[place, d] * share_of, len(pick)) for d in range(DIMENSIONS)], 1)
            logits = mean @ softmax + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(pick)), labels[pick]] -= 1
            p *= weight[pick][:, None] / len(pick)
            # two classes: every vector's slope lies along the difference of the softmax's columns
            along = (softmax[:, 1] - softmax[:, 0]).astype(np.float32)
            by_word = np.bincount(place, p[row, 1] * share_of, len(words)) / n
            touched, at = np.unique(feature, return_inverse=True)
            change = np.bincount(at, np.repeat(by_word, n), len(touched))
            slope, lean = mean.T @ p, p.sum(0)
            softmax_squares += slope**2
            softmax -= (rate * slope / np.sqrt(softmax_squares)).astype(np.float32)
            bias_squares += lean**2
            bias -= (rate * lean / np.sqrt(bias_squares)).astype(np.float32)
            squares[touched] += change**2 * float(along @ along)
            table[touched] -= (rate * change / np.sqrt(squares[touched]))[:, None].astype(np.float32) * along
    return Model(table, softmax, bias)


def labelled_sample(documents: DataFrame, labels: DataFrame, learn: Column, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """text and toxic of at most per_class rows of each class where learn is true, those with the least hash of their id."""
    known = labels.where(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    short = documents.where(learn & (F.octet_length("text") <= SAMPLE_BYTES)).select("doc_id", "text")
    key = F.xxhash64(F.lit(SEED), "doc_id")
    each = [known.where(F.col("toxic") == c).join(short.select("doc_id"), "doc_id").orderBy(key, "doc_id").limit(per_class) for c in (0, 1)]
    found = short.join(F.broadcast(each[0].union(each[1])), "doc_id").select("doc_id", "text", "toxic")  # 2 * per_class ids
    return found.orderBy(key, "doc_id", F.xxhash64("text")).limit(2 * per_class)  # an id may stand in many rows


def fit(documents: DataFrame, labels: DataFrame, learn: Column) -> Model:
    rows = sorted(labelled_sample(documents, labels, learn).collect(), reverse=True)
    toxic = np.array([r.toxic for r in reversed(rows)], np.int64)
    return train((rows.pop().text for _ in range(len(rows))), toxic)  # a text that is numbered needs no memory


def _scores(sent, name: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        bias, each = sent.value[0], sent.value[1].tolist()
        for batch in batches:
            logits = np.full(batch.num_rows, bias)
            for i, text in enumerate(batch.column("text").to_pylist()):
                found = distinct_words(text or "")
                if not found:
                    continue
                total = []
                for word in found:
                    own = known.get(word)
                    if own is None:
                        rows = word_buckets(word)
                        own = known[word] = math.fsum(each[r] for r in rows) / len(rows)
                    total.append(own)
                logits[i] += math.fsum(total) / len(total)  # in any order the same
            if len(known) > CACHE_WORDS:
                known.clear()
            score = 1 / (1 + np.exp(-np.clip(logits, -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*batch.schema.names, name])

    return run


def with_scores(documents: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """All columns of the documents and the probability of label 1."""
    storage.small_batches(documents.sparkSession)
    sent = documents.sparkSession.sparkContext.broadcast((float(model.bias[1] - model.bias[0]), model.bucket_logits()))  # BUCKETS numbers
    schema = T.StructType([*documents.schema.fields, T.StructField(name, T.DoubleType())])
    return documents.mapInArrow(_scores(sent, name), schema)
