"""Embeddings of texts with a model given in, by batches on the executors."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH = 32
HELD_BYTES = 16 << 20  # of texts that wait for their batch to be full

Embedder = Callable[[list[str]], list[list[float]]]


def text_to_embed(items: DataFrame) -> DataFrame:
    """items (doc_id, title, content) with the text that stands for each: the title twice, then the whole content. Items
    without content have none and go."""
    title = F.coalesce("title", F.lit(""))
    return items.where(F.trim(F.coalesce("content", F.lit(""))) != "").withColumn("text", F.concat_ws("\n", title, title, "content"))


_MODELS: dict[int, tuple[object, Embedder]] = {}


def _model(factory: Callable[[], Embedder], token: str) -> Embedder:
    """Built once in a Python worker."""
    if token not in _MODELS:
        _MODELS[token] = factory()
    return _MODELS[token]


def _answers(model: Embedder, texts: list[str]) -> list[tuple[list[float] | None, str | None]]:
    """Vector and error of each text. If a batch fails, its texts are tried one by one."""
    try:
        vectors = model(texts)
        if len(vectors) != len(texts):
            raise ValueError(f"{len(vectors)} vectors for {len(texts)} texts")
        return [([float(x) for x in v], None) for v in vectors]
    except Exception as error:
        if len(texts) == 1:
            return [(None, f"{type(error).__name__}: {error}")]
        return [_answers(model, [t])[0] for t in texts]


def _embedding(factory: Callable[[], Embedder], token: str, size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows in order, less than a batch of them
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= size or sum(b.nbytes for b in held) > HELD_BYTES:
                yield from done(held, len(held) == 0)
        yield from done(held, True)

    def done(held: list[pa.RecordBatch], last: bool) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        whole = rows.num_rows if last else rows.num_rows - rows.num_rows % size
        for at in range(0, whole, size):
            part = rows.slice(at, min(size, whole - at))
            answers = _answers(_model(factory, token), [t or "" for t in part.column("text").to_pylist()])
            out = part.drop_columns(["text"]).append_column("embedding", pa.array([v for v, _ in answers], pa.list_(pa.float32())))
            yield from out.append_column("error", pa.array([e for _, e in answers], pa.string())).combine_chunks().to_batches()
        held[:] = rows.slice(whole).to_batches()

    return run


def embed(texts: DataFrame, factory: Callable[[], Embedder], size: int = BATCH) -> DataFrame:
    """texts with embedding and error in place of `text`, rows in their order within a task.

    factory makes a model (texts to vectors) once in each Python worker. The model is called for each `size` rows of a task,
    across the borders of Arrow batches; only a task's last call has fewer. A text that fails has a null vector and an error."""
    import uuid

    left = texts.drop("text", "embedding", "error")
    schema = left.select("*", F.lit(None).cast("array<float>").alias("embedding"), F.lit(None).cast("string").alias("error")).schema
    return texts.select(*left.columns, "text").mapInArrow(_embedding(factory, uuid.uuid4().hex, size), schema)


def missing(texts: DataFrame, index: DataFrame) -> DataFrame:
    """Texts whose doc_id and text the index (doc_id, text_sha256) lacks: new ones, and those that have changed."""
    return texts.withColumn("text_sha256", F.sha2("text", 256)).join(index.select("doc_id", "text_sha256"), ["doc_id", "text_sha256"], "left_anti")


class HashingEmbedder:
    """A stand-in for a model: counts of words by a plain hash, to the length of one. Equal texts have equal vectors."""

    def __init__(self, dimensions: int = 16):
        self.dimensions = dimensions

    def __call__(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            counts = [0] * self.dimensions
            for word in text.split(" "):
                if word:
                    counts[(ord(word[0]) + 31 * len(word)) % self.dimensions] += 1
            length = math.sqrt(sum(c * c for c in counts)) or 1.0
            out.append([c / length for c in counts])
        return out
