"""Nearest neighbours by inner product, with multiprobe p-stable hashing and exact reranking.

Vectors are scaled by the largest norm M and given one more component so that all have norm one; a query has zero
there. Then the Euclidean distance falls as the inner product grows. Each of TABLES tables cuts the projections on a few
Gaussian directions into bins of WIDTH; a bucket is a tuple of bins. A neighbour at distance r has its projection at
that of the query plus N(0, r * r), so every bucket has an estimated chance to hold it. A query visits buckets in the
order of that chance until their sum reaches the recall asked for. What all tables give is reranked by inner product in
double precision.

r is estimated on a bounded sample (SAMPLE vectors, SAMPLE_QUERIES queries); every vector is indexed. Of equal vectors
the k + 1 least vec_ids are enough for any answer, so a vector that is very frequent costs no more. Full groups of
buckets are dealt out in chunks of CHUNK vectors and CHUNK queries.

Vectors that are null, zero, of another length than most, or hold nulls or non-finite numbers take no part, nor do rows
with a null vec_id. Repeated rows (equal id and vector) are one. Of an id with several vectors each that is a query is
answered, under the same query_id, and each that is near is a neighbour, so an id may then stand at two ranks. With fewer
candidates than k a query gets all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import storage

K = 20
TABLES = 2
WIDTH = 1.25
RECALL = 0.985
SAMPLE, SAMPLE_QUERIES = 4096, 256
CHUNK = 8192
SEED = 11


class Hashing:
    """The functions of all tables; `reach` is the distance at which neighbours are expected."""

    def __init__(self, dimension: int, count: int, norm: float, reach: float, tables: int, width: float):
        self.norm, self.reach, self.tables, self.width = norm, reach, tables, width
        self.functions = max(2, min(16, int(np.log2(max(count, 2)) / 4)))
        rng = np.random.default_rng(SEED)
        self.directions = rng.standard_normal((tables, self.functions, dimension + 1))
        self.offsets = rng.random((tables, self.functions)) * width
        self.groups = max(16, count // CHUNK)

    def lifted(self, x: np.ndarray, query: bool) -> np.ndarray:
        if query:
            return np.c_[x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros(len(x))]
        x = x / self.norm
        return np.c_[x, np.sqrt(np.maximum(0, 1 - (x**2).sum(1)))]

    def projections(self, x: np.ndarray, table: int) -> np.ndarray:
        return (x @ self.directions[table].T + self.offsets[table]) / self.width

    def code(self, bins: np.ndarray) -> np.ndarray:
        """One number for a tuple of bins."""
        h = np.zeros(len(bins), np.uint64)
        for j in range(bins.shape[1]):
            h = h * np.uint64(4099) + (bins[:, j] + 2048).astype(np.uint64)
        return h.view(np.int64)

    def probes(self, at: np.ndarray, recall: float) -> np.ndarray:
        """The codes that a query with projections `at` (in bins) visits in one table, by falling chance of success."""
        chance, bins = np.ones(1), np.zeros((1, 0), np.int64)
        spread = self.reach / self.width
        for x in at:
            near = np.arange(int(np.floor(x - 4 * spread)), int(np.floor(x + 4 * spread)) + 1)
            edge = np.array([0.5 * (1 + erf((e - x) / (spread * sqrt(2)))) for e in [*near, near[-1] + 1]])
            own = np.diff(edge)
            chance = np.outer(chance, own).ravel()
            bins = np.c_[np.repeat(bins, len(near), 0), np.tile(near, len(bins))]
            keep = chance > (1 - recall) * 1e-4
            chance, bins = chance[keep], bins[keep]
        order = np.argsort(-chance, kind="stable")
        visited = int(np.searchsorted(np.cumsum(chance[order]), recall)) + 1
        return self.code(bins[order[:visited]])


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 0))


def valid_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id and vector (array of doubles) of the rows that take part; equal rows once."""
    x = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    x = x.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & finite & F.exists("vector", lambda v: v != 0))
    sizes = x.groupBy(F.size("vector").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").limit(1).collect()
    return x.where(F.size("vector") == (sizes[0]["n"] if sizes else 0)).dropDuplicates(["vec_id", "vector"])


def _fit(vectors: DataFrame, k: int, tables: int, width: float) -> Hashing:
    stats = vectors.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("d"), F.sqrt(F.max(F.aggregate("vector", F.lit(0.0), lambda a, v: a + v * v))).alias("norm")).first()
    sample = vectors.orderBy(F.xxhash64(F.lit(SEED), "vec_id"), "vec_id").limit(SAMPLE).toArrow()
    hashing = Hashing(stats["d"] or 1, stats["n"], float(stats["norm"] or 1), 1.0, tables, width)
    if sample.num_rows > 1:
        x = _matrix(sample.column("vector"))
        queries, points = hashing.lifted(x[:SAMPLE_QUERIES], True), hashing.lifted(x, False)
        products = np.sort(queries @ points.T, axis=1)[:, ::-1]
        rank = min(len(x) - 1, max(1, round(k * len(x) / stats["n"])))  # rank 0 is the vector itself, most often
        distance = np.sqrt(np.maximum(0, 2 - 2 * products[:, rank]))
        hashing.reach = max(1e-3, float(np.quantile(distance, 0.75)))
    return hashing


def _buckets(sent) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h: Hashing = sent.value
        for batch in batches:
            x = h.lifted(_matrix(batch.column("vector")), False)
            for t in range(h.tables):
                code = h.code(np.floor(h.projections(x, t)).astype(np.int64))
                yield pa.record_batch({"tab": pa.array(np.full(len(x), t, np.int32)), "grp": (code % h.groups).astype(np.int32), "code": code, "vec_id": batch.column("vec_id"), "vector": batch.column("vector")})

    return run


def _visits(sent, recall: float) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h: Hashing = sent.value
        for batch in batches:
            x = h.lifted(_matrix(batch.column("vector")), True)
            for t in range(h.tables):
                rows, groups, codes = [], [], []
                for i, at in enumerate(h.projections(x, t)):
                    code = h.probes(at, recall)
                    group = code % h.groups
                    for g in np.unique(group):
                        rows.append(i)
                        groups.append(int(g))
                        codes.append(code[group == g])
                take = pa.array(rows, pa.int64())
                yield pa.record_batch({"tab": pa.array(np.full(len(rows), t, np.int32)), "grp": pa.array(groups, pa.int32()), "codes": pa.array(codes, pa.list_(pa.int64())), "query": batch.column("query").take(take), "vector": batch.column("vector").take(take)})

    return run


def _rerank(k: int) -> callable:
    def run(index: pa.Table, queries: pa.Table) -> pa.Table:
        found: dict[str, list] = {"query": [], "vec_id": [], "score": []}
        if index.num_rows and queries.num_rows:
            index = index.sort_by([("code", "ascending"), ("vec_id", "ascending")])
            code, ids, x = index.column("code").to_numpy(), index.column("vec_id").to_numpy(), _matrix(index.column("vector"))
            q, names = _matrix(queries.column("vector")), queries.column("query").to_numpy()
            lists = queries.column("codes").combine_chunks()
            asked, by = lists.flatten().to_numpy(), np.repeat(np.arange(len(q)), np.diff(lists.offsets.to_numpy()))
            order = np.argsort(asked, kind="stable")
            asked, by = asked[order], by[order]
            best_q, best_id, best_score = [], [], []
            first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            for a, b in zip(first, np.r_[first[1:], len(code)], strict=True):
                who = by[np.searchsorted(asked, code[a], "left") : np.searchsorted(asked, code[a], "right")]
                if not len(who):
                    continue
                score = q[who] @ x[a:b].T
                top = np.argsort(-score, axis=1, kind="stable")[:, :k]  # rows stand by vec_id: ties go to the smaller
                best_q.append(np.repeat(who, top.shape[1]))
                best_id.append(ids[a:b][top].ravel())
                best_score.append(np.take_along_axis(score, top, 1).ravel())
            if best_q:
                who, vec, score = map(np.concatenate, (best_q, best_id, best_score))
                order = np.lexsort((vec, -score, who))
                who, vec, score = who[order], vec[order], score[order]
                start = np.searchsorted(who, who, "left")
                keep = np.arange(len(who)) - start < k
                found = {"query": names[who[keep]], "vec_id": vec[keep], "score": score[keep]}
        return pa.table({"query": pa.array(found["query"], pa.int64()), "vec_id": pa.array(found["vec_id"], pa.int64()), "score": pa.array(found["score"], pa.float64())})

    return run


def nearest(embeddings: DataFrame, is_query, k: int = K, tables: int = TABLES, width: float = WIDTH, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id and score of the k vectors found with the largest inner product for each query row."""
    spark = embeddings.sparkSession
    vectors = storage.materialize(valid_vectors(embeddings), "ann-vectors")
    hashing = _fit(vectors, k, tables, width)
    sent = spark.sparkContext.broadcast(hashing)
    equal = Window.partitionBy("vector").orderBy("vec_id")
    index = vectors.withColumn("n", F.row_number().over(equal)).where(F.col("n") <= k + 1).select("vec_id", "vector")
    least = vectors.where(is_query).groupBy("vector").agg(F.min("vec_id").alias("query"))  # equal queries are one, however many
    asking = storage.materialize(vectors.where(is_query).join(least, "vector"), "ann-queries")
    asked = asking.where(F.col("vec_id") == F.col("query")).select("query", "vector")

    buckets = storage.materialize(index.mapInArrow(_buckets(sent), "tab int, grp int, code bigint, vec_id bigint, vector array<double>"), "ann-buckets")
    each_table = 1 - (1 - recall) ** (1 / tables)
    visits = storage.materialize(asked.mapInArrow(_visits(sent, each_table), "tab int, grp int, codes array<bigint>, query bigint, vector array<double>"), "ann-visits")
    parts = lambda df, name: df.groupBy("tab", "grp").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias(name))
    chunks = parts(buckets, "index_parts").join(parts(visits, "query_parts"), ["tab", "grp"])
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    left = buckets.join(chunks, ["tab", "grp"]).withColumn("i", own("vec_id", "index_parts")).withColumn("j", every("query_parts")).drop("index_parts", "query_parts")
    right = visits.join(chunks, ["tab", "grp"]).withColumn("j", own("query", "query_parts")).withColumn("i", every("index_parts")).drop("index_parts", "query_parts")
    key = ["tab", "grp", "i", "j"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_rerank(k + 1), "query bigint, vec_id bigint, score double")

    merged = found.groupBy("query", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    top = merged.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    answers = asking.select(F.col("vec_id").alias("query_id"), "query").join(top, "query").where(F.col("vec_id") != F.col("query_id"))
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return answers.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
