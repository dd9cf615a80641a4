import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from textloom.llm import merkle, queries

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, tree string, at bigint"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]])


def levels(nodes):
    found = [nodes]
    while len(found[-1]) > 1:
        found.append([sha(*found[-1][i : i + 2]) for i in range(0, len(found[-1]), 2)])
    return found


def path(found, i):
    for level in found[:-1]:
        yield i % 2, level[i ^ 1] if i ^ 1 < len(level) else ""
        i //= 2


def expected(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    names = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    trees = {k: levels([x[2] for x in sorted(groups[k], key=lambda x: x[:3])]) for k in names}
    top, out = levels([trees[k][-1][0] for k in names]), []
    for g, name in enumerate(names):
        for i, (_, _, own, r) in enumerate(sorted(groups[name], key=lambda x: x[:3])):
            beside = [*path(trees[name], i), *path(top, g)]
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            h = leaf((*r[:3], r[3] + 1, r[4])) if changed else own
            for right, s in beside:
                h = sha(s, h) if right else sha(h, s)
            out.append((r[0], own, trees[name][-1][0], top[-1][0], sha(*[s for _, s in beside]), h, h == top[-1][0]))
    return sorted(out, key=repr)


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", 2)
    monkeypatch.setattr(merkle, "BLOCK", 4)
    monkeypatch.setattr(merkle, "ROWS_PER_TASK", 20)


def got(docs):
    other = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, merkle.leaf([F.col(c) + 1 if c == "n_chars" else F.col(c) for c in merkle.FIELDS]))
    rows = merkle.with_proofs(merkle.manifest(docs, other))
    return sorted((tuple(r) for r in rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


def documents(sizes):
    rows = [(i, f"src{i % 3}", lang, i * 3, f"text {i} é", "x", 5) for lang, n in sizes.items() for i in range(1, n + 1)]
    return [*rows, (None, None, None, None, None, None, None), (7, "a", "en", None, "", None, 1), (9, "a", "é", 9, "x" * 5000, None, 1), (9, "a", "é", 9, "x" * 5000, None, 1), (-4, "a", "é", 9, None, None, 1)]


@pytest.mark.parametrize("sizes", [{"en": 37, "de": 16, "fr": 17, "": 1}, {"en": 65}, {f"l{i}": 2 for i in range(9)}])
def test_trees_of_small_blocks(spark, small_blocks, sizes):
    rows = documents(sizes)
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(3)) == expected(rows)


def test_one_row_and_none(spark):
    one = [(3, "a", "en", 1, "t", None, None)]
    assert got(spark.createDataFrame(one, SCHEMA)) == expected(one)
    assert got(spark.createDataFrame([], SCHEMA)) == []


def test_query_on_the_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select(*merkle.FIELDS).collect()]
    found = queries.op13_merkle_manifest(spark, sf)
    assert sorted(map(tuple, found.collect()), key=repr) == expected(rows)


def test_the_largest_count_of_characters(spark, tmp_path):
    row = [(i, "a", "en", 2**63 - 1, "t") for i in range(30)]
    spark.createDataFrame(row, "doc_id bigint, source string, lang string, n_chars bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, queries.op13_merkle_manifest(spark, str(tmp_path)).collect()), key=repr) == expected(row)
