"""Every corpus query and the pipeline on tables of blank texts, on empty tables, and with extra columns of clashing names."""

from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from textloom.llm import queries, text

SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "benchmark": "item_id bigint, text string",
    "pages": "page_id bigint, url string, html string",
    "embeddings": "vec_id bigint, embedding array<float>",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}
CLASHES = ["score", "key", "_key", "mix", "ranges", "asked", "tree", "at", "digest", "size", "ids", "decoded", "n_tokens", "held_out", "fault", "part", "rest", "root", "copies", "row", "file"]
BLANK = {
    "documents": [(i, t, None if i == 3 else "en", None, None) for i, t in enumerate([None, "", " ", "\n\t", None, ""])] + [(None, None, None, None, None)],
    "pages": [(1, None, None), (2, "", ""), (None, "x", " ")],
    "embeddings": [(0, None), (20, []), (40, [0.0, 0.0]), (60, [float("nan"), 1.0])],
    "conversations": [(1, None, None, None), (1, 2, "", ""), (None, None, "user", " "), (2, 1, "user", "\n")],
    "labels": [(0, 1, None), (None, None, 1), (1, 0, 0)],
}
WORDY = BLANK | {
    "documents": [*BLANK["documents"], *[(i, f"Some words of text number {i % 7}. " * (i % 5 + 1), "fr" if i % 3 else "en", f"src{i % 3}", i) for i in range(10, 40)]],
    "benchmark": [(1, "some words of text number 3"), (2, None), (3, ""), (None, "words")],
    "embeddings": [*BLANK["embeddings"], *[(i, [float(i % 9), 1.0, float(i % 4)]) for i in range(100, 130)]],
    "conversations": [*BLANK["conversations"], *[(5, t, ("user", "assistant")[t % 2], f"Line {t}.") for t in range(8)]],
    "pages": [*BLANK["pages"], *[(i, f"http://h{i}.org/x", "<p>one line</p><p>two</p>") for i in range(10, 20)]],
}
KEYS = {"op1": "documents", "op7": "documents", "op8": "documents", "op9": "documents", "op10": "documents", "op12": "documents", "op13": "documents", "op4": "documents", "op6": "pages"}


def folder(spark, path, tables, extra=False):
    for name, schema in SCHEMAS.items():
        frame = spark.createDataFrame(tables.get(name, []), schema)
        if extra:
            taken = {c.lower() for c in frame.columns}
            frame = frame.selectExpr("*", *[f"{i} as `{c}`" for i, c in enumerate(CLASHES) if c not in taken])
        frame.write.parquet(f"{path}/{name}.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["empty", "blank", "clashing"])
def test_every_query(spark, tmp_path, name):
    tables = {"empty": {}, "blank": BLANK, "clashing": WORDY}[name]
    d = folder(spark, tmp_path, tables, name == "clashing")
    for query, run in queries.queries().items():
        rows = run(spark, d).collect()
        table = KEYS.get(query.split("_")[0])
        if table:
            assert len(rows) == len(tables.get(table, [])), query
        if name == "empty":
            assert not rows, query
    assert len({r.conv_id for r in queries.op11_repaired_conversations(spark, d).collect()}) == len({r[0] for r in tables.get("conversations", [])})
    out = corpus_pipeline.run(spark, d).collect()
    assert len({r.doc_id for r in out}) <= len(tables.get("documents", []))
    if name == "blank":
        assert len(out) >= 1


def test_stages_keep_the_columns(spark, tmp_path):
    d = folder(spark, tmp_path, WORDY, True)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns, name
        assert not Counter(map(repr, out.collect())) - Counter(map(repr, docs.collect())), name


def test_hashes_of_nothing_first(monkeypatch):
    monkeypatch.setattr(text, "_POWERS", {})
    none = np.zeros(0, np.uint8)
    h, rows, _, _ = text.words(none, np.zeros(4, np.int64))
    assert len(h) == 0 and rows.tolist() == [0, 0, 0, 0]
    assert len(text.prefix_hashes(np.zeros(0, np.uint64))) == 1
    assert len(text.words(np.frombuffer(b"a b", np.uint8), np.array([0, 3]))[0]) == 2
