import random

import corpus_pipeline
from textloom.llm import queries, sql

from .conftest import prose


def test_planted_cases(spark, tmp_path):
    """Toxic documents, near copies and benchmark passages go; clean documents, empty ones and null ids stay."""
    rng = random.Random(8)
    item = prose(rng, 30)
    rows, labels = [], []
    for i in range(240):
        text = prose(rng, 60)
        if i % 4 == 0:
            text += " grumblefoo snarkwit"
        rows.append((i, text, "en", f"src{i % 3}", len(text)))
        labels.append((i, 1, int(i % 4 == 0)))
    near = rows[1][1].split()
    near[30] = "changed"
    rows += [(300, rows[1][1], "en", "src0", 1), (301, " ".join(near), "en", None, 1), (302, prose(rng, 10) + " " + item + " " + prose(rng, 10), "en", "src1", 1), (303, None, None, None, None), (None, prose(rng, 40), None, None, None)]
    d = f"{tmp_path}/sf"
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    out = corpus_pipeline.run(spark, d).collect()
    got = {r.doc_id for r in out}
    toxic = {i for i, _, t in labels if t}
    clean = {i for i, _, t in labels if not t}
    assert len(out) == len({(r.doc_id, r.start) for r in out})
    assert not got & {300, 301, 302} and {303, None} <= got
    assert len(got & toxic) <= 0.1 * len(toxic) and len(got & clean) >= 0.97 * len(clean)
    starts = sorted((r.start, r.n_tokens) for r in out)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))


def test_every_operator_has_its_query():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)]
    assert set(sql.oracle_sql()) <= set(names)
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
