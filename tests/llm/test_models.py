import random

import numpy as np
from pyspark.sql import functions as F

from textloom.llm import ann, mixing, toxicity

BAD = ["grumblefoo", "snarkwit", "blorptoad"]


def labelled(n=1200):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdehilmnorstu") for _ in range(rng.randint(2, 8))) for _ in range(120)]
    rows, labels = [], []
    for i in range(n):
        own = [rng.choice(words) for _ in range(rng.randint(3, 60))]
        bad = i % 4 == 0
        if bad:
            word = rng.choice(BAD)
            at = rng.randrange(len(word))
            own[rng.randrange(len(own))] = word[:at] + rng.choice("xyz") + word[at:] if i % 8 == 0 else word
        rows.append((i, " ".join(own), "en"))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_held_out_accuracy_and_misspellings(spark):
    rows, labels = labelled()
    rows += [(9000, None, None), (9001, "", None), (9002, "snarrkwit", None), (9003, "snarrkwit", None), (None, "hello", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string")
    marks = spark.createDataFrame([*labels, (0, 1, 1), (None, 1, 1), (9050, 0, None)], "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(docs, marks, F.col("doc_id") % 5 != 0)
    out = toxicity.with_scores(docs.drop("score"), model).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    score = {r.doc_id: r.score for r in out}
    held = [(score[i], t) for i, _, t in labels if i % 5 == 0]
    assert np.mean([(s >= 0.5) == t for s, t in held]) >= 0.9
    assert score[9000] == score[9001] and score[9002] == score[9003] >= 0.5


def test_no_labels(spark, documents):
    marks = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    scored = toxicity.with_scores(documents, toxicity.fit(documents, marks, F.lit(True)))
    assert {round(r.score, 6) for r in scored.collect()} == {0.5}


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((3000, 24)) * rng.uniform(0.3, 2, (3000, 1))
    x[1500:1560] = x[7]
    rows = [(i, [float(v) for v in e], 0) for i, e in enumerate(x)]
    rows += [(5000, None, 0), (5020, [0.0] * 24, 0), (5040, [float("nan")] * 24, 0), (5060, [None, *[1.0] * 23], 0), (5080, [1.0, 2.0], 0), (None, [1.0] * 24, 0), rows[40]]
    out = ann.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int"), F.col("vec_id") % 20 == 0).collect()
    got = {}
    for r in sorted(out, key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, 3000, 20))
    hits = 0
    for q, found in got.items():
        assert [n for n, _, _ in found] == list(range(1, 21)) and all(v != q for _, v, _ in found)
        score = x @ x[q]
        assert all(abs(score[v] - s) < 1e-9 for _, v, s in found)
        assert [(-round(s, 9), v) for _, v, s in found] == sorted((-round(s, 9), v) for _, v, s in found)
        score[q] = -np.inf
        best = np.lexsort((np.arange(3000), -score))[:20]
        hits += len(set(best.tolist()) & {v for _, v, _ in found})
    assert hits / (20 * len(got)) >= 0.9


def test_few_and_no_vectors(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [1.0, 0.0])], "vec_id bigint, embedding array<double>")
    out = {(r.query_id, r["rank"], r.vec_id) for r in ann.nearest(few, F.col("vec_id") % 20 == 0).collect()}
    assert out == {(0, 1, 20), (0, 2, 1), (20, 1, 0), (20, 2, 1)}
    assert ann.nearest(few.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_scores_are_those_of_plain_means_and_softmax(spark):
    rows, labels = labelled(200)
    model = toxicity.train([t for _, t, _ in rows], np.array([t for _, _, t in labels]), epochs=2)
    texts = [rows[3][1], "Some NEW words, words", "grumblefoo", "", "日本 語"]
    out = toxicity.with_scores(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), model).collect()
    for r in out:
        bags = [model.table[toxicity.word_buckets(w)].astype(float).mean(0) for w in toxicity.distinct_words(r.text)]
        mean = np.mean(bags, 0) * toxicity.SCALE if bags else np.zeros(toxicity.DIMENSIONS)
        p = np.exp(mean @ model.softmax + model.bias)
        assert abs(r.score - p[1] / p.sum()) < 1e-5


def test_slots_are_those_of_a_simulated_schedule(spark):
    for parts in ([1], [2, 1], [5, 3, 2], [20, 10, 10, 5, 5, 50], [1] * 7 + [13]):
        period, given, want = sum(parts), [0] * len(parts), []
        for t in range(period):
            ready = [(-(-(given[s] + 1) * period // p), s) for s, p in enumerate(parts) if given[s] * period // p <= t]
            _, s = min(ready)
            want.append((t, s, given[s]))
            given[s] += 1
        got = [(r["slot"], r["part"], r["nth"]) for r in mixing.period_slots(spark, parts).orderBy("slot").collect()]
        assert got == want


def test_mixture_keeps_rows_and_weights(documents, rows):
    out = [r.m for r in mixing.mix(documents, {"src0": 2, "src1": 1}, 3, block=2, name="m").collect()]
    assert sorted(m.position for m in out) == list(range(len(rows)))
    assert all(m.release <= m.slot < m.deadline for m in out)
    blocks = {(m.part, m.block, m.slot) for m in out}
    assert len({s for _, _, s in blocks}) == len(blocks)
    last = min(max(s for p, _, s in blocks if p == q) for q in {p for p, _, _ in blocks})
    for t in range(1, last + 1):
        for part, w in (("src0", 2 / 6), ("src1", 1 / 6), ("src2", 1 / 6), ("src3", 1 / 6), (None, 1 / 6)):
            assert abs(sum(p == part and s < t for p, _, s in blocks) - t * w) < 1
    order = [m.slot for m in sorted(out, key=lambda m: m.position)]
    assert order == sorted(order)


def test_parts_of_all_sources():
    assert mixing.whole_parts(["b", None, "x", "a"], {"x": 50}, 50) == [("x", 3), ("a", 1), ("b", 1), (None, 1)]
    assert mixing.whole_parts(["x"], {"x": 4, "y": 2}, 50) == [("x", 2), ("y", 1)]
    assert mixing.whole_parts([], {}, 50) == []


def test_a_column_named_mix_and_quotes_in_sources(spark):
    docs = spark.createDataFrame([(i, "it's" if i % 2 else None, "x", i) for i in range(50)], "doc_id bigint, source string, mix string, position int")
    out = mixing.mix(docs)
    assert sorted(out.columns) == ["doc_id", "mix", "position", "source"] and sorted(r.mix.position for r in out.collect()) == list(range(50))
    assert mixing.in_mixed_order(docs).columns == docs.columns


def test_empty_mixture(empty):
    assert mixing.mix(empty).count() == 0 and mixing.in_mixed_order(empty).columns == empty.columns
