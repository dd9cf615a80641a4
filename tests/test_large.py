"""What grows with the tables: texts are cut once, few rows move, and the results stay whole."""

from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import search, toc
from textloom.plans import routing as routing_plans
from textloom.plans import search as search_plans

DOCUMENTS = "doc_id bigint, text string, lang string, source string"
BENCHMARK = "item_id bigint, text string"
MOST = 12_000  # rows that may move in a test


@pytest.fixture
def folder(spark, tmp_path):
    def made(documents, benchmark):
        spark.createDataFrame(documents, DOCUMENTS).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame(benchmark, BENCHMARK).write.parquet(f"{tmp_path}/benchmark.parquet")
        return str(tmp_path)

    return made


def same(rows, columns):
    rows = rows if isinstance(rows, list) else rows.fetchall()
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(round(float(r[i]), 6) if isinstance(r[i], (float, Decimal)) else r[i] for i in order) for r in rows), key=repr)


def oracle(folder, sql):
    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    return same(duck.execute(sql), [c[0] for c in duck.description])


def plain(df):
    return same(df.collect(), df.columns)


def shuffled_rows(spark, action):
    sc = spark.sparkContext
    sc.setJobGroup("counted", "counted")
    before = set(sc.statusTracker().getJobIdsForGroup("counted"))
    action()
    scala = sc._jsc.sc()
    scala.listenerBus().waitUntilEmpty()
    jobs = set(sc.statusTracker().getJobIdsForGroup("counted")) - before
    sc.setLocalProperty("spark.jobGroup.id", None)
    stages = {s for j in jobs for s in sc.statusTracker().getJobInfo(j).stageIds}
    return sum(scala.statusStore().lastStageAttempt(s).shuffleWriteRecords() for s in stages)


def test_an_analyser_sees_each_text_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def analyser():
        def run(text):
            seen.add(1)
            return [(w, "N") for w in text.split()]

        return run

    items = spark.createDataFrame([(i, f"title{i}", f"word{i % 7} other{i}") for i in range(40)], "doc_id bigint, title string, content string")
    asked = spark.createDataFrame([(0, "word3 other5")], "query_id bigint, text string")
    hits = search.bm25(items, asked, 3, tokens=search.analysed(analyser, {"N"})).collect()
    assert hits[0].doc_id == 5 and len(hits) == 3
    assert seen.value == 81


def test_only_the_best_of_each_task_move(spark):
    items = spark.createDataFrame([(i, "t", f"shared{i % 50} " + "both " * (i % 3)) for i in range(3000)], "doc_id bigint, title string, content string")
    asked = spark.createDataFrame([(q, f"both t shared{q}") for q in range(30)], "query_id bigint, text string")
    found = []
    assert shuffled_rows(spark, lambda: found.extend(search.bm25(items, asked, 5).collect())) < 5000 + 3000  # ids, terms and leading hits; pairs were 90,000
    assert len(found) == 150 and all(r.doc_id % 50 == r.query_id for r in found)


def test_queries_in_parts_give_the_same(spark):
    items = spark.createDataFrame([(i, "t", f"a{i % 5} b{i % 7} c{i % 11}") for i in range(300)], "doc_id bigint, title string, content string")
    asked = spark.createDataFrame([(q, f"a{q % 5} b{q % 7} c{q % 11}") for q in range(40)], "query_id bigint, text string")
    whole = plain(search.bm25(items, asked, 4))
    assert len(whole) == 160 and plain(search.bm25(items, asked, 4, at_once=9)) == whole


def test_scores_in_small_pieces_are_the_same(spark, monkeypatch):
    items = [(i, "t", f"a{i % 5} b{i % 7} c{i % 11}") for i in range(300)]
    asked = {q: f"a{q % 5} b{q % 7} c{q % 11}" for q in range(12)}
    frame, queries = spark.createDataFrame(items, "doc_id bigint, title string, content string"), spark.createDataFrame(list(asked.items()), "query_id bigint, text string")
    corpus = search.corpus_of(frame)
    whole = plain(search.bm25(frame, queries, 4, corpus=corpus))
    index = corpus.index.coalesce(1).toArrow().to_batches()
    weights = {t: search.EPSILON * corpus.mean if x < 0 else x for t, x in corpus.terms.select("term", search.odds(corpus.n, F.col("df"))).collect()}
    import pyarrow as pa

    pairs = [(q, t, weights[t]) for q, text in asked.items() for t in text.split()]
    sent = type("Sent", (), {"value": search._asked(pa.table(dict(zip(("q", "term", "weight"), zip(*pairs), strict=True))))})
    for cells in (1, 40, 1 << 21):
        monkeypatch.setattr(search, "CELLS", cells)
        got = [tuple(r.values()) for b in search._scored(sent, 4, search.K1, search.B, corpus.avgdl)(iter(index)) for r in b.to_pylist()]
        assert sorted((q, d, s) for q, d, s in got) == sorted((q, d, s) for d, q, _, s in whole)


def test_repeated_rows_are_one_item(spark, folder):
    texts = [f"head {i}\nfoo{'abcd'[i % 4]} bar{'abc'[i % 3]} baz" for i in range(20)]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    d = folder(rows + rows[3:5] + [(None, "foob alone barb", "en", "s"), (50, None, "en", "s"), (51, "", "en", "s")], [(0, "foob barc alone"), (1, "nothing"), (2, "")])
    for name in ("bm25_batch", "bm25_analysed"):
        got = plain(search_plans.QUERIES[name](spark, d))
        assert got == oracle(d, search_plans.SQL[name]) and len(got) == 10


def test_headings_that_begin_alike_need_no_ratios(monkeypatch):
    def never(*_):
        raise AssertionError("a ratio was counted")

    monkeypatch.setattr(toc.SequenceMatcher, "ratio", never)
    lines = [f"chapter {'abcdefgh'[i % 8] * 3} of the whole {'xyz'[i % 3]}" for i in range(40)]
    entries = [(i, i // 10 + 1, t, True) for i, t in enumerate(lines)] + [(40, 1, "qqqq", True), (41, 1, "", True)]
    blocks = [(i // 10 + 1, i % 10, t.upper(), t) for i, t in enumerate(lines)]
    found = list(toc._matched(entries, blocks))
    assert [f[:5] for f in found] == [(i, True, t.upper(), i // 10 + 1, 1.0) for i, t in enumerate(lines)] + [(40, False, None, None, None), (41, False, None, None, None)]


def test_entries_without_text_have_no_heading(spark):
    entries = spark.createDataFrame([(1, 0, 1, "Intro"), (1, 1, 1, None), (2, 0, None, "Alone"), (None, 0, 1, "Intro")], "doc_id bigint, pos int, page_number int, clean_text string")
    blocks = spark.createDataFrame([(1, None, 0, "nowhere"), (1, 1, 0, None), (1, 1, 1, "Introduction"), (None, 1, 0, "Intros"), (3, 1, 0, "x")], "doc_id bigint, page int, block_idx int, text string")
    got = {(r.doc_id, r.pos): (r.matched, r.matched_text, r.page_num) for r in toc.match(entries, blocks).collect()}
    assert got == {(1, 0): (True, "Introduction", 1), (1, 1): (False, None, None), (2, 0): (False, None, None), (None, 0): (True, "Intros", 1)}


def test_lines_of_contents_keep_their_readings(spark):
    lines = ["1.2 One .... 7", "  Two  12 ", "a.b ... 3\n", "x 12", "..... 4", "a\nb .. 5", "· ·· 6", "one … 8 9", "y .. 12  34", "", None]
    got = [(r.c, r.p, r.k) for r in spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "i int, t string").select("i", T.toc_clean(F.col("t")).alias("c"), T.toc_page(F.col("t")).alias("p"), T.match_key(F.col("t")).alias("k")).orderBy("i").collect()]
    assert got == [("1.2 One", 7, "1.2 one ...."), ("Two", 12, "two"), ("a.b", 3, "a.b ... 3"), ("x 12", None, "x"), ("", 4, "....."), ("", 5, "a b .."), ("", 6, "· ··"), ("one … 8 9", None, "one … 8"), ("y .. 12", 34, "y .. 12"), ("", None, ""), (None, None, None)]


def crowd(n=500, m=20):
    """Documents that all share words with all questions, whose texts some documents hold."""
    words = "alpha beta gamma delta".split()
    asked = [(q, f"Common words here, {words[q % 4]} own{q}. " + " ".join(f"Second{q % 3} part of {words[(q + 1) % 4]}." for _ in range(q % 4))) for q in range(m)]
    held = {7 * q: t for q, t in asked[: m // 2]}
    docs = [(i, f"title {i}\n" + held.get(i, f"common words here {words[i % 4]} and second{i % 3} part of it {'x' * (i % 9)}"), "en", f"s{i % 3}") for i in range(n)]
    return docs, asked


@pytest.mark.parametrize("name", ["expected_sections", "routed_search", "routed_answers", "agent_search", "recall_mrr_by_mode", "negative_cases", "exclusive_wins"])
def test_pairs_of_query_and_document_stay_in_their_tasks(spark, folder, name):
    d = folder(*crowd())
    query = (search_plans.QUERIES | routing_plans.QUERIES)[name]
    got = []
    moved = shuffled_rows(spark, lambda: got.extend(plain(query(spark, d))))
    assert got == oracle(d, (search_plans.SQL | routing_plans.SQL)[name]) and got
    assert moved < MOST
