"""Operators on small literal frames, where the tables lack what they need."""

import datetime as dt
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.functions import geometry, vectors
from textloom.functions import text as T
from textloom.operators import conversation, evaluation, formulas, html_text, layout, pages, rag, search, toc, trees, usage, validation, workspace
from textloom.sources import files


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_numbers_and_captions(spark):
    texts = ["1. A", "1.2. B", "1.2 C", "(3) D", "x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(T.section_number(F.col("t"))).collect()] == ["1", "1.2", None, "3", None]
    captions = spark.createDataFrame([("Figure 2.1: x",), ("Table 3. y",), ("Figure 2",), ("표 4: z",)], "t string")
    assert [r[0] for r in captions.select(T.caption_id(F.col("t"))).collect()] == ["fig-2-1", "tbl-3", None, "tbl-4"]
    assert one(spark, T.reference_ids(F.lit("see Figure 2.1 and table 3, Figure 2.1")))[0] == ["fig-2-1", "tbl-3"]
    assert one(spark, T.special_block(F.lit("[NOTE] x")), T.special_block(F.lit("plain")))[:] == ("note", None)
    assert one(spark, T.heading_tag(F.lit("Heading 2"), F.lit(30.0)), T.heading_tag(F.lit(None).cast("string"), F.lit(16.0)), T.heading_tag(F.lit("Body"), F.lit(9.0)))[:] == ("h2", "h2", "p")


def test_sentences_and_counts(spark):
    assert one(spark, T.sentences(F.lit("Pi is 3.14. Ok?Yes! x")))[0] == ["Pi is 3.", "14.", "Ok?", "Yes!", "x"]
    assert one(spark, T.occurrences(F.lit("aaaa"), F.lit("aa")), T.occurrences(F.lit("abc"), F.lit("")))[:] == (2, 0)
    assert one(spark, validation.split_positions(F.lit("a.b.a.b"), F.lit(".b")))[0] == [1, 5]


def test_toc_and_urls(spark):
    r = one(spark, T.toc_line(F.lit("1.2 Scope ........ 14")).alias("x")).x
    assert (r.clean_text, r.page_number, r.numbering, r.heading_level) == ("1.2 Scope", 14, "1.2", 2)
    assert one(spark, T.match_key(F.lit("  Scope  of\twork 12 ")))[0] == "scope of work"
    assert one(spark, T.resolve_url(F.lit("a/b/c.html"), F.lit("../d/./e.html")), T.resolve_url(F.lit("a/b.html"), F.lit("http://x/y")))[:] == ("a/d/e.html", "http://x/y")
    assert one(spark, T.client_address(F.lit("1.2.3.4, 5.6.7.8"), F.lit("9.9.9.9")), T.client_address(F.lit(None).cast("string"), F.lit("9.9.9.9")))[:] == ("1.2.3.4", "9.9.9.9")
    r = one(spark, T.breadcrumb(F.lit("A > B > C")).alias("x"), T.breadcrumb(F.lit("A")).alias("y"))
    assert tuple(r.x) == ("A", 3, "B") and tuple(r.y) == ("A", 1, None)


def test_rectangles_and_vectors(spark):
    box = lambda *v: F.struct(*[F.lit(float(x)).alias(n) for x, n in zip(v, ("x0", "y0", "x1", "y1"))])
    assert one(spark, geometry.iou(box(0, 0, 2, 2), box(1, 0, 3, 2)))[0] == pytest.approx(1 / 3)
    assert one(spark, geometry.column_of(box(0, 0, 70, 1), F.lit(100.0)), geometry.column_of(box(60, 0, 90, 1), F.lit(100.0)))[:] == ("full", "right")
    assert one(spark, vectors.squared_distance(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(0.0), F.lit(0.0))))[0] == 5


TABLE = "<table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>x|y</td></tr><tr><td>2</td></tr></table>"
SPANS = "<table><tr><th>A</th><th>B</th></tr><tr><td rowspan=2>1</td><td>B</td></tr><tr><td>3</td></tr></table>"


def test_tables_and_formulas():
    assert html_text.table_to_text(TABLE).split("\n") == ["| A | B |", "| --- | --- |", r"| 1 | x\|y |", "| 2 |  |"]
    assert html_text.table_to_text(SPANS) == "A: 1\nA: 1, B: 3"
    math = "<math><mfrac><mi>a</mi><msup><mi>β</mi><mn>2</mn></msup></mfrac></math>"
    assert html_text.mathml_to_latex(math) == r"\frac{a}{\beta^{2}}"
    assert html_text.mathml_to_latex("<math><munder><mo>∑</mo><mi>i</mi></munder></math>") == r"\sum_{i}"
    assert html_text.mathml_to_latex("<math><mi>a</mi>") == "a"
    assert html_text.searchable_text(f"<p>x &eacute;</p>{TABLE}<p>{math}</p>").split("\n\n")[-1] == r"$\frac{a}{\beta^{2}}$"
    m = 'xmlns:m="http://x"'
    omml = f"<m:oMath {m}><m:f><m:num><m:r><m:t>1</m:t></m:r></m:num><m:den><m:r><m:t>x+2</m:t></m:r></m:den></m:f></m:oMath>"
    assert formulas.omml_to_mathml(omml) == "<math><mfrac><mrow><mn>1</mn></mrow><mrow><mi>x</mi><mo>+</mo><mn>2</mn></mrow></mfrac></math>"


def test_sections_merge_and_pack(spark):
    long = "\n\n".join("p" * 900 for _ in range(5))
    html = f"pre<h1>One</h1>{'a' * 120}<h2>Two</h2>short<h2>Two</h2>{'b' * 150}<h3 id='own'>Three</h3>{long.replace(chr(10) * 2, '<br>')}"
    df = spark.createDataFrame([(1, "u", html), (2, "v", "no headings"), (3, "w", None)], "page_id bigint, url string, html string")
    found = pages.sections(df).orderBy("pos").collect()
    assert [(r.level, r.title, r.section_id) for r in found] == [(1, "One", "one"), (2, "Two", "two"), (2, "Two", "two-1"), (3, "Three", "own")]
    merged = pages.merge_short(pages.sections(df)).orderBy("pos").collect()
    assert [r.section_id for r in merged] == ["one", "two-1", "own"] and merged[0].content.endswith("\n\nTwo\nshort")
    parts = pages.chunks(pages.merge_short(pages.sections(df)), 2000).where("section_id like 'own%'").orderBy("chunk").collect()
    assert [r.section_id for r in parts] == ["own", "own-2", "own-3"] and all(len(r.content) <= 2000 for r in parts)
    assert "id=\"two-1\"" in pages.inject_ids(df).where("page_id = 1").first().html


@settings(max_examples=20, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=12))
def test_packing_keeps_all_paragraphs(sizes):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    text = "\n\n".join("x" * n for n in sizes)
    out = one(spark, pages.packed(F.lit(text), 60))[0]
    assert "\n\n".join(out) == text
    assert all(len(c) <= 60 + 2 * c.count("\n\n") or "\n\n" not in c for c in out)


def test_rules(spark):
    paragraphs = ["1. A", "3. B", "1.1. x", "2.1. y", "2.3. z", "Table 1 and Table 3", "see Table 1", "체크 체크", "시험 테스트 시험", "x" * 81 + ".", "3.14"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(paragraphs)], "doc_id bigint, paragraph_index int, text string")
    found = {(r.rule_id, r.paragraph_index, r.char_start, r.char_end) for r in validation.validate(df).collect()}
    assert ("numbering_continuity", 1, 0, 2) in found and ("numbering_continuity", 4, 0, 4) in found
    assert ("table_caption", 5, 12, 19) in found and not any(r == "table_caption" and p == 6 for r, p, _, _ in found)
    assert {(s, e) for r, p, s, e in found if r == "forbidden_terms"} == {(0, 2), (3, 5)}
    assert ("inconsistent_terms", 8, 3, 6) in found and ("sentence_length", 9, 0, 82) in found
    score = validation.scores(spark.createDataFrame([(1,), (2,)], "doc_id bigint"), validation.validate(df)).orderBy("doc_id").collect()
    assert score[0].error == 2 and score[1].score == 100
    assert validation.validate(df, "unknown").count() == 0


def test_feedback_rounds_half_to_even(spark):
    rows = [("SIMPLE", "high", "positive")] + [("SIMPLE", "high", "negative")] * 7 + [(None, "", "positive"), ("", None, "negative")]
    out = {(r.level, r.route, r.confidence): (r.positive, r.negative, r.rate) for r in usage.feedback_summary(spark.createDataFrame(rows, "route string, confidence string, feedback string")).collect()}
    assert out["route", "SIMPLE", None] == (1, 7, 12) and out["route", "UNKNOWN", None] == (1, 1, 50) and out["total", None, None] == (2, 8, 20)


def test_visits_at_the_gap(spark):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [(i, 1, at(s)) for i, s in enumerate((0, 120, 241, 300))]
    out = usage.visits(spark.createDataFrame(rows, "event_id bigint, user_id bigint, ts timestamp_ntz")).orderBy("visit").collect()
    assert [r.events for r in out] == [2, 2]


def test_fusion_with_null_sections(spark):
    leg = "query_id bigint, doc_id bigint, section string, rank int"
    a, b = spark.createDataFrame([(0, 1, None, 1), (0, 2, "x", 2)], leg), spark.createDataFrame([(0, 1, None, 2), (0, 3, None, 1)], leg)
    out = {(r.doc_id, r.section): r.score for r in search.fuse(a, b, 5, keys=("doc_id", "section")).collect()}
    assert out == {(1, None): round(0.3 / 61 + 0.7 / 62, 6), (2, "x"): round(0.3 / 62, 6), (3, None): round(0.7 / 61, 6)}


def test_evaluation_of_negatives(spark):
    results = spark.createDataFrame([("m", "a", 1, False), ("m", "a", 2, True), ("m", "n", 1, False)], "mode string, case_id string, rank int, correct boolean")
    cases = spark.createDataFrame([("a", "f", False), ("n", "neg", True), ("o", "neg", True)], "case_id string, category string, negative boolean")
    out = {r.case_id: (r.hit, r.rr) for r in evaluation.score_cases(results, cases, 5, ["m"]).collect()}
    assert out == {"a": (1, 0.5), "n": (0, 0.0), "o": (1, 1.0)}
    assert one(spark, evaluation.expects(F.lit("intro-1"), F.lit("u"), F.array(F.lit("intro")), F.lit(None).cast("array<string>")))[0]


def test_follow_up_keeps_order_and_repeats(spark):
    assert one(spark, conversation.follow_up(F.lit("b a b c"), F.lit("c d")))[0] == "b a b c d"
    assert one(spark, conversation.follow_up(F.lit(None).cast("string"), F.lit("q")))[0] == "q"


def test_trees(spark):
    nodes = spark.createDataFrame([(1, None, 0, "Root", None), (2, 1, 1, "Guide", None), (3, 2, 0, "Intro", "a.html"), (4, 2, 1, "Terms", "glossary:x"), (5, 1, 0, "Home", "h.html")], "id bigint, parent_id bigint, pos bigint, label string, url string")
    flat = trees.flatten(nodes)
    assert {r.url: r.path for r in trees.breadcrumbs(flat).collect()}["a.html"] == "Root > Guide > Intro"
    assert trees.counts_by_root(flat).first().documents == 2
    assert [r.url for r in trees.descendants(flat, 1).collect()] == ["h.html", "a.html", "glossary:x"]
    assert {r.id for r in trees.filtered(nodes, flat, "guide").collect()} == {1, 2, 3, 4} and {r.id for r in trees.filtered(nodes, flat, "intro").collect()} == {1, 2, 3}
    paths = spark.createDataFrame([(1, ["Root", "Guide", "Intro"]), (2, ["Root", "No"]), (3, ["Root"]), (4, []), (5, ["Root", "Guide", "Intro", "Deeper"])], "path_id int, labels array<string>")
    assert {r.path_id: r.id for r in trees.find_by_labels(nodes, paths).collect()} == {1: 3, 3: 1}
    swapped = {r.id: r.pos for r in trees.swapped(nodes, 5, 1).collect()}
    assert (swapped[5], swapped[2]) == (1, 0)
    folders = spark.createDataFrame([(1, None, "a"), (2, 1, "b"), (3, 2, "c")], "id bigint, parent_id bigint, name string")
    left, docs = trees.remove_folder(folders, spark.createDataFrame([(9, 2)], "doc_id bigint, folder bigint"), 2)
    assert {r.id: r.parent_id for r in left.collect()} == {1: None, 3: 1} and docs.first().folder == 1
    first, rest = trees.split_fixed(nodes, ["h.html", "a.html"])
    assert [r.id for r in first.collect()] == [5, 3] and rest.count() == 3


TREE = "id bigint, parent_id bigint, pos bigint, label string, url string"


def test_deep_and_broken_trees(spark):
    chain = [(i, i - 1 if i else None, 0, f"n{i}", f"u{i}") for i in range(200)]
    found = {r.id: r for r in trees.flatten(spark.createDataFrame([*chain, (900, 901, 0, "lost", "x")], TREE)).collect()}
    assert len(found) == 200 and found[199].depth == 200 and found[199].root == 0 and found[199].labels == [f"n{i}" for i in range(200)]
    with pytest.raises(ValueError):
        trees.flatten(spark.createDataFrame([(1, None, 0, "r", None), (2, 4, 0, "a", None), (3, 2, 0, "b", None), (4, 3, 0, "c", None), (5, 4, 0, "d", None)], TREE))
    assert trees.flatten(spark.createDataFrame([], TREE)).count() == 0


def test_neighbours_cross_roots_and_ranges(spark):
    rows = [(r, None, r, f"r{r}", None) for r in range(5)] + [(100 + i, i % 5, i, f"p{i}", f"u{i}") for i in range(60)] + [(300, 0, 500, "empty", "")]
    got = {r.url: (r.before, r.after) for r in trees.neighbours(trees.flatten(spark.createDataFrame(rows, TREE))).collect()}
    order = [f"u{i}" for r in range(5) for i in range(r, 60, 5)]
    assert got == {u: (b, a) for u, b, a in zip(order, [None, *order], [*order[1:], None], strict=False)}


def test_section_ids_pass_by_taken_ones(spark):
    titles = spark.createDataFrame([(1, i, t) for i, t in enumerate(["x", "x-1", "x", "x", "x-1"])] + [(2, 0, "x")], "page_id bigint, pos int, title string")
    assert [r.section_id for r in pages.unique_ids(titles).orderBy("page_id", "pos").collect()] == ["x", "x-1", "x-2", "x-3", "x-1-1", "x"]


def test_layout(spark):
    box = "doc_id bigint, page int, conf double, x0 double, y0 double, x1 double, y1 double"
    df = spark.createDataFrame([(1, 1, 0.9, 0.0, 0.0, 10.0, 10.0), (1, 1, 0.8, 1.0, 0.0, 11.0, 10.0), (1, 1, 0.7, 8.0, 8.0, 20.0, 20.0)], box)
    assert sorted(r.conf for r in layout.non_maximum_suppression(df).collect()) == [0.7, 0.9]
    caps = spark.createDataFrame([(1, 1, 1.0, 0.0, 0.0, 30.0, 4.0)], box)
    clipped = {r.conf: (r.y0, r.y1) for r in layout.clip_by_captures(df, caps, "conf").collect()}
    assert clipped[0.9] == (4.0, 10.0) and clipped[0.7] == (8.0, 20.0)
    square = spark.createDataFrame([(2, 1, 0.5, 0.0, 0.0, 100.0, 100.0), (3, 1, 0.4, 5.0, 5.0, 5.0, 9.0)], box)
    right, most = spark.createDataFrame([(2, 1, 1.0, 90.0, 0.0, 120.0, 100.0)], box), spark.createDataFrame([(2, 1, 1.0, 0.0, 0.0, 100.0, 51.0)], box)
    assert {r.conf: (r.y0, r.y1) for r in layout.clip_by_captures(square, right, "conf").collect()} == {0.5: (0.0, 100.0), 0.4: (5.0, 9.0)}
    assert {r.conf for r in layout.clip_by_captures(square, most, "conf").collect()} == {0.4}
    both = spark.createDataFrame([(2, 1, 2.0, 0.0, 60.0, 100.0, 99.0), (2, 1, 1.0, 0.0, 0.0, 100.0, 50.0)], box)
    assert {(r.y0, r.y1) for r in layout.clip_by_captures(square.where("conf = 0.5"), both, "conf").collect()} == {(50.0, 60.0)}
    assert layout.outside_tables(df, caps).count() == 1
    rects = spark.createDataFrame([(1, 0.0, 0.0, 5.0, 2.0), (1, 6.0, 0.2, 5.0, 2.0), (1, 0.0, 5.0, 3.0, 2.0)], "group bigint, x double, y double, w double, h double")
    assert sorted((r.y, r.w) for r in layout.merge_lines(rects).collect()) == [(0.0, 11.0), (5.0, 3.0)]


def test_contents_match(spark):
    entries = spark.createDataFrame([(1, 0, "Scope of work", 3), (1, 1, "Safety rules", 4), (1, 2, "Maintenance", 9), (1, 3, "Nothing like it", 5)], "doc_id bigint, pos int, clean_text string, page_number int")
    blocks = spark.createDataFrame([(1, 3, 0, "Scope of work"), (1, 4, 0, "Safety"), (1, 4, 1, "rules and more"), (1, 8, 0, "Maintenence")], "doc_id bigint, page int, block_idx int, text string")
    out = {r.pos: r for r in toc.match(entries, blocks).collect()}
    assert out[0].similarity == 1.0 and out[1].matched_text == "Safety rules and more" and 0.8 <= out[2].similarity < 1 and not out[3].matched
    assert toc.match_rate(toc.match(entries, blocks)).first().percent == 75.0
    twice = spark.createDataFrame([(1, 0, "alpha beta", 1, True), (1, 1, "beta", 1, True), (1, 2, "alpha", 1, False)], "doc_id bigint, pos int, clean_text string, page_number int, is_section boolean")
    words = spark.createDataFrame([(1, 1, 0, "alpha"), (1, 1, 1, "beta")], "doc_id bigint, page int, block_idx int, text string")
    assert {r.pos: r.matched for r in toc.match(twice, words).collect()} == {0: True, 1: False, 2: False}
    listed = spark.createDataFrame([(1, 1, "cover"), (1, 2, "Contents\nA .... 3"), (1, 3, "B ..... 9"), (1, 4, "text")], "doc_id bigint, page int, text string")
    assert tuple(toc.toc_pages(listed).first()) == (1, 2, 3)


def test_routes_and_parts(spark):
    assert one(spark, rag.route(F.lit("hi"), F.lit("REASON")), rag.route(F.lit("a question"), F.lit("I say reason")), rag.route(F.lit("a question"), F.lit(None).cast("string")))[:] == ("CHAT", "REASON", "SIMPLE")
    assert one(spark, rag.confidence(F.lit("COMPARE"), F.lit(2)), rag.confidence(F.lit("SIMPLE"), F.lit(2)), rag.confidence(F.lit("REASON"), F.lit(0)))[:] == ("medium", "high", "low")
    assert rag.parts_of("q", lambda p: 'x ["first part", "b", "second part"] y') == ["first part", "second part"] and rag.parts_of("q", lambda p: "[]") == ["q"]
    assert rag.parse_object('```json\n{"query": "x"}\n```') == {"query": "x"} and rag.rewritten("ab", "x" * 7, "f") == "f"
    hits = lambda q: spark.createDataFrame([(1, 0, q), (2, 1, "same")], "rank int, doc_id bigint, content string")
    plans = iter(['{"query": "one"}', '{"query": "two"}', '{"sufficient": true}'])
    assert sorted(r.content for r in rag.agent("q", lambda p: next(plans), hits).collect()) == ["one", "same", "two"]


def test_workspace(spark):
    now = F.lit("2024-01-01 12:00:00").cast("timestamp")
    sessions = spark.createDataFrame([("a", 1, "2024-01-01 11:00:00"), ("b", 1, "2024-01-01 13:00:00"), ("c", 9, "2024-01-02 00:00:00")], "token string, user_id bigint, e string").withColumn("expires_at", F.col("e").cast("timestamp"))
    users = spark.createDataFrame([(1, "u", "editor")], "id bigint, username string, role string")
    assert [r.token for r in workspace.valid_sessions(sessions, users, now).collect()] == ["b"]
    assert one(spark, workspace.page_range(F.lit("3-5"), F.lit(9)), workspace.page_range(F.lit("3-9"), F.lit(9)), workspace.page_range(F.lit("x"), F.lit(9)), workspace.page_range(F.lit("7"), F.lit(5)))[:] == ([3, 4, 5], None, None, None)
    stored = spark.createDataFrame([(1, 1, "done"), (1, 2, "done")], "doc_id bigint, page int, status string")
    jobs = spark.createDataFrame([(1, 2, 3, "running")], "doc_id bigint, first int, last int, status string")
    assert {r.page: r.status for r in workspace.page_overlay(stored, jobs).collect()} == {1: "done", 2: "running", 3: "running"}
    assert [r.page for r in workspace.without_range(stored, jobs).collect()] == [1]
    seq = spark.createDataFrame([(1, "t", 0, None), (1, "t", 1, 5), (1, "t", 2, None), (1, "t", 3, 2)], "doc_id bigint, category string, pos int, explicit int")
    assert [r.number for r in workspace.sequence_numbers(seq).orderBy("pos").collect()] == [1, 5, 6, 2]  # an explicit number is shown as it stands
    nodes = spark.createDataFrame([(1, 0, "figure"), (1, 1, "p"), (1, 2, "figure"), (1, 6, "p")], "doc_id bigint, pos int, kind string")
    assert {r.pos: r.figure for r in workspace.nearest_figure(nodes).collect()}[1] == 0


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.html").write_text("<h1>T</h1>")
    (tmp_path / "y.txt").write_text("no")
    assert [(r.url, r.html) for r in files.html_pages(spark, str(tmp_path)).collect()] == [("a/x.html", "<h1>T</h1>")]
    (tmp_path / "g.csv").write_bytes("﻿abbr,en,ko\nAB,alpha,가\n".encode())
    assert [tuple(r)[1:] for r in files.glossary_csv(spark, str(tmp_path / "g.csv")).collect()] == [("AB", "alpha", "가")]
    assert files.index_json(spark, f"{tmp_path}/none.json", "title string").count() == 0
    old, new = spark.createDataFrame([("u", None, 1), ("v", "s", 2)], "url string, section string, v int"), spark.createDataFrame([("u", None, 3)], "url string, section string, v int")
    assert sorted(r.v for r in files.upserted(old, new, ["url", "section"]).collect()) == [2, 3]
    sheet = spark.createDataFrame([(1, ["A", "", "", "u"]), (2, ["", " B ", "", ""]), (3, ["", "", "", ""])], "row_no int, cells array<string>")
    assert [tuple(r) for r in files.outline_levels(sheet).collect()] == [(1, 1, "A", "u"), (2, 2, "B", None)]
    assert files.demo_events(spark, 3, 7, 1).collect() == files.demo_events(spark, 3, 7, 1).collect()


def test_streamed_visits_are_those_of_the_batch(spark, tmp_path):
    from textloom.streaming import visits as streams

    rng = random.Random(0)
    start = dt.datetime(2024, 1, 1)
    rows = [(i, rng.randrange(5), start + dt.timedelta(seconds=rng.randrange(7200))) for i in range(300)] + [(999, 99, start + dt.timedelta(days=9))]
    spark.createDataFrame(rows, "event_id bigint, user_id bigint, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("event_id bigint, user_id bigint, ts timestamp").parquet(f"{tmp_path}/in")
    query = streams.visits(stream).writeStream.format("memory").queryName("visits_out").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(120)
    batch = usage.visits(spark.createDataFrame(rows[:-1], "event_id bigint, user_id bigint, ts timestamp"))
    got = sorted((r.user_id, r.first_ts, r.events) for r in spark.table("visits_out").collect())
    assert got == sorted((r.user_id, r.first_ts, r.events) for r in batch.collect())


def test_settings_and_paths(spark):
    from textloom.config import merged
    from textloom.operators import docx

    assert merged({"a": {"x": 1, "y": 2}, "b": 1}, {"a": {"y": 3}, "c": {}}) == {"a": {"x": 1, "y": 3}, "b": 1, "c": {}}
    assert one(spark, *[T.is_content_path(F.lit(p)) for p in ("contents/a.html", "contents/../x", "other/a")])[:] == (True, False, False)
    assert one(spark, T.in_range(F.lit(4), F.lit("3-7")), T.in_range(F.lit(4), F.lit("3")))[:] == (True, False)
    w = 'xmlns:w="w"'
    cell = lambda t, p="": f"<w:tc><w:tcPr>{p}</w:tcPr><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    table = f"<w:tbl><w:tr>{cell('a', '<w:vMerge w:val=%srestart%s/>' % (chr(34), chr(34)))}{cell('b', '<w:gridSpan w:val=%s2%s/>' % (chr(34), chr(34)))}</w:tr><w:tr>{cell('', '<w:vMerge/>')}{cell('c')}{cell('d')}</w:tr></w:tbl>"
    item = lambda t, n: f'<w:p><w:pPr><w:numPr><w:ilvl w:val="{n}"/></w:numPr></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
    body = f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:rPr><w:b/></w:rPr><w:t>T</w:t></w:r></w:p>{item("x", 0)}{item("y", 1)}{table}</w:body></w:document>'
    assert docx.body_html(body) == '<h1><strong>T</strong></h1><ul><li>x</li><ul><li>y</li></ul></ul><table><tr><td rowspan="2">a</td><td colspan="2">b</td></tr><tr><td>c</td><td>d</td></tr></table>'
    heads, places = spark.createDataFrame([(1, "a", 0.0), (1, "b", 50.0)], "doc_id bigint, id string, offset double"), spark.createDataFrame([(1, 49.0), (1, 60.0)], "doc_id bigint, at double")
    assert {r.at: r.id for r in trees.active_headings(heads, places).collect()} == {49.0: "a", 60.0: "b"}



def test_nearest_vectors_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_BYTES", 8 * 3 * 40)  # several blocks of both sides
    monkeypatch.setattr(search, "SLICE", 16)
    rng = random.Random(1)
    vectors = {i: [float(rng.randrange(4)) for _ in range(3)] if i % 3 else [1.0, 2.0, 3.0] for i in range(150)}
    rows = [*vectors.items(), (900, None), (901, [1.0])]
    df = spark.createDataFrame(rows, "doc_id bigint, embedding array<float>")
    asked = df.where("doc_id % 2 = 0").withColumnRenamed("doc_id", "query_id")
    got = {}
    for r in search.knn(df, asked, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.doc_id)
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assert got == {q: sorted(vectors, key=lambda i: (far(vectors[q], vectors[i]), i))[:5] for q in vectors if q % 2 == 0}
    assert search.knn(df.limit(0), asked, 5).count() == 0 and search.knn(df, asked.limit(0), 5).count() == 0
