"""Operators beyond the sizes, levels and depths at which they once ended, against plain versions."""

import posixpath
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from textloom.functions import emitters
from textloom.functions import text as T
from textloom.operators import evaluation, search, trees, validation
from textloom.sources import files, sheets


def test_outlines_of_any_level(spark):
    rng = random.Random(4)
    rows = [(d, p, rng.choice([1, 2, 3, 9, 10, 11, 40, 1000])) for d in range(6) for p in range(40)] + [(9, 0, None)]
    frame = spark.createDataFrame(rows, "doc_id bigint, pos bigint, level int")
    parents = {(r.doc_id, r.pos): r.parent for r in trees.parents_by_level(frame).collect()}
    ends = {(r.doc_id, r.pos): r.until for r in trees.until_next_heading(frame).collect()}
    for d, p, level in rows[:-1]:
        own = [x for x in rows if x[0] == d]
        assert parents[d, p] == max((q for _, q, n in own if q < p and n < level), default=None)
        assert ends[d, p] == min((q for _, q, n in own if q > p and n <= level), default=None)
    assert parents[9, 0] is None and trees.parents_by_level(frame.limit(0)).count() == 0


def test_urls_of_any_depth(spark):
    rng = random.Random(5)
    pairs = [("a/b/c.html", "../" * n + "z.html") for n in range(14)] + [("x/" * 30 + "p.html", "../" * 29 + "./q/../z.html")]
    pairs += [("/".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) + "/p.html", "/".join(rng.choice(["..", ".", "d", "e"]) for _ in range(rng.randint(0, 14))) + "/z.html") for _ in range(60)]
    frame = spark.createDataFrame([(b.lstrip("/"), u.lstrip("/")) for b, u in pairs], "b string, u string")
    for r in frame.select("*", T.resolve_url(F.col("b"), F.col("u")).alias("got")).collect():
        assert r.got == posixpath.normpath(posixpath.join(posixpath.dirname(r.b), r.u)), r
    some = [("a/b.html", "http://x/y"), ("a/b.html", "http://x/../y"), ("a/b.html", "#top"), ("a/b.html", "/r/../s"), ("a/b/c.html", "./"), ("a/b/c.html", ".."), ("", "x")]
    frame = spark.createDataFrame([(i, *s) for i, s in enumerate(some)], "i int, b string, u string")
    got = [r.got for r in frame.select("i", T.resolve_url(F.col("b"), F.col("u")).alias("got")).orderBy("i").collect()]
    assert got == ["http://x/y", "http://x/../y", "#top", "/s", "a/b/", "a/", "x"]


def test_vectors_of_several_sizes_and_broken_ones(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_BYTES", 8 * 4 * 10)
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0]), *[(i, [float(i), float(i % 3), 1.0]) for i in range(1, 30)], *[(i, [float(i), 2.0]) for i in range(30, 50)]]
    broken = [(90, [nan, 1.0, 1.0]), (91, [1.0, None, 1.0]), (92, [1.0, inf, 1.0]), (93, None), (94, [])]
    frame = spark.createDataFrame([*broken, *rows], "doc_id bigint, embedding array<double>")
    got = {}
    for r in search.knn(frame, frame.withColumnRenamed("doc_id", "query_id"), 4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.doc_id)
    known = dict(rows)
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assert got == {q: sorted((i for i in known if len(known[i]) == len(v)), key=lambda i: (far(v, known[i]), i))[:4] for q, v in known.items()}


def test_active_headings_over_many_ranges(spark):
    rng = random.Random(6)
    heads = [(0 if rng.random() < 0.8 else rng.randrange(1, 5), i, float(rng.randrange(500))) for i in range(300)] + [(7, 999, 5.0), (0, 998, None)]
    places = [(rng.randrange(6), float(rng.randrange(520))) for _ in range(300)]
    heads_frame, places_frame = spark.createDataFrame(heads, "doc_id bigint, id bigint, offset double"), spark.createDataFrame([*places, *places[:9], (1, None)], "doc_id bigint, at double")
    want = {}
    for doc, at in places:
        fit = [(o, i) for d, i, o in heads if d == doc and o is not None and o <= at + 10]
        if fit:
            want[doc, at] = max(fit)[1]
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = {(r.doc_id, r.at): r.id for r in trees.active_headings(heads_frame, places_frame, 10.0).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == want


def test_all_label_paths_at_once(spark):
    rng = random.Random(7)
    nodes = [(0, None, 0, "r", "u0")] + [(i, rng.randrange(i), rng.randrange(3), rng.choice("abc"), f"u{i}") for i in range(1, 80)] + [(200, None, 1, "r", "second")]
    paths = [(i, ["r"] + [rng.choice("abc") for _ in range(rng.randint(0, 4))]) for i in range(80)] + [(900, []), (901, ["x"]), (902, None)]

    def walk(labels):
        parent = None
        for label in labels:
            fit = sorted((n[2], n[0]) for n in nodes if n[1] == parent and n[3] == label)
            if not fit:
                return None
            parent = fit[0][1]
        return parent

    frame = spark.createDataFrame(nodes, "id bigint, parent_id bigint, pos int, label string, url string")
    got = trees.find_by_labels(frame, spark.createDataFrame(paths, "path_id bigint, labels array<string>")).collect()
    assert {r.path_id: r.id for r in got} == {i: walk(p) for i, p in paths if p and walk(p) is not None} and all(r.url == f"u{r.id}" for r in got)
    assert trees.find_by_labels(frame, spark.createDataFrame([], "path_id bigint, labels array<string>")).count() == 0


def test_prefixes_of_several_lengths(spark):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("ab") for _ in range(rng.randint(*n)))
    results = [(c, word((1, 6)) if rng.random() > 0.1 else None, rng.choice(["u1", "u2", None])) for c in range(8) for _ in range(12)]
    sections, urls = [(c, word((1, 5))) for c in range(6) for _ in range(2)] + [(7, "")], [(c, "u1") for c in range(4)]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(results)], "i int, case_id int, section string, url string")
    got = {r.i: r.correct for r in evaluation.matched(frame, spark.createDataFrame(sections, "case_id int, prefix string"), spark.createDataFrame(urls, "case_id int, url string")).collect()}
    assert got == {i: any(s is not None and s.startswith(p) for k, p in sections if k == c) or (c, u) in urls for i, (c, s, u) in enumerate(results)}


def test_negative_cases_are_right_without_results(spark):
    cases = spark.createDataFrame([(1, "negative", True), (2, "negative", True), (3, "x", False)], "case_id int, category string, negative boolean")
    results = spark.createDataFrame([("m", 2, 1, False), ("m", 3, 1, False), ("m", 3, 2, True)], "mode string, case_id int, rank int, correct boolean")
    got = {r.case_id: (r.hit, r.rr) for r in evaluation.score_cases(results, cases, 5, ["m"]).collect()}
    assert got == {1: (1, 1.0), 2: (0, 0.0), 3: (1, 0.5)}


def test_table_functions(spark):
    emitters.register(spark)
    docs = spark.createDataFrame([(1, "aXa aa\n\naaa"), (2, None), (3, "")], "doc_id bigint, text string")
    lateral = spark.sql("SELECT p.doc_id, p.nth, h.* FROM (SELECT d.doc_id, l.nth, l.line FROM {docs} d, LATERAL text_lines(d.text) l) p, LATERAL term_hits(p.line, array('aa', 'a', '', NULL)) h", docs=docs)
    plain = validation.forbidden_terms(validation.paragraphs_of(docs), "x", {"aa": "b", "a": "c"})
    assert sorted((r.doc_id, r.nth, r.char_start, r.char_end) for r in lateral.collect()) == sorted((r.doc_id, r.paragraph_index, r.char_start, r.char_end) for r in plain.collect())
    rng = random.Random(9)
    heads = [(d, p, rng.choice(["1", "2", "3", "1.1", "1.2", "2.1", "1.1.1", "x", None])) for d in range(4) for p in range(30)]
    gaps = spark.sql("SELECT * FROM numbering_gaps(TABLE({heads}))", heads=spark.createDataFrame(heads, "doc_id bigint, pos bigint, number string")).collect()
    want, last = [], {}
    for d, p, number in heads:
        if number and number != "x":
            parts = [int(x) for x in number.split(".")]
            before = last.get((d, len(parts)))
            if before and before[0][:-1] == parts[:-1] and before[0][-1] + 1 != parts[-1]:
                want.append((d, p, number, before[1]))
            last[d, len(parts)] = parts, number
    assert sorted(map(tuple, gaps)) == sorted(want)


def made_workbook(path, sheets_of):
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as book:
        named = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets_of, 1))
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{named}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets_of) + 1))
        book.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{links}</Relationships>")
        book.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>Guide</t></si><si><r><t>In</t></r><r><t>tro</t></r><rPh><t>hint</t></rPh></si></sst>')
        for i, rows in enumerate(sheets_of.values(), 1):
            book.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{main}"><sheetData>{rows}</sheetData></worksheet>')


@pytest.fixture
def book(tmp_path):
    menu = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="D1" t="inlineStr"><is><t>guide.html</t></is></c></row><row r="3"><c r="B3" t="s"><v>1</v></c><c r="C3"/><c r="D3" t="str"><v>intro.html</v></c></row><row r="4"/>'
    many = "".join(f'<row r="{n}"><c r="A{n}"><v>{n}</v></c><c r="B{n}" t="b"><v>{n % 2}</v></c><c r="AA{n}"><v>{n / 4}</v></c></row>' for n in range(1, 4502))
    made_workbook(f"{tmp_path}/menu.xlsx", {"Menu": menu, "Many": many})
    return f"{tmp_path}/menu.xlsx"


def test_workbooks(spark, book, tmp_path):
    frame = sheets.workbook(spark, book)
    assert frame.rdd.getNumPartitions() == 2
    assert {(r.sheet, r["count"]) for r in frame.groupBy("sheet").count().collect()} == {("Menu", 2), ("Many", 4501)}
    menu = sheets.workbook(spark, f"file://{book}", "Menu")
    assert [(r.row_no, r.cells) for r in menu.orderBy("row_no").collect()] == [(1, ["Guide", None, None, "guide.html"]), (3, [None, "Intro", None, "intro.html"])]
    assert [tuple(r) for r in files.outline_levels(menu.select("row_no", "cells")).orderBy("row_no").collect()] == [(1, 1, "Guide", "guide.html"), (3, 2, "Intro", "intro.html")]
    last = frame.where("sheet = 'Many' and row_no = 4501").first().cells
    assert len(last) == 27 and last[:2] == ["4501", "TRUE"] and last[26] == "1125.25"
    assert sheets.workbooks(spark, str(tmp_path)).drop("path").exceptAll(frame.drop("path")).count() == 0


def test_an_analyser_and_what_stands_in_for_it(spark):
    from textloom.plans.search import analyser

    frame = spark.createDataFrame([(1, "Radar-2 sees a PLANE, é!"), (2, None), (3, "")], "id int, text string")
    nouns = search.analysed(analyser, {"N", "SN"})
    assert [r.t for r in frame.select("id", nouns(F.col("text")).alias("t")).orderBy("id").collect()] == [["radar", "2", "sees", "a", "plane"], [], []]

    def absent():
        raise ImportError("no such library")

    plain = search.analysed(absent, {"N"})
    assert [r.t for r in frame.select("id", plain(F.col("text")).alias("t")).orderBy("id").collect()] == [["radar-2", "sees", "plane,", "é!"], [], []]


def test_reports_and_percents(spark):
    from textloom.operators import toc, usage

    entries = spark.createDataFrame([(1, 0, "One", 1, 3, True), (1, 1, "Fig", 1, None, False), (1, 2, "Two", 2, None, True)], "doc_id int, pos int, clean_text string, heading_level int, page_number int, is_section boolean")
    matches = spark.createDataFrame([(1, 0, True, 3, 0.9, []), (1, 2, False, None, None, [("Too " * 40, 5, 0.61)])], "doc_id int, pos int, matched boolean, page_num int, similarity double, suggestions array<struct<text:string,page:int,similarity:double>>")
    lines = [r.line for r in toc.report(entries, matches, "f.pdf").orderBy("line_no").collect()]
    assert lines == ["[report] f.pdf", "-" * 50, '✓ h1: "One" (p.3) → matched (similarity 0.90)', '- [skipped] "Fig" (figure or table)', '✗ h2: "Two" (p.?) → no match', f'   near: "{("Too " * 40)[:60]}" (p.5, 0.61)', "-" * 50, "2 sections | 1 matched (50.0%) | 1 not"]
    counts = spark.createDataFrame([("a", 8), ("b", 3), ("c", 0)], "k string, n int")
    assert {r.k: r.percent for r in usage.percent_of_most(counts).collect()} == {"a": 100, "b": 38, "c": 0}
    assert {r.percent for r in usage.percent_of_most(counts.withColumn("n", F.lit(0))).collect()} == {0} and usage.percent_of_most(counts.limit(0)).count() == 0
