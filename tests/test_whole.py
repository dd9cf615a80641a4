"""Queries that once read a part of their input, against plain versions over whole small tables."""

import html
from collections import Counter

import pytest

from textloom.operators import validation
from textloom.operators import workspace as operators_workspace
from textloom.plans import catalog, pages, search, tables, workspace


@pytest.fixture
def folder(spark, tmp_path):
    def made(**given):
        for name, (rows, schema) in given.items():
            spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return made


DOCUMENTS = "doc_id bigint, text string, lang string, source string"
BENCHMARK = "item_id bigint, text string"


def documents(*texts):
    return [(i, t, "en", "s") for i, t in enumerate(texts)], DOCUMENTS


def test_whole_benchmark_texts_are_searched(spark, folder):
    fill = [f"filler{i} more{i}" for i in range(12)]
    d = folder(documents=documents("only tenth here", "has ninth inside", *fill), benchmark=([(7, " a1 a2 a3  a4 a5 a6\ta7 a8 ninth tenth ")], BENCHMARK))
    assert [r.text for r in tables.questions(spark, d).collect()] == ["a1 a2 a3 a4 a5 a6 a7 a8 ninth tenth"]
    assert {r.doc_id for r in search.bm25_batch(spark, d).collect()} == {0, 1}
    assert {(r.doc_id, r.part) for r in search.decomposed_search(spark, d).collect()} == {(0, 1), (1, 1)}


def test_halves_hold_all_words(spark, folder):
    fill = [f"filler{i} more{i}" for i in range(12)]
    d = folder(documents=documents("one", "w2", "w3", *[f"x{i} y{i}" for i in range(3)], "w11", "w12", "w13", *fill), benchmark=([(0, " ".join(f"w{i}" for i in range(14)))], BENCHMARK))
    assert {(r.doc_id, r.part) for r in search.decomposed_search(spark, d).collect()} == {(1, 0), (2, 0), (6, 1), (7, 1), (8, 1)}


def test_every_term_has_its_frequencies(spark, folder):
    texts = ["aa bb aa", "bb cc", "Dd"]
    d = folder(documents=documents(*texts))
    df, tf = Counter(), Counter()
    for t in texts:
        words = t.lower().split() * 4  # the one line is the title, which counts three times
        df.update(set(words))
        tf.update(words)
    assert {(r.term, r.df, r.tf) for r in search.document_frequencies(spark, d).collect()} == {(w, df[w], tf[w]) for w in df}


def test_whole_pages_are_escaped(spark, folder):
    page = "<p class=\"x\">a & b</p>" * 40
    d = folder(pages=([(1, "http://x/y", page)], "page_id bigint, url string, html string"))
    assert [r.html for r in pages.escaped_html(spark, d).collect()] == [html.escape(page, quote=False).replace('"', "&quot;")]


def test_abbreviations_of_all_documents_are_known(spark, folder):
    d = folder(documents=documents("the ABC here", "an XY2 and XY2", "ABC of XY2, QRS"))
    want = {(0, "ABC", 1, "of 0"), (1, "XY2", 2, "of 1"), (2, "ABC", 1, "of 0"), (2, "XY2", 1, "of 1"), (2, "QRS", 1, "of 2")}
    assert {(r.doc_id, r.abbr, r.n, r.en) for r in catalog.abbreviation_join(spark, d).collect()} == want


def test_terms_of_any_letters_have_meanings(spark, folder):
    d = folder(documents=documents("Été one", "été two", "표준 std", "ab x"))
    assert {tuple(r) for r in catalog.abbreviation_multimap(spark, d).collect()} == {("ÉTÉ", 2, "one|two"), ("표준", 1, "std"), ("AB", 1, "x")}


def test_every_line_is_an_entry_and_a_block(spark, folder):
    lines = [f"line {i} " + "x" * 70 + f" tail {i} end" for i in range(45)]
    d = folder(documents=documents("\n".join(lines)))
    entries, blocks = workspace._contents(spark, d)
    assert {r.text for r in blocks.collect()} == {r.clean_text for r in entries.collect()} == set(lines)
    near = {(i, sum(abs(i // 10 - j // 10) <= 2 for j in range(45))) for i in range(45)}
    assert {(r.pos, r.blocks) for r in workspace.contents_candidates(spark, d).collect()} == near
    assert {tuple(r) for r in workspace.contents_match_rate(spark, d).collect()} == {(0, 45, 45, 100.0)}


def test_every_conversation_has_a_range(spark, folder):
    turns = [(c, t, "user", "x") for c in range(4) for t in range(3)]
    d = folder(conversations=(turns, "conv_id bigint, turn bigint, role string, text string"))
    status = {(r.doc_id, r.page): r.status for r in workspace.page_overlay(spark, d).collect()}
    assert status == {(c, t): "running" if t else "user" for c in range(4) for t in range(3)}
    assert {(r.doc_id, r.page) for r in workspace.pages_after_cancel(spark, d).collect()} == {(c, 0) for c in range(4)}


def test_repeated_sentences_have_their_own_places(spark):
    sentence = "a long sentence that stands twice."
    rows = spark.createDataFrame([(1, 0, f"{sentence} {sentence}")], "doc_id bigint, paragraph_index int, text string")
    got = validation.sentence_length(rows, "suggestion", 10).collect()
    assert sorted((r.char_start, r.char_end) for r in got) == [(0, 34), (35, 69)]


def test_low_explicit_numbers_leave_the_counter(spark):
    rows = spark.createDataFrame([(1, "c", i, e) for i, e in enumerate([None, None, 1, None, 9, None])], "doc_id bigint, category string, pos int, explicit int")
    assert [r.number for r in operators_workspace.sequence_numbers(rows).orderBy("pos").collect()] == [1, 2, 1, 3, 9, 10]
