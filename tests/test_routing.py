"""Routed retrieval and the agent over batches, against the same questions one by one."""

import json

import pytest
from pyspark.sql import functions as F

from textloom.operators import rag, routing
from textloom.plans import routing as plans
from textloom.plans.tables import items, questions

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "Radar", "the radar sees far."), (2, "Radio", "the radio talks far away."), (3, "Radar", "the radar sees far."), (4, "Gun", "a gun shoots."), (5, None, None), (6, "Ship", "radar and radio on a ship.")]
    return spark.createDataFrame(rows, "doc_id bigint, title string, content string").cache()


def key(rows):
    return sorted(tuple(r) for r in rows)


def test_batch_of_agents_equals_one_by_one(spark):
    docs = items(spark, SF)
    leg = routing.keyword_leg(docs)
    asked = questions(spark, SF).where("query_id < 4")
    hits, log = routing.agent(asked, docs, leg, plans.planner, 5)
    one_by_one, logs = [], []
    for q in range(4):
        h, g = routing.agent(asked.where(F.col("query_id") == q), docs, leg, plans.planner, 5)
        one_by_one += h.select("query_id", "place", "doc_id", "part").collect()
        logs += g.select("query_id", "steps", "search_queries").collect()
    assert key(hits.select("query_id", "place", "doc_id", "part").collect()) == key(one_by_one)
    assert sorted(log.select("query_id", "steps", "search_queries").collect()) == sorted(logs)
    assert {r.steps for r in logs} - {1, 2, 3} == set() and any(r.steps > 1 for r in logs)


def test_a_planner_is_asked_once_for_each_step_and_sees_what_was_found(spark, docs):
    asked = spark.createDataFrame([(1, "radar"), (2, "gun?"), (3, "nothing here")], "query_id bigint, text string")
    replies = {0: {1: {"sufficient": False, "query": "radar"}, 2: {"sufficient": True, "query": "gun"}, 3: "insufficient"}, 1: {1: {"sufficient": False, "query": "radio"}}, 2: {1: {"sufficient": True}}}
    seen_by_step = []

    def planner(seen):
        rows = seen.collect()
        seen_by_step.append({r.query_id: (r.found, r.summary) for r in rows})
        out = [(r.query_id, r.text, r.step, r.found, r.summary, json.dumps(reply) if isinstance(reply := replies[r.step][r.query_id], dict) else reply) for r in rows]
        return spark.createDataFrame(out, seen.schema.add("reply", "string"))

    hits, log = routing.agent(asked, docs, routing.keyword_leg(docs), planner, 5)
    assert [set(s) for s in seen_by_step] == [{1, 2, 3}, {1}, {1}]
    assert seen_by_step[0][1] == (0, "") and seen_by_step[1][1][0] == 2 and seen_by_step[1][1][1].startswith("1. [Radar] the radar sees far....")
    logs = {r.query_id: (r.steps, r.search_queries) for r in log.collect()}
    assert logs == {1: (3, ["radar", "radio"]), 2: (1, ["gun?"]), 3: (1, ["nothing here"])}
    found = {}
    for r in hits.orderBy("query_id", "place").collect():
        found.setdefault(r.query_id, []).append(r.doc_id)
    assert set(found[1]) == {1, 2, 6} and 3 not in found


def test_routes_confidence_and_pages(spark, docs):
    asked = spark.createDataFrame([(1, "radar", "SIMPLE"), (2, "hi", "SIMPLE"), (3, "radar. radio", "compare"), (4, "zzzzz", "nothing"), (5, "gun shoots", "REASON")], "query_id bigint, text string, reply string")
    pages = spark.createDataFrame([(4, 77, "Page", "what is on screen"), (1, 77, "Page", "what is on screen")], "query_id bigint, doc_id bigint, title string, content string")
    context, answers = routing.routed(asked.withColumn("search_text", F.col("text")), docs, routing.keyword_leg(docs), lambda c: F.split(c, r"\. "), plans.planner, 5, pages=pages)
    known = {r.query_id: (r.route, r.confidence, r.reasoning_steps, r.hits) for r in answers.collect()}
    assert known[1] == ("SIMPLE", "high", 1, 2) and known[2] == ("CHAT", "high", 0, 0) and known[4] == ("SIMPLE", "low", 1, 0)
    assert known[3] == ("COMPARE", "high", 1, 3) and known[5][0] == "REASON" and known[5][1] == "medium"
    found = {}
    for r in context.collect():
        found.setdefault(r.query_id, set()).add(r.doc_id)
    assert found[1] == {1, 6} and found[4] == {77} and 2 not in found  # equal contents count once, pages stand in for nothing


def test_no_questions(spark, docs):
    none = spark.createDataFrame([], "query_id bigint, text string, search_text string, reply string")
    context, answers = routing.routed(none, docs, routing.keyword_leg(docs), lambda c: F.array(c), plans.planner, 5)
    assert context.count() == 0 and answers.count() == 0


@pytest.mark.parametrize(
    ("reply", "want"),
    [
        ('{"sufficient": true, "query": "x"}', (True, "x")),
        ('{"sufficient": false, "query": " more "} and words', (False, "more")),
        ('Well:\n```json\n{"sufficient": false, "query": "y"}\n```', (False, "y")),
        ('this is insufficient, "query": "z"', (False, "z")),
        ("It is sufficient.", (True, "")),
        ("no idea", (False, "")),
        ("{broken sufficient", (True, "")),
        (None, (False, "")),
    ],
)
def test_plans(spark, reply, want):
    frame = spark.createDataFrame([(reply,)], "reply string")
    assert tuple(frame.select("*", routing.plan_of(F.col("reply")).alias("p")).select("p.*").first()) == want


def test_metadata_wishes(spark):
    rows = [(1, {"doc_category": "a", "parent": "p"}, "a/x"), (2, {"doc_category": "b"}, "a/x"), (3, {}, "a/x"), (4, None, "b/x"), (5, None, None)]
    frame = spark.createDataFrame(rows, "id int, meta map<string,string>, path string")

    def kept(filters):
        return [r.id for r in frame.where(routing.metadata_condition(filters, F.col("meta"), F.col("path"))).orderBy("id").collect()]

    assert kept({"doc_category": "a", "parent": ""}) == [1, 3]
    assert kept({"doc_category": "", "parent": None}) == [1, 2, 3, 4, 5]
    assert kept({"parent": "p"}) == [1, 3, 4, 5]


def test_parts_fall_back_to_the_question(spark):
    frame = spark.createDataFrame([("a b. c d",), ("one",), ("x. y",)], "t string")
    got = [r[0] for r in frame.select(routing.parts_column(F.split("t", r"\. "), F.col("t"))).collect()]
    assert got == [["a b", "c d"], ["one"], ["x. y"]] and rag.MOST_PARTS == 3
