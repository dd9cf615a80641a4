"""What surrounds a model that answers questions: routes, parts of questions, labels, and loops. Models are given in."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUTES = ("SIMPLE", "COMPARE", "REASON", "CHAT")
SHORTEST_QUESTION, MOST_PARTS, MOST_STEPS = 5, 3, 3


class Model(Protocol):
    def __call__(self, prompt: str) -> str: ...


def route(question: Column, reply: Column) -> Column:
    """The first of ROUTES that a classifier's reply names, CHAT for very short questions, SIMPLE without a reply."""
    named = F.coalesce(*[F.when(F.contains(F.upper(reply), F.lit(r)), r) for r in ROUTES], F.lit("SIMPLE"))
    return F.when(F.length(F.trim(question)) < SHORTEST_QUESTION, "CHAT").otherwise(named)


def confidence(chosen: Column, results: Column) -> Column:
    """high with two results or more (three to compare), medium with fewer, low with none."""
    enough = F.when(chosen == "COMPARE", 3).otherwise(2)
    return F.when(results >= enough, "high").when(results > 0, "medium").otherwise("low")


def parse_list(reply: str) -> list[str]:
    """A JSON array of texts: the whole reply, one in a fence or in brackets, else its lines without bullets."""
    for found in (reply, *re.findall(r"```(?:json)?\s*(.*?)```", reply, re.S), *re.findall(r"\[.*?\]", reply, re.S)):
        try:
            value = json.loads(found)
        except ValueError:
            continue
        if isinstance(value, list):
            return [str(v).strip() for v in value if str(v).strip()]
    lines = (re.sub(r"^\s*(?:[-*•]|\d+[.)])\s*", "", line).strip() for line in reply.splitlines())
    return [line for line in lines if line]


def parse_object(reply: str) -> dict | None:
    for found in (reply, *re.findall(r"```(?:json)?\s*(.*?)```", reply, re.S), *re.findall(r"\{.*\}", reply, re.S)):
        try:
            value = json.loads(found)
        except ValueError:
            continue
        if isinstance(value, dict):
            return value
    return None


def parts_of(question: str, model: Model) -> list[str]:
    """Up to MOST_PARTS parts of 3 to 200 characters; the question itself if fewer than two are valid."""
    try:
        parts = [p for p in parse_list(model(question)) if 3 <= len(p) <= 200][:MOST_PARTS]
    except Exception:  # a model that fails leaves the question whole
        parts = []
    return parts if len(parts) >= 2 else [question]


def rewritten(question: str, reply: str | None, fallback: str) -> str:
    """A model's rewriting unless it is empty or more than three times as long."""
    text = (reply or "").strip().strip('"')
    return text if text and len(text) <= 3 * len(question) else fallback


def agent(question: str, plan: Model, search: Callable[[str], DataFrame], most: int = MOST_STEPS) -> DataFrame:
    """Search as a model plans: in each step it gives {"sufficient": bool, "query": text}; hits add up, the first of equal
    beginnings stays. Without any step the question itself is searched. search: hits with rank, doc_id and content."""
    from .search import first_of_prefix

    found: DataFrame | None = None
    for step in range(most):
        wish = parse_object(plan(question)) or {}
        if wish.get("sufficient") or not wish.get("query"):
            break
        hits = search(str(wish["query"])).withColumn("step", F.lit(step))
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        found = search(question).withColumn("step", F.lit(0))
    return first_of_prefix(found, None, [F.col("step"), F.col("rank")])


def usable_models(models: DataFrame) -> DataFrame:
    """Models that are neither embedders nor rerankers."""
    name = F.lower("name")
    return models.where(~(F.contains(name, F.lit("embed")) | F.contains(name, F.lit("bge")) | F.contains(name, F.lit("rerank"))))


def with_default(hits: DataFrame, page: DataFrame) -> DataFrame:
    """The hits, or the current page if there are none. Both: doc_id, title, content."""
    none = hits.limit(1).agg(F.count("*").alias("n"))
    fallback = page.withColumn("_k", F.lit(1)).join(none.where("n = 0").select(F.lit(1).alias("_k")), "_k").drop("_k")
    return hits.unionByName(fallback)
