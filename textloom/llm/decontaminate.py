"""Documents that hold a benchmark item within an edit budget, by pieces and Myers' bit-parallel distance.

Texts are compared by words: runs of ASCII letters and digits and of bytes above 127, A-Z lower-cased. An item of n words
may differ by k = floor(rate * n) words put in, left out or changed. Cut into k + 1 pieces, at least one piece then stands
unchanged in the document (pigeonhole), so exact hits of pieces give all candidates. Around each hit the least edit
distance of the whole item is found with one bit for each of its words.

In scripts without spaces (Chinese characters, kana, Thai, Lao, Burmese, Khmer) each character is a word. Items so short
that their budget is none match as they are, as a sequence of whole words. Null and empty items take no part. Null and empty documents match nothing. Repeated items and repeated documents give rows of their own; null ids stay null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage
from .text import LOWER, LOWER_RANDOM, Lookup, bounds, chunks, column_bytes, mix, prefix_hashes, range_hashes

RATE = 0.2
#: Words of the benchmark that go to the tasks at once. A larger benchmark is matched in several passes.
WORDS_AT_ONCE = 2_000_000
_INSIDE = (LOWER >= 128) | ((LOWER >= 48) & (LOWER <= 57)) | ((LOWER >= 97) & (LOWER <= 122))
_MATCH = "doc_id bigint, item_id bigint, n_words bigint, budget bigint, distance bigint, first_word bigint"


def _unspaced(data: np.ndarray) -> np.ndarray:
    """Where a character of a script without spaces begins, or the one after it, by the bytes of UTF-8."""
    after = np.r_[data[1:], np.uint8(0)]
    three = (data >= 0xE3) & (data <= 0xE9)  # U+3000 to U+9FFF
    three |= (data == 0xE0) & (after >= 0xB8) & (after <= 0xBB)  # Thai and Lao
    three |= (data == 0xE1) & ((after >= 0x80) & (after <= 0x82) | (after == 0x9E) | (after == 0x9F))  # Burmese and Khmer
    four = (data == 0xF0) & (after >= 0xA0) & (after <= 0xB3)  # further Chinese characters
    return np.unique(np.concatenate([f for at, n in ((three, 3), (four, 4)) for f in (np.flatnonzero(at), np.flatnonzero(at) + n)]))


def plain_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = _INSIDE[data]
    start, end, rows = bounds(data, offsets, inside)
    cut = _unspaced(data)
    cut = cut[(cut > 0) & (cut < len(data))]
    cut = np.setdiff1d(cut[inside[cut] & inside[cut - 1]], offsets)  # in the middle of a run
    if len(cut):
        start, end = np.union1d(start, cut), np.union1d(end, cut)
        rows = np.searchsorted(start, offsets)
    return mix(range_hashes(prefix_hashes(LOWER_RANDOM[data]), start, end) + (end - start).astype(np.uint64)), rows


def piece_bounds(n: int, budget: int) -> list[tuple[int, int]]:
    cut = [n * i // (budget + 1) for i in range(budget + 2)]
    return list(zip(cut[:-1], cut[1:], strict=True))


def least_distance(masks: dict[int, int], n: int, text: list[int], anchored: bool = False) -> tuple[int, int]:
    """The least edit distance of a pattern of n words to any run of `text`, and the end of the first such run (Myers).
    anchored: to runs from the start of `text` alone."""
    full, high = (1 << n) - 1, 1 << n - 1
    up, down, score, best, at = full, 0, n, n, 0
    for i, word in enumerate(text, 1):
        same = masks.get(word, 0)
        vertical = same | down
        horizontal = (((same & up) + up) ^ up) | same
        grow, shrink = down | (full & ~(horizontal | up)), up & horizontal
        if grow & high:
            score += 1
        elif shrink & high:
            score -= 1
        grow, shrink = (grow << 1 | anchored) & full, shrink << 1 & full
        up, down = shrink | (full & ~(vertical | grow)), grow & vertical
        if score < best:
            best, at = score, i
    return best, at


@dataclass
class Items:
    ids: list
    words: list[np.ndarray]
    budgets: list[int]


def _items(benchmark: DataFrame, rate: float) -> Items:
    rows = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text")).toArrow()
    data, offsets = column_bytes(rows.column("text"))
    word, at = plain_words(data, offsets)
    found = Items([], [], [])
    for i, item in enumerate(rows.column("item_id").to_pylist()):
        own = word[at[i] : at[i + 1]]
        if len(own):
            found.ids.append(item)
            found.words.append(own)
            found.budgets.append(int(rate * len(own)))
    return found


class _Matcher:
    def __init__(self, items: Items):
        self.items = items
        by_length: dict[int, list[tuple[int, int, int]]] = {}
        for i, (own, budget) in enumerate(zip(items.words, items.budgets, strict=True)):
            prefix = prefix_hashes(own)
            for a, b in piece_bounds(len(own), budget):
                h = int(range_hashes(prefix, np.array([a]), np.array([b]))[0])
                by_length.setdefault(b - a, []).append((h, i, a))
        self.pieces = {}
        for length, found in by_length.items():
            found.sort()
            keys = np.array([h for h, _, _ in found], np.uint64)
            distinct, first = np.unique(keys, return_index=True)
            self.pieces[length] = Lookup(distinct), np.r_[first, len(found)], found
        self.masks: dict[tuple[int, bool], dict[int, int]] = {}

    def mask(self, i: int, backwards: bool = False) -> dict[int, int]:
        if (i, backwards) not in self.masks:
            own: dict[int, int] = {}
            for at, word in enumerate(self.items.words[i].tolist()[:: -1 if backwards else 1]):
                own[word] = own.get(word, 0) | 1 << at
            self.masks[i, backwards] = own
        return self.masks[i, backwards]

    def find(self, word: np.ndarray, rows: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(row, item, distance, first word of the best window) for each item that a row holds."""
        windows: dict[tuple[int, int], list[tuple[int, int]]] = {}
        prefix = prefix_hashes(word)
        for length, (lookup, first, found) in self.pieces.items():
            if len(word) < length:
                continue
            start = np.arange(len(word) - length + 1)
            at = lookup(range_hashes(prefix, start, start + length))
            hit = np.flatnonzero(at >= 0)
            row = np.searchsorted(rows, hit, "right") - 1
            inside = hit + length <= rows[row + 1]
            for p, r, key in zip(hit[inside].tolist(), row[inside].tolist(), at[hit[inside]].tolist(), strict=True):
                for _, i, offset in found[first[key] : first[key + 1]]:
                    k, n = self.items.budgets[i], len(self.items.words[i])
                    windows.setdefault((r, i), []).append((max(int(rows[r]), p - offset - k), min(int(rows[r + 1]), p - offset + n + k)))
        out = []
        for (r, i), spans in windows.items():
            spans.sort()
            best, n = None, len(self.items.words[i])
            merged = [list(spans[0])]
            for a, b in spans[1:]:
                if a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            for a, b in merged:
                distance, end = least_distance(self.mask(i), n, word[a:b].tolist())
                if distance <= self.items.budgets[i] and (best is None or distance < best[0]):
                    best = distance, a, end
            if best is not None:
                distance, a, end = best
                _, back = least_distance(self.mask(i, True), n, word[a : a + end].tolist()[::-1], True)  # from the run's end
                out.append((r, i, distance, a + end - back - int(rows[r])))
        return out


def _matches(sent) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _Matcher(sent.value)
        items = matcher.items
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            ids = batch.column("doc_id")
            for first, _, part, at in chunks(data, offsets):
                for r, i, distance, word in matcher.find(*plain_words(part, at)):
                    values = ids[first + r].as_py(), items.ids[i], len(items.words[i]), items.budgets[i], distance, word
                    yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in values], ["doc_id", "item_id", "n_words", "budget", "distance", "first_word"])

    return run


def _passes(benchmark: DataFrame, rate: float, at_once: int) -> Iterator:
    """The benchmark's items, sent to the tasks in parts of bounded size."""
    spark = benchmark.sparkSession
    storage.small_batches(spark)
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-int(size) // (2 * at_once)))  # a word has two bytes at least, with what parts it from the next
    for i in range(parts):
        own = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == i) if parts > 1 else benchmark
        yield spark.sparkContext.broadcast(_items(own, rate))


def benchmark_matches(documents: DataFrame, benchmark: DataFrame, rate: float = RATE, at_once: int = WORDS_AT_ONCE) -> DataFrame:
    """A row for each document and item that it holds within the item's budget, at the best place."""
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return reduce(DataFrame.unionByName, [docs.mapInArrow(_matches(sent), _MATCH) for sent in _passes(benchmark, rate, at_once)])


def _clean(sent) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _Matcher(sent.value)
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            keep = np.ones(batch.num_rows, bool)
            for first, _, part, at in chunks(data, offsets):
                keep[[first + r for r, _, _, _ in matcher.find(*plain_words(part, at))]] = False
            yield batch.filter(pa.array(keep))

    return run


def without_matches(documents: DataFrame, benchmark: DataFrame, rate: float = RATE, at_once: int = WORDS_AT_ONCE) -> DataFrame:
    """The documents, with all their columns, that hold no item within its budget."""
    for sent in _passes(benchmark, rate, at_once):
        documents = documents.mapInArrow(_clean(sent), documents.schema)
    return documents
