"""Brown class-based bigram scores for documents.

Text is cut into words (see text.py) and one end token. Every training word has a class of its own. Exchange clustering
on the driver seeds the classes: there words with a large share of the training tokens are units, and every other word
goes with the unit of its last two bytes. Then sweeps over all words, as Spark jobs, put each word where the likelihood
of the class bigrams rises most, by its own counts before and after each class; classes change between sweeps, and a
sweep after which the likelihood is lower is taken back. The model is

    P(word | previous) = P(class | previous class) * P(unit | class) * P(word | unit)

where the units of a class are its frequent words and one for the rest of its words. Each factor has add-one smoothing,
so the words seen in training and one unseen word for each class share all mass. An unseen word has the class of its
last two bytes' unit.

Empty and null texts hold the end token alone. Repeated rows are documents of their own. A null doc_id counts as the
empty text when it is dealt to training. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import storage
from .text import Lookup, chunks, column_bytes, distinct, mix, words

#: A word with at least this share of all training tokens is a unit of the seed: 2 ** 11 words at most, in a corpus of any size.
UNIT_SHARE = 2**-11
#: Counts of words with at least this share go to every task: 2 ** 20 words at most, of 24 bytes. Others are joined.
KNOWN_SHARE = 2**-20
SUFFIX_UNITS = 512
CLASSES = 64
SWEEPS = 8
WORD_SWEEPS = 2  # after the seed, in Spark: each half of the words moves once
MOVING_PARTS = 2  # a sweep moves one of so many parts of the words
BLOCK_BYTES = 1 << 18
#: How often a word has a class after it (at), before it (CLASSES + at), or itself (2 * CLASSES). Those of once go as `at` alone.
ENTRY = np.dtype([("at", "u1"), ("n", "<i8")])
NONE = 255  # the class of a word that training has not
END = np.uint64(0)  # the hash that stands for the end token
FLUSH = 1 << 21
SWEEP_TOKENS = 1 << 20  # tokens whose contexts a task of a sweep holds
TABLED = 32  # of fewer neighbours the gains are in a table
PART_TOKENS = 1 << 21  # tokens for each part of the word hashes
PACK = "zstd"


def suffix_unit(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The unit of a rare word, by its last two bytes."""
    last = data[end - 1].astype(np.int64)
    second = np.where(end - start > 1, data[np.maximum(end - 2, 0)].astype(np.int64), 0)
    return (second * 256 + last) * 40503 % 65521 % SUFFIX_UNITS


def with_end(word: np.ndarray, rows: np.ndarray, fill) -> tuple[np.ndarray, np.ndarray]:
    """The rows with one more element after each."""
    return np.insert(word, rows[1:], fill), rows + np.arange(len(rows))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, units, sums, waiting = [], [], [], 0

    def merged():
        k, u, n = np.concatenate(keys), np.concatenate(units), np.concatenate(sums)
        order = np.argsort(k, kind="stable")
        k, u, n = k[order], u[order], n[order]
        first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        return k[first], u[first], np.add.reduceat(n, first)

    for batch in batches:
        data, offsets = column_bytes(batch.column("text"))
        for first, last, part, at in chunks(data, offsets):
            h, _, start, end = words(part, at)
            k, where, n = np.unique(h, return_index=True, return_counts=True)
            keys += [k, np.array([END])]
            units += [suffix_unit(part, start[where], end[where]), np.array([-1])]
            sums += [n, np.array([last - first])]
            waiting += len(k) + 1
            if waiting > FLUSH:
                k, u, n = merged()
                keys, units, sums, waiting = [k], [u], [n], 0
    if keys:
        k, u, n = merged()
        for i in range(0, len(k), 1 << 17):
            s = slice(i, i + (1 << 17))
            yield pa.record_batch({"word": k[s].view(np.int64), "unit": u[s].astype(np.int32), "n": n[s].astype(np.int64)})


def word_counts(docs: DataFrame) -> DataFrame:
    """word (hash), unit (of its suffix), n: the exact count of every word, and of the end token, over all rows."""
    each = docs.select("text").mapInArrow(_count_words, "word bigint, unit int, n bigint")
    return each.groupBy("word").agg(F.max("unit").alias("unit"), F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """What every task knows of the counts; its size is bounded by UNIT_SHARE, KNOWN_SHARE and SUFFIX_UNITS."""

    tokens: int
    types: int
    known: np.ndarray  # hashes, the most frequent first
    known_n: np.ndarray
    known_suffix: np.ndarray
    unit_words: int  # so many of them are units
    rare_tokens: np.ndarray | None = None  # of each class: tokens and types that are no units
    rare_types: np.ndarray | None = None

    @property
    def units(self) -> int:
        return self.unit_words + SUFFIX_UNITS

    @property
    def end(self) -> int:
        return int(np.flatnonzero(self.known == END)[0])

    def seed_units(self) -> np.ndarray:
        """The seed's unit of each known word."""
        at = np.arange(len(self.known))
        return np.where(at < self.unit_words, at, self.unit_words + self.known_suffix)


def vocabulary(counts: DataFrame) -> Vocabulary:
    total = counts.agg(F.sum("n"), F.count("*")).first()
    tokens, types = int(total[0] or 0), int(total[1])
    least_unit, least_known = max(1, tokens * UNIT_SHARE), max(1, tokens * KNOWN_SHARE)
    is_end = F.col("word") == int(END)
    known = counts.where((F.col("n") >= least_known) | is_end).select("word", "n", "unit").toArrow().to_pandas()
    if not tokens:
        known.loc[0] = (int(END), 0, 0)
    known = known.sort_values(["n", "word"], ascending=[False, True])
    unit = (known.n >= least_unit) | (known.word == int(END))
    known = known.assign(rest=~unit).sort_values("rest", kind="stable")
    suffix = np.maximum(known.unit.to_numpy(np.int64), 0)
    return Vocabulary(tokens, types, known.word.to_numpy(np.int64).view(np.uint64), known.n.to_numpy(np.int64), suffix, int(unit.sum()))


def _packed(x: np.ndarray) -> pa.Array:
    """One value: the array's bytes, compressed after their number."""
    raw = x.tobytes()
    return pa.array([len(raw).to_bytes(8, "little") + pa.compress(raw, PACK, asbytes=True)])


def _unpacked(value: pa.Scalar, kind) -> np.ndarray:
    raw = value.as_py()
    return np.frombuffer(pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), PACK), kind)


_CODED = "block bigint, doc_id array<bigint>, held_out array<boolean>, rows binary, codes binary, words array<bigint>, suffix binary"


def _coder(sent) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = sent.value
        lookup, end_at, block = Lookup(v.known), v.end, TaskContext.get().partitionId() << 33
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            for first, last, part, at in chunks(data, offsets, BLOCK_BYTES):
                h, rows, start, end = words(part, at)
                code = lookup(h)
                rare = np.flatnonzero(code < 0)
                own, where, back = np.unique(h[rare], return_index=True, return_inverse=True)
                code[rare] = len(v.known) + back
                suffix = suffix_unit(part, start[rare[where]], end[rare[where]])
                code, rows = with_end(code, rows, end_at)
                whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                yield pa.record_batch({
                    "block": pa.array([block]), "doc_id": whole(batch.column("doc_id").slice(first, last - first)), "held_out": whole(batch.column("held_out").slice(first, last - first)),
                    "rows": _packed(rows.astype(np.int64)), "codes": _packed(code.astype(np.int32)),
                    "words": whole(pa.array(own.view(np.int64))), "suffix": _packed(suffix.astype(np.int16)),
                })
                block += 1

    return run


def coded(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """Blocks of whole documents (doc_id, text, held_out): each token as its place among the known words, or after
    them among the block's own `words`."""
    sent = docs.sparkSession.sparkContext.broadcast(v)
    return docs.select("doc_id", "text", "held_out").mapInArrow(_coder(sent), _CODED)


def _part(word: np.ndarray, bits: int) -> np.ndarray:
    return (word >> np.uint64(63 - bits) >> np.uint64(1)).astype(np.int32)


def _asker(bits: int) -> Callable:
    """Of each block its own words by parts of the hashes; words are in the order of hashes, so each part is a run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                own = batch.column("words")[i].values.to_numpy(zero_copy_only=False).view(np.uint64)
                part, first = np.unique(_part(own, bits), return_index=True)
                ends = np.r_[first[1:], len(own)]
                asked = [own[a:b].tobytes() for a, b in zip(first.tolist(), ends.tolist(), strict=False)]
                yield pa.record_batch({"part": part, "block": pa.array([batch.column("block")[i].as_py()] * len(part), pa.int64()), "words": pa.array(asked, pa.binary())})

    return run


def _classes_by_part(bits: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = _part(batch.column("word").to_numpy().view(np.uint64), bits)
            yield pa.record_batch({"part": part, "word": batch.column("word"), "class": batch.column("class"), "n": batch.column("n")})

    return run


def _answer(asked: pa.Table, classes: pa.Table) -> pa.Table:
    """The class (NONE if training has not the word) and the count of each asked word of one part of the hashes."""
    word = classes.column("word").to_numpy().view(np.uint64)
    order = np.argsort(word)
    word, own_class, own_n = word[order], classes.column("class").to_numpy()[order], classes.column("n").to_numpy()[order]
    found_class, found_n = [], []
    for raw in asked.column("words").to_pylist():
        h = np.frombuffer(raw, np.uint64)
        c, n = np.full(len(h), NONE, np.uint8), np.zeros(len(h), np.int64)
        if len(word):
            at = np.minimum(np.searchsorted(word, h), len(word) - 1)
            has = word[at] == h
            c[has], n[has] = own_class[at[has]], own_n[at[has]]
        found_class.append(c.tobytes())
        found_n.append(n.tobytes())
    return pa.table({"part": asked.column("part"), "block": asked.column("block"), "class": pa.array(found_class, pa.binary()), "n": pa.array(found_n, pa.binary())})


def resolved(blocks: DataFrame, classes: DataFrame, tokens: int) -> DataFrame:
    """Blocks with the class and count of each of their own words that training has.

    Blocks ask each part of the word hashes for a run of words, and the answers, a byte and a number for each, come back
    in the order of parts. The parts grow in number with the tokens.
    """
    spark = blocks.sparkSession
    bits = max(1, int(np.ceil(np.log2(storage.tasks(spark, tokens, PART_TOKENS)))))
    asked = blocks.select("block", "words").mapInArrow(_asker(bits), "part int, block bigint, words binary")
    dealt = classes.select("word", "class", "n").mapInArrow(_classes_by_part(bits), "part int, word bigint, class int, n bigint")
    answers = asked.groupBy("part").cogroup(dealt.groupBy("part")).applyInArrow(_answer, "part int, block bigint, class binary, n binary")
    answers = storage.materialize(answers, "brown-answers")
    found = answers.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("part", "class", "n"))).alias("found"))
    out = storage.materialize(blocks.drop("found").join(found, "block", "left"), "brown-blocks")
    storage.discard(answers)
    return out


@dataclass
class Block:
    """One block: docs' first tokens, and of each token its code; of each code the suffix, and what is found."""

    rows: np.ndarray
    codes: np.ndarray
    held: np.ndarray
    words: np.ndarray
    suffix: np.ndarray
    found_class: np.ndarray  # of own words, -1 where nothing is found
    found_n: np.ndarray

    def classes(self, known: np.ndarray, suffix: np.ndarray) -> np.ndarray:
        """The class of each code: of known words, and of own words by what is found, else by their suffix."""
        return np.r_[known, np.where(self.found_class >= 0, self.found_class, suffix[self.suffix])]

    def trained(self) -> np.ndarray:
        return np.repeat(~self.held, np.diff(self.rows))


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, Block]]:
    has_found = "found" in batch.schema.names
    for i in range(len(batch)):
        raw = lambda name, kind: _unpacked(batch.column(name)[i], kind).astype(np.int64)  # noqa: E731, B023
        own = batch.column("words")[i].values.to_numpy(zero_copy_only=False).view(np.uint64)
        c, n = np.full(len(own), -1), np.zeros(len(own), np.int64)
        if has_found and batch.column("found")[i].is_valid:
            x = batch.column("found")[i].values
            c = np.frombuffer(b"".join(x.field("class").to_pylist()), np.uint8).astype(np.int64)
            c[c == NONE] = -1
            n = np.frombuffer(b"".join(x.field("n").to_pylist()), np.int64)
        held = batch.column("held_out")[i].values.to_numpy(zero_copy_only=False).astype(bool)
        yield i, Block(raw("rows", np.int64), raw("codes", np.int32), held, own, raw("suffix", np.int16), c, n)


def _bigram_counter(sent) -> Callable:
    """Counts pairs of classes of tokens that follow each other in training."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, suffix, many, end_at = sent.value
        keys, sums, waiting = [], [], 0
        for batch in batches:
            for _, b in _blocks(batch):
                c = b.classes(known, suffix)
                now = c[b.codes[b.trained()]]
                before = np.r_[c[end_at], now[:-1]]  # a document begins after the end of another
                k, n = distinct(before * many + now)
                keys.append(k)
                sums.append(n)
                waiting += len(k)
                if waiting > FLUSH:
                    k, n = distinct(np.concatenate(keys), np.concatenate(sums))
                    keys, sums, waiting = [k], [n], 0
        if keys:
            k, n = distinct(np.concatenate(keys), np.concatenate(sums))
            yield pa.record_batch({"pair": k.astype(np.int64), "n": n.astype(np.int64)})

    return run


def _bigrams(blocks: DataFrame, known: np.ndarray, suffix: np.ndarray, many: int, end_at: int) -> np.ndarray:
    sent = blocks.sparkSession.sparkContext.broadcast((known, suffix, many, end_at))
    table = blocks.mapInArrow(_bigram_counter(sent), "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((many, many))
    out.flat[table.column("pair").to_numpy()] = table.column("n").to_numpy()
    return out


def exchange(pairs: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """The class of each unit. pairs[i, j]: how often unit j follows unit i.

    Units start dealt out in turn, most frequent first. A sweep takes each unit out of its class and puts it where the
    sum of n * log(n) over class bigrams, less that over the classes on either side, is largest; ties go to the first
    class. It ends when a sweep moves nothing.
    """
    units = len(pairs)
    k = min(classes, max(1, units))
    size = pairs.sum(0) + pairs.sum(1)
    order = np.argsort(-size, kind="stable")
    at = np.empty(units, np.int64)
    at[order] = np.arange(units) % k
    member = np.zeros((units, k))
    member[np.arange(units), at] = 1
    to_class, from_class = pairs @ member, pairs.T @ member  # unit -> class, and class -> unit
    both = member.T @ to_class

    def f(x):
        return x * np.log(np.maximum(x, 1))

    for _ in range(sweeps):
        moved = 0
        for u in order:
            if not size[u]:
                continue
            old, out, into, own = at[u], to_class[u], from_class[u], pairs[u, u]
            # out and into hold the unit's own class as it is now; take the unit's bigram with itself apart
            out_rest, into_rest = out.copy(), into.copy()
            out_rest[old] -= own
            into_rest[old] -= own
            both[old, :] -= out_rest
            both[:, old] -= into_rest
            both[old, old] -= own
            left, right = both.sum(1), both.sum(0)
            gain = (f(both + out_rest[None, :]) - f(both)).sum(1) + (f(both + into_rest[:, None]) - f(both)).sum(0)
            d = np.arange(k)
            cell = both[d, d]
            gain += f(cell + out_rest + into_rest + own) - f(cell) - (f(cell + out_rest) - f(cell)) - (f(cell + into_rest) - f(cell))
            gain -= f(left + out_rest.sum() + own) - f(left) + f(right + into_rest.sum() + own) - f(right)
            new = int(np.argmax(gain))
            both[new, :] += out_rest
            both[:, new] += into_rest
            both[new, new] += own
            if new != old:
                at[u] = new
                moved += 1
                to_class[:, old] -= pairs[:, u]
                to_class[:, new] += pairs[:, u]
                from_class[:, old] -= pairs[u, :]
                from_class[:, new] += pairs[u, :]
        if not moved:
            break
    return at


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(both: np.ndarray) -> float:
    return float(_xlogx(both).sum() - _xlogx(both.sum(0)).sum() - _xlogx(both.sum(1)).sum())


def _context_counter(sent, number: int, parts: int) -> Callable:
    """word, class, once, more (see ENTRY): how often each class stands before and after a word, in training."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, known, suffix = sent.value
        words, olds, ats, sums, waiting = [], [], [], [], 0

        def merged():
            h, old, at, n = (np.concatenate(x) for x in (words, olds, ats, sums))
            order = np.lexsort((at, h))
            h, old, at, n = h[order], old[order], at[order], n[order]
            first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (at[1:] != at[:-1])])
            h, old, at, n = h[first], old[first], at[first], np.add.reduceat(n, first)
            head = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            entries = np.empty(len(h), ENTRY)
            entries["at"], entries["n"] = at, n
            once = n == 1
            bounds = np.r_[head, len(h)]
            before = np.r_[0, np.cumsum(once)]  # of entries of once

            def packed(items, cut):
                offsets = ((cut - cut[0]) * items.itemsize).astype(np.int32)
                return pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(items[cut[0] : cut[-1]].tobytes())])

            single, more = entries["at"][once], entries[~once]
            for i in range(0, len(head), 1 << 14):
                cut = bounds[i : i + (1 << 14) + 1]
                yield pa.record_batch({"word": h[cut[:-1]].view(np.int64), "class": old[cut[:-1]].astype(np.int32), "once": packed(single, before[cut]), "more": packed(more, cut - before[cut])})

        for batch in batches:
            for _, b in _blocks(batch):
                c = b.classes(known, suffix)
                now = b.codes[b.trained()]
                if not len(now):
                    continue
                before = np.r_[v.end, now[:-1]]
                same = before == now
                may = moves_in(np.r_[v.known, b.words], number, parts)  # of the others only their number is told
                as_second = now * 256 + np.where(may[now], np.where(same, 2 * CLASSES, CLASSES + c[before]), CLASSES)
                as_first = (before * 256 + c[now])[~same & may[before]]
                key, n = distinct(np.r_[as_second, as_first])
                code = key >> 8
                words.append(np.r_[v.known, b.words][code])
                olds.append(c[code])
                ats.append(key & 255)
                sums.append(n)
                waiting += len(key)
                if waiting > FLUSH:
                    yield from merged()
                    words, olds, ats, sums, waiting = [], [], [], [], 0
        if waiting:
            yield from merged()

    return run


def gain_tables(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What x more of a neighbour of class j add to each class's sum, and what x fewer take: [x * k + j, class], x < TABLED."""
    k = len(cells)
    x = np.arange(TABLED)[:, None, None]
    add, less = _xlogx(cells + x) - _xlogx(cells), _xlogx(cells) - _xlogx(np.maximum(cells - x, 0))
    return add.reshape(-1, k), less.reshape(-1, k)


def best_classes(both: np.ndarray, old: np.ndarray, word: np.ndarray, at: np.ndarray, n: np.ndarray, tables: list | None = None) -> np.ndarray:
    """The best class of each word, every other word staying where it is; a tie leaves a word in its class.

    both: the class bigrams with the words in their old classes. An entry says that `word` (a place in old, ascending)
    has n neighbours of the kind `at` (see ENTRY). tables: gain_tables of both.T and of both.
    """
    k, m = len(both), len(old)
    tables = tables or [gain_tables(both.T), gain_tables(both)]
    table = np.bincount(word * (2 * CLASSES + 1) + at, n, m * (2 * CLASSES + 1)).reshape(m, -1)
    out, into, own = table[:, :k], table[:, CLASSES : CLASSES + k], table[:, -1:]
    all_words = np.arange(m)
    gain = np.zeros((m, k))
    for side, cells, other, (add, less) in ((0, both.T, into, tables[0]), (CLASSES, both, out, tables[1])):
        mine = (at >= side) & (at < side + k)
        each_w, each_j, each_x = word[mine], at[mine] - side, n[mine]
        # few neighbours, of another class than the word's own: what they add to a cell is in a table
        few = (each_x < TABLED) & (each_j != old[each_w])
        few_w, key = each_w[few], each_x[few] * k + each_j[few]
        for i in range(0, len(key), 1 << 12):
            w = few_w[i : i + (1 << 12)]
            head = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
            gain[w[head]] += np.add.reduceat(add[key[i : i + (1 << 12)]], head)
        gain[all_words, old] += np.bincount(few_w, less[key, old[few_w]] - add[key, old[few_w]], m)
        each_w, each_j, each_x = each_w[~few], each_j[~few], each_x[~few].astype(float)
        for i in range(0, len(each_w), 1 << 12):
            w, j, x = each_w[i : i + (1 << 12)], each_j[i : i + (1 << 12)], each_x[i : i + (1 << 12)]
            base = cells[j]  # of each class the cell that the entry would join, with the word taken out
            base[np.arange(len(w)), old[w]] -= x
            its = np.flatnonzero(j == old[w])
            base[its] -= other[w[its]]
            base[its, j[its]] -= own[w[its], 0]
            head = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
            gain[w[head]] += np.add.reduceat(_xlogx(base + x[:, None]) - _xlogx(base), head)
    w, c = np.nonzero(((out > 0) & (into > 0)) | (own > 0))  # where a class meets itself in more ways than one
    o, i, self = out[w, c], into[w, c], own[w, 0]
    cell = both[c, c] - np.where(c == old[w], o + i + self, 0)
    gain[w, c] += _xlogx(cell + o + i + self) + _xlogx(cell) - _xlogx(cell + o) - _xlogx(cell + i)
    for margin, size in ((both.sum(1), out.sum(1) + own[:, 0]), (both.sum(0), into.sum(1) + own[:, 0])):
        sizes, of = np.unique(size, return_inverse=True)
        gain -= (_xlogx(margin + sizes[:, None]) - _xlogx(margin))[of]
        mine = margin[old]
        gain[all_words, old] -= 2 * _xlogx(mine) - _xlogx(mine - size) - _xlogx(mine + size)
    new = gain.argmax(1)
    return np.where(gain[all_words, new] > gain[all_words, old] + 1e-6, new, old)


def moves_in(word: np.ndarray, number: int, parts: int) -> np.ndarray:
    """Whether words may move in a sweep: those of one of so many parts, by their hash, each part in its turn."""
    return mix(np.ascontiguousarray(word).view(np.uint64)) % np.uint64(parts) == np.uint64(number % parts)


def _assigner(sent_both, number: int, parts: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = sent_both.value
        tables = [gain_tables(both.T), gain_tables(both)]
        words, olds, lengths, entries = [], [], {"once": [], "more": []}, {"once": [], "more": []}
        for batch in batches:
            words.append(batch.column("word").to_numpy())
            olds.append(batch.column("class").to_numpy())
            for name, kind in (("once", np.dtype("u1")), ("more", ENTRY)):
                data, offsets = column_bytes(batch.column(name))
                lengths[name].append(np.diff(offsets) // kind.itemsize)
                entries[name].append(np.frombuffer(data.tobytes(), kind))
        if not words or not sum(map(len, words)):
            return
        word, first, at = np.unique(np.concatenate(words), return_index=True, return_inverse=True)
        old = np.concatenate(olds)[first]
        w = np.r_[np.repeat(at, np.concatenate(lengths["once"])), np.repeat(at, np.concatenate(lengths["more"]))]
        single, more = np.concatenate(entries["once"]), np.concatenate(entries["more"])
        kind, times = np.r_[single, more["at"]], np.r_[np.ones(len(single), np.int64), more["n"]]
        key, n = distinct(w.astype(np.int64) * 256 + kind, times)
        w, kind = key >> 8, key & 255
        as_second = kind >= CLASSES  # each token of a word has one before it
        count = np.bincount(w[as_second], n[as_second], len(word)).astype(np.int64)
        for i in range(0, len(word), 1 << 12):
            a, b = np.searchsorted(w, [i, i + (1 << 12)])
            best = old[i : i + (1 << 12)].astype(np.int64)
            may = moves_in(word[i : i + (1 << 12)], number, parts)
            its = np.flatnonzero(may[w[a:b] - i])
            place = np.cumsum(may) - 1
            if may.any():
                best[may] = best_classes(both, best[may], place[w[a:b][its] - i], kind[a:b][its], n[a:b][its], tables)
            yield pa.record_batch({"word": word[i : i + (1 << 12)], "class": best.astype(np.int32), "n": count[i : i + (1 << 12)]})

    return run


def sweep(blocks: DataFrame, v: Vocabulary, known: np.ndarray, suffix: np.ndarray, both: np.ndarray, number: int) -> DataFrame:
    """word, class, n: for the words that may move in this sweep the best class, by their counts against the classes as they
    are; for the others the class that they have. All words at once would swing past the best classes."""
    context = blocks.sparkSession.sparkContext.broadcast((v, known, suffix))
    each = blocks.mapInArrow(_context_counter(context, number, MOVING_PARTS), "word bigint, class int, once binary, more binary")
    dealt = each.repartition(storage.tasks(blocks.sparkSession, v.tokens, SWEEP_TOKENS), "word")
    return dealt.mapInArrow(_assigner(blocks.sparkSession.sparkContext.broadcast(both), number, MOVING_PARTS), "word bigint, class int, n bigint")


@dataclass
class Model:
    vocabulary: Vocabulary
    known_class: np.ndarray
    suffix_class: np.ndarray  # of words that training has not
    class_of: np.ndarray  # of each unit: the unit words, then the rest of each class
    transition: np.ndarray  # log10 P(class | previous class)
    emission: np.ndarray  # log10 P(unit | class)
    rare: np.ndarray  # log10 of what divides n + 1 in the rest of a class


def learn(blocks: DataFrame, v: Vocabulary, counts: DataFrame) -> tuple[Model, DataFrame, DataFrame]:
    """The model, the classes of all training words (word, class, n), and the blocks with those found.

    The seed's bigram table that comes to the driver has at most (2 ** 11 + 1 + SUFFIX_UNITS) ** 2 rows, those of the
    sweeps CLASSES ** 2; the classes of words that are not known to every task stay in Spark.
    """
    seed = exchange(_bigrams(blocks, v.seed_units(), v.unit_words + np.arange(SUFFIX_UNITS), v.units, v.end))
    k = int(seed.max(initial=0)) + 1
    suffix = seed[v.unit_words :]
    known = seed[v.seed_units()]
    both = _bigrams(blocks, known, suffix, k, v.end)
    seeds = F.element_at(F.array(*[F.lit(int(c)) for c in suffix]), F.greatest("unit", F.lit(0)) + 1)
    of_units = blocks.sparkSession.createDataFrame([(int(w), int(c)) for w, c in zip(v.known[: v.unit_words].view(np.int64), known, strict=False)], "word bigint, own int")
    classes = counts.join(F.broadcast(of_units), "word", "left").select("word", F.coalesce("own", seeds).alias("class"), "n")
    found = None
    for number in range(WORD_SWEEPS):
        moved = sweep(blocks if found is None else found, v, known, suffix, both, number)
        now = storage.materialize(moved, "brown-classes")
        at_known = now.where((F.col("n") >= max(1, v.tokens * KNOWN_SHARE)) | (F.col("word") == int(END))).toArrow().to_pandas()
        own = known.copy()
        own[Lookup(v.known)(at_known.word.to_numpy(np.int64).view(np.uint64))] = at_known["class"]
        next_found = resolved(blocks if found is None else found, now, v.tokens)
        next_both = _bigrams(next_found, own, suffix, k, v.end)
        if likelihood(next_both) <= likelihood(both):
            storage.discard(next_found)
            break
        storage.discard(blocks if found is None else found)
        found, known, both, classes = next_found, own, next_both, now
    if found is None:
        found = resolved(blocks, classes, v.tokens)
    rest = classes.where((F.col("n") < max(1, v.tokens * UNIT_SHARE)) & (F.col("word") != int(END)))
    rest = rest.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("types")).toPandas()
    rare_tokens, rare_types = np.zeros(k), np.zeros(k)
    rare_tokens[rest["class"]], rare_types[rest["class"]] = rest.n, rest.types
    class_of = np.r_[known[: v.unit_words], np.arange(k)]
    unit_n = np.r_[v.known_n[: v.unit_words], rare_tokens]
    prior = (both.sum(0) + 1) / (both.sum() + k)
    transition = (both + k * prior[None, :]) / (both.sum(1, keepdims=True) + k)
    emission = (unit_n + 1) / (np.bincount(class_of, unit_n, k) + np.bincount(class_of, minlength=k))[class_of]
    model = Model(replace(v, rare_tokens=rare_tokens, rare_types=rare_types), known, suffix, class_of, np.log10(transition), np.log10(emission), np.log10(rare_tokens + rare_types + 1))
    return model, classes, found


def fit(docs: DataFrame, counts: DataFrame) -> Model:
    """Cluster all words by the bigrams of all rows; counts are the word_counts of the same rows."""
    counts = storage.materialize(counts, "brown-counts")
    v = vocabulary(counts)
    blocks = storage.materialize(coded(docs.withColumn("held_out", F.lit(False)), v), "brown-coded")
    return learn(blocks, v, counts)[0]


_SCORED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def _scorer(sent) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = sent.value
        v = m.vocabulary
        whole = np.log10(v.tokens + v.types + 1.0)
        for batch in batches:
            for i, b in _blocks(batch):
                c = b.classes(m.known_class, m.suffix_class)
                n = np.r_[v.known_n, b.found_n]
                log_n = np.log10(n + 1.0)
                unit = np.r_[np.arange(v.unit_words), v.unit_words + c[v.unit_words :]]
                inner = m.emission[unit] + np.where(np.arange(len(c)) < v.unit_words, 0.0, log_n - m.rare[c])
                many = np.diff(b.rows)
                doc = np.repeat(np.arange(len(many)), many)
                now = c[b.codes]
                step = m.transition[np.r_[c[v.end], now[:-1]], now] + inner[b.codes]
                sums = lambda x: np.bincount(doc, x, len(many))  # noqa: E731, B023
                yield pa.record_batch({
                    "doc_id": batch.column("doc_id")[i].values, "held_out": batch.column("held_out")[i].values, "n_tokens": many.astype(np.int64),
                    "n_known": sums(n[b.codes] > 0).astype(np.int64), "base_score": sums(log_n[b.codes]) - many * whole, "score": sums(step),
                })

    return run


def brown_scores(documents: DataFrame, held_out: Column) -> DataFrame:
    """Score every document by the class model and by add-one unigrams, learning from rows where held_out is false.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of the text's probability).
    Counts and classes of words below KNOWN_SHARE come from a join on the word; no table of all words goes to one task.
    """
    storage.small_batches(documents.sparkSession)
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), held_out.alias("held_out"))
    counts = storage.materialize(word_counts(docs.where(~F.col("held_out"))), "brown-counts")
    v = vocabulary(counts)
    blocks = storage.materialize(coded(docs, v), "brown-coded")
    model, _, found = learn(blocks, v, counts)
    scored = found.mapInArrow(_scorer(docs.sparkSession.sparkContext.broadcast(model)), _SCORED)
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(v.tokens).cast("bigint").alias("train_tokens"), "base_score", "score",
        F.lit(v.types).cast("bigint").alias("train_types"), F.pow(10.0, -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )
