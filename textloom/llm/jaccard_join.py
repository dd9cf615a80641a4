"""Near duplicates by the Jaccard similarity of word shingles, with adaptive multi-match prefixes.

A document is the set of its distinct shingles of five words. Equal sets are one class. All sets are put in one order:
rare shingles first, by levels of an estimate of how many documents hold them, then by hash. Two sets of similarity t share
at least l shingles within their prefixes of |x| - ceil(t * |x|) + l shingles; each document takes the l whose estimated
cost, postings read plus candidates verified, is least, and a pair must share as many as the smaller l of the two. It must
also share as many as its sizes ask for if all that stands behind the shorter prefix is shared. What passes is verified
exactly, on whole texts.

A shingle that several documents hold in their prefixes does not give all pairs. Round one verifies, for each document,
the one partner that it meets most often: in short lists, or the first of long ones. Long lists whose documents of like
size are then in different components are compared in blocks, where the shared prefix shingles of a pair are counted in
place, so a pair comes out only if it passes, and of the first shingle alone: in round two the best few of each document
in a block, and in round three, after the components of round two, all that are left between different components. So
copies cost in proportion to their number, and no link between components is lost.

Null and empty texts have no shingles and are linked with nothing. A text of fewer than five words is one shingle.
Repeated rows fall in one class. A null doc_id takes part; a component of null ids alone has a null id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import storage
from .components import connected
from .text import chunks, column_bytes, distinct, mix, shingles, words

SIZE = 5
PERCENT = 80
#: Every task knows, for each of so many slots of shingle hashes, the level (bits of the count) of its most frequent one.
SLOT_BITS = 24
LOCAL_LEAST = 2  # a task reports shingles that so many of its documents hold
FREQUENT_LEAST = 4  # of all reports of a shingle, to have a level
RUN = 1 << 22  # shingles that a task counts at a time
VERIFY_COST = 4.0  # of a candidate, in postings
FEW = 3  # sets of a prefix shingle that are compared pair by pair at once
SALT_LEVEL = 14  # lists of shingles of a higher level are dealt to several tasks
BLOCK = 256
BEST = 2  # partners of each set in a block that round two verifies
COLUMNS = 4096  # shingles of a block that are counted at a time
SEEN = 1 << 16  # sets that a task remembers, to leave out copies
_POSTING = "shingle bigint, salt bigint, node bigint, n int, l int"
_PAIR = "x bigint, y bigint, matches int, kind int, n int, l int"


def least_shared(n: int | np.ndarray, percent: int = PERCENT):
    """ceil(percent / 100 * n)."""
    return (percent * n + 99) // 100


def must_share(n_a: np.ndarray, n_b: np.ndarray, l_a: np.ndarray, l_b: np.ndarray, percent: int) -> np.ndarray:
    """How many shingles two similar sets share in their prefixes at least, from their sizes and matches.

    Of two prefixes one ends first in the common order. All that is shared up to its end stands in both prefixes, and of
    what stands behind it no more than that set's rest can be shared.
    """
    n_a, n_b = n_a.astype(np.int64), n_b.astype(np.int64)
    both = -(-percent * (n_a + n_b) // (100 + percent))
    rest = [n - np.minimum(n, n - least_shared(n, percent) + l) for n, l in ((n_a, l_a), (n_b, l_b))]
    return np.maximum(np.minimum(l_a, l_b), both - np.maximum(*rest)).astype(np.int32)


def _sets(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row of the column, its distinct shingle hashes in order)."""
    data, offsets = column_bytes(column)
    for first, last, part, at in chunks(data, offsets):
        word, rows, _, _ = words(part, at)
        h, row, _ = shingles(word, rows, size)
        cut = np.searchsorted(row, np.arange(last - first + 1))
        for i in range(last - first):
            yield first + i, np.unique(h[cut[i] : cut[i + 1]])


def node_of(own: np.ndarray) -> np.uint64:
    """A hash of a set: the node that stands for all texts with that set."""
    sums = own.sum(keepdims=True), mix(own + np.uint64(1)).sum(keepdims=True)
    return mix(sums[0] + np.array([len(own)], np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ mix(sums[1]))[0]


def _signatures(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, node = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.uint64)
            for i, own in _sets(batch.column("text"), size):
                n[i], node[i] = len(own), node_of(own)
            yield pa.record_batch({"key": batch.column("key"), "doc_id": batch.column("doc_id"), "n": n, "node": pa.array(node.view(np.int64), mask=n == 0)})

    return run


def _local_frequent(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, waiting = [], 0

        def report():
            k, c = distinct(np.concatenate(keys))
            keep = c >= LOCAL_LEAST
            return pa.record_batch({"shingle": k[keep].view(np.int64), "docs": c[keep].astype(np.int64)})

        for batch in batches:
            for _, own in _sets(batch.column("text"), size):
                waiting += len(own)
                keys.append(own)
                if waiting > RUN:
                    yield report()
                    keys, waiting = [], 0
        if keys:
            yield report()

    return run


def shingle_levels(docs: DataFrame, size: int = SIZE) -> np.ndarray:
    """For each slot of shingle hashes the bits of the count of the most frequent shingle in it, 0 for rare ones.

    A run of RUN shingles in a task leaves out those that fewer than LOCAL_LEAST of its documents hold. The order of
    shingles, which all tasks take from here, decides the cost of the join and not its result. 2 ** SLOT_BITS bytes.
    """
    each = docs.mapInArrow(_local_frequent(size), "shingle bigint, docs bigint")
    sums = each.groupBy("shingle").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= FREQUENT_LEAST)
    slot = F.pmod(F.col("shingle"), F.lit(1 << SLOT_BITS))
    level = sums.groupBy(slot.alias("slot")).agg((F.floor(F.log2(F.max("docs"))) + 1).cast("bigint").alias("level"))
    bits = F.call_function("shiftleft", F.col("level"), (F.col("slot") % 8 * 8).cast("int"))
    found = level.select(F.floor(F.col("slot") / 8).cast("int").alias("word"), bits.alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << SLOT_BITS - 3, "<i8")
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return out.view(np.uint8)


def matches_of(cost: np.ndarray, base: int, most: int) -> int:
    """The number of matches l in 1..most with the least cost; cost: of each shingle's other postings, in order."""
    sums = np.cumsum(cost[: base + most - 1])
    at = sums[base - 1 :]
    return int(np.argmin(at + VERIFY_COST * at / np.arange(1, len(at) + 1))) + 1


def _prefixes(sent, size: int, percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = sent.value
        seen: set[int] = set()  # copies of one set give no postings of their own, or few
        for batch in batches:
            prefix, salt, node, n, l = [], [], [], [], []
            for _, own in _sets(batch.column("text"), size):
                if not len(own) or (name := int(node_of(own).view(np.int64))) in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(name)
                level = levels[(own & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)]
                least = least_shared(len(own), percent)
                base, matches, often = len(own) - least + 1, 1, level > 0
                usual = own[~often]
                if len(usual) >= base:  # nothing in the prefix is frequent: one match is the cheapest
                    prefix.append(usual[:base])
                    salt.append(np.zeros(base, np.int64))
                else:
                    order = np.argsort(level, kind="stable")
                    ordered, high = own[order], level[order].astype(np.int64)
                    matches = matches_of(np.where(high > 0, 2.0**high, 0.0), base, least)
                    end = base + matches - 1
                    prefix.append(ordered[:end])
                    split = np.minimum(np.maximum(high[:end] - SALT_LEVEL, 0), 30)
                    salt.append(np.where(split > 0, (name & ((1 << split) - 1)) + 1, 0).astype(np.int64))
                node.append(name)
                n.append(len(own))
                l.append(matches)
            if prefix:
                many = np.array([len(p) for p in prefix])
                each = lambda x, t: np.repeat(np.array(x, t), many)
                yield pa.record_batch({"shingle": np.concatenate(prefix).view(np.int64), "salt": np.concatenate(salt), "node": each(node, np.int64), "n": each(n, np.int32), "l": each(l, np.int32)})

    return run


def _batch(x, y, matches, kind: int, n=None, l=None) -> pa.RecordBatch:
    zero = np.zeros(len(x), np.int32)
    return pa.record_batch({"x": x, "y": y, "matches": zero + np.int32(matches) if np.isscalar(matches) else matches.astype(np.int32), "kind": zero + np.int32(kind), "n": zero if n is None else n, "l": zero if l is None else l})


def _first_pairs(percent: int, few: int) -> Callable:
    """Of the postings of a partition, sorted by shingle, salt and node: pairs (kind 0: of few, kind 1: with the first of
    many), and the postings of shingles that several hold (kind 2; x: shingle, y: node, matches: 0 of few, 1 of many).
    Of a long list no more than its first is kept from batch to batch."""

    def pairs(a, b, node, n, l, kind):
        keep = (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])) & (node[a] != node[b])
        a, b = a[keep], b[keep]
        return _batch(np.minimum(node[a], node[b]), np.maximum(node[a], node[b]), must_share(n[a], n[b], l[a], l[b], percent), kind)

    def lists(rows, few):
        """Whole lists, or the last of them so far if it is long: rows of kind 0, 1 and 2."""
        shingle, salt, node, n, l = rows
        first = np.flatnonzero(np.r_[True, (shingle[1:] != shingle[:-1]) | (salt[1:] != salt[:-1])])
        many = np.diff(np.r_[first, len(shingle)])
        size, head = np.repeat(many, many), np.repeat(first, many)
        place = np.arange(len(shingle)) - head
        short = np.flatnonzero((size <= few) & (size > 1))
        long = np.flatnonzero(size > few)
        for d in range(1, few):
            a = short[place[short] + d < size[short]]
            yield pairs(a, a + d, node, n, l, 0)
        b = long[place[long] > 0]
        yield pairs(head[b], b, node, n, l, 1)
        yield _batch(shingle[short], node[short], 0, 2, n[short], l[short])
        yield _batch(shingle[long], node[long], 1, 2, n[long], l[long])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("shingle", "salt", "node", "n", "l")
        left = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)]
        head = None  # the first posting of a long list that goes on, and its last node

        def cut_lists(rows, last):
            nonlocal left, head
            shingle, salt, node = rows[:3]
            once = np.r_[True, (shingle[1:] != shingle[:-1]) | (salt[1:] != salt[:-1]) | (node[1:] != node[:-1])]
            rows = [c[once] for c in rows]
            shingle, salt, node = rows[:3]
            if head is not None:
                goes_on = int(np.argmin(np.r_[(shingle == head[0][0][0]) & (salt == head[0][1][0]), False]))
                more = [c[:goes_on] for c in rows]
                if goes_on and more[2][0] == head[1]:
                    more = [c[1:] for c in more]
                if len(more[0]):
                    node, n, l = (np.r_[h, c] for h, c in zip(head[0][2:], more[2:], strict=True))
                    at = np.arange(1, len(node))
                    yield pairs(0 * at, at, node, n, l, 1)
                    yield _batch(more[0], more[2], 1, 2, more[3], more[4])
                    head = head[0], int(more[2][-1])
                if goes_on == len(shingle) and not last:
                    left = [c[:0] for c in rows]
                    return
                rows, head = [c[goes_on:] for c in rows], None
                shingle, salt, node = rows[:3]
            if not len(shingle):
                left = rows
                return
            cut = len(shingle)
            if not last:
                cut = int(np.flatnonzero(np.r_[True, (shingle[1:] != shingle[:-1]) | (salt[1:] != salt[:-1])])[-1])
                if len(shingle) - cut > few:  # it is long, and what comes of it is compared with its first
                    head = [c[cut : cut + 1] for c in rows], int(node[-1])
                    cut = len(shingle)
            left = [c[cut:] for c in rows]
            if cut:
                rows = [c[:cut] for c in rows]
                dealt = rows[1] > 0  # parts of lists: long ones, however many are in the part
                for part, least in ((~dealt, few), (dealt, 0)):
                    if part.any():
                        yield from lists([c[part] for c in rows], least)

        for batch in batches:
            if batch.num_rows:
                yield from cut_lists([np.r_[a, batch.column(c).to_numpy()] for a, c in zip(left, names, strict=True)], False)
        if len(left[0]):
            yield from cut_lists(left, True)

    return run


def _groups(each: Callable) -> Callable:
    """What `each` makes of the rows of one shingle, sizes, i and j, of batches that are sorted by them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if left is not None:
                rows = pa.concat_tables([left, rows])
            keys = [rows.column(c).to_numpy() for c in ("shingle", "sizes", "i", "j")]
            ends = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], 0)) + 1
            for first, end in zip(np.r_[0, ends[:-1]].tolist() if len(ends) else [], ends.tolist(), strict=False):
                yield from each(rows.slice(first, end - first))
            left = rows.slice(int(ends[-1])) if len(ends) else rows
        if left is not None and left.num_rows:
            yield from each(left)

    return run


def _two_blocks(rows: pa.Table, percent: int):
    """The places of either block's rows, what a pair of them must share, and whether it may be similar by labels and sizes."""
    n, l, label, block = (rows.column(c).to_numpy() for c in ("n", "l", "label", "block"))
    a, b = (np.flatnonzero(block == int(rows.column(c)[0].as_py())) for c in ("i", "j"))
    na, nb, la, lb = n[a][:, None], n[b][None, :], l[a][:, None], l[b][None, :]
    keep = (label[a][:, None] != label[b][None, :]) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))
    return a, b, must_share(na, nb, la, lb, percent), keep


def _possible(percent: int) -> Callable:
    """The rows that have a partner in the other block with which they may share as many prefix shingles as they must,
    if this shingle is the first that the two share in long lists (later: how many a set has from here on)."""

    def each(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        a, b, least, keep = _two_blocks(rows, percent)
        later, few = rows.column("later").to_numpy(), rows.column("few").to_numpy()
        keep &= np.minimum(later[a][:, None], later[b][None, :]) + np.minimum(few[a][:, None], few[b][None, :]) >= least
        if keep.any():
            stay = np.union1d(a[keep.any(1)], b[keep.any(0)])
            yield from rows.take(pa.array(stay)).combine_chunks().to_batches()

    return _groups(each)


def _block_pairs(percent: int, best: int) -> Callable:
    """Of rows sorted by shingle, sizes, i and j: the pairs of different labels, one of either block, that share as many
    prefix shingles as they must, this one first. best: only so many for each set; 0: all."""

    def columns_of(rows: pa.Table, name: str, a: np.ndarray, b: np.ndarray):
        """Parts of 0-1 matrices of either block's rows, a column for each shingle of the list column that rows share."""
        lists = rows.column(name).combine_chunks()
        size = np.diff(lists.offsets.to_numpy())
        token, place, times = np.unique(lists.values.to_numpy(zero_copy_only=False), return_inverse=True, return_counts=True)
        shared = times > 1
        hit = shared[place]
        row, place = np.repeat(np.arange(rows.num_rows), size)[hit], (np.cumsum(shared) - 1)[place[hit]]
        order = np.argsort(place, kind="stable")
        row, place, token = row[order], place[order], token[shared]
        spots = []
        for block in (a, b):
            spot = np.full(rows.num_rows, -1)
            spot[block] = np.arange(len(block))
            spots.append(spot)
        for first in range(0, len(token), COLUMNS):
            x, y = np.searchsorted(place, (first, first + COLUMNS))
            own = token[first : first + COLUMNS]
            out = []
            for block, spot in zip((a, b), spots, strict=True):
                matrix = np.zeros((len(block), len(own)), np.float32)
                r = spot[row[x:y]]
                matrix[r[r >= 0], place[x:y][r >= 0] - first] = 1
                out.append(matrix)
            yield own, *out

    def pairs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        node, shingle = rows.column("node").to_numpy(), int(rows.column("shingle")[0].as_py())
        a, b, least, keep = _two_blocks(rows, percent)
        if not keep.any():
            return
        both, before = np.zeros((2, len(a), len(b)), np.float32)
        for token, left, right in columns_of(rows, "many", a, b):
            both += left @ right.T
            earlier = token < shingle
            if earlier.any():
                before += left[:, earlier] @ right[:, earlier].T
        for _, left, right in columns_of(rows, "few", a, b):
            both += left @ right.T
        over = both - least
        keep &= (over >= 0) & (before == 0)
        if best:
            ranked = np.where(keep, over, -1.0)
            chosen = np.zeros_like(keep)
            for axis in (0, 1):
                k = min(best, ranked.shape[axis])
                top = np.argpartition(-ranked, k - 1, axis)
                np.put_along_axis(chosen, top[:k] if axis == 0 else top[:, :k], True, axis)
            keep &= chosen
        p, q = np.nonzero(keep)
        p, q = node[a[p]], node[b[q]]
        if len(p):
            yield pa.record_batch({"x": np.minimum(p, q), "y": np.maximum(p, q)})

    return _groups(pairs)


def _verify(size: int, percent: int) -> Callable:
    """Of pairs with both texts, those that are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                x = batch.column("x").to_numpy()
                first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
                of = np.cumsum(np.r_[True, x[1:] != x[:-1]]) - 1
                xs = [own for _, own in _sets(batch.column("x_text").take(pa.array(first)), size)]
                good = np.zeros(batch.num_rows, bool)
                for i, q in _sets(batch.column("y_text"), size):
                    p = xs[of[i]]
                    both = np.concatenate([p, q])
                    both.sort(kind="stable")
                    shared = int((both[1:] == both[:-1]).sum())
                    good[i] = 100 * shared >= percent * (len(p) + len(q) - shared)
                good = pa.array(good)
                yield pa.record_batch({"a": batch.column("x").filter(good), "b": batch.column("y").filter(good)})

    return run


_MEMBER = "shingle bigint, sizes int, i int, j int, node bigint, n int, l int, later int, few int, label bigint, block int"


def _dealt(rows: DataFrame) -> DataFrame:
    keys = ("shingle", "sizes", "i", "j")
    return rows.repartition(*keys).sortWithinPartitions(*keys)


def _blocks_between_labels(info: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Of long lists that hold several labels, the rows of each two blocks to compare: those of one shingle, sizes, i, j.

    A list is cut by sizes: sets of similar size are in one class of sizes or in neighbouring ones, so each class forms a
    list with the one below it. Lists of the same sets are compared once. Sets of the label that most of a list have are
    compared with the others alone, not with each other.
    """
    many = info.select("node", "n", "l", F.size("few").alias("few"), F.size("many").alias("size"), F.posexplode("many").alias("at", "shingle"))
    labelled = many.join(labels, "node").withColumn("later", F.col("size") - F.col("at")).withColumn("class", F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent)) + 1e-9).cast("int") if percent < 100 else F.col("n"))
    labelled = labelled.withColumn("sizes", F.explode(F.array("class", F.col("class") + 1)))
    key = ["shingle", "sizes"]
    by_label = labelled.groupBy(*key, "label").agg(F.count("*").alias("sets"), F.max("class").alias("class"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("h1"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("h2"))
    lists = by_label.groupBy(*key).agg(F.sum("sets").alias("sets"), F.max("class").alias("class"), F.max("sets").alias("most"), F.max_by("label", F.struct("sets", "label")).alias("main"), F.count("*").alias("labels"), F.sum("h1").alias("h1"), F.bit_xor("h2").alias("h2"))
    lists = lists.where((F.col("labels") > 1) & (F.col("class") == F.col("sizes"))).groupBy("sizes", "sets", "most", "main", "h1", "h2").agg(F.min("shingle").alias("shingle"))
    lists = lists.select(*key, "main", F.ceil((F.col("sets") - F.col("most")) / BLOCK).cast("int").alias("others"), F.ceil(F.col("most") / BLOCK).cast("int").alias("mains"))
    h = F.xxhash64("node")
    block = F.when(F.col("label") == F.col("main"), F.col("others") + F.pmod(h, F.col("mains"))).otherwise(F.pmod(h, F.col("others"))).cast("int")
    rows = labelled.join(lists, key).withColumn("block", block)
    last = F.when(F.col("block") < F.col("others"), F.col("others") + F.col("mains")).otherwise(F.col("others")) - 1
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), last)))
    rows = rows.select(*key, F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "node", "n", "l", "later", "few", "label", "block")
    rows = storage.materialize(_dealt(rows).mapInArrow(_possible(percent), _MEMBER), "members")
    return _dealt(rows.drop("few", "later").join(info.select("node", "many", "few"), "node"))


def near_duplicate_components(documents: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """key, doc_id, n_shingles, node and component (hashes; null without shingles) of every row. key: the hash of doc_id
    and text; node: that of the set, component: the least node of those that links join."""
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    spark = docs.sparkSession
    storage.small_batches(spark)
    signed = storage.materialize(docs.mapInArrow(_signatures(size), "key bigint, doc_id bigint, n bigint, node bigint"), "signatures")
    sent = spark.sparkContext.broadcast(shingle_levels(docs.select("text"), size))
    dealt = docs.select("text").mapInArrow(_prefixes(sent, size, percent), _POSTING).repartition("shingle", "salt").sortWithinPartitions("shingle", "salt", "node")
    first = storage.materialize(dealt.mapInArrow(_first_pairs(percent, FEW), _PAIR), "pairs")

    def similar(pairs: DataFrame, name: str) -> DataFrame:
        """The pairs x, y whose sets are similar, as a, b."""
        wanted = pairs.select(F.col("x").alias("node")).distinct().union(pairs.select(F.col("y").alias("node")).distinct()).distinct()
        one = storage.materialize(signed.groupBy("node").agg(F.min("key").alias("key")).join(wanted, "node", "left_semi"), f"{name}-wanted")
        texts = storage.maybe_among(docs.select("key", "text"), storage.key_bits(one, "key"), "key").join(one, "key").dropDuplicates(["node"]).select("node", "text")
        texts = storage.materialize(texts, f"{name}-texts")
        both = pairs.join(texts.select(F.col("node").alias("y"), F.col("text").alias("y_text")), "y").join(texts.select(F.col("node").alias("x"), F.col("text").alias("x_text")), "x")
        links = storage.materialize(both.select("x", "y", "x_text", "y_text").mapInArrow(_verify(size, percent), "a bigint, b bigint"), f"{name}-links")
        storage.discard(texts)
        return links

    def apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
        of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label"))
        return pairs.join(of("x"), "x").join(of("y"), "y").where("x_label <> y_label").select("x", "y")

    def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
        """The labels after more links between nodes."""
        ends = links.join(labels.select(F.col("node").alias("a"), F.col("label").alias("p")), "a").join(labels.select(F.col("node").alias("b"), F.col("label").alias("q")), "b")
        to = connected(ends.select(F.col("p").alias("a"), F.col("q").alias("b")))
        out = labels.join(to.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left")
        return storage.materialize(out.select("node", F.coalesce("to", "label").alias("label")), "labels")

    # a prefix shingle gives a pair once; of a long list only pairs with its first are met
    sums = first.where("kind < 2").groupBy("x", "y").agg(F.sum(1 - F.col("kind")).alias("few"), F.count("*").alias("shared"), F.max("matches").alias("matches"))
    met = storage.materialize(sums.where(F.col("shared") >= F.col("matches")), "met")
    often = Window.partitionBy("y").orderBy(F.desc("shared"), "x")
    candidates = storage.materialize(met.withColumn("nth", F.row_number().over(often)).where("nth = 1").select("x", "y"), "candidates")
    of = lambda is_many: F.collect_list(F.when(F.col("matches") == is_many, F.col("x")))
    info = first.where("kind = 2").groupBy(F.col("y").alias("node")).agg(F.max("n").alias("n"), F.max("l").alias("l"), F.array_sort(of(1)).alias("many"), of(0).alias("few"))
    info = storage.materialize(info, "info")  # of a set the shingles of its prefix that other prefixes hold
    labels = joined(info.select("node", F.col("node").alias("label")), similar(candidates, "first"))

    # a similar pair that no long list holds has met often enough in short ones; others come out of blocks
    enough = apart(met.where("few >= matches").select("x", "y"), labels)
    for name, best in (("second", BEST), ("third", 0)):
        more = _blocks_between_labels(info, labels, percent).mapInArrow(_block_pairs(percent, best), "x bigint, y bigint")
        more = storage.materialize((more.unionByName(enough) if best else more).distinct().join(candidates, ["x", "y"], "left_anti"), f"{name}-candidates")
        if not more.isEmpty():
            labels = joined(labels, similar(more, name))
        candidates = candidates.unionByName(more)
    named = labels.select("node", F.col("label").alias("component"))
    return signed.join(named, "node", "left").select("key", "doc_id", F.col("n").alias("n_shingles"), "node", F.coalesce("component", "node").alias("component"))


def with_component_ids(components: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id, the least doc_id of the component; a row without shingles is alone."""
    components = storage.materialize(components, "components")
    least = components.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("least"))
    return components.join(least, "component", "left").select("doc_id", "n_shingles", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def one_of_each(documents: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """The documents without near duplicates: of each component the row of the least doc_id stays (the least hash of the
    text among equals); rows without shingles all stay."""
    components = storage.materialize(near_duplicate_components(documents, size, percent), "components")
    best = components.where("component is not null").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("key"))).alias("best"))
    key, empty = storage.free_name(documents, "_key"), F.coalesce("text", F.lit(""))
    keep = best.select(F.col("best.key").alias(key))
    keyed = documents.withColumn(key, F.xxhash64("doc_id", empty))
    blank = F.trim(F.translate(empty, "\t\n\x0b\x0c\r", "     ")) == ""
    once = keyed.where(~blank).join(keep, key, "left_semi").dropDuplicates([key])
    return once.unionByName(keyed.where(blank)).drop(key)
