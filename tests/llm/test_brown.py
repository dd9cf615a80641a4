import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.llm import brown, text
from textloom.llm.queries import remainder

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def tokens(t):
    return WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))


def test_words_are_those_of_the_pattern(rows):
    for r in rows:
        data = np.frombuffer((r[1] or "").encode(), np.uint8)
        h, at, start, end = text.words(data, np.array([0, len(data)]))
        own = tokens(r[1])
        assert [bytes(data[a:b]).lower() for a, b in zip(start, end)] == [w.lower() for w in own]
        assert len(set(h.tolist())) == len(set(own))


def test_base_is_that_of_counted_unigrams(documents, rows):
    out = brown.brown_scores(documents, remainder("doc_id", 7) == 2).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    counts = Counter(w for r in rows if not held(r[0]) for w in [*tokens(r[1]), None])
    n, v = sum(counts.values()), len(counts)
    texts = {r[0]: r[1] for r in rows}
    assert len(out) == len(rows)
    for r in out:
        own = [*tokens(texts[r.doc_id]), None]
        assert r.held_out == held(r.doc_id) and r.n_tokens == len(own) and r.train_tokens == n
        assert r.n_known == sum(counts[w] > 0 for w in own)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own), abs=1e-6)
        assert r.score < 0


def test_probabilities_sum_to_one(documents):
    train = documents.withColumn("text", F.coalesce("text", F.lit("")))
    counts = brown.word_counts(train)
    m = brown.fit(train, counts)
    v = m.vocabulary
    assert np.allclose((10**m.transition).sum(1), 1)
    for c in range(int(m.class_of.max()) + 1):
        assert (10 ** m.emission[m.class_of == c]).sum() == pytest.approx(1)
    total = counts.agg(F.sum("n")).first()[0]
    assert v.tokens == total
    # in a suffix unit: the words seen and one unseen
    assert np.allclose((v.rare_tokens + v.rare_types + 1) / 10**m.rare, 1)


def test_joined_words_score_as_known_ones(documents, monkeypatch):
    learn = remainder("doc_id", 7) == 2
    want = {(r.doc_id, round(r.score, 6), r.n_known) for r in brown.brown_scores(documents, learn).collect()}
    monkeypatch.setattr(brown, "KNOWN_SHARE", 0.5)
    monkeypatch.setattr(brown, "UNIT_SHARE", 0.5)
    few = brown.brown_scores(documents, learn).collect()
    monkeypatch.setattr(brown, "KNOWN_SHARE", 2**-18)
    many = brown.brown_scores(documents, learn).collect()
    assert {(r.doc_id, round(r.score, 6), r.n_known) for r in few} == {(r.doc_id, round(r.score, 6), r.n_known) for r in many}
    assert want


def test_exchange_finds_blocks():
    rng = np.random.default_rng(0)
    pairs = rng.integers(0, 2, (12, 12)).astype(float)
    for i in range(12):
        for j in range(12):
            if (j % 3) == (i % 3 + 1) % 3:
                pairs[i, j] += 50
    at = brown.exchange(pairs, 3)
    assert all(len({at[i] for i in range(12) if i % 3 == k}) == 1 for k in range(3)) and len(set(at)) == 3


@pytest.fixture
def two_kinds(spark):
    """Rare words that stand either between a and b, as up does, or between c and d, as vex does; all end alike."""
    rng = np.random.default_rng(1)
    texts = []
    for i in range(60):
        one, two = [f"{'u' if (i + j) % 2 else 'v'}{rng.integers(0, 40)}xx" for j in range(2)]
        texts.append(" ".join(f"a {w} b" if w[0] == "u" else f"c {w} d" for w in (one, two, "up", "vex") * 3))
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


@pytest.mark.parametrize("known", [0.02, 2**-18])
def test_rare_words_are_clustered_by_their_own_neighbours(spark, two_kinds, monkeypatch, known):
    monkeypatch.setattr(brown, "UNIT_SHARE", 0.02)
    monkeypatch.setattr(brown, "KNOWN_SHARE", known)
    counts = brown.word_counts(two_kinds)
    v = brown.vocabulary(counts)
    assert v.unit_words == 7  # a to d, up, vex and the end
    blocks = brown.coded(two_kinds.withColumn("held_out", F.lit(False)), v).cache()
    _, classes, _ = brown.learn(blocks, v, counts)
    place = {r["word"]: r["class"] for r in classes.collect()}
    hashed = lambda w: int(text.words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[0].view(np.int64)[0])
    seen = {w for r in two_kinds.collect() for w in r.text.split()}
    assert set(place) == {hashed(w) for w in seen} | {0}
    of = lambda kind: {place[hashed(w)] for w in seen if w[0] == kind}
    assert not of("u") & of("v")


def test_best_class_is_that_of_whole_likelihoods():
    """Each word is moved alone to each class, and the likelihood counted anew."""
    rng = np.random.default_rng(2)
    pairs = rng.integers(0, 4, (9, 9)) * rng.integers(0, 2, (9, 9))
    old = np.arange(9) % 3
    table = lambda c: np.array([[pairs[np.ix_(c == i, c == j)].sum() for j in range(3)] for i in range(3)], float)
    word, at, n = [], [], []
    for w in range(9):
        left, right = np.zeros(3, int), np.zeros(3, int)
        for x in set(range(9)) - {w}:
            right[old[x]] += pairs[w, x]
            left[old[x]] += pairs[x, w]
        for kind, count in [*enumerate(right), *((brown.CLASSES + c, x) for c, x in enumerate(left)), (2 * brown.CLASSES, pairs[w, w])]:
            if count:
                word.append(w), at.append(kind), n.append(count)
    got = brown.best_classes(table(old), old, np.array(word), np.array(at), np.array(n))
    for w in range(9):
        value = [brown.likelihood(table(np.where(np.arange(9) == w, c, old))) for c in range(3)]
        assert value[got[w]] == pytest.approx(max(value))


def test_empty_table(empty):
    assert brown.brown_scores(empty, F.lit(False)).count() == 0


def test_gains_of_few_and_many_neighbours_are_one_formula(monkeypatch):
    rng = np.random.default_rng(3)
    k, m = 5, 40
    old = rng.integers(0, k, m)
    both = rng.integers(5000, 9000, (k, k)).astype(float)
    word, at = (x.ravel() for x in np.meshgrid(np.arange(m), np.r_[:k, brown.CLASSES : brown.CLASSES + k, 2 * brown.CLASSES], indexing="ij"))
    n = rng.integers(1, 60, len(word))
    some = brown.best_classes(both, old, word, at, n)
    monkeypatch.setattr(brown, "TABLED", 1)
    assert (some == brown.best_classes(both, old, word, at, n)).all()
    assert (some != old).any()


def test_answers_stand_in_the_order_of_what_is_asked():
    h = np.array([3, 9, 1 << 63], np.uint64)
    asked = pa.table({"part": pa.array([0], pa.int32()), "block": pa.array([7], pa.int64()), "words": pa.array([h.tobytes()], pa.binary())})
    rows = lambda w, c, n: pa.table({"word": pa.array(np.array(w, np.uint64).view(np.int64)), "class": pa.array(c, pa.int32()), "n": pa.array(n, pa.int64())})
    got = brown._answer(asked, rows([1 << 63, 3], [2, 5], [40, 1])).to_pylist()[0]
    assert list(got["class"]) == [5, brown.NONE, 2] and np.frombuffer(got["n"], np.int64).tolist() == [1, 0, 40]
    none = brown._answer(asked, rows([], [], [])).to_pylist()[0]
    assert list(none["class"]) == [brown.NONE] * 3


def test_scores_are_those_of_a_plain_class_bigram_model(spark, two_kinds, monkeypatch):
    """The scorer's sums against dictionaries: class transitions, words of their own, and the rest of each class."""
    monkeypatch.setattr(brown, "UNIT_SHARE", 0.02)
    train = two_kinds.withColumn("held_out", F.lit(False))
    counts = brown.word_counts(two_kinds)
    v = brown.vocabulary(counts)
    model, classes, found = brown.learn(brown.coded(train, v).cache(), v, counts)
    place = {r["word"]: r["class"] for r in classes.collect()}
    hashed = lambda w: int(text.words(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[0].view(np.int64)[0]) if w else 0
    docs = {r.doc_id: [*tokens(r.text), None] for r in two_kinds.collect()}
    n = Counter(w for own in docs.values() for w in own)
    k, total = len(model.transition), sum(n.values())
    at = {w: place[hashed(w)] for w in n}
    both, after = Counter(), Counter()
    for own in docs.values():
        for a, b in zip([None, *own[:-1]], own):
            both[at[a], at[b]] += 1
            after[at[a]] += 1
    column = Counter()
    for (_, b), x in both.items():
        column[b] += x
    alone = {w for w in n if w is None or n[w] >= max(1, total * 0.02)}
    rest, types = Counter(), Counter()
    for w in set(n) - alone:
        rest[at[w]] += n[w]
        types[at[w]] += 1
    units = {c: sum(n[w] + 1 for w in alone if at[w] == c) + rest[c] + 1 for c in range(k)}

    def token(a, b):
        c, d = at[a], at[b]
        step = (both[c, d] + k * (column[d] + 1) / (total + k)) / (after[c] + k)
        inner = (n[b] + 1) / units[d] if b in alone else (rest[d] + 1) / units[d] * (n[b] + 1) / (rest[d] + types[d] + 1)
        return math.log10(step) + math.log10(inner)

    got = found.mapInArrow(brown._scorer(spark.sparkContext.broadcast(model)), brown._SCORED).collect()
    assert len(got) == len(docs)
    for r in got:
        own = docs[r.doc_id]
        assert r.score == pytest.approx(sum(token(a, b) for a, b in zip([None, *own[:-1]], own)), abs=1e-6)


def test_each_sweep_moves_its_own_part_and_raises_the_likelihood(spark, two_kinds, monkeypatch):
    monkeypatch.setattr(brown, "UNIT_SHARE", 0.02)
    seen, plain = [], brown.likelihood
    monkeypatch.setattr(brown, "likelihood", lambda both: (seen.append(plain(both)), seen[-1])[1])
    counts = brown.word_counts(two_kinds)
    v = brown.vocabulary(counts)
    brown.learn(brown.coded(two_kinds.withColumn("held_out", F.lit(False)), v).cache(), v, counts)
    pairs = list(zip(seen[::2], seen[1::2]))  # of the next classes, and of those before
    assert pairs and all(new > old for new, old in pairs[:-1]) and pairs[0][0] > pairs[0][1]
    word = np.arange(1000, dtype=np.int64)
    parts = [brown.moves_in(word, i, 2) for i in range(3)]
    assert (parts[0] ^ parts[1]).all() and (parts[0] == parts[2]).all() and 300 < parts[0].sum() < 700
