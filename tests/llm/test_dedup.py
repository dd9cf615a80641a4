import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from textloom.llm import components, decontaminate, jaccard_join, line_spread, repeats, storage, text

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingle_set(text):
    w = WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows, percent=80):
    sets = [shingle_set(r[1]) for r in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    out = []
    for i, r in enumerate(rows):
        ids = [q[0] for k, q in enumerate(rows) if find(k) == find(i) and q[0] is not None]
        out.append((r[0], len(sets[i]), min(ids) if ids else None))
    return Counter(out)


def test_components_are_those_of_all_pairs(documents, rows):
    got = jaccard_join.with_component_ids(jaccard_join.near_duplicate_components(documents)).collect()
    assert Counter(map(tuple, got)) == brute_components(rows)


@pytest.mark.parametrize("frequent, few, salt, batch, best", [(2, 3, 14, 1 << 20, 2), (1000, 3, 14, 2000, 2), (2, 8, 14, 1 << 20, 1), (2, 2, 1, 2000, 1), (2, 1, 3, 500, 1)])
def test_hot_groups_lose_no_link(spark, monkeypatch, frequent, few, salt, batch, best):
    """Chains of near copies around one text, and texts that share a passage but nothing else, with and without counts,
    with dealt lists, and with batches shorter than a list."""
    for name, value in (("FREQUENT_LEAST", frequent), ("LOCAL_LEAST", 1), ("BLOCK", 7), ("FEW", few), ("SALT_LEVEL", salt), ("BEST", best), ("SEEN", 9)):
        monkeypatch.setattr(jaccard_join, name, value)
    monkeypatch.setattr(text, "CHUNK_BYTES", 1000)
    monkeypatch.setattr(storage, "BATCH_BYTES", batch)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(60):
        own = list(base)
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(80)] = f"x{rng.randrange(10_000)}"
        rows.append((i, " ".join(own)))
    rows += [(100 + i, " ".join(base[:40]) + " " + " ".join(f"y{i}_{j}" for j in range(40))) for i in range(25)]
    rows += [(200 + i, " ".join(base[40:]) + f" z{i % 9} z{i % 7} z{i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = jaccard_join.with_component_ids(jaccard_join.near_duplicate_components(docs)).collect()
    assert Counter(map(tuple, got)) == brute_components(rows)


def test_one_of_each_keeps_the_least_id(documents, rows):
    kept = jaccard_join.one_of_each(documents)
    assert kept.columns == documents.columns
    want = {c for _, n, c in brute_components(rows) if n and c is not None}
    got = [r.doc_id for r in kept.collect() if shingle_set(r.text) and r.doc_id is not None]
    assert sorted(got) == sorted(want)


def test_empty_tables(empty):
    assert jaccard_join.with_component_ids(jaccard_join.near_duplicate_components(empty)).count() == 0
    assert repeats.without_repeats(empty).count() == 0


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 103), (103, 101), (7, 7)]
    got = dict(map(tuple, components.connected(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100, 103: 100}


def brute_repeats(rows, length):
    texts = [(r[1] or "").encode() for r in rows]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for r, t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int(gone.sum() and (np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((r[0], len(t), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("length, many", [(400, 2048), (60, 2048), (60, 1)])
def test_repeats_are_those_of_all_strings(documents, rows, length, many):
    got = repeats.without_repeats(documents, length, 16 if length < 400 else 32, many).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got) == brute_repeats(rows, length)


def test_repeats_in_bytes_that_are_no_utf8(spark):
    texts = [bytes([255, 200]) + b"same text " * 9, b"other " + bytes([255]) * 3 + b"same text " * 9, bytes([254]), b"same text " * 8 + bytes([200])]
    docs = spark.createDataFrame([(i, bytearray(t)) for i, t in enumerate(texts)], "doc_id bigint, bytes binary").selectExpr("doc_id", "cast(bytes as string) as text")
    got = repeats.without_repeats(docs, 60, 16).collect()
    rows = [(i, t.decode("latin-1")) for i, t in enumerate(texts)]

    class Raw(str):
        def encode(self):
            return str.encode(self, "latin-1")

    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got) == brute_repeats([(i, Raw(t)) for i, t in rows], 60)


@pytest.mark.parametrize("length, many", [(400, 2048), (640, 1)])
def test_repeats_of_texts_with_equal_sums_of_powers(spark, length, many):
    a, b = ("".join(x[i.bit_count() % 2] for i in range(256)) for x in ("A~", "~A"))  # Thue-Morse words
    middle = "".join(random.Random(1).choices("cdefghijklmn", k=128))  # holds the trigger of all strings
    rows = [(0, a + middle + b), (1, b + middle + a)]
    for texts in (rows, [*rows, (2, "head " + rows[1][1] + " tail")]):
        got = repeats.without_repeats(spark.createDataFrame(texts, "doc_id bigint, text string"), length, 32, many).collect()
        assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got) == brute_repeats(texts, length)


def test_order_by_doubling():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 2, 600).astype(np.uint8)
    start = np.arange(600 - 20)
    seen = Counter(bytes(data[i : i + 20]) for i in start)
    assert repeats.equal_strings(data, start, 20).tolist() == [seen[bytes(data[i : i + 20])] > 1 for i in start]


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i, *row[1:]] if False else row
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_least_distance_is_that_of_all_runs():
    rng = random.Random(2)
    for _ in range(200):
        pattern = [rng.randrange(4) for _ in range(rng.randint(1, 8))]
        text = [rng.randrange(4) for _ in range(rng.randint(0, 12))]
        masks = {}
        for i, w in enumerate(pattern):
            masks[w] = masks.get(w, 0) | 1 << i
        want = min(edit_distance(pattern, text[i:j]) for i in range(len(text) + 1) for j in range(i, len(text) + 1))
        assert decontaminate.least_distance(masks, len(pattern), text)[0] == want


def test_matches_are_those_of_all_windows(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(6, 24)))) for i in range(12)] + [(50, "too short"), (51, None), (52, "")]
    docs = []
    for i in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 50))]
        own = rng.choice(items[:12])[1].split()
        for _ in range(rng.randint(0, 5)):
            at = rng.randrange(len(own))
            own[at : at + rng.randint(0, 1)] = [rng.choice(vocabulary)] * rng.randint(0, 1)
            own = own or ["w0"]
        at = rng.randint(0, len(words))
        docs.append((i, ", ".join(words[:at] + [w.upper() for w in own] + words[at:])))
    docs += [(None, items[0][1]), (90, None), (91, ""), docs[0]]
    want = Counter()
    for d, t in docs:
        w = (t or "").lower().replace(",", "").split()
        for k, item in items[:12]:
            p = item.split()
            best = min(edit_distance(p, w[a : a + n]) for a in range(len(w) + 1) for n in range(max(0, len(p) - 6), len(p) + 7))
            if best <= int(decontaminate.RATE * len(p)):
                want[d, k, best] += 1
    frames = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    for at_once in (2_000_000, 100):
        got = decontaminate.benchmark_matches(*frames, at_once=at_once).collect()
        assert Counter((r.doc_id, r.item_id, r.distance) for r in got) == want
    clean = decontaminate.without_matches(*frames, at_once=100).collect()
    assert sorted(str(r.doc_id) for r in clean) == sorted(str(d) for d, _ in docs if not any(k[0] == d for k in want))
    assert decontaminate.benchmark_matches(frames[0], frames[1].limit(0)).count() == 0


def test_where_a_match_begins_and_short_items(spark):
    items = spark.createDataFrame([(0, "a b c d e f g h i j"), (1, "short one"), (2, "word")], "item_id bigint, text string")
    docs = [(0, "x y z a b NEW c d e f g h i j k"), (1, "p a b c e f g h i j q"), (2, "q short, one r"), (3, "short x one words"), (4, "Word")]
    got = decontaminate.benchmark_matches(spark.createDataFrame(docs, "doc_id bigint, text string"), items).collect()
    assert sorted((r.doc_id, r.item_id, r.distance, r.first_word) for r in got) == [(0, 0, 1, 3), (1, 0, 1, 1), (2, 1, 0, 1), (4, 2, 0, 0)]


def test_spread_lines_are_those_of_exact_counts(spark):
    rng = random.Random(4)
    pages = []
    for i in range(150):
        lines = [f"line {rng.randrange(6)}" if rng.random() < 0.5 else f"line {i} {rng.randrange(3)}" for _ in range(6)]
        lines += [f"rare {rng.randrange(12)}"] * 2
        pages.append((i, f"http://h{rng.randrange(20)}.org/p{i}", "<p>" + "</p><p>".join(lines) + "</p>"))
    pages += [(None, None, None), (500, "no url", ""), pages[0]]
    for threshold in (3, 8, 15):
        got = line_spread.spread_lines(spark.createDataFrame(pages, "page_id bigint, url string, html string"), threshold).collect()
        sites = {}
        split = lambda h: [x for x in re.split("</?p>", h or "") if x]
        for _, u, h in pages:
            for x in split(h):
                sites.setdefault(x, set()).add(u.split("/")[2] if u and "//" in u else "")
        want = Counter()
        for p, _, h in pages:
            kept = [x for x in split(h) if len(sites[x]) < threshold]
            want[p, len(split(h)), len(split(h)) - len(kept), "\n".join(kept)] += 1
        assert Counter((r.page_id, r.n_lines, r.n_removed, r.text) for r in got) == want
    assert line_spread.spread_lines(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_scripts_without_spaces_and_five_words(spark):
    docs = [(1, "他们在北京大学学习计算机科学与技术专业。"), (2, "ก่อนนี้ภาษาไทยไม่มีเว้นวรรคเลยนะ"), (3, "x one two three four six y"), (4, "他们在上海"), (5, "a b c"), (6, "𠀀𠀁𠀂𠀃end"), (7, "日本語é文")]
    items = [(10, "北京大学学习计算机"), (11, "ภาษาไทยไม่มีเว้นวรรค"), (12, "one two three four five"), (13, "a c"), (14, "𠀁𠀂𠀃"), (15, "é")]
    got = decontaminate.benchmark_matches(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {(r.doc_id, r.item_id, r.distance) for r in got} == {(1, 10, 0), (2, 11, 0), (3, 12, 1), (6, 14, 0), (7, 15, 0)}
    assert {r.item_id: (r.n_words, r.budget) for r in got} == {10: (9, 1), 11: (20, 4), 12: (5, 1), 14: (3, 0), 15: (1, 0)}
    assert {r.doc_id: r.first_word for r in got}[1] == 3
