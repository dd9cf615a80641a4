import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.llm import encode, storage, token_counts, token_files

ENCODER = encode.Encoder(encode.tokenizer_path())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"ab1 .,'\n\t\r\x1c\xa0é日 ", "  ", " \n", "'s"]), max_size=40).map("".join), max_size=5))
def test_ids_are_those_of_whole_texts(texts):
    ids, sizes = ENCODER.encode(texts, 2)
    at = 0
    for text, n in zip(texts, sizes, strict=True):
        assert ids[at : at + n].tolist() == [*ENCODER.tokenizer.encode(text, add_special_tokens=False).ids, 2]
        at += n


def test_words_that_came_twice_stay_known(monkeypatch):
    monkeypatch.setattr(encode, "CACHE_WORDS", 20)
    mine, asked = encode.Encoder(encode.tokenizer_path()), []
    learn = mine._encode_words
    monkeypatch.setattr(mine, "_encode_words", lambda new: asked.extend(new) or learn(new))
    for i in range(30):
        text = "now and then " + " ".join(f"é{i}x{j}" for j in range(9)) + " and then\n on"
        ids, sizes = mine.encode([text, "", text + " "], 2)
        want = [[*mine.tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in (text, "", text + " ")]
        assert ids.tolist() == sum(want, []) and sizes.tolist() == list(map(len, want))
    assert asked.count("now") == asked.count(" and") == 1 and mine.count[0] < 40
    assert asked.count(" é0x3") == 1
    asked.clear()
    assert mine.encode(["o word, word! word... 7word.,. it's, <|endoftext|>. é\u0301, word"])[0].tolist() == mine.tokenizer.encode("o word, word! word... 7word.,. it's, <|endoftext|>. é\u0301, word", add_special_tokens=False).ids
    assert asked.count(" word") == 1 and not {" word,", " word!", " word..."} & set(asked)
    few = " ".join("abcdefghijklmnopqrstuvwxyz" * 2)
    for _ in range(4):
        assert mine.encode([few])[0].tolist() == mine.tokenizer.encode(few, add_special_tokens=False).ids


def expected(rows):
    return [[*ENCODER.tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2] for r in rows]


def test_files_hold_the_ids(spark, documents, rows, tmp_path):
    path = f"file://{tmp_path}/tokens"
    token_files.write_tokens(documents, path)
    want = Counter((r[0], tuple(ids)) for r, ids in zip(rows, expected(rows), strict=True))
    assert Counter((r.doc_id, tuple(r.ids)) for r in token_files.read_tokens(spark, path).collect()) == want
    out = sorted(token_files.token_digest(spark, path).collect(), key=lambda r: r.start)
    ids_of = {}
    for r, ids in zip(rows, expected(rows), strict=True):
        ids_of.setdefault(r[0], set()).add(zlib.crc32(np.array(ids, "<u4").tobytes()))
    total = 0
    for r in out:
        assert r.start == total and r.ids_crc32 in ids_of[r.doc_id]
        total += r.n_tokens
    assert [r.doc_id for r in out] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x or 0))
    one = token_files.read_tokens(spark, path).where("doc_id = 7")
    assert "EqualTo(doc_id,7)" in one._jdf.queryExecution().executedPlan().toString() and one.count() == 1


def test_empty_token_files(spark, empty, tmp_path):
    token_files.write_tokens(empty, f"file://{tmp_path}/none")
    assert token_files.read_tokens(spark, f"file://{tmp_path}/none").count() == 0


def test_histogram_and_sums(documents, rows):
    lengths = [len(x) for x in expected(rows)]
    sums = token_counts.suffix_sums(token_counts.length_histogram(documents))
    got = {r.n_tokens: r for r in sums.collect()}
    assert {k: r.docs for k, r in got.items()} == Counter(lengths)
    for n, r in got.items():
        assert r.docs_at_least == sum(x >= n for x in lengths) and r.tokens_at_least == sum(x for x in lengths if x >= n)
        assert r.tokens_if_cut == sum(min(x, n) for x in lengths)
    assert token_counts.quantile(sums, 0.5).first()[0] == sorted(lengths)[(len(lengths) + 1) // 2 - 1]
    cut = {r.max_tokens: r for r in token_counts.totals_at(sums, [1, 16, 100_000]).collect()}
    assert cut[16].tokens == sum(min(x, 16) for x in lengths) and cut[16].cut_docs == sum(x > 16 for x in lengths)


def test_empty_histogram(empty):
    assert token_counts.suffix_sums(token_counts.length_histogram(empty)).count() == 0


def test_bits_lose_no_key(spark):
    df = spark.range(2000).select(F.xxhash64("id").alias("k"))
    keys = df.where("pmod(k, 7) = 0")
    bits = storage.key_bits(keys, "k")
    among = storage.maybe_among(df, bits, "k")
    assert keys.join(among, "k", "left_anti").count() == 0
    assert among.count() + storage.maybe_among(df, bits, "k", among=False).count() == 2000
