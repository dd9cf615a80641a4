import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from textloom.llm import bpe, queries
from textloom.llm.encode import tokenizer_path

PATH = tokenizer_path(bpe.TOKENIZER)
ENCODER, DECODER, WHOLE = bpe.ForcedBoundaries(PATH), bpe.Decoder(PATH), Tokenizer.from_file(PATH)
PIECES = [*"abtsx1 .,'!<|>\n\t\r\x1c\x85\xa0 é日Σİǆ̸́ﬁ😀가ᄀ", "'s", "'ll", "  ", " \n", "ing", "the", "<|endoftext|>", "<|startoftext|>", "  ", "ΑΣ"]


def plain(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids


def plain_text(ids):
    return WHOLE.decode(ids, skip_special_tokens=False)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=30).map("".join), max_size=5))
def test_ids_and_texts_are_the_library_s(texts):
    ids, sizes = ENCODER.encode(texts)
    assert len(ids) == sizes.sum()
    at = 0
    for text, n in zip(texts, sizes, strict=True):
        assert ids[at : at + n].tolist() == plain(text)
        assert DECODER.decode(ids[at : at + n]).decode() == plain_text(plain(text))
        at += n


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=80))
def test_any_characters(text):
    assert ENCODER.encode([text])[0].tolist() == plain(text)


def test_no_token_spans_a_cut():
    words = ["zqxjkv", "hello", "xXxX", "qqqqwwwwzzzz", "日本語のテキスト", "überstraßenbahn"]
    mapped = [w for text in words for w, _ in WHOLE.pre_tokenizer.pre_tokenize_str(text)]
    pieces, many = ENCODER.cut(mapped)
    assert many.sum() == len(pieces) > len(mapped)  # cuts inside words too
    assert "".join(p.removesuffix(" ") for p in pieces) == "".join(mapped)
    for token in WHOLE.get_vocab(with_added_tokens=False):
        codes = ENCODER._bytes(token.removesuffix("</w>"))
        assert ENCODER.together[codes[:-1], codes[1:]].all()


def test_windows_and_a_full_memory(monkeypatch):
    monkeypatch.setattr(bpe, "WINDOW", 50)
    monkeypatch.setattr(bpe, "KEPT_STRINGS", 4)
    rng = random.Random(1)
    encoder = bpe.ForcedBoundaries(PATH)
    for text in ["word " * 40, "w" * 400 + " \n" + "ab,c" * 60, "", " " * 120, " ".join(rng.choice(PIECES) for _ in range(300))]:
        assert encoder.encode_long(text).tolist() == plain(text)
    monkeypatch.setattr(bpe, "DECODED_IDS", 3)
    assert DECODER.decode(np.array(plain("some more words than three"), np.uint32)).decode() == plain_text(plain("some more words than three"))


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        bpe.ForcedBoundaries(tokenizer_path("byte_bpe_50k.json"))


def expected(doc_id, text):
    ids = plain(text)
    return doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(plain_text(ids).encode()).hexdigest()


def digests(df):
    from pyspark.sql import functions as F

    return sorted((tuple(r) for r in df.select("doc_id", "n_tokens", F.sha2("ids", 256), F.sha2("decoded", 256)).collect()), key=repr)


def test_tables(spark, documents, rows, empty):
    docs = documents.withColumnRenamed("key", "ids").withColumnRenamed("lang", "decoded")
    out = bpe.decode(bpe.encode(docs))
    assert digests(out) == sorted((expected(r[0], r[1]) for r in rows), key=repr)
    assert set(out.columns) == {"doc_id", "source", "n_chars", "n_tokens", "ids", "decoded"}
    both = bpe.encode(docs, back=True)
    assert digests(both) == digests(out) and set(both.columns) == set(out.columns)
    assert bpe.decode(bpe.encode(empty)).count() == 0
    blank = spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")
    assert digests(bpe.decode(bpe.encode(blank))) == [expected(1, None), expected(2, "")]


def test_query_on_the_table(spark):
    sf = "/root/testdata/sf0.001"
    texts = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(map(tuple, queries.op12_forced_boundary_bpe(spark, sf).collect()))
    assert got == sorted(expected(*r) for r in texts)
