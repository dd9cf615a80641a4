"""Encoding and decoding with a byte-pair vocabulary that drops white space and marks word ends.

Forced boundaries: two neighbouring bytes that stand together inside no token of the vocabulary belong to two tokens in
every encoding, for all that a merge makes is a token. Merges on one side of such a place never touch the other side, so
both sides may be encoded apart and their ids joined. With the bytes of white space inside no token at all, texts are
cut there first; each different stretch between them is cut further, where the library's own pre-tokenizer ends a word
and, inside words, at pairs that no token holds. Only the last fragment of a word gets the word's end. Each different
fragment goes through the merges once, and ids of stretches and texts are joined from those of fragments.

Null texts count as empty ones and give no ids; strings of special tokens in a text become their ids, as in the library.
Rows may repeat, and a column of the input may have any name; all of them stay, but one named as an added column.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage
from .encode import text_groups, tokenizer_path

TOKENIZER = "word_bpe_49k.json"
KEPT_STRINGS, KEPT_CHARS = 1_000_000, 20_000_000  # stretches and fragments that a Python worker remembers; then it starts again
WINDOW = 1 << 20  # characters of a text that are in work at a time
TOGETHER = 5000  # new stretches that the pre-tokenizer gets as one text
DECODED_IDS = 1 << 16  # ids that are in work at a time
WHITE = " \t\n\v\f\r"
_STRETCH = re.compile(r"[^\x20\x09-\x0D]+")
_WHITE = re.compile(r"[\x20\x09-\x0D]")
_ANY_WHITE = re.compile(r"\s")
_INNER = " "  # after a fragment that ends inside its word; no symbol of a byte-level vocabulary


def byte_of_symbol() -> dict[str, int]:
    """The byte-level alphabet: a printable byte is its own character, the others follow from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Store:
    """Ids of numbered strings, one after the other in one array."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.flat, self.used, self.chars = np.zeros(1 << 14, np.uint32), 0, 0
        self.start, self.length, self.count = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), 0

    def add(self, flat: np.ndarray, length: np.ndarray) -> None:
        while self.used + len(flat) > len(self.flat):
            self.flat = np.r_[self.flat, np.zeros_like(self.flat)]
        while self.count + len(length) > len(self.start):
            self.start, self.length = np.r_[self.start, np.zeros_like(self.start)], np.r_[self.length, np.zeros_like(self.length)]
        self.flat[self.used : self.used + len(flat)] = flat
        self.start[self.count : self.count + len(length)] = self.used + np.cumsum(length) - length
        self.length[self.count : self.count + len(length)] = length
        self.used, self.count = self.used + len(flat), self.count + len(length)

    def numbers(self, strings: list[str]) -> tuple[np.ndarray, list[str]]:
        """The number of each string, and the strings that are new, in the order of their numbers."""
        number, new, out = self.number, [], []
        for s in strings:
            n = number.get(s)
            if n is None:
                n = number[s] = len(number)
                new.append(s)
            out.append(n)
        self.chars += sum(map(len, new))
        return np.array(out, np.int64), new

    def joined(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        length = self.length[number]
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.start[number] - (ends - length), length) + np.arange(total)], length


def sums(values: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The sum of each run of values, runs without any included."""
    total = np.r_[0, np.cumsum(values)]
    end = np.cumsum(many)
    return total[end] - total[end - many]


class ForcedBoundaries:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            rule = json.load(file)
        model = rule["model"]
        self.words = Tokenizer.from_str(json.dumps(rule | {"truncation": None, "padding": None, "added_tokens": [], "model": model | {"vocab": {}, "merges": []}}))
        self.suffix = model.get("end_of_word_suffix") or ""
        added = rule.get("added_tokens") or []
        self.special = {t["content"]: t["id"] for t in added}
        self._checked(model, added)
        bare = {"version": rule["version"], "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "pre_tokenizer": None, "post_processor": None, "decoder": None}
        self.ending = Tokenizer.from_str(json.dumps(bare | {"model": model}))
        self.inner = Tokenizer.from_str(json.dumps(bare | {"model": model | {"end_of_word_suffix": None}}))
        self.byte = np.zeros(1 << 16, np.uint8)
        for symbol, b in byte_of_symbol().items():
            self.byte[ord(symbol)] = b
        self.together = self.pairs(model["vocab"])
        blank = np.frombuffer(WHITE.encode(), np.uint8)
        if self.together[blank].any() or self.together[:, blank].any():
            raise ValueError("tokens with white space inside: texts can't be cut there")
        self._at_special = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self._forget()

    def _checked(self, model: dict, added: list[dict]) -> None:
        odd = [t["content"] for t in added if t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] or _WHITE.search(t["content"])]
        other = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
        if model.get("type") != "BPE" or odd or other:
            raise ValueError(f"no plain byte-pair vocabulary: {[model.get('type'), *odd, *other]}")

    def pairs(self, vocab: dict[str, int]) -> np.ndarray:
        """For each pair of bytes, whether they stand together inside a token."""
        together = np.zeros((256, 256), bool)
        for token in vocab:
            codes = self._bytes(token[: len(token) - len(self.suffix)] if self.suffix and token.endswith(self.suffix) else token)
            together[codes[:-1], codes[1:]] = True
        return together

    def _bytes(self, symbols: str) -> np.ndarray:
        return self.byte[np.frombuffer(symbols.encode("utf-16-le"), np.uint16)]

    def _forget(self) -> None:
        self.stretches, self.fragments = _Store(), _Store()

    def _words(self, new: list[str]) -> tuple[list[str], np.ndarray]:
        """The words of the library's pre-tokenizer, as byte symbols, and how many each stretch has.

        Stretches without any white space are handed over together, with spaces between them, which stay where they are."""
        split = self.words.pre_tokenizer.pre_tokenize_str
        norm = self.words.normalizer.normalize_str if self.words.normalizer else str
        plain = np.fromiter((_ANY_WHITE.search(s) is None and s != "" for s in new), bool, len(new))
        found: list[list[str]] = [[]] * len(new)
        at = np.flatnonzero(plain)
        for first in range(0, len(at), TOGETHER):
            run = at[first : first + TOGETHER]
            text = norm(" ".join([new[i] for i in run]))
            ends = np.cumsum([len(s) + 1 for s in text.split(" ")])
            if len(ends) != len(run):
                plain[run] = False
                continue
            got = split(text)
            words, each = [w for w, _ in got], np.searchsorted(ends, [span[0] for _, span in got], "right")
            cuts = np.searchsorted(each, np.arange(len(run) + 1))
            for i, a, b in zip(run, cuts[:-1], cuts[1:], strict=True):
                found[i] = words[a:b]
        for i in np.flatnonzero(~plain):
            found[i] = [w for w, _ in split(norm(new[i]))] if new[i] else []
        return [w for words in found for w in words], np.fromiter(map(len, found), np.int64, len(found))

    def cut(self, words: list[str]) -> tuple[list[str], np.ndarray]:
        """The fragments of the words, with _INNER after those that end inside one, and how many each word has."""
        if not words:
            return [], np.zeros(0, np.int64)
        symbols = "".join(words)
        code = self._bytes(symbols)
        word_end = np.cumsum([len(w) for w in words])
        after = np.r_[~self.together[code[:-1], code[1:]], True]
        last = np.zeros(len(code), bool)
        last[word_end - 1] = True
        end = np.flatnonzero(after | last) + 1
        begin, inside = np.r_[0, end[:-1]].tolist(), ~last[end - 1]
        many = np.diff(np.r_[0, np.searchsorted(end, word_end, "right")])
        return [symbols[a:b] + _INNER if i else symbols[a:b] for a, b, i in zip(begin, end.tolist(), inside.tolist(), strict=True)], many

    def _merged(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new fragments: those that end a word get the word's end."""
        inner = np.fromiter((f.endswith(_INNER) for f in new), bool, len(new))
        ids: list[list[int]] = [[]] * len(new)
        for tokenizer, which in ((self.ending, ~inner), (self.inner, inner)):
            at = np.flatnonzero(which)
            for i, e in zip(at, tokenizer.encode_batch_fast([new[i].removesuffix(_INNER) for i in at], add_special_tokens=False), strict=True):
                ids[i] = e.ids
        return np.array([x for part in ids for x in part], np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))

    def _learn(self, new: list[str]) -> None:
        """Ids of new stretches, joined from those of their fragments."""
        if not new:
            return
        special = [s for s in new if s in self.special]
        words, words_of = self._words(["" if s in self.special else s for s in new] if special else new)
        pieces, pieces_of = self.cut(words)
        number, fresh = self.fragments.numbers(pieces)
        if fresh:
            self.fragments.add(*self._merged(fresh))
        flat, length = self.fragments.joined(number)
        length = sums(length, sums(pieces_of, words_of))
        for s in special:
            i = new.index(s)
            flat, length[i] = np.insert(flat, int(length[:i].sum()), np.uint32(self.special[s])), 1
        self.stretches.add(flat, length)

    def _parts(self, text: str) -> list[str]:
        if self._at_special is None or not any(s in text for s in self.special):
            return _STRETCH.findall(text)
        return [s for part in self._at_special.split(text) for s in ([part] if part in self.special else _STRETCH.findall(part))]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many each text has."""
        if len(self.stretches.number) + len(self.fragments.number) > KEPT_STRINGS or self.stretches.chars + self.fragments.chars > KEPT_CHARS:
            self._forget()
        parts = [self._parts(t) for t in texts]
        number, new = self.stretches.numbers([s for p in parts for s in p])
        self._learn(new)
        flat, length = self.stretches.joined(number)
        return flat, sums(length, np.fromiter(map(len, parts), np.int64, len(parts)))

    def encode_long(self, text: str) -> np.ndarray:
        """The ids of one text, of which about WINDOW characters, up to a white space, are in work at a time."""
        found, at = [], 0
        while at < len(text):
            end = _WHITE.search(text, at + WINDOW)
            end = end.start() if end else len(text)
            found.append(self.encode([text[at:end]])[0])
            at = end
        return np.concatenate(found) if found else np.zeros(0, np.uint32)


class Decoder:
    """Texts of ids as the library's decode gives them, with the strings of special tokens in their places."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        token = [b""] * (max(vocab.values()) + 1)
        for text, i in vocab.items():
            token[i] = text.encode() + b" "
        self.length = np.fromiter(map(len, token), np.int64, len(token))
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(token), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the text. Without a decoder of its own a vocabulary's tokens stand with spaces between them."""
        if self.tokenizer.decoder is not None:
            return self.tokenizer.decode(ids.tolist(), skip_special_tokens=False).encode()
        out = bytearray()
        for first in range(0, len(ids), DECODED_IDS):
            some = ids[first : first + DECODED_IDS].astype(np.int64)
            length = self.length[some]
            ends = np.cumsum(length)
            out += self.flat[np.repeat(self.start[some] - (ends - length), length) + np.arange(int(ends[-1]))].tobytes()
        return bytes(out[:-1])


_KEPT: dict[tuple[type, str], object] = {}


def kept(kind: type, path: str):
    """One encoder or decoder for each tokenizer in a Python worker, kept from task to task."""
    if (kind, path) not in _KEPT:
        _KEPT[kind, path] = kind(path)
    return _KEPT[kind, path]


def _with(batch: pa.RecordBatch, first: int, last: int, **more: pa.Array) -> pa.RecordBatch:
    part = batch.slice(first, last - first)
    return pa.record_batch([*part.columns, *more.values()], names=[*batch.schema.names, *more])


def _encoding(path: str, text: str, back: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(ForcedBoundaries, path)
        for batch in batches:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            rest = batch.drop_columns([text])
            for first, last in text_groups(texts, WINDOW):
                some = texts[first:last]
                if max(map(len, some)) > WINDOW:
                    each = [encoder.encode_long(t) for t in some]
                    ids, sizes = np.concatenate(each), np.fromiter(map(len, each), np.int64, len(each))
                else:
                    ids, sizes = encoder.encode(some)
                at = np.r_[0, np.cumsum(sizes)] * 4
                packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(some), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(ids.astype("<u4"))])
                more = {"n_tokens": pa.array(sizes, pa.int64()), "ids": packed.cast(pa.binary())}
                if back:
                    decoder, ends = kept(Decoder, path), np.cumsum(sizes)
                    more["decoded"] = pa.array([decoder.decode(ids[b - n : b]) for b, n in zip(ends, sizes, strict=True)], pa.binary()).cast(pa.string())
                yield _with(rest, first, last, **more)

    return run


def _decoding(path: str, ids: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = kept(Decoder, path)
        for batch in batches:
            packed = [x or b"" for x in batch.column(ids).to_pylist()]
            for first, last in text_groups(packed, 4 * WINDOW):
                texts = [decoder.decode(np.frombuffer(x, "<u4")) for x in packed[first:last]]
                yield _with(batch, first, last, decoded=pa.array(texts, pa.binary()).cast(pa.string()))

    return run


def encode(documents: DataFrame, tokenizer: str | None = None, back: bool = False) -> DataFrame:
    """documents with n_tokens and, in place of the text, ids: little-endian unsigned 32-bit integers in one binary value.

    back: with `decoded` too, as decode gives it, in the same pass."""
    storage.small_batches(documents.sparkSession)
    added = {"n_tokens": F.lit(0).cast("bigint"), "ids": F.lit(b"")} | ({"decoded": F.lit("")} if back else {})
    docs = documents.drop(*added)
    left = docs.drop("text")
    schema = left.select("*", *[c.alias(n) for n, c in added.items()]).schema
    return docs.select(*left.columns, "text").mapInArrow(_encoding(tokenizer or tokenizer_path(TOKENIZER), "text", back), _nullable(schema))


def decode(encoded: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """encoded with the decoded text of its ids; null ids give an empty one."""
    storage.small_batches(encoded.sparkSession)
    left = encoded.drop("decoded")
    schema = left.select("*", F.lit("").alias("decoded")).schema
    return left.mapInArrow(_decoding(tokenizer or tokenizer_path(TOKENIZER), "ids"), _nullable(schema))


def _nullable(schema):
    for field in schema:
        field.nullable = True
    return schema
