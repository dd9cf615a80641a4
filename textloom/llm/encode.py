"""Token ids of whole texts with a public tokenizer, each distinct word encoded once by the library.

A byte-level pre-tokenizer always cuts before a single space that stands between two characters that are no white
space, so a text may be cut there and the ids of the parts joined: the result is that of encoding the whole text.
"""

from __future__ import annotations

import os
import re

import numpy as np

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
RUN_WORDS = 1000  # new words that the library gets as one text
SPACE_BYTE = "\u0120"  # how a byte-level vocabulary writes a space
CACHE_WORDS = 600_000  # words that a Python worker remembers; then it keeps the half at most that came more than once
MARKS = "!#$%&*+,-./:;=?@"  # a byte-level pre-tokenizer cuts between a letter or digit and these
_UNSAFE = re.compile(r"\s \s|\s \Z")
_CUT = re.compile(r"(?<=\S) (?=\S)")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Ids(dict):
    """Numbers its keys in the order they come, in one count with others, and lists the new ones with what stands before."""

    def __init__(self, count: list[int], new: list[str], before: str):
        self.count, self.new, self.before = count, new, before

    def __missing__(self, key):
        self[key] = n = self.count[0]
        self.count[0] += 1
        self.new.append(self.before + key)
        return n


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.begins = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        self.begins[[i for token, i in self.tokenizer.get_vocab().items() if token.startswith(SPACE_BYTE)]] = True
        self.marks = "".join(c for c in MARKS if c not in {t.content[-1:] for t in self.tokenizer.get_added_tokens_decoder().values()})
        self.count, self.new = [0], []
        self.at_start, self.after_space = _Ids(self.count, self.new, ""), _Ids(self.count, self.new, " ")
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.length, self.uses = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _forget(self) -> None:
        """Words that came once go, as do the rarest of the others beyond half of CACHE_WORDS. Old uses count half from then on."""
        least = 2
        if np.count_nonzero(self.uses > 1) > CACHE_WORDS // 2:
            least = int(np.partition(self.uses, -(CACHE_WORDS // 2))[-(CACHE_WORDS // 2)]) + 1
        keep = self.uses >= least
        number, known = (np.cumsum(keep) - 1).tolist(), keep.tolist()
        for words in (self.at_start, self.after_space):
            left = [(w, number[n]) for w, n in words.items() if known[n]]
            words.clear()
            words.update(left)
        self.count[0] = int(keep.sum())
        kept = self._joined(np.flatnonzero(keep))
        self.length, self.uses, self.used = self.length[keep], self.uses[keep] // 2, len(kept)
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.r_[kept, np.zeros(1 << 16, np.uint32)]

    def _learn(self) -> None:
        """The ids of new parts: of those that end in marks after a letter or digit, what stands before and the marks are
        parts of their own, and their ids are joined."""
        if not self.new:
            return
        joined, pairs, marks = [], [], self.marks
        for i, part in enumerate(self.new.copy()):
            if part[-1:] not in marks:
                continue
            stem = part.rstrip(marks)
            if part[:1] == " " and len(stem) > 1 and stem[-1] < "\u0250" and stem[-1].isalnum():
                joined.append(i)
                pairs += self.after_space[stem[1:]], self.at_start[part[len(stem) :]]
        new, before = self.new.copy(), len(self.length)
        self.new.clear()
        plain = np.ones(len(new), bool)
        plain[joined] = False
        flat, length = self._encode_words([w for w, p in zip(new, plain.tolist(), strict=True) if p])
        none = np.zeros(len(new), np.int64)
        self.start, self.length, self.uses = np.r_[self.start, none], np.r_[self.length, none], np.r_[self.uses, none]
        self._add(before + np.flatnonzero(plain), flat, length)
        pair = np.array(pairs, np.int64)
        self._add(before + np.array(joined, np.int64), self._joined(pair), self.length[pair].reshape(-1, 2).sum(1))
        np.add.at(self.uses, pair, 1)

    def _add(self, number: np.ndarray, flat: np.ndarray, length: np.ndarray) -> None:
        total = len(flat)
        while self.used + total > len(self.flat):
            self.flat = np.r_[self.flat, np.zeros(len(self.flat), np.uint32)]
        self.flat[self.used : self.used + total] = flat
        self.start[number], self.length[number] = self.used + np.cumsum(length) - length, length
        self.used += total

    def _joined(self, number: np.ndarray) -> np.ndarray:
        """The ids of numbered parts, one after the other."""
        length = self.length[number]
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.start[number] - (ends - length), length) + np.arange(total)]

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([x for part in ids for x in part], np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))

    def _encode_words(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the parts. Those of a space and something that is no white space are encoded in long runs, for the
        library takes its time for each text; an id that begins with a space then begins a part."""
        run = np.array([len(w) > 1 and w[0] == " " and not w[1].isspace() for w in new])
        flat, length = self._each([w for w, r in zip(new, run, strict=True) if not r])
        words = [w for w, r in zip(new, run, strict=True) if r]
        more, _ = self._each(["".join(words[i : i + RUN_WORDS]) for i in range(0, len(words), RUN_WORDS)])
        first = np.flatnonzero(self.begins[more])
        if len(first) != len(words):  # a special token with a space in it; no public tokenizer here has one
            more, sizes = self._each(words)
        else:
            sizes = np.diff(np.r_[first, len(more)])
        lengths = np.zeros(len(new), np.int64)
        lengths[~run], lengths[run] = length, sizes
        out = np.zeros(len(flat) + len(more), np.uint32)
        place = np.repeat(run, lengths)
        out[~place], out[place] = flat, more
        return out, lengths

    def _numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The number of each part of each text, and how many parts each text has."""
        if self.count[0] > CACHE_WORDS:
            self._forget()
        def numbers(of: dict):
            return lambda parts, get=of.__getitem__: np.fromiter(map(get, parts), np.int64, len(parts))

        first, other, found, many = numbers(self.at_start), numbers(self.after_space), [np.zeros(0, np.int64)], []
        for text in texts:
            parts = text.split(" ") if _UNSAFE.search(text) is None else _CUT.split(text)
            found += first(parts[:1]), other(parts[1:])
            many.append(len(parts))
        self._learn()
        number = np.concatenate(found)
        self.uses += np.bincount(number, minlength=len(self.uses))
        return number, np.array(many, np.int64)

    def lengths(self, texts: list[str]) -> np.ndarray:
        number, many = self._numbers(texts)
        if not len(many):
            return many
        return np.add.reduceat(self.length[number], np.cumsum(many) - many)

    def encode(self, texts: list[str], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many each text has; end_id follows each text."""
        number, many = self._numbers(texts)
        if not len(many):
            return np.zeros(0, np.uint32), many
        ids = self._joined(number)
        sizes = np.add.reduceat(self.length[number], np.cumsum(many) - many)
        if end_id is not None:
            ids, sizes = np.insert(ids, np.cumsum(sizes), np.uint32(end_id)), sizes + 1
        return ids, sizes


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each tokenizer in a Python worker, kept from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def text_groups(texts: list[str], limit: int = 1 << 20):
    """Runs of texts of about `limit` characters."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= limit:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)
