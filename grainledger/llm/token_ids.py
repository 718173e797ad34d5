"""Token ids of whole texts with a public tokenizer, encoded word by word so that frequent words cost a look-up."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import zlib
from array import array
from collections.abc import Iterable
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A space after white space (other than that of _RARE): here the words cannot be told by single spaces.
_PAIRS = ("  ", "\n ", "\t ", "\r ")

#: White space to one library but perhaps not to another; a text with any of it is encoded in one call.
_RARE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200d\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")

#: Latin letters, then punctuation that no contraction begins with: two pre-tokens of any pre-tokenizer used here.
_LETTERS, _MARKS = re.compile(r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+").fullmatch, "-!#$%&()*+,./:;<=>?@|~"

#: Stands between units that are encoded in one call, so many at a time; one of the above, so that no unit has it.
BETWEEN, TOGETHER = "\x1e", 64


class _Units(dict):
    """Ids (bytes) of ``before + unit`` of the units that came first, while there is room."""

    def __init__(self, before: str, room: int, line: _Units | None = None, end: _Units | None = None):
        self.before, self.room, self.line, self.end = before, room, line, end

    def of(self, units: Iterable[str], ids_of_many) -> dict[str, bytes]:
        """Ids of units of which none is known: those of parts that are known or come more than once are found once, the others in one call."""
        ended, lined, rest, need = [], [], [], {}
        for unit in units:
            if unit.isalpha():  # most new ones: neither marks nor lines to look for, and not known
                need[unit] = None
            else:
                rest.append(unit)
        got = {}
        for unit in rest:
            if self.end is not None and len(word := unit.rstrip(_MARKS)) < len(unit) and _LETTERS(word):
                ended.append((unit, word, unit[len(word) :]))
                if word in self:
                    got[word] = self[word]
                else:
                    need[word] = None
            elif self.line is not None and unit.count("\n") == 1 and unit[0] != "\n" and unit[-1] != "\n":
                lined.append((unit, *unit.split("\n")))
            else:
                need[unit] = None
        left = self.all([x[1] for x in lined], ids_of_many)
        right = self.line.all([x[2] for x in lined], ids_of_many) if lined else ()
        marks = self.end.all([x[2] for x in ended], ids_of_many) if ended else ()
        if lined:  # the lines' own words may be known by now
            got.update((unit, self[unit]) for unit in need if unit in self)
        new = [unit for unit in need if unit not in got] if got else list(need)
        got.update(zip(new, ids_of_many(new, self.before)))
        got.update((unit, got[word] + mark) for (unit, word, _), mark in zip(ended, marks))
        got.update((unit, a + b) for (unit, _, _), a, b in zip(lined, left, right))
        if len(self) < self.room:
            self.update(islice(got.items(), self.room - len(self)))
        return got

    def all(self, units: list[str], ids_of_many) -> list[bytes]:
        """Ids of any units, of each in its place."""
        got = list(map(self.get, units))
        if new := {unit for unit, ids in zip(units, got) if ids is None}:
            found = self.of(new, ids_of_many)
            got = [found[unit] if ids is None else ids for unit, ids in zip(units, got)]
        return got


class WordEncoder:
    """Ids of texts, equal to the tokenizer's for the text in one call.

    The pre-tokenizers of the files used never join what stands before white space with what follows its
    start, nor letters with the punctuation after them, so a text falls into units whose ids concatenate to
    the text's. Arrow tells the distinct units of the texts given, and each is looked up once; up to ``remember``
    of them are remembered, of which the frequent ones come early and stay.
    Strings of special tokens in a text are ordinary text.
    """

    def __init__(self, path: str, keeps_space: bool, remember: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import AddedToken, Tokenizer

        def load() -> Tokenizer:
            tokenizer = Tokenizer.from_file(path)
            tokenizer.encode_special_tokens = True
            return tokenizer

        self.load = load
        self.tokenizer = load()
        self.between = self.tokenizer.get_vocab_size()  # the id that BETWEEN is given
        self.tokenizer.add_tokens([AddedToken(BETWEEN, normalized=False)])
        self.plain = None
        self.wide = self.between > 65536
        self.dtype = np.dtype("<u4" if self.wide else "<u2")
        self.keeps_space = keeps_space
        end = _Units("", remember // 10)
        if keeps_space:
            line = _Units("\n", remember // 5, end=end)
            self.first = _Units("", remember // 10, line, end)
            self.known = _Units(" ", remember, line, end)
        else:
            self.first = self.known = _Units("", remember, end=end)

    def ids_of_many(self, units: list[str], before: str = "") -> list[bytes]:
        """Ids of ``before + unit`` of each: joined by a token of their own, which the tokenizer parts them at, since a call for each costs more than its ids do."""
        out, width, between = [], self.dtype.itemsize, BETWEEN + before
        for e in self.tokenizer.encode_batch_fast([before + between.join(units[i : i + TOGETHER]) for i in range(0, len(units), TOGETHER)], add_special_tokens=False):
            ids = np.frombuffer(array("I", e.ids), np.uint32)
            raw, a = ids.astype(self.dtype).tobytes(), 0
            for b in [*(np.flatnonzero(ids == self.between) * width).tolist(), len(raw)]:
                out.append(raw[a:b])
                a = b + width
        return out

    def ids(self, text: str) -> bytes:
        """Ids of any text in one call; one that has the joining character needs a tokenizer that knows no such token."""
        tokenizer = self.tokenizer
        if BETWEEN in text:
            tokenizer = self.plain = self.plain or self.load()
        return np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype).tobytes()

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned integers of ``self.dtype``."""
        out = [self.ids(t) if _RARE.search(t) or self.keeps_space and any(pair in t for pair in _PAIRS) else None for t in texts]
        split = pa.array([t for t, ids in zip(texts, out) if ids is None], pa.large_string())
        split = pc.split_pattern(split, " ") if self.keeps_space else pc.ascii_split_whitespace(split)
        units, bounds = split.values, split.offsets.to_numpy()
        first = np.zeros(len(units), bool)
        if self.keeps_space:
            first[bounds[:-1]] = True
        code, found = np.empty(len(units), np.int64), [b""]
        for here, known in ((first, self.first), (~first, self.known)):
            if here.any():
                coded = units.filter(pa.array(here)).dictionary_encode()
                code[here] = coded.indices.to_numpy() + len(found)
                found += known.all(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), self.ids_of_many)
        # the ids of all distinct units one after the other, and of each unit in the texts its run of them
        width = self.dtype.itemsize
        size = np.fromiter(map(len, found), np.int64, len(found)) // width
        start, size = (np.cumsum(size) - size)[code], size[code]
        after = np.cumsum(size)
        ids = np.frombuffer(b"".join(found), self.dtype)[np.arange(size.sum()) + np.repeat(start - after + size, size)].tobytes()
        at = (np.concatenate([[0], after])[bounds] * width).tolist()
        got = iter(zip(at, at[1:]))
        return [ids[slice(*next(got))] if whole is None else whole for whole in out]

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer's file on this machine; resolved where the task runs."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


_encoders: dict[tuple, WordEncoder] = {}


def give_back() -> None:
    """Returns to the machine what this Python worker has freed; else it stays the worker's while it waits for another task."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def let_go() -> None:
    """Gives back what an encoder with its units takes, more than 100 MB: for tasks of operators that have no use for it and
    may run in the same Python worker."""
    if _encoders:
        _encoders.clear()
        gc.collect()  # units and encoder refer to one another
        give_back()


def encoder(name: str, keeps_space: bool, remember: int = 500_000) -> WordEncoder:
    """One encoder for each Python worker, kept between tasks until another is asked for or ``let_go`` is called."""
    key = (name, keeps_space, remember)
    if key not in _encoders:
        let_go()
        _encoders[key] = WordEncoder(tokenizer_path(name), keeps_space, remember)
    return _encoders[key]


def crc_of_ids(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())
