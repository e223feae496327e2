"""Tokenising by cached units.

A public tokenizer cuts a text into pieces that it encodes one by one. Texts are split where
such cuts are certain; each distinct unit is encoded once per process (the store starts anew at
a bounded number of units) and the ids of a batch are gathered with array operations. Texts in
which the cuts are not certain go through the tokenizer whole, so ids always equal those of the
tokenizer over the whole text.
"""

from __future__ import annotations

import ctypes
import itertools
import os
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Units that a store holds at most before it starts anew, and fewer where memory counts for more than time.
UNITS, FEW_UNITS = 600_000, 250_000
#: Bytes of text that one step of array operations takes, fewer likewise, and fewest, where other stages have filled memory before.
SLICE_BYTES, FEW_BYTES, FEWEST_BYTES = 6 << 20, 3 << 20, 3 << 19
#: New units that are encoded in one text, and what stands between them where spaces are dropped.
JOINED, MARK = 500, "\x01"
#: Words of Latin letters, which no step before the model cuts or composes.
PLAIN = re.compile(" ?[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+")
#: Such a word, without the letter whose lower case ends with a mark, and signs: the first sign opens a piece of its own.
TAILED = re.compile(" ?[A-Za-zÀ-ÖØ-öø-įı-ɏ]+" + r"[!-&(-/:-@\[-`{-~]+")
#: How byte-level vocabularies write bytes: printable ones as themselves, the others in order from U+0100.
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTES = {b: chr(0x100 + i) for i, b in enumerate(sorted(set(range(256)) - set(_SHOWN)))}
SPACE = BYTES[0x20]
#: The bytes of plain words and spaces that are written otherwise.
_OTHERWISE = [(chr(b), c) for b, c in BYTES.items() if b == 0x20 or b >= 0x7F]


def give_back() -> None:
    """Memory that is free in this process goes back to the system, where the C library can do that."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


class UnitStore:
    """Distinct units and their ids in one flat array.

    A full store starts anew with the units that were asked for again since it last did so.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = UNITS, signs: bool = False):
        """``encode`` gives (ids of all units one after another, ids per unit); ``signs``: it cuts before signs behind a plain word."""
        self.encode, self.limit, self.signs = encode, limit, signs
        self.clear()

    _last: UnitStore | None = None

    def activate(self) -> None:
        """Empty the store that was used before this one: a process holds one full store at a time."""
        if UnitStore._last is not None and UnitStore._last is not self:
            UnitStore._last.clear()
            give_back()
        UnitStore._last = self

    @classmethod
    def release(cls) -> None:
        """Empty the store that is in use."""
        if cls._last is not None:
            cls._last.clear()
            cls._last = None
            give_back()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.start = np.zeros(1 << 14, np.int64)
        self.again = np.zeros(1 << 14, bool)
        self.used = 0

    def _renew(self) -> None:
        """Only units that were asked for again stay, none if they are over half of a full store."""
        again = self.again[: len(self.index)]
        if (k := int(again.sum())) == 0 or 2 * k > self.limit:
            return self.clear()
        units = list(itertools.compress(self.index, again.tolist()))
        ids, n = self.gather(np.flatnonzero(again))
        self.clear()
        self._add(units, ids, n)

    def _add(self, units: list[str], ids: np.ndarray, n: np.ndarray) -> None:
        k = len(self.index)
        while k + len(units) + 1 > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.again = np.concatenate([self.again, np.zeros_like(self.again)])
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[k + 1 : k + 1 + len(units)] = self.used + np.cumsum(n)
        self.used += len(ids)
        self.index.update(zip(units, range(k, k + len(units)), strict=True))

    def rows(self, units: list[str]) -> np.ndarray:
        """Row numbers of the units, new ones encoded. Valid until the next call."""
        self.activate()
        if len(self.index) > self.limit:
            self._renew()
        index = self.index
        out = np.fromiter(map(index.get, units, itertools.repeat(-1)), np.int64, len(units))
        new = out < 0
        self.again[out[~new]] = True
        if new.any():
            unknown = list(itertools.compress(units, new.tolist()))
            missing = list(dict.fromkeys(unknown))
            # a last comma or stop behind a letter is a piece of its own, as are signs behind a plain word
            tails = {u: len(u) - 1 for u in missing if u.endswith((",", ".")) and u[-2:-1].isalpha() and (u[-2].isascii() or unicodedata.normalize("NFC", u[-2]).lower()[-1:].isalpha())}
            if self.signs:
                word, signs = PLAIN.match, TAILED.fullmatch
                tails |= {u: word(u).end() for u in missing if u not in tails and signs(u)}
            need = dict.fromkeys([u for u in missing if u not in tails] if tails else missing)
            need |= dict.fromkeys([u[:k] for u, k in tails.items()]) | dict.fromkeys([u[k:] for u, k in tails.items()])
            need = [u for u in need if u not in index]
            self._add(need, *self.encode(need))
            if tails:
                pairs = np.array([(index[u[:k]], index[u[k:]]) for u, k in tails.items()], np.int64).ravel()
                ids, n = self.gather(pairs)
                self._add(list(tails), ids, n[::2] + n[1::2])
            out[new] = np.fromiter(map(index.__getitem__, unknown), np.int64, len(unknown))
        return out

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the rows one after another, ids per row)."""
        begin = self.start[rows]
        n = self.start[rows + 1] - begin
        return self.flat[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())], n


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, part) of about ``most`` bytes each, one text at least; nulls become empty."""
    texts = pc.fill_null(texts, "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        yield a, texts.slice(a, b - a)
        a = b


def split_spaces(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """(code of every part between spaces, distinct parts, number of parts of each text)."""
    lists = pc.split_pattern(texts, " ")
    coded = lists.flatten().dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_numpy(zero_copy_only=False).tolist(), np.diff(lists.offsets.to_numpy())


def _sum_by(counts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of ``values``, ``counts[i]`` long each."""
    total = np.concatenate([[0], np.cumsum(values)])
    at = np.concatenate([[0], np.cumsum(counts)])
    return total[at[1:]] - total[at[:-1]]


def flat_lists(lists) -> tuple[np.ndarray, np.ndarray]:
    """(values of all lists, their lengths)."""
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(itertools.chain.from_iterable(lists), np.uint32, int(n.sum())), n


class TextEncoder:
    """Ids of whole texts by a tokenizers file, exactly as its ``encode`` gives them."""

    def __init__(self, path: str, keeps_spaces: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.keeps_spaces = keeps_spaces
        self.model = self.tokenizer.model
        if keeps_spaces:
            vocabulary = self.tokenizer.get_vocab()
            self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
            self.opens[[i for t, i in vocabulary.items() if t.startswith(SPACE)]] = True
        else:
            self.mark = self._one_by_one([MARK])[0]
        self.store = UnitStore(self._units, UNITS if keeps_spaces else FEW_UNITS, signs=True)

    def _one_by_one(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return flat_lists([e.ids for e in self.tokenizer.encode_batch(units, add_special_tokens=False)])

    def _words(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of plain letters, with or without a space before: one piece each, so the model alone is asked."""
        tokens = self.model.tokenize
        written = "\n".join(units).encode().decode("latin-1")
        for shown, c in _OTHERWISE:
            written = written.replace(shown, c)
        return flat_lists([[t.id for t in tokens(w)] for w in written.split("\n")])

    def _units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units: words of plain letters by the model, others with their surroundings."""
        whole = PLAIN.fullmatch
        if self.keeps_spaces:
            plain = [whole(u) is not None for u in units]
        else:  # the vocabulary lower-cases
            plain = [whole(u) is not None and u[0] != " " and u == u.lower() for u in units]
        words, others = [list(itertools.compress(units, x)) for x in (plain, [not p for p in plain])]
        if not others:
            return self._words(words)
        if not words:
            return self._joined(others)
        ids, n = (np.concatenate(x) for x in zip(self._words(words), self._joined(others), strict=True))
        plain, place = np.array(plain), np.empty(len(units), np.int64)
        place[plain], place[~plain] = np.arange(len(words)), np.arange(len(words), len(units))
        begin, size = (np.cumsum(n) - n)[place], n[place]
        return ids[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())], size

    def _joined(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units, many in one text where the text shows again where units begin."""
        if self.keeps_spaces:
            # " word" with no other white space: its first token, and no other, opens with the space
            joins = [len(u) > 1 and u[0] == " " and u.isprintable() and " " not in u[1:] and "<|" not in u for u in units]
        else:
            joins = [len(u) > 0 and u.isprintable() and "<|" not in u for u in units]
        many = [u for u, j in zip(units, joins, strict=True) if j]
        ids, n = [], []
        for a in range(0, len(many), JOINED):
            part = many[a : a + JOINED]
            text = "".join(part) if self.keeps_spaces else f" {MARK} ".join(part)
            got = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
            if self.keeps_spaces:
                size = np.diff(np.concatenate([np.flatnonzero(self.opens[got]), [len(got)]]))
            else:
                at = np.flatnonzero(got == self.mark)
                size = np.diff(np.concatenate([[-1], at, [len(got)]])) - 1
                got = np.delete(got, at)
            if len(size) != len(part):
                got, size = self._one_by_one(part)
            ids.append(got)
            n.append(size)
        rest = [u for u, j in zip(units, joins, strict=True) if not j]
        if rest:
            got, size = self._one_by_one(rest)
            ids.append(got)
            n.append(size)
        if not ids:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        ids, n = np.concatenate(ids), np.concatenate(n)
        if not rest or not many:
            return ids, n
        j = np.array(joins)
        place = np.empty(len(units), np.int64)
        place[j], place[~j] = np.arange(len(many)), np.arange(len(many), len(units))
        begin, size = (np.cumsum(n) - n)[place], n[place]
        return ids[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())], size

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, ids per text)."""
        # special tokens; and, where spaces are kept, white space behind white space
        odd = pc.match_substring(texts, "<|")
        if self.keeps_spaces:
            odd = pc.or_(odd, pc.match_substring_regex(texts, r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\p{Z}][\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\p{Z}]"))
        odd = odd.to_numpy(zero_copy_only=False).astype(bool)
        plain = pc.if_else(pa.array(odd), "", texts) if odd.any() else texts
        if self.keeps_spaces:
            # a line end by itself is a piece; what follows it, or opens a text, has no space before it
            codes, parts, n_parts = split_spaces(pc.replace_substring(plain, "\n", " \n "))
            bare = np.zeros(len(codes) + 1, bool)
            bare[np.cumsum(n_parts) - n_parts] = True
            if "\n" in parts:
                line = np.flatnonzero(codes == parts.index("\n"))
                bare[line] = bare[line + 1] = True
            bare = bare[:-1]
            used, at = np.unique(codes[bare], return_inverse=True)
            rows = self.store.rows([" " + p for p in parts] + [parts[i] for i in used])
            of_part = rows[codes]
            of_part[bare] = rows[len(parts) :][at]
        else:
            # the vocabulary lower-cases; a combining mark could compose with one case only
            plain = pc.if_else(pc.match_substring_regex(plain, r"\p{M}"), plain, pc.ascii_lower(plain))
            for c in "\n\t\r\v\f":
                plain = pc.replace_substring(plain, c, " ")
            codes, parts, n_parts = split_spaces(plain)
            of_part = self.store.rows(parts)[codes]
        ids, n = self.store.gather(of_part)
        per_text = _sum_by(n_parts, n)
        if odd.any():
            where = np.flatnonzero(odd)
            whole = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch(texts.take(pa.array(where)).to_pylist(), add_special_tokens=False)]
            # an odd text stood for an empty one, whose own unit has no ids but, at most, those of ""
            cuts = np.split(ids, np.cumsum(per_text)[:-1])
            for i, w in zip(where, whole, strict=True):
                cuts[i] = w
            ids, per_text = np.concatenate(cuts), np.array([len(c) for c in cuts])
        return ids, per_text


_ENCODERS: dict[tuple[str, bool], TextEncoder] = {}


def encoder(path: str, keeps_spaces: bool) -> TextEncoder:
    """One encoder a process and file."""
    if (key := (path, keeps_spaces)) not in _ENCODERS:
        _ENCODERS[key] = TextEncoder(path, keeps_spaces)
    return _ENCODERS[key]
