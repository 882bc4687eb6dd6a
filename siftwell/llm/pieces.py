"""Batch encoding by a public tokenizer, over the distinct pieces of a batch.

Texts are cut at safe boundaries, where the tokenizer itself always cuts, so the
ids of a text are those of its pieces one after another and a very long text is
never encoded at once.  Each distinct piece of a batch is encoded once, and a
bounded cache in the Python worker keeps pieces for later batches.

Which boundaries are safe depends on the pre-tokenizer:

- ``spaces``: white space is dropped and case is folded, so each run of anything
  but ASCII white space is a piece; ASCII pieces are lower-cased beforehand.
- ``before_space``: a single space belongs to the word that follows it, so a
  piece begins at each space that has other characters than white space on both
  sides.

Both also cut between an ASCII letter and ASCII punctuation other than ``'``.  No
such cut and none before a space is made where a special token (``<|``) may be or,
for ``before_space``, next to white space beyond ASCII.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .shared import LOWER, ranges, ranges_to_strings, text_bytes

#: Pieces that a worker's cache holds before it starts anew.
CACHE_PIECES = 1_000_000
#: Bytes of text that the library gets at once.
ENCODE_BYTES = 1 << 20

_SPECIAL = r"<\|"
_OTHER_SPACE = r"<\||[\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_SPECIAL_BYTES = re.compile(rb"<\|")
#: The same white space in UTF-8, in runs.
_OTHER_BYTES = re.compile(rb"(?:[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80)+")
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[c for c in b"!\"#$%&()*+,-./:;<=>?@[]^_`{}~\\"]] = True


def tokenizer_path(name: str) -> str:
    """A tokenizer file's place; a path is taken as it is."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """``lengths`` and ``ids`` of text columns, equal to the library's results on the whole texts."""

    def __init__(self, name: str, cut: str, keep_ids: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.cut, self.keep_ids = Tokenizer.from_file(tokenizer_path(name)), cut, keep_ids
        self.special = max((len(t.content.encode()) for t in self.tokenizer.get_added_tokens_decoder().values()), default=0)
        self._clear()

    def _clear(self) -> None:
        self.number: dict[str, int] = {}
        self.size = np.zeros(0, np.int64)
        self.at = np.zeros(0, np.int64)
        self.arena = np.zeros(0, np.uint32)

    def _pieces(self, col: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The pieces of all rows and how many each row has."""
        data, offs = text_bytes(col)
        n = len(data)
        edge = np.zeros(n + 1, bool)
        if n > 2:
            left, right = data[:-1], data[1:]
            edge[1:-1] = (_LETTER[left] & _PUNCT[right]) | (_PUNCT[left] & _LETTER[right])
        space = _SPACE[data]
        if self.cut == "before_space" and n > 2:
            edge[1:-2] |= (data[1:-1] == 0x20) & ~space[:-2] & ~space[2:]
        odd = _OTHER_SPACE if self.cut == "before_space" else _SPECIAL
        for r in np.flatnonzero(pc.match_substring_regex(col, odd).to_numpy(zero_copy_only=False)):
            begin, text = int(offs[r]), data[offs[r] : offs[r + 1]].tobytes()
            for m in _SPECIAL_BYTES.finditer(text):
                edge[begin + max(m.start() - 1, 0) : begin + m.start() + self.special + 1] = False
            for m in _OTHER_BYTES.finditer(text) if self.cut == "before_space" else ():
                edge[begin + max(m.start() - 1, 0) : begin + m.end() + 1] = False
        edge[offs] = True
        if self.cut == "before_space":
            edge[n] = False
            starts = np.flatnonzero(edge)
            ends = np.append(starts[1:], n) if len(starts) else starts
        else:
            starts = np.flatnonzero(~space & (edge[:-1] | np.concatenate(([True], space[:-1]))[:n]))
            ends = np.flatnonzero(~space & (edge[1:] | np.concatenate((space[1:], [True]))[:n])) + 1
            ascii_only = np.diff(np.concatenate(([0], np.cumsum(data >= 0x80)))[np.stack((starts, ends))], axis=0)[0] == 0
            special = np.zeros(n + 1, bool)
            special[:-1] = data == ord("|")
            ascii_only &= np.diff(np.concatenate(([0], np.cumsum(special)))[np.stack((starts, ends))], axis=0)[0] == 0
            fold = np.zeros(n + 1, np.int8)
            fold[starts[ascii_only]] += 1
            fold[ends[ascii_only]] -= 1
            data = np.where(np.cumsum(fold[:n]) > 0, LOWER[data], data)
        return ranges_to_strings(data, starts, ends), np.diff(np.searchsorted(starts, offs))

    def _known(self, pieces: pa.Array) -> np.ndarray:
        """The number of each distinct piece, after encoding those that are new."""
        texts = pieces.to_pylist()
        new = [t for t in texts if t not in self.number]
        if len(self.number) + len(new) > CACHE_PIECES:
            self._clear()
            new = texts
        if new:
            sizes, chunks, at = [], [], 0
            while at < len(new):
                to, load = at, 0
                while to < len(new) and (to == at or load < ENCODE_BYTES):
                    load += len(new[to])
                    to += 1
                for e in self.tokenizer.encode_batch_fast(new[at:to], add_special_tokens=False):
                    ids = e.ids
                    sizes.append(len(ids))
                    if self.keep_ids:
                        chunks += ids
                at = to
            begin = len(self.number)
            self.number.update(zip(new, range(begin, begin + len(new))))
            sizes = np.array(sizes, np.int64)
            if self.keep_ids:
                self.at = np.concatenate((self.at, len(self.arena) + np.cumsum(sizes) - sizes))
                self.arena = np.concatenate((self.arena, np.array(chunks, np.uint32)))
            self.size = np.concatenate((self.size, sizes))
        return np.fromiter(map(self.number.__getitem__, texts), np.int64, len(texts))

    def _numbers(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        pieces, counts = self._pieces(col)
        coded = pieces.dictionary_encode()
        known = self._known(coded.dictionary)
        return known[coded.indices.to_numpy(zero_copy_only=False)] if len(pieces) else known, counts

    def lengths(self, col: pa.Array) -> np.ndarray:
        """Tokens of each row."""
        numbers, counts = self._numbers(col)
        return np.diff(np.concatenate(([0], np.cumsum(self.size[numbers])))[np.concatenate(([0], np.cumsum(counts)))])

    def ids(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows, one after another, and how many each row has."""
        numbers, counts = self._numbers(col)
        size = self.size[numbers]
        n = np.diff(np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(counts)))])
        return self.arena[ranges(self.at[numbers], size)], n


_encoders: dict[tuple, Encoder] = {}


def encoder(name: str, cut: str, keep_ids: bool) -> Encoder:
    """The worker's own encoder; it stays from task to task."""
    key = (name, cut, keep_ids)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(name, cut, keep_ids)
    return _encoders[key]
