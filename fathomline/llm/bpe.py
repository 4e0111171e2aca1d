"""Token ids of a public byte-level BPE vocabulary, by the tokenizers library, with a cache of pieces.

The vocabulary's pre-tokenizer never joins a character with a white-space run that follows it, so a text may be cut before each such run and every
piece encoded on its own: the ids are those of the whole text. Pieces repeat. Texts are cut and looked up as arrays, a block of bytes at a time;
what isn't found goes to the library, each distinct piece of a block once.

The cache is a table of fixed size (SETS sets of two places, 40 bytes each) whose keys are the pieces' own bytes, so a find is exact; a new piece
takes the first place of its set and moves the piece there to the second. Pieces of more than 16 bytes, or of more ids than a place holds, lie in a
dictionary of at most LONG_BYTES. Memory doesn't grow with the vocabulary of the texts.
"""

from __future__ import annotations

import json
import os
from array import array

import numpy as np
import pyarrow as pa

from .common import held

#: Sets of the cache's table, as a power of two.
SETS = 1 << 19
LONG_BYTES = 8 << 20
#: Bytes of text that are cut and looked up at once.
BLOCK = 1 << 19
_KEY = 16
_JOINED = 1024
_MOST_MARKS = 4


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of every byte, by the byte-level rule: printable Latin-1 stands for itself, the rest is numbered from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


def _flags(values) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


#: White space before which a text is cut, and after which (among other characters, below) it isn't.
_BLANK, _SPACE = _flags(b" \t\n\r"), _flags(b" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f")
_LETTER, _MARK = _flags([*range(0x41, 0x5B), *range(0x61, 0x7B)]), _flags(b".,!?;:*#$%&|<>()")
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def cuts(data: np.ndarray) -> np.ndarray:
    """Which bytes of data (UTF-8) a piece may begin at: ASCII white space that no white space of any kind precedes."""
    out = np.zeros(len(data), bool)
    if len(data) < 2:
        return out
    out[1:] = _BLANK[data[1:]] & ~_SPACE[data[:-1]]
    wide = np.flatnonzero(out[1:] & (data[:-1] >= 0x80)) + 1
    if len(wide):
        c, b, a = (data[np.maximum(wide - k, 0)] for k in (1, 2, 3))
        space = (b == 0xC2) & ((c == 0x85) | (c == 0xA0)) | (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
        space |= (a == 0xE2) & ((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F))
        out[wide[space]] = False
    return out


class Encoder:
    """Encodes texts with the file at path, without special tokens."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab()
        self.dtype = np.dtype("<u2" if max(vocabulary.values(), default=0) < 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.inline = _KEY // self.dtype.itemsize
        #: Bytes that each id stands for: one for each character of the byte alphabet.
        self.width = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, i in vocabulary.items():
            self.width[i] = len(token)
        with open(path, encoding="utf-8") as f:
            shape = json.load(f)
        before = shape.get("pre_tokenizer") or {}
        self.cuttable = shape.get("normalizer") is None and before.get("type") == "ByteLevel" and not before.get("add_prefix_space", True) and before.get("use_regex", True)
        self.rows = np.zeros((2 * SETS, 5), np.uint64)  # key (two words), bytes and ids, ids (two words)
        self.shift = np.uint64(64 - SETS.bit_length() + 1)
        self.long: dict[bytes, np.ndarray] = {}
        self.long_bytes = 0
        self.model = self.tokenizer.model
        self.alphabet = np.array([ord(sign) for _, sign in sorted(byte_alphabet().items())], "<u2")
        self.marks: dict[bytes, list[int]] = {}

    def encode(self, text: str) -> np.ndarray:
        """The ids of text, with the smallest unsigned type that holds the vocabulary."""
        return self.encode_column(pa.array([text], pa.large_string()))[0]

    def encode_column(self, column: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a string column (null: none), each followed by end_id if given; and the places where texts begin and the last ends."""
        n = len(column)
        if not n:
            return np.zeros(0, self.dtype), np.zeros(1, np.int64)
        at = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
        at -= at[0]
        if self.cuttable:
            ids, counts = self._blocks(data, at)
        else:
            found = [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast([bytes(data[a:b]).decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)], add_special_tokens=False)]
            ids, counts = np.concatenate(found), np.array(list(map(len, found)))
        ends = np.cumsum(counts)
        if end_id is not None:
            ids, ends = np.insert(ids, ends, end_id), ends + np.arange(1, n + 1)
        return ids, np.concatenate([[0], ends])

    def _blocks(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts that begin at `at` in data, and how many each has."""
        out, before = [], np.zeros(len(at), np.int64)  # ids before each text
        begin, total, size = 0, 0, BLOCK
        while begin < len(data):
            stop = min(len(data), begin + size)
            first, last = np.searchsorted(at, [begin, stop], "left")
            mark = cuts(data[begin:stop])
            mark[0] = True
            mark[at[first:last] - begin] = True
            starts = np.flatnonzero(mark)
            if stop < len(data):  # the last piece may go on behind the block
                if len(starts) == 1:
                    size *= 2
                    continue
                stop = begin + int(starts[-1])
                starts = starts[:-1]
                last = np.searchsorted(at, stop, "left")
            ids, counts = self._pieces(data[begin:stop], starts)
            ends = np.concatenate([[0], np.cumsum(counts)])
            before[first:last] = total + ends[np.searchsorted(starts, at[first:last] - begin, "left")]
            total += len(ids)
            out.append(ids)
            begin, size = stop, BLOCK
        before[np.searchsorted(at, len(data), "left") :] = total
        return np.concatenate(out) if out else np.zeros(0, self.dtype), np.diff(before)

    def _pieces(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces of data that begin at starts, and how many each has."""
        sizes = np.diff(starts, append=len(data))
        padded = np.zeros(len(data) + _KEY, np.uint8)
        padded[: len(data)] = data
        word = np.ndarray(len(data) + _KEY - 7, "<u8", padded, strides=(1,))
        low = word[starts] & _MASK[np.minimum(sizes, 8)]
        high = word[starts + 8] & _MASK[np.clip(sizes - 8, 0, 8)]
        h = (low ^ high * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)
        place = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93) >> self.shift << np.uint64(1)
        place = place.astype(np.int64)
        found = self.rows[place]

        def same(rows: np.ndarray, k) -> np.ndarray:
            return (rows[:, 0] == low[k]) & (rows[:, 1] == high[k]) & ((rows[:, 2] & np.uint64(0xFF)) == sizes[k].view(np.uint64))

        lost = np.flatnonzero(~same(found, slice(None)))
        second = self.rows[place[lost] + 1]
        good = same(second, lost)
        found[lost[good]] = second[good]
        lost = lost[~good]
        counts = (found[:, 2] >> np.uint64(8)).astype(np.int64)
        counts[lost] = 0
        slow: dict[int, np.ndarray] = {}
        if len(lost):
            slow = self._missing(padded, starts, sizes, low, high, place, found, counts, lost)
        words = np.ascontiguousarray(found[:, 3:]).view(self.dtype)
        ids = words[np.arange(self.inline) < counts[:, None]]
        if slow:
            where = np.fromiter(slow, np.int64, len(slow))
            is_slow = np.zeros(len(starts), bool)
            is_slow[where] = True
            counts[where] = [len(x) for x in slow.values()]
            spread = np.repeat(is_slow, counts)
            out = np.empty(len(spread), self.dtype)
            out[~spread] = ids
            out[spread] = np.concatenate(list(slow.values()))
            ids = out
        return ids, counts

    def _missing(self, padded, starts, sizes, low, high, place, found, counts, lost) -> dict[int, np.ndarray]:
        """Fills found and counts for the pieces `lost`, and the cache; what no place holds is returned by piece, in order."""
        text = padded.tobytes()
        numbers: dict[bytes, int] = {}
        number = np.array([numbers.setdefault(text[a : a + n], len(numbers)) for a, n in zip(starts[lost].tolist(), sizes[lost].tolist(), strict=True)])
        at = lost[np.unique(number, return_index=True)[1]]  # of each distinct piece the first
        pieces = list(numbers)
        kept = {k: self.long[pieces[k]] for k in np.flatnonzero(sizes[at] > 2).tolist() if pieces[k] in self.long} if self.long else {}
        new = np.array([k for k in range(len(at)) if k not in kept], np.int64)
        pool, begin, n = self._library(padded, text, starts[at[new]], sizes[at[new]])
        fits = (sizes[at[new]] <= _KEY) & (n <= self.inline)
        for k, a, m in zip(new[~fits].tolist(), begin[~fits].tolist(), n[~fits].tolist(), strict=True):
            kept[k] = pool[a : a + m].copy()
            cost = len(pieces[k]) + kept[k].nbytes + 300
            if self.long_bytes + cost > LONG_BYTES:
                self.long, self.long_bytes = {}, 0
            self.long[pieces[k]] = kept[k]
            self.long_bytes += cost
        if fits.any():
            at, begin, n = at[new[fits]], begin[fits], n[fits]
            column = np.arange(self.inline)
            flat = np.where(column < n[:, None], pool[np.minimum(begin[:, None] + column, len(pool) - 1)], 0).astype(self.dtype)
            rows = np.empty((len(at), 5), np.uint64)
            rows[:, 0], rows[:, 1], rows[:, 2], rows[:, 3:] = low[at], high[at], sizes[at] | n << 8, flat.view(np.uint64)
            row_of = np.full(len(pieces), -1)
            row_of[new[fits]] = np.arange(len(at))
            got = row_of[number]
            found[lost[got >= 0]] = rows[got[got >= 0]]
            counts[lost[got >= 0]] = n[got[got >= 0]]
            self.rows[place[at] + 1] = self.rows[place[at]]
            self.rows[place[at]] = rows
        return {k: kept[x] for k, x in zip(lost.tolist(), number.tolist(), strict=True) if x in kept} if kept else {}

    def _library(self, data: np.ndarray, text: bytes, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of pieces of data, where in them each piece's begin and how many they are.

        A word of letters (one blank before it or none) and the marks behind it goes to the model alone: the pre-tokenizer parts the two, and nothing else there.
        """
        ends = starts + sizes
        marks, on = np.zeros(len(starts), np.int64), np.ones(len(starts), bool)
        for k in range(1, _MOST_MARKS + 1):
            on &= (sizes > k) & _MARK[data[ends - k]]
            marks += on
        first, last = starts + (data[starts] == 0x20), ends - marks
        other = np.concatenate([[0], np.cumsum(~_LETTER[data], dtype=np.int32)])
        wide = np.concatenate([[0], np.cumsum(data >= 0x80, dtype=np.int32)])
        word = (last > first) & (other[last] == other[first])
        for k in np.flatnonzero((last > first) & ~word & (other[last] - other[first] == wide[last] - wide[first])).tolist():
            word[k] = text[first[k] : last[k]].decode("utf-8", "replace").isalpha()  # the sign that replaces wrong bytes is no letter
        spelt = self.alphabet[data].tobytes().decode("utf-16-le")
        tokenize, pool, n = self.model.tokenize, array(self.code), np.zeros(len(starts), np.int64)
        words = np.flatnonzero(word)
        sized = []
        for a, b, m in zip(starts[words].tolist(), last[words].tolist(), marks[words].tolist(), strict=True):
            ids = [t.id for t in tokenize(spelt[a:b])]
            if m:
                ids += self._behind(text[b : b + m])
            pool.extend(ids)
            sized.append(len(ids))
        n[words] = sized
        rest = np.flatnonzero(~word)
        order = np.concatenate([words, rest])
        if len(rest):
            found = self._together([text[a:b] for a, b in zip(starts[rest].tolist(), ends[rest].tolist(), strict=True)])
            n[rest] = list(map(len, found))
            for ids in found:
                pool.frombytes(ids.tobytes())
        begin = np.empty(len(starts), np.int64)
        begin[order] = np.cumsum(n[order]) - n[order]
        return np.frombuffer(pool, self.dtype), begin, n

    def _behind(self, marks: bytes) -> list[int]:
        if (ids := self.marks.get(marks)) is None:
            if len(self.marks) > 1000:
                self.marks.clear()
            ids = self.marks[marks] = self.tokenizer.encode(marks.decode(), add_special_tokens=False).ids
        return ids

    def _together(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of each piece. Those that begin with white space and don't end with it are encoded together and told apart by the bytes of their ids."""
        groups: list[tuple[list[int], str]] = []
        members: list[int] = []
        parts: list[str] = []
        size = 0

        def close() -> None:
            nonlocal members, parts, size
            if members:
                groups.append((members, "".join(parts)))
            members, parts, size = [], [], 0

        for k, p in enumerate(pieces):
            text = p.decode("utf-8", "replace")
            if _BLANK[p[0]] and not text[-1].isspace() and "\ufffd" not in text:
                members.append(k)
                parts.append(text)
                size += len(p)
                if size >= _JOINED:
                    close()
            else:
                groups.append(([k], text))
        close()
        out: list[np.ndarray] = [np.zeros(0, self.dtype)] * len(pieces)
        for (who, _), e in zip(groups, self.tokenizer.encode_batch_fast([t for _, t in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, self.dtype)
            if len(who) == 1:
                out[who[0]] = ids
                continue
            reach = np.cumsum(self.width[ids])
            ends = np.cumsum([len(pieces[k]) for k in who])
            stops = np.searchsorted(reach, ends) + 1
            if len(reach) < stops[-1] or (reach[stops - 1] != ends).any():
                raise ValueError("ids of pieces that were encoded together can't be told apart")
            for k, part in zip(who, np.split(ids, stops[:-1]), strict=True):
                out[k] = part
        return out


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and file, while its tasks encode."""
    return held(f"encoder {path}", lambda: Encoder(path))
