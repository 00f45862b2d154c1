"""Token ids of texts by the `tokenizers` library, with the ids of words kept per worker.

A byte-level tokenizer cuts texts by a pattern of which no match goes on over a space that a character other than white
space follows: the space begins the next match. So the parts between such spaces, each with its space, are encoded alone
and give the same ids as the whole. Parts recur. All parts of a batch are found, and looked up in a table of those seen
before, by array operations; a part of LONGEST bytes at most is its own key, so a hit is exact. Only the others go through
the library, each once a batch, and are kept then.

The table has two generations of KEPT parts at most: when the young one is full, it becomes the old one, and the former
old one goes; a part found in the old one alone is put into the young one again. So memory is bounded by bytes, whatever
the corpus, and what recurs stays. Other kinds of tokenizer encode whole texts.
"""

from __future__ import annotations

import json
import os

import numpy as np

from .common import mix, ranges

END_ID = 2
#: Parts of a generation; a part takes some 80 bytes.
KEPT = 3 << 18
#: Bytes of a part that is kept: four words of 8 bytes, of which the last byte is the length.
LONGEST = 31
#: Parts and bytes of them that are encoded at once. Longer strings cost the library more for each byte.
RUN, RUN_BYTES = 500, 1 << 13
#: How a byte-level vocabulary writes a space.
SPACE = "Ġ"
_KEY = 4
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
#: Masks that leave the first 0 to 8 bytes of a little-endian word.
_FIRST = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
_BLANK = np.zeros(256, bool)
_BLANK[[*range(9, 14), *range(28, 33)]] = True
#: First bytes of white space beyond ASCII.
_WIDE = np.zeros(256, bool)
_WIDE[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_ENCODERS: dict[str, Encoder] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class _Table:
    """Parts' keys and their ids: open addressing, all steps for many parts at once."""

    def __init__(self, kind: type, kept: int):
        self.kept = kept
        self.bits = max(4, (4 * kept // 3 - 1).bit_length())  # three quarters full at most
        self._keys = np.zeros((1 << self.bits, _KEY), np.uint64)
        self._number = np.zeros(1 << self.bits, np.int32)  # 0: free
        self.n, self.used = 1, 0
        self.at, self.length = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.pool = np.zeros(1 << 14, kind)

    def find(self, keys: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The number of each key, 0 for none."""
        mask, out = (1 << self.bits) - 1, np.zeros(len(keys), np.int32)
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        rest: np.ndarray | None = None  # all, at first
        while len(slot):
            number = self._number[slot]
            own = keys if rest is None else keys[rest]
            hit = (self._keys[slot] == own).all(axis=1) & (number > 0)
            if rest is None:
                out[hit] = number[hit]
            else:
                out[rest[hit]] = number[hit]
            on = np.flatnonzero(~hit & (number > 0))
            rest = on if rest is None else rest[on]
            slot = (slot[on] + 1) & mask
        return out

    def add(self, keys: np.ndarray, h: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Put in distinct keys that are not there, with their joined ids; their numbers."""
        numbers = self.place(ids, lengths)
        mask, rest = (1 << self.bits) - 1, np.arange(len(keys))
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(rest):
            free = self._number[slot] == 0
            self._number[slot[free]] = numbers[rest[free]]  # of several for one slot, one stays
            won = free & (self._number[slot] == numbers[rest])
            self._keys[slot[won]] = keys[rest[won]]
            rest, slot = rest[~won], (slot[~won] + 1) & mask
        self.n, self.used = self.n + len(keys), self.used + len(ids)
        return numbers

    def place(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Numbers for joined ids behind what is kept; what comes next overwrites them."""
        numbers = np.arange(self.n, self.n + len(lengths))
        while len(self.at) < self.n + len(lengths):
            self.at, self.length = (np.concatenate((x, np.zeros_like(x))) for x in (self.at, self.length))
        while len(self.pool) < self.used + len(ids):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        self.pool[self.used : self.used + len(ids)] = ids
        self.at[numbers] = self.used + np.cumsum(lengths) - lengths
        self.length[numbers] = lengths
        return numbers

    def ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Joined ids of numbers, and how many each has."""
        lengths = self.length[numbers]
        return self.pool[ranges(self.at[numbers], lengths)], lengths


class Encoder:
    """encode(texts): all their ids joined, and the end of each text in them, without end ids."""

    def __init__(self, path: str, kept: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        cut = spec.get("pre_tokenizer") or {}
        plain = not any(" " in t["content"] or t.get("lstrip") or t.get("rstrip") for t in spec.get("added_tokens") or ())
        self._parts = plain and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not spec.get("normalizer") and not spec.get("truncation")
        self.vocabulary = self._tokenizer.get_vocab_size()
        self.kind = np.uint16 if self.vocabulary <= 1 << 16 else np.uint32
        self._spaced = np.zeros(self.vocabulary, bool)  # ids of tokens that begin with a space
        for token, i in self._tokenizer.get_vocab().items():
            self._spaced[i] = token.startswith(SPACE)
        self._kept = kept or KEPT
        self._young, self._old = _Table(self.kind, self._kept), None

    def _each(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _spaced_parts(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Joined ids of parts of data with the space before each, and how many each has: long runs are encoded, in which ids that begin with a space tell where a part starts."""
        out, counts = [np.zeros(0, self.kind)], [np.zeros(0, np.int64)]
        text = data[ranges(starts - 1, lengths + 1)].tobytes()
        at = np.append(0, np.cumsum(lengths + 1))
        lo = 0
        while lo < len(starts):
            room = int(np.searchsorted(at, at[lo] + RUN_BYTES, side="right")) - 1
            hi = min(len(starts), lo + RUN, max(lo + 1, room))
            ids = self._each([text[at[lo] : at[hi]].decode()])[0]
            first = np.flatnonzero(self._spaced[ids])
            if len(first) == hi - lo and not first[0]:
                out.append(ids)
                counts.append(np.diff(np.append(first, len(ids))))
            else:  # not a vocabulary as expected
                each = self._each([text[at[i] : at[i + 1]].decode() for i in range(lo, hi)])
                out += each
                counts.append(np.array([len(e) for e in each], np.int64))
            lo = hi
        return np.concatenate(out), np.concatenate(counts)

    def _known(self, keys: np.ndarray, h: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Numbers in the young table for keys of parts of data, after putting in those that are not there."""
        numbers = self._young.find(keys, h)
        lost = np.flatnonzero(numbers == 0)
        if not len(lost):
            return numbers
        _, one, which = np.unique(h[lost], return_index=True, return_inverse=True)
        if not (keys[lost] == keys[lost][one][which]).all():  # two parts of one hash
            _, one, which = np.unique(keys[lost], axis=0, return_index=True, return_inverse=True)
        new = lost[one]
        if self._young.n + len(new) > self._young.kept:
            if self._young.n > 1:
                self._old = self._young
            self._young = _Table(self.kind, max(self._kept, len(new) + 1))
            return self._known(keys, h, data, starts, lengths)
        had = self._old.find(keys[new], h[new]) if self._old else np.zeros(len(new), np.int32)
        again, rest = np.flatnonzero(had), np.flatnonzero(had == 0)
        own = np.zeros(len(new), np.int32)
        if len(again):
            own[again] = self._young.add(keys[new[again]], h[new[again]], *self._old.ids(had[again]))
        if len(rest):
            at = new[rest]
            own[rest] = self._young.add(keys[at], h[at], *self._spaced_parts(data, starts[at], lengths[at]))
        numbers[lost] = own[which.ravel()]
        return numbers

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """texts in UTF-8."""
        if not texts:
            return np.zeros(0, self.kind), np.zeros(0, np.int64)
        if not self._parts:
            each = self._each([t.decode() for t in texts])
            return np.concatenate([np.zeros(0, self.kind), *each]), np.cumsum([len(x) for x in each], dtype=np.int64)
        joined = b" ".join(texts)
        n = len(joined)
        data = np.frombuffer(joined + bytes(8 * _KEY), np.uint8)
        spaces = np.flatnonzero(data[:n] == 32)
        starts, ends = np.append(0, spaces + 1), np.append(spaces, n)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        first = np.searchsorted(starts, np.cumsum(sizes + 1) - sizes - 1)
        whole = np.zeros(len(starts), bool)  # strings of their own: texts' first parts, and parts with spaces in them
        whole[first] = True
        goes_on = (_blank(data, starts) | (starts == ends)) & ~whole  # its space is not a cut
        if goes_on.any():
            keep = np.flatnonzero(~goes_on)
            first = np.searchsorted(keep, first)
            last = np.append(keep[1:], len(starts)) - 1  # of what a part is joined from
            whole = whole[keep] | (last > keep)
            starts, ends = starts[keep], ends[last]
        lengths = ends - starts
        numbers = np.zeros(len(starts), np.int64)
        short = np.flatnonzero(~whole & (lengths <= LONGEST))
        keys = _keys(data, starts[short], lengths[short])
        h = mix(keys @ _FACTORS)
        numbers[short] = self._known(keys, h, data, starts[short], lengths[short])
        # what is not kept goes behind the table, for this gather alone
        long, apart = np.flatnonzero(~whole & (lengths > LONGEST)), np.flatnonzero(whole)
        a, n_a = self._spaced_parts(data, starts[long], lengths[long])
        back = np.ones(len(starts), np.int64)  # a text's first part has no space before it
        back[first] = 0
        strings = [joined[x:y] for x, y in zip((starts - back)[apart].tolist(), ends[apart].tolist(), strict=True)]
        number = {s: i for i, s in enumerate(dict.fromkeys(strings))}
        b = self._each([s.decode() for s in number])
        extra = self._young.place(np.concatenate((a, *b)), np.concatenate((n_a, np.array([len(x) for x in b], np.int64))))
        numbers[long], numbers[apart] = extra[: len(long)], extra[[len(long) + number[s] for s in strings]]
        ids, counts = self._young.ids(numbers)
        return ids, np.cumsum(counts)[np.append(first[1:], len(starts)) - 1]


def _blank(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether white space, or what some tables take for it, begins at each place."""
    out = _BLANK[data[at]]
    wide = np.flatnonzero(_WIDE[data[at]])
    if len(wide):
        a, b, c = (data[at[wide] + i] for i in range(3))
        general = (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F)
        out[wide] = (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & ((b == 0x9A) & (c == 0x80) | (b == 0xA0) & (c == 0x8E)) | (a == 0xE2) & general | (a == 0xE3) & (b == 0x80) & (c == 0x80)
    return out


def _keys(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The bytes of parts of LONGEST at most, with zeros behind, and their lengths as the last byte."""
    words = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    out = np.empty((len(starts), _KEY), np.uint64)
    for j in range(_KEY):
        out[:, j] = words[starts + 8 * j] & _FIRST[np.clip(lengths - 8 * j, 0, 8)]
    out[:, -1] |= lengths.astype(np.uint64) << np.uint64(56)
    return out


def encoder(path: str) -> Encoder:
    """This worker's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encoded(texts: list[bytes], enc: Encoder, end_id: int) -> list[bytes]:
    """The ids of each text with the end id, as little-endian unsigned 32-bit integers."""
    ids, ends = enc.encode(texts)
    end = np.array([end_id], "<u4").tobytes()
    data, ends = ids.astype("<u4").tobytes(), (4 * ends).tolist()
    return [data[a:b] + end for a, b in zip([0, *ends], ends, strict=False)]
