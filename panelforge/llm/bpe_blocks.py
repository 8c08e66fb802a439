"""Byte-level BPE of blocks of texts as arrays.

Pre-tokens are cut by the kinds of bytes, in one pass over the bytes of all texts of a block. Each is looked up by its own
bytes in a table of those met lately; the new ones go through the automaton of `bpe` side by side. Words with letters beyond
Latin-1, apostrophes or control characters are looked up whole; they, very long pre-tokens and texts with other white space
or added tokens are encoded by `bpe.Encoder`, to the same ids.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

from panelforge.llm import bpe
from panelforge.llm.shared import BLOCK_BYTES, kept

#: Bytes of a key, the logarithm of the table's slots (a key has one), and the ids that the table can point to before it is emptied.
KEY_BYTES, SLOT_BITS, POOL_IDS = 24, 21, 1 << 23
WHITE, LETTER, DIGIT, SIGN, OTHER = range(5)
#: What no cutting by bytes is right for: a zero, with which keys are filled up, and white space beyond ASCII.
STRANGE = re.compile(rb"\0|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


def kinds_of_bytes() -> np.ndarray:
    kind = np.full(256, OTHER, np.uint8)
    for byte in range(128):
        c = chr(byte)
        kind[byte] = WHITE if c in "\t\n\v\f\r " else LETTER if c.isalpha() else DIGIT if c.isdigit() else SIGN if c.isprintable() and c != "'" else OTHER
    return kind


KINDS = kinds_of_bytes()
#: By length: the bytes of a key that belong to it.
BELONGS = np.array([[255] * n + [0] * (KEY_BYTES - n) for n in range(KEY_BYTES + 1)], np.uint8).view("<u8")


def byte_kinds(flat: np.ndarray) -> np.ndarray:
    """The kind of each byte of UTF-8 text; both bytes of the letters from U+00C0 to U+00FF are letters."""
    kind = KINDS[flat]
    lead = np.flatnonzero(flat == 0xC3)
    second = flat[lead + 1]
    lead = lead[(second != 0x97) & (second != 0xB7)]  # multiplication and division sign
    kind[lead] = kind[lead + 1] = LETTER
    return kind


def token_starts(flat: np.ndarray, kind: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin, texts beginning at `begins`. A word with a byte of kind OTHER becomes one, and its bytes that kind."""
    n = len(flat)
    edge, white = np.zeros(n + 1, bool), kind == WHITE
    edge[begins] = edge[n] = True
    other = np.flatnonzero(kind == OTHER)
    if len(other):
        first = np.flatnonzero(~white & (np.r_[True, white[:-1]] | edge[:-1]))
        end = np.flatnonzero(~white & (np.r_[white[1:], True] | edge[1:])) + 1
        word = np.unique(np.searchsorted(first, other, "right") - 1)
        step = np.zeros(n + 1, np.int8)
        step[first[word]] += 1
        step[end[word]] -= 1
        kind[np.cumsum(step[:-1], dtype=np.int8) > 0] = OTHER
    start = edge[:-1].copy()
    inner = ~edge[1:-1]
    start[1:] |= (kind[1:] != kind[:-1]) & (white[1:] | (flat[:-1] != 32))  # the space before a word belongs to it
    start[1:-1] |= white[:-2] & white[1:-1] & ~white[2:] & inner[1:]  # of white space before a word the last character stands apart
    return np.flatnonzero(start)


def mix(key: np.ndarray) -> np.ndarray:
    """A number of each key, whose upper bits are its slot; keys that share one are told apart by their bytes."""
    mixed = key[:, 0] * np.uint64(0x9E3779B97F4A7C15) + key[:, 1] * np.uint64(0xC2B2AE3D27D4EB4F) + key[:, 2] * np.uint64(0x165667B19E3779F9)
    mixed ^= mixed >> np.uint64(32)
    return mixed * np.uint64(0xD6E8FEB86659FD93)


class Blocks:
    """Ids of blocks of texts, with the table of the pre-tokens met lately."""

    def __init__(self, encoder: bpe.Encoder):
        self.encoder = encoder
        self.side = encoder.side = encoder.side or bpe.SideBySide(encoder.merges)
        self.added = [s.encode() for s in encoder.merges.added]
        self.key = np.zeros((1 << SLOT_BITS, KEY_BYTES // 8), np.uint64)  # no pre-token is all zeros
        self.first, self.count = np.zeros(1 << SLOT_BITS, np.int32), np.zeros(1 << SLOT_BITS, np.uint8)
        self.pool, self.used = np.zeros(POOL_IDS, "<u4"), 0

    def _strange(self, flat: np.ndarray, ends: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Which texts are not to be cut by bytes."""
        data, at = flat.tobytes(), []
        other = kind == OTHER
        if other.any():
            at += [m.start() for m in STRANGE.finditer(data)]
            within = np.diff(np.append(0, np.cumsum(other))[ends])
            at += ends[:-1][within * 4 > np.diff(ends)].tolist()  # other scripts: words of them gain nothing here
        for s in self.added:
            i = data.find(s)
            while i >= 0:
                at.append(i)
                i = data.find(s, i + 1)
        return np.unique(np.searchsorted(ends, np.array(at, np.int64), "right") - 1)

    def each(self, flat: np.ndarray, ends: np.ndarray) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text; `flat` holds the UTF-8 bytes of all of them, `ends` their offsets from 0."""
        if len(flat) > BLOCK_BYTES:
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
                if b - a > BLOCK_BYTES:
                    yield self.encoder.packed(flat[a:b].tobytes().decode())
                else:
                    yield from self.each(flat[a:b], np.array([0, b - a]))
            return
        kind = byte_kinds(flat)
        strange = self._strange(flat, ends, kind)
        apart: dict[int, bytes] = {}
        if len(strange):
            texts = [flat[ends[i] : ends[i + 1]].tobytes().decode() for i in strange.tolist()]
            apart = dict(zip(strange.tolist(), self.encoder.each(texts)))
            size = np.diff(ends)
            stays = np.repeat(~np.isin(np.arange(len(size)), strange), size)
            size[strange] = 0
            flat, kind, ends = flat[stays], kind[stays], np.r_[0, np.cumsum(size)]
        ids, ends = self._ids(flat, ends, kind)
        raw, ends = ids.tobytes(), ends.tolist()
        for i in range(len(ends) - 1):
            yield apart[i] if i in apart else raw[4 * ends[i] : 4 * ends[i + 1]]

    def _ids(self, flat: np.ndarray, ends: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and the offsets of each text's."""
        n = len(flat)
        if not n:
            return np.zeros(0, "<u4"), np.zeros(len(ends), np.int64)
        if self.used + n > len(self.pool):  # a pre-token has no more ids than bytes
            self.key[:], self.used = 0, 0
            self.pool = self.pool if n <= len(self.pool) else np.zeros(n, "<u4")
        at = token_starts(flat, kind, ends[:-1][np.diff(ends) > 0])
        size = np.diff(np.append(at, n))
        filled = np.zeros(n + KEY_BYTES, np.uint8)
        filled[:n] = flat
        key = np.ndarray((n,), f"V{KEY_BYTES}", filled, 0, (1,))[at].view("<u8").reshape(len(at), -1) & BELONGS[np.minimum(size, KEY_BYTES)]
        mixed = mix(key)
        slot = (mixed >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        held = self.key[slot]
        new = np.flatnonzero((held[:, 0] != key[:, 0]) | (held[:, 1] != key[:, 1]) | (held[:, 2] != key[:, 2]) | (size > KEY_BYTES))
        first, count = self.first[slot].astype(np.int64), self.count[slot].astype(np.int64)
        alone = (size[new] > KEY_BYTES) | (kind[at[new] + size[new] - 1] == OTHER)
        self._whole(flat, at, size, key, slot, new[alone], first, count)
        new = new[~alone]
        while len(new):
            _, one, of = np.unique(mixed[new], return_index=True, return_inverse=True)
            once = new[one]
            found, start, many = self.side.rows(key[once].view(np.uint8), size[once])
            start += self._append(found)
            self._keep(slot[once], key[once], start, many)
            same = (key[once][of] == key[new]).all(axis=1)  # others only share the number: they come next
            first[new[same]], count[new[same]] = start[of[same]], many[of[same]]
            new = new[~same]
        total = np.cumsum(count)
        ids = self.pool[np.repeat(first - total + count, count) + np.arange(total[-1])]
        return ids, np.r_[0, total][np.searchsorted(at, ends)]

    def _whole(self, flat: np.ndarray, at: np.ndarray, size: np.ndarray, key: np.ndarray, slot: np.ndarray, new: np.ndarray, first: np.ndarray, count: np.ndarray) -> None:
        """The ids of new words that the encoder takes whole."""
        met: dict[str, list[int]] = {}
        for i, a, n in zip(new.tolist(), at[new].tolist(), size[new].tolist()):
            met.setdefault(flat[a : a + n].tobytes().decode(), []).append(i)
        for where, ids in zip(met.values(), self.encoder.each(met)):
            start, many = self._append(np.frombuffer(ids, "<u4")), len(ids) // 4
            first[where], count[where] = start, many
            if size[where[0]] <= KEY_BYTES:
                self._keep(slot[where[0]], key[where[0]], start, many)

    def _append(self, ids: np.ndarray) -> int:
        start = self.used
        self.used += len(ids)
        self.pool[start : self.used] = ids
        return start

    def _keep(self, slot, key, first, count) -> None:
        self.key[slot], self.first[slot], self.count[slot] = key, first, count


def blocks(key: str, tokenizer_json: str) -> Blocks:
    """The encoder of a vocabulary for blocks, built once in each Python worker."""
    return kept(f"blocks {key}", lambda: Blocks(bpe.Encoder(bpe.Merges(tokenizer_json))))
