"""Byte-level BPE as a bounded-lookahead streaming transducer, and its decoder.

A pre-token is read byte by byte by an automaton over the vocabulary that knows all tokens ending at the
byte. After n bytes the last token of the encoding of that prefix is unique: it is the token ending at n
whose left neighbour (the last token of the shorter prefix) it can stand beside without the merge list
joining across the boundary. `Merges.lookahead`, the longest token of the merge list in bytes, is the
sufficient lookahead: whatever follows, the next token starts within the last `lookahead` bytes, so a token
is final once the chains of all those positions pass through its end. Final tokens are emitted and
forgotten, so memory grows neither with a pre-token nor with the text. Every pre-token takes this path;
ids of short ones met lately are kept, a bounded number of them. Short ones that a block of texts brings
anew go through the automaton side by side (`SideBySide`): the same steps, a byte of all of them at a time.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from panelforge.llm.shared import id_and_text, kept, sliced

#: The pre-token pattern of byte-level BPE with contractions, and Unicode white space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WHITE = "\t-\r \x85\xa0  -     　"
#: A unit is a run without white space, with the space before it, or white space: no pre-token crosses units.
UNITS = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
#: Units that are one word of Latin letters and then signs, as the pre-token pattern cuts them too.
SIMPLE = re.compile(r"( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@[-`{-~]*)")
#: Units and pre-tokens kept with their ids in a Python worker; twice as many at most. Longer ones are not kept.
CACHE_UNITS, CACHE_CHARS = 700_000, 64
#: Characters of a text whose units are cut at once, and ids that go on together.
STEP_CHARS = 1 << 16
#: Bytes of a pre-token between two looks for final tokens.
LOOK_EVERY = 4096
NEVER = 1 << 60
#: Pairs of tokens and steps of the automaton that a worker remembers.
KNOWN = 1_000_000
#: Pre-tokens that go through the automaton side by side, and the logarithm of the slots for steps and for pairs of tokens.
TOGETHER, SLOT_BITS = 8192, 20


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """A merge list with what the transducer needs of it."""

    def __init__(self, tokenizer_json: str):
        spec = json.loads(tokenizer_json)
        letters = byte_letters()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        vocab = spec["model"]["vocab"]
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.ids = {as_bytes(s): i for s, i in vocab.items() if s not in added}
        self.bytes_of = {i: b for b, i in self.ids.items()} | {i: s.encode() for s, i in added.items()}
        self.added = added
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.made: dict[int, int] = {}
        for r, m in enumerate(spec["model"]["merges"]):
            left, right = m.split(" ") if isinstance(m, str) else m
            a, b = vocab[left], vocab[right]
            whole = vocab[left + right]
            self.rank[a, b] = r
            if whole not in self.made:
                self.parts[whole], self.made[whole] = (a, b), r
        self.lookahead = max(map(len, self.ids))
        self.beside: dict[tuple[int, int], bool] = {}
        self._automaton()

    def _automaton(self) -> None:
        """Aho-Corasick automaton of the tokens: go[state << 8 | byte] is the next state where the trie has one, else fail[state] goes on; ends[state]: (token, bytes) of the tokens that end here, longest first."""
        self.go: dict[int, int] = {}
        text_of, self.ends = [b""], [()]
        for text in sorted(self.ids, key=len):
            state = 0
            for i, byte in enumerate(text):
                key = state << 8 | byte
                state = self.go.get(key, 0)
                if not state:
                    state = self.go[key] = len(text_of)
                    text_of.append(text[: i + 1])
                    self.ends.append(())
            self.ends[state] = ((self.ids[text], len(text)),)
        self.fail = [0] * len(text_of)
        go, fail = self.go, self.fail
        parents = sorted(((len(text_of[state]), key >> 8, key & 255, state) for key, state in go.items()))
        for size, parent, byte, state in parents:
            if size > 1:
                at = fail[parent]
                while at and (at << 8 | byte) not in go:
                    at = fail[at]
                fail[state] = go.get(at << 8 | byte, 0)
            self.ends[state] += self.ends[fail[state]]
        self.trie, self.go = self.go, dict(self.go)
        self.remembered = len(go) + KNOWN

    def can_stand_beside(self, left: int, right: int) -> bool:
        """Whether the merges that make the two tokens never join across their boundary: both spines are undone, latest merge first."""
        known = self.beside.get((left, right))
        if known is not None:
            return known
        a, b, a_gone, b_gone, fits = left, right, NEVER, NEVER, True
        while True:
            r = self.rank.get((a, b), NEVER)
            if r < a_gone and r <= b_gone and r < NEVER:
                fits = False
                break
            a_made, b_made = self.made.get(a, -1), self.made.get(b, -1)
            if a_made < 0 and b_made < 0:
                break
            if a_made > b_made:
                a, a_gone = self.parts[a][1], a_made
            else:
                b, b_gone = self.parts[b][0], b_made
        if len(self.beside) > KNOWN:
            self.beside.clear()
        self.beside[left, right] = fits
        return fits

    def stream(self, text: bytes) -> Iterator[list[int]]:
        """Ids of one pre-token, as they become final."""
        go, fail, ends, beside, fits = self.go, self.fail, self.ends, self.beside, self.can_stand_beside
        look = LOOK_EVERY + self.lookahead
        state, n, last, span = 0, 0, [-1], [0]  # last[i]: last token of the prefix i bytes after what is emitted; span: its bytes
        for byte in text:
            n += 1
            key = state << 8 | byte
            state = go.get(key)
            if state is None:
                at = key >> 8
                while state is None:  # every single byte is a token, so the root has a step
                    at = fail[at]
                    state = go.get(at << 8 | byte)
                if len(go) < self.remembered:
                    go[key] = state
            for token, size in ends[state]:
                if size > n:
                    continue
                before = last[n - size]
                if before < 0:
                    if n != size:
                        continue
                else:
                    ok = beside.get((before, token))
                    if not (fits(before, token) if ok is None else ok):
                        continue
                last.append(token)
                span.append(size)
                break
            if n >= look:
                out: list[int] = []
                n -= self._emit_final(out, last, span)
                yield out
        out = []
        self._walk(out, last, span, len(last) - 1)
        yield out

    def transduce(self, text: bytes) -> list[int]:
        """Ids of one pre-token."""
        return [i for part in self.stream(text) for i in part]

    def _walk(self, out: list[int], last: list[int], span: list[int], at: int) -> None:
        chain = []
        while at > 0:
            chain.append(last[at])
            at -= span[at]
        out.extend(reversed(chain))

    def _emit_final(self, out: list[int], last: list[int], span: list[int]) -> int:
        """Emit the tokens on which the chains of the last `lookahead` positions agree, and how many bytes they are; the last emitted one stays as position 0."""
        live = set(range(max(0, len(last) - self.lookahead), len(last)))
        while len(live) > 1:
            top = max(live)
            live.remove(top)
            live.add(top - span[top])
        cut = live.pop()
        if cut <= 0:
            return 0
        self._walk(out, last, span, cut)
        kept = last[cut]
        del last[:cut], span[:cut]
        last[0], span[0] = kept, 0
        return cut


class Remembered:
    """A function of keys under 2^43 with values under 2^20 over arrays; keys met lately are remembered, one a slot."""

    def __init__(self, f: Callable[[np.ndarray], np.ndarray]):
        self.f, self.held = f, np.full(1 << SLOT_BITS, -1, np.int64)

    def __call__(self, key: np.ndarray) -> np.ndarray:
        slot = (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOT_BITS)).view(np.int64)
        held = self.held[slot]
        new = np.flatnonzero(held >> 20 != key)
        if len(new):
            once, of = np.unique(key[new], return_inverse=True)
            held[new] = once[of] << 20 | self.f(once)[of]
            self.held[slot[new]] = held[new]
        return held & ((1 << 20) - 1)


class SideBySide:
    """The transducer over many short pre-tokens at once, as arrays: one step takes the next byte of all of them."""

    def __init__(self, merges: Merges):
        keys = np.fromiter(merges.trie, np.int64, len(merges.trie))
        order = np.argsort(keys)
        self.keys, self.to = keys[order], np.fromiter(merges.trie.values(), np.int64, len(keys))[order]
        self.fail = np.array(merges.fail, np.int64)
        self.root = np.zeros(256, np.int64)
        self.root[keys[keys < 256]] = [merges.trie[k] for k in keys[keys < 256].tolist()]
        counts = np.fromiter(map(len, merges.ends), np.int64, len(merges.ends))
        self.first = np.cumsum(counts) - counts
        ends = np.array([e for some in merges.ends for e in some], np.int32)
        self.token, self.size = ends[:, 0].copy(), ends[:, 1].copy()
        self.top = max(merges.bytes_of) + 1
        pairs = np.array([a * self.top + b for a, b in merges.rank], np.int64)
        order = np.argsort(pairs)
        self.pairs = np.append(pairs[order], np.iinfo(np.int64).max)
        self.rank = np.append(np.fromiter(merges.rank.values(), np.int64, len(pairs))[order], NEVER)
        self.made = np.full(self.top, -1, np.int64)
        self.left, self.right = np.zeros(self.top, np.int64), np.zeros(self.top, np.int64)
        for token, r in merges.made.items():
            self.made[token], (self.left[token], self.right[token]) = r, merges.parts[token]
        if len(self.fail) >> 20:
            raise ValueError("the automaton has too many states")
        self.step, self.beside = Remembered(self._step), Remembered(self._undone)

    def _step(self, key: np.ndarray) -> np.ndarray:
        """The next state of each state << 8 | byte, by the trie or over `fail`."""
        state, byte = key >> 8, key & 255
        out = self.root[byte]
        todo = np.flatnonzero(state)
        state, byte = state[todo], byte[todo]
        while len(todo):
            key = state << 8 | byte
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[at] == key
            out[todo[found]] = self.to[at[found]]
            todo, byte, state = todo[~found], byte[~found], self.fail[state[~found]]
            deep = state > 0  # at the root `out` is right already
            todo, byte, state = todo[deep], byte[deep], state[deep]
        return out

    def _undone(self, pair: np.ndarray) -> np.ndarray:
        """Merges.can_stand_beside of each left * top + right."""
        a, b = pair // self.top, pair % self.top
        fits, at = np.ones(len(a), np.int64), np.arange(len(a))
        a_gone, b_gone = np.full(len(a), NEVER), np.full(len(a), NEVER)
        while len(at):
            pair = a * self.top + b
            i = np.searchsorted(self.pairs, pair)
            r = np.where(self.pairs[i] == pair, self.rank[i], NEVER)
            joined = (r < a_gone) & (r <= b_gone) & (r < NEVER)
            fits[at[joined]] = 0
            a_made, b_made = self.made[a], self.made[b]
            on = ~joined & ((a_made >= 0) | (b_made >= 0))
            of_a = a_made > b_made
            a, a_gone = np.where(of_a, self.right[a], a)[on], np.where(of_a, a_made, a_gone)[on]
            b, b_gone = np.where(of_a, b, self.left[b])[on], np.where(of_a, b_gone, b_made)[on]
            at = at[on]
        return fits

    def packed(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each pre-token, none of them empty."""
        out = [b""] * len(texts)
        order = sorted(range(len(texts)), key=lambda i: len(texts[i]), reverse=True)
        for a in range(0, len(order), TOGETHER):
            some = order[a : a + TOGETHER]
            width, length = len(texts[some[0]]), np.array([len(texts[i]) for i in some])
            ids, count = self._together(np.frombuffer(b"".join([texts[i].ljust(width, b"\0") for i in some]), np.uint8).reshape(len(some), width), length)
            raw, ends = ids.tobytes(), np.cumsum(count).tolist()
            for i, end, n in zip(some, ends, count.tolist()):
                out[i] = raw[4 * (end - n) : 4 * end]
        return out

    def rows(self, text: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first, count): row i of `text`, its first length[i] bytes, has the ids from first[i] on, count[i] of them."""
        order = np.argsort(-length, kind="stable")
        parts, first, count, n = [], np.zeros(len(length), np.int64), np.zeros(len(length), np.int64), 0
        for a in range(0, len(order), TOGETHER):
            some = order[a : a + TOGETHER]
            ids, many = self._together(text[some], length[some])
            first[some], count[some] = n + np.cumsum(many) - many, many
            parts.append(ids)
            n += len(ids)
        return np.concatenate(parts) if parts else np.zeros(0, "<u4"), first, count

    def _together(self, text: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after the other, and how many each has; lengths descend."""
        n, width = len(length), int(length[0])
        flat = np.ascontiguousarray(text[:, :width].T).astype(np.int64)
        last, span = np.full((width + 1, n), -1, np.int32), np.zeros((width + 1, n), np.int32)
        flat_last = last.reshape(-1)
        state = np.zeros(n, np.int64)
        for i in range(width):
            live = int(np.searchsorted(-length, -i, "left"))  # those with a byte at i
            state = self.step(state[:live] << 8 | flat[i, :live])
            row, at = np.arange(live), self.first[state]
            while len(row):
                token, size = self.token[at], self.size[at]
                before = flat_last[np.maximum(i + 1 - size, 0) * n + row]
                ok = size == i + 1
                inner = np.flatnonzero(size <= i)
                ok[inner] = self.beside(before[inner].astype(np.int64) * self.top + token[inner]) > 0
                done = row[ok]
                last[i + 1, done], span[i + 1, done] = token[ok], size[ok]
                row, at = row[~ok], at[~ok] + 1
        ids = np.zeros((n, width), "<u4")
        row, at, count = np.arange(n), length.copy(), np.zeros(n, np.int64)
        while len(row):
            count[row] += 1
            ids[row, width - count[row]] = last[at, row]
            at = at - span[at, row]
            row, at = row[at > 0], at[at > 0]
        return ids[np.arange(width) >= (width - count)[:, None]], count


class Recent(dict):
    """A map that keeps what was met since it last filled up twice: memory is bounded, frequent keys stay."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.older = most, {}

    def turn(self) -> None:
        self.older = dict(self)
        self.clear()


class Encoder:
    """Ids of whole texts, unit by unit; short units and pre-tokens met lately are kept with their ids."""

    def __init__(self, merges: Merges):
        self.merges, self.units = merges, Recent(CACHE_UNITS)
        self.side: SideBySide | None = None
        self.split = regex.compile(PATTERN)
        self.added = re.compile("(" + "|".join(re.escape(s) for s in sorted(merges.added, key=len, reverse=True)) + ")") if merges.added else None

    def _pieces(self, unit: str) -> list[str]:
        plain = SIMPLE.fullmatch(unit)
        return [p for p in plain.groups() if p] if plain else self.split.findall(unit)

    def each(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids of each text, as `packed` gives them. What a block of texts brings anew goes through the automaton side by side."""
        texts = list(texts)
        cut = [UNITS.findall(t) if len(t) <= STEP_CHARS and (self.added is None or not self.added.search(t)) else None for t in texts]
        units, unit = self.units, self._unit
        known = [[] if some is None else list(map(units.get, some)) for some in cut]
        met = {u for some, ids in zip(cut, known) if None in ids for u, x in zip(some, ids) if x is None}
        pieces = {p for u in met if len(u) <= CACHE_CHARS and u not in units.older for p in self._pieces(u)}
        self._learn([p for p in pieces if p not in units and p not in units.older])
        for text, some, ids in zip(texts, cut, known):
            yield self.packed(text) if some is None else b"".join([x or units.get(u) or unit(u) for u, x in zip(some, ids)])

    def _learn(self, new: list[str]) -> None:
        if self.side is None:
            self.side = SideBySide(self.merges)
        units = self.units
        if len(units) + len(new) > units.most:
            units.turn()
        if len(new) < units.most:
            units.update(zip(new, self.side.packed([p.encode() for p in new])))

    def _unit(self, unit: str) -> bytes:
        """Ids of a unit. A pre-token is a unit too, so both are kept in one map."""
        units = self.units
        known = units.older.get(unit)
        if known is None:
            pieces = self._pieces(unit)
            if len(pieces) > 1:
                known = b"".join([units.get(p) or self._unit(p) for p in pieces])
            else:
                ids = self.merges.transduce(unit.encode())
                known = struct.pack(f"<{len(ids)}I", *ids)
        if len(unit) <= CACHE_CHARS:
            if len(units) >= units.most:
                units.turn()
            units[unit] = known
        return known

    def pieces(self, text: str) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of the text, a bounded number at a time."""
        if self.added is not None and any(s in text for s in self.merges.added):
            for s in self.added.split(text):
                if s in self.merges.added:
                    yield np.array([self.merges.added[s]], "<u4").tobytes()
                elif s:
                    yield from self._plain(s)
        else:
            yield from self._plain(text)

    def _plain(self, text: str) -> Iterator[bytes]:
        """Units of STEP_CHARS characters at a time; the last one may be cut, so the next step begins with it. A longer unit goes pre-token by pre-token, each as its tokens become final."""
        known, unit, at, n = self.units.get, self._unit, 0, len(text)
        while at < n:
            end = at + STEP_CHARS
            units = UNITS.findall(text, at, end)
            if end < n:
                if len(units) == 1:
                    whole = UNITS.match(text, at).group()
                    for p in self.split.finditer(whole):
                        for ids in self.merges.stream(p.group().encode()):
                            yield struct.pack(f"<{len(ids)}I", *ids)
                    at += len(whole)
                    continue
                end -= len(units.pop())
            yield b"".join([known(u) or unit(u) for u in units])
            at = end

    def packed(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of the text."""
        return b"".join(self.pieces(text))

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.packed(text), "<u4")


class Decoder:
    """Ids back to text: bytes of each token go through an incremental UTF-8 state machine, ill-formed sequences become U+FFFD."""

    def __init__(self, merges: Merges):
        top = max(merges.bytes_of) + 1
        self.table = np.array([merges.bytes_of.get(i, b"") for i in range(top)], dtype=object)

    def pieces(self, parts: Iterable[np.ndarray]) -> Iterator[str]:
        """Text of ids that come in parts."""
        state = codecs.getincrementaldecoder("utf-8")("replace")
        for ids in parts:
            yield state.decode(b"".join(self.table[ids].tolist()))
        yield state.decode(b"", final=True)

    def text(self, ids: np.ndarray) -> str:
        return "".join(self.pieces([ids]))


def coders(key: str, tokenizer_json: str) -> tuple[Encoder, Decoder, np.ndarray]:
    """The coders of a vocabulary, built once in each Python worker; decimal: the ids as text."""

    def build():
        merges = Merges(tokenizer_json)
        decoder = Decoder(merges)
        return Encoder(merges), decoder, np.array([str(i) for i in range(len(decoder.table))], dtype=object)

    return kept(key, build)


def vocabulary(spark, path: str):
    """(key, broadcast) of a vocabulary file, which the driver reads; a few MB whatever the corpus."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    return hashlib.sha256(text.encode()).hexdigest(), spark.sparkContext.broadcast(text)


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def roundtrip(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Encode every text and decode the ids: (doc_id, n_tokens, ids_sha256, decoded_sha256).

    Null and empty texts have no tokens; ids and decoded text of very long ones pass through in parts, so beside the
    row itself memory is constant; repeated rows give repeated results; a null doc_id stays null; other columns are
    ignored; an empty table gives no rows.
    """
    key, sent = vocabulary(docs.sparkSession, tokenizer_path)

    def run(batches):
        encoder, decoder, decimal = coders(key, sent.value)
        for whole in batches:
            for batch in sliced(whole):
                n, a, b = [], [], []
                for text in batch.column(1).to_pylist():
                    tokens, said = 0, hashlib.sha256()

                    def told():
                        nonlocal tokens
                        for part in encoder.pieces(text):  # noqa: B023
                            ids = np.frombuffer(part, "<u4")
                            said.update(("," * bool(tokens and len(ids)) + ",".join(decimal[ids].tolist())).encode())  # noqa: B023
                            tokens += len(ids)
                            yield ids

                    decoded = hashlib.sha256()
                    for piece in decoder.pieces(told()):
                        decoded.update(piece.encode())
                    n.append(tokens)
                    a.append(said.hexdigest())
                    b.append(decoded.hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], schema=SCHEMA)

    kinds = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return id_and_text(docs).mapInArrow(run, kinds)
