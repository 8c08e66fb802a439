"""Exact substring dedup: every byte covered by a 50-byte string that a smaller doc_id also holds goes.

Text stays where it is, in a table of chunks bucketed by chunk. Of each 50-byte window the least
32-byte gram (by hash) is its anchor, so equal windows have equal anchors at equal places.
1. Chunks send the hashes of their distinct anchors; ranges of hashes answer which ones other chunks have.
2. A shared anchor with the 18 bytes on either side is a segment: all windows that can hold the anchor. It
   goes, byte for byte, to the anchor's range, once per distinct segment and chunk, with the least doc_id
   that holds it. Where an anchor stands in very many places its windows go one by one, each to the
   range of its own hash, so no anchor's segments need to meet in one task.
3. A range builds the suffix array of its distinct segments by two-stage sorting: suffixes smaller than
   their successors are sorted directly, the others are induced by scanning the buckets of first bytes.
   Adjacent common prefixes of a window or more are equal windows; those of larger documents go.
4. Chunks apply the answers.

Hashes only route; what is equal is decided by comparing bytes. There are as many ranges as their measured
bytes need, so a range's size does not grow with the corpus (a passage of all chunks is one row a chunk).
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.llm.shared import BLOB_ROWS, Scratch, partitions, powers, raw_bytes, release, scratch, sliced, small_batches, written

WINDOW, GRAM = 50, 32
SIDE = WINDOW - GRAM
SEGMENT = WINDOW + SIDE
#: A segment's row: its bytes, zeros, its size; in memory filled up to whole words.
ROW, ROW_WORDS = SEGMENT + 1, 9
CHUNK_BYTES = 2 << 20
STEP = 1 << 18
#: Segments whose suffixes are sorted at once, and the places of an anchor from which its windows go one by one.
SORT_SEGMENTS = 20_000
#: Bytes of segments that a range holds on average, and of text whose anchors it holds.
RANGE_BYTES, RANGE_TEXT = 12 << 20, 8 << 20
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Stands for a null doc_id where ids are compared.
LAST = np.iinfo(np.int64).max


def anchors(flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, 64-bit hash) of the anchors of all 50-byte windows inside the documents that `ends` cuts out of `flat`."""
    n = len(flat)
    places, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    lengths = np.diff(ends)
    for a in range(0, max(0, n - WINDOW + 1), STEP):
        z = min(n, a + STEP + WINDOW - 1)
        part = flat[a:z].astype(np.uint64) + np.uint64(1)
        m = z - a
        up, down = powers(m + 1)
        total = np.zeros(m + 1, np.uint64)
        np.cumsum(part * up[:m], out=total[1:])
        grams = m - GRAM + 1
        h = (total[GRAM:] - total[:grams]) * down[:grams]
        h ^= h >> np.uint64(30)
        h *= MIX_A
        h ^= h >> np.uint64(27)
        h *= MIX_B
        h ^= h >> np.uint64(31)
        key = (h >> np.uint64(24) << np.uint64(24)) | np.arange(grams, dtype=np.uint64)
        for reach in (1, 2, 4, 8):
            key = np.minimum(key[:-reach], key[reach:])
        key = np.minimum(key[:-3], key[3:])  # the least of 19 grams: 16 and 16, three apart
        first, last = np.searchsorted(ends, a, "right") - 1, np.searchsorted(ends, z, "left")
        inside = np.zeros(len(key) + 1, np.int64)
        for d in range(max(0, first), min(last, len(lengths))):
            if lengths[d] >= WINDOW:
                low, high = max(0, ends[d] - a), min(len(key), ends[d + 1] - WINDOW + 1 - a)
                if low < high:
                    inside[low] += 1
                    inside[high] -= 1
        at = (key[np.cumsum(inside[:-1]) > 0] & np.uint64((1 << 24) - 1)).astype(np.int64)
        if len(at):
            at = at[np.r_[True, at[1:] != at[:-1]]]
            at = np.unique(at)
            places.append(at + a)
            hashes.append(h[at])
    place, found = np.concatenate(places), np.concatenate(hashes)
    place, once = np.unique(place, return_index=True)
    return place, spread(found[once])


def spread(h: np.ndarray) -> np.ndarray:
    """A bijection: anchors are least hashes, so without it low ranges would get most of them."""
    h = h * MIX_A
    h ^= h >> np.uint64(32)
    return h * MIX_B


def ranges(h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of n equal ranges each hash lies in, and in which 256th of it."""
    x = (h >> np.uint64(32)) * np.uint64(n)
    return (x >> np.uint64(32)).astype(np.int64), (x >> np.uint64(24)).astype(np.uint8)


def runs(h: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """(range, first, end) of ascending hashes."""
    r = ranges(h, n)[0]
    cuts = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else np.zeros(0, np.int64)
    return [(int(r[a]), int(a), int(b)) for a, b in zip(cuts, np.append(cuts[1:], len(r)))]


def packed(h: np.ndarray) -> bytes:
    """Ascending hashes, their leading 48 bits as differences of 32 bits where those suffice."""
    top = h >> np.uint64(16)
    steps = np.diff(top, prepend=top[:1])
    if len(top) and (steps >> np.uint64(32)).any():
        return b"8" + top.tobytes()
    return b"4" + top[:1].tobytes() + steps.astype(np.uint32).tobytes()


def unpacked(b: bytes) -> np.ndarray:
    if b[:1] == b"8":
        return np.frombuffer(b, np.uint64, offset=1)
    first = np.frombuffer(b, np.uint64, 1, 1)
    return first[0] + np.cumsum(np.frombuffer(b, np.uint32, offset=9).astype(np.uint64))


def small_ids(ids: np.ndarray) -> bytes:
    """Ids as 32-bit steps from the least where those suffice."""
    low = ids.min()
    steps = (ids - low).astype(np.uint64)
    if (steps >> np.uint64(32)).any():
        return b"8" + ids.tobytes()
    return b"4" + np.array([low], np.int64).tobytes() + steps.astype(np.uint32).tobytes()


def large_ids(b: bytes) -> np.ndarray:
    if b[:1] == b"8":
        return np.frombuffer(b, np.int64, offset=1)
    return np.frombuffer(b, np.int64, 1, 1)[0] + np.frombuffer(b, np.uint32, offset=9).astype(np.int64)


def mark_of(words: np.ndarray) -> np.ndarray:
    """A hash of each row of words."""
    mark = np.zeros(len(words), np.uint64)
    for j in range(words.shape[1]):
        mark = (mark ^ words[:, j]) * MIX_A
        mark ^= mark >> np.uint64(29)
    return mark


def unlike(words: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Which rows, in this order, differ from the row before."""
    new = np.ones(len(order), bool)
    new[1:] = (words[order[1:]] != words[order[:-1]]).any(axis=1)
    return new


class Chunk:
    """A chunk's documents and anchors."""

    def __init__(self, doc_id: pa.Array, text: pa.Array):
        self.doc_id = doc_id.fill_null(LAST).to_numpy(zero_copy_only=False)
        self.flat, self.ends = raw_bytes(text)
        self.place, self.hash = anchors(self.flat, self.ends)
        self.doc = np.searchsorted(self.ends, self.place, "right") - 1
        self.own, self.of, self.times = np.unique(self.hash, return_inverse=True, return_counts=True)

    def heavy(self, a: int, b: int) -> bytes:
        """(index, places) of the anchors from a to b that stand in several places."""
        at = np.flatnonzero(self.times[a:b] > 8)
        return np.stack([at, self.times[a:b][at]]).astype(np.uint32).tobytes()

    def select(self, answers: dict[int, bytes], n: int) -> None:
        """Segments of the anchors that another document has, and the first occurrence (by doc_id) of each distinct one."""
        shared, hot = np.zeros(len(self.own), bool), np.zeros(len(self.own), bool)
        for r, a, b in runs(self.own, n):
            if r in answers:
                bits = np.unpackbits(np.frombuffer(answers[r], np.uint8))
                shared[a:b] = bits[: b - a]
                full = -(-(b - a) // 8) * 8
                if len(bits) > full:
                    hot[a:b] = bits[full : full + b - a]
        ids = self.doc_id[self.doc]
        low, high = np.full(len(self.own), LAST), np.full(len(self.own), np.iinfo(np.int64).min)
        np.minimum.at(low, self.of, ids)
        np.maximum.at(high, self.of, ids)
        shared |= low < high
        pick = np.flatnonzero(shared[self.of])
        place, doc, key = self.place[pick], self.doc[pick], self.hash[pick]
        start = np.maximum(place - SIDE, self.ends[doc])
        size = np.minimum(place + GRAM + SIDE, self.ends[doc + 1]) - start
        burst = hot[self.of[pick]]
        whole = int((~burst).sum())
        if whole < len(pick):
            many = size[burst] - WINDOW + 1
            nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            start = np.concatenate([start[~burst], np.repeat(start[burst], many) + nth])
            doc = np.concatenate([doc[~burst], np.repeat(doc[burst], many)])
            key = np.concatenate([key[~burst], np.zeros(len(nth), np.uint64)])
            size = np.concatenate([size[~burst], np.full(len(nth), WINDOW)])
        self.start, self.size, self.ids = start, size, self.doc_id[doc]
        self.rows = np.zeros((len(start), 8 * ROW_WORDS), np.uint8)
        k = np.arange(SEGMENT)
        for i in range(0, len(start), 1 << 14):
            one = slice(i, i + (1 << 14))
            held = self.flat[np.minimum(start[one, None] + k, len(self.flat) - 1)]
            held[k >= size[one, None]] = 0
            self.rows[one, :SEGMENT] = held
        self.rows[:, SEGMENT] = size
        words = self.rows.view(np.uint64)
        mark = mark_of(words)
        key[whole:] = spread(mark[whole:])
        order = np.lexsort((self.ids, mark, key))
        new = unlike(words, order)
        self.sent = order[new]  # in the order of their keys, so ranges are contiguous
        self.key = key[self.sent]
        self.like = np.empty(len(order), np.int64)
        self.like[order] = np.cumsum(new) - 1

    def covered(self, answers: dict[int, bytes], n: int) -> np.ndarray:
        """Which bytes go."""
        mask = np.zeros(len(self.sent), np.uint32)
        for r, a, b in runs(self.key, n):
            if r in answers:
                mask[a:b] = np.frombuffer(answers[r], np.uint32)
        change = np.zeros(len(self.flat) + 1, np.int32)
        if len(self.start):
            later = self.ids > self.ids[self.sent][self.like]
            every = mask[self.like]
            for o in range(SIDE + 1):
                gone = (o <= self.size - WINDOW) & (later | (every >> np.uint32(o) & np.uint32(1)).astype(bool))
                start = self.start[gone] + o  # a window that two segments hold counts once in both lines
                change[start] += 1
                change[start + WINDOW] -= 1
        return np.cumsum(change[:-1]) > 0


def suffix_order(rows: np.ndarray, need: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two-stage suffix sorting of the rows (segments, zero after `end`): (row, place) of the suffixes from 0 to `need`
    of each row in lexicographic order, and each place's eight-byte words.

    A suffix is small if it is smaller than its successor. Small ones are sorted directly, word by
    word and only while tied. Scanning buckets of first bytes upwards then puts the predecessor of
    each suffix seen, where it is large, at the head of its bucket.
    """
    n, width = rows.shape
    small = np.zeros((n, width + 1), bool)
    for j in range(width - 1, -1, -1):
        nxt = rows[:, j + 1] if j + 1 < width else np.zeros(n, np.uint8)
        here = rows[:, j]
        small[:, j] = (j + 1 < end) & ((here < nxt) | ((here == nxt) & small[:, j + 1]))
    # a large suffix needs its successors up to the next small one, or to the row's end
    stop = end.copy()
    for j in range(width - 1, -1, -1):
        stop = np.where(small[:, j] & (j >= need), j, stop)
    padded = np.pad(rows, ((0, 0), (0, 8)))
    stride = width + 1
    word = np.zeros((n, stride), np.uint64)
    for k in range(8):
        word |= padded[:, k : k + stride].astype(np.uint64) << np.uint64(56 - 8 * k)
    words = word.reshape(-1)
    r, p = np.nonzero(small[:, :width] & (np.arange(width) <= stop[:, None]))
    order = np.argsort(words[r * stride + p], kind="stable")
    r, p = r[order], p[order]
    w = words[r * stride + p]
    tied = np.zeros(len(r) + 1, bool)
    tied[1:-1] = w[1:] == w[:-1]
    for k in range(8, width, 8):
        run = np.flatnonzero(tied[:-1] | tied[1:])
        if not len(run):
            break
        group = np.cumsum(~tied[run])
        w = words[r[run] * stride + np.minimum(p[run] + k, width)]  # the last word is zero
        order = np.lexsort((w, group))
        r[run], p[run], w, group = r[run][order], p[run][order], w[order], group[order]
        tied[run] = np.r_[False, (group[1:] == group[:-1]) & (w[1:] == w[:-1])]
    head = rows[r, p]
    cut = np.searchsorted(head, np.arange(257))
    out_r, out_p = [], []
    waiting: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(256)]

    def induce(r: np.ndarray, p: np.ndarray, c: int):
        """Large predecessors of suffixes in order; those that begin with c come back, others wait in their bucket."""
        ok = p > 0
        r, p = r[ok], p[ok] - 1
        ok = ~small[r, p]
        r, p = r[ok], p[ok]
        b = rows[r, p]
        order = np.argsort(b, kind="stable")
        r, p, b = r[order], p[order], b[order]
        cuts = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else np.zeros(0, np.int64)
        own = r[:0], p[:0]
        for x, y in zip(cuts, np.append(cuts[1:], len(b))):
            if b[x] == c:
                own = r[x:y], p[x:y]
            else:
                waiting[b[x]].append((r[x:y], p[x:y]))
        return own

    whole = np.flatnonzero((stop == end) & (end > 0))
    induce(whole, end[whole], -1)
    for c in range(256):
        level = (np.concatenate([x[0] for x in waiting[c]]), np.concatenate([x[1] for x in waiting[c]])) if waiting[c] else (r[:0], p[:0])
        waiting[c] = []
        while len(level[0]):
            out_r.append(level[0])
            out_p.append(level[1])
            level = induce(*level, c)
        if cut[c + 1] > cut[c]:
            out_r.append(r[cut[c] : cut[c + 1]])
            out_p.append(p[cut[c] : cut[c + 1]])
            if len(induce(out_r[-1], out_p[-1], c)[0]):
                raise AssertionError("a small suffix has no large predecessor with its own first byte")
    every_r = np.concatenate(out_r) if out_r else np.zeros(0, np.int64)
    every_p = np.concatenate(out_p) if out_p else np.zeros(0, np.int64)
    ok = every_p <= need[every_r]
    return every_r[ok], every_p[ok], word


def window_masks(rows: np.ndarray, size: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each segment the places (bits) where a window begins that a segment of a smaller document also holds."""
    mask = np.zeros(len(rows), np.uint32)
    if not len(rows):
        return mask
    r, p, word = suffix_order(rows, size - WINDOW, size)
    equal = np.ones(max(0, len(r) - 1), bool)  # common prefix of at least a window
    for k in (*range(0, WINDOW - 8, 8), WINDOW - 8):
        w = word[r, p + k]
        equal &= w[1:] == w[:-1]
    starts = np.flatnonzero(np.r_[True, ~equal])
    ids = doc[r]
    least = np.minimum.reduceat(ids, starts)
    gone = ids > np.repeat(least, np.diff(np.append(starts, len(r))))
    np.bitwise_or.at(mask, r[gone], np.uint32(1) << p[gone].astype(np.uint32))
    return mask


def segment_masks(rows: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """window_masks of rows of ROW bytes: only distinct segments are sorted, each with its least document; copies in larger documents go whole."""
    words = np.zeros((len(rows), 8 * ROW_WORDS), np.uint8)
    words[:, :ROW] = rows
    words = words.view(np.uint64)
    order = np.lexsort((doc, mark_of(words)))
    new = unlike(words, order)
    first = order[new]
    size = rows[first, SEGMENT].astype(np.int64)
    found = window_masks(np.ascontiguousarray(rows[first, :SEGMENT]), size, doc[first])
    mask = np.empty(len(rows), np.uint32)
    of = np.cumsum(new) - 1
    mask[order] = np.where(doc[order] > doc[first][of], (np.uint32(1) << (size - WINDOW + 1).astype(np.uint32)[of]) - np.uint32(1), found[of])
    return mask


def chunked(docs: DataFrame, n: int) -> tuple[DataFrame, str]:
    """The documents (doc_id, text, rest) as rows of about CHUNK_BYTES in a table bucketed by chunk, and its name. Later joins by chunk move no text.

    A chunk's number is chosen among 8n candidates so that all chunks of a task fall into one bucket: a task writes one
    file. Where none fits the first one is taken, and the task writes one more.
    """
    spark = docs.sparkSession

    def run(batches):
        release()
        task, seq = TaskContext.get().partitionId(), 0
        for whole in batches:
            for b in sliced(whole, limit=CHUNK_BYTES):
                one = [pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), pa.concat_arrays([c])) for c in b.columns]
                size = int(np.diff(raw_bytes(b.column(1))[1]).sum())
                yield pa.RecordBatch.from_arrays([pa.array([task], pa.int64()), pa.array([task << 40 | seq * 8 * n], pa.int64()), pa.array([size], pa.int64()), *one], names=["task", "first", "bytes", *b.schema.names])
                seq += 1

    kinds = T.StructType([*(T.StructField(c, T.LongType()) for c in ("task", "first", "bytes")), *(T.StructField(f.name, T.ArrayType(f.dataType)) for f in docs.schema)])
    fits = F.filter(F.sequence("first", F.col("first") + (8 * n - 1)), lambda x: F.pmod(F.hash(x), F.lit(n)) == F.pmod("task", F.lit(n)))
    rows = docs.mapInArrow(run, kinds).select(F.coalesce(F.get(fits, F.lit(0)), "first").alias("chunk"), "bytes", *docs.columns)
    name = f"panelforge_chunks_{uuid.uuid4().hex}"
    rows.write.format("parquet").options(**BLOB_ROWS).bucketBy(n, "chunk").option("path", scratch(spark, "chunks")).saveAsTable(name)
    return spark.table(name), name


def chunks_of(batches):
    for b in batches:
        for i in range(b.num_rows):
            cell = {name: b.column(k).slice(i, 1) for k, name in enumerate(b.schema.names)}
            yield cell["chunk"][0].as_py(), Chunk(cell["doc_id"].flatten(), cell["text"].flatten()), cell


def answers_of(cell: pa.Array) -> dict[int, bytes]:
    got = cell[0].as_py()
    return {x["r"]: x["answer"] for x in got} if got else {}


def removal(docs: DataFrame, emit, kinds) -> DataFrame:
    """Run the four steps over (doc_id, text, rest) and give what emit(chunk, covered bytes, cell) yields, written to the shared folder; what lies in between is removed."""
    with small_batches(docs.sparkSession), Scratch(docs.sparkSession) as between:  # rows are blobs, and all steps run before this function returns
        return _removal(docs, emit, kinds, between)


def meet_hashes(batches):
    """Of each chunk's hashes in a range: which ones another chunk has, and, where there are any, which ones stand in very many places."""
    held: dict[int, list[tuple]] = {}
    for b in batches:
        for r, chunk, sent, heavy in zip(*(x.to_pylist() for x in b.columns)):
            held.setdefault(r, []).append((chunk, sent, heavy))
    while held:
        r, parts = held.popitem()
        hashes = [unpacked(p[1]) for p in parts]
        every = np.concatenate(hashes)
        first = np.cumsum([0, *map(len, hashes)])
        places = np.ones(len(every), np.uint32)
        for a, (_, _, heavy) in zip(first, parts):
            at, times = np.frombuffer(heavy, np.uint32).reshape(2, -1)
            places[a + at] = times
        order = np.argsort(every, kind="stable")
        s = every[order]
        starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, np.int64)
        chunks = np.diff(np.append(starts, len(s)))
        total = np.add.reduceat(places[order].astype(np.int64), starts) if len(s) else chunks
        shared, hot = np.zeros(len(every), bool), np.zeros(len(every), bool)
        shared[order], hot[order] = np.repeat(chunks > 1, chunks), np.repeat(total > SORT_SEGMENTS, chunks)
        bits, segments = [], []
        for a, b in zip(first[:-1], first[1:]):
            bits.append(np.packbits(shared[a:b]).tobytes() + (np.packbits(hot[a:b]).tobytes() if hot[a:b].any() else b""))
            segments.append(int(places[a:b][shared[a:b]].sum()) + SIDE * int(places[a:b][hot[a:b]].sum()))
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int64()), pa.array([r] * len(parts), pa.int32()), pa.array(bits, pa.binary()), pa.array(segments, pa.int64())], names=["chunk", "r", "answer", "segments"])


def meet_segments(batches):
    """Of each chunk's segments in a range: the places of windows that a smaller document holds."""
    held: dict[int, list[tuple]] = {}
    for b in batches:
        for r, chunk, ids, part, rows in zip(*(x.to_pylist() for x in b.columns)):
            held.setdefault(r, []).append((chunk, ids, part, rows))
    while held:
        r, parts = held.popitem()
        chunk = [p[0] for p in parts]
        ids = np.concatenate([large_ids(p[1]) for p in parts])
        part = np.frombuffer(b"".join(p[2] for p in parts), np.uint8)
        sizes = [len(p[2]) for p in parts]
        rows = np.frombuffer(b"".join(p[3] for p in parts), np.uint8).reshape(-1, ROW)
        del parts
        order = np.argsort(part, kind="stable")
        ends = np.cumsum(np.bincount(part, minlength=256))
        mask = np.zeros(len(ids), np.uint32)
        a = 0
        while a < len(order):  # whole 256ths, so that equal windows meet
            z = int(ends[max(np.searchsorted(ends, a + SORT_SEGMENTS, "right") - 1, np.searchsorted(ends, a, "right"))])
            mask[order[a:z]] = segment_masks(rows[order[a:z]], ids[order[a:z]])
            a = z
        answers = [x.tobytes() for x in np.split(mask, np.cumsum(sizes)[:-1])]
        yield pa.RecordBatch.from_arrays([pa.array(chunk, pa.int64()), pa.array([r] * len(chunk), pa.int32()), pa.array(answers, pa.binary())], names=["chunk", "r", "answer"])


def _removal(docs: DataFrame, emit, kinds, between: Scratch) -> DataFrame:
    spark = docs.sparkSession
    n = partitions(spark)
    table, name = chunked(docs, n)
    between.table(name)
    size = table.agg(F.sum("bytes")).first()[0] or 0
    n1 = max(n, -(-size // RANGE_TEXT))

    def send_hashes(batches):
        for chunk, c, _ in chunks_of(batches):
            parts = runs(c.own, n1)
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int32()), pa.array([chunk] * len(parts), pa.int64()), pa.array([packed(c.own[a:b]) for _, a, b in parts], pa.binary()), pa.array([c.heavy(a, b) for _, a, b in parts], pa.binary())], names=["r", "chunk", "sent", "heavy"])

    texts = table.select("chunk", "doc_id", "text")
    answered = texts.mapInArrow(send_hashes, "r int, chunk long, sent binary, heavy binary").repartitionById(n1, F.col("r")).mapInArrow(meet_hashes, "chunk long, r int, answer binary, segments long")
    shared = between.written(answered.groupBy("chunk").agg(F.collect_list(F.struct("r", "answer")).alias("shared"), F.sum("segments").alias("segments")), "shared")
    n2 = max(n, -(-(shared.agg(F.sum("segments")).first()[0] or 0) * ROW // RANGE_BYTES))
    shared = shared.select("chunk", "shared")

    def send_segments(batches):
        for chunk, c, cell in chunks_of(batches):
            c.select(answers_of(cell["shared"]), n1)
            parts, part = runs(c.key, n2), ranges(c.key, n2)[1]
            ids = c.ids[c.sent]
            for k in range(0, len(parts), 64):  # a part of the ranges at a time
                some = parts[k : k + 64]
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in some], pa.int32()), pa.array([chunk] * len(some), pa.int64()), pa.array([small_ids(ids[a:b]) for _, a, b in some], pa.binary()), pa.array([part[a:b].tobytes() for _, a, b in some], pa.binary()), pa.array([c.rows[c.sent[a:b], :ROW].tobytes() for _, a, b in some], pa.binary())], names=["r", "chunk", "ids", "part", "rows"])

    def apply(batches):
        for _, c, cell in chunks_of(batches):
            c.select(answers_of(cell["shared"]), n1)
            yield emit(c, c.covered(answers_of(cell["gone"]), n2), cell)

    met = texts.join(shared, "chunk", "left").mapInArrow(send_segments, "r int, chunk long, ids binary, part binary, rows binary").repartitionById(n2, F.col("r")).mapInArrow(meet_segments, "chunk long, r int, answer binary")
    gone = between.written(met.groupBy("chunk").agg(F.collect_list(F.struct("r", "answer")).alias("gone")), "gone")
    return written(table.join(shared, "chunk", "left").join(gone, "chunk", "left").mapInArrow(apply, kinds), "kept")


def plain(docs: DataFrame, rest: Column) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), rest.alias("rest"))


def dedup_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256).

    Null texts are empty and lose nothing, as do texts under 50 bytes; rows with one doc_id never
    remove from each other, a null doc_id counts as the largest; of equal texts all but those of the least doc_id
    vanish; long texts are chunks of their own; an empty table gives no rows; other columns are ignored.
    """

    def emit(c: Chunk, gone: np.ndarray, cell):
        sizes = np.diff(c.ends)
        removed, n_spans, sha = [], [], []
        for a, b in zip(c.ends, c.ends[1:]):
            g = gone[a:b]
            removed.append(int(g.sum()))
            n_spans.append(int(g[:1].sum()) + int((g[1:] & ~g[:-1]).sum()))
            sha.append(hashlib.sha256(c.flat[a:b][~g].tobytes()).hexdigest())
        return pa.RecordBatch.from_arrays([cell["doc_id"].flatten(), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return removal(plain(docs, F.lit(None).cast("boolean")), emit, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of documents with the repeated bytes taken out of `text`; a character that loses a byte goes whole.

    Null texts stay null; n_chars follows the text where there is such a column; all columns, whatever their
    names and types, stay as they are; repeated rows, null doc_ids, ties and empty tables as in dedup_report.
    """
    other = {c: f"c{i}" for i, c in enumerate(docs.columns) if c != "text"}
    rest = F.struct(*[F.col(f"`{c}`").alias(k) for c, k in other.items()], F.col("text").isNull().alias("no_text"))
    laid = plain(docs, rest)

    def emit(c: Chunk, gone: np.ndarray, cell):
        texts = [c.flat[a:b][~gone[a:b]].tobytes().decode(errors="ignore") for a, b in zip(c.ends, c.ends[1:])]
        return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), cell["rest"].flatten()], names=["text", "rest"])

    out = removal(laid, emit, T.StructType([T.StructField("text", T.StringType()), T.StructField("rest", laid.schema["rest"].dataType)]))
    gone = F.col("rest.no_text")
    kept = {c: F.col(f"rest.{k}") for c, k in other.items()} | {"text": F.when(~gone, F.col("text")).cast(docs.schema["text"].dataType)}
    if "n_chars" in kept:
        kept["n_chars"] = F.when(gone, kept["n_chars"]).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[kept[c].alias(c) for c in docs.columns])
