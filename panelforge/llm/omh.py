"""Order MinHash fingerprints: likeness of texts that sees the order of their k-mers, as edit distance does.

Every k-mer is numbered by its occurrence in the text, so repeats are items of their own. The items'
hashes are dealt into bins by their leading bits (one permutation serves all bins). A bin takes its
`keep` smallest items, puts them back into text order and hashes that tuple; the fingerprint is the
list of the bins' hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.llm.shared import id_and_text, partitions

K, BINS, KEEP = 6, 64, 2
#: Odd 64-bit multipliers of the mixing steps (fixed values of SplitMix64).
STEP, MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Stands for a null doc_id in the order of documents: they come last.
LEAST = -(1 << 63)
PLACE = np.uint64(24)
PLACES = 1 << 24


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


def order_of(keys: np.ndarray) -> np.ndarray:
    """Places in the order of the leading 40 bits of the keys, ties by place; longer texts by a stable sort of the same bits."""
    n = len(keys)
    if n > PLACES:
        return np.argsort(keys >> PLACE, kind="stable")
    packed = np.sort((keys >> PLACE << PLACE) | np.arange(n, dtype=np.uint64))
    return (packed & np.uint64(PLACES - 1)).astype(np.int64)


def items(text: str, k: int = K) -> np.ndarray:
    """A hash of each occurrence-numbered k-mer in text order; a text shorter than k is one k-mer."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
    if not len(codes):
        return codes
    if len(codes) < k:
        codes = np.pad(codes, (0, k - len(codes)))
    n = len(codes) - k + 1
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * STEP + codes[j : j + n] + np.uint64(1)
    h = mix(h)
    order = order_of(h)
    sorted_h = h[order] >> PLACE
    new = np.r_[True, sorted_h[1:] != sorted_h[:-1]]
    starts = np.flatnonzero(new)
    nth = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
    occurrence = np.empty(n, np.uint64)
    occurrence[order] = nth.astype(np.uint64)
    return mix(h + occurrence * STEP)


def signature(text: str, k: int = K, bins: int = BINS, keep: int = KEEP) -> np.ndarray:
    """`bins` numbers from 1 to 65535, 0 for a bin without items."""
    out = np.zeros(bins, np.uint16)
    g = items(text, k)
    n = len(g)
    if not n:
        return out
    shift = np.uint64(64 - (bins - 1).bit_length())
    place = np.arange(n)
    if n > 32 * bins * keep:
        # a sixteen-fold excess of the smallest items is enough unless some bin got too few of them
        small = np.flatnonzero((g & ((np.uint64(1) << shift) - np.uint64(1))) < np.uint64(int(2.0 ** int(shift) * 16 * bins * keep / n)))
        if np.bincount((g[small] >> shift).astype(np.int64), minlength=bins).min() >= keep:
            place, g = small, g[small]
    order = order_of(g)
    which = (g[order] >> shift).astype(np.int64)
    starts = np.flatnonzero(np.r_[True, which[1:] != which[:-1]])
    rank = np.arange(len(which)) - np.repeat(starts, np.diff(np.append(starts, len(which))))
    taken = order[rank < keep]
    which = which[rank < keep]
    again = np.lexsort((place[taken], which))
    taken, which = taken[again], which[again]
    starts = np.flatnonzero(np.r_[True, which[1:] != which[:-1]])
    count = np.diff(np.append(starts, len(which)))
    tuple_hash = np.zeros(len(starts), np.uint64)
    for j in range(keep):
        has = count > j
        tuple_hash[has] = mix(tuple_hash[has] * STEP + g[taken[starts[has] + j]])
    out[which[starts]] = (tuple_hash % np.uint64(65535)).astype(np.uint16) + np.uint16(1)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Equal bins among those that either text fills; 1 for two empty texts."""
    either = (a > 0) | (b > 0)
    n = int(either.sum())
    return 1.0 if n == 0 else float(((a == b) & either).sum()) / n


def hexed(s: np.ndarray) -> str:
    return s.astype(">u2").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The text whose last third (rounded down, in code points) is replaced by the start of the following text."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every text; null is empty, an empty text has 64 empty bins."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([hexed(signature(t)) for t in b.column(1).to_pylist()], pa.string())], names=["doc_id", "fingerprint"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, fingerprint string")


def with_following(docs: DataFrame) -> DataFrame:
    """Rows of contiguous ranges of doc_id, each range in one partition in descending order, followed by the row that comes next (`borrowed`).

    The text moves once. Range bounds are quantiles of doc_id (as many as shuffle partitions); the
    largest id of a range, one number per range, is what the driver learns.
    """
    spark = docs.sparkSession
    plain = id_and_text(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(LEAST)))
    n = partitions(spark)
    cuts = plain.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 10000).alias("q")).first()["q"] or []
    cuts = sorted(set(cuts))
    # the range of an id: how many cuts lie below it
    bucket = F.lit(0)
    low, high = 0, len(cuts)

    def halve(low: int, high: int):
        """A balanced tree of comparisons."""
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(F.col("doc_id") <= cuts[mid], halve(low, mid)).otherwise(halve(mid + 1, high))

    bucket = halve(low, high)
    dealt = plain.withColumn("bucket", bucket)
    top = {r["bucket"]: r["most"] for r in dealt.groupBy("bucket").agg(F.max("doc_id").alias("most")).collect()}
    order = sorted(top)
    # the head of each range is also sent to the range above it, the very first row to the lowest range
    goes = {top[b]: (order[i + 1] if i + 1 < len(order) else order[0]) for i, b in enumerate(order)}
    if not goes:
        return dealt.withColumn("borrowed", F.lit(False))
    target = F.create_map(*[F.lit(x) for pair in goes.items() for x in pair])
    lent = dealt.filter(F.col("doc_id").isin(list(goes))).withColumn("bucket", target[F.col("doc_id")]).withColumn("borrowed", F.lit(True))
    both = dealt.withColumn("borrowed", F.lit(False)).unionByName(lent)
    return both.repartitionById(len(cuts) + 1, F.col("bucket")).sortWithinPartitions("bucket", "borrowed", F.col("doc_id").desc(), F.xxhash64("text"))


OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Each text's fingerprint beside those of its edited text and of the next document in descending doc_id.

    Null texts are empty (fingerprint of empty bins, likeness 1 to another empty text); rows with the
    same doc_id follow each other by a hash of the text, those without one come last; a table of one row is its own next document;
    an empty table gives no rows; other columns are ignored.
    """
    import hashlib

    def pairs(batches) -> Iterator[tuple]:
        held = None
        for b in batches:
            for doc, text, bucket, borrowed in zip(*(b.column(i).to_pylist() for i in range(4))):
                now = (doc, text, signature(text), bucket)
                if held is not None and held[3] == bucket:
                    yield held, now
                held = None if borrowed else now

    def run(batches):
        out: tuple[list, ...] = tuple([] for _ in OUT)

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, OUT)], schema=OUT)
            for c in out:
                c.clear()
            return batch

        for (doc, text, sig, _), (_, following, next_sig, _) in pairs(batches):
            other = edited(text, following)
            other_sig = signature(other)
            row = (None if doc == LEAST else doc, len(text), hashlib.sha256(other.encode()).hexdigest(), hexed(sig), hexed(other_sig), likeness(sig, other_sig), likeness(sig, next_sig))
            for c, x in zip(out, row):
                c.append(x)
            if len(out[0]) >= 2000:
                yield flush()
        yield flush()

    kinds = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType()), *(T.StructField(c, T.StringType()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")), T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())])
    return with_following(docs).select("doc_id", "text", "bucket", "borrowed").mapInArrow(run, kinds)
