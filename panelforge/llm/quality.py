"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

Tokens are runs of letters, of digits or of signs, lower-cased; unigrams and bigrams are hashed into
BUCKETS counts. The raw model counts every n-gram of every document, the target model those of a
bounded sample of labelled good rows. N-grams that more labelled bad rows hold than the good ones let
expect lower the ratio, so a few words of abuse count though they are rare in the raw text. A document's
log importance weight is the mean log ratio of its n-grams times TYPICAL, the weight of so many n-grams of its
kind: sums over all n-grams rank documents by length first (see README). The k largest of log weight plus
standard Gumbel noise are a sample without replacement in proportion to the weights (`sampled`); k is given, or it is the
number of documents whose weight is at or above a cut that is calibrated on labelled rows. The cut alone, without
noise, is the classifier of the pipeline's stage (`classified`).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm.shared import BLOCK_BYTES, id_and_text, powers, raw_bytes, release, sliced, small_batches, written

BUCKETS = 1 << 18
SLICES = 64
#: Labelled rows of each kind (good, bad) that fit the target model and the cut.
SAMPLE_ROWS = 4000
#: Of them, the share that fits the target model; the others calibrate the cut.
FIT_SHARE = 0.75
#: Pseudo-count of a bucket in either model, and the standard errors of difference at which its log ratio counts half.
PRIOR, SURE = 1.0, 5.0
#: Pseudo-count of a bucket in the texts of rejected labels, and the weight of that evidence.
BAD_PRIOR, BAD_WEIGHT = 0.1, 3.0
#: Share of labelled good rows that the cut may reject, and the n-grams that a log weight stands for: the temperature of the sample. With fewer
#: noise decides about clear cases, with more about none (README).
GOOD_LOSS, TYPICAL = 0.005, 32.0
#: Byte classes: 0 white, 1 letter (and all bytes of non-ASCII letters), 2 digit, 3 sign.
CLASS = np.full(256, 3, np.uint8)
CLASS[[9, 10, 11, 12, 13, 32]] = 0
CLASS[list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = 1
CLASS[48:58] = 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def grams(flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of every unigram and bigram of the texts that `ends` cuts out of `flat`."""
    n = len(flat)
    kind = CLASS[flat]
    first = np.ones(n, bool)
    first[1:] = kind[1:] != kind[:-1]
    first[ends[:-1][ends[:-1] < n]] = True
    start = np.flatnonzero(first)
    stop = np.append(start[1:], n)
    words = kind[start] != 0 if n else np.zeros(0, bool)
    start, stop = start[words], stop[words]
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((LOWER[flat].astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    h = (total[stop] - total[start]) * down[start]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    text = np.searchsorted(ends, start, side="right") - 1
    together = text[1:] == text[:-1]
    pair = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + (h[1:] ^ (h[1:] >> np.uint64(31))))[together]
    every = np.concatenate([h, (pair ^ (pair >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)])
    return (every >> np.uint64(64 - 18)).astype(np.int64), np.concatenate([text, text[1:][together]])


def pieces(b: pa.RecordBatch):
    """(bytes, offsets, first row) of at most a block each; a longer text comes in blocks of its own, cut at white space where there is any."""
    at = 0
    for part in sliced(b):
        flat, ends = raw_bytes(part.column(1))
        if len(flat) <= BLOCK_BYTES or part.num_rows > 1:
            yield flat, ends, at
        else:
            a = 0
            while a < len(flat):
                z = min(len(flat), a + BLOCK_BYTES)
                if z < len(flat):
                    white = np.flatnonzero(CLASS[flat[z - 65536 : z]] == 0)
                    z = z - 65536 + int(white[-1]) + 1 if len(white) else z
                yield flat[a:z], np.array([0, z - a]), at
                a = z
        at += part.num_rows


#: What is counted: n-grams of all rows, n-grams of good rows, good texts and bad texts that hold one.
KINDS = 4


def gram_counts(marked: DataFrame) -> tuple[np.ndarray, int, int]:
    """(KINDS x BUCKETS counts, good rows, bad rows) of (doc_id, text, mark) in one pass; mark: 1 good, 2 bad, else neither.

    A text of several blocks counts once a block among texts. A task sends its counts once, in slices; the driver gets KINDS times BUCKETS
    numbers whatever the corpus.
    """
    width = BUCKETS // SLICES

    def run(batches):
        release()
        counts, rows = np.zeros((KINDS, BUCKETS), np.int64), np.zeros(3, np.int64)
        for b in batches:
            mark = b.column(2).to_numpy()
            rows += np.bincount(mark, minlength=3)
            for flat, ends, at in pieces(b):
                bucket, text = grams(flat, ends)
                counts[0] += np.bincount(bucket, minlength=BUCKETS)
                of = mark[at + text]
                if of.any():
                    counts[1] += np.bincount(bucket[of == 1], minlength=BUCKETS)
                    for kind in (1, 2):
                        own = of == kind
                        once = np.unique(text[own].astype(np.int64) * BUCKETS + bucket[own]) % BUCKETS
                        counts[1 + kind] += np.bincount(once, minlength=BUCKETS)
        sliced_counts = [np.ascontiguousarray(counts[:, i * width : (i + 1) * width]).tobytes() for i in range(SLICES)]
        first = lambda n: pa.array([int(n), *[0] * (SLICES - 1)], pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(sliced_counts, pa.binary()), first(rows[1]), first(rows[2])], names=["slice", "counts", "good", "bad"])

    def add(batches):
        sums: dict[int, list] = {}
        for b in batches:
            for s, c, g, w in zip(*(x.to_pylist() for x in b.columns)):
                held = sums.setdefault(s, [0, 0, 0])
                sums[s] = [held[0] + np.frombuffer(c, np.int64), held[1] + g, held[2] + w]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x[0].tobytes() for x in sums.values()], pa.binary()), *(pa.array([x[i] for x in sums.values()], pa.int64()) for i in (1, 2))], names=["slice", "counts", "good", "bad"])

    kinds = "slice int, counts binary, good long, bad long"
    out, good, bad = np.zeros((KINDS, SLICES, width), np.int64), 0, 0
    for r in marked.mapInArrow(run, kinds).repartition(SLICES, "slice").mapInArrow(add, kinds).collect():
        out[:, r["slice"]] += np.frombuffer(r["counts"], np.int64).reshape(KINDS, width)
        good, bad = good + r["good"], bad + r["bad"]
    return out.reshape(KINDS, BUCKETS), good, bad


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log ratio of the two models in each bucket. The common scale is the median of target to raw counts
    over the target's n-grams, so junk in the raw text does not raise all other words. A ratio is shrunk
    smoothly by how sure its difference is, so rare words add little noise to long texts and none is cut off."""
    if not target.sum():
        return np.zeros(len(raw))
    share = target / np.maximum(raw, 1)
    order = np.argsort(share)
    mass = np.cumsum(target[order])
    scale = share[order][np.searchsorted(mass, mass[-1] / 2)]
    expected = raw * scale
    ratio = np.log((target + PRIOR) / (expected + PRIOR))
    return ratio * sureness(np.abs(target - expected) / np.sqrt(expected + 1))


def sureness(errors: np.ndarray) -> np.ndarray:
    """Share of a log ratio that counts when its counts differ by so many standard errors; a half at SURE, never 0 for a difference."""
    return errors**4 / (errors**4 + SURE**4)


def bad_ratio(good: np.ndarray, bad: np.ndarray, good_rows: int, bad_rows: int) -> np.ndarray:
    """Negative log ratio of buckets that more bad texts hold than the good ones let expect, shrunk like log_ratio; 0 elsewhere."""
    if not good_rows or not bad_rows:
        return np.zeros(len(good))
    expected = good * (bad_rows / good_rows)
    ratio = np.minimum(np.log((expected + BAD_PRIOR) / (bad + BAD_PRIOR)), 0)
    return BAD_WEIGHT * ratio * sureness(np.maximum(bad - expected, 0) / np.sqrt(expected + 1))


def scores(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """(doc_id, grams, log_weight): the sum of log ratios over each text's n-grams; n-grams do not cross the blocks of a very long text."""
    sent = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches):
        release()
        table = sent.value
        for b in batches:
            n, total = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows)
            for flat, ends, at in pieces(b):
                bucket, text = grams(flat, ends)
                rows = len(ends) - 1
                n[at : at + rows] += np.bincount(text, minlength=rows)
                total[at : at + rows] += np.bincount(text, weights=table[bucket], minlength=rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(total)], names=["doc_id", "grams", "log_weight"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, grams long, log_weight double")


def labelled(labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, good, fits) of about `rows` good and `rows` bad labelled ids, all where there are fewer; a document labelled twice is bad if any label says so.

    Ids are drawn by a threshold on their hash that the two counts give, so no task ranks the labels; twice `rows` of a kind are never met.
    """
    of = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.coalesce((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), F.lit(False)).cast("int")).alias("good"))
    n = of.agg(*[F.coalesce(F.sum((F.col("good") == g).cast("long")), F.lit(0)).alias(f"n{g}") for g in (0, 1)]).first()
    share = F.when(F.col("good") == 1, min(1.0, rows / max(1, n["n1"]))).otherwise(min(1.0, rows / max(1, n["n0"])))
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < share * float(1 << 40)
    return of.filter(drawn).select("doc_id", "good", (F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1000)) < int(1000 * FIT_SHARE)).alias("fits"))


def best_cut(good: np.ndarray, bad: np.ndarray, loss: float = GOOD_LOSS) -> float:
    """The score that parts the labelled rows best among those that reject at most `loss` of the good ones; -inf without both kinds."""
    if not len(good) or not len(bad):
        return -np.inf
    most = np.quantile(good, loss)
    options = np.unique(np.concatenate([good[good <= most], bad[bad <= most]]))
    if not len(options):
        return -np.inf
    good, bad = np.sort(good), np.sort(bad)
    gain = np.searchsorted(bad, options, "left") / len(bad) - np.searchsorted(good, options, "left") / len(good)
    return float(options[gain.argmax()])


def kth_largest(df: DataFrame, column: str, k: int) -> float:
    """The k-th largest value by repeated counts in 1024 bins: a few passes over a narrow table, 1024 numbers to the driver each."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    left = k
    for _ in range(8):
        width = (high - low) / 1024
        if not width > 0 or low + width == low:
            break
        bins = F.least(F.floor((F.col(column) - F.lit(low)) / F.lit(width)), F.lit(1023))
        counts = dict(df.filter(F.col(column).between(low, high)).groupBy(bins.alias("bin")).count().collect())
        for b in sorted(counts, reverse=True):
            if left <= counts[b]:
                break
            left -= counts[b]
        low, high = low + b * width, (low + (b + 1) * width if b < 1023 else high)
        if counts[b] == left:
            break
    return low


def gumbel(seed: int) -> Column:
    """Standard Gumbel noise drawn from a hash of doc_id."""
    return -F.log(-F.log((F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)))


def weights(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, float]:
    """((doc_id, log_weight, log_ratio_sum, grams) of every document, written; the cut of log weights that parts labelled good from bad rows best).

    Texts are read twice: for the counts of all rows and of those that are labelled, and for the weights.
    """
    of = labelled(labels.select("doc_id", "quality", "toxic"))
    with small_batches(docs.sparkSession):
        plain = id_and_text(docs)
        fits = of.filter("fits").select(F.col("doc_id").alias("id"), F.when(F.col("good") == 1, 1).otherwise(2).alias("m"))
        marked = plain.join(F.broadcast(fits), F.col("doc_id") == F.col("id"), "left").select("doc_id", "text", F.coalesce("m", F.lit(0)).alias("mark"))
        (raw, good, good_texts, bad_texts), good_rows, bad_rows = gram_counts(marked)
        ratio = log_ratio(good, raw) + bad_ratio(good_texts, bad_texts, good_rows, bad_rows)
        weighed = scores(plain, ratio).withColumnRenamed("log_weight", "log_ratio_sum").withColumn("log_weight", F.col("log_ratio_sum") * TYPICAL / F.greatest("grams", F.lit(1)))
        held = written(weighed.select("doc_id", "log_weight", "log_ratio_sum", "grams"), "quality")
    tested = held.join(F.broadcast(of.filter("not fits")), "doc_id").groupBy("doc_id", "good").agg(F.min("log_weight").alias("log_weight")).toPandas()  # a row a labelled id
    return held, best_cut(*(tested.log_weight[tested.good == g].to_numpy() for g in (1, 0)))


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, log_weight, log_ratio_sum, grams, kept) of every document; kept: the log weight is at or above the cut.

    The same weights as sampled, no noise. Without labels of both kinds nothing is rejected; rows as in sampled.
    """
    held, cut = weights(docs, labels)
    return held.withColumn("kept", F.col("log_weight") >= F.lit(float(cut)))


def sampled(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = 11) -> DataFrame:
    """(doc_id, log_weight, log_ratio_sum, grams, sample_key, kept) of every document.

    log_ratio_sum: over all n-grams; log_weight: of TYPICAL of them, 0 for null and empty texts; sample_key: log_weight
    plus standard Gumbel noise; kept: among the k largest keys, k as given or else the number of documents
    at or above the cut. Ties at the last key are all kept; without labels of both kinds (and without k), or in an
    empty table, nothing is rejected; repeated rows repeat, rows of one doc_id share the noise; a null doc_id has the
    key of its text alone and is never labelled; long texts count whole; other columns are ignored.
    """
    held, cut = weights(docs, labels)
    held = held.withColumn("sample_key", F.col("log_weight") + gumbel(seed))
    if k is None:
        k = held.filter(F.col("log_weight") >= cut).count() if cut > -np.inf else 0
    last = kth_largest(held, "sample_key", k) if k else -np.inf
    return held.withColumn("kept", F.col("sample_key") >= F.lit(float(last)))
