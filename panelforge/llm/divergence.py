"""How far the sources of a language diverge from it and from each other, term by term.

Every term of a (lang, source) group has a share of 10^9, one added to each count. Two shares p, q diverge by
floor((p - q)^2 / q); all of it is integer arithmetic.

Terms of a group that stand out from the language come by an upper-bound search: a group's terms fall into buckets of
equal count, the extreme language shares of a bucket bound its divergences, and buckets are evaluated best bound first until
the bounds of those unseen are strictly below the k-th value found. A large group is searched in salted parts of at most about
PART_TERMS terms, whose winners meet.

Pairs of sources come from postings: a term that neither source holds diverges by the same amount everywhere, one
that a single source holds by an amount of its count alone, which histograms of counts add up; only terms that both
hold are met, in the posting list of the term, and their pairs are summed where they are made.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelforge.llm.shared import offsets, raw_bytes, release, sliced, small_batches, written

#: Shares are parts of so many.
UNIT = 1_000_000_000
#: A language keeps terms of so many of its documents; a group reports so many terms.
LEAST_DOCS, BEST = 3, 200
#: Bytes of text counted at once, pairs of postings met at once, terms of a group searched at once, slices of a language's sources.
COUNT_BYTES, PAIRS, PART_TERMS, SLICES = 4 << 20, 1 << 20, 1 << 14, 16

TERM = np.zeros(256, bool)
TERM[65:91] = TERM[97:123] = TERM[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def terms_of(flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.StringArray]:
    """(text, term) of every run of letters and bytes of non-ASCII characters; only A-Z are lower-cased, terms do not cross texts."""
    keep = TERM[flat]
    first = keep.copy()
    first[1:] &= ~keep[:-1]
    heads = ends[:-1][ends[:-1] < len(flat)]
    first[heads] = keep[heads]
    start = np.flatnonzero(first)
    body = LOWER[flat[keep]]
    place = np.append(np.cumsum(keep)[start] - 1, len(body)).astype(np.int32)
    return np.searchsorted(ends, start, side="right") - 1, pa.StringArray.from_buffers(len(start), pa.py_buffer(place), pa.py_buffer(body))


def _codes(*columns: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code of each row, a first row of each code) of the combinations of columns without nulls."""
    key = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        coded = c.dictionary_encode()
        key = key * max(1, len(coded.dictionary)) + coded.indices.to_numpy(zero_copy_only=False)
    _, at, code = np.unique(key, return_index=True, return_inverse=True)
    return code.reshape(-1), at


COUNTED = "lang string, source string, term string, n long, docs long"


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, added up within blocks of text."""

    def run(batches):
        release()
        for whole in batches:
            for b in sliced(whole, "text", COUNT_BYTES):
                text, terms = terms_of(*raw_bytes(b.column(2)))
                coded = terms.dictionary_encode()
                many = max(1, len(coded.dictionary))
                each, n = np.unique(text.astype(np.int64) * many + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
                group, at = _codes(b.column(0), b.column(1))
                found, back = np.unique(group[each // many] * many + each % many, return_inverse=True)
                rows = pa.array(at[found // many])
                total = np.zeros(len(found), np.int64)
                np.add.at(total, back.reshape(-1), n)
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), coded.dictionary.take(pa.array(found % many)), pa.array(total), pa.array(np.bincount(back.reshape(-1), minlength=len(found)))], names=["lang", "source", "term", "n", "docs"])

    return docs.mapInArrow(run, COUNTED)


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (count + 1) / (total + terms)), in 38 digits where counts are large."""
    of = F.nullif(total + terms, F.lit(0))
    div = lambda a, b: F.call_function("div", a, b)
    large = div((count.cast("decimal(20,0)") + 1) * F.lit(UNIT).cast("decimal(10,0)"), of.cast("decimal(20,0)"))
    return F.when(count < 4_000_000_000, div((count + 1) * F.lit(UNIT).cast("long"), of)).otherwise(large) + 1


def apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); shares are at most UNIT + 1, so the square fits a long."""
    return F.call_function("div", (p - q) * (p - q), q)


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def best_first(p: np.ndarray, q: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(places, divergences, buckets evaluated) of at least the `most` largest divergences and all that tie with the last, for p > q: buckets of equal p in order of their bounds, until a bound is strictly below the last value that counts."""
    share, bucket = np.unique(p, return_inverse=True)
    bucket = bucket.reshape(-1)
    low, high = np.full(len(share), np.iinfo(np.int64).max), np.zeros(len(share), np.int64)
    np.minimum.at(low, bucket, q)
    np.maximum.at(high, bucket, q)
    bound = np.maximum(_apart(share, low), _apart(share, high))
    rows, ends = np.argsort(bucket, kind="stable"), np.append(0, np.cumsum(np.bincount(bucket, minlength=len(share))))
    places, values, last, seen = np.zeros(0, np.int64), np.zeros(0, np.int64), -1, 0
    for b in np.argsort(-bound, kind="stable"):
        if len(values) >= most and bound[b] < last:
            break
        seen += 1
        at = rows[ends[b] : ends[b + 1]]
        places, values = np.append(places, at), np.append(values, _apart(p[at], q[at]))
        if len(values) >= most:
            last = np.partition(values, len(values) - most)[len(values) - most]
            stay = values >= last
            places, values = places[stay], values[stay]
    return places, values, seen


def _searched(shares: DataFrame, most: int) -> DataFrame:
    """(lang, source, item, value, rank) of each group's `most` most divergent terms above the language."""

    def run(t: pa.Table) -> pa.Table:
        p, q = (t.column(c).combine_chunks().to_numpy() for c in ("p", "q"))
        at, value, _ = best_first(p, q, most)
        found = t.select(["lang", "source", "term"]).take(pa.array(at)).append_column("value", pa.array(value))
        return found.take(pa.compute.sort_indices(found, [("value", "descending"), ("term", "ascending")])[:most]).rename_columns(["lang", "source", "item", "value"])

    part = F.pmod(F.xxhash64("term"), F.ceil(F.col("held") / PART_TERMS))
    found = shares.filter("p > q").select("lang", "source", "term", "p", "q", part.alias("part")).groupBy("lang", "source", "part").applyInArrow(run, "lang string, source string, item string, value long")
    order = W.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def _met(postings: DataFrame) -> DataFrame:
    """(lang, source, item, value): what the terms that two sources hold add to the sums of those that one holds; posting lists are met in parts of PAIRS pairs, summed at once."""

    def sums(lang, source, i, j, p, p0):
        code, at = _codes(lang, source)
        v = _apart(p[i], p[j]) - _apart(p[i], p0[j]) - _apart(p0[i], p[j]) + _apart(p0[i], p0[j])
        pair, back = np.unique(code[i] * len(at) + code[j], return_inverse=True)
        total = np.zeros(len(pair), np.int64)
        np.add.at(total, back.reshape(-1), v)
        a, b = pa.array(at[pair // len(at)]), pa.array(at[pair % len(at)])
        return pa.RecordBatch.from_arrays([lang.take(a), source.take(a), source.take(b), pa.array(total)], names=["lang", "source", "item", "value"])

    def run(batches):
        release()
        for b in batches:
            ends = offsets_of(b.column(1))
            entries = b.column(1).flatten()
            source, p, p0 = (entries.field(k) for k in range(3))
            p, p0 = p.to_numpy(), p0.to_numpy()
            length = np.diff(ends)
            row = np.repeat(np.arange(len(length)), length)
            lang = b.column(0).take(pa.array(row))
            done = np.append(0, np.cumsum(length[row]))
            a = 0
            while a < len(row):
                z = max(a + 1, int(np.searchsorted(done, done[a] + PAIRS, side="right")) - 1)
                many = length[row[a:z]]
                i = np.repeat(np.arange(a, z), many)
                j = np.repeat(ends[row[a:z]] - np.append(0, np.cumsum(many)[:-1]), many) + np.arange(many.sum())
                if (other := i != j).any():
                    yield sums(lang, source, i[other], j[other], p, p0)
                a = z

    return postings.mapInArrow(run, "lang string, source string, item string, value long")


def offsets_of(lists: pa.Array) -> np.ndarray:
    """Places of the lists in their flattened values, from 0."""
    ends = lists.offsets.to_numpy().astype(np.int64)
    return ends - ends[0]


def _pairs(groups: DataFrame, shares: DataFrame, postings: DataFrame) -> DataFrame:
    """(lang, source, item, value, rank): all other sources of a language by the sum of divergences over all its terms."""
    each = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), "terms", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))).alias("slice"))
    slice_of = lambda *c: F.pmod(F.xxhash64(*c), F.lit(SLICES)).cast("int").alias("slice")
    empty = groups.select("lang", "source", "p0", slice_of("source")).join(each, ["lang", "slice"]).filter("source <> item")
    empty = empty.select("lang", "source", "item", F.when(F.col("terms") > 0, F.col("terms") * apart(F.col("p0"), F.col("q0"))).otherwise(0).alias("value"))
    counts = shares.groupBy("lang", "source", "p", "p0").agg(F.count(F.lit(1)).alias("n")).select("*", slice_of("source", "p"))
    one = counts.join(each, ["lang", "slice"]).filter("source <> item")
    p, p0, q0, n = (F.col(c) for c in ("p", "p0", "q0", "n"))
    one = one.groupBy("lang", "source", "item").agg(F.sum(n * (apart(p, q0) - apart(p0, q0))).alias("here"), F.sum(n * (apart(q0, p) - apart(q0, p0))).alias("there"))
    both = F.explode(F.array(F.struct("source", "item", F.col("here").alias("value")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), F.col("there").alias("value"))))
    one = one.select("lang", both.alias("v")).select("lang", "v.*")
    total = empty.unionByName(one).unionByName(_met(postings)).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    order = W.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    return total.withColumn("rank", F.row_number().over(order))


def audited(docs: DataFrame, most: int = BEST, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, part, item, value, rank): every other source of a group's language (part pair) and the group's terms that stand out from the language (part term, at most `most`).

    Null lang, source and text are ''. A row is a document, repeated rows and null doc_ids too. A language without kept terms has pairs of
    value 0 and no terms; ties are ranked by item in UTF-8 order; very long texts count whole; other columns, whatever
    their names, do not pass; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    d = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    with small_batches(spark):
        sums = counted(d).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        terms = sums.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("postings"))
        terms = written(terms.filter(F.col("docs") >= least_docs).select("lang", "term", "n", "postings"), "terms")
        held = terms.select("lang", "term", F.col("n").alias("lang_n"), F.inline("postings"))
        langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("lang_total"))
        totals = held.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("held"))
        groups = d.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "held", "terms", "lang_total"])
        groups = written(groups.withColumn("p0", share(F.lit(0).cast("long"), F.col("total"), F.col("terms"))), "groups")
        p, q = share(F.col("n"), F.col("total"), F.col("terms")), share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
        shares = held.join(groups, ["lang", "source"]).select("lang", "source", "term", p.alias("p"), "p0", q.alias("q"), "held")
        lists = shares.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("postings")).select("lang", "postings")
        part = lambda df, name: df.select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank")
        return written(part(_pairs(groups, shares, lists), "pair").unionByName(part(_searched(shares, most), "term")), "divergence")


SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
 t AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
 x AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM t GROUP BY 1, 2, 3),
 k AS (SELECT lang, term, sum(n) AS n FROM x GROUP BY 1, 2 HAVING sum(docs) >= {LEAST_DOCS}),
 l AS (SELECT lang, count(*) AS terms, sum(n) AS total FROM k GROUP BY 1),
 g AS (SELECT DISTINCT lang, source FROM d),
 c AS (SELECT g.lang, g.source, k.term, coalesce(x.n, 0) AS n, k.n AS lang_n FROM g JOIN k ON g.lang = k.lang LEFT JOIN x ON x.lang = g.lang AND x.source = g.source AND x.term = k.term),
 s AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY 1, 2),
 p AS (SELECT c.lang, c.source, c.term, c.n, 1 + (CAST({UNIT} AS HUGEINT) * (c.n + 1)) // CAST(s.total + l.terms AS HUGEINT) AS p, 1 + (CAST({UNIT} AS HUGEINT) * (c.lang_n + 1)) // CAST(l.total + l.terms AS HUGEINT) AS q
  FROM c JOIN s ON c.lang = s.lang AND c.source = s.source JOIN l ON c.lang = l.lang),
 a AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
 o AS (SELECT a.lang, a.source, b.source AS item FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
 u AS (SELECT o.lang, o.source, 'pair' AS part, o.item, CAST(coalesce(a.value, 0) AS BIGINT) AS value FROM o LEFT JOIN a ON o.lang = a.lang AND o.source = a.source AND o.item = a.item
  UNION ALL SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // q AS BIGINT) FROM p WHERE n > 0 AND p > q),
 z AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM u)
 SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM z WHERE part = 'pair' OR rank <= {BEST}"""
