"""Spelling variants: words one edit apart, by bands of letter parities.

A word's mask holds a bit a letter, set if the letter stands in it an odd number of times. One inserted or deleted character
flips a bit, a replaced one at most two, so of three bands of the mask one is left as it was: words meet in
an equal band at lengths that differ by at most one, and what meets is verified by edit distance. A pair is taken in
the first band that its words share. A band bucket of more than BUCKET_WORDS words is met by halves as well: one edit leaves
the first or the second half of the shorter word whole, so no pair is lost and no bucket is met whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm.shared import written

RUN, LEAST_CHARS, LEAST_COUNT, SLIP = r"[A-Za-zÀ-ÿ]+", 5, 3, 97
#: A form is taken if it is so many times as frequent as the word.
TIMES = 2
#: Letters dealt to bands in turn, frequent ones first, so that bands tell words apart about equally; others follow by code point.
LETTERS, BANDS = "etaoinsrhldcumfpgwybvkxjqz", 3
#: Words of a band bucket that meet without their halves.
BUCKET_WORDS = 64
A_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and nothing else."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, A_Z, A_Z.lower()))


def slipped(doc_id: Column, run: Column) -> Column:
    """The run, without one character where the crc32 of `doc_id:run` is a multiple of SLIP."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = F.pmod(h, F.length(run)).cast("int")
    return F.when(h % SLIP == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): words of at least LEAST_CHARS code points that occur LEAST_COUNT times or more."""
    long = RUN.removesuffix("+") + f"{{{LEAST_CHARS},}}"  # a slip only shortens a run
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(long), F.lit(0))).alias("run"))
    words = runs.select("doc_id", lower_ascii(F.col("run")).alias("run")).select(slipped(F.col("doc_id"), F.col("run")).alias("word"))
    return words.filter(F.length("word") >= LEAST_CHARS).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_COUNT)


def band(word: Column, number: int) -> Column:
    """Band `number` of the mask: parities of every BANDS-th letter."""
    place = lambda c: F.when(F.instr(F.lit(LETTERS), c) > 0, F.instr(F.lit(LETTERS), c) - 1).otherwise(len(LETTERS) + F.pmod(F.ascii(c), F.lit(64)))
    flip = lambda m, c: F.when(place(c) % BANDS == number, m.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.floor(place(c) / BANDS).cast("int")))).otherwise(m)
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), flip)


def half(word: Column, base: Column, side: Column) -> Column:
    """The first (side 0) or second half of a word that is compared with words of `base` code points or one more."""
    h = F.floor(base / 2).cast("int")
    return F.when(side == 0, F.substring(word, F.lit(1), h)).otherwise(F.right(word, (base - h).cast("int")))


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b): every two words of (word, n) that differ by one inserted, deleted or replaced code point, once; words are distinct."""
    masked = written(words.withColumns({f"m{i}": band(F.col("word"), i) for i in range(BANDS)}).withColumn("chars", F.length("word")), "masks")
    masks = F.array(*[f"m{i}" for i in range(BANDS)])
    one = lambda base: F.struct(base.cast("int").alias("base"))
    left = masked.select("*", F.posexplode(masks).alias("band", "value"), F.col("chars").alias("base"))
    right = masked.select("*", F.posexplode(masks).alias("band", "value")).select("*", F.inline(F.array(one(F.col("chars")), one(F.col("chars") - 1))))
    key = ["band", "value", "base"]
    large = written(right.groupBy(*key).agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > BUCKET_WORDS).select(*key, F.lit(True).alias("large")), "buckets")

    def keyed(side: DataFrame) -> DataFrame:
        marked = side.join(large, key, "left")
        halves = F.when(F.col("large"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(-1)))
        marked = marked.withColumn("side", F.explode(halves))
        return marked.withColumn("half", F.when(F.col("side") >= 0, half(F.col("word"), F.col("base"), F.col("side"))).otherwise(F.lit(""))).drop("large", "chars")

    on = [*key, "side", "half"]
    a = keyed(left).select(*on, F.col("word").alias("a"), F.col("n").alias("n_a"), *[F.col(f"m{i}").alias(f"a{i}") for i in range(BANDS)])
    b = keyed(right).select(*on, F.col("word").alias("b"), F.col("n").alias("n_b"), *[F.col(f"m{i}").alias(f"b{i}") for i in range(BANDS)])
    once = (F.length("b") > F.length("a")) | (F.col("a") < F.col("b"))
    flips = sum(F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))) for i in range(BANDS))
    first = F.col("band") == F.coalesce(*[F.when(F.col(f"a{i}") == F.col(f"b{i}"), i) for i in range(BANDS)])
    fresh = (F.col("side") < 1) | (half(F.col("a"), F.col("base"), F.lit(0)) != half(F.col("b"), F.col("base"), F.lit(0)))
    met = a.join(b, on).filter(once & (flips <= 2) & first & fresh)
    return met.filter(F.levenshtein("a", "b", 1) == 1).select("a", "b", "n_a", "n_b")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms followed to the last by doubling. A form is more frequent than its word, so chains end, after as many doublings as their length has bits."""
    at = written(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while at.filter("moved").limit(1).count():
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = written(at.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
    return at.select("word", "root")


def grouped(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the vocabulary.

    Null texts hold no words and null doc_ids stand for an empty id; repeated rows count again; among near words of the same n the
    smallest in code-point order is the form; very long texts count whole; other columns, whatever their names, do not
    pass; an empty table gives an empty result.
    """
    words = written(vocabulary(docs.select("doc_id", "text")), "words")
    pairs = near_pairs(words)
    seen = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n"))))
    best = pairs.select(seen.alias("p")).select("p.*").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    is_form = -F.col("best.less") >= TIMES * F.col("n")
    out = written(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")), "forms")
    last = roots(out.filter("form is not null").select("word", "form"))
    return out.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


SQL = f"""WITH RECURSIVE step AS (SELECT n, n AS c, 0 AS k FROM range(256) AS r(n) UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM step WHERE k < 8),
 tab AS (SELECT list(c ORDER BY n) AS t FROM step WHERE k = 8),
 r AS (SELECT doc_id, translate(run, '{A_Z}', '{A_Z.lower()}') AS run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '{RUN}')) AS run FROM documents) AS x GROUP BY 1, 2),
 b AS (SELECT run, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM r WHERE length(run) >= {LEAST_CHARS}),
 h AS (SELECT run, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, CAST(length(x) / 2 AS BIGINT)), lambda i: CAST(('0x' || substr(x, 2 * i + 1, 2)) AS BIGINT))), lambda a, c: xor(a >> 8, CAST(t[1 + (xor(a, c) & 255)] AS BIGINT))), 4294967295) AS h FROM b, tab),
 v AS (SELECT CASE WHEN h % {SLIP} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
 w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM v WHERE length(word) >= {LEAST_CHARS} GROUP BY 1 HAVING sum(n) >= {LEAST_COUNT}),
 e AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w) AS y),
 l AS (SELECT e.word AS a, w.word AS b FROM e JOIN w ON e.d = w.word),
 p AS (SELECT a, b FROM l UNION SELECT b, a FROM l UNION SELECT x.word, y.word FROM e x JOIN e y ON x.i = y.i AND x.d = y.d AND x.word <> y.word),
 q AS (SELECT p.a AS word, p.b AS near, w.n, row_number() OVER (PARTITION BY p.a ORDER BY w.n DESC, p.b) AS place, count(*) OVER (PARTITION BY p.a) AS n_near FROM p JOIN w ON p.b = w.word),
 f AS (SELECT w.word, w.n, coalesce(q.n_near, 0) AS n_near, CASE WHEN q.n >= {TIMES} * w.n THEN q.near END AS form, CASE WHEN q.n >= {TIMES} * w.n THEN q.n END AS form_n FROM w LEFT JOIN q ON w.word = q.word AND q.place = 1),
 o AS (SELECT word, coalesce(form, word) AS at, form IS NULL AS over FROM f UNION ALL SELECT o.word, coalesce(f.form, f.word), f.form IS NULL FROM o JOIN f ON o.at = f.word WHERE NOT o.over)
 SELECT f.word, form, o.at AS root, f.n, n_near, form_n FROM f JOIN o ON f.word = o.word AND o.over"""
