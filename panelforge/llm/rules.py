"""Quality rules, line first: lines that fail go, then texts that lose too much are rejected.

All of it is column expressions over one row, so a text never leaves the row it was read in: no shuffle,
no Python. A line is a piece between line feeds that holds a word; a word is a run of characters other than space
and U+0009 to U+000D. A line fails one of three kinds of rules:

- punctuation: it does not end a sentence, or symbols or shouted endings stand for too many of its words;
- navigation: separators part its words, or it is a short line of menu words;
- boilerplate: licence, cookie, script and rights notices.

Repeated eight-word windows are found by their hashes; where two are equal, the windows of that text are sorted and their words compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD, WINDOW = r"[^\x20\x09-\x0D]+", 8
WHITE = " \t\n\x0b\x0c\r"
SYMBOL, SEPARATOR, SHOUT = r"[#*$%&|<>]", r"[|»›·•]", r"[!?][!?]"
#: Texts of fewer words fail, and those of which repeated windows hold more than so many words in a hundred.
LEAST_WORDS, MOST_REPEATED = 20, 30
#: A line may have a symbol or a doubled mark for every so many words; separators part one in so many words; menu lines are this short.
WORDS_A_SYMBOL, WORDS_A_SEPARATOR, MENU_WORDS = 4, 4, 6
#: Notices and menus are lines of at most so many characters.
NOTICE_CHARS = 240
#: Texts that lose more than so many in a hundred characters of their lines are rejected.
MOST_LOST = 40
#: Ends of sentences, closing marks behind them, looked for in so many last characters of a line.
TAIL = 16
SENTENCE_END = r"[.!?…。！？][\"'”’»)\]]*[\x20\x09-\x0D]*$"
#: Words of menus and phrases of notices, lower case.
MENU = "home|menu|login|log in|sign in|sign up|register|next|previous|back|search|contact|about us|site map|sitemap|share|print|more"
NOTICES = "all rights reserved|licensed under|released under the|general public license|creative commons|cookie policy|uses cookies|accept cookies|enable javascript|privacy policy|terms of (use|service)|lorem ipsum"
MENU_LINE = rf"(?i)^[\x20\x09-\x0D]*({MENU})([\x20\x09-\x0D|,/>-]+({MENU}))*[\x20\x09-\x0D.]*$"
NOTICE = f"(?i)({NOTICES})"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once a row however often body names it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return let(F.trim(text, F.lit(WHITE)), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, f"[{WHITE}]+")))


def repeated_words(words: Column) -> Column:
    """Words of the 8-word windows that the text holds twice or more, the first ones included; overlapping windows count a word once.

    Windows are hashed first; only a text in which two hashes are equal has its windows sorted and compared.
    """
    starts = lambda ws: F.sequence(F.lit(0), F.size(ws) - WINDOW)
    at = lambda ws, i: F.slice(ws, i + 1, WINDOW)

    def same(a: Column, b: Column) -> Column:
        return (a["h"] == b["h"]) & (a["w"] == b["w"])

    def hits(found: Column) -> Column:
        left = lambda x, i: (i > 0) & same(x, F.get(found, i - 1))
        right = lambda x, i: (i < F.size(found) - 1) & same(x, F.get(found, i + 1))
        return F.sort_array(F.transform(F.filter(found, lambda x, i: left(x, i) | right(x, i)), lambda x: x["at"]))

    def covered(places: Column) -> Column:
        step = lambda a, p: F.struct((p + WINDOW).alias("end"), (a["total"] + F.least(F.lit(WINDOW), p + WINDOW - a["end"])).alias("total"))
        return F.aggregate(places, F.struct(F.lit(0).alias("end"), F.lit(0).alias("total")), step, lambda a: a["total"])

    hashes = lambda ws: F.transform(starts(ws), lambda i: F.xxhash64(*[F.get(ws, i + j) for j in range(WINDOW)]))
    windows = lambda ws, hs: F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), at(ws, i).alias("w"), i.alias("at"))))
    some = lambda ws, hs: F.when(F.size(F.array_distinct(hs)) < F.size(hs), let(windows(ws, hs), lambda found: covered(hits(found)))).otherwise(0)
    return let(words, lambda ws: F.when(F.size(ws) > WINDOW, let(hashes(ws), lambda hs: some(ws, hs))).otherwise(0)).cast("long")


def fails(line: Column) -> Column:
    """Whether a line fails a rule; counts are taken where a line has anything to count."""
    n = F.regexp_count(line, F.lit(WORD))
    many = lambda pattern, words: F.regexp_count(line, F.lit(pattern)) * words > n
    marked = line.rlike(f"{SYMBOL}|{SHOUT}|{SEPARATOR}") & (many(SYMBOL, WORDS_A_SYMBOL) | many(SHOUT, WORDS_A_SYMBOL) | many(SEPARATOR, WORDS_A_SEPARATOR))
    short = (F.length(line) <= NOTICE_CHARS) & (line.rlike(NOTICE) | (line.rlike(MENU_LINE) & (n <= MENU_WORDS)))
    return ~F.right(line, F.lit(TAIL)).rlike(SENTENCE_END) | marked | short


def measured(docs: DataFrame) -> DataFrame:
    """docs with a struct column __m of what the rules measure: counts, the lines and the lines that stay."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda l: l.rlike(WORD))
    of = lambda words, kept: lambda ls: F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
        repeated_words(words).alias("n_repeat_words"),
        F.size(ls).cast("long").alias("n_lines"),
        F.size(kept).cast("long").alias("n_kept_lines"),
        F.aggregate(ls, F.lit(0).cast("long"), lambda a, l: a + F.length(l)).alias("line_chars"),
        F.aggregate(kept, F.lit(0).cast("long"), lambda a, l: a + F.length(l)).alias("kept_chars"),
        F.concat_ws("\n", kept).alias("cleaned"),
    )
    whole = let(words_of(text), lambda ws: let(lines, lambda ls: let(F.filter(ls, lambda l: ~fails(l)), lambda kept: of(ws, kept)(ls))))
    return docs.withColumn("__m", whole)


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < LEAST_WORDS) | (n_repeat_words * 100 > n_words * MOST_REPEATED)


def judged(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines, n_kept_lines, line_chars, kept_chars, cleaned_sha256) of every row.

    kept: base_failed is false and the failing lines hold at most MOST_LOST in a hundred characters of all lines. Null and empty
    texts have no word: all counts 0, base_failed, not kept, cleaned text empty. Repeated rows and null doc_ids are rows of
    their own; a very long text is handled whole in its row; other columns, whatever their names, do not pass; an
    empty table gives an empty result.
    """
    m = measured(docs.select("doc_id", "text")).select("doc_id", "__m.*")
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    lost = (F.col("line_chars") - F.col("kept_chars")) * 100 > F.col("line_chars") * MOST_LOST
    out = m.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~lost).withColumn("cleaned_sha256", F.sha2("cleaned", 256))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_kept_lines", "line_chars", "kept_chars", "cleaned_sha256")


def cleaned(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with the lines that fail taken out of their texts; all columns stay."""
    m = measured(docs)
    lost = (F.col("__m.line_chars") - F.col("__m.kept_chars")) * 100 > F.col("__m.line_chars") * MOST_LOST
    kept = m.filter(~base_failed(F.col("__m.n_words"), F.col("__m.n_repeat_words")) & ~lost)
    return kept.withColumn("text", F.col("__m.cleaned")).drop("__m")


def _sql() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    count = lambda of, pattern: f"len(regexp_extract_all({of}, {q(pattern)}))"
    fail = f"""NOT regexp_matches(right(l, {TAIL}), {q(SENTENCE_END)}) OR {count('l', SYMBOL)} * {WORDS_A_SYMBOL} > {count('l', WORD)} OR {count('l', SHOUT)} * {WORDS_A_SYMBOL} > {count('l', WORD)}
 OR {count('l', SEPARATOR)} * {WORDS_A_SEPARATOR} > {count('l', WORD)} OR (length(l) <= {NOTICE_CHARS} AND (({count('l', WORD)} <= {MENU_WORDS} AND regexp_matches(l, {q(MENU_LINE)})) OR regexp_matches(l, {q(NOTICE)})))"""
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
 w AS (SELECT r, doc_id, text, regexp_extract_all(text, {q(WORD)}) AS ws, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, {q(WORD)})) AS ls FROM d),
 p AS (SELECT r, unnest(range(len(ws) - {WINDOW} + 1)) AS i, ws FROM w WHERE len(ws) > {WINDOW}),
 g AS (SELECT r, i, array_to_string(ws[i + 1 : i + {WINDOW}], ' ') AS g FROM p),
 f AS (SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY r, g) AS k FROM g) AS x WHERE k > 1),
 t AS (SELECT r, CAST(sum(least({WINDOW}, i - coalesce(before, i - {WINDOW}))) AS BIGINT) AS n FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM f) AS y GROUP BY r),
 m AS (SELECT doc_id, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars, {count('text', SYMBOL)} AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(t.n, 0) AS n_repeat_words,
  ls, list_filter(ls, lambda l: NOT ({fail})) AS ks FROM w LEFT JOIN t ON w.r = t.r),
 c AS (SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {LEAST_WORDS} OR n_repeat_words * 100 > n_words * {MOST_REPEATED} AS base_failed, len(ls) AS n_lines, len(ks) AS n_kept_lines,
  CAST(coalesce(list_sum(list_transform(ls, lambda x: length(x))), 0) AS BIGINT) AS line_chars, CAST(coalesce(list_sum(list_transform(ks, lambda x: length(x))), 0) AS BIGINT) AS kept_chars, sha256(coalesce(array_to_string(ks, chr(10)), '')) AS cleaned_sha256 FROM m)
 SELECT *, NOT base_failed AND (line_chars - kept_chars) * 100 <= line_chars * {MOST_LOST} AS kept FROM c"""


SQL = _sql()
