"""Column expressions shared by all operators: keys, safe arithmetic, missing values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def missing_as_null(c: str | Column) -> Column:
    """NaN is missing: null."""
    return F.when(F.isnan(col(c)), None).otherwise(col(c))


def to_number(c: str | Column) -> Column:
    """Text to double; what is no number, and NaN, is null."""
    return missing_as_null(col(c).try_cast("double"))


def date_key(c: str | Column) -> Column:
    """YYYYMMDD text: dashes dropped, first eight characters."""
    return F.substring(F.regexp_replace(col(c).cast("string"), "-", ""), 1, 8)


def code_key(c: str | Column, width: int = 6) -> Column:
    """Upper case, before the first dot, zero-padded (never cut)."""
    head = F.substring_index(F.upper(col(c).cast("string")), ".", 1)
    return F.when(F.length(head) >= width, head).otherwise(F.lpad(head, width, "0"))


def safe_ratio(a: str | Column, b: str | Column) -> Column:
    """a / b; null where b is 0 or either is null."""
    return F.when(col(b) != 0, col(a) / col(b))


def corr(x: str | Column, y: str | Column, over=None, flat=None) -> Column:
    """Pearson correlation of the rows that have both, over a window or a group; `flat` (null) where one side does not vary: Spark's own raises there."""
    both = col(x).isNotNull() & col(y).isNotNull()
    a, b = F.when(both, col(x).cast("double")), F.when(both, col(y).cast("double"))
    of = (lambda c: c.over(over)) if over is not None else (lambda c: c)
    cov, sd = of(F.covar_pop(a, b)), F.sqrt(of(F.var_pop(a)) * of(F.var_pop(b)))
    return F.when(sd != 0, cov / sd).when(cov.isNotNull(), F.lit(flat).cast("double"))


def clip(c: str | Column, low, high) -> Column:
    """Between low and high; null stays null (least and greatest alone would skip it)."""
    x = col(c)
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.when(x.isNotNull(), F.least(F.greatest(x, low), high))


def truth(c: Column) -> Column:
    """A comparison with a missing value is false."""
    return F.coalesce(c, F.lit(False))


def mean_of_available(*cs: str | Column) -> Column:
    """Row mean of the columns that are not null; null if none is."""
    xs = [col(c) for c in cs]
    n = reduce(lambda a, b: a + b, [F.when(x.isNotNull(), 1).otherwise(0) for x in xs])
    total = reduce(lambda a, b: a + b, [F.coalesce(x.cast("double"), F.lit(0.0)) for x in xs])
    return F.when(n > 0, total / n)


def weighted_mean_of_available(pairs: list[tuple[str | Column, float]]) -> Column:
    """Sum of weight x value over the weights' magnitudes, of the values that are not null."""
    total = reduce(lambda a, b: a + b, [F.coalesce(col(c), F.lit(0.0)) * w for c, w in pairs])
    weight = reduce(lambda a, b: a + b, [F.when(col(c).isNotNull(), abs(w)).otherwise(0.0) for c, w in pairs])
    return F.when(weight > 0, total / weight)


def first_reason(rules: list[tuple[Column, str]]) -> Column:
    """The name of the first rule that holds, null if none does."""
    out = F.lit(None).cast("string")
    for test, name in reversed(rules):
        out = F.when(truth(test), name).otherwise(out)
    return out


def cn_number(c: str | Column) -> Column:
    """Numbers with Chinese units (fixed values: 万 1e4, 亿 1e8, 万亿 1e12), signs and thousands separators, as decimal; null if there is none."""
    x = F.regexp_replace(col(c), "[,，\\s]", "")
    digits = F.regexp_extract(x, "([-+]?[0-9]+(?:\\.[0-9]+)?)", 1)
    unit = F.regexp_extract(x, "[0-9](万亿|亿|万)", 1)
    scale = F.when(unit == "万亿", 10**12).when(unit == "亿", 10**8).when(unit == "万", 10**4).otherwise(1).cast("decimal(20,0)")
    number = F.when(digits != "", digits.try_cast("decimal(18,6)") * scale)
    return F.when(x.rlike("^(亏损|减少|下降|负)"), -F.abs(number)).otherwise(number)


def cn_percent(c: str | Column) -> Column:
    """A percentage as a fraction."""
    return F.when(col(c).rlike("[%％]"), cn_number(F.regexp_replace(col(c), "[%％].*$", "")).cast("double") / 100)


#: Full-width forms from U+FF01 on stand for ASCII from U+0021 on; the ideographic space for a space.
FULL_WIDTH = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
HALF_WIDTH = "".join(chr(c) for c in range(0x21, 0x7F)) + " "


def half_width(c: str | Column) -> Column:
    return F.translate(col(c), FULL_WIDTH, HALF_WIDTH)


def title_key(title: str | Column, issuer: str | Column | None = None) -> Column:
    """Announcement title for comparison: full-width forms folded, `issuer:` prefix, punctuation and space dropped, lower case."""
    x = half_width(title)
    if issuer is not None:
        name = half_width(issuer)
        x = F.when(F.startswith(x, F.concat(name, F.lit(":"))), x.substr(F.length(name) + 2, F.length(x))).otherwise(x)
    return F.lower(F.regexp_replace(x, "[\\p{P}\\p{S}\\s]", ""))


def unique_place(text: str | Column, quote: str | Column) -> Column:
    """0-based place of the quote if it occurs exactly once, else null."""
    first = F.instr(col(text), col(quote))
    again = F.position(col(quote), col(text), first + 1)
    return F.when((first > 0) & (again == 0), first - 1)


def relocated(text: str | Column, quote: str | Column, ignore_space: bool = False) -> Column:
    """struct(start, end, source) of the one place in the raw text that a quote stands for, null if there is none or more than one.

    Text and quote are compared with line ends as line feeds and full-width forms folded (and white space left out); places are code
    points of the raw text, end exclusive, and source is what stands there. For the way back CR LF pairs become a CR, which makes
    a text of the compared one's length: a compared place lies as many characters further on as there are CRs before it.
    """
    raw = col(text)
    paired = F.replace(F.regexp_replace(raw, "\\r(?!\\n)", "\n"), F.lit("\r\n"), F.lit("\r"))
    folded = lambda c: half_width(F.regexp_replace(c, "\\r\\n?", "\n"))
    tight = lambda c: F.regexp_replace(folded(c), "\\s", "") if ignore_space else folded(c)
    wanted = tight(col(quote))
    at = unique_place(tight(raw), wanted)

    def offset(pairs: Column, n: Column) -> Column:
        return n + F.length(F.substring(pairs, F.lit(1), n)) - F.length(F.replace(F.substring(pairs, F.lit(1), n), F.lit("\r"), F.lit("")))

    def struct(first: Column, last: Column, pairs: Column) -> Column:
        start, end = offset(pairs, first), offset(pairs, last)
        return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), F.substring(raw, start + 1, end - start).alias("source"))

    def place(x: Column) -> Column:
        if not ignore_space:
            return struct(x["at"], x["at"] + F.length(x["wanted"]), x["pairs"])
        seen = F.filter(F.transform(F.split(x["pairs"], ""), lambda c, i: F.when(~half_width(c).rlike("\\s") & (c != ""), i)), lambda i: i.isNotNull())
        return F.transform(F.array(seen), lambda k: struct(F.get(k, x["at"]), F.get(k, x["at"] + F.length(x["wanted"]) - 1) + 1, x["pairs"]))[0]

    held = F.struct(at.alias("at"), wanted.alias("wanted"), paired.alias("pairs"))
    return F.transform(F.array(held), lambda x: F.when(x["at"].isNotNull() & (F.length(x["wanted"]) > 0), place(x)))[0]
