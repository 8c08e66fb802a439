"""The source audit, the line-first rules and the spelling variants against brute force, edge rows included."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from panelforge.llm import divergence, rules, variants

KIND = "doc_id long, text string, lang string, source string, n_chars long, n long, word string, part string"


@pytest.fixture(scope="module")
def rows():
    """Documents of made-up words with slips, repeats, menus and notices; null, empty, white, very long and repeated rows, a null id."""
    random.seed(9)
    words = ["".join(random.choice("aeinrstéÜ") for _ in range(random.randrange(3, 9))) for _ in range(60)]
    words += ["Stone", "stones", "stony", "STORY", "store", "naïve", "naive", "éé×÷ü"]

    def line():
        out = " ".join(random.choice(words) for _ in range(random.randrange(3, 30)))
        return random.choice([out + ".", out + ".", out + "!", out, out.replace(" ", " | "), out.replace(" ", "!! ") + ".", "Home | About us", "All rights reserved."])

    docs = []
    for i in range(120):
        text = "\n".join(line() for _ in range(random.randrange(1, 8)))
        if i % 9 == 0:
            text += "\n" + text
        docs.append((i, text, random.choice(["en", "en", "de", None]), random.choice(["s0", "s0", "s0", "s1", "s2", ""])))
    long = " ".join(random.choice(words) for _ in range(30_000)) + "."
    docs += [(200, None, "en", "s0"), (201, "", "de", None), (202, " \n\t \x0b", "en", "s3"), (203, long, "en", "s0"), (204, "1 2 3", "xx", "s0"), (206, "wordaa " * 3 + "wordab " * 8 + "wordbb " * 20, "en", "s0"), (205, None, "yy", "s9"), (None, "stone stones .", "en", "s1"), (7, docs[7][1], docs[7][2], docs[7][3]), (7, docs[7][1], docs[7][2], docs[7][3])]
    return [(*d, None, i, "x", "y") for i, d in enumerate(docs)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, KIND)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def ascii_lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def audit(rows, most=200, least=3):
    term = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    count, docs, groups = Counter(), defaultdict(set), set()
    for i, r in enumerate(rows):
        lang, source = r[2] or "", r[3] or ""
        groups.add((lang, source))
        for t in term.findall(r[1] or ""):
            count[lang, source, ascii_lower(t)] += 1
            docs[lang, ascii_lower(t)].add(i)
    out = set()
    for lang in {g[0] for g in groups}:
        kept = sorted(t for (l, t), d in docs.items() if l == lang and len(d) >= least)
        sources = sorted(s for l, s in groups if l == lang)
        total = {t: sum(count[lang, s, t] for s in sources) for t in kept}
        share = lambda c: {t: 1 + 10**9 * (c(t) + 1) // (sum(map(c, kept)) + len(kept)) for t in kept}
        p, q = {s: share(lambda t, s=s: count[lang, s, t]) for s in sources}, share(lambda t: total[t])
        for s in sources:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources if o != s]
            terms = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if count[lang, s, t] and p[s][t] > q[t]]
            for part, found, top in (("pair", pairs, None), ("term", terms, most)):
                order = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:top]
                out |= {(lang, s, part, item, value, k) for k, (value, item) in enumerate(order, 1)}
    return out


@pytest.mark.parametrize(("most", "part_terms", "pairs"), [(200, 1 << 14, 1 << 20), (4, 3, 5)])
def test_audit_equals_exact_arithmetic(docs, rows, monkeypatch, most, part_terms, pairs):
    monkeypatch.setattr(divergence, "PART_TERMS", part_terms)
    monkeypatch.setattr(divergence, "PAIRS", pairs)
    monkeypatch.setattr(divergence, "COUNT_BYTES", 5000)
    got = [tuple(r) for r in divergence.audited(docs, most).collect()]
    assert len(got) == len(set(got)) and set(got) == audit(rows, most)


def test_best_first_search_stops_early_and_keeps_ties():
    rng = np.random.default_rng(4)
    for _ in range(200):
        n = int(rng.integers(1, 300))
        q = rng.integers(1, 50, n) * 1000
        p = q + rng.integers(1, 40, n) * 1000
        at, value, seen = divergence.best_first(p, q, 10)
        f = (p - q) ** 2 // q
        last = np.sort(f)[::-1][min(10, n) - 1]
        assert sorted(at) == sorted(np.flatnonzero(f >= last)) and (value == f[at]).all()
        assert seen <= len(np.unique(p))
    p = np.repeat([10**9, 2000], [10, 5000])
    assert divergence.best_first(p, np.full(5010, 1000), 10)[2] == 1


def test_large_counts_are_shared_exactly(spark):
    got = spark.createDataFrame([(3_999_999_999, 10**13, 7), (4 * 10**12, 10**13, 7), (0, 0, 0)], "c long, t long, v long").select(divergence.share(*map(lambda c: __import__("pyspark.sql.functions").sql.functions.col(c), "ctv")).alias("p")).collect()
    assert [r["p"] for r in got] == [1 + 10**9 * (c + 1) // (10**13 + 7) for c in (3_999_999_999, 4 * 10**12)] + [None]


def judge(text):
    text = text or ""
    ws = words_of(text)
    windows = defaultdict(list)
    for i in range(len(ws) - 7):
        windows[tuple(ws[i : i + 8])].append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    lines = [l for l in text.split("\n") if words_of(l)]
    dup = sum(l in set(lines[:i]) for i, l in enumerate(lines))
    bad = []
    for l in lines:
        n = len(words_of(l))
        many = lambda p: len(re.findall(p, l)) * 4 > n  # noqa: B023, E731
        short = len(l) <= rules.NOTICE_CHARS and (bool(re.search(rules.NOTICE, l)) or (n <= rules.MENU_WORDS and bool(re.search(rules.MENU_LINE, l))))
        bad.append(not re.search(rules.SENTENCE_END, l[-16:]) or many(rules.SYMBOL) or many(rules.SHOUT) or many(rules.SEPARATOR) or short)
    kept = [l for l, b in zip(lines, bad) if not b]
    size, left = sum(map(len, lines)), sum(map(len, kept))
    failed = len(ws) < 20 or 100 * len(covered) > 30 * len(ws)
    return (len(ws), sum(map(len, ws)), len(re.findall(rules.SYMBOL, text)), dup, len(covered), failed, not failed and (size - left) * 100 <= size * rules.MOST_LOST, len(lines), len(kept), size, left, hashlib.sha256("\n".join(kept).encode()).hexdigest())


def test_rules_equal_a_loop(docs, rows):
    got = sorted(map(str, (tuple(r) for r in rules.judged(docs).collect())))
    assert got == sorted(str((r[0], *judge(r[1]))) for r in rows)
    verdicts = [judge(r[1]) for r in rows]
    assert {v[6] for v in verdicts} == {True, False} and any(v[4] for v in verdicts) and any(v[3] for v in verdicts)


def test_cleaned_documents_lose_lines_and_keep_columns(docs, rows):
    got = rules.cleaned(docs)
    assert got.columns == docs.columns
    want = Counter((r[0], "\n".join(l for l in r[1].split("\n") if words_of(l) and judge(l)[8])) for r in rows if judge(r[1])[6])
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == want


def test_rules_have_no_python_and_no_exchange(docs):
    plan = rules.judged(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def group(rows):
    count = Counter()
    for r in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r[1] or ""):
            run = ascii_lower(run)
            h = zlib.crc32(f"{'' if r[0] is None else r[0]}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    n = {w: k for w, k in count.items() if len(w) >= 5 and k >= 3}
    form, links = {}, {}
    for w in n:
        close = [v for v in n if near(w, v)]
        best = min(close, key=lambda v: (-n[v], v), default=None)
        links[w] = len(close)
        form[w] = best if best and n[best] >= 2 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, form[w], root(w), n[w], links[w], n[form[w]] if form[w] else None) for w in n}


@pytest.mark.parametrize("bucket", [64, 1])
def test_variants_equal_all_pairs(docs, rows, monkeypatch, bucket):
    monkeypatch.setattr(variants, "BUCKET_WORDS", bucket)
    got = [tuple(r) for r in variants.grouped(docs).collect()]
    want = group(rows)
    assert len(got) == len(set(got)) and set(got) == want
    assert any(r[1] for r in want) and any(r[1] and r[2] != r[1] for r in want)


@pytest.mark.parametrize("bucket", [64, 2])
def test_near_pairs_are_whole_over_dense_words(spark, monkeypatch, bucket):
    """Words of few letters, most of them neighbours, accents and repeated letters among them."""
    monkeypatch.setattr(variants, "BUCKET_WORDS", bucket)
    random.seed(3)
    words = sorted({"".join(random.choice("aabé×") for _ in range(random.randrange(5, 9))) for _ in range(150)})
    got = variants.near_pairs(spark.createDataFrame([(w, 3) for w in words], "word string, n long")).collect()
    pairs = [tuple(sorted((r["a"], r["b"]))) for r in got]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(a, b) for a in words for b in words if a < b and near(a, b)}


def test_roots_follow_long_chains(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(37)] + [("x", "w5")]
    got = dict(map(tuple, variants.roots(spark.createDataFrame(chain, "word string, form string")).collect()))
    assert got == {w: "w37" for w, _ in chain}


@pytest.mark.parametrize("operator", [divergence.audited, rules.judged, variants.grouped, rules.cleaned])
def test_empty_tables_and_plain_nulls(spark, operator):
    assert operator(spark.createDataFrame([], KIND)).collect() == []
    nulls = spark.createDataFrame([(None,) * 8] * 3, KIND)
    assert len(operator(nulls).collect()) == (3 if operator is rules.judged else 0)


@pytest.mark.parametrize(("name", "operator"), [("divergence", divergence), ("rules", rules), ("variants", variants)])
def test_sql_gives_the_same_rows(docs, rows, name, operator):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", [r[:4] for r in rows])
    got = {"divergence": divergence.audited, "rules": rules.judged, "variants": variants.grouped}[name](docs)
    cur = con.execute(operator.SQL)
    names = [c[0] for c in cur.description]
    want = sorted(str(tuple(r[names.index(c)] for c in got.columns)) for r in cur.fetchall())
    assert sorted(str(tuple(r)) for r in got.collect()) == want
