"""Training-data operators against brute force on small fixtures, and their defined edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from panelforge.llm import bpe, langid, media, omh, packing, pii, quality, simhash, substrings, warc
from panelforge.llm.components import components

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, bucket string, fp int"


@pytest.fixture(scope="module")
def texts():
    """Copies, near copies, a shared passage, empty, null, one-letter, very long and odd texts."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeilnorstu") for _ in range(rng.randint(1, 9)))
    passage = " ".join(word() for _ in range(40))
    out = [" ".join(word() for _ in range(rng.randint(5, 300))) for _ in range(40)]
    out += [out[3], out[3], out[5] + " x", out[7][:200] + passage, passage + out[9], passage.upper(), None, "", "", " \n\t", "a", "é" * 60, "é" * 61, "aa" * 300, "日本 語\x00z", "<|endoftext|> don't  go\n\n 1.2.3.4", " ".join(word() for _ in range(20000))]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i * 3, t, "en", None, None if t is None else len(t), "x", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(4)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def test_bpe_equals_the_library(docs, texts):
    t = Tokenizer.from_file(PATH)
    got = {r["doc_id"]: r for r in bpe.roundtrip(docs, PATH).collect()}
    for i, s in enumerate(texts):
        ids = t.encode(s or "", add_special_tokens=False).ids
        r = got[i * 3]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_transducer_streams_long_pre_tokens():
    m = bpe.Merges(open(PATH).read())
    t = Tokenizer.from_file(PATH)
    for s in ("a" * 20000, "".join(chr(97 + (i * i + i // 7) % 26) for i in range(30000))):
        assert m.transduce(s.encode()) == t.encode(s, add_special_tokens=False).ids
    assert bpe.Decoder(m).text(np.array([m.ids[b"\xe3"]], "u4")) == "�"


def test_packing(docs, texts):
    t = Tokenizer.from_file(PATH)
    p = packing.pack(docs, PATH, max_tokens=64, documents_per_group=16).toPandas()
    for i, s in enumerate(texts):
        ids = np.array(t.encode(s or "", add_special_tokens=False).ids + [0], "<u4")
        own = p[p.doc_id == i * 3].sort_values("start")
        assert own.start.tolist() == list(range(0, len(ids), 64)) and own.length.sum() == len(ids) == own.doc_tokens.iloc[0]
        assert own.ids_crc32.tolist() == [zlib.crc32(ids[a : a + 64].tobytes()) for a in range(0, len(ids), 64)]
    for _, s in p.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 64


def test_first_fit_decreasing_equals_a_scan():
    """Every piece stands in the bin that a scan over all bins finds."""
    sizes = np.random.default_rng(0).integers(1, 65, 500)
    free, want = [64] * int((sizes == 64).sum()), {}
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = sizes[i]
        at = len(want) if s == 64 else next((j for j, f in enumerate(free) if f >= s), len(free))
        if at == len(free):
            free.append(64)
        free[at] -= s
        want[i] = at
    assert packing.first_fit_decreasing(sizes, 64).tolist() == [want[i] for i in range(500)]


def test_a_repeated_doc_id_spreads_over_groups(spark):
    d = spark.createDataFrame([(7, f"text number {i} " * (i % 9)) for i in range(400)], "doc_id long, text string")
    got = packing.pack(d, PATH, documents_per_group=50).selectExpr("shiftright(sequence_id, 32) AS g").groupBy("g").count().collect()
    assert len(got) == 8 and max(r["count"] for r in got) < 120


def test_order_minhash_edits(docs, texts):
    got = {r["doc_id"]: r for r in omh.edited_likeness(docs).collect()}
    order = sorted(range(len(texts)), reverse=True)
    for k, i in enumerate(order):
        s, nxt = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        n = len(s) // 3
        e = s[: len(s) - n] + nxt[:n]
        r = got[i * 3]
        assert r["n_chars"] == len(s) and r["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        assert r["near_edited"] == omh.likeness(omh.signature(s), omh.signature(e)) and 0 <= r["near_next"] <= 1
    assert got[9]["fingerprint"] == got[120]["fingerprint"]
    assert omh.likeness(omh.signature("abcdefgh" * 40), omh.signature("abcdefgh" * 40)) == 1.0
    near, far = "the cat sat on the mat " * 9, "mat the on sat cat the " * 9
    assert omh.likeness(omh.signature(near), omh.signature(near + "x")) > omh.likeness(omh.signature(near), omh.signature(far))


def omh_plain(s: str) -> list[int]:
    """The signature by loops over whole numbers modulo 2^64."""
    full = 2**64 - 1

    def mix(x):
        x = (x ^ x >> 30) * int(omh.MIX_A) & full
        x = (x ^ x >> 27) * int(omh.MIX_B) & full
        return x ^ x >> 31

    s += "\0" * (omh.K - len(s)) if s else ""
    seen, items = {}, []
    for i in range(len(s) - omh.K + 1):
        h = 0
        for c in s[i : i + omh.K]:
            h = (h * int(omh.STEP) + ord(c) + 1) & full
        h = mix(h)
        nth = seen[h >> 24] = seen.get(h >> 24, -1) + 1
        items.append(mix((h + nth * int(omh.STEP)) & full))
    out = []
    for b in range(omh.BINS):
        least = sorted((g >> 24, i) for i, g in enumerate(items) if g >> 58 == b)[: omh.KEEP]
        t = 0
        for i in sorted(i for _, i in least):
            t = mix((t * int(omh.STEP) + items[i]) & full)
        out.append(t % 65535 + 1 if least else 0)
    return out


def test_order_minhash_signature_against_a_plain_one():
    rng = random.Random(2)
    for text in ["", "a", "abcde", "é日本語x", *("".join(rng.choice("abc ") for _ in range(n)) for n in (6, 40, 400, 6000))]:
        assert omh.signature(text).tolist() == omh_plain(text)


def simhash_plain(t: str) -> int:
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
    if not w:
        return 0
    g = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in g]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_components(docs, texts):
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    f = [simhash_plain(t or "") for t in texts]
    reach = list(range(len(f)))
    for _ in f:
        for i, a in enumerate(f):
            for j, b in enumerate(f):
                if (a ^ b).bit_count() <= 3:
                    reach[i] = reach[j] = min(reach[i], reach[j])
    for i in range(len(f)):
        assert got[i * 3]["fingerprint"] == format(f[i], "016x") and got[i * 3]["component_id"] == reach[i] * 3


@pytest.mark.parametrize("rows", [4096, 8])
def test_near_links_connect_what_brute_force_connects(spark, rows):
    rng = random.Random(1)
    centre = [rng.getrandbits(64) for _ in range(6)]
    fps = sorted({c ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 4))) & (2**64 - 1) for c in centre for _ in range(40)})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    stars = components(simhash.near_links(spark.createDataFrame([(x,) for x in signed], "fp long"), cell_rows=rows)).collect()
    root = {x: x for x in signed} | {r["u"]: r["v"] for r in stars}
    label = {x: x for x in signed}
    for _ in signed:
        new = {x: min(label[y] for y in signed if ((x ^ y) & (2**64 - 1)).bit_count() <= 3) for x in signed}
        if new == label:
            break
        label = new
    assert root == label


def test_copies_are_one_group(docs):
    got = {r["doc_id"]: r["component_id"] for r in simhash.copy_groups(docs).collect()}
    assert got[120] == got[123] == got[9] and got[126] == got[15]
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id in (9, 120, 123)").count() == 1


def test_copies_share_four_fifths_of_their_shingles(spark):
    rng = random.Random(12)
    words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    turned = words[200:] + words[:200]  # 392 of 400 shingles are common
    shuffled = words[::-1]  # the same words, no shingle
    spread = [w if i % 9 else "x" for i, w in enumerate(words)]  # most words, few shingles
    repeated = words[:100] * 4
    texts = [words, turned, shuffled, spread, [*words, "end"], repeated, words[:100], ["short", "text"], ["Short", "TEXT"], ["text", "short"], None, []]
    d = spark.createDataFrame([(i, None if t is None else " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    shingles = lambda t: {tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))} if t else set()
    low = [shingles([w.lower() for w in t or []]) for t in texts]
    want = {i: min(j for j, o in enumerate(low) if s == o or s and 5 * len(s & o) >= 4 * len(s | o)) for i, s in enumerate(low)}
    assert want == {0: 0, 1: 0, 2: 2, 3: 3, 4: 0, 5: 5, 6: 5, 7: 7, 8: 7, 9: 9, 10: 10, 11: 10}
    assert {r["doc_id"]: r["component_id"] for r in simhash.copy_groups(d).collect()} == want


def test_copy_pairs_and_a_chain_of_copies(spark):
    rng = random.Random(5)
    text = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    rows = []
    for i in range(30):
        rows.append((i, " ".join(text)))
        text[i * 10] = f"n{i}"
    got = {r["doc_id"]: r["component_id"] for r in simhash.copy_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got.values()) == {0}
    bits = bytearray(b"\xff" * simhash.BITMAP)
    entries = spark.createDataFrame([(0, 7, m, label, size, bits) for m, label, size in [(1, 1, 100), (2, 1, 100), (3, 3, 80), (4, 4, 79)]] + [(1, 7, 9, 9, 100, bits)], "seed int, fp long, mark long, label long, size int, bits binary")
    for rows in (4096, 1):
        assert sorted(tuple(r) for r in simhash.copy_pairs(entries, 3, rows).collect()) == [(1, 3), (2, 3), (3, 4)]


def test_bitmaps_leave_no_copy_out():
    rng = random.Random(6)
    sets = []
    for n in (1, 3, 10, 150, 900, 5000):
        base = [rng.getrandbits(63) for _ in range(n)]
        for share in (0.0, 0.02, 0.05, 0.1, 0.15, 0.3, 0.6):
            sets.append(np.unique([x if rng.random() >= share else rng.getrandbits(63) for x in base]).astype(np.int64))
    bits = np.frombuffer(b"".join(map(simhash.bitmap_of, sets)), np.uint64).reshape(len(sets), -1)
    size = np.array([len(s) for s in sets])
    p, q = (x.reshape(-1) for x in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    ok = simhash.may_be_copies(bits, size, p, q)
    share = np.array([len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b])) for a, b in zip(p, q)])
    assert ok[share >= 0.8].all() and not ok[(share < 0.6) & (size[p] < 200)].any()


def dedup_plain(rows):
    first: dict[bytes, int] = {}
    for i, t in sorted(rows):
        for k in range(len(t) - 49):
            first.setdefault(t[k : k + 50], i)
    for i, t in rows:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 49):
            if first[t[k : k + 50]] < i:
                gone[k : k + 50] = True
        yield i, gone


def test_substrings(docs, texts):
    got = {r["doc_id"]: r for r in substrings.dedup_report(docs).collect()}
    for i, gone in dedup_plain([(i * 3, (t or "").encode()) for i, t in enumerate(texts)]):
        t = np.frombuffer((texts[i // 3] or "").encode(), np.uint8)
        r = got[i]
        assert (r["n_bytes"], r["n_removed"]) == (len(t), int(gone.sum()))
        assert r["n_spans"] == int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        assert r["kept_sha256"] == hashlib.sha256(t[~gone].tobytes()).hexdigest()


def test_equal_hashes_of_different_texts_remove_nothing(spark):
    """Two texts whose anchors have one 64-bit hash."""
    pair = ["lyqkadowolpndygtogkzdaduxaslvyxufcqlsjnsvljrmkzxvs", "lyqkadowonqndygsmhjzebfszbrjvyyuecrmulnqvljrmkzxvs"]
    h = [substrings.anchors(np.frombuffer(t.encode(), np.uint8), np.array([0, 50]))[1].tolist() for t in pair]
    assert h[0] == h[1]
    rows = [(1, pair[0]), (2, pair[1]), (3, pair[1])]
    got = substrings.dedup_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r["doc_id"]: r["n_removed"] for r in got} == {1: 0, 2: 0, 3: 50}


@pytest.mark.parametrize("most", [5, 20000])
def test_substrings_of_small_alphabets_and_frequent_anchors(spark, monkeypatch, most):
    monkeypatch.setattr(substrings, "SORT_SEGMENTS", most)  # 5: most anchors send their windows one by one
    monkeypatch.setattr(substrings, "CHUNK_BYTES", 600)
    rng = random.Random(most)
    rows = []
    for alphabet in ("ab", "\0\1", "\0", "abcdefgh ", "é日a"):
        base = "".join(rng.choice(alphabet) for _ in range(300))
        for _ in range(12):
            t = ""
            for _ in range(rng.randint(0, 5)):
                a = rng.randrange(300)
                t += base[a : a + rng.randint(0, 120)] if rng.random() < 0.6 else "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
            rows.append((rng.randrange(40), t))
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in substrings.dedup_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect())
    want = []
    for (i, t), (_, gone) in zip(rows, dedup_plain([(i, t.encode()) for i, t in rows])):
        b = np.frombuffer(t.encode(), np.uint8)
        want.append((i, len(b), int(gone.sum()), hashlib.sha256(b[~gone].tobytes()).hexdigest()))
    assert got == sorted(want)


def test_deduplicated_keeps_columns(docs):
    got = substrings.deduplicated(docs)
    assert got.columns == docs.columns and got.count() == docs.count()
    rows = {r["doc_id"]: r for r in got.collect()}
    assert rows[120]["text"] == "" and rows[120]["n_chars"] == 0 and rows[138]["text"] is None and rows[9]["lang"] == "en"


def test_deduplicated_keeps_odd_columns_and_null_ids(spark):
    import datetime as dt

    at = dt.datetime(2024, 1, 2, 3, 4, 5, 123456)
    passage = "the same words stand here in full and they go on for more than fifty bytes"
    rows = [(None, passage, at, {"k": [1.5, None]}, True, 1), (4, passage, None, None, None, 2), (9, "x" + passage, at, {}, False, 3)]
    d = spark.createDataFrame(rows, "doc_id long, text string, rest timestamp, `c0` map<string, array<double>>, __no_text boolean, chunk int")
    got = substrings.deduplicated(d)
    assert got.schema == d.schema
    assert {r["chunk"]: r["text"] for r in got.collect()} == {1: "", 2: passage, 3: "x"}
    assert {tuple(map(str, r[2:])) for r in got.collect()} == {tuple(map(str, r[2:])) for r in rows}


def test_two_stage_sorting_orders_suffixes():
    rng = np.random.default_rng(3)
    rows = rng.integers(97, 100, (60, substrings.SEGMENT), dtype=np.uint8)
    rows[30:] = rows[:30]
    n = len(rows)
    need, end = np.full(n, substrings.SIDE), np.full(n, substrings.SEGMENT)
    r, p, _ = substrings.suffix_order(rows, need, end)
    keys = [rows[a, b:].tobytes() for a, b in zip(r, p)]
    assert len(keys) == n * (substrings.SIDE + 1) and keys == sorted(keys)


def test_quality_rejects_junk_and_keeps_good(spark):
    rng = random.Random(7)
    good = [" ".join(rng.choice(["river", "stone", "light", "tree", "walk", "home", "and", "the"]) for _ in range(60)) for _ in range(300)]
    bad = [" ".join(rng.choice(["$$$", "buy!!", "CLICK", "%%%"]) for _ in range(60)) for _ in range(60)]
    rows = [(i, t, "en", "s", len(t or ""), "", 0) for i, t in enumerate([*good, *bad, None, ""])]
    labels = spark.createDataFrame([(i, int(i < 300), 0) for i in range(0, 360, 2)], "doc_id long, quality int, toxic int")
    d = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: r["kept"] for r in quality.sampled(d, labels).collect()}
    assert sum(got[i] for i in range(300)) >= 295 and not any(got[i] for i in range(300, 360))
    assert all(r["kept"] for r in quality.sampled(d, labels.limit(0)).collect())


@pytest.mark.parametrize("k", [1, 40, 399])
def test_quality_is_a_gumbel_top_k_of_the_two_models(spark, k):
    """Counts, ratios, weights, noise and the k largest keys, all by loops over words."""
    rng = random.Random(k)
    words = [f"w{i}" for i in range(60)] + ["!!", "12"]
    docs = [" ".join(rng.choice(words[:40] if i % 3 else words) for _ in range(rng.randint(0, 30))) for i in range(400)]
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(0, 400, 2)], "doc_id long, quality int, toxic int")
    fits = {r["doc_id"]: r["good"] for r in quality.labelled(labels).filter("fits").collect()}
    assert {i: int(i % 3 > 0) for i in fits} == fits and len(fits) > 100
    bucket = lambda t: quality.grams(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[0].tolist()
    raw, target, held_good, held_bad = (np.zeros(quality.BUCKETS) for _ in range(4))
    for i, t in enumerate(docs):
        for b in bucket(t):
            raw[b] += 1
            target[b] += fits.get(i) == 1
        for b in set(bucket(t)):
            held_good[b] += fits.get(i) == 1
            held_bad[b] += fits.get(i) == 0
    ratio = quality.log_ratio(target, raw) + quality.bad_ratio(held_good, held_bad, sum(fits.values()), len(fits) - sum(fits.values()))
    noise = {r["doc_id"]: r["g"] for r in d.select("doc_id", quality.gumbel(11).alias("g")).collect()}
    assert abs(np.mean(list(noise.values())) - 0.5772) < 0.2 and abs(np.std(list(noise.values())) - 1.2825) < 0.2
    keys = {}
    for i, t in enumerate(docs):
        own = bucket(t)
        keys[i] = sum(ratio[b] for b in own) * quality.TYPICAL / max(1, len(own)) + noise[i]
    got = {r["doc_id"]: r for r in quality.sampled(d, labels, k=k).collect()}
    assert all(abs(got[i]["sample_key"] - x) < 1e-6 for i, x in keys.items())
    assert {i for i, r in got.items() if r["kept"]} == set(sorted(keys, key=keys.get)[-k:])


def test_labelled_sample_is_bounded(spark):
    labels = spark.range(6000).selectExpr("id AS doc_id", "CAST(id % 10 < 9 AS int) AS quality", "0 AS toxic")
    n = {r["good"]: r["count"] for r in quality.labelled(labels, 500).groupBy("good").count().collect()}
    assert 400 <= n[1] <= 600 and 400 <= n[0] <= 600
    assert quality.labelled(labels, 10_000).count() == 6000


def test_quality_counts_rare_abuse(spark):
    rng = random.Random(9)
    plain = lambda: [f"w{int(rng.paretovariate(0.7)) % 3000}" for _ in range(80)]
    good = [" ".join(plain()) for _ in range(600)]
    rude = [" ".join([*plain()[:76], "you", "absolute", "scumbag", "idiot"]) for _ in range(24)]
    d = spark.createDataFrame(list(enumerate([*good, *rude])), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i >= 600)) for i in range(624) if i % 8], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["kept"] for r in quality.sampled(d, labels).collect()}
    assert sum(not got[i] for i in range(600, 624)) >= 20 and sum(got[i] for i in range(600)) >= 590


def test_log_ratio_keeps_one_sided_rare_grams():
    raw, target = np.full(1000, 400), np.full(1000, 100)
    raw[:3], target[:3] = (40, 80, 4), 0
    r = quality.log_ratio(target, raw)
    assert r[1] < r[0] < r[2] < 0 and (r[3:] == 0).all()
    r = quality.bad_ratio(np.array([0, 0, 50, 0]), np.array([2, 8, 5, 0]), 500, 50)
    assert r[1] < r[0] < 0 and r[2] == r[3] == 0


def test_grams_against_a_loop():
    text = "Ab ab!! 12 ab"
    flat = np.frombuffer(text.encode(), np.uint8)
    bucket, doc = quality.grams(flat, np.array([0, len(flat)]))
    words = re.findall(r"[a-z]+|\d+|[^\sa-z\d]+", text.lower())
    assert len(bucket) == 2 * len(words) - 1 and set(doc) == {0}
    assert bucket[0] == bucket[1] == bucket[words.index("12") + 1]


def test_kth_largest(spark):
    x = np.random.default_rng(1).normal(size=3000).round(2)
    d = spark.createDataFrame([(float(v),) for v in x], "x double")
    for k in (1, 17, 2999):
        cut = quality.kth_largest(d, "x", k)
        assert (x >= cut).sum() == (x >= np.sort(x)[-k]).sum()


def test_language(spark):
    rng = random.Random(3)
    def text(letters):
        return " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(40))
    rows = [(i, text("abcde" if i % 2 else "vwxyz"), "aa" if i % 2 else "zz", "s", 0, "", 0) for i in range(80)]
    rows += [(100, None, "aa", "s", 0, "", 0), (101, "12 !!", None, "s", 0, "", 0), (102, "", "aa", "s", 0, "", 0), (103, text("abcde") * 40, None, "s", 0, "", 0)]
    got = {r["doc_id"]: r for r in langid.predict(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(got[i]["lang_pred"] == ("aa" if i % 2 else "zz") for i in range(80)) and got[103]["lang_pred"] == "aa"
    assert {got[i]["lang_pred"] for i in (100, 101, 102)} == {"und"}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for i, r in got.items())


def phrases_plain(train: str, s: str) -> int:
    n = i = 0
    while i < len(s):
        k = 1
        while i + k <= len(s) and s[i : i + k] in train:
            k += 1
        i, n = i + max(1, k - 1), n + 1
    return n


@pytest.mark.parametrize("block", [1, 3, 64, 2048])
def test_phrases_against_find(monkeypatch, block):
    monkeypatch.setattr(langid, "BLOCK_CHARS", block)
    rng = random.Random(block)
    for _ in range(20):
        train = {x: "".join(rng.choice("ab c") for _ in range(rng.randint(1, 60))).strip() or "a" for x in "xyz"}
        texts = ["".join(rng.choice("ab cd") for _ in range(rng.randint(1, 200))) for _ in range(8)]
        assert langid.Languages(train).phrases(texts).tolist() == [[phrases_plain(train[x], t) for x in "xyz"] for t in texts]


def test_only_letters_count():
    assert langid.normalised("½ ² ①") == "" and langid.normalised("A½b, Ünï_① x1") == "a b ünï x"
    assert langid.Languages({"aa": "abc"}).predict(["½ ² ①", None, "12", "abc"])[0] == ["und", "und", "und", "aa"]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.predict(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null and lang_pred <> 'und'")
    right, n = got.selectExpr("sum(int(lang = lang_pred))", "count(*)").first()
    assert n > 100 and right / n > 0.97


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def pii_plain(s):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, s):
            d = pii.digits_of(m.group())
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 14 <= len(d) <= 19 and pii.luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda x: (x[0], pii.KINDS.index(x[2])))


def test_base_patterns_against_re():
    rng = random.Random(2)
    odd = ["a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "+1 (578) 555-6437", "4111 1111 1111 1111x", "", "@@a.b", "9" * 3000, "a" * 3000 + "@"]
    for s in odd + ["".join(rng.choice("12.@+- (a)b") for _ in range(40)) for _ in range(4000)]:
        assert pii.base_spans(s) == pii_plain(s)


def test_field_adds_and_base_stays(docs, spark):
    t = "é call (415) 555-2671, card 9807915762804490, mail a.b@c.de and 12 dogs"
    own, every = pii.spans(pii.trained(), [t])[0]
    assert own == pii_plain(t) and set(own) <= set(every)
    assert {t[a:b] for a, b, k in every if k == "phone"} == {"(415) 555-2671"}
    assert pii.masked(t, every) == "é call [PHONE], card [CARD], mail [EMAIL] and 12 dogs"
    got = {r["doc_id"]: r for r in pii.find(docs).collect()}
    assert got[138]["spans"] == "" and got[138]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert pii.redact(docs).columns == docs.columns


def test_spans_of_long_words_and_common_forms():
    field = pii.trained()
    for text, want in [("fax 212-555-0188 now", "212-555-0188"), ("call (415) 555-2671", "(415) 555-2671"), ("a" * 300 + " tel 415-555-0199", "415-555-0199"), ("write to x" + "y" * 80 + "@localhost", "x" + "y" * 80 + "@localhost")]:
        assert want in {text[a:b] for a, b, _ in pii.spans(field, [text])[0][1]}
    assert pii.shape("ab-12" * 40) == "x-d" * 40 and pii.shape("(415),") == "(d)"


def test_spans_across_windows_are_found_whole():
    field = pii.trained()
    for n in range(pii.WINDOW - 4, pii.WINDOW + 4):
        text = "word " * (n - 2) + "call (415) 555-2671 today " + "word " * 150
        a = text.index("(415)")
        assert (a, a + 14, "phone") in pii.spans(field, [text])[0][1]
    line = " ".join(["call"] + ["(415) 555-2671 or"] * 100 + ["12 34 56"] * 60)
    words = [m.group() for m in pii.WORD.finditer(line)]
    parts = pii.windows(line, [m.span() for m in pii.WORD.finditer(line)])
    labels = [x for i, part in enumerate(parts) for x in field.viterbi([[line[a:b] for a, b in part]])[0][i > 0 :]]
    assert len(parts) > 1 and labels == field.viterbi([words])[0]


def test_viterbi_is_the_best_path():
    import itertools

    f = pii.trained()
    words = ["call", "(415)", "555-2671", "now", "12"]
    scores = f.scores([words])[0][0]
    value = lambda path: sum(scores[i, y] for i, y in enumerate(path)) + sum(f.move[a, b] for a, b in zip(path, path[1:]))
    best = max(itertools.product(range(len(pii.LABELS)), repeat=len(words)), key=value)
    assert f.viterbi([words])[0] == list(best)


def huffman_plain(scan: bytes, n: int) -> list[int]:
    """Differences of a scan, bit by bit, from the code lengths in the header."""
    bits = "".join(f"{b:08b}" for b in scan.replace(b"\xff\x00", b"\xff"))
    out, at = [], 0
    while len(out) < n:
        ones = 0
        while bits[at] == "1":
            ones, at = ones + 1, at + 1
        at += 1
        s = 8 - ones
        v = int(bits[at : at + s], 2) if s else 0
        at += s
        out.append(v if s == 0 or v >> (s - 1) else v - (1 << s) + 1)
    return out


def test_motion_jpeg_round_trip_and_bitstream():
    rng = np.random.default_rng(1)
    payload = rng.integers(0, 256, media.SAMPLES * 3, dtype=np.uint8)
    payload[: media.SAMPLES] = 255
    file = media.encode_payloads([payload])[0]
    (samples, step), = media.decode_media([file])
    assert samples.reshape(-1).tolist() == payload.tolist() and step == 40000
    frames, _ = media.indexed_frames(file)
    at, size = frames[1]
    d = huffman_plain(media.Frame(file[at : at + size]).scan, media.SAMPLES)
    x = np.zeros((media.SIDE, media.SIDE), int)
    for i, v in enumerate(d):
        r, c = divmod(i, media.SIDE)
        x[r, c] = v + (x[r, c - 1] if c else x[r - 1, 0] if r else 128)
    assert x.reshape(-1).tolist() == payload[media.SAMPLES : 2 * media.SAMPLES].tolist()


def frame_plain(x: np.ndarray) -> bytes:
    """A lossless frame of any size with a table of its own: all code words have 4 bits."""
    bits = ""
    for r, row in enumerate(x.astype(int)):
        for c, v in enumerate(row):
            d = v - (row[c - 1] if c else x[r - 1, 0].astype(int) if r else 128)
            s = int(abs(d)).bit_length()
            bits += f"{s:04b}" + (f"{d if d > 0 else d + (1 << s) - 1:0{s}b}" if s else "")
    bits += "1" * (-len(bits) % 8)
    scan = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
    h, w = x.shape
    dht = b"\xff\xc4" + (19 + 9).to_bytes(2, "big") + b"\x00" + bytes([0, 0, 0, 9] + [0] * 12) + bytes(range(9))
    sof = b"\xff\xc3" + (11).to_bytes(2, "big") + b"\x08" + h.to_bytes(2, "big") + w.to_bytes(2, "big") + b"\x01\x01\x11\x00"
    return b"\xff\xd8" + dht + sof + b"\xff\xda" + (8).to_bytes(2, "big") + b"\x01\x01\x00\x01\x00\x00" + scan + b"\xff\xd9"


def test_frames_of_other_files_are_read_by_their_headers():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 256, (3, 10, 7), dtype=np.uint8)
    (samples, _), own = media.decode_media([media.avi([frame_plain(f) for f in x]), media.encode_payloads([np.full(576, 7, np.uint8)])[0]])
    assert samples.tolist() == x.reshape(3, -1).tolist() and (own[0] == 7).all()
    for broken in (frame_plain(x[0]).replace(b"\xff\xc3", b"\xff\xc0"), frame_plain(x[0]).replace(b"\x01\x00\x00", b"\x04\x00\x00"), b"no frame"):
        with pytest.raises(ValueError):
            media.decode_media([media.avi([broken])])


def shots_plain(frames: np.ndarray) -> list[int]:
    """Shots by loops: the histogram difference is over a quarter and over three times the mean of the eight before."""
    hist = [[sum(int(v) >> 4 == b for v in f) for b in range(16)] for f in frames]
    diff = [sum(abs(a - b) for a, b in zip(x, y)) / (2 * frames.shape[1]) for x, y in zip(hist, hist[1:])]
    out = [0]
    for i, d in enumerate(diff):
        before = diff[max(0, i - 8) : i]
        if d > 0.25 and d > 3 * (sum(before) / len(before) if before else 0):
            out.append(i + 1)
    return out


def test_shots_against_loops():
    rng = np.random.default_rng(8)
    for _ in range(30):
        level = np.repeat(rng.integers(0, 200, 12), rng.integers(1, 6, 12))
        frames = (level[:, None] + rng.integers(0, int(rng.integers(1, 56)), (len(level), 576))).astype(np.uint8)
        assert media.shot_starts(frames).tolist() == shots_plain(frames)


def test_motion_jpeg_rows(docs, texts, spark):
    got = {r["doc_id"]: r for r in media.media_features(docs).collect()}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        p = b + b"\xff" * (max(1, -(-len(b) // 576)) * 576 - len(b))
        r = got[i * 3]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        assert [c["first_frame"] for c in r["clips"]] == shots_plain(np.frombuffer(p, np.uint8).reshape(-1, 576)) and r["clips"][-1]["end_us"] == len(p) // 576 * 40000
    table = media.media_table(docs.filter("doc_id = 168"))
    clips = media.clip_rows(table).orderBy("clip").collect()
    assert [tuple(c)[2:] for c in clips] == [tuple(c) for c in got[168]["clips"]] and [c["clip"] for c in clips] == list(range(len(clips)))
    assert media.clip_rows(table.unionByName(table.selectExpr("doc_id", "n_bytes", "CAST(null AS binary) AS media"))).count() == len(clips)


def test_warc(spark):
    import base64

    rows = [(5, "http://a.example.com/x?q=1", "<p>é</p>", 1), (2, "https://b.example.com:8443/", "<p>é</p>", 1), (9, None, None, 1), (11, "bad url\r\n", "", 1), (3, "http://a.example.com/x", "other", 1), (3, "http://a.example.com/x", "other", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload int")
    index = warc.capture_index(pages).collect()
    got = {r["page_id"]: r for r in index}
    assert len(index) == len(rows) and got[5]["refers_to"] == 2 and got[11]["refers_to"] == 9 and got[2]["record_type"] == got[3]["record_type"] == "response"
    assert got[5]["payload_bytes"] == 9 and got[5]["payload_digest"] == base64.b32encode(hashlib.sha1("<p>é</p>".encode()).digest()).decode()
    keys = [(r["url_key"], r["captured_at"], r["page_id"]) for r in index]
    assert keys == sorted(keys)
    assert warc.capture_index(pages.limit(0)).count() == 0


def test_loser_tree_merges():
    rng = random.Random(5)
    for k in (0, 1, 2, 7):
        runs = [sorted((rng.randrange(9), i) for i in range(rng.randrange(6))) for _ in range(k)]
        assert [x for x in warc.LoserTree(runs)] == sorted(x for r in runs for x in r)


def test_empty_tables(nothing, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for df in (bpe.roundtrip(nothing, PATH), packing.pack(nothing, PATH), omh.edited_likeness(nothing), simhash.near_duplicates(nothing), simhash.one_of_each(nothing), substrings.dedup_report(nothing), substrings.deduplicated(nothing), quality.sampled(nothing, labels), langid.predict(nothing), pii.find(nothing), pii.redact(nothing), media.media_features(nothing)):
        assert df.count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    first = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == first.columns and out.schema == first.schema
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert 0 < docs.count() < first.count()
    assert docs.filter(F.col("text").rlike(r"@mail\d")).count() == 0
