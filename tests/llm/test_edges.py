"""Nulls in every column, empty and very long texts, repeated rows and ids, and columns with clashing names."""

import datetime as dt

import public_tokenizers
import pytest

from panelforge.llm import bpe, langid, media, omh, packing, pii, quality, simhash, substrings, warc

PATH = public_tokenizers.path("byte_bpe_50k.json")
EXTRA = "chunk long, rest string, fp long, bucket int, borrowed boolean, media string, mark long, least long, kept boolean, start long, length long, pack_group int, cell long, lang string, seen timestamp, __no_text boolean, refers_to string, run string"
LONG = "word and another " * 9000
TEXTS = [(None, "some text of a few words"), (None, None), (5, None), (5, LONG), (5, LONG), (7, ""), (7, " \n"), (9, "Call (415) 555-2671 or write a@b.co"), (11, "aa" * 40000)]


@pytest.fixture(scope="module")
def odd(spark):
    at = dt.datetime(2024, 1, 2, 3, 4, 5, 123456)
    rows = [(i, t, *((None,) * 18 if k % 2 else (1, "r", 2, 3, True, "m", 4, 5, False, 6, 7, 8, 9, "en", at, True, "x", "y"))) for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, f"doc_id long, text string, {EXTRA}").repartition(3)


def ids(df):
    return sorted((r["doc_id"] for r in df.select("doc_id").collect()), key=lambda x: (x is not None, x))


WANT = sorted((i for i, _ in TEXTS), key=lambda x: (x is not None, x))


@pytest.mark.parametrize("name", ["language", "omh", "omh_plain", "simhash", "substrings", "pii", "media", "bpe", "quality", "copies"])
def test_a_row_for_every_row(odd, spark, name):
    labels = spark.createDataFrame([(5, 1, 0), (7, 0, None), (None, 1, 1), (5, None, 0)], "doc_id long, quality int, toxic int")
    run = {
        "language": langid.predict,
        "omh": omh.edited_likeness,
        "omh_plain": omh.fingerprints,
        "simhash": simhash.near_duplicates,
        "substrings": substrings.dedup_report,
        "pii": pii.find,
        "media": media.media_features,
        "bpe": lambda d: bpe.roundtrip(d, PATH),
        "quality": lambda d: quality.sampled(d, labels),
        "copies": simhash.copy_groups,
    }[name]
    assert ids(run(odd)) == WANT


def test_packing_holds_every_piece(odd):
    p = packing.pack(odd, PATH, documents_per_group=2).toPandas()
    assert p.doc_id.isna().sum() == 2 and set(p.doc_id.dropna()) == {5, 7, 9, 11}
    for _, s in p.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 1024


@pytest.mark.parametrize("stage", [substrings.deduplicated, pii.redact, simhash.one_of_each])
def test_stages_keep_columns_and_rows(odd, stage):
    got = stage(odd)
    assert got.schema == odd.schema
    kept = {tuple(map(str, r[2:])) for r in got.collect()}
    assert kept <= {tuple(map(str, r[2:])) for r in odd.collect()}
    if stage is not simhash.one_of_each:
        assert ids(got) == WANT


def test_equal_documents_have_equal_values(odd):
    rows = [r for r in media.media_features(odd).collect() if r["doc_id"] == 5 and r["n_bytes"]]
    assert len(rows) == 2 and rows[0] == rows[1] and rows[0]["n_bytes"] == len(LONG)
    gone = {(r["doc_id"], r["n_bytes"]): r["n_removed"] for r in substrings.dedup_report(odd).collect()}
    assert gone[5, len(LONG)] == 0 and gone[11, 80000] == 0  # rows of one doc_id take nothing from each other


def test_pages_with_nulls_and_repeats(spark):
    rows = [(1, None, None, None), (1, None, None, None), (None, "http://x.y/", "a", "q"), (3, "http://x.y/", "a", None), (None, None, "a", None), (4, "http://x.y/", "a", "q")]
    got = warc.capture_index(spark.createDataFrame(rows, "page_id long, url string, html string, run string")).collect()
    assert sorted((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in got if r["page_id"] != 4) == [(0, "response", None), (0, "response", None), (1, "response", None), (1, "response", None), (3, "response", None)]
    assert [(r["record_type"], r["refers_to"]) for r in got if r["page_id"] == 4] == [("revisit", 3)]


def test_pipeline_stages_with_clashing_columns(spark):
    import corpus_pipeline
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    docs = docs.withColumns({"kept": F.lit(1), "rest": F.col("lang"), "mark": F.col("doc_id"), "__no_text": F.lit(None).cast("boolean")})
    docs = docs.unionByName(docs.limit(1).withColumns({"doc_id": F.lit(None).cast("long"), "text": F.lit(None).cast("string")}))
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in docs.schema]
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert docs.count() > 10
