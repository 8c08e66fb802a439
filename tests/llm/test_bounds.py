"""Memory and group bounds of operators on alphabets, labels and repeats that no sample data hold."""

import random

import public_tokenizers

from panelforge.llm import langid, packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_automata_of_large_alphabets_are_small_and_exact():
    random.seed(1)
    han = [chr(0x4E00 + i) for i in range(3000)]
    train = {n: "".join(random.choice(a) for _ in range(12_000)) for n, a in (("zh", han), ("ja", han), ("en", "abcde "), ("de", "abcdef "))}
    languages = langid.Languages(train)
    assert sum(x.nbytes for a in languages.automata for x in (a.base, a.cells, a.again, a.lacks)) < 4_000_000
    texts = [train["zh"][500:520] + train["ja"][9:40] + "abcab?", train["en"][7:90], "".join(random.choice(han) for _ in range(300))]

    def plain(known, text):
        n = i = 0
        while i < len(text):
            k = 0
            while i + k < len(text) and text[i : i + k + 1] in known:
                k += 1
            n, i = n + 1, i + max(1, k)
        return n

    assert languages.phrases(texts).tolist() == [[plain(train[x], t) for x in languages.names] for t in texts]


def test_only_the_commonest_languages_are_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES", 2)
    rows = [(i, f"words of text {i}", lang) for i, lang in enumerate(["en"] * 40 + ["de"] * 30 + [f"x{k}" for k in range(50)])]
    assert set(langid.training_texts(spark.createDataFrame(rows, "doc_id long, text string, lang string"))) == {"en", "de"}


def test_identical_rows_spread_over_groups(spark):
    docs = spark.createDataFrame([(1, "the same text")] * 4000, "doc_id long, text string").repartition(3)
    got = packing.pack(docs, PATH, documents_per_group=100).toPandas()
    per_group = got.groupby(got["sequence_id"] // 2**32).size()
    assert len(got) == 4000 and len(per_group) == 40 and per_group.max() < 200
    assert (got.groupby("sequence_id")["length"].sum() <= 1024).all()


def test_noise_decides_about_borderline_documents_and_not_about_clear_ones(spark):
    from panelforge.llm import quality

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    plain = quality.classified(docs, labels).toPandas().set_index("doc_id")
    runs = [quality.sampled(docs, labels, k=500, seed=s).toPandas().set_index("doc_id")["kept"] for s in (1, 2)]
    weight = plain["log_weight"]
    last = weight.sort_values(ascending=False).iloc[499]
    near = (weight - last).abs() < 2.6  # two deviations of the noise
    assert (runs[0] != runs[1])[near].mean() > 0.1
    assert all(r.sum() == 500 for r in runs)
    assert not runs[0][weight < last - 30].any() and not runs[1][weight < last - 30].any()
    assert plain["kept"].equals(weight >= weight[plain["kept"]].min())
