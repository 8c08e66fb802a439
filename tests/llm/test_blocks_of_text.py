"""Blocks of texts as arrays get the ids that the tokenizers library gives, and new words cost no Python call each."""

import random
import sys

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from panelforge.llm import bpe, bpe_blocks, packing
from panelforge.llm.shared import raw_bytes

PATH = public_tokenizers.path("byte_bpe_50k.json")
MERGES = bpe.Merges(open(PATH).read())
PARTS = ["the", "ing", "Sch", "ä", "É", "ÿ", "×", "÷", "µ", "ß", "9", "2024", "²", "'", "'s", "'LL", "don't", "!?", "-", "<|", "漢字", "🙂", "é", "’", "\0", "\x1c", "\x7f", "​"]
SPACES = [" ", "  ", "   ", "\n", "\r\n", " \n", "\n ", "\t\t", "\v", "\f", " " * 40, "\x85", "\xa0", " \xa0", " ", " ", " ", " ", " ", "　"]


def blocks() -> bpe_blocks.Blocks:
    return bpe_blocks.Blocks(bpe.Encoder(MERGES))


def each(encoder: bpe_blocks.Blocks, texts: list[str]) -> list[list[int]]:
    return [list(memoryview(x).cast("I")) if x else [] for x in encoder.each(*raw_bytes(pa.array(texts, pa.string())))]


def odd_texts() -> list[str]:
    random.seed(11)
    plain = [p for p in PARTS if p.isascii() and p.isprintable() or p in "äÉÿß"]
    texts = ["", "", " ", "\n", "a", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "x" * 25, " " + "y" * 23, " " + "y" * 24, "-" * 500, " ", "a ", " a", "a\n", "\na", "'", " '", "' a", "Ã", "a×b ÷c"]
    for parts, spaces in ((plain, SPACES[:3]), (plain * 4 + PARTS, SPACES[:11]), (plain, SPACES[:11]), (PARTS, SPACES[:11]), (PARTS, SPACES)):
        for _ in range(250):
            texts.append("".join(random.choice(parts) if random.random() < 0.6 else random.choice(spaces) for _ in range(random.randint(1, 40))))
    random.shuffle(texts)
    return texts


@pytest.fixture(scope="module")
def expected() -> list[list[int]]:
    library = Tokenizer.from_file(PATH)
    library.no_truncation()
    library.no_padding()
    return [library.encode(t, add_special_tokens=False).ids for t in odd_texts()]


def test_odd_texts_in_one_block_and_alone(expected):
    encoder, texts = blocks(), odd_texts()
    assert each(encoder, texts) == expected
    assert each(encoder, texts) == expected  # from the table
    fresh = blocks()
    assert [each(fresh, [t])[0] for t in texts] == expected
    assert each(encoder, []) == []


def test_few_slots_a_small_pool_equal_numbers_and_long_rows(expected, monkeypatch):
    texts = odd_texts()
    monkeypatch.setattr(bpe_blocks, "SLOT_BITS", 5)
    monkeypatch.setattr(bpe_blocks, "POOL_IDS", 4000)
    monkeypatch.setattr(bpe_blocks, "BLOCK_BYTES", 300)
    encoder = blocks()
    assert [ids for a in range(0, len(texts), 7) for ids in each(encoder, texts[a : a + 7])] == expected
    assert len(encoder.pool) == 4000
    monkeypatch.setattr(bpe_blocks, "BLOCK_BYTES", 1 << 20)
    monkeypatch.setattr(bpe_blocks, "mix", lambda key: (key[:, 0] % np.uint64(3)) << np.uint64(62))
    assert each(blocks(), texts) == expected


def calls(f) -> int:
    """Python calls that f makes."""
    n = 0

    def count(_, event, __):
        nonlocal n
        n += event == "call"

    sys.setprofile(count)
    try:
        f()
    finally:
        sys.setprofile(None)
    return n


def test_new_words_cost_no_python_call_each(monkeypatch):
    """`Encoder.each`, which op 7 used before, makes several calls for each."""
    monkeypatch.setattr(bpe, "TOGETHER", 1 << 15)
    random.seed(12)
    words = ["".join(random.choices(["the", "ing", "er", "ön", "an", "st", "wh", "re"], k=6)) for _ in range(20_000)]
    texts = [" ".join(words[a : a + 100]) + "." for a in range(0, len(words), 100)]
    encoder, before = blocks(), bpe.Encoder(MERGES)
    assert calls(lambda: list(before.each(texts))) > len(words)
    assert calls(lambda: each(encoder, texts)) < len(words) / 2


def test_packing_takes_texts_by_blocks(spark, monkeypatch):
    made = []
    monkeypatch.setattr(packing, "blocks", lambda *a: made.append(a) or blocks())
    frame = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    monkeypatch.setattr(type(frame), "mapInArrow", lambda self, run, _: list(run([pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["a b", ""]})])))
    (batch,) = packing.token_pieces(frame, PATH, 1024, 0)
    assert made and batch.column(2).to_pylist() == [3, 1]
