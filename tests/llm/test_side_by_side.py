"""Pre-tokens that go through the automaton side by side get the ids that each gets alone."""

import random

import public_tokenizers
from tokenizers import Tokenizer

from panelforge.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_side_by_side_equals_one_by_one(monkeypatch):
    random.seed(5)
    monkeypatch.setattr(bpe, "TOGETHER", 64)
    merges = bpe.Merges(open(PATH).read())
    words = ["".join(random.choice(letters) for _ in range(random.randint(1, 60))) for letters in (["the", "ing", " an", "er"], "abcde", "éäßñ漢字🙂", "0123", "\n\t ", "=-*#") for _ in range(60)]
    texts = [w.encode() for w in words]
    side = bpe.SideBySide(merges)
    for _ in range(2):
        assert [list(memoryview(x).cast("I")) for x in side.packed(texts)] == [merges.transduce(t) for t in texts]


def test_a_block_of_texts_equals_the_library_and_no_word_goes_alone(monkeypatch):
    random.seed(6)
    syllables = ["th", "ing", "er", "on", "ä", "Sch", "é", "漢", "9", "'s", "  ", "\n", "!?"]
    texts = ["", " ", "<|endoftext|> a", "a" * 70_000] + [" ".join("".join(random.choices(syllables, k=random.randint(1, 9))) for _ in range(80)) for _ in range(40)]
    library = Tokenizer.from_file(PATH)
    library.no_truncation()
    library.no_padding()
    expected = [library.encode(t, add_special_tokens=False).ids for t in texts]
    for most in (700_000, 50):
        monkeypatch.setattr(bpe, "CACHE_UNITS", most)
        encoder, alone = bpe.Encoder(bpe.Merges(open(PATH).read())), []
        transduce = encoder.merges.transduce
        encoder.merges.transduce = lambda b: alone.append(b) or transduce(b)
        got = [list(memoryview(x).cast("I")) if x else [] for x in encoder.each(texts)]
        assert got == expected
        assert most == 50 or all(len(b.decode()) > 50 or b in b"<|endoftext|> a" for b in alone)
