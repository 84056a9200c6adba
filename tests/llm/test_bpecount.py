"""Token counts by heap merging against the tokenizers library and a plain merge loop."""

import json
import random

import pytest

from foretide.llm import bpecount

P = pytest.importorskip("public_tokenizers")
PATH = str(P.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def counter():
    return bpecount.Counter(PATH)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    return lambda texts: [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_every_character_in_context(counter, library):
    texts = [f"a{c} b {c}{c}c1{c}2 ' {c}.{c}\n {c}" for c in map(chr, [*range(0xD800), *range(0xE000, 0x20000, 7)])]
    assert [counter.count(t) for t in texts] == library(texts)


def test_mixed_texts(counter, library):
    rng = random.Random(1)
    parts = ["a", "b", "the", " ", "  ", "\n", "'s", "'", "1", "23", "é", "ñ", "\U0001f600", ".", "!!", "\t", "<|endoftext|>", "<|", "|>", "中", "文", "ing", "‍", "\x1c"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 60))) for _ in range(5000)]
    assert [counter.count(t) for t in texts] == library(texts)


def test_long_pieces_and_texts(counter, library):
    rng = random.Random(2)
    one = "".join(rng.choices("abcdefgh", k=60_000))
    twins = ["ab", "ba"]
    for _ in range(11):  # letters in the order of Thue and Morse: no hash is asked, so none can collide
        twins = [twins[0] + twins[1], twins[1] + twins[0]]
    texts = [one, *twins, " ".join(["word"] * 300_000), "x" * 4097]
    assert [counter.count(t) for t in texts] == library(texts)


def test_merges_equal_a_plain_loop(counter):
    with open(PATH) as f:
        merges = json.load(f)["model"]["merges"]
    byte = bpecount.alphabet()
    ranks = {tuple(bytes(byte[c] for c in part) for part in m): i for i, m in enumerate(merges)}
    rng = random.Random(3)
    for _ in range(300):
        piece = bytes(rng.choices(b" etaoinshr\xc3\xa9", k=rng.randint(0, 40)))
        symbols = [bytes([b]) for b in piece]
        while True:
            at = min((ranks[p], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in ranks) if any(p in ranks for p in zip(symbols, symbols[1:])) else None
            if at is None:
                break
            symbols[at[1] : at[1] + 2] = [symbols[at[1]] + symbols[at[1] + 1]]
        assert counter.merged(piece) == len(symbols)


def test_memory_is_forgotten_not_wrong(monkeypatch, library):
    monkeypatch.setattr(bpecount, "REMEMBER", 5)
    small = bpecount.Counter(PATH)
    texts = [" ".join(f"word{i}x{j}" for j in range(20)) for i in range(30)]
    assert [small.count(t) for t in texts] == library(texts)
    assert len(small.known) <= 5


def test_other_kinds_are_refused():
    with pytest.raises(ValueError):
        bpecount.Counter(str(P.path("word_bpe_49k.json")))


def test_tables(odd, clashing, empty, library):
    for docs in (odd, clashing):
        rows = bpecount.counts(docs.withColumn("n_tokens", docs["text"]), PATH, limit=5).collect()
        assert len(rows) == docs.count()
        for r in rows:
            text = r["text"] or ""
            assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), library([text])[0], library([text])[0] > 5)
    assert bpecount.counts(empty, PATH).count() == 0
