"""Long strings that a polynomial hash modulo 2**64 takes for equal."""

import re
from collections import Counter

import pytest

from foretide.llm import linefreq, tokens

P = pytest.importorskip("public_tokenizers")
WORD = re.compile("[^\x20\x09-\x0d]+")


def twins(letters):
    a, b = "ab", "ba"
    while len(a) < letters:
        a, b = a + b, b + a
    return a, b


def test_tokens_of_long_twins_are_the_librarys():
    from tokenizers import Tokenizer

    path = str(P.path("byte_bpe_50k.json"))
    library, own = Tokenizer.from_file(path), tokens.Encoder(path, added=True)
    texts = [t for n in (128, 1024, 2048, 4096) for t in twins(n)]
    for order in (texts, texts[::-1]):
        ids, sizes = own.encode([f"{t} end" for t in order])
        want = [e.ids for e in library.encode_batch([f"{t} end" for t in order], add_special_tokens=False)]
        assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_long_twins_repeat_nothing():
    for n in (1024, 2048, 4096):
        a, b = twins(n)
        assert linefreq.repeated_words(f"{a} c d e f g h i zz {b} c d e f g h i") == 0
        assert linefreq.repeated_words(f"{a} c d e f g h i zz {a} c d e f g h i") == 16


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside)


def test_all_counts_of_odd_rows(odd, make):
    more = make([(50 + i, t) for i, t in enumerate(["# a #\n# a #\n \n \n*$%&|<>", "é é\né é\r\né é", "x " * 40, "\x1c\x85   b", "one two three four five six seven eight nine " * 3])])
    for docs in (odd, more):
        rows, _ = linefreq.judge(docs)
        got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rows.collect())
        assert got == sorted((r["doc_id"] is None, r["doc_id"] or 0, *plain_counts(r["text"])) for r in docs.collect())
