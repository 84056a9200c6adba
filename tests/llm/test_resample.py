"""Importance resampling: features, deduplicated counts, draw."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from foretide.llm import resample

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def features(text, n, buckets):
    words = WORD.findall((text or "").translate(UPPER))
    runs = [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]
    return [zlib.crc32(r.encode("utf-8", "surrogatepass")) % buckets for r in runs]


def plain_draw(docs, target, n=1, buckets=10_000, seed=2024, least=20, percent=10):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(features(text, n, buckets))
    for text in target:
        t.update(features(text, n, buckets))
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    out = []
    for doc_id, text in docs:
        f = features(text, n, buckets)
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([doc_id, len(WORD.findall((text or "").translate(UPPER))), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    can = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    rank = {id(r): i + 1 for i, r in enumerate(can[: percent * len(can) // 100])}
    return sorted(((str(r[0]), *r[1:], rank.get(id(r))) for r in out), key=str)


def drawn(df):
    return [(str(r["doc_id"]), r["n_words"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in df.collect()]


def key(rows):
    return sorted(rows, key=str)


def test_crc_of_spans_is_zlibs():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    starts = rng.integers(0, 4000, 900)
    ends = starts + rng.choice([0, 1, 2, 7, 47, 48, 49, 300, 1000], 900)
    got = resample.crc_fed(np.full(900, 0xFFFFFFFF, np.uint32), data, starts, ends) ^ np.uint32(0xFFFFFFFF)
    assert got.tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def texts(rng, n):
    lines = [" ".join(rng.choice("Aa bB c1 é dd ß, x. 中文 e-e".split()) for _ in range(rng.randint(0, 9))) for _ in range(12)]
    return ["\n".join(rng.choice(lines) for _ in range(rng.randint(0, 9))) for _ in range(n)]


def test_equals_plain_counts_with_runs_over_lines(make):
    rng = random.Random(5)
    docs = [(i, t) for i, t in enumerate(texts(rng, 60))] + [(None, "a b c\n\n \nd"), (7, None), (8, ""), (9, "\n"), (1, "one word " * 30), (1, "one word " * 30)]
    target = texts(rng, 9) + [None, ""]
    frame, wanted = make(docs), make([(i, t) for i, t in enumerate(target)])
    for n in (1, 2, 4):
        got = drawn(resample.draw(frame, wanted, ngram=n, buckets=97, least_words=5, percent=40))
        want = plain_draw(docs, target, n, 97, least=5, percent=40)
        assert key(r[:5] for r in got) == key(r[:5] for r in want)
        assert sorted(r[5] for r in got if r[5]) == sorted(r[5] for r in want if r[5])
        single = {r[0] for r in want if sum(x[0] == r[0] for x in want) == 1}
        assert key(r for r in got if r[0] in single) == key(r for r in want if r[0] in single)


def test_lines_count_once_and_multiply():
    lines = [b"a b", b"c", b"  ", b"A b a"]
    times = np.array([3, 5, 7, 2])
    total = resample.line_counts(lines, times, 2, 1000)
    want = Counter()
    for line, n in zip(lines, times.tolist(), strict=True):
        for b in features(line.decode(), 2, 1000):
            want[b] += n
    assert {b: int(n) for b, n in enumerate(total) if n} == want


def test_odd_and_empty_tables(odd, clashing, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    want = plain_draw(rows, [r[1] for r in rows], least=3, percent=50)
    for docs in (odd, clashing):
        got = drawn(resample.draw(docs, docs, least_words=3, percent=50))
        assert key(r[:5] for r in got) == key(r[:5] for r in want)
        assert sorted(r[5] for r in got if r[5]) == sorted(r[5] for r in want if r[5])
    assert resample.draw(empty, odd).count() == 0
    assert all(r["weight"] is not None for r in resample.draw(odd, empty).collect())


def test_every_query_row_is_ranked_over_many_ranges(spark, make):
    docs = make([(i, " ".join(["w"] * (i % 50))) for i in range(3000)])
    rows = resample.draw(docs, docs).collect()
    ranks = sorted(r["rank"] for r in rows if r["rank"])
    can = sorted((-r["score"], r["doc_id"], r["rank"]) for r in rows if r["n_words"] >= 20)
    assert ranks == list(range(1, len(can) // 10 + 1))
    assert [r for *_, r in can] == ranks + [None] * (len(can) - len(ranks))
