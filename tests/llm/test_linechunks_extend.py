"""Chunks by a hash rolled over lines, and removed stretches that grow line by line."""

import random
import re

import pytest
from pyspark.sql import functions as F

from foretide.llm import linechunks

WORDS = "lorem ipsum dolor sit amet tempor magna aliqua enim minim veniam quis nostrud".split()


def lines_of(text):
    return [x for x in re.split(linechunks.LINE_END, text) if x]


def prose(rng, n):
    out = []
    for _ in range(n):
        out.append(" ".join(rng.choice(WORDS) + rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) + rng.choice([". ", ", ", "\n", ".\n"]))
    return "".join(out)


def by_definition(cut):
    """Texts after removal, from the chunks of each document, first places in order of doc_id and position."""
    first, twin = {}, {}
    for d in sorted(cut):
        for p, c in enumerate(cut[d]):
            body = "\n".join(x.strip(" \t\n\x0b\x0c\r") for x in c)
            if len(c) >= 2 and len(body) >= 48:
                at = first.setdefault(body, (d, p))
                if at != (d, p):
                    twin[d, p] = at
    gone = {(d, p): set(range(len(cut[d][p]))) for d, p in twin}
    for (d, p), (e, q) in twin.items():
        for step in (-1, 1):
            a, b = p + step, q + step
            if (d, a) in twin or not 0 <= a < len(cut[d]) or not 0 <= b < len(cut[e]):
                continue
            mine, other = cut[d][a][::step], cut[e][b][::step]
            for k, (x, y) in enumerate(zip(mine, other)):
                if x.strip(" \t\n\x0b\x0c\r") != y.strip(" \t\n\x0b\x0c\r"):
                    break
                gone.setdefault((d, a), set()).add(k if step == 1 else len(mine) - 1 - k)
    texts = {d: "".join(x for p, c in enumerate(cs) for k, x in enumerate(c) if k not in gone.get((d, p), ())) for d, cs in cut.items()}
    return texts, twin, {at for at in gone if at not in twin}


@pytest.mark.parametrize("window", [1, 2, 3])
def test_stretches_grow_as_defined(spark, make, window):
    rng = random.Random(window)
    passages = [prose(rng, rng.randint(8, 20)) for _ in range(12)]
    rows = []
    for i in range(60):
        parts = [prose(rng, rng.randint(4, 9))]
        for p in rng.sample(passages, 2):
            whole = lines_of(p)
            a = rng.randint(0, 3)  # cut anywhere, so neighbours agree in part
            parts += ["".join(whole[a : len(whole) - rng.randint(0, 3)]), prose(rng, rng.randint(0, 6))]
        rows.append((i, "".join(parts)))
    rows += [(100, None), (101, ""), (102, rows[3][1]), (102, rows[3][1]), (103, "one line only")]
    docs = make(rows)
    cut = {r["doc_id"]: r["c"] for r in docs.where("text is not null").select("doc_id", linechunks.chunks(F.col("text"), window=window).alias("c")).collect()}
    for i, t in rows:
        assert t is None or [x for c in cut[i] for x in c] == lines_of(t)
    want, twin, trimmed = by_definition(cut)
    out = linechunks.dedup(docs, window=window, extend=True).collect()
    assert len(out) == len(rows) and trimmed
    for r in out:
        assert r["text"] == want.get(r["doc_id"])
        assert r["removed"] == sorted(p for d, p in twin if d == r["doc_id"])
        lost = len((dict(rows)[r["doc_id"]] or "").split()) - len((r["text"] or "").split())
        assert r["removed_words"] == lost
    # One copy of every line stays.
    left = {x.strip() for t in want.values() for x in lines_of(t)}
    assert left >= {x.strip() for _, t in rows if t for x in lines_of(t)}


def test_borders_follow_the_rolled_hash_only(spark, make):
    rng = random.Random(9)
    passage = prose(rng, 60)
    docs = make([(i, prose(rng, 5 + i) + passage + prose(rng, 7)) for i in range(3)])
    cut = [r["c"] for r in docs.select(linechunks.chunks(F.col("text"), window=3).alias("c")).collect()]
    bodies = [{"".join(c) for c in cs} for cs in cut]
    assert len(bodies[0] & bodies[1] & bodies[2]) >= 5


def test_extended_on_odd_rows(odd, clashing, empty):
    for docs in (odd, clashing, empty):
        out = linechunks.dedup(docs, window=2, extend=True)
        assert out.columns[: -3] == [c for c in docs.columns if c != "removed"]
        assert out.count() == docs.count()
