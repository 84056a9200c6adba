"""Source divergence audit against a plain loop, with digests that collide and blocks that split."""

import random
import re
from collections import Counter, defaultdict

import pytest

from foretide.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def plain_audit(rows, least, extra=5, top=50):
    found = [(lang or "", source or "", Counter(TERM.findall((text or "").translate(UPPER)))) for lang, source, text in rows]
    out = []
    for lang in {r[0] for r in found}:
        docs = Counter(t for a, _, c in found if a == lang for t in c)
        kept = [t for t, n in docs.items() if n >= least]
        counts = defaultdict(Counter)
        for a, source, c in found:
            if a == lang:
                counts[source].update({t: c[t] for t in kept if c[t]})
        whole = Counter()
        for c in counts.values():
            whole.update(c)

        def share(c):
            n = sum(c.values())
            return {t: 1 + 1_000_000_000 * (c[t] + extra) // (n + extra * len(kept)) for t in kept}

        p, q = {s: share(c) for s, c in counts.items()}, share(whole)
        for s in counts:
            pair = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in counts if o != s)
            term = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if counts[s][t] and p[s][t] > q[t])[:top]
            for part, items in (("pair", pair), ("term", term)):
                out += [(lang, s, part, item, -v, i + 1) for i, (v, _, item) in enumerate(items)]
    return sorted(out)


def rows_of(rng, n):
    vocabulary = [f"t{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(60)] + ["Éa", "éA", "中文", "straße"]
    return [
        (rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", "ß", None]), " ".join(rng.choices(vocabulary, k=rng.randint(0, 25))) + rng.choice(["", " 12", "!x-Y"]))
        for _ in range(n)
    ] + [("fr", "only", "a b c"), ("xx", "p", ""), ("xx", "q", None), ("en", "no words", "12 34")]


def audited(spark, rows, **options):
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    got = [(r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in divergence.audit(docs, **options).collect()]
    return sorted(got)


@pytest.mark.parametrize("options", [{}, {"bits": 4}, {"side": 2, "per_block": 7}, {"bits": 3, "side": 1, "per_block": 5}, {"top": 3}])
def test_equals_a_plain_loop(spark, options):
    rows = rows_of(random.Random(8), 250)
    assert audited(spark, rows, least_docs=6, **options) == plain_audit(rows, 6, top=options.get("top", 50))


def test_nothing_kept_and_empty(spark):
    rows = rows_of(random.Random(9), 12)
    assert audited(spark, rows, least_docs=1000) == plain_audit(rows, 1000)
    assert audited(spark, []) == []


def test_odd_tables(odd, clashing, spark):
    rows = [(r["lang"], r["source"], r["text"]) for r in odd.collect()]
    want = plain_audit(rows, 2)
    for docs in (odd, clashing):
        got = [(r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in divergence.audit(docs, least_docs=2).collect()]
        assert sorted(got) == want


def test_a_task_writes_chunks(spark, monkeypatch):
    rows = rows_of(random.Random(10), 120)
    docs = spark.createDataFrame(rows, "lang string, source string, text string").coalesce(1)
    monkeypatch.setattr(divergence, "HELD", 20)
    chunks = divergence.term_rows(docs).where("chunk is not null").select("chunk").distinct().count()
    assert chunks > 3
    assert audited(spark, rows, least_docs=4, bits=5) == plain_audit(rows, 4)
