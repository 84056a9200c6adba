"""Operators against brute force, exact round trips and held-out accuracy."""

import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from foretide.llm import decontaminate, linechunks, linefreq, mixing, quality, queries, sharding, simhash, tokens, toxicity, warc
from foretide.llm.common import fold
from foretide.settings import fresh_path

FOLDER = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables not present")


def words(rng, n):
    return [rng.choice("lorem ipsum dolor sit amet tempor magna aliqua enim minim veniam quis nostrud".split()) + rng.choice("abcdefghij") for _ in range(n)]


def hash_of(text):
    """Fingerprint by the definition."""
    w = text.encode().lower().split()
    s = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([b" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if hs and 2 * sum(h >> b & 1 for h in hs) > len(hs))


def roots(fps, radius):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and (a ^ b).bit_count() <= radius:
                parent[find(a)] = find(b)
    return {f: find(f) for f in fps}


def test_fingerprints():
    rng = random.Random(1)
    for n in (0, 1, 3, 4, 5, 200):
        text = " ".join(words(rng, n)) + "\x0b Ä"
        assert simhash.fingerprint(text) == hash_of(text)
    long = " ".join(words(rng, 300_000))  # several chunks
    assert simhash.fingerprint(long) == hash_of(long)


def test_components_of_dense_and_chained_codes(spark):
    rng = random.Random(2)
    codes = {rng.getrandbits(64) for _ in range(300)}
    centre = rng.getrandbits(64)
    codes |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(400)}  # a dense group
    chain = rng.getrandbits(64)
    for i in range(15):  # each link is 4 bits away from the last
        chain ^= 0xF << (4 * i)
        codes.add(chain)
    signed = [(c - (1 << 64) if c >> 63 else c,) for c in codes]
    df = spark.createDataFrame(signed, "fp long")
    edges = simhash.links(df)
    assert edges.where("bit_count(a ^ b) > 4").count() == 0
    got = {r["node"] % (1 << 64): r["root"] for r in simhash.components(edges).collect()}
    want = roots(codes, 4)
    groups = {}
    for c in codes:
        groups.setdefault(want[c], set()).add(got.get(c, c))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)
    assert edges.count() < 20_000  # no listing of the 80,000 pairs of the dense group


@tables
def test_simhash_query(spark):
    rows = queries.QUERIES["op7_simhash"](spark, FOLDER).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    prints = {d: hash_of(t) for d, t in docs.items()}
    assert {r["doc_id"]: r["fingerprint"] for r in rows} == {d: f"{f:016x}" for d, f in prints.items()}
    want = roots(set(prints.values()), 4)
    least = {}
    for d, f in prints.items():
        least[want[f]] = min(d, least.get(want[f], d))
    assert {r["doc_id"]: r["component_id"] for r in rows} == {d: least[want[f]] for d, f in prints.items()}


def test_band_search_finds_edited_items():
    rng = random.Random(3)
    items = [(i, " ".join(words(rng, 40))) for i in range(5)]
    index = decontaminate.build(items)
    changed = items[1][1].split()
    changed[7], changed[23] = "other", "thing"
    half = " ".join(items[2][1].split()[:25])
    short = " ".join(items[3][1].split()[:6])
    long = " ".join(words(rng, 120_000))
    texts = [
        f"before {items[0][1].upper()} after",
        " ".join(["x", *changed, "y"]),
        f"lead {half} tail",
        f"lead {short} tail",
        long + " " + items[4][1].replace(" ", ",\n") + " end",
        None,
        "",
    ]
    found = [[h["item_id"] for h in hs] for hs in decontaminate.search(index, texts)]
    assert found == [[0], [1], [2], [], [4], [], []]
    hit = decontaminate.search(index, texts)[0][0]
    assert texts[0][hit["start"] : hit["end"]] == items[0][1].upper()


def test_band_search_equals_plain_edit_distance():
    rng = random.Random(4)

    def distance(pattern, text):  # best match of the pattern anywhere in the text
        row = [0] * (len(text) + 1)
        for i, p in enumerate(pattern, 1):
            prev, row[0] = row[0], i
            for j, t in enumerate(text, 1):
                prev, row[j] = row[j], min(prev + (p != t), row[j] + 1, row[j - 1] + 1)
        return min(row)

    for _ in range(25):
        item = " ".join(words(rng, 12))[:80].strip()
        index = decontaminate.build([(1, item)])
        body = list(item)
        for _ in range(rng.randint(0, 12)):
            at = rng.randrange(len(body))
            body[at : at + 1] = rng.choice([[], ["z"], [body[at], "q"]])
        text = "aa " + "".join(body) + " bb " + " ".join(words(rng, 30))
        norm = "".join(map(chr, decontaminate.normalise(text)[0]))
        want = distance("".join(map(chr, index.codes[0])), norm) <= index.budget(len(index.codes[0]))
        assert bool(decontaminate.search(index, [text])[0]) == want


def test_quotes_from_any_place_of_an_item_are_found():
    rng = random.Random(15)
    items = [(i, " ".join(words(rng, 60))) for i in range(4)]
    index = decontaminate.build(items)
    for size in (80, 100, 119):
        for i, item in items:
            for at in range(0, len(item) - size, 17):
                quote = item[at : at + size + 1].strip()
                if len(quote) < 80:
                    continue
                texts = [f"{' '.join(words(rng, 20))} 7{quote}7 {' '.join(words(rng, 20))}"]
                (hit,) = [h for h in decontaminate.search(index, texts)[0] if h["item_id"] == i]
                assert hit["distance"] == 0 and quote[8:-8] in texts[0][hit["start"] : hit["end"]]
                # and with a few edits inside
                body = list(quote)
                for p in (20, 45):
                    body[p] = "9"
                assert i in [h["item_id"] for h in decontaminate.search(index, [f"xx {''.join(body)} yy"])[0]]


def test_short_items_are_found_whole():
    index = decontaminate.build([(1, "What is the capital of Peru?"), (2, "No way"), (3, "what is THE capital of peru"), (4, " ".join(["long item text"] * 10)), (5, "é")])
    texts = ["He asked: what is the capital of Peru", "what is the capital of perus", "no, way", "anno way no wayx", "Well, NO WAY! É", "x" * 140_000 + " no way"]
    found = [[h["item_id"] for h in hs] for hs in decontaminate.search(index, texts)]
    assert found == [[1, 3], [], [2], [], [2, 5], [2]]
    hit = decontaminate.search(index, texts)[0][0]
    assert texts[0][hit["start"] : hit["end"]] == "what is the capital of Peru" and hit["distance"] == 0


def test_benchmark_in_blocks(spark, make):
    rng = random.Random(5)
    items = [(i, " ".join(words(rng, 30))) for i in range(12)]
    docs = make([(i, "x " + t + " y") for i, t in items] + [(99, "nothing of the kind")])
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(docs, bench, block_chars=500).collect()}
    assert {(i, i) for i, _ in items} <= got
    assert [r["doc_id"] for r in decontaminate.clean(docs, bench, block_chars=500).collect()] == [99]


def test_shards_are_even_and_grow_into_the_new_one(spark, make):
    rng = random.Random(6)
    docs = make([(i, "w" * rng.choice([1, 10, 400, 3000])) for i in range(2_000)])
    maps = sharding.plan(docs, 8, ["doc_id"], slots=512)
    second = maps.read(2)
    loads = [r[0] for r in second.groupBy("shard").sum("bytes").select("sum(bytes)").collect()]
    assert len(loads) == 8 and max(loads) - min(loads) < 3_100
    grown = {r["vslot"]: r["shard"] for r in maps.write(sharding.grow(second, 8), 3).collect()}
    assert all(grown[r["vslot"]] in (r["shard"], 8) for r in second.collect()) and 8 in grown.values()
    assert maps.versions() == [1, 2, 3]
    moved = sharding.rebalance(second, 8).join(second.withColumnRenamed("shard", "was"), "vslot").where("shard <> was").count()
    assert moved < 100  # an even map is hardly edited


def test_targets_are_the_reshared_excess(spark):
    sizes = {"a": 10, "b": 1_000, "c": 500, "d": 3, "e": 800, None: 700}
    rows = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), [5, 2, 1]).collect()
    names = ["a", "b", "c", "d", "e", None]
    w = {n: [5, 2, 1][i % 3] for i, n in enumerate(names)}
    want = {n: sum(sizes.values()) * w[n] / sum(w.values()) for n in names}
    for _ in range(50):
        over = {n for n in names if want[n] > 3 * sizes[n] + 1e-9}
        free = [n for n in names if want[n] < 3 * sizes[n] - 1e-9]
        excess = sum(want[n] - 3 * sizes[n] for n in over)
        for n in over:
            want[n] = 3 * sizes[n]
        for n in free:
            want[n] += excess * w[n] / sum(w[m] for m in free)
    assert {r["source"]: round(r["target"], 6) for r in rows} == {n: round(v, 6) for n, v in want.items()}


def test_schedule_follows_the_definition(spark, make):
    rng = random.Random(7)
    docs = make([(i, " ".join(words(rng, rng.choice([0, 3, 40, 200]))), f"s{i % 4}") for i in range(120)])
    placed, sources, pieces = mixing.mix(docs, [5, 2, 1], block=7)
    src = sorted(sources.collect(), key=lambda r: r["sid"])
    total = sum(r["source_size"] for r in src)
    bounds = np.cumsum([r["target"] for r in src]) / total * mixing.PERIOD
    turns = Counter(int(np.searchsorted(np.round(bounds), i * mixing.STRIDE % mixing.PERIOD, side="right")) for i in range(-(-total // 7)))
    used = Counter()
    for r in pieces.collect():
        used[r["sid"]] += r["words"]
    for r in src:
        assert used[r["sid"]] == min(turns[r["sid"]] * 7, 3 * r["source_size"])
    rows = mixing.taken(placed, pieces).collect()
    assert sum(r["taken"] for r in rows) == sum(used.values())
    again = mixing.taken(*[x for i, x in enumerate(mixing.mix(docs, [5, 2, 1], block=7)) if i != 1]).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in rows) == sorted((r["doc_id"], r["taken"]) for r in again)


def test_small_sources_get_their_words(spark, make, tmp_path):
    rng = random.Random(16)
    rows = [(i, "w " * 4_000, "a-hot") for i in range(150)]  # 600,000 words, so blocks of 9
    small = {"b": [1], "c": [2], "d": [1, 1], "e": [30], "f": [7, 5, 9], "g": [200], "h": [2, 3]}
    for source, sizes in small.items():
        rows += [(1_000 + len(rows) + k, " ".join(words(rng, n)), source) for k, n in enumerate(sizes)]
    docs = make(rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op2_mixture"](spark, str(tmp_path)).collect()
    source = {r[0]: r[2] for r in rows}
    used, target = Counter(), {}
    for r in got:
        used[source[r["doc_id"]]] += r["taken"]
        target[source[r["doc_id"]]] = r["target"]
        assert r["taken"] <= 3 * r["size"]
    assert used == {s: round(t) for s, t in target.items()}
    _, _, pieces = mixing.mix(docs, [5, 2, 1])
    order = {}
    for r in sorted(pieces.collect(), key=lambda r: (r["sid"], r["rank"])):
        assert r["turn"] >= order.get(r["sid"], 0)
        order[r["sid"]] = r["turn"]
    # A source whose target is less than half of its first document stays in the mix.
    weights = [1_000_000.0] + [1.0] * 7
    assert {r["source"] for r in mixing.mixed_documents(docs, weights).collect()} == set(target)
    two = make([(1, "w " * 900, "a"), (2, "w " * 900, "b"), (3, "w " * 900, "b")])
    assert {r["source"] for r in mixing.mixed_documents(two, [9, 1]).collect()} == {"a", "b"}


@tables
def test_token_files(spark):
    tk = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    path, file = fresh_path(spark, "tokens"), str(public.path("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(1000, "a b  c\t\n d\x1ce <|endoftext|> it's  "), (1001, None), (1002, "x\u0085 y")], "doc_id long, text string")
    docs = docs.unionByName(extra)
    tokens.write(docs, path, file, stripe_bytes=1 << 16, row_index_stride=1_000)
    plain = tk.Tokenizer.from_file(file)
    plain.encode_special_tokens = True
    at, want = 0, []
    for r in sorted(docs.collect(), key=lambda r: r["doc_id"]):
        ids = [*plain.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        want.append((r["doc_id"], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, tokens.digests(spark, path).collect())) == want
    plan = tokens.documents(spark, path, [3, 1001])
    assert "In(doc_id" in plan._jdf.queryExecution().toString().replace(" ", "") or "doc_id IN" in plan._jdf.queryExecution().toString()
    assert {r["doc_id"]: len(r["ids"]) for r in plan.collect()} == {w[0]: w[2] for w in want if w[0] in (3, 1001)}


def test_nnpu_ignores_hidden_labels():
    rng = np.random.default_rng(8)
    n, toxic = 3_000, rng.random(3_000) < 0.1
    x = np.column_stack([toxic & (rng.random(n) < 0.9), rng.random(n) < 0.3])
    known = toxic & (rng.random(n) < 0.5)
    rows, cols = np.nonzero(x)
    w, b = toxicity.nnpu_fit(rows, cols, known.astype(float), np.ones(n), 2, 0.1)
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert ((p >= 0.3) == x[:, 0]).mean() > 0.99 and abs(w[1]) < abs(w[0]) / 4


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="tables not present")
@pytest.mark.parametrize("name, column, part, parts, least", [("op4_toxicity", "toxic", 2, 4, 0.9), ("op8_quality", "quality", 1, 3, 0.98)])
def test_held_out_accuracy(spark, name, column, part, parts, least):
    folder = "/root/testdata/sf0.1"
    rows = queries.QUERIES[name](spark, folder)
    known = rows.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where(fold("doc_id", parts) == part).toPandas()
    assert known["held_out"].all()
    y, rank = known[column].to_numpy(), known["score"].rank().to_numpy()
    n1, n0 = y.sum(), (1 - y).sum()
    assert (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0) >= least
    assert (known["predicted"] == y).mean() >= 0.95


def test_repeated_windows():
    rng = random.Random(9)
    for _ in range(20):
        w = [rng.choice("ab") for _ in range(rng.randint(0, 60))]
        grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        cover = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        assert linefreq.repeated_words(" ".join(w)) == len(cover)


def test_line_frequency(make):
    rng = random.Random(10)
    footer = "All rights reserved by the site 2024"
    own = ["\n".join([" ".join(words(rng, 30)), footer]) for _ in range(30)]
    rows = [(i, t, "host") for i, t in enumerate(own)]
    rows += [(100 + i, footer.upper().replace("2024", "1999") + "\n" + " ".join(f"t{i}" for _ in range(1)) + "\n" + footer * 3, "host") for i in range(2)]
    rows += [(200 + i, own[0], "host") for i in range(40)]  # copies count once
    rows += [(300, footer + "\n" + " ".join(words(rng, 25)), "other")]
    docs = make(rows)
    out, over = linefreq.judge(docs, least=20, share=0.0)
    assert [(r["host"], r["n"]) for r in over.collect()] == [("host", 32)]
    kept = {r["doc_id"]: (r["kept"], r["removed_words"]) for r in out.collect()}
    assert all(kept[i] == (True, 7) for i in range(30)) and kept[300] == (True, 0)
    clean = {r["doc_id"]: r["text"] for r in linefreq.stripped(docs, over).collect()}
    assert clean[3] == own[3].split("\n")[0] and clean[300] == rows[-1][1]


def test_line_frequency_is_the_same_on_small_and_large_hosts(spark, make, tmp_path):
    rng = random.Random(14)
    footer = "All rights reserved by the site 2024"
    rows = []
    for host, n in (("small", 50), ("middle", 300), ("large", 1_200)):
        for i in range(n):  # the same share of every host has the footer; a tenth of those hold little else
            text = " ".join(words(rng, 25))
            if i % 5 == 0:
                text = "\n".join([footer] * 6 + [" ".join(words(rng, 3))]) if i % 50 == 0 else text + "\n" + footer
            rows.append((len(rows), text, host))
    rows += [(len(rows) + i, " ".join(words(rng, 25)) + ("\nSeen twice by chance" if i < 2 else ""), "tiny") for i in range(8)]
    make(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.QUERIES["op6_line_frequency"](spark, str(tmp_path)).collect()}
    for i, text, host in rows:
        held = text.count(footer)
        assert got[i]["removed_words"] == 7 * held, host
        assert got[i]["kept"] == (held < 6 and not got[i]["base_failed"]), host
    assert sum(got[i]["removed_words"] > 0 for i, _, host in rows if host == "small") == 10


def lines_of(text):
    """Lines by the rule."""
    import re

    return [x for x in re.split(linechunks.LINE_END, text) if x]


def test_chunks_are_the_text_and_shift_resistant(spark, make):
    rng = random.Random(11)
    passage = " ".join(" ".join(words(rng, 6)) + "." for _ in range(30)) + " "
    texts = [" ".join(" ".join(words(rng, 5)) + rng.choice(".,") for _ in range(20)) + " " for _ in range(6)]
    rows = [(i, t + (passage if i % 2 else "") + texts[-1 - i]) for i, t in enumerate(texts)]
    rows.append((50, "Start. " + passage))
    rows.append((60, "A mark \uffff in it. " + passage + "\n\nend."))
    docs = make(rows)
    from pyspark.sql import functions as F

    cut = {r["doc_id"]: r["c"] for r in docs.select("doc_id", linechunks.chunks(F.col("text")).alias("c")).collect()}
    for i, t in rows:
        assert "".join(x for c in cut[i] for x in c) == t
        assert [x for c in cut[i] for x in c] == lines_of(t)
    out = {r["doc_id"]: r for r in linechunks.dedup(docs).collect()}
    # Brute force over the chunks: the first place of each body stays.
    first, want = {}, {}
    for i, _ in sorted(rows):
        for pos, c in enumerate(cut[i]):
            body = "\n".join(x.strip() for x in c)
            if len(c) >= 2 and len(body) >= 48:
                if first.setdefault(body, (i, pos)) != (i, pos):
                    want.setdefault(i, []).append(pos)
    assert {i: r["removed"] for i, r in out.items() if r["removed"]} == want
    assert out[50]["removed_words"] > 100 and out[0]["removed_chunks"] == len(want.get(0, []))
    for i, _ in rows:
        assert out[i]["text"] == "".join(x for p, c in enumerate(cut[i]) if p not in want.get(i, []) for x in c)


def test_chunks_are_never_short_and_find_short_passages(spark, make):
    from pyspark.sql import functions as F

    rng = random.Random(12)

    def prose(n, least=1, most=12):  # clauses of all lengths
        out = []
        while len(out) < n:
            w = words(rng, min(rng.randint(least, most), n - len(out)))
            out += [*w[:-1], w[-1] + rng.choice(".,")]
        return " ".join(out)

    passages = [prose(rng.randint(50, 100), 5) for _ in range(60)]
    rows = [(i, f"{prose(rng.randint(60, 90))} {p} {prose(rng.randint(60, 90))}") for i, p in enumerate(passages * 2)]
    rows.append((900, "a.\nb\n\n\n" * 200 + prose(40, 1, 2)))  # a long run of the shortest lines
    docs = make(rows)
    cut = {r["doc_id"]: r["c"] for r in docs.select("doc_id", linechunks.chunks(F.col("text")).alias("c")).collect()}
    for i, t in rows:
        assert [x for c in cut[i] for x in c] == lines_of(t)
        assert all(len(c) >= 2 and len("\n".join(x.strip() for x in c)) >= 48 for c in cut[i]) and len(cut[i]) > 1
        # Borders by the definition: the least hash among all lines closer than a chunk on either side.
        size, hs = [len(x.strip()) + 1 for x in lines_of(t)], [xxhash.xxh64_intdigest(x.strip().encode(), 42) for x in lines_of(t)]
        hs, at, want = [h - (1 << 64) if h >> 63 else h for h in hs], np.cumsum(size), []
        for k in range(1, len(hs)):
            near = [j for j in range(1, len(hs) + 1) if j != k and (abs(j - k) < 2 or abs(at[j - 1] - at[k - 1]) < 49)]
            edge = k < 2 or len(hs) - k < 2 or at[k - 1] < 49 or at[-1] - at[k - 1] < 49
            if not edge and all(hs[k - 1] < hs[j - 1] if j < k else hs[k - 1] <= hs[j - 1] for j in near):
                want.append(k)
        assert np.cumsum([len(c) for c in cut[i]]).tolist() == [*want, len(hs)]
    out = {r["doc_id"]: r["removed_words"] for r in linechunks.dedup(docs).collect()}
    planted = sum(len(p.split()) for p in passages)
    assert sum(out[60 + i] for i in range(60)) >= 0.45 * planted
    assert sum(out[60 + i] == 0 for i in range(60)) <= 10


def test_warc_pushdown_and_revisits(spark):
    big = "<p>é" + "x" * 2_000
    pages = spark.createDataFrame(
        [(1, "http://a/1", big), (2, "http://a/2", "short"), (3, "http://a/3", "short"), (7, "http://a/7", big), (5, None, big), (9, "u", None)],
        "page_id long, url string, html string",
    )
    path = fresh_path(spark, "warc")
    warc.write_pages(pages, path)
    rows = {r["page_id"]: r for r in warc.read(spark, path).collect()}
    assert {k: (r["record_type"], r["refers_to"]) for k, r in rows.items()} == {
        1: ("revisit", 7), 5: ("revisit", 7), 7: ("response", None), 2: ("response", None), 3: ("response", None), 9: ("response", None)
    }
    assert bytes(rows[7]["payload"]).decode() == big and rows[1]["payload"] is None and rows[1]["payload_bytes"] == len(big.encode())
    only = warc.read(spark, path).where("record_type = 'revisit' and page_id in (1, 2, 7)")
    assert [r["page_id"] for r in only.collect()] == [1]
    reader = warc.WarcReader({"path": path})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    rest = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), GreaterThan(("page_id",), 1)]))
    assert len(rest) == 1 and reader.tests == [("record_type", frozenset(["revisit"]))]
    assert warc.read(spark, path, payload=False).where("payload is not null").count() == 0


@tables
def test_warc_query_equals_its_twin(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{FOLDER}/pages.parquet'")
    cur = con.execute(queries.TWINS["op10_warc"])
    names = [c[0] for c in cur.description]
    got = queries.QUERIES["op10_warc"](spark, FOLDER)
    assert sorted(got.columns) == sorted(names)
    assert sorted((tuple(r[n] for n in names) for r in got.collect()), key=str) == sorted(cur.fetchall(), key=str)


@tables
def test_shard_query(spark):
    rows = queries.QUERIES["op1_virtual_slots"](spark, FOLDER).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == {d: (len(t.encode()) + 8, zlib.crc32(t.encode())) for d, t in docs.items()}
    assert {r["shard"] for r in rows} == set(range(24))
    for s in range(24):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))


@tables
def test_mixture_query(spark):
    rows = queries.QUERIES["op2_mixture"](spark, FOLDER).collect()
    source = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    taken, target = Counter(), {}
    for r in rows:
        taken[source[r["doc_id"]]] += r["taken"]
        target[source[r["doc_id"]]] = r["target"]
        assert r["taken"] <= 3 * r["size"]
    assert all(abs(taken[s] - t) <= 0.01 * t + 8 for s, t in target.items())


def test_encoder_equals_the_library_on_odd_texts():
    public = pytest.importorskip("public_tokenizers")
    encoder = tokens.Encoder(str(public.path("byte_bpe_50k.json")))
    rng = random.Random(3)
    parts = [*"ab é'ñ,.;!?|%$&*# \n\t  　\u0085…“ж²3_-×÷ÿ́\U0001f600\x1c", "  ", " the", "don't", "'s", "n't", "ß", "\n\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(1_500)]
    ids, sizes = encoder.encode(texts)
    ends = np.cumsum(sizes)
    plain = encoder.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [ids[e - n : e].tolist() for e, n in zip(ends, sizes, strict=True)] == [p.ids for p in plain]


def test_token_query_equals_an_unmodified_tokenizer(spark, make, tmp_path):
    tk = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    texts = ["plain text, no token.", "x <|endoftext|> y", "<|endoftext|>", "a<|endoftext|><|endoftext|> b.\nIt's <|endoftext", "<|end of text|>", None, "é " * 300 + "<|endoftext|>tail\u00a0end"]
    make(list(enumerate(texts))).write.parquet(f"{tmp_path}/documents.parquet")
    plain = tk.Tokenizer.from_file(str(public.path("byte_bpe_50k.json")))
    at, want = 0, []
    for i, t in enumerate(texts):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert plain.encode(texts[1], add_special_tokens=False).ids == [87, 220, 50256, 331]
    assert sorted(map(tuple, queries.QUERIES["op3_tokens_orc"](spark, str(tmp_path)).collect())) == want
