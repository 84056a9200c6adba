"""Every operator and stage on nulls, empty and very long texts, repeated rows, clashing names, empty tables."""

import pytest

import corpus_pipeline
from foretide.llm import decontaminate, linechunks, linefreq, mixing, quality, sharding, simhash, tokens, toxicity, warc
from foretide.settings import fresh_path

TOKENIZERS = pytest.importorskip("public_tokenizers")


def bench(spark):
    return spark.createDataFrame([(1, "plain words of a short text that says a little more than nothing at all today"), (2, None), (None, "")], "item_id long, text string")


@pytest.fixture(params=["odd", "clashing", "empty"])
def docs(request):
    return request.getfixturevalue(request.param)


def test_shards(docs):
    keys = ["doc_id", "text"]
    maps = sharding.plan(docs, 4, keys, slots=64)
    out = sharding.numbered(sharding.place(docs, maps.read(2), keys, 64), maps.read(2), ["doc_id"]).collect()
    assert len(out) == docs.count()
    for shard in {r["shard"] for r in out}:
        assert sorted(r["slot"] for r in out if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in out)))


def test_mix(docs):
    placed, sources, pieces = mixing.mix(docs, [5, 2, 1])
    rows = mixing.taken(placed, pieces).collect()
    assert len(rows) == docs.count()
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    assert mixing.mixed_documents(docs, [5, 2, 1]).columns == docs.columns


def test_tokens(spark, docs):
    path = fresh_path(spark, "t")
    tokens.write(docs, path, str(TOKENIZERS.path("byte_bpe_50k.json")))
    rows = sorted(tokens.digests(spark, path).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["start"]))
    assert len(rows) == docs.count()
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]


def test_toxicity(docs, labels):
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.reject(docs, model).columns == docs.columns


def test_quality(docs, labels):
    rows = quality.score(docs, quality.fit(docs, labels, updates=100)).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)


def test_no_labels(odd, labels):
    none = labels.limit(0)
    assert {r["score"] for r in quality.score(odd, quality.fit(odd, none)).collect()} == {0.5}
    assert {round(r["score"], 6) for r in toxicity.score(odd, toxicity.fit(odd, none)).collect()} == {0.1}


def test_decontaminate(spark, docs):
    hits = decontaminate.matches(docs, bench(spark)).collect()
    kept = decontaminate.clean(docs, bench(spark))
    assert [h["doc_id"] for h in hits] == ([1, 1] if docs.count() else [])
    assert kept.count() == docs.count() - len(hits) and kept.columns == docs.columns
    assert decontaminate.clean(docs, bench(spark).limit(0)).count() == docs.count()


def test_simhash(docs):
    rows = simhash.classes(docs).collect()
    assert len(rows) == docs.count()
    zero = {r["component_id"] for r in rows if r["fingerprint"] == "0" * 16}
    assert zero == ({2} if rows else set())
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len({r["component_id"] for r in rows})


def test_line_frequency(docs):
    rows, over = linefreq.judge(docs)
    assert rows.count() == docs.count()
    assert linefreq.stripped(docs, over).columns == docs.columns


def test_line_chunks(docs):
    out = linechunks.dedup(docs)
    assert out.count() == docs.count()
    assert sorted(str(r["text"]) for r in out.where("removed_chunks = 0").select("text").collect()) == sorted(
        str(r["text"]) for r in docs.join(out.where("removed_chunks > 0").select("doc_id"), "doc_id", "left_anti").select("text").collect()
    )


def test_warc(spark, docs):
    pages = docs.selectExpr("doc_id as page_id", "source as url", "text as html", "lang as payload", "lang as refers_to")
    path = fresh_path(spark, "w")
    warc.write_pages(pages, path)
    rows = warc.read(spark, path).collect()
    want = sorted((p["page_id"] or -1, (p["html"] or "").encode()) for p in pages.collect())
    assert sorted((r["page_id"] or -1, bytes(r["payload"])) for r in rows) == want


def test_stages(spark, docs, labels, tmp_path, monkeypatch):
    tables = {"labels": labels, "benchmark": bench(spark)}
    monkeypatch.setattr(corpus_pipeline, "table", lambda _s, _d, name: tables[name])
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, "unused")
        if name != "shard":
            assert now.columns == docs.columns, name
        now.write.parquet(path := f"{tmp_path}/{name}")
        now = spark.read.parquet(path)
    assert now.count() <= 3 * docs.count()
