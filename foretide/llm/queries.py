"""The registered queries of this subpackage: thin digests of the operators' results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foretide.llm import bpecount, decontaminate, divergence, linechunks, linefreq, mixing, quality, resample, sharding, simhash, tokens, toxicity, warc
from foretide.llm.common import fold, table
from foretide.settings import fresh_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TWINS: dict[str, str] = {}

SHARDS, WEIGHTS = 24, [5, 2, 1]

PAGES_SQL = """
with p as (select page_id, encode(coalesce(html, '')) as body from pages),
d as (select page_id, octet_length(body) as n, sha1(body) as digest from p),
g as (select digest, max(page_id) as last_id from d where n >= 1000 group by digest)
select d.page_id, cast(d.n as bigint) as payload_bytes, d.digest as payload_digest,
       case when g.last_id is null or g.last_id = d.page_id then 'response' else 'revisit' end as record_type,
       case when g.last_id <> d.page_id then g.last_id end as refers_to
from d left join g on d.digest = g.digest
"""


# CRC-32 of the distinct words by its table, built from the rule; sums and draw as the contract states them.
RESAMPLE_SQL = r"""
with tab as (
  select list(c order by i) as t from (
    select i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c
    from (select unnest(range(256)) as i))
),
d as (
  select row_number() over () as row, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
  from documents
),
b as (
  select regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
  from benchmark
),
dw as (select row, w, count(*) as n from (select row, unnest(words) as w from d) group by 1, 2),
bw as (select w, count(*) as n from (select unnest(words) as w from b) group by 1),
words as (select w from dw union select w from bw),
coded as (
  select w, xor(list_reduce(
      list_concat([4294967295], list_transform(range(1, octet_length(encode(w)) + 1), lambda k: cast('0x' || substr(hex(encode(w)), cast(2 * k - 1 as bigint), 2) as bigint))),
      lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 as bucket
  from words, tab
),
s as (select bucket, sum(n) as n from dw join coded using (w) group by 1),
t as (select bucket, sum(n) as n from bw join coded using (w) group by 1),
gain as (
  select k.bucket, cast(floor(1000 * ln(((coalesce(t.n, 0) + 1)::double * ((select coalesce(sum(n), 0) from s) + 10000)::double)
         / ((coalesce(s.n, 0) + 1)::double * ((select coalesce(sum(n), 0) from t) + 10000)::double))) as bigint) as g
  from (select unnest(range(10000)) as bucket) k left join s on s.bucket = k.bucket left join t on t.bucket = k.bucket
),
weights as (select row, sum(dw.n * g) as weight from dw join coded using (w) join gain using (bucket) group by 1),
scored as (
  select doc_id, len(words) as n_features, cast(coalesce(weight, 0) as bigint) as weight,
         cast(coalesce(weight, 0) + floor(-1000 * ln(-ln((cast('0x' || substr(sha256('2024:' || coalesce(cast(doc_id as varchar), '')), 1, 8) as bigint) + 0.5::double) / 4294967296::double))) as bigint) as score
  from d left join weights using (row)
),
drawn as (
  select *, row_number() over (partition by n_features >= 20 order by score desc, doc_id nulls last) as r, count(*) over (partition by n_features >= 20) as n from scored
)
select doc_id, cast(n_features as bigint) as n_features, weight, score, cast(case when n_features >= 20 and r <= 10 * n // 100 then r end as bigint) as "rank" from drawn
"""

DIVERGENCE_SQL = r"""
with d as (
  select row_number() over () as row, coalesce(lang, '') as lang, coalesce(source, '') as source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as terms
  from documents
),
grp as (select distinct lang, source from d),
occ as (select row, lang, source, term, count(*) as n from (select row, lang, source, unnest(terms) as term from d) group by all),
kept as (select lang, term from occ group by all having count(*) >= 30),
cnt as (select lang, source, term, sum(n)::hugeint as n from occ semi join kept on occ.lang = kept.lang and occ.term = kept.term group by all),
v as (select lang, count(*)::hugeint as v from kept group by all),
tot as (select lang, source, sum(n) as total from cnt group by all),
cells as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n,
         1 + (1000000000 * (coalesce(c.n, 0) + 5)) // (coalesce(tot.total, 0) + 5 * v.v) as p
  from grp g join kept k on g.lang = k.lang join v on v.lang = g.lang
  left join cnt c on c.lang = g.lang and c.source = g.source and c.term = k.term
  left join tot on tot.lang = g.lang and tot.source = g.source
),
lang_total as (select lang, sum(n) as total from cnt group by all),
lang_cnt as (select lang, term, sum(n) as n from cnt group by all),
per_lang as (
  select lang, term, 1 + (1000000000 * (n + 5)) // (total + 5 * v.v) as q from lang_cnt join lang_total using (lang) join v using (lang)
),
pair as (
  select a.lang, a.source, b.source as item, coalesce(sum(abs(x.p - y.p)), 0) as value
  from grp a join grp b on a.lang = b.lang and a.source <> b.source
  left join cells x on x.lang = a.lang and x.source = a.source
  left join cells y on y.lang = b.lang and y.source = b.source and y.term = x.term
  group by all
),
term as (
  select c.lang, c.source, c.term as item, c.p - l.q as value from cells c join per_lang l on l.lang = c.lang and l.term = c.term where c.n > 0 and c.p > l.q
),
parts as (select lang, source, 'pair' as part, item, value from pair union all select lang, source, 'term', item, value from term),
ordered as (select *, row_number() over (partition by lang, source, part order by value desc, item) as r from parts)
select lang, source, part, item, cast(value as bigint) as value, cast(r as int) as "rank" from ordered where part = 'pair' or r <= 50
"""


def query(name: str, twin: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if twin:
            TWINS[name] = twin
        return fn

    return keep


@query("op1_virtual_slots")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    keys = ["doc_id", "text"]
    slots = sharding.plan(docs, SHARDS, keys).read(2)
    placed = sharding.place(docs, slots, keys).select(
        "doc_id",
        sharding.size_of().alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        "vslot",
        "shard",
    )
    out = sharding.numbered(placed, slots, ["doc_id", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot")


@query("op2_mixture")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, _, pieces = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), WEIGHTS)
    return mixing.taken(placed, pieces).select("doc_id", "size", "source_size", "target", "taken")


@query("op3_tokens_orc")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = fresh_path(spark, "tokens")
    tokens.write(table(spark, sf_dir, "documents"), path, str(public_tokenizers.path("byte_bpe_50k.json")), added=True)
    return tokens.digests(spark, path)


@query("op4_toxicity")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(fold("doc_id", 4) != 2))
    held = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    return toxicity.score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


@query("op5_decontaminate")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op6_line_frequency")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = linefreq.judge(table(spark, sf_dir, "documents"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed_words")
    return rows.select("doc_id", *counts, "base_failed", "kept")


@query("op7_simhash")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op8_quality")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels").where(fold("doc_id", 3) != 1))
    held = F.coalesce(fold("doc_id", 3) == 1, F.lit(False))
    return quality.score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


@query("op9_line_chunks")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linechunks.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), least_chars=32, window=2, extend=True)
    return out.select("doc_id", "removed_chunks", "removed_words", "removed", F.crc32(F.col("text").cast("binary")).alias("kept_crc32"), "text")


@query("op10_warc", PAGES_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    warc.write_pages(table(spark, sf_dir, "pages"), path)
    # A response is measured on its payload as read back; a revisit has only its headers.
    size = F.coalesce(F.octet_length("payload"), F.col("payload_bytes")).cast("long")
    digest = F.coalesce(F.sha1("payload"), F.col("payload_digest"))
    return warc.read(spark, path).select("page_id", size.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to")


@query("op11_resample", RESAMPLE_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample.draw(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


@query("op12_divergence", DIVERGENCE_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


@query("op13_token_counts")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpecount.counts(docs, str(public_tokenizers.path("byte_bpe_50k.json"))).select("doc_id", "n_bytes", "n_tokens", "over_limit")
