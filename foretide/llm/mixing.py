"""Mixing sources to target weights by a low-discrepancy schedule.

Turn i of the mix is the point frac(i * golden ratio), here in 31-bit integers so that a
whole period is exactly even.  Points run through the cumulative target weights to a
source; the turns of a source are ranked, and turn r of a source takes block r of it.
Blocks are equal runs of tokens: the documents of a source are laid end to end in a hashed
order, again and again up to ``max_epochs`` times, and cut every ``block`` tokens.

Every source gets its target to the word, however small: what the schedule's turns give
beyond it is cut off, and what they leave is settled by further blocks, the last one
partial, at the turns where they stand evenly in the mix.

Only DataFrame expressions.  Texts are read once, to a slim table of (source, size,
position hash).  Positions in a source and ranks of turns are running sums in two levels,
hash range (or stretch of turns) first, then inside it, so a source with a third of all
documents is never one task; the join is on (source, block), which is even.

Nulls and texts without words have size 0 and take nothing.  A null source is a source
of its own, last in order.  A null doc_id or repeated row is placed by its hash; repeated
rows lie next to each other.  Empty tables give an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foretide.llm.common import row_hash
from foretide.settings import materialise

PERIOD = 1 << 31
STRIDE = 1_327_217_885  # odd and nearest to PERIOD times the golden ratio's fraction
LEAST_TURNS, MOST_BLOCK = 65_536, 4_096
STRETCH = 8_192  # turns ranked together
RANGES = 2_048  # hash ranges of the documents of a source


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: list[float], max_epochs: int = 3) -> DataFrame:
    """(source, sid, source_size, target) of (source, source_size).

    Sources in code-point order, null last, take ``weights`` in turn and share the total;
    no target exceeds ``max_epochs`` times its source.  Re-sharing the excess by weight ends
    where every target is min(cap, level * weight); the level is found over the sources
    sorted by cap per weight.  One row per source meets in this window, not its documents.
    """
    spark_order = Window.partitionBy().orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("sid", F.row_number().over(spark_order) - 1)
    ws = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.withColumn("_w", F.element_at(ws, F.pmod("sid", F.lit(len(weights))) + 1)).withColumn("_cap", F.col("source_size").cast("double") * max_epochs)
    fill = Window.partitionBy().orderBy(F.col("_cap") / F.col("_w"), "sid")
    lower = fill.rowsBetween(Window.unboundedPreceding, -1)
    here = fill.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    stepped = ranked.withColumn(
        "_level",
        (F.sum(F.col("source_size").cast("double")).over(whole) - F.coalesce(F.sum("_cap").over(lower), F.lit(0.0))) / F.sum("_w").over(here),
    )
    # From the first source on whose cap reaches the level, nobody is cut.
    level = F.min(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.struct(F.col("_cap") / F.col("_w"), F.col("sid"), F.col("_level")))).over(whole)["_level"]
    return stepped.select("source", F.col("sid").cast("int").alias("sid"), "source_size", F.least("_cap", level * F.col("_w")).alias("target"))


def turns(plan: DataFrame, total: int, block: int) -> DataFrame:
    """(turn, sid, rank): the schedule, each source's turns numbered from 0."""
    spark = plan.sparkSession
    n = -(-total // block) if total else 0
    point = F.pmod(F.pmod(F.col("id"), F.lit(PERIOD)) * F.lit(STRIDE), F.lit(PERIOD))
    cell_bits = 12  # sources are looked up by the cell of a point
    upper = F.sum("target").over(Window.partitionBy().orderBy("sid").rowsBetween(Window.unboundedPreceding, 0))
    share = F.greatest(F.sum("target").over(Window.partitionBy()), F.lit(1e-9))
    bounds = plan.withColumn("_hi", F.when(F.col("sid") == F.max("sid").over(Window.partitionBy()), F.lit(PERIOD)).otherwise(F.round(upper / share * PERIOD)).cast("long"))
    bounds = bounds.withColumn("_lo", F.lag("_hi", 1, 0).over(Window.partitionBy().orderBy("sid"))).where("_lo < _hi")
    width = PERIOD >> cell_bits
    cells = bounds.select("sid", "_lo", "_hi", F.explode(F.sequence(F.floor(F.col("_lo") / width), F.floor((F.col("_hi") - 1) / width))).alias("_cell"))
    drawn = spark.range(n).select(F.col("id").alias("turn"), point.alias("_u")).withColumn("_cell", F.floor(F.col("_u") / width))
    dealt = drawn.join(cells, "_cell").where("_lo <= _u and _u < _hi").select("turn", "sid", F.floor(F.col("turn") / STRETCH).alias("_s"))
    per = dealt.groupBy("sid", "_s").agg(F.count("*").alias("_n"))
    before = per.select("sid", "_s", F.coalesce(F.sum("_n").over(Window.partitionBy("sid").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("sid", "_s").orderBy("turn"))
    return dealt.join(before, ["sid", "_s"]).select("turn", "sid", (F.col("_before") + inside - 1).alias("rank"))


def settled(schedule: DataFrame, plan: DataFrame, total: int, block: int) -> DataFrame:
    """``schedule`` with further turns for the sources that it leaves below their targets.

    A further turn comes where rank r of the source stands evenly in the mix, and not before
    the source's last turn of the schedule.
    """
    n = -(-total // block) if total else 0
    had = schedule.groupBy("sid").agg(F.count("*").alias("_n"), F.max("turn").alias("_last"))
    short = plan.select("sid", "target", F.ceil(F.round("target") / block).alias("_need")).join(had, "sid", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    ranks = short.where("_need > _n").select("sid", "target", "_last", F.explode(F.sequence(F.col("_n"), F.col("_need") - 1)).alias("rank"))
    even = F.floor((F.col("rank") + 0.5) * block / F.col("target") * n)
    turn = F.greatest(F.least(even, F.lit(n - 1)), F.coalesce("_last", F.lit(0)))
    return schedule.unionByName(ranks.select(turn.cast("long").alias("turn"), "sid", F.col("rank").cast("long").alias("rank")))


def laid_out(slim: DataFrame) -> DataFrame:
    """``slim`` (sid, size, h, …) with ``start``: tokens of its source before it, in hash order."""
    ranged = slim.withColumn("_r", F.pmod(F.shiftrightunsigned("h", 50), F.lit(RANGES)).cast("int"))
    per = ranged.groupBy("sid", "_r").agg(F.sum("size").alias("_n"))
    before = per.select("sid", "_r", F.coalesce(F.sum("_n").over(Window.partitionBy("sid").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.sum("size").over(Window.partitionBy("sid", "_r").orderBy("h", "doc_id", "key").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    return ranged.join(before, ["sid", "_r"]).withColumn("start", F.col("_before") + inside).drop("_r", "_before")


def mix(
    docs: DataFrame, weights: list[float], max_epochs: int = 3, block: int | None = None, seed: int = 17
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mix of ``docs`` (doc_id, source, text): documents, sources and pieces.

    * documents: doc_id, key, size, sid, start, source, source_size, target
    * pieces: turn, sid, rank, doc_id, key, epoch, start (in the document), words;
      in turn order they are the mixed stream
    * sources: source, sid, source_size, target

    ``block`` defaults to a 65,536th of all tokens, between 1 and 4,096, and each source's
    words are settled to its target.  With a ``block`` of the caller's the turns of the
    schedule are taken as they are, whole blocks only.
    """
    settle = block is None
    slim = materialise(
        docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), row_hash(docs).alias("key")).withColumn(
            "h", F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("key"))
        ),
        "mix-documents",
    )
    sources = materialise(targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs).coalesce(1), "mix-sources")
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    block = block or max(1, min(MOST_BLOCK, total // LEAST_TURNS))
    # One row per source: Spark broadcasts the table where it is small and splits skew where it is not.
    known = slim.join(sources.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    placed = materialise(laid_out(known).drop("h"), "mix-placed")
    # A little beyond the target: the schedule may give a source a few turns more than its share.
    rounds = F.least(F.lit(max_epochs - 1), F.floor((F.col("target") + 64 * block) / F.col("source_size"))).cast("int")
    limit = F.round("target").cast("long") if settle else F.lit(None).cast("long")
    again = placed.where("size > 0").select("doc_id", "key", "sid", "size", limit.alias("_limit"), F.explode(F.sequence(F.lit(0), rounds)).alias("epoch"), (F.col("epoch") * F.col("source_size") + F.col("start")).alias("_at"))
    again = again.withColumn("_end", F.least(F.col("_at") + F.col("size"), F.col("_limit"))).where("_at < _end")
    cut = again.withColumn("rank", F.explode(F.sequence(F.floor(F.col("_at") / block), F.floor((F.col("_end") - 1) / block))))
    low = F.greatest(F.col("_at"), F.col("rank") * block)
    high = F.least(F.col("_end"), (F.col("rank") + 1) * block)
    blocks = cut.select("sid", "rank", "doc_id", "key", "epoch", (low - F.col("_at")).alias("start"), (high - low).alias("words"))
    schedule = turns(sources, total, block)
    if settle:
        schedule = settled(materialise(schedule, "mix-turns"), sources, total, block)
    pieces = schedule.join(blocks, ["sid", "rank"])
    return placed, sources, pieces


def taken(placed: DataFrame, pieces: DataFrame) -> DataFrame:
    """``placed`` with the words that the mix takes of each document (or of its equal rows together)."""
    sums = pieces.groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).agg(F.sum("words").alias("_taken"))
    rows = placed.withColumn("_n", F.count("*").over(Window.partitionBy("doc_id", "key")))
    match = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))
    # Equal rows share what they take; the first of them get the remainder.
    turn = F.row_number().over(Window.partitionBy("doc_id", "key").orderBy("start"))
    all_taken = F.coalesce("_taken", F.lit(0))
    one = F.floor(all_taken / F.col("_n")) + F.when(turn <= F.pmod(all_taken, F.col("_n")), 1).otherwise(0)
    return rows.join(sums, match, "left").withColumn("taken", one.cast("long")).drop("_id", "_key", "_taken", "_n")


def mixed_documents(docs: DataFrame, weights: list[float], max_epochs: int = 3, block: int | None = None) -> DataFrame:
    """``docs`` repeated as the mix takes them: whole documents, to the nearest number of copies.

    A prefix of each source's stream is taken, so all but one of its documents are taken
    a whole number of times and only that one is rounded.  The first document of a source
    that has a share in the mix is kept once at least, so rounding drops no source.
    """
    placed, _, pieces = mix(docs, weights, max_epochs, block)
    least = F.when((F.min("start") == 0) & (F.sum("taken") > 0), 1).otherwise(0)
    copies = taken(placed, pieces).where("size > 0").groupBy("doc_id", "key")
    copies = copies.agg(F.greatest(F.round(F.sum("taken") / F.sum("size")), least).cast("int").alias("_copies"))
    copies = copies.where("_copies > 0").withColumnRenamed("doc_id", "_id").withColumnRenamed("key", "_key")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), row_hash(docs).alias("_own"))
    match = F.col("_row.doc_id").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_key"))
    return own.join(copies, match).select("_row", F.explode(F.sequence(F.lit(1), "_copies")).alias("_copy")).select("_row.*")
