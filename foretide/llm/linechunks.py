"""Line dedup by content-defined chunks.

A text is a sequence of lines; a line ends at a line feed or after the punctuation that
ends a sentence or clause.  Each line is hashed, and a chunk ends after a line whose hash is
the least among its neighbours: all lines whose ends are less than ``least_lines`` lines or
less than ``least_chars`` characters away on either side.  Two borders are therefore never
closer than that, so every chunk has ``least_lines`` lines and ``least_chars`` characters,
and only a whole text can be shorter.  With ``window`` above one the hash rolls over that many line
hashes, the line's own last.  A border depends on its neighbours only, so a passage
pasted elsewhere is cut in the same places, wherever it starts.  A chunk that occurs more
than once anywhere is kept at its first place, by doc_id and position, and removed elsewhere.

Equal hashes are candidates only: the chunks' bytes are compared, and a hash that two
different chunks share removes nothing.

The ends of a passage lie in chunks that hold foreign lines too.  With ``extend`` each stretch of
removed chunks grows to both sides, line by line, as far as the lines before and after it equal those
before and after the first place of its outermost chunk.  A line removed so stands at an earlier
place, of which the same can be said, so one copy of every line stays.

Only DataFrame expressions.  Cutting happens inside the row, without a shuffle, and its
chunks are written once; what is grouped is one slim row per chunk, with partial
aggregates.

Nulls stay null and empty texts empty.  Rows that are equal in every column count as one
document and are treated alike.  A null doc_id comes last in the order of places.  An
empty table gives no rows; input columns named like an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretide.llm.common import maybe_in, row_hash
from foretide.settings import materialise

LINE_END = r"(?<=\n)|(?<=[.!?,;:] )"
MARK = "\uffff"  # a code point that is no character
_SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(_SPACE))


def lines(text: Column) -> Column:
    """The lines of a text; marking the ends and cutting at the mark is the quick way to split there."""
    marked = F.split(F.regexp_replace(text, r"(\n|[.!?,;:] )", "$1" + MARK), MARK)
    exact = F.split(text, LINE_END)
    return F.filter(F.when(F.contains(text, F.lit(MARK)), exact).otherwise(marked), lambda x: x != "")


def _borders(text: Column, least_lines: int, least_chars: int, window: int = 1) -> Column:
    """One-element array of a struct: the lines, the lines without the white space around them, and the chunks' last lines."""
    far = least_chars + 1  # a line counts its characters and the line feed that joins it in a body
    most = max(least_lines, far)  # lines that are a chunk whatever their lengths

    def scanned(hs: Column, sizes: Column, below) -> Column:
        """Do the lines make a chunk of the least size, and is the own hash below those of all lines before its end?"""
        start = F.struct(F.lit(0).alias("far"), F.lit(0).alias("n"), F.lit(True).alias("least"))

        def step(a: Column, p: Column) -> Column:
            short = (a["far"] < far) | (a["n"] < least_lines)
            # The line that crosses the least size belongs to the chunk, its far end is no neighbour.
            d, n = a["far"] + p["size"], a["n"] + 1
            near = short & ((d < far) | (n < least_lines))
            return F.struct(d.alias("far"), n.alias("n"), (a["least"] & (~near | F.coalesce(below(p["h"]), F.lit(False)))).alias("least"))

        pairs = F.zip_with(sizes, hs, lambda x, h: F.struct(x.alias("size"), h.alias("h")))
        return F.aggregate(pairs, start, step, lambda a: a["least"] & (a["far"] >= far) & (a["n"] >= least_lines))

    def ends(v: Column) -> Column:
        n = F.size(v["lines"])

        def here(i: Column) -> Column:
            own = F.get(v["hs"], i - 1)

            def side(size, other, below, slow: Column) -> Column:
                """Few lines are looked at one by one, a long run of short ones is scanned."""
                out, length, least = None, None, F.lit(True)
                for k in range(1, least_lines + 4):
                    length = size(k) if length is None else length + size(k)
                    if k >= least_lines:
                        out = (F if out is None else out).when(length >= far, least)
                    least = least & below(other(k))
                return out.otherwise(slow)

            def under(x: Column) -> Column:
                return own < x

            def upto(x: Column) -> Column:
                return own <= x

            left, right = F.least(i, F.lit(most)), F.least(n - i, F.lit(most))
            back = scanned(F.reverse(F.slice(v["hs"], F.greatest(i - left, F.lit(1)), F.least(left, i - 1))), F.reverse(F.slice(v["sizes"], i - left + 1, left)), under)
            ahead = scanned(F.slice(v["hs"], i + 1, right), F.slice(v["sizes"], i + 1, right), upto)
            before = side(lambda k: F.get(v["sizes"], i - k), lambda k: F.get(v["hs"], i - 1 - k), under, back)
            after = side(lambda k: F.get(v["sizes"], i + k - 1), lambda k: F.get(v["hs"], i + k - 1), upto, ahead)
            # The next line on either side settles most lines.
            beside = under(F.get(v["hs"], i - 2)) & upto(F.get(v["hs"], i)) if least_lines > 1 else F.lit(True)
            inner = F.when((i < least_lines) | (n - i < least_lines), False).when(~beside, False).when(~before, False).otherwise(after)
            return (i == n) | inner

        return F.filter(F.sequence(F.lit(1), n), here)

    # Each step goes through a one-element array, so that its value is computed once per row.
    cut = F.transform(F.array(lines(text)), lambda v: F.struct(v.alias("lines"), F.transform(v, _trimmed).alias("plain")))
    sized = F.transform(
        cut,
        lambda v: F.struct(
            v["lines"].alias("lines"), v["plain"].alias("plain"),
            F.transform(v["plain"], lambda x: F.xxhash64(x)).alias("hs"), F.transform(v["plain"], lambda x: F.length(x) + 1).alias("sizes"),
        ),
    )
    if window > 1:

        def rolled(v: Column) -> Column:
            return F.transform(v["hs"], lambda h, i: F.xxhash64(h, *[F.get(v["hs"], i - k) for k in range(1, window)]))

        sized = F.transform(sized, lambda v: F.struct(v["lines"].alias("lines"), v["plain"].alias("plain"), rolled(v).alias("hs"), v["sizes"].alias("sizes")))
    none = F.array().cast("array<int>")
    return F.transform(
        sized, lambda v: F.struct(v["lines"].alias("lines"), v["plain"].alias("plain"), F.when(F.size(v["lines"]) > 0, ends(v)).otherwise(none).alias("ends"))
    )


def _spans(v: Column, name: str, end: Column, k: Column) -> Column:
    start = F.when(k == 0, F.lit(0)).otherwise(F.get(v["ends"], k - 1))
    return F.slice(v[name], start + 1, end - start)


def chunks(text: Column, least_lines: int = 2, least_chars: int = 48, window: int = 1) -> Column:
    """Array of chunks, each an array of lines; put together they are the text."""
    cut = _borders(text, least_lines, least_chars, window)
    return F.element_at(F.transform(cut, lambda v: F.transform(v["ends"], lambda e, k: _spans(v, "lines", e, k))), 1)


def hashed_chunks(text: Column, least_lines: int = 2, least_chars: int = 48, window: int = 1) -> Column:
    """Array of chunks with their text and the hash of what is compared; no hash for those too short to count."""

    def counted(lines_: Column) -> Column:
        body = F.array(F.when(F.size(lines_) >= least_lines, F.array_join(lines_, "\n")))
        return F.element_at(F.transform(body, lambda b: F.when(F.length(b) >= least_chars, F.xxhash64(b))), 1)

    def one(v: Column, e: Column, k: Column) -> Column:
        return F.struct(F.array_join(_spans(v, "lines", e, k), "").alias("c"), counted(_spans(v, "plain", e, k)).alias("h"))

    cut = _borders(text, least_lines, least_chars, window)
    return F.element_at(F.transform(cut, lambda v: F.transform(v["ends"], lambda e, k: one(v, e, k))), 1)


def _bytes(chunk: Column) -> Column:
    """What is compared: the lines without the white space around them."""
    return F.array_join(F.transform(chunk, _trimmed), "\n")


def _same_lines(own: Column, other: Column) -> Column:
    """How many lines agree from the start of both arrays on."""
    agree = F.zip_with(own, other, lambda x, y: F.coalesce(_trimmed(x) == _trimmed(y), F.lit(False)))
    return F.coalesce(F.nullif(F.array_position(agree, False), F.lit(0)) - 1, F.size(agree)).cast("int")


def _trims(rows: DataFrame, spots: DataFrame) -> DataFrame:
    """(_id, _key, trims): chunks beside removed ones, by position, with what stays of them and the words that go.

    ``rows`` holds _id, _key and the chunks _c; ``spots`` _gone_id, _gone_key, removed and first, for each
    removed chunk in order its position and the first place of the same chunk.
    """

    def beside(step: int) -> Column:
        def open_end(s: Column, i: Column) -> Column:
            alone = ~F.coalesce(F.get("removed", i + step) == s["pos"] + step, F.lit(False))
            return alone & (s["pos"] + step >= 0) & (s["place"]["pos"] + step >= 0)

        def edge(s: Column) -> Column:
            first = s["place"]
            return F.struct(F.lit(step).alias("step"), (s["pos"] + step).alias("pos"), first["_id"].alias("c_id"), first["_key"].alias("c_key"), (first["pos"] + step).alias("c_pos"))

        return F.transform(F.filter("first", open_end), edge)

    edges = materialise(
        spots.select(F.col("_gone_id").alias("_id"), F.col("_gone_key").alias("_key"), F.explode(F.concat(beside(-1), beside(1))).alias("_e")).select("_id", "_key", "_e.*"),
        "chunks-edges",
    )
    wanted = edges.select("_id", "_key", "pos").unionByName(edges.select(F.col("c_id").alias("_id"), F.col("c_key").alias("_key"), F.col("c_pos").alias("pos")))
    at = F.xxhash64("_id", "_key", "pos")
    some = maybe_in(rows.select("_id", "_key", "_c"), wanted, "_key").select("_id", "_key", F.posexplode("_c").alias("pos", "c"))
    held = maybe_in(some.withColumn("_at", at), wanted.withColumn("_at", at), "_at").groupBy("_id", "_key", "pos").agg(F.min("c").alias("c"))
    held = materialise(held, "chunks-beside")
    theirs = held.select(F.col("_id").alias("o_id"), F.col("_key").alias("o_key"), F.col("pos").alias("o_pos"), F.col("c").alias("other"))
    mine = held.select(F.col("_id").alias("m_id"), F.col("_key").alias("m_key"), F.col("pos").alias("m_pos"), F.col("c").alias("own"))
    both = edges.join(theirs, F.col("c_id").eqNullSafe(F.col("o_id")) & (F.col("c_key") == F.col("o_key")) & (F.col("c_pos") == F.col("o_pos"))).join(
        mine, F.col("_id").eqNullSafe(F.col("m_id")) & (F.col("_key") == F.col("m_key")) & (F.col("pos") == F.col("m_pos"))
    )
    back = F.col("step") == -1
    a, b = lines(F.col("own")), lines(F.col("other"))
    same = _same_lines(F.when(back, F.reverse(a)).otherwise(a), F.when(back, F.reverse(b)).otherwise(b))
    cuts = (
        both.select("_id", "_key", "pos", "own", back.alias("back"), same.alias("n"))
        .where("n > 0")
        .groupBy("_id", "_key", "pos")
        .agg(F.min("own").alias("own"), F.coalesce(F.max(F.when(~F.col("back"), F.col("n"))), F.lit(0)).alias("head"), F.coalesce(F.max(F.when(F.col("back"), F.col("n"))), F.lit(0)).alias("tail"))
    )
    left = F.transform(F.array(lines(F.col("own"))), lambda v: F.array_join(F.slice(v, F.col("head") + 1, F.greatest(F.size(v) - F.col("head") - F.col("tail"), F.lit(0))), ""))
    cuts = cuts.select("_id", "_key", "pos", F.element_at(left, 1).alias("c"), F.regexp_count("own", F.lit(WORD)).alias("words"))
    cuts = cuts.withColumn("words", F.col("words") - F.regexp_count("c", F.lit(WORD)))
    return cuts.groupBy("_id", "_key").agg(F.collect_list(F.struct("pos", "c")).alias("trims"), F.sum("words").cast("long").alias("trimmed_words"))


def dedup(docs: DataFrame, least_lines: int = 2, least_chars: int = 48, window: int = 1, extend: bool = False) -> DataFrame:
    """``docs`` with repeated chunks removed from ``text``.

    Adds removed_chunks, removed_words and removed (positions of the chunks); ``removed_words`` counts the
    lines that stretches grew by too.
    """
    columns = [c for c in docs.columns if c not in ("removed_chunks", "removed_words", "removed")]
    own = docs.select(*[F.col(f"`{c}`") for c in columns])
    rest = [F.col(f"`{c}`") for c in columns if c != "text"]
    cut = F.when(F.col("text").isNotNull(), hashed_chunks(F.col("text"), least_lines, least_chars, window))
    rows = own.select(F.col("doc_id").alias("_id"), row_hash(own).alias("_key"), F.struct(*rest).alias("_row"), cut.alias("_p"))
    # Cut once: all that follows reads this table, and all but the byte comparison and the result only the hashes.
    rows = materialise(rows.select("_id", "_key", "_row", F.col("_p.c").alias("_c"), F.col("_p.h").alias("_h")), "chunks")
    parts = rows.select("_id", "_key", F.posexplode("_h").alias("pos", "h")).where("h is not null")
    place = F.struct(F.col("_id").isNull().alias("none"), "_id", "_key", "pos")
    repeated = parts.groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("h", "first")
    repeated = materialise(repeated, "chunks-repeated")
    # Byte comparison: all bodies of a hash must be one.
    bodies = rows.select(F.explode(F.arrays_zip(F.col("_c").alias("c"), F.col("_h").alias("h"))).alias("_p")).select("_p.c", "_p.h").where("h is not null")
    bodies = maybe_in(bodies, repeated, "h").groupBy("h", _bytes(lines(F.col("c"))).alias("body")).agg(F.lit(1).alias("one"))
    same = bodies.groupBy("h").agg(F.count("*").alias("bodies"), F.min(F.regexp_count("body", F.lit(WORD))).alias("words")).where("bodies = 1").select("h", "words")
    real = materialise(repeated.join(same, "h"), "chunks-real")
    spots = (
        maybe_in(parts, real, "h")
        .join(real, "h")
        .where(place != F.col("first"))
        .groupBy("_id", "_key", "pos")
        .agg(F.min("words").alias("words"), F.min("first").alias("first"))
        .groupBy("_id", "_key")
        .agg(F.sort_array(F.collect_list(F.struct("pos", F.col("first").alias("place")))).alias("first"), F.sum("words").cast("long").alias("removed_words"))
    )
    spots = spots.select(F.col("_id").alias("_gone_id"), F.col("_key").alias("_gone_key"), F.col("first.pos").alias("removed"), "first", "removed_words")
    if extend:
        spots = materialise(spots, "chunks-spots")
        grown = (F.col("_gone_id").eqNullSafe(F.col("_id"))) & (F.col("_gone_key") == F.col("_key"))
        gone = spots.join(_trims(rows, spots), grown, "left").select(
            "_gone_id", "_gone_key", "removed", (F.col("removed_words") + F.coalesce("trimmed_words", F.lit(0))).alias("removed_words"), "trims"
        )
    else:
        gone = spots.select("_gone_id", "_gone_key", "removed", "removed_words", F.lit(None).cast("array<struct<pos:int,c:string>>").alias("trims"))
    gone = materialise(gone, "chunks-removed")
    found = rows.drop("_h").join(gone, F.col("_id").eqNullSafe(F.col("_gone_id")) & (F.col("_key") == F.col("_gone_key")), "left")
    trims = F.coalesce("trims", F.array().cast("array<struct<pos:int,c:string>>"))
    whole = F.array_except(F.sequence(F.lit(0), F.size("_c") - 1), F.concat(F.col("removed"), trims["pos"]))
    kept = F.sort_array(F.concat(F.transform(whole, lambda i: F.struct(i.alias("pos"), F.get("_c", i).alias("c"))), trims))
    text = F.array_join(F.when(F.col("removed").isNull(), F.col("_c")).otherwise(kept["c"]), "")  # null stays null
    return found.select(
        F.col("_row").withField("text", text).alias("_row"),
        F.coalesce(F.size("removed"), F.lit(0)).alias("removed_chunks"),
        F.coalesce("removed_words", F.lit(0)).alias("removed_words"),
        F.coalesce("removed", F.array().cast("array<int>")).alias("removed"),
    ).select(*[f"_row.`{c}`" for c in columns], "removed_chunks", "removed_words", "removed")
