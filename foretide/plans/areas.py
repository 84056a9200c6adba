"""Registered queries: same-coloured areas, specks, and strips on the operators' own grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from foretide.operators import board as B
from foretide.operators import components as K
from foretide.plans import views as V
from foretide.plans.boards import WEDGE, _strips, _votes, board_scene, bright
from foretide.plans.registry import query
from foretide.plans.sessions import R

C = F.col
SPECK = 331  # every 331st pixel of the scene takes a colour of its own: at most one in a block of six by six


def renamed(cte: str, names: dict[str, str]) -> str:
    """The text of a registered view, reading other views."""
    sql = V.CTES[cte]
    for old, new in names.items():
        sql = sql.replace(old, new)
    return sql


# The scene of 48 x 48 pixels is made of blocks of six, so an area has 35 pixels or more or
# is a lone speck: the twin keeps a pixel if one of its four neighbours has its colour.
V.register_ctes(
    {
        "fx_speckled": f"""select frame, y, x, case when (y*48 + x + frame*7) % {SPECK} = 0 then cast((frame + y) % 4 as int) else colour end as colour from (
            select c.frame, c.y*6 + dy.dy as y, c.x*6 + dx.dx as x, case when greatest(c.r, c.g, c.b) >= .52 then c.colour else -1 end as colour from fx_coloured c, range(6) dy(dy), range(6) dx(dx))""",
        "fx_kept": """select frame, y, x, colour from (select *, coalesce(lag(colour) over r = colour, false) or coalesce(lead(colour) over r = colour, false) or coalesce(lag(colour) over c = colour, false)
            or coalesce(lead(colour) over c = colour, false) as joined from fx_speckled window r as (partition by frame, y order by x), c as (partition by frame, x order by y)) where colour >= 0 and joined""",
        "fx_keptrgb": "select *, null::double as r, null::double as g, null::double as b from fx_kept",
        "fx_striparea19": _strips("s", 0.32 + 0.008, 0.94, 0.012, [-0.085 + 0.17 * i / 14 for i in range(15)], "ph", "", "fx_keptrgb", 1),
        "fx_striparea24": _strips("s", 0.35, 2.1, 0.006, [-0.06 + 0.12 * i / 8 for i in range(9)], "0.0", "", "fx_keptrgb", 1),
        "fx_areavotes19": _votes("fx_striparea19", 7),
        "fx_areavotes24": _votes("fx_striparea24", 6),
        "fx_areaconnected": renamed("fx_connected", {"fx_occupied": "fx_areavotes19"}),
        "fx_areastacks": renamed("fx_stacks", {"fx_connected": "fx_areaconnected"}),
        "fx_arearuns": renamed("fx_runs24", {"fx_voted24": "fx_areavotes24", ">= 4": ">= 7"}),
        "fx_flashstrips": _strips("s", 0.37, 0.93, 0.012, [-0.19 + 2 * 0.19 * i / 20 for i in range(21)], "ph", "", centre="(24.0 + frame % 5 * 3)"),
    }
)


def speckled(spark, d):
    """The coloured pixels of the scene with specks, and the frames' geometry."""
    px, geo = board_scene(spark, d)
    speck = (C("y") * 48 + C("x") + C("frame") * 7) % SPECK == 0
    own = px.where(speck).select("frame", "y", "x", ((C("frame") + C("y")) % 4).cast("int").alias("colour"))
    return B.coloured_pixels(px).where(~speck).unionByName(own), geo


@query(
    "p13_same_colour_areas",
    # Two neighbouring cells of one colour reach each other; a cell's area is the least cell it reaches.
    """with recursive cell as (select frame, y*8 + x as i, colour from fx_coloured where colour >= 0),
         edge as (select a.frame, a.i, b.i as j from cell a join cell b on b.frame = a.frame and b.colour = a.colour and (abs(b.i - a.i) = 8 or (abs(b.i - a.i) = 1 and b.i//8 = a.i//8))),
         reach as (select frame, i, i as j from cell union select r.frame, r.i, e.j from reach r join edge e on e.frame = r.frame and e.i = r.j),
         area as (select frame, root, count(*) as size from (select frame, i, min(j) as root from reach group by all) group by all)
       select a.frame, c.colour, count(*) as areas, max(a.size) as largest, sum(a.size) as pixels from area a join cell c on c.frame = a.frame and c.i = a.root group by all""",
)
def _(spark, d):
    coloured = bright(spark, d).select("frame", "y", "x", B.classify_colour().alias("colour")).where("colour >= 0")
    areas = K.same_colour_components(coloured).groupBy("frame", "component").agg(F.first("colour").alias("colour"), F.first("size").alias("size"))
    return areas.groupBy("frame", "colour").agg(F.count("*").alias("areas"), F.max("size").alias("largest"), F.sum("size").alias("pixels"))


@query(
    "p13_drop_specks",
    "select frame, colour, count(*) as n, cast(sum(x) as bigint) as xs, cast(sum(y) as bigint) as ys from fx_kept group by all",
)
def _(spark, d):
    coloured, geo = speckled(spark, d)
    return K.drop_specks(coloured, geo).groupBy("frame", "colour").agg(F.count("*").alias("n"), F.sum("x").alias("xs"), F.sum("y").alias("ys"))


def clean(spark, d):
    coloured, geo = speckled(spark, d)
    kept = K.drop_specks(coloured, geo)
    return kept, geo


@query("p19_stacks_without_specks", "select frame, cast(lane as int) as lane, round(height, 6) as height, cast(top as int) as top, colours from fx_areastacks")
def _(spark, d):
    kept, geo = clean(spark, d)
    s = B.lane_stacks(geo, kept, 48, 48)
    return s.select("frame", "lane", R(C("height")).alias("height"), "top", F.array_join("colours", ",").alias("colours"))


@query(
    "p20_incoming_without_specks",
    f"select f.frame, cast(l.l as int) as lane, round(coalesce(q, 2.1), 6) as incoming from (select vec_id as frame from embeddings) f, range(6) l(l) left join ({WEDGE.replace('fx_scene', 'fx_kept')}) w on w.frame = f.frame and w.lane = l.l",
)
def _(spark, d):
    kept, geo = clean(spark, d)
    flat = geo.select("frame", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("lane"), F.lit(0.36).alias("height"))
    return B.incoming(geo, flat, kept).select("frame", "lane", R(C("incoming")).alias("incoming"))


@query(
    "p24_runs_without_specks",
    """select s.frame, cast(s.lane as int) as lane, round(coalesce(w.radius, 2.1), 6) as incoming, cast(coalesce(w.colour, -1) as int) as colour, round(coalesce(w.confidence, 0.0), 6) as confidence from fx_areastacks s left join (
        select * from (select r.*, row_number() over (partition by r.frame, r.lane order by r.radius) as k from fx_arearuns r join (
          select k.frame, k.lane, case when abs(g.ph) <= 5 then k.height else max(k.height) over (partition by k.frame) end as h from fx_areastacks k join fx_boards g using (frame)) n on n.frame = r.frame and n.lane = r.lane
          where r.radius > greatest(0.48, n.h + 0.07)) where k = 1) w on w.frame = s.frame and w.lane = s.lane""",
)
def _(spark, d):
    kept, geo = clean(spark, d)
    runs = B.incoming_runs(geo, B.lane_stacks(geo, kept, 48, 48), kept, 48, 48)
    return runs.select("frame", "lane", R(C("incoming")).alias("incoming"), "colour", R(C("confidence")).alias("confidence"))


@query(
    "p29_flash_grid",
    """select frame, lane, ok as valid, case when ok then 'ok' else 'board_crop_incomplete' end as reason, case when ok then round(white, 6) end as white, case when ok then round(coloured, 6) end as coloured,
         case when ok then round(whitest, 6) end as whitest from (
       select frame, cast(lane as int) as lane, sum(c) as coloured, sum(w) as white, max(w) as whitest, sum(sum(n)) over (partition by frame) = 6*47*21 as ok from (
         select frame, lane, j, count(*) as n, avg(case when colour >= 0 then 1.0 else 0.0 end) as c, avg(case when least(r,g,b) > .84 and greatest(r,g,b) - least(r,g,b) < .065 then 1.0 else 0.0 end) as w
         from fx_flashstrips group by all) group by frame, lane)""",
)
def _(spark, d):
    px, geo = board_scene(spark, d)
    moved = geo.withColumn("cx", 24.0 + C("frame") % 5 * 3).withColumn("cy", 24.0 + C("frame") % 5 * 3)
    o = B.flash_observation(moved, px, 48, 48)
    lane = F.explode(F.sequence(F.lit(0), F.lit(5))).alias("lane")
    of = lambda c: F.element_at(c, C("lane") + 1)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    return o.select("*", lane).select(
        "frame", "lane", "valid", "reason", R(total(of("white"))).alias("white"), R(total(of("coloured"))).alias("coloured"), R(F.array_max(of("white"))).alias("whitest"),
    )
