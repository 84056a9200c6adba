"""Registered queries: rasters, board geometry, lane features, clear detection."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from foretide.operators import board as B
from foretide.operators import windows as W
from foretide.operators.aggregates import stability_summary
from foretide.operators.timeline import Timeline
from foretide.plans import views as V
from foretide.plans.registry import query
from foretide.plans.sessions import KEY, R
from foretide.plans.timelines import FRAME_LINE, GEO_LINE, O, geometry, lane_frames, sequenced

C = F.col

V.register_ctes(
    {
        "fx_bright": "select frame, session, y, x, least(1.0, r*4) as r, least(1.0, g*4) as g, least(1.0, b*4) as b from fx_pixels",
        "fx_px": """select *, .299*r + .587*g + .114*b as gray, greatest(r,g,b) - least(r,g,b) as span, greatest(r,g,b) - least(r,g,b) > .16 as col,
            sqrt(pow(x*2.0/7-1, 2) + pow(y*2.0/7-1, 2)) as radius, cast(floor(((atan2(y*2.0/7-1, x*2.0/7-1) + 2*pi()) % (2*pi())) / (pi()/3)) as int) as sector from fx_bright""",
        "fx_pixframe": """select frame, avg(gray) as brightness, stddev_pop(gray) as contrast, avg(span) as saturation, avg(case when gray > .08 then 1.0 else 0.0 end) as non_dark,
            avg(dx) + avg(dy) as edge_density, avg(case when x between 2 and 5 and y between 2 and 5 then gray end) as centre_brightness,
            avg(case when ring then c end) as board_occupancy, coalesce(avg(case when radius between .12 and .27 then c end), 0) as near_occupancy, coalesce(avg(case when radius between .3 and .43 then c end), 0) as outer_occupancy,
            sum(case when ring and col then greatest(0.0, least(1.0, (radius - .12)/.31)) else 0 end)/greatest(1, count(case when ring then 1 end)) as radial_pressure, """
        + ", ".join(f"coalesce(avg(case when ring and sector = {k} then c end), 0) as occupancy_{k}" for k in range(6)) + ", "
        + ", ".join(f"greatest(0.0, least(1.0, (coalesce(quantile_cont(case when ring and col and sector = {k} then radius end, .9), .12) - .12)/.31)) as reach_{k}" for k in range(6))
        + """ from (select *, radius between .12 and .43 as ring, case when col then 1.0 else 0.0 end as c, abs(gray - lag(gray) over (partition by frame, y order by x)) as dx, abs(gray - lag(gray) over (partition by frame, x order by y)) as dy from fx_px) group by frame""",
        "fx_lseq": "select l.*, s.seq from fx_lanes l join fx_seq s using (frame)",
    }
)
OCC = [f"occupancy_{k}" for k in range(6)]
REACH = [f"reach_{k}" for k in range(6)]


def bright(spark, d):
    p = V.pixels(spark, d)
    return p.select("frame", "session", "y", "x", *[F.least(F.lit(1.0), C(c) * 4).alias(c) for c in "rgb"])


def features(spark, d):
    return B.frame_features(bright(spark, d), 8)


def raster_query(name, columns):
    @query(name, "select frame, " + ", ".join(f"round({c}, 6) as {c}" for c in columns) + " from fx_pixframe")
    def _(spark, d):
        return features(spark, d).select("frame", *[R(C(c)).alias(c) for c in columns])


raster_query("p03_appearance", ["brightness", "contrast", "saturation", "non_dark"])
raster_query("p04_edge_density", ["edge_density"])
raster_query("p05_centre_brightness", ["centre_brightness"])
raster_query("p07_occupancy", ["board_occupancy", "near_occupancy", "outer_occupancy"])
raster_query("p08_radial_pressure", ["radial_pressure"])
raster_query("p09_sector_occupancy", OCC)
raster_query("p10_sector_reach", REACH)

MEAN_OCC = "(" + "+".join(OCC) + ")/6"
VECTOR_SQL = ["brightness", "contrast", "saturation", "non_dark", "edge_density", "centre_brightness", "0.0", "greatest(0.0, least(1.0, (frame % 64)/32.0))",
              "board_occupancy", "near_occupancy", "outer_occupancy", "radial_pressure", "sqrt((" + "+".join(f"pow({o} - {MEAN_OCC}, 2)" for o in OCC) + ")/6)",
              "(" + "+".join(REACH) + ")/6", "greatest(" + ",".join(REACH) + ")", *OCC, *REACH]


@query("p11_frame_vector", "select frame, " + ", ".join(f"round({e}, 6) as v{i}" for i, e in enumerate(VECTOR_SQL)) + " from fx_pixframe")
def _(spark, d):
    v = B.assemble_vector(features(spark, d), F.lit(0.0), (C("frame") % 64).cast("double"))
    return v.select("frame", *[R(F.element_at("vector", i + 1)).alias(f"v{i}") for i in range(27)])


@query("p01_to_pixels", "select frame, cast(y//2 as int) as y, cast(x//2 as int) as x, round(avg(floor(r*255 + .5)/255), 6) as r, round(avg(floor(g*255 + .5)/255), 6) as g, round(avg(floor(b*255 + .5)/255), 6) as b from fx_bright group by all")
def _(spark, d):
    byte = lambda c: F.lpad(F.hex(F.floor(C(c) * 255 + 0.5).cast("long")), 2, "0")
    px = bright(spark, d).select("frame", "y", "x", F.concat(byte("b"), byte("g"), byte("r")).alias("_b"))
    raw = px.groupBy("frame").agg(F.sort_array(F.collect_list(F.struct("y", "x", "_b"))).alias("_l"))
    data = F.unhex(F.array_join(F.transform("_l", lambda v: v["_b"]), ""))
    images = raw.select("frame", F.struct(F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(3).alias("nChannels"), data.alias("data")).alias("image"))
    return B.to_pixels(images, 4).select("frame", "y", "x", *[R(C(c)).alias(c) for c in "rgb"])


@query("p02_luma", "select frame, y, x, round(gray, 9) as gray from (select frame, cast(y as int) as y, cast(x as int) as x, .299*r + .587*g + .114*b as gray from fx_bright)")
def _(spark, d):
    return bright(spark, d).select("frame", "y", "x", R(B.luma(), 9).alias("gray"))


@query("p06_masks", "select frame, sector, count(*) as n, count(case when radius between .12 and .43 then 1 end) as ring, count(case when radius between .12 and .27 then 1 end) as near, count(case when radius between .3 and .43 then 1 end) as outer_ring, round(sum(radius), 6) as radius from fx_px group by all")
def _(spark, d):
    m = B.ring_columns(bright(spark, d), 8)
    n = lambda c, a: F.count(F.when(C(c), 1)).alias(a)
    return m.groupBy("frame", "sector").agg(F.count("*").alias("n"), n("ring", "ring"), n("near", "near"), n("outer", "outer_ring"), R(F.sum("radius")).alias("radius"))


@query(
    "p12_letterbox",
    """select g.frame, cast(g.y as int) as y, cast(g.x as int) as x, round(coalesce(s.r, 0), 6) as r, round(coalesce(s.g, 0), 6) as g, round(coalesce(s.b, 0), 6) as b from
       (select frame, a.a as y, b.b as x from (select distinct frame from fx_bright), range(4) a(a), range(6) b(b)) g
       left join (select frame, y//2 as y, x//2 + 1 as x, avg(r) as r, avg(g) as g, avg(b) as b from fx_bright group by frame, y//2, x//2) s on s.frame = g.frame and s.y = g.y and s.x = g.x""",
)
def _(spark, d):
    return B.letterbox(bright(spark, d), 8, 8, 4, 6).select("frame", "y", "x", *[R(C(c)).alias(c) for c in "rgb"])


def palette_distance(k):
    colour = B.PALETTE[k]
    lo, hi = min(colour), max(colour)
    return "sqrt(" + " + ".join(f"pow(({ch} - lo)/wide - {(v - lo) / (hi - lo)!r}, 2)" for ch, v in zip("rgb", colour)) + ")"


V.register_ctes(
    {
        "fx_coloured": "select frame, y, x, r, g, b, case when span > .16 and least(d0,d1,d2,d3) < .42 then case when d0 = least(d0,d1,d2,d3) then 0 when d1 = least(d0,d1,d2,d3) then 1 when d2 = least(d0,d1,d2,d3) then 2 else 3 end else -1 end as colour from (select *, "
        + ", ".join(f"{palette_distance(k)} as d{k}" for k in range(4)) + " from (select *, least(r,g,b) as lo, greatest(r,g,b) - least(r,g,b) as span, greatest(1e-8, greatest(r,g,b) - least(r,g,b)) as wide from fx_bright))",
        "fx_gray": "select * from (select *, greatest(abs(r - 189/255.0), abs(g - 195/255.0), abs(b - 199/255.0)) as off, greatest(r,g,b) - least(r,g,b) as span from fx_bright) where off < .5 and abs(x - 4) < 4.8 and abs(y - 4) < 4.8 and span < .5",
    }
)


@query("p13_classify_colour", "select frame, cast(y as int) as y, cast(x as int) as x, colour from fx_coloured")
def _(spark, d):
    return bright(spark, d).select("frame", "y", "x", B.classify_colour().alias("colour"))


@query("p14_gray_mask", "select frame, count(*) as n from fx_gray group by frame")
def _(spark, d):
    return bright(spark, d).where(B.gray_mask(8, 8, 0.5, 0.5, 0.6)).groupBy("frame").agg(F.count("*").alias("n"))


SUP = ", ".join(f"quantile_cont(x*cos(radians({30 + 60 * k})) + y*sin(radians({30 + 60 * k})), .99) as s{k}" for k in range(6))
A_ = "(s0+s1+s2+s3+s4+s5)/6"
CX = "(" + "+".join(f"s{k}*cos(radians({30 + 60 * k}))" for k in range(6)) + ")/3"
CY = "(" + "+".join(f"s{k}*sin(radians({30 + 60 * k}))" for k in range(6)) + ")/3"
ERR = "+".join(f"pow(cx*cos(radians({30 + 60 * k})) + cy*sin(radians({30 + 60 * k})) + a - s{k}, 2)" for k in range(6))


@query(
    "p15_fit_hexagon",
    f"""select f.frame, case when coalesce(n, 0) < 12 then 'gray_not_found' when a < 1 or residual > .4 then 'gray_fit_uncertain' else 'ok' end as reason,
        case when coalesce(n, 0) >= 12 then round(cx, 6) end as cx, case when coalesce(n, 0) >= 12 then round(cy, 6) end as cy, case when coalesce(n, 0) >= 12 then round(a, 6) end as apothem, case when coalesce(n, 0) >= 12 then round(residual, 6) end as residual
        from (select distinct frame from fx_bright) f left join (select *, sqrt(({ERR})/6)/greatest(1.0, a) as residual from (select *, {A_} as a, {CX} as cx, {CY} as cy from (select frame, count(*) as n, {SUP} from fx_gray group by frame))) g using (frame)""",
)
def _(spark, d):
    g = B.fit_hexagon(bright(spark, d), 8, 8, 0.5, 0.5, 0.6, max_residual=0.4, min_apothem=1.0, min_points=12)
    return g.select("frame", "reason", *[R(C(c)).alias(c) for c in ("cx", "cy", "apothem", "residual")])


def board_scene(spark, d):
    """48 x 48 rasters with a known geometry per frame (apothem 11..14, any phase)."""
    px = B.transform_pixels(bright(spark, d), 6.0)
    geo = V.read(spark, d, "embeddings").select(
        C("vec_id").alias("frame"), F.lit(True).alias("valid"), F.lit("ok").alias("reason"), F.lit(24.0).alias("cx"), F.lit(24.0).alias("cy"),
        (11 + C("vec_id") % 4).cast("double").alias("apothem"), (C("vec_id") % 60 - 30).cast("int").alias("phase"), F.lit(0.32).alias("core_ratio"),
        F.lit(0.01).alias("residual"), F.lit(0.01).alias("orientation_error"),
    )
    return px, geo


def _strips(
    name: str, start: float, stop: float, step: float, offsets, phase: str, where: str, scene: str = "fx_coloured", block: int = 6, centre: str = "24.0",
) -> str:
    """SQL rows of a strip grid (frame, lane, j, radius, colour and pixel of each sample)."""
    last = math.ceil((stop - start) / step) - 1
    values = ", ".join(f"({o!r})" for o in offsets)
    axis = f"radians(30.0 + 60.0 * l.l + {phase})"
    r = f"({start!r} + j.j * {step!r})"
    return f"""select q.frame, q.lane, q.j, q.radius, c.colour, c.r, c.g, c.b from (
        select frame, l.l as lane, j.j as j, {r} as radius, round_even({centre} + ({r} * cos({axis}) - o.o * sin({axis})) * a, 0) as sx, round_even({centre} + ({r} * sin({axis}) + o.o * cos({axis})) * a, 0) as sy
        from fx_boards, range(6) l(l), range({last + 1}) j(j), (values {values}) o(o)) q join {scene} c on c.frame = q.frame and c.x = cast(floor(q.sx/{block}) as bigint) and c.y = cast(floor(q.sy/{block}) as bigint) {where}"""


def _votes(strips: str, least: int) -> str:
    return f"""select frame, lane, j, radius, colour, n from (select *, row_number() over (partition by frame, lane, j order by n desc, colour) as k from (
        select frame, lane, j, radius, colour, count(*) as n from {strips} group by all)) where k = 1 and n >= {least}"""


BRIGHT = "where c.colour >= 0 and greatest(c.r, c.g, c.b) >= .52"
V.register_ctes(
    {
        "fx_boards": "select vec_id as frame, (11 + vec_id % 4)::double as a, vec_id % 60 - 30 as ph from embeddings",
        "fx_strip19": _strips("s", 0.32 + 0.008, 0.94, 0.012, [-0.085 + 0.17 * i / 14 for i in range(15)], "ph", BRIGHT),
        "fx_occupied": _votes("fx_strip19", 7),
        "fx_connected": """select * from (select *, sum(case when j - pj > 3 then 1 else 0 end) over (partition by frame, lane order by j) as holes, first(radius) over (partition by frame, lane order by j) as r0 from (
            select *, lag(j) over (partition by frame, lane order by j) as pj, lag(colour) over (partition by frame, lane order by j) as pc from fx_occupied)) where holes = 0 and r0 <= 0.32 + 0.055""",
        "fx_stacks": """select g.frame, l.l as lane, coalesce(max(c.radius) + 0.006, 0.32) as height, coalesce(last(c.colour order by c.j) filter (c.j is not null), -1) as top,
            coalesce(string_agg(case when c.pc is null or c.pc <> c.colour then c.colour::varchar end, ',' order by c.j), '') as colours
            from fx_boards g cross join range(6) l(l) left join fx_connected c on c.frame = g.frame and c.lane = l.l group by g.frame, l.l""",
        "fx_strip24": _strips("s", 0.35, 2.1, 0.006, [-0.06 + 0.12 * i / 8 for i in range(9)], "0.0", BRIGHT),
        "fx_voted24": _votes("fx_strip24", 6),
        "fx_runs24": """select frame, lane, colour, min(radius) as radius, avg(n/9.0) as confidence from (select *, j - row_number() over (partition by frame, lane, colour order by j) as k from fx_voted24) group by frame, lane, colour, k having count(*) >= 4""",
        "fx_strip29": _strips("s", 0.37, 0.93, 0.07, [-0.19 + 2 * 0.19 * i / 4 for i in range(5)], "ph", ""),
        "fx_dark": "select frame, dy.dy + y*6 as y, dx.dx + x*6 as x from fx_bright, range(6) dy(dy), range(6) dx(dx) where r < .28 and g < .36 and b < .43",
        "fx_rays": """select q.frame, q.ray, q.angle, coalesce(max(case when sqrt(pow(d.x - 24.0, 2) + pow(d.y - 24.0, 2))/q.a < .46 then radius end), 0.0) as outer_r from (
            select frame, a, t.t as ray, t.t*(2*pi()/180) - pi() as angle, i.i*(0.25/100) + 0.20 as radius,
              cast(round_even(24.0 + cos(t.t*(2*pi()/180) - pi())*((i.i*(0.25/100) + 0.20)*a), 0) as bigint) as sx, cast(round_even(24.0 + sin(t.t*(2*pi()/180) - pi())*((i.i*(0.25/100) + 0.20)*a), 0) as bigint) as sy
            from fx_boards, range(180) t(t), range(101) i(i)) q left join fx_dark d on d.frame = q.frame and d.x = q.sx and d.y = q.sy group by all""",
        "fx_facing": "select frame, deg.deg as deg, outer_r*greatest(" + ", ".join(f"cos(angle - radians(deg.deg + 30 + {60 * k}))" for k in range(6)) + ") as ap from fx_rays, range(60) deg(deg) where outer_r > .22",
        "fx_mad": "select f.frame, f.deg, median(abs(ap - m)) as error, any_value(m) as core from fx_facing f join (select frame, deg, median(ap) as m from fx_facing group by all) t on t.frame = f.frame and t.deg = f.deg group by all",
        "fx_phase": "select frame, deg, error, core from (select *, row_number() over (partition by frame order by round(error, 9), deg) as k from fx_mad) where k = 1",
    }
)


@query("p32_transform_pixels", "select frame, cast(y*2 + a.a as int) as y, cast(x*2 + b.b as int) as x, round(r, 6) as r from fx_bright, range(2) a(a), range(2) b(b)")
def _(spark, d):
    return B.transform_pixels(bright(spark, d), 2.0).select("frame", "y", "x", R(C("r")).alias("r"))


@query("p32_transform_pixels_down", "select frame, cast(y//2 as int) as y, cast(x//2 as int) as x, round(avg(r), 6) as r from fx_bright group by frame, y//2, x//2")
def _(spark, d):
    return B.transform_pixels(bright(spark, d), 0.5).select("frame", C("y").cast("int").alias("y"), C("x").cast("int").alias("x"), R(C("r")).alias("r"))


_REACH = [f"(x - cx)*cos(radians({30 + 60 * k})) + (y - cy)*sin(radians({30 + 60 * k}))" for k in range(6)]
V.register_ctes(
    {
        "fx_all48": "select frame, dy.dy + y*6 as y, dx.dx + x*6 as x, r, g, b from fx_bright, range(6) dy(dy), range(6) dx(dx)",
        "fx_core48": "select frame, count(*) as n, (min(x)+max(x))/2.0 as cx, (min(y)+max(y))/2.0 as cy from fx_all48 where r < .28 and g < .36 and b < .43 and abs(x - 24) < 48*.12 and abs(y - 24) < 48*.2 group by frame",
        "fx_gray48": "select frame, y, x from fx_all48 where greatest(abs(r - 189/255.0), abs(g - 195/255.0), abs(b - 199/255.0)) < .5 and abs(x - 24) < 48*.26 and abs(y - 24) < 48*.26 and greatest(r,g,b) - least(r,g,b) < .5",
        "fx_solid48": "select p.frame, " + ", ".join(f"{e} as e{k}" for k, e in enumerate(_REACH)) + " from (select a.frame, a.y, a.x from fx_gray48 a join fx_gray48 b on b.frame = a.frame and abs(b.x - a.x) <= 1 and abs(b.y - a.y) <= 1 group by all having count(*) >= 2) p join fx_core48 c on c.frame = p.frame",
        "fx_tops48": "select frame, list_sort([" + ", ".join(f"max(e{k})" for k in range(6)) + "]) as s from fx_solid48 group by frame",
        "fx_fit48": "select t.frame, (s[3] + s[4])/2 as a, list_sort([" + ", ".join(f"abs(s[{k + 1}] - (s[3] + s[4])/2)/greatest(1.0, (s[3] + s[4])/2)" for k in range(6)) + "]) as e from fx_tops48 t",
        "fx_over48": "select f.frame, avg(case when greatest(e0,e1,e2,e3,e4,e5) > f.a*1.04 then 1.0 else 0.0 end) as over from fx_solid48 s join fx_fit48 f on f.frame = s.frame group by f.frame",
    }
)


@query(
    "p16_fit_hexagon_core",
    """select frame, reason = 'ok' as valid, reason, round(cx, 6) as cx, round(cy, 6) as cy, round(a, 6) as apothem from (select g.frame, c.cx, c.cy, f.a, case when f.frame is null and coalesce(c.n, 0) >= 4 then 'gray_not_found' when coalesce(c.n, 0) < 4 then 'core_center_missing'
        when f.a < 8 or e[3] >= .035 or o.over > .02 then 'occluded_gray_fit_uncertain' else 'ok' end as reason from fx_boards g left join fx_core48 c using (frame) left join fx_fit48 f using (frame) left join fx_over48 o using (frame))""",
)
def _(spark, d):
    px, _ = board_scene(spark, d)
    return B.fit_hexagon_core(px, 48, 48, min_core=4, min_neighbours=2, near=0.5, max_span=0.5).select("frame", "valid", "reason", *[R(C(c)).alias(c) for c in ("cx", "cy", "apothem")])


@query(
    "p17_orientation",
    "select g.frame, round(u.usable, 6) as usable, round(p.error, 6) as orientation_error, cast(case when p.deg < 30 then p.deg else p.deg - 60 end as double) as phase from fx_boards g join (select frame, avg(case when outer_r > .22 then 1.0 else 0.0 end) as usable from fx_rays group by 1) u using (frame) left join fx_phase p using (frame)",
)
def _(spark, d):
    px, geo = board_scene(spark, d)
    o = B.orientation(geo.drop("phase", "core_ratio", "orientation_error"), px, 48, 48)
    return o.select("frame", R(C("usable")).alias("usable"), R(C("orientation_error")).alias("orientation_error"), C("phase").cast("double").alias("phase"))


@query("p18_core_ratio", "select g.frame, round(p.core, 6) as core_ratio from fx_boards g left join fx_phase p using (frame)")
def _(spark, d):
    px, geo = board_scene(spark, d)
    return B.orientation(geo.drop("phase", "core_ratio", "orientation_error"), px, 48, 48).select("frame", R(C("core_ratio")).alias("core_ratio"))


def stacks(spark, d):
    px, geo = board_scene(spark, d)
    coloured = B.coloured_pixels(px)
    return px, geo, coloured, B.lane_stacks(geo, coloured, 48, 48)


@query("p19_lane_stacks", "select frame, cast(lane as int) as lane, round(height, 6) as height, cast(top as int) as top, colours from fx_stacks")
def _(spark, d):
    return stacks(spark, d)[3].select("frame", "lane", R(C("height")).alias("height"), "top", F.array_join("colours", ",").alias("colours"))


WEDGE = """select c.frame, c.lane, count(*) as n, quantile_cont(proj, .03) as q from (
   select frame, cast(((floor(degrees(atan2(y-24.0, x-24.0))/60) % 6) + 6) % 6 as int) as lane, x, y, 11 + frame % 4 as a from fx_scene) c0,
   lateral (select c0.frame, c0.lane, ((c0.x-24)*cos(radians(30+60*c0.lane)) + (c0.y-24)*sin(radians(30+60*c0.lane)))/c0.a as proj, abs(-(c0.x-24)*sin(radians(30+60*c0.lane)) + (c0.y-24)*cos(radians(30+60*c0.lane)))/c0.a as across, c0.a) c
   where across < tan(radians(12))*proj and proj > 0.48 and proj < 2.1 and not (proj > .94 and proj < 1.08) group by c.frame, c.lane, c.a having count(*) > greatest(4.0, c.a*.05)"""
V.register_ctes(
    {
        "fx_scene": "select c.frame, c.y*6 + dy.dy as y, c.x*6 + dx.dx as x, c.colour from fx_coloured c, range(6) dy(dy), range(6) dx(dx) where c.colour >= 0 and greatest(c.r, c.g, c.b) >= .52",
    }
)


@query(
    "p20_incoming",
    f"select f.frame, cast(l.l as int) as lane, round(coalesce(q, 2.1), 6) as incoming from (select vec_id as frame from embeddings) f, range(6) l(l) left join ({WEDGE}) w on w.frame = f.frame and w.lane = l.l",
)
def _(spark, d):
    px, geo = board_scene(spark, d)
    flat = geo.select("frame", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("lane"), F.lit(0.36).alias("height"))
    return B.incoming(geo, flat, B.coloured_pixels(px)).select("frame", "lane", R(C("incoming")).alias("incoming"))


def vector_sql() -> str:
    """All 54 numbers: four of each lane, its colour as four flags, and whether the next lane's colour equals it."""
    of = lambda lane, e: f"round(max(case when lane = {lane} then {e} end), 6)"
    geometry = [of(lane, e) for lane in range(6) for e in ("height", "greatest(0.0, incoming - height)", "incoming", "0.9 - frame % 7 * 0.1")]
    flags = [of(lane, f"case when top = {c} then 1.0 else 0.0 end") for lane in range(6) for c in range(4)]
    same = [of(lane, "case when top >= 0 and top = nxt then 1.0 else 0.0 end") for lane in range(6)]
    columns = ", ".join(f"{e} as v{i}" for i, e in enumerate(geometry + flags + same))
    return f"""select run, frame, {columns} from (
        select l.*, (frame + lane*lane) % 5 - 1 as top, (frame + ((lane+1)%6)*((lane+1)%6)) % 5 - 1 as nxt from fx_lanes l) group by run, frame"""


@query("p21_board_vector", vector_sql())
def _(spark, d):
    f = lane_frames(spark, d)
    lanes = f.select("run", "frame", F.posexplode(F.arrays_zip("height", "incoming")).alias("lane", "_v")).select(
        "run", "frame", "lane", "_v.height", "_v.incoming", ((C("frame") + C("lane") * C("lane")) % 5 - 1).cast("int").alias("top")
    )
    geo = f.select("frame", F.lit(0.01).alias("residual"), (C("frame") % 7 * 0.01).alias("orientation_error"))
    v = B.board_vector(lanes, geo).join(f.select("run", "frame"), "frame")
    return v.select("run", "frame", *[R(F.element_at("vector", i + 1)).alias(f"v{i}") for i in range(54)])


@query("p22_route_repair", "select frame, valid and mx <= .3 as kept, case when valid and mx <= .3 then round(mx, 6) else -1.0 end as tallest from (select frame, frame % 9 <> 0 as valid, max(height) as mx from fx_lanes group by frame)")
def _(spark, d):
    f = lane_frames(spark, d)
    first = f.select("frame", (C("frame") % 9 != 0).alias("valid"), C("height").alias("heights"))
    second = f.select("frame", F.lit(True).alias("valid"), F.array(F.lit(-1.0)).alias("heights"))
    r = B.route_repair(first, second, 0.3)
    return r.select("frame", (~C("repaired")).alias("kept"), R(F.array_max("heights")).alias("tallest"))


@query(
    "p23_hold_geometry",
    """with recursive f as (select g.run, g.frame, s.seq, valid, cx, cy, apothem as a, .31 + abs(cx - 50)*.03 as core, g.frame % 2 = 0 as rv, cx + .1 as rx, cy as ry, apothem*1.01 as ra, .325 as rc from fx_geo g join fx_seq s using (frame)),
walk as (select run, frame, seq, valid, cx, cy, a, core, 0 as held, false as refit from f where seq = 1
 union all
 select n.run, n.frame, n.seq, n.valid, case when n.h then n.pcx else n.ux end, case when n.h then n.pcy else n.uy end, case when n.h then n.pa else n.ua end, case when n.h then n.ua*n.uc/n.pa else n.uc end, case when n.h then n.pheld + 1 else 0 end, n.u and not n.h from (
  select *, valid and pv and uc > .34 and abs(ua*uc/(pa*pcore) - 1) < .025 and sqrt(pow(ux - pcx, 2) + pow(uy - pcy, 2)) < .04*pa and pheld < 2 and pcore < .34 and abs(ua*uc/pa/.325 - 1) < .055 as h from (
   select *, case when u then rx else cx end as ux, case when u then ry else cy end as uy, case when u then ra else a end as ua, case when u then rc else core end as uc from (
    select f.*, w.valid as pv, w.cx as pcx, w.cy as pcy, w.a as pa, w.core as pcore, w.held as pheld, f.valid and w.valid and f.rv and sqrt(pow(f.cx - w.cx, 2) + pow(f.cy - w.cy, 2))/w.a > .075 as u from walk w join f on f.run = w.run and f.seq = w.seq + 1))) n)
select run, frame, valid, case when valid then round(cx, 6) end as cx, case when valid then round(a, 6) end as apothem, case when valid then round(core, 6) end as core, case when valid then held else 0 end as held, case when valid then refit else false end as refit from walk""",
)
def _(spark, d):
    g = geometry(spark, d)
    f = g.withColumn("core", 0.31 + F.abs(C("cx") - 50) * 0.03).withColumn("refit_valid", C("frame") % 2 == 0)
    f = f.select("*", (C("cx") + 0.1).alias("refit_cx"), C("cy").alias("refit_cy"), (C("apothem") * 1.01).alias("refit_apothem"), F.lit(0.325).alias("refit_core"))
    return B.hold_geometry(f, GEO_LINE).select("run", "frame", "valid", R(C("cx")).alias("cx"), R(C("apothem")).alias("apothem"), R(C("core")).alias("core"), "held", "refit")


@query(
    "p24_incoming_runs",
    """select s.frame, cast(s.lane as int) as lane, round(coalesce(w.radius, 2.1), 6) as incoming, cast(coalesce(w.colour, -1) as int) as colour, round(coalesce(w.confidence, 0.0), 6) as confidence from fx_stacks s left join (
        select * from (select r.*, row_number() over (partition by r.frame, r.lane order by r.radius) as k from fx_runs24 r join (
          select k.frame, k.lane, case when abs(g.ph) <= 5 then k.height else max(k.height) over (partition by k.frame) end as h from fx_stacks k join fx_boards g using (frame)) n on n.frame = r.frame and n.lane = r.lane
          where r.radius > greatest(0.48, n.h + 0.07)) where k = 1) w on w.frame = s.frame and w.lane = s.lane""",
)
def _(spark, d):
    px, geo, coloured, st = stacks(spark, d)
    return B.incoming_runs(geo, st, coloured, 48, 48, length=4).select("frame", "lane", R(C("incoming")).alias("incoming"), "colour", R(C("confidence")).alias("confidence"))


@query(
    "j21_sample_strips",
    """select frame, cast(l.l as int) as lane, count(colour) as hits from (select frame, 11 + frame % 4 as a, frame % 60 - 30 as ph from (select vec_id as frame from embeddings)) g, range(6) l(l), range(20) j(j), range(5) o(o)
       left join (select frame as f2, x as x2, y as y2, colour from fx_scene) s on s.f2 = g.frame
         and s.x2 = greatest(0, least(47, round_even(24 + ((.40 + j.j*.03)*cos(radians(30+60*l.l+ph)) - (-.1 + o.o*.05)*sin(radians(30+60*l.l+ph)))*a, 0)))
         and s.y2 = greatest(0, least(47, round_even(24 + ((.40 + j.j*.03)*sin(radians(30+60*l.l+ph)) + (-.1 + o.o*.05)*cos(radians(30+60*l.l+ph)))*a, 0))) group by all""",
)
def _(spark, d):
    px, geo = board_scene(spark, d)
    points = B.strip_points(geo, 0.40, 0.985, 0.03, [-0.1 + 0.05 * i for i in range(5)], C("phase"))
    s = B.sample(points, B.coloured_pixels(px), 48, 48)
    return s.groupBy("frame", "lane").agg(F.count("colour").alias("hits"))


@query("j20_with_masks", "select frame, count(case when radius between .12 and .43 and col then 1 end) as occupied, round(sum(case when radius between .12 and .43 then gray else 0 end), 6) as gray from fx_px group by frame")
def _(spark, d):
    m = B.ring_columns(bright(spark, d), 8)
    return m.groupBy("frame").agg(F.count(F.when(C("ring") & C("colourful"), 1)).alias("occupied"), R(F.sum(F.when(C("ring"), B.luma()).otherwise(0.0))).alias("gray"))


@query("p31_score_pixels", "select frame, count(case when x between 1 and 7 and y between 2 and 6 and least(r,g,b) > 150/255.0 and greatest(r,g,b) - least(r,g,b) < 50/255.0 then 1 end) as n from fx_bright group by frame")
def _(spark, d):
    return B.score_pixels(bright(spark, d), 8, 8, 3, 2)


@query(
    "w12_pixel_motion",
    """select s.session, s.frame, round(coalesce(avg(abs(a.gray - b.gray)), 0.0), 6) as motion from fx_seq s join fx_px a on a.frame = s.frame
       left join fx_seq p on p.session = s.session and p.seq = s.seq - 1 left join fx_px b on b.frame = p.frame and b.x = a.x and b.y = a.y group by s.session, s.frame""",
)
def _(spark, d):
    px = bright(spark, d)
    frames = V.read(spark, d, "embeddings").select(C("label").alias("session"), C("vec_id").alias("frame"))
    return B.pixel_motion(frames, px, FRAME_LINE).select("session", "frame", R(C("motion")).alias("motion"))




# --- lanes along time -------------------------------------------------------------------
LANE_LINE = Timeline(("run",), ("at_ms",), "at_ms", 5_000)


def timed_lanes(spark, d):
    """Lane frames at four per second: at_ms = 250 x position in the run."""
    seq = sequenced(spark, d).select("frame", (C("seq") * 250).alias("at_ms"))
    return lane_frames(spark, d).join(seq, "frame")


LOOK = "select c.run, c.frame, c.lane, " + ", ".join(
    f"round(c.height - b{s}.height, 6) as growth_{s}, round((b{s}.incoming - c.incoming)/{s}, 6) as motion_{s}, case when b{s}.seq is not null then round(least(c.confidence, b{s}.confidence), 6) end as conf_{s}" for s in (1, 2)
) + " from fx_lseq c " + " ".join(f"left join fx_lseq b{s} on b{s}.run = c.run and b{s}.lane = c.lane and b{s}.seq = c.seq - {4 * s}" for s in (1, 2))


@query("w08_lookback_deltas", LOOK)
def _(spark, d):
    o = W.lookback_deltas(timed_lanes(spark, d), LANE_LINE, (1, 2), 600)
    names = [f"{p}_{s}" for s in (1, 2) for p in ("growth", "motion", "conf")]
    lanes = o.select("run", "frame", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("lane"), *names)
    return lanes.select("run", "frame", C("lane").cast("long").alias("lane"), *[R(C(n)[C("lane")]).alias(n) for n in names])


@query(
    "w08_ranked_lookback",
    """with r as (select run, frame, seq, height, row_number() over (partition by frame order by height) - 1 as rk, min(confidence) over (partition by frame) as low from fx_lseq)
       select c.run, c.frame, c.rk as lane, round(c.height - b.height, 6) as growth_1, case when b.seq is not null then round(greatest(0.0, b.height - c.height), 6) end as clear_1, case when b.seq is not null then round(least(c.low, b.low)*.5, 6) end as conf_1 from r c left join r b on b.run = c.run and b.seq = c.seq - 4 and b.rk = c.rk""",
)
def _(spark, d):
    o = W.lookback_deltas(timed_lanes(spark, d), LANE_LINE, (1,), 300, ranked=True)
    lanes = o.select("run", "frame", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("lane"), "growth_1", "clear_1", "conf_1")
    return lanes.select("run", "frame", C("lane").cast("long").alias("lane"), *[R(C(n)[C("lane")]).alias(n) for n in ("growth_1", "clear_1", "conf_1")])


V.register_ctes(
    {
        "fx_pairs": """select c.run, c.frame, c.seq, c.lane, p.incoming - c.incoming as step, (c.frame % 8 <= 5 and p.frame % 8 <= 5) as stable,
          (c.frame % 8 <= 5 and p.frame % 8 <= 5) and p.incoming >= 2.05 and c.incoming < 2.05 as appeared,
          (c.frame % 8 <= 5 and p.frame % 8 <= 5) and p.incoming < 2.05 and c.incoming < 2.05 and p.incoming > p.height + .1 and c.incoming > c.height + .1 and p.incoming - c.incoming > .004 and p.incoming - c.incoming < .25 as matched,
          (c.frame % 8 <= 5 and p.frame % 8 <= 5) and p.incoming - p.height < .2 and c.incoming - p.incoming > .15 as landed
          from fx_lseq c join fx_lseq p on p.run = c.run and p.lane = c.lane and p.seq = c.seq - 1""",
        "fx_growth": "select run, seq, h - lag(h) over (partition by run order by seq) as g from (select run, seq, sum(height) as h from fx_lseq group by all)",
    }
)


def motion_sql() -> str:
    """All 48 numbers: per horizon, one aggregate over lane pairs and one over stack growth."""
    parts, cols = [], []
    for k, s in enumerate((1, 2, 4, 8)):
        n, m = 4 * s, [f"m{12 * k + i}" for i in range(12)]
        window = f"p.run = f.run and p.seq between f.seq - {n - 1} and f.seq group by f.run, f.frame"
        speed = [f"round(coalesce(quantile_cont(step, {q}) filter (where matched), 0)*4, 6) as {m[i]}" for i, q in enumerate((0.5, 0.25, 0.75, 1.0))]
        counts = [f"round(count(case when matched then 1 end)/{6 * n}.0, 6) as {m[4]}", f"count(case when appeared then 1 end)*1.0 as {m[5]}", f"count(case when landed then 1 end)*1.0 as {m[6]}"]
        growth = [f"round(sum(greatest(g, 0)), 6) as {m[7]}", f"round(sum(greatest(-g, 0)), 6) as {m[8]}", f"count(case when g > .06 then 1 end)*1.0 as {m[9]}", f"count(case when g < -.06 then 1 end)*1.0 as {m[10]}", f"round(sum(g), 6) as {m[11]}"]
        parts.append(f"(select f.run, f.frame, {', '.join(speed + counts)} from fx_full f join fx_pairs p on {window}) a{k}")
        parts.append(f"(select f.run, f.frame, {', '.join(growth)} from fx_full f join fx_growth p on {window}) b{k}")
        cols += m
    joined = parts[0] + "".join(f" join {p} using (run, frame)" for p in parts[1:])
    return f"select run, frame, {', '.join(cols)} from {joined}"


V.register_ctes({"fx_full": "select run, frame, seq from fx_lseq where lane = 0 and seq >= 33"})


@query("w09_motion_features", motion_sql())
def _(spark, d):
    m = W.motion_features(timed_lanes(spark, d).withColumn("phase", C("frame") % 8), LANE_LINE).where("motion is not null")
    return m.select("run", "frame", *[R(F.element_at("motion", i + 1)).alias(f"m{i}") for i in range(48)])


def tracked(spark, d):
    """Lane frames with colours, confidences and a steady board."""
    f = timed_lanes(spark, d)
    lane = F.sequence(F.lit(0), F.lit(5))
    return f.select(
        "run", "frame", "at_ms", "height", F.transform("incoming", lambda v: 1.0 + v).alias("incoming"),
        F.transform(lane, lambda k: ((F.floor(C("at_ms") / 1500) + k) % 4 - F.when(C("frame") % 7 == 0, 1).otherwise(0)).cast("int")).alias("colour"),
        F.transform("confidence", lambda v: 0.68 + v).alias("conf"), (C("frame") % 7).cast("int").alias("phase"), F.lit(20.0).alias("apothem"), F.lit(50.0).alias("cx"), F.lit(50.0).alias("cy"),
    )


@query("w10_verified_motion")
def _(spark, d):
    m = W.verified_motion(tracked(spark, d), LANE_LINE).where("motion is not null")
    return m.select("run", "frame", *[R(F.element_at("motion", i + 1)).alias(f"m{i}") for i in range(48)])


@query(
    "w11_recent_event_features",
    """select session_id, event_id, case when n < 17 then 'short_history' when ok = 0 then 'unsupported_geometry' when lo <> hi then 'reset_within_window' end as context_reason,
       case when n = 17 and ok = 1 and lo = hi then c2 end as count_2, case when n = 17 and ok = 1 and lo = hi then round(s2, 6) end as conf_2 from (
         select *, count(*) over w as n, min(case when event_id % 50 <> 0 then 1 else 0 end) over w as ok, min(active_ms//6000) over w as lo, max(active_ms//6000) over w as hi,
           count(case when event_type='click' then 1 end) over v as c2, sum(case when event_type='click' then motion/500 else 0 end) over v as s2 from fx_obs
         window w as (partition by session_id order by ts_ms, event_id rows between 16 preceding and current row), v as (partition by session_id order by ts_ms, event_id rows between 3 preceding and current row))""",
)
def _(spark, d):
    f = V.obs(spark, d).select(
        *KEY, "ts_ms", "active_ms", (C("event_id") % 50 != 0).alias("supported"), (C("event_type") == "click").alias("event"), (C("motion") / 500).alias("confidence"), F.expr("active_ms div 6000").alias("segment")
    )
    r = W.recent_event_features(f, O, (1, 2, 4, 8), 2)
    return r.select(*KEY, "context_reason", "count_2", R(C("conf_2")).alias("conf_2"))


@query(
    "p25_normalise_scale",
    """select run, frame, lane, ok as valid, case when ok then round(height*.32/core, 6) end as height, case when ok then round(least(incoming*.32/core, 2.1), 6) end as incoming, case when ok then round(greatest(0.0, least(incoming*.32/core, 2.1) - height*.32/core), 6) end as gap
       from (select *, core > .27 and core < .40 as ok from (select *, .25 + max(case when lane = 0 then gap end) over (partition by frame)*.8 as core from fx_lanes))""",
)
def _(spark, d):
    f = lane_frames(spark, d).withColumn("core", 0.25 + F.element_at("gap", 1) * 0.8).withColumn("valid", F.lit(True)).withColumn("reason", F.lit("ok")).withColumn("apothem", F.lit(100.0))
    n = B.normalise_scale(f)
    lanes = n.select("run", "frame", "valid", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("lane"), "height", "incoming", "gap")
    return lanes.select("run", "frame", C("lane").cast("long").alias("lane"), "valid", *[R(C(c)[C("lane")]).alias(c) for c in ("height", "incoming", "gap")])


def full_vectors(spark, d):
    """150-number vectors: lanes, colour one-hots and matches, and 96 change values."""
    f = lane_frames(spark, d)
    lane = F.sequence(F.lit(0), F.lit(5))
    f = f.withColumn("tops", F.transform(lane, lambda k: ((C("frame") + k * k) % 5 - 1).cast("int")))
    onehot = F.flatten(F.transform("tops", lambda t: F.array(*[(t == c).cast("double") for c in range(4)])))
    turned = F.concat(F.slice("tops", 2, 5), F.slice("tops", 1, 1))
    match = F.zip_with("tops", turned, lambda a, b: ((a >= 0) & (a == b)).cast("double"))
    change = F.transform(F.sequence(F.lit(0), F.lit(95)), lambda i: F.element_at("v", (i % 64 + 1).cast("int")) - 0.1)
    return f.withColumn("vector", F.concat(F.slice("v", 1, 24), onehot, match, change))


@query(
    "p26_invariant_features",
    """select run, frame, round(avg(height), 6) as height_mean, round(stddev_pop(height), 6) as height_std, round(max(height) - min(height), 6) as height_range, round(avg(gap), 6) as gap_mean, round(stddev_pop(gap), 6) as gap_std,
       round(min(case when height = mh then gap end), 6) as gap_at_tallest, round(min(case when height >= md then gap end), 6) as gap_min_tall, round(min(confidence), 6) as conf_min, count(case when top = 0 then 1 end)*1.0 as colour_0, count(case when top = 2 then 1 end)*1.0 as colour_2,
       count(case when top >= 0 and top = nxt then 1 end)*1.0 as matches, 182 as width from (
         select *, max(height) over (partition by frame) as mh, median(height) over (partition by frame) as md, (frame + lane*lane) % 5 - 1 as top, (frame + ((lane+1)%6)*((lane+1)%6)) % 5 - 1 as nxt from fx_lanes) group by run, frame""",
)
def _(spark, d):
    i = B.invariant_features(full_vectors(spark, d))
    at = lambda k: F.element_at("invariant", k + 1)
    return i.select(
        "run", "frame", F.size("invariant").alias("width"), *[R(at(k)).alias(n) for k, n in ((18, "height_mean"), (19, "height_std"), (20, "height_range"), (26, "gap_mean"), (27, "gap_std"), (28, "gap_at_tallest"), (29, "gap_min_tall"), (30, "conf_min"))],
        at(32).alias("colour_0"), at(34).alias("colour_2"), at(36).alias("matches"),
    )


@query("p27_compact_features", "select run, frame, 80 as n, round(sum(height)/6, 6) as height_mean from fx_lseq where seq >= 33 group by run, frame")
def _(spark, d):
    m = W.motion_features(timed_lanes(spark, d).withColumn("phase", C("frame") % 8), LANE_LINE).where("motion is not null").select("frame", "motion")
    c = B.compact_features(B.invariant_features(full_vectors(spark, d)).join(m, "frame"))
    return c.select("run", "frame", F.size("compact").alias("n"), R(F.element_at("compact", 20 + 18 + 1)).alias("height_mean"))


@query(
    "p28_derive_windows",
    """select c.run, c.frame, case when s.seq is not null then round(s.h, 6) end as height_sum, s.seq is null and c.frame % 4 <> 0 as changed from (select distinct run, frame, seq from fx_lseq) c
       left join (select run, seq, sum(height) as h from fx_lseq where frame % 3 <> 0 group by all) s on s.run = c.run and s.seq = (select max(q.seq) from fx_lseq q where q.run = c.run and q.frame % 3 <> 0 and q.seq <= c.seq) and c.seq - s.seq <= 1""",
)
def _(spark, d):
    f = timed_lanes(spark, d).withColumn("height_sum", F.aggregate("height", F.lit(0.0), lambda s, x: s + x))
    anchors = f.select("run", "frame", "at_ms", (C("frame") % 4 != 0).alias("valid"))
    w = B.derive_windows(anchors, f.where("frame % 3 <> 0").select("run", "at_ms", "height_sum"), LANE_LINE, 300, ["height_sum"])
    return w.select("run", "frame", R(C("height_sum")).alias("height_sum"), "changed")


@query(
    "a20_stability_summary",
    """select 'half' as variant, count(case when valid and sqrt(pow((cx/2+.3)*2 - cx, 2) + pow(cy - cy, 2))/apothem <= .025 then 1 end) as geometry_stable, count(case when valid and frame % 5 <> 0 then 1 end) as colours_stable, count(*) as total from fx_geo""",
)
def _(spark, d):
    g = geometry(spark, d).withColumn("colours", F.array(C("frame") % 4)).withColumnRenamed("frame", "id")
    v = g.select(
        "id", F.lit("half").alias("variant"), "valid", (C("cx") / 2 + 0.3).alias("cx"), (C("cy") / 2).alias("cy"), (C("apothem") / 2).alias("apothem"),
        F.when(C("id") % 5 == 0, F.array(F.lit(-1).cast("long"))).otherwise(C("colours")).alias("colours"), F.lit(0.5).alias("scale"), F.lit(0).alias("pad_x"), F.lit(0).alias("pad_y"),
    )
    return stability_summary(g, v, 0.025)


# --- clear flashes ---------------------------------------------------------------------
@query(
    "p29_flash_observation",
    """select frame, true as valid, 'ok' as reason, 6 as lanes, round(max(c), 6) as most_coloured, round(max(w), 6) as most_white from (
        select frame, lane, j, avg(case when colour >= 0 then 1.0 else 0.0 end) as c, avg(case when least(r,g,b) > .84 and greatest(r,g,b) - least(r,g,b) < .065 then 1.0 else 0.0 end) as w from fx_strip29 group by all) group by frame""",
)
def _(spark, d):
    px, geo = board_scene(spark, d)
    o = B.flash_observation(geo, px, 48, 48, step=0.07, across=5)
    return o.select("frame", "valid", "reason", F.size("white").alias("lanes"), R(F.array_max(F.flatten("coloured"))).alias("most_coloured"), R(F.array_max(F.flatten("white"))).alias("most_white"))


V.register_ctes(
    {
        "fx_flash": """select g.run, g.frame, s.seq, g.apothem, g.cx, g.cy, g.frame % 23 <> 0 as valid, g.frame % 17 = 0 as reset from fx_geo g join fx_seq s using (frame)""",
        "fx_flashcut": """select *, sum(cut) over (partition by run order by seq) as seg from (select *, case when seq = 1 or not valid or not lag(valid) over w or reset or abs(apothem/lag(apothem) over w - 1) > .08
            or sqrt(pow(cx - lag(cx) over w, 2) + pow(cy - lag(cy) over w, 2)) > .08*lag(apothem) over w then 1 else 0 end as cut from fx_flash window w as (partition by run order by seq))""",
        "fx_cells": "select vec_id as frame, l.l as lane, j.j as j, abs(embedding[l.l*10+j.j+1]::double) as white, abs(embedding[(l.l*10+j.j+30)%64+1]::double) as coloured from embeddings, range(6) l(l), range(10) j(j)",
        "fx_colmax": "select c.run, c.seq, c.seg, f.j, max(f.coloured) as m from fx_flashcut c join fx_cells f using (frame) where c.valid group by all",
        "fx_prior": "select c.frame, m.j, max(m.m) as prior from fx_flashcut c join fx_colmax m on m.run = c.run and m.seg = c.seg and m.seq between c.seq - 2 and c.seq - 1 where c.valid group by all",
        "fx_ev": """select frame, max(e) as evidence from (select frame, lane, g, avg(white) as e from (select f.frame, f.lane, f.j, f.white, f.j - row_number() over (partition by f.frame, f.lane order by f.j) as g
            from fx_cells f join fx_prior p on p.frame = f.frame and p.j = f.j where f.white >= .1 and p.prior >= .1) group by frame, lane, g having count(*) >= 2) group by frame""",
        "fx_broad": "select distinct a.frame from fx_cells a join fx_cells b on b.frame = a.frame and b.lane = a.lane and b.j = a.j + 1 where a.white >= .1 and b.white >= .1",
        "fx_clear": """select *, sum(case when evidence > 0 then 1 else 0 end) over (partition by run, seg, stretch order by seq) as seen from (
            select *, seq - row_number() over (partition by run, seg, broad order by seq) as stretch from (
              select c.*, coalesce(e.evidence, 0.0) as evidence, c.valid and b.frame is not null as broad from fx_flashcut c left join fx_ev e using (frame) left join fx_broad b using (frame)))""",
    }
)


def flashes(spark, d):
    seq = sequenced(spark, d).select("frame", "seq")
    e = V.read(spark, d, "embeddings").select(C("vec_id").alias("frame"), "embedding")
    grid = lambda shift: F.transform(
        F.sequence(F.lit(0), F.lit(5)),
        lambda k: F.transform(F.sequence(F.lit(0), F.lit(9)), lambda j: F.abs(F.element_at("embedding", ((k * 10 + j + shift) % 64 + 1).cast("int")).cast("double"))),
    )
    f = geometry(spark, d).withColumn("valid", C("frame") % 23 != 0).join(seq, "frame").join(e, "frame")
    return f.select(
        "run", "frame", "valid", F.when(C("valid"), "ok").otherwise("unsupported_geometry").alias("reason"), "cx", "cy", "apothem", grid(0).alias("white"), grid(30).alias("coloured"),
        (C("seq") / 12.0).alias("t"), (C("seq") * 1000.0 / 12).alias("at_ms"), (C("frame") % 17 == 0).alias("reset"),
    )


FLASH_LINE = Timeline(("run",), ("at_ms",), "at_ms", 2_000)


@query(
    "p30_clear_events",
    """select run, frame, valid as supported, coalesce(broad and evidence > 0 and seen = 1, false) as event, round(case when valid then evidence else 0 end, 6) as confidence from fx_clear""",
)
def _(spark, d):
    e = B.clear_events(flashes(spark, d), FLASH_LINE, 12, 0.1)
    return e.select("run", "frame", "supported", "event", R(C("confidence")).alias("confidence"))


