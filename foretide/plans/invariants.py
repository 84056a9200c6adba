"""Registered queries: every number of the rotation-invariant and of the compact vector."""

from __future__ import annotations

from pyspark.sql import functions as F

from foretide.operators import board as B
from foretide.operators import windows as W
from foretide.plans import views as V
from foretide.plans.boards import LANE_LINE, full_vectors, motion_sql, timed_lanes
from foretide.plans.registry import query
from foretide.plans.sessions import R

C = F.col
LANES = range(6)


def vector_list() -> str:
    """The 150 numbers of a frame as a list: lanes, colour flags, matches, changes."""
    top = [f"((frame + {i * i}) % 5 - 1)" for i in LANES]
    flags = [f"case when {t} = {k} then 1.0::double else 0.0 end" for t in top for k in range(4)]
    same = [f"case when {t} >= 0 and {t} = {top[(i + 1) % 6]} then 1.0::double else 0.0 end" for i, t in enumerate(top)]
    changes = [f"abs(embedding[{i % 64 + 1}]::double) - 0.1" for i in range(96)]
    lanes = [f"abs(embedding[{i + 1}]::double)" for i in range(24)]
    return "select run, frame, [" + ", ".join(lanes + flags + same + changes) + "] as v from (select label as run, vec_id as frame, embedding from embeddings)"


def invariant_sql() -> list[str]:
    """The 182 numbers as expressions over ``v``."""
    at = lambda i: f"v[{i + 1}]"
    h, g, i_, c = ([at(4 * lane + k) for lane in LANES] for k in range(4))
    total = lambda x: "(" + " + ".join(x) + ")"
    listed = lambda x: "[" + ", ".join(x) + "]"
    most, least = (lambda x: f"greatest({', '.join(x)})"), (lambda x: f"least({', '.join(x)})")
    out = [f"list_sort({listed(x)})[{k + 1}]" for x in (h, g, i_) for k in LANES]
    out += [f"{total(h)}/6", f"list_stddev_pop({listed(h)})", f"{most(h)} - {least(h)}", total(h)]
    out += [total([f"case when {x} > {t} then 1.0 else 0.0 end" for x in h]) for t in (0.5, 0.65, 0.8, 0.95)]
    out += [f"{total(g)}/6", f"list_stddev_pop({listed(g)})"]
    out += [least([f"case when {x} >= {bound} then {y} end" for x, y in zip(h, g)]) for bound in (most(h), f"list_median({listed(h)})")]
    out += [least(c), f"{total(c)}/6"]
    flag = [[at(24 + 4 * lane + k) for k in range(4)] for lane in LANES]
    counts = [total([f[k] for f in flag]) for k in range(4)]
    every = most(["1.0", total(counts)])
    out += [*counts, total([at(48 + lane) for lane in LANES])]
    out.append(total([f"case when {n} > 0 then -({n}/{every})*ln({n}/{every}) else 0.0 end" for n in counts]))
    item = [listed([h[lane], *flag[lane]]) for lane in LANES]
    ring = most([listed([item[(lane + k) % 6] for lane in LANES]) for k in LANES])
    out += [f"({ring})[{lane + 1}][{k + 2}]" for lane in LANES for k in range(4)]
    change = lambda s, k: [at(54 + 24 * s + 4 * lane + k) for lane in LANES]
    out += [x for s in range(4) for k in range(4) for x in change(s, k)]
    for s in range(4):
        grow, clear, motion = change(s, 0), change(s, 1), change(s, 2)
        out += [total(grow), most(grow), least(grow), total(clear), f"{total(motion)}/6", most(motion)]
    return out


NUMBERS = invariant_sql()
FAST = [k * 12 + j for k in range(4) for j in range(5)]
SLOW = [i for i in range(48) if i not in FAST]
V.register_ctes(
    {
        "fx_vec150": vector_list(),
        "fx_invariant": "select run, frame, " + ", ".join(f"round({e}, 6) as n{i}" for i, e in enumerate(NUMBERS)) + " from fx_vec150",
        "fx_motion48": motion_sql(),
    }
)


@query("p26_all_numbers", "select run, frame, " + ", ".join(f"n{i}" for i in range(182)) + " from fx_invariant")
def _(spark, d):
    i = B.invariant_features(full_vectors(spark, d))
    return i.select("run", "frame", *[R(F.element_at("invariant", k + 1)).alias(f"n{k}") for k in range(182)])


COMPACT = [*(f"m.m{i}" for i in FAST), *(f"n.n{i}" for i in range(32)), *(f"m.m{i}" for i in SLOW)]


@query(
    "p27_all_numbers",
    "select n.run, n.frame, " + ", ".join(f"{e} as c{i}" for i, e in enumerate(COMPACT)) + " from fx_invariant n join fx_motion48 m on m.frame = n.frame",
)
def _(spark, d):
    m = W.motion_features(timed_lanes(spark, d).withColumn("phase", C("frame") % 8), LANE_LINE).where("motion is not null").select("frame", "motion")
    c = B.compact_features(B.invariant_features(full_vectors(spark, d)).join(m, "frame"))
    return c.select("run", "frame", *[R(F.element_at("compact", i + 1)).alias(f"c{i}") for i in range(80)])
