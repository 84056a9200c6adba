"""Registered queries: joins along time, analytic windows, insights, alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from foretide.functions import scalars as S
from foretide.operators import aggregates as A
from foretide.operators import quality as Q
from foretide.operators import timejoin as J
from foretide.operators import windows as W
from foretide.operators.timeline import SLICE, Timeline, row_numbers
from foretide.plans import views as V
from foretide.plans.registry import query
from foretide.plans.sessions import KEY, RUNS_LINE, R, cohort_runs, runs40
from foretide.settings import materialise

C = F.col
O = V.OBS_LINE
ORD = "partition by session_id order by ts_ms, event_id"


# --- flagship ------------------------------------------------------------------
V.register_ctes(
    {
        "fx_numbered": f"select *, row_number() over ({ORD}) as rn from fx_obs",
        "fx_windows": """
select a.session_id, a.event_id, a.ts_ms, a.active_ms, a.motion, f.active_duration_ms, count(*) as rows, a.active_ms - min(h.active_ms) as span_ms
from fx_numbered a join fx_numbered h on h.session_id = a.session_id and h.active_ms between a.active_ms - 8000 and a.active_ms
join fx_facts f on f.session_id = a.session_id
where a.rn > 32 and (a.rn - 33) % 4 = 0 group by a.session_id, a.event_id, a.ts_ms, a.active_ms, a.motion, f.active_duration_ms having count(*) >= 28 and a.active_ms - min(h.active_ms) >= 7500""",
        "fx_history": """
select w.session_id, w.event_id, h.motion, h.active_ms, row_number() over (partition by w.session_id, w.event_id order by h.active_ms, h.ts_ms, h.event_id) - 1 as i,
       count(*) over (partition by w.session_id, w.event_id) as n
from fx_windows w join fx_obs h on h.session_id = w.session_id and h.active_ms between w.active_ms - 8000 and w.active_ms""",
        "fx_even": """
select h.session_id, h.event_id, k.i, h.motion, h.active_ms from fx_history h, range(32) k(i)
where h.i = cast(round_even(k.i * (h.n - 1) / 31.0, 0) as bigint)""",
    }
)


def windows(spark, d, fields=("motion",)):
    """Anchored 8 s histories of every run with the duration and labels attached."""
    w = J.select_history(V.obs(spark, d), V.HISTORY_LINE, fields)
    return w.join(V.session_facts(spark, d).select("session_id", "active_duration_ms"), "session_id").withColumn(
        "ttf", S.time_to_failure(C("active_duration_ms"), C("active_ms"))
    )


@query(
    "flagship_failure_rates",
    "select count(distinct session_id) as sessions, count(*) as windows, round(avg(mean_motion), 6) as mean_motion, "
    + ", ".join(f"round(avg(case when ttf <= {h} then 1.0 else 0.0 end), 6) as rate_{h}" for h in V.FX_HORIZONS)
    + """ from (select w.session_id, greatest(0.0, (w.active_duration_ms - w.active_ms)/1000.0) as ttf, m.mean_motion from fx_windows w
          join (select session_id, event_id, avg(motion) as mean_motion from fx_even group by all) m on m.session_id = w.session_id and m.event_id = w.event_id)""",
)
def _(spark, d):
    w = windows(spark, d).withColumn("history", J.resample_even(C("history")))
    f = aggregated(w)
    y = f.withColumn("y", S.failure_targets(C("ttf"), V.FX_HORIZONS))
    rates = [F.sum(F.element_at("y", i + 1)).alias(f"_y{i}") for i in range(7)]
    per = y.groupBy("session_id").agg(F.count("*").alias("_n"), F.sum("mean_motion").alias("_m"), *rates)
    return per.agg(
        F.count("*").alias("sessions"),
        F.sum("_n").alias("windows"),
        R(F.sum("_m") / F.sum("_n")).alias("mean_motion"),
        *[R(F.sum(f"_y{i}") / F.sum("_n")).alias(f"rate_{h}") for i, h in enumerate(V.FX_HORIZONS)],
    )


def aggregated(w):
    return J.aggregate_window(w, ["session_id", SLICE, "event_id", "ttf"], ["motion"])


@query("j05_select_history", 'select session_id, event_id, "rows" as n, span_ms from fx_windows')
def _(spark, d):
    return J.select_history(V.obs(spark, d), V.HISTORY_LINE, ["motion"]).select(*KEY, C("rows").alias("n"), "span_ms")


@query("w06_anchors", "select session_id, event_id from fx_numbered where rn > 32 and (rn - 33) % 4 = 0")
def _(spark, d):
    return J.anchors(V.obs(spark, d), O).select(*KEY)


@query("w07_resample_even", "select session_id, event_id, i, active_ms, motion from fx_even")
def _(spark, d):
    w = windows(spark, d).select(*KEY, F.posexplode(J.resample_even(C("history"))).alias("i", "row"))
    return w.select(*KEY, C("i").cast("long").alias("i"), "row.active_ms", "row.motion")


@query(
    "a10_aggregate_window",
    """select session_id, event_id, round(avg(motion), 9) as mean_motion, round(stddev_pop(motion), 9) as std_motion, min(motion) as min_motion, max(motion) as max_motion,
       round(avg(case when i >= 24 then motion end) - avg(case when i < 8 then motion end), 9) as delta_motion from fx_even group by all""",
)
def _(spark, d):
    w = windows(spark, d).withColumn("history", J.resample_even(C("history")))
    a = aggregated(w)
    return a.select(*KEY, *[R(C(f"{s}_motion"), 9).alias(f"{s}_motion") for s in ("mean", "std", "min", "max", "delta")])


@query(
    "a13_normalise",
    """select session_id, event_id, round((motion - mu)/sd, 6) as motion from fx_windows,
       (select avg(motion) as mu, stddev_pop(motion) + 1e-6 as sd from fx_even)""",
)
def _(spark, d):
    w = windows(spark, d).withColumn("history", J.resample_even(C("history")))
    stats = A.fit_normaliser(w, ["motion"])
    return A.normalise(w.select(*KEY, "motion"), stats, ["motion"]).select(*KEY, R(C("motion")).alias("motion"))


# --- joins ------------------------------------------------------------------------
@query(
    "j01_resume_points",
    """select f.session_id, l.ordinal, l.active_ms as resume_ms from fx_facts f left join
       (select *, row_number() over (partition by session_id order by ts_ms, event_id) as ordinal from fx_lifecycle where state='active') l using (session_id)""",
)
def _(spark, d):
    return J.resume_points(V.session_facts(spark, d).select("session_id"), V.lifecycle(spark, d), O).select("session_id", "ordinal", "resume_ms")


@query(
    "j02_last_resume",
    """select o.session_id, o.event_id, coalesce((select max(l.active_ms) from fx_lifecycle l where l.session_id=o.session_id and l.state='active' and l.active_ms <= o.active_ms), 0) as last_resume from fx_obs o""",
)
def _(spark, d):
    return J.last_resume(V.obs(spark, d), V.lifecycle(spark, d), O).select(*KEY, "last_resume")


@query(
    "j03_frames_with_clock",
    "select session_id, ts_ms, active_ms, motion from fx_obs where event_type = 'view' and event_id % 3 <> 0",
)
def _(spark, d):
    o = V.obs(spark, d)
    frames = o.where("event_type = 'view'").select("session_id", "ts_ms", "event_id")
    clock = o.where("event_id % 3 <> 0").select("session_id", "ts_ms", "event_id", "active_ms", "motion")
    return J.frames_with_clock(frames, clock, ["session_id", "ts_ms", "event_id"]).select("session_id", "ts_ms", "active_ms", "motion")


@query("j04_attach_motion", "select session_id, event_id, case when event_id % 3 <> 0 then motion else 0.0 end as motion from fx_obs where event_type = 'view'")
def _(spark, d):
    o = V.obs(spark, d)
    frames = o.where("event_type = 'view'").select(*KEY)
    return J.attach_motion(frames, o.where("event_id % 3 <> 0"), KEY).select(*KEY, "motion")


def view_frames(spark, d, fps=1):
    """View events as video frames: index per run and its own clock (index / fps + 0.5 s)."""
    v = V.obs(spark, d).where("event_type = 'view'")
    n = row_numbers(v, O, "_rn")
    return n.select(
        "session_id", (C("_rn") - 1).alias("idx"), C("motion").alias("radius"), "event_id",
        ((C("_rn") - 1) * int(1000 / fps) + 500).alias("active_ms"), "ts_ms",
    )


V.register_ctes(
    {
        "fx_frames": f"""select session_id, event_id, ts_ms, rn - 1 as idx, motion as radius, (rn - 1)*1000 + 500 as active_ms from
        (select *, row_number() over ({ORD}) as rn from fx_obs where event_type = 'view')""",
    }
)


@query(
    "j06_asof_frame",
    """select o.session_id, o.event_id, (select max(f.idx) from fx_frames f where f.session_id = o.session_id and f.active_ms <= o.active_ms and o.active_ms - f.active_ms <= 300
         and f.active_ms = (select max(g.active_ms) from fx_frames g where g.session_id = o.session_id and g.active_ms <= o.active_ms)) as idx from fx_obs o""",
)
def _(spark, d):
    return J.asof_frame(V.obs(spark, d), view_frames(spark, d), O, 300, {"idx": C("idx")}).select(*KEY, "idx")


@query(
    "j07_nearest",
    """select session_id, event_id, near_id from (select t.session_id, t.event_id, o.event_id as near_id,
         row_number() over (partition by t.session_id, t.event_id order by abs(o.active_ms - t.active_ms), o.active_ms, o.event_id) as k
         from (select * from fx_obs where event_type = 'signup') t join (select * from fx_obs where event_type = 'purchase') o using (session_id)) where k = 1""",
)
def _(spark, d):
    o = V.obs(spark, d)
    t = o.where("event_type = 'signup'").select("session_id", "event_id", "active_ms")
    p = o.where("event_type = 'purchase'").select("session_id", "event_id", "active_ms")
    n = J.nearest(t, p, Timeline(("session_id",), ("active_ms",), "active_ms", V.SLICE_MS), "event_id", {"near_id": C("event_id")})
    return n.select(*KEY, "near_id").where("near_id is not null")


V.register_ctes(
    {"fx_seq": "select vec_id as frame, label as session, row_number() over (partition by label order by vec_id) as seq from embeddings"}
)
FRAME_LINE = Timeline(("session",), ("frame",), "frame", 100)


def sequenced(spark, d):
    e = V.read(spark, d, "embeddings").select(C("vec_id").alias("frame"), C("label").alias("session"))
    return row_numbers(e, FRAME_LINE, "seq")


@query(
    "j08_best_alignment",
    """select session, target, candidates, round(mse, 9) as mse, "offset", "offset" = lo or "offset" = hi as search_edge from (
        select session, target, "offset", mse, min("offset") over w as lo, max("offset") over w as hi, count(*) over w as candidates,
               row_number() over (partition by session, target order by mse, "offset") as k from (
          select s.session, s.seq as target, c.seq - s.seq as "offset", avg(pow(a.r - b.g, 2)) as mse
          from fx_seq s join fx_seq c on c.session = s.session and c.seq - s.seq between -7 and 8
          join fx_pixels a on a.frame = s.frame join fx_pixels b on b.frame = c.frame and a.x = b.x and a.y = b.y
          where s.seq % 3 = 0 and a.x between 2 and 5 and a.y between 2 and 5 group by all)
        window w as (partition by session, target)) where k = 1""",
)
def _(spark, d):
    px = V.pixels(spark, d).join(sequenced(spark, d).select("frame", "seq"), "frame")
    t = px.where("seq % 3 = 0").select("session", "seq", "y", "x", C("r").alias("value"))
    c = px.select("session", "seq", "y", "x", C("g").alias("value"))
    b = J.best_alignment(t, c, ["session"], range(-7, 9), (2, 5))
    return b.select("session", "target", "candidates", R(C("mse"), 9).alias("mse"), C("offset").cast("long").alias("offset"), "search_edge")


DUP = dict(start_ms=3_600_000, duration_ms=200)


@query(
    "j09_duplicate_runs",
    """select distinct a.session_id from fx_facts a join fx_facts b on a.session_id <> b.session_id and abs(a.started_ms - b.started_ms) <= 3600000
       and abs(a.active_duration_ms - b.active_duration_ms) <= 200
       and abs(a.valid_frame_count - b.valid_frame_count) <= greatest(4.0, round_even(greatest(a.valid_frame_count, b.valid_frame_count)*0.02, 0))""",
)
def _(spark, d):
    return J.duplicate_runs(V.session_facts(spark, d), **DUP)


@query(
    "j09_quarantine",
    """select f.session_id, f.usable and t.session_id is null as usable, case when t.session_id is not null then 'excluded: duplicate-controller capture' else f.quality_reason end as quality_reason
       from fx_sessions f left join (select distinct a.session_id from fx_cohort a join fx_cohort b on a.session_id <> b.session_id and abs(a.started_ms - b.started_ms) <= 3600000
       and abs(a.active_duration_ms - b.active_duration_ms) <= 200
       and abs(a.valid_frame_count - b.valid_frame_count) <= greatest(4.0, round_even(greatest(a.valid_frame_count, b.valid_frame_count)*0.02, 0))) t using (session_id)""",
)
def _(spark, d):
    return J.quarantine_duplicates(V.sessions(spark, d), **DUP).select("session_id", "usable", "quality_reason")


@query("j10_pause_counts", "select f.session_id, count(l.event_id) as pause_count from fx_facts f left join fx_lifecycle l on l.session_id = f.session_id and l.state = 'paused' group by 1")
def _(spark, d):
    return J.pause_counts(V.session_facts(spark, d), V.lifecycle(spark, d)).select("session_id", "pause_count")


@query(
    "j11_session_detail",
    """select session_id, section, (rn-1)//25 as page, count(*) as items, min(ts_ms) as first_ms, max(ts_ms) as last_ms from (
         select session_id, 'predictions' as section, ts_ms, row_number() over (partition by session_id order by ts_ms, event_id) as rn from fx_predictions where status='ready'
         union all select session_id, 'lifecycle', ts_ms, row_number() over (partition by session_id order by ts_ms, event_id) from fx_lifecycle) group by all""",
)
def _(spark, d):
    p = V.predictions(spark, d).where("status = 'ready'").select(*KEY, "ts_ms", "active_ms", "loss_window")
    pages = J.session_detail({"predictions": p, "lifecycle": V.lifecycle(spark, d)}, O, 25)
    ms = lambda at: F.get_json_object(at, "$.ts_ms").cast("long")
    return pages.select(
        "session_id", "section", "page", F.size("items").alias("items"), ms(F.element_at("items", 1)).alias("first_ms"),
        ms(F.element_at("items", -1)).alias("last_ms"),
    )


@query(
    "j12_prior_baseline",
    """select s.session_id, round((select avg(b.active_duration_ms) from fx_sessions b where b.usable and b.started_ms < s.started_ms)/1000.0, 6) as baseline_s from fx_sessions s""",
)
def _(spark, d):
    return J.prior_baseline(V.sessions(spark, d), RUNS_LINE).select("session_id", R(C("baseline_s")).alias("baseline_s"))


def marks(spark, d, *kinds, fps=12):
    """Distinct positions of each kind of event: one pass over the observations, one table.

    Positions are dealt by all their columns to the session's number of partitions, so no
    task's share depends on how small they are on the wire or on a busy session.
    """
    o = V.obs(spark, d).where(C("event_type").isin(*kinds))
    at = o.select("session_id", F.expr(f"active_ms * {fps} div 1000").alias("at"), "event_type")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    once = materialise(at.repartition(parts, *at.columns).distinct(), "marks")
    return [once.where(C("event_type") == k).select("session_id", "at") for k in kinds]


@query(
    "j13_match_events",
    """
with recursive truth as (select distinct session_id, active_ms*12//1000 as pos from fx_obs where event_type='purchase'),
ev as (select distinct session_id, active_ms*12//1000 as pos from fx_obs where event_type='click'),
k as (select session_id, pos, row_number() over (partition by session_id order by pos) as k,
      (select count(*) from truth t where t.session_id = e.session_id and t.pos + 6 < e.pos) as lo,
      (select count(*) from truth t where t.session_id = e.session_id and t.pos - 1 <= e.pos) as hi from ev e),
tn as (select session_id, pos, row_number() over (partition by session_id order by pos) - 1 as i from truth),
walk as (select session_id, pos, k, hi, greatest(0, lo) as p, greatest(0, lo) < hi as hit from k where k = 1
  union all select k.session_id, k.pos, k.k, k.hi, greatest(w.p + case when w.hit then 1 else 0 end, k.lo), greatest(w.p + case when w.hit then 1 else 0 end, k.lo) < k.hi
  from walk w join k on k.session_id = w.session_id and k.k = w.k + 1),
used as (select session_id, pos, case when hit then p end as i from walk)
select coalesce(u.session_id, t.session_id) as session_id, case when u.pos is null then 'missed' when t.pos is null then 'false' else 'matched' end as kind, u.pos as event_at, t.pos as truth_at
from used u full join tn t on t.session_id = u.session_id and t.i = u.i""",
)
def _(spark, d):
    return J.match_events(*marks(spark, d, "click", "purchase"), ["session_id"], 1, 6)


@query(
    "j14_completeness",
    """select (select count(*) from documents d where d.doc_id not in (select doc_id from labels)) as missing,
       (select count(*) from labels l where l.doc_id not in (select doc_id from documents)) as unexpected,
       (select count(*) from (select doc_id from labels group by 1 having count(*) > 1)) as repeated""",
)
def _(spark, d):
    return J.completeness(V.read(spark, d, "documents"), V.read(spark, d, "labels"), "doc_id")


@query(
    "j15_expand_grid",
    "select run, candidate, fold, count(*) as n from fx_runs join fx_obs using (session_id), (values ('a'),('b')) c(candidate), range(3) f(fold) group by all",
)
def _(spark, d):
    runs = cohort_runs(spark, d).select("session_id", "run")
    n = V.obs(spark, d).join(runs, "session_id").groupBy("run").agg(F.count("*").alias("n"))
    return J.expand_grid(n, candidate=["a", "b"], fold=[0, 1, 2]).select("run", "candidate", C("fold").cast("long").alias("fold"), "n")


@query(
    "j16_anchor_differences",
    """select side, count(*) as n from (select 'left' as side from fx_obs where event_id % 10 = 0 and event_id % 15 <> 0 union all select 'right' from fx_obs where event_id % 15 = 0 and event_id % 10 <> 0) group by 1""",
)
def _(spark, d):
    o = V.obs(spark, d).select("session_id", "event_id", "active_ms")
    a, b = o.where("event_id % 15 <> 0"), o.where("event_id % 10 <> 0")
    return J.anchor_differences(a, b, ["session_id", "event_id", "active_ms"]).groupBy("side").agg(F.count("*").alias("n"))


@query(
    "j17_common_windows",
    "select session_id, event_id, (1 + active_ms // 4000)*10000000 + (1 + active_ms // 3000) as segment from fx_obs where event_id % 3 <> 0 and event_id % 5 <> 0",
)
def _(spark, d):
    o = V.obs(spark, d)
    a = o.select(*KEY, (C("event_id") % 3 != 0).alias("valid"), F.expr("1 + active_ms div 4000").alias("segment"))
    b = o.select(*KEY, (C("event_id") % 5 != 0).alias("valid"), F.expr("1 + active_ms div 3000").alias("segment"))
    return J.common_windows(a, b, KEY)


@query("j18_needs_work", "select doc_id from documents where doc_id % 7 = 0 or source = (select max(source) from documents)")
def _(spark, d):
    docs = V.read(spark, d, "documents")
    now = docs.select("doc_id", "source", S.content_hash(C("text").cast("binary")).alias("content"), F.lit("v1").alias("code"))
    old_text = F.when(C("doc_id") % 7 == 0, F.concat("text", F.lit("~"))).otherwise(C("text"))
    newest = docs.agg(F.max("source").alias("_s"))
    cache = docs.join(F.broadcast(newest)).where(C("source") != C("_s")).select(
        "doc_id", S.content_hash(old_text.cast("binary")).alias("content"), F.lit("v1").alias("code")
    )
    return J.needs_work(now, cache, ["doc_id", "content", "code"]).select("doc_id")


@query("j19_apply_repairs", "select session_id, event_id, case when event_id % 9 = 0 then motion + 1000 else motion end as motion, event_id % 9 = 0 or event_id % 4 <> 0 as valid from fx_obs")
def _(spark, d):
    o = V.obs(spark, d).withColumn("valid", C("event_id") % 4 != 0)
    fixed = o.where("event_id % 9 = 0").withColumn("motion", C("motion") + 1000).withColumn("valid", F.lit(True))
    return J.apply_repairs(o, fixed, KEY, ["motion", "valid"]).select(*KEY, "motion", "valid")


@query(
    "j22_clip_frames",
    """select session_id, anchor, event_id from (select t.session_id, t.event_id as anchor, o.event_id,
         row_number() over (partition by t.session_id, t.event_id order by o.ts_ms, o.event_id) - 1 as i, count(*) over (partition by t.session_id, t.event_id) as n
         from fx_obs t join fx_obs o on o.session_id = t.session_id and abs(o.active_ms - t.active_ms) <= 2000 where t.event_id % 40 = 0)
       where i in (select cast(floor(k.k * (n-1) / greatest(1, least(8, n)-1)) as bigint) from range(8) k(k) where k.k < least(8, n))""",
)
def _(spark, d):
    o = V.obs(spark, d).select("session_id", "event_id", "ts_ms", "active_ms")
    a = o.where("event_id % 40 = 0").withColumnRenamed("event_id", "anchor")
    return J.clip_frames(a, o, O, "anchor", 2000).select("session_id", "anchor", "event_id")


@query(
    "j23_lead_frames",
    """select e.session_id, l.lead, f.idx, f.event_id from fx_facts e, (values (10.0),(5.0),(2.0)) l(lead) join fx_frames f on f.session_id = e.session_id and f.idx = cast(trunc(e.active_duration_ms/1000.0 - l.lead) as bigint)""",
)
def _(spark, d):
    ends = V.session_facts(spark, d).select("session_id", (C("active_duration_ms") / 1000.0).alias("event_s"))
    return J.lead_frames(ends, view_frames(spark, d), ["session_id"], 1.0, (10, 5, 2)).select("session_id", "lead", "idx", "event_id")


@query(
    "u04_audit_targets",
    """select session_id, kind, round(at_s, 6) as at_s from (
        select session_id, 'distribution' as kind, active_duration_ms/1000.0*f.f as at_s from fx_facts, (values (0.1),(0.9)) f(f)
        union all select session_id, 'after_resume', active_ms/1000.0+1 from fx_lifecycle where state='active' and active_ms > 0)""",
)
def _(spark, d):
    ends = J.expand_grid(V.session_facts(spark, d).select("session_id", "active_duration_ms"), f=[0.1, 0.9])
    a = ends.select("session_id", F.lit("distribution").alias("kind"), (C("active_duration_ms") / 1000.0 * C("f")).alias("at_s"))
    p = V.lifecycle(spark, d).where("state = 'active' and active_ms > 0")
    b = p.select("session_id", F.lit("after_resume").alias("kind"), (C("active_ms") / 1000.0 + 1).alias("at_s"))
    return a.unionByName(b).select("session_id", "kind", R(C("at_s")).alias("at_s"))


# --- windows -------------------------------------------------------------------------
@query("w01_run_order", "select session_id, cast(run as bigint) as run from fx_runs40")
def _(spark, d):
    return runs40(spark, d).select("session_id", "run")


V.register_ctes(
    {
        "fx_gaps": f"""select *, ts_ms - lag(ts_ms) over ({ORD}) as wall_delta, active_ms - lag(active_ms) over ({ORD}) as active_delta,
        row_number() over ({ORD}) as rn from fx_obs""",
        "fx_segments": """select *, sum(case when rn = 1 or active_delta <= 0 or active_delta > 600 or wall_delta > 150000000 or
          exists (select 1 from fx_lifecycle l where l.session_id = g.session_id and l.state='active' and l.event_id % 6 = 0 and l.active_ms > g.active_ms - g.active_delta and l.active_ms <= g.active_ms)
          then 1 else 0 end) over (partition by session_id order by ts_ms, event_id) as segment from fx_gaps g""",
    }
)


@query("w02_gap_flags", "select session_id, event_id, active_delta, coalesce(wall_delta > 150000000 or active_delta > 600, false) as gap from fx_gaps")
def _(spark, d):
    return W.gap_flags(V.obs(spark, d), O, "ts_ms", 150_000_000, 600).select(*KEY, "active_delta", "gap")


@query(
    "w03_low_streak",
    """select session_id, max(case when low then n else 0 end) as longest from (select session_id, low, g, count(*) as n from (
        select session_id, motion <= 20 as low, row_number() over (partition by session_id order by ts_ms, event_id) - row_number() over (partition by session_id, motion <= 20 order by ts_ms, event_id) as g from fx_obs)
        group by all) group by session_id""",
)
def _(spark, d):
    return W.low_streak(V.obs(spark, d), O, 20.0)


def segmented(spark, d):
    some = V.lifecycle(spark, d).where("event_id % 6 = 0")
    return W.segment_ids(J.last_resume(V.obs(spark, d), some, O, -1), O, "ts_ms", 600, 150_000_000)


@query("w04_segment_ids", "select session_id, event_id, cast(segment as bigint) as segment from fx_segments")
def _(spark, d):
    return segmented(spark, d).select(*KEY, "segment")


V.register_ctes(
    {
        "fx_geo": """select label as run, vec_id as frame, vec_id % 9 <> 0 as valid, 20 + abs(embedding[1]::double) as apothem, 50 + embedding[2]::double*10 as cx, 50 + embedding[3]::double*10 as cy,
        row_number() over (partition by label order by vec_id) as rn from embeddings""",
        "fx_changed": """select *, case when rn = 1 then false else (not valid or not pv or abs(apothem/pa - 1) > .03 or sqrt((cx-px)*(cx-px)+(cy-py)*(cy-py)) > .08*pa) end as changed from (
        select *, lag(valid) over w as pv, lag(apothem) over w as pa, lag(cx) over w as px, lag(cy) over w as py from fx_geo window w as (partition by run order by frame))""",
    }
)
GEO_LINE = Timeline(("run",), ("frame",), "frame", 100)


def geometry(spark, d):
    e = lambda i: F.element_at("embedding", i).cast("double")
    return V.read(spark, d, "embeddings").select(
        C("label").alias("run"), C("vec_id").alias("frame"), (C("vec_id") % 9 != 0).alias("valid"),
        (20 + F.abs(e(1))).alias("apothem"), (50 + e(2) * 10).alias("cx"), (50 + e(3) * 10).alias("cy"),
    )


@query("w05_geometry_changed", "select run, frame, case when rn = 1 then false else (not valid or not pv or abs(apothem/pa - 1) > .08 or sqrt((cx-px)*(cx-px)+(cy-py)*(cy-py)) > .08*pa) end as changed from fx_changed")
def _(spark, d):
    return W.geometry_changed(geometry(spark, d), GEO_LINE).select("run", "frame", "changed")


@query(
    "w13_smooth",
    "select session_id, event_id, " + ", ".join(f"round(greatest({', '.join(f's{j}' for j in range(i + 1))}), 9) as s{i}" if i else "round(s0, 9) as s0" for i in range(7))
    + " from (select session_id, event_id, " + ", ".join(f"avg(m{i}) over w as s{i}" for i in range(7))
    + f" from fx_predictions window w as ({ORD} rows between 2 preceding and current row))",
)
def _(spark, d):
    m = V.predictions(spark, d).select(*KEY, "ts_ms", "active_ms", "m")
    return W.smooth(m, O).select(*KEY, *[R(F.element_at("smoothed", i + 1), 9).alias(f"s{i}") for i in range(7)])


@query(
    "w14_warning_leads",
    """select session_id, round(coalesce(max(case when crossing < 7 and ttf <= 12 then ttf end), 0.0), 6) as lead, count(case when crossing < 7 and ttf > 12 then 1 end) as false_early from fx_labelled group by 1""",
)
def _(spark, d):
    p = V.labelled(spark, d).withColumn("signal", S.predicted_class(C("crossing")) < 5)
    return W.warning_leads(p, 12.0).select("session_id", R(C("lead")).alias("lead"), "false_early")


SEG_SQL = """select session_id, '{kind}' as kind, min(ts_ms) as start_ms, max(ts_ms) as end_ms, min(active_ms) as start_active_ms, max(active_ms) as end_active_ms from (
  select *, row_number() over (partition by session_id order by ts_ms, event_id) - row_number() over (partition by session_id, hit order by ts_ms, event_id) as g from (
    select *, {pred} as hit from fx_predictions where status='ready')) where hit group by session_id, g having max(active_ms) - min(active_ms) >= {ms}"""
SIGNAL_SQL = SEG_SQL.format(kind="loss_signal", pred="loss_window <> 'none'", ms=400)
IMMINENT_SQL = SEG_SQL.format(kind="imminent", pred="loss_window = 'under_10s'", ms=100)
SHIFT_SQL = f"""select session_id, 'forecast_shift' as kind, pt as start_ms, ts_ms as end_ms, pa as start_active_ms, active_ms as end_active_ms from (
  select *, lag(ts_ms) over ({ORD}) as pt, lag(active_ms) over ({ORD}) as pa, lag(remaining) over ({ORD}) as pr from fx_predictions where status='ready')
  where active_ms - pa <= 3000 and pr - remaining >= 9.123"""


@query("w15_segments", SIGNAL_SQL)
def _(spark, d):
    p = V.predictions(spark, d).where("status = 'ready'")
    return W.segments(p, O, C("loss_window") != "none", 400, "loss_signal")


@query("w16_forecast_shifts", SHIFT_SQL)
def _(spark, d):
    return W.forecast_shifts(V.predictions(spark, d).where("status = 'ready'"), O, 3000, 9.123)


@query("w17_insights", f"{SIGNAL_SQL} union all {IMMINENT_SQL} union all {SHIFT_SQL}")
def _(spark, d):
    return W.insights(V.predictions(spark, d), O, 400, 100, 3000, 9.123).orderBy("session_id", "start_ms", "kind")


@query("ud01_predicate_segments", SEG_SQL.format(kind="busy", pred="m0 > 0.25", ms=200))
def _(spark, d):
    p = V.predictions(spark, d).where("status = 'ready'")
    return W.segments(p, O, F.element_at("m", 1) > 0.25, 200, "busy")


@query(
    "w18_context_validity",
    """select session_id, event_id, case when event_id % 97 = 0 then 'gray_not_found' when n < 9 or s <> segment then 'insufficient_continuous_context' when bad > 0 then 'invalid_frame_in_context' else 'ok' end as reason from (
        select *, count(*) over w as n, first(segment) over w as s, sum(case when event_id % 97 = 0 then 1 else 0 end) over w as bad from fx_segments
        window w as (partition by session_id order by ts_ms, event_id rows between 8 preceding and current row))""",
)
def _(spark, d):
    f = segmented(spark, d).withColumn("valid", C("event_id") % 97 != 0).withColumn("frame_reason", F.when(C("event_id") % 97 == 0, "gray_not_found").otherwise("ok"))
    return W.context_validity(f, O, 9).select(*KEY, "reason")


V.register_ctes(
    {
        "fx_ctx": """select s.session_id, run, s.event_id, s.active_ms, case when s.event_id % 97 = 0 then 'gray_not_found' when n < 9 or first_seg <> segment then 'insufficient_continuous_context' when bad > 0 then 'invalid_frame_in_context' else 'ok' end as reason from (
        select *, count(*) over w as n, first(segment) over w as first_seg, sum(case when event_id % 97 = 0 then 1 else 0 end) over w as bad from fx_segments
        window w as (partition by session_id order by ts_ms, event_id rows between 8 preceding and current row)) s join fx_runs r using (session_id)""",
    }
)


def contexts(spark, d):
    f = segmented(spark, d).withColumn("valid", C("event_id") % 97 != 0).withColumn("frame_reason", F.when(C("event_id") % 97 == 0, "gray_not_found").otherwise("ok"))
    runs = cohort_runs(spark, d).select("session_id", "run", "active_duration_ms")
    return W.context_validity(f, O, 9).join(runs, "session_id")


@query("a08_coverage_by_run", "select cast(run as bigint) as run, count(*) as eligible, count(case when reason='ok' then 1 end) as valid, round(avg(case when reason='ok' then 1.0 else 0.0 end), 6) as coverage from fx_ctx group by 1")
def _(spark, d):
    return A.coverage_by_run(contexts(spark, d)).select("run", "eligible", "valid", R(C("coverage")).alias("coverage"))


@query("a09_frame_failures", "select cast(run as bigint) as run, reason, count(*) as n from fx_ctx where reason <> 'ok' group by all")
def _(spark, d):
    return A.exclusions_by_run(contexts(spark, d))


@query(
    "a26_tail_support",
    """select cast(c.run as bigint) as run, count(case when ttf <= 3 then 1 end) as eligible_tail, count(case when ttf <= 3 and reason='ok' then 1 end) as supported_tail, round(avg(case when reason='ok' then 1.0 else 0.0 end), 6) as supported_share
       from (select c.*, (f.active_duration_ms - c.active_ms)/1000.0 as ttf from fx_ctx c join fx_facts f using (session_id)) c group by 1""",
)
def _(spark, d):
    c = contexts(spark, d).withColumn("ttf", (C("active_duration_ms") - C("active_ms")) / 1000.0).withColumn("valid", C("reason") == "ok")
    return A.tail_support(c, 3.0).select("run", "eligible_tail", "supported_tail", R(C("supported_share")).alias("supported_share"))


@query("a27_message_counts", "select event_type, count(*) as n from events group by 1")
def _(spark, d):
    return A.message_counts(V.read(spark, d, "events"), "event_type")


BUCKET_SQL = """select * from (select p.*, s.segment, floor(p.active_ms/1000.0) as bucket, lag(floor(p.active_ms/1000.0)) over w as pb, lag(s.segment) over w as ps, row_number() over w as brn
  from fx_labelled p join fx_segments s using (session_id, event_id) window w as (partition by p.session_id order by p.ts_ms, p.event_id))"""


@query("w19_per_second", f"select session_id, event_id from ({BUCKET_SQL}) where brn = 1 or bucket <> pb or segment <> ps")
def _(spark, d):
    p = V.predictions(spark, d).join(segmented(spark, d).select(*KEY, "segment"), KEY)
    return W.per_second(p, O, C("active_ms") / 1000.0).select(*KEY)


V.register_ctes(
    {
        # One row per second and segment, chunked at segment changes and gaps; a switch is three in a row on one side.
        "fx_sampled": f"""select session_id, event_id, ts_ms, active_ms/1000.0 as t, m6 as p, ttf as r, segment from ({BUCKET_SQL}) where brn = 1 or bucket <> pb or segment <> ps""",
        "fx_alerts": """
select *, coalesce(last_switch = 1, false) as active from (
 select *, last_value(case when up3 then 1 when dn3 then 0 end ignore nulls) over (partition by session_id, grp order by ts_ms, event_id) as last_switch from (
  select *, min(case when p > .5 then 1 else 0 end) over v = 1 and count(*) over v = 3 as up3, min(case when p < .5 then 1 else 0 end) over v = 1 and count(*) over v = 3 as dn3 from (
   select *, sum(cut) over (partition by session_id order by ts_ms, event_id) as grp from (
    select *, case when lag(t) over w is null or lag(segment) over w <> segment or t - lag(t) over w > 1.6 then 1 else 0 end as cut from fx_sampled window w as (partition by session_id order by ts_ms, event_id)))
  window v as (partition by session_id, grp order by ts_ms, event_id rows between 2 preceding and current row)))""",
        "fx_onsets": "select *, active and not coalesce(lag(active) over (partition by session_id, grp order by ts_ms, event_id), false) as onset from fx_alerts",
    }
)


def alerts(spark, d):
    seg = V.obs(spark, d)
    seg = W.segment_ids(seg, O, "ts_ms", 1500, 300_000_000).select(*KEY, "segment")
    p = V.labelled(spark, d).join(seg, KEY)
    return p.select(*KEY, "ts_ms", "active_ms", (C("active_ms") / 1000.0).alias("t"), F.element_at("m", 7).alias("p"), C("ttf").alias("r"), "segment")


ALERT_SEG = """select session_id, event_id, sum(case when rn = 1 or active_delta <= 0 or active_delta > 1500 or wall_delta > 300000000 then 1 else 0 end) over (partition by session_id order by ts_ms, event_id) as segment from fx_gaps"""
V.CTES["fx_sampled"] = V.CTES["fx_sampled"].replace("join fx_segments s using", f"join ({ALERT_SEG}) s using")


@query("w20_alert_episodes", "select session_id, event_id, active, onset from fx_onsets")
def _(spark, d):
    return W.alert_states(alerts(spark, d), O).select(*KEY, "active", "onset")


@query(
    "e10_alert_metrics",
    """select session_id, count(case when onset then 1 end) as alerts, count(case when onset and r between 3 and 10 then 1 end) as timely, count(case when onset and r > 10 then 1 end) as false_alerts,
       round(sum(least(1.0, greatest(0.0, r))), 6) as observed_s, round(sum(case when r > 10 then least(1.0, r - 10) else 0 end), 6) as early_s,
       round(sum(case when active and r > 10 then least(1.0, r - 10) else 0 end), 6) as warning_early_s,
       case when count(case when onset and r between 3 and 10 then 1 end) > 0 then 1.0 else 0.0 end as timely_recall,
       round(coalesce(count(case when onset and r between 3 and 10 then 1 end) / nullif(count(case when onset then 1 end), 0), 0.0), 6) as precision,
       round(coalesce(count(case when onset and r > 10 then 1 end) * 60.0 / nullif(sum(least(1.0, greatest(0.0, r))), 0), 0.0), 6) as false_per_minute,
       round(coalesce(sum(case when active and r > 10 then least(1.0, r - 10) else 0 end) / nullif(sum(case when r > 10 then least(1.0, r - 10) else 0 end), 0), 0.0), 6) as early_fraction
       from fx_onsets group by 1""",
)
def _(spark, d):
    m = W.alert_metrics(W.alert_states(alerts(spark, d), O), ["session_id"], 3.0, 10.0)
    return m.select("session_id", "alerts", "timely", "false_alerts", *[R(C(c)).alias(c) for c in m.columns[4:]])


@query("w22_state_asof", "select o.session_id, o.event_id, coalesce((select last(l.state order by l.ts_ms, l.event_id) from fx_lifecycle l where l.session_id=o.session_id and l.active_ms <= o.active_ms), 'active') as state from fx_obs o")
def _(spark, d):
    return J.state_as_of(V.obs(spark, d), V.lifecycle(spark, d), O).select(*KEY, "state")


@query(
    "w23_active_clock",
    f"""select session_id, event_id, cast(sum(spent) over ({ORD}) as bigint) as active_elapsed from (
        select *, case when lag(state) over ({ORD}) = 'active' then ts_ms - lag(ts_ms) over ({ORD}) else 0 end as spent from fx_lifecycle)""",
)
def _(spark, d):
    line = Timeline(("session_id",), ("ts_ms", "event_id"), "ts_ms", 5 * V.DAY_MS)
    return W.active_clock(V.lifecycle(spark, d), line).select(*KEY, "active_elapsed")


@query("w24_running_max", f"select session_id, event_id, max(motion) over ({ORD}) as running_max from fx_obs")
def _(spark, d):
    return W.running_max(V.obs(spark, d), O, "motion").select(*KEY, "running_max")


@query(
    "w25_collection_index",
    "select session_id, cast(coalesce(sum(case when usable then 1 else 0 end) over (order by started_ms, session_id rows between unbounded preceding and 1 preceding), 0) + 1 as bigint) as collection_index from fx_sessions",
)
def _(spark, d):
    return Q.collection_index(V.sessions(spark, d), RUNS_LINE).select("session_id", "collection_index")


@query(
    "w26_fraction_rows",
    f"""select session_id, cast(part as bigint) as part, event_id from (select *, row_number() over ({ORD}) as rn, count(*) over (partition by session_id) as n from fx_obs),
        (values (0, 1/3.0), (1, 2/3.0), (2, 0.5)) f(part, frac) where rn - 1 = cast(floor((n-1)*frac) as bigint)""",
)
def _(spark, d):
    return W.fraction_rows(V.obs(spark, d), O, [1 / 3, 2 / 3, 0.5]).select("session_id", C("part").cast("long").alias("part"), "event_id")


V.register_ctes(
    {"fx_counts": "select label as run, vec_id as frame, count(case when abs(embedding[i+1]) > 0.11 then 1 end) as n from embeddings, range(64) t(i) group by all"}
)


def pixel_counts(spark, d):
    big = F.filter("embedding", lambda v: F.abs(v.cast("double")) > 0.11)
    return V.read(spark, d, "embeddings").select(C("label").alias("run"), C("vec_id").alias("frame"), F.size(big).alias("n"))


@query(
    "w27_propose_boundary",
    """select run, coalesce(max(case when p >= 25 and n < 25 then frame end), max(frame)) as idx, coalesce(bool_or(p >= 25 and n < 25), false) as found from (
        select run, frame, n, lag(n) over (partition by run order by frame) as p from fx_counts) group by run""",
)
def _(spark, d):
    return W.propose_boundary(pixel_counts(spark, d), GEO_LINE, 25)


@query(
    "w28_thin",
    f"""
with recursive numbered as (select session_id, event_id, active_ms, row_number() over ({ORD}) as rn from fx_obs),
walk as (select session_id, event_id, active_ms, rn, active_ms as kept_at, true as kept from numbered where rn = 1
 union all select n.session_id, n.event_id, n.active_ms, n.rn, case when n.active_ms >= w.kept_at + 240 then n.active_ms else w.kept_at end, n.active_ms >= w.kept_at + 240
 from walk w join numbered n on n.session_id = w.session_id and n.rn = w.rn + 1)
select session_id, event_id from walk where kept""",
)
def _(spark, d):
    return W.thin(V.obs(spark, d), O, 240).select(*KEY)


@query(
    "w29_clip_by_fraction",
    """select f.session_id, f.idx, f.idx - s.start as "offset" from fx_frames f join (select session_id, cast(floor(count(*)*0.4/2) as bigint)*1 as start from fx_frames group by 1) s using (session_id) where f.idx >= s.start and f.idx < s.start + 6""",
)
def _(spark, d):
    f = view_frames(spark, d).select("session_id", "idx")
    n = f.groupBy("session_id").agg(F.count("*").alias("n_cached"))
    line = Timeline(("session_id",), ("idx",), "idx", 1000)
    return W.clip_by_fraction(f.join(n, "session_id"), line, 0.4, 2, 1, 6).select("session_id", "idx", "offset")


@query(
    "w30_drop_events",
    """select run, frame, coalesce(h - lag(h) over (partition by run order by frame) < -0.06, false) as dropped from (select run, frame, sum(height) as h from fx_lanes group by all)""",
)
def _(spark, d):
    return W.drop_events(lane_frames(spark, d), GEO_LINE).select("run", "frame", "dropped")


def lane_frames(spark, d):
    """height, gap, incoming, confidence arrays of six lanes."""
    pick = lambda k: F.transform(F.sequence(F.lit(0), F.lit(5)), lambda l: F.element_at("v", l * 4 + k))
    return V.lanes(spark, d).select(
        "run", "frame", "v", pick(1).alias("height"), pick(2).alias("gap"), pick(3).alias("incoming"), pick(4).alias("confidence")
    )


