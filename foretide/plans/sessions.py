"""Registered queries: scalars, quality, session joins and aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from foretide.functions import scalars as S
from foretide.operators import aggregates as A
from foretide.operators import quality as Q
from foretide.operators import timejoin as J
from foretide.operators import windows as W
from foretide.operators.timeline import Timeline, row_numbers
from foretide.plans import views as V
from foretide.plans.registry import query
from foretide.settings import COHORT, HORIZONS

C = F.col
R = lambda x, d=6: F.round(x.cast("double"), d)
KEY = ["session_id", "event_id"]
RUNS_LINE = Timeline((), ("started_ms", "session_id"), "started_ms", V.HOUR_MS)
PS = ", ".join(f"round(p{i}, 6) as p{i}" for i in range(7))
MS6 = ", ".join(f"round(m{i}, 6) as m{i}" for i in range(7))


def spread(name: str, prefix: str, n: int = 7):
    return [R(F.element_at(name, i + 1)).alias(f"{prefix}{i}") for i in range(n)]


# --- scalar functions -------------------------------------------------------
@query("f01_monotone", f"select session_id, event_id, {MS6} from fx_predictions")
def _(spark, d):
    return V.predictions(spark, d).select(*KEY, *spread("m", "m"))


@query("f02_first_crossing", "select session_id, event_id, cast(crossing as bigint) as crossing from fx_predictions")
def _(spark, d):
    return V.predictions(spark, d).select(*KEY, C("crossing").cast("long").alias("crossing"))


@query("f03_loss_window", "select session_id, event_id, loss_window from fx_predictions")
def _(spark, d):
    return V.predictions(spark, d).select(*KEY, "loss_window")


@query(
    "f04_window_text",
    """
select loss_window, count(*) as n,
  case loss_window when 'none' then 'NO FAILURE SIGNAL' when 'under_10s' then 'LOSS IMMINENT - <10s'
    else 'LOSS LIKELY IN ' || replace(replace(loss_window, '_to_', '-'), 's', 's') end as label,
  case loss_window when 'under_10s' then 5.0 when '10_to_20s' then 15.0 when '20_to_30s' then 25.0
    when '30_to_45s' then 37.5 when '45_to_60s' then 52.5 else 60.0 end::double as seconds
from fx_predictions group by loss_window""",
)
def _(spark, d):
    n = V.predictions(spark, d).groupBy("loss_window").agg(F.count("*").alias("n"))
    w = C("loss_window")
    return n.select("loss_window", "n", S.window_label(w).alias("label"), S.window_seconds(w).alias("seconds"))


@query(
    "f05_expected_remaining",
    f"select session_id, event_id, round({V.trapezoid_sql(V.MS, HORIZONS)}, 9) as remaining from fx_predictions",
)
def _(spark, d):
    return V.predictions(spark, d).select(*KEY, R(S.expected_remaining(C("m")), 9).alias("remaining"))


@query("f06_failure_targets", "select session_id, event_id, " + ", ".join(f"y{i}" for i in range(7)) + " from fx_labelled")
def _(spark, d):
    return V.labelled(spark, d).select(*KEY, *[F.element_at("y", i + 1).alias(f"y{i}") for i in range(7)])


@query("f07_time_to_failure", "select session_id, event_id, round(ttf, 6) as ttf from fx_labelled")
def _(spark, d):
    return V.labelled(spark, d).select(*KEY, R(C("ttf")).alias("ttf"))


CLASS_SQL = (
    "case when ttf <= 2 then 0 when ttf <= 4 then 1 when ttf <= 6 then 2 when ttf <= 9 then 3 when ttf <= 12 then 4 else 5 end"
)
PRED_CLASS_SQL = "case when crossing <= 1 then 0 when crossing <= 3 then 1 else crossing - 2 end"


@query(
    "f08_window_class",
    f"select session_id, event_id, {CLASS_SQL} as actual_class, {PRED_CLASS_SQL} as predicted_class from fx_labelled",
)
def _(spark, d):
    return V.labelled(spark, d).select(
        *KEY, S.actual_class(C("ttf"), V.FX_HORIZONS).alias("actual_class"), S.predicted_class(C("crossing")).alias("predicted_class")
    )


@query(
    "f09_average_duration_probs",
    "select session_id, event_id, "
    + ", ".join(
        f"round(1.0/(1.0+exp(greatest(-50.0, least(50.0, (avg_s - active_ms/1000.0 - {h})/5.0)))), 6) as p{i}"
        for i, h in enumerate(V.FX_HORIZONS)
    )
    + " from fx_obs, (select avg(active_duration_ms/1000.0) as avg_s from fx_facts)",
)
def _(spark, d):
    avg = V.session_facts(spark, d).agg(F.avg(C("active_duration_ms") / 1000.0).alias("avg_s"))
    rows = V.obs(spark, d).join(F.broadcast(avg))
    p = S.average_duration_probs(C("avg_s"), C("active_ms") / 1000.0, V.FX_HORIZONS)
    return rows.select(*KEY, p.alias("p")).select(*KEY, *spread("p", "p"))


@query(
    "f11_safe_logit",
    "select session_id, event_id, round(ln(q/(1-q)), 6) as z from (select session_id, event_id, greatest(1e-6, least(1-1e-6, m3)) as q from fx_predictions)",
)
def _(spark, d):
    return V.predictions(spark, d).select(*KEY, R(S.safe_logit(F.element_at("m", 4))).alias("z"))


@query(
    "f12_certainty",
    """select session_id, event_id, case when abs(m6-m0) <= .04 then 'high' when abs(m6-m0) <= .1 then 'medium' else 'low' end as tier,
       case when abs(m6-m0) <= .1 then 'medium' else 'low' end as tier_high_off from fx_predictions""",
)
def _(spark, d):
    spread_ = F.abs(F.element_at("m", 7) - F.element_at("m", 1))
    return V.predictions(spark, d).select(
        *KEY, S.certainty(spread_, 0.04, 0.10, True, True).alias("tier"), S.certainty(spread_, 0.04, 0.10, False, True).alias("tier_high_off")
    )


@query(
    "f13_round_even",
    """select session_id, event_id, cast(round_even(active_ms/250.0, 0) as double) as r0, cast(round_even(event_id/2.0, 0) as double) as half
       from fx_obs""",
)
def _(spark, d):
    return V.obs(spark, d).select(
        *KEY, S.round_even(C("active_ms") / 250.0).alias("r0"), S.round_even(C("event_id") / 2.0).alias("half")
    )


@query(
    "f14_content_hash",
    "select doc_id, sha256(text) as content, sha256(cast(doc_id as varchar) || '|' || source || '|' || lang) as composite from documents",
)
def _(spark, d):
    return V.read(spark, d, "documents").select(
        "doc_id", S.content_hash(C("text").cast("binary")).alias("content"),
        S.content_hash(C("doc_id").cast("string"), C("source"), C("lang")).alias("composite"),
    )


@query(
    "f15_entropy",
    """select session_id, round(sum(case when n > 0 then -(n/t)*ln(n/t) else 0 end), 6) as entropy from (
       select session_id, n*1.0 as n, sum(n) over (partition by session_id)*1.0 as t from (
         select session_id, event_type, count(*) as n from fx_obs group by 1, 2)) group by session_id""",
)
def _(spark, d):
    kinds = ["click", "error", "purchase", "signup", "view"]
    per = V.obs(spark, d).groupBy("session_id").agg(
        *[F.count(F.when(C("event_type") == k, 1)).cast("double").alias(k) for k in kinds]
    )
    return per.select("session_id", R(S.entropy([C(k) for k in kinds])).alias("entropy"))


@query(
    "f16_canonical_ring",
    """select vec_id, max(ring) as ring from (
        select vec_id, [ round(abs(embedding[(k+j)%6*4+1]::double)*4)::int for j in range(6) ] as r,
               string_agg('', '') as unused, k from embeddings, range(6) t(k) group by vec_id, embedding, k) a,
        lateral (select array_to_string(list_transform(r, lambda v: lpad(v::varchar, 2, '0')), '-') as ring) b group by vec_id""",
)
def _(spark, d):
    e = V.read(spark, d, "embeddings")
    ring = F.transform(
        F.sequence(F.lit(0), F.lit(5)),
        lambda j: F.lpad(F.round(F.abs(F.element_at("embedding", j * 4 + 1).cast("double")) * 4).cast("int").cast("string"), 2, "0"),
    )
    return e.select("vec_id", F.array_join(S.canonical_ring(ring), "-").alias("ring"))


@query(
    "f17_average_motion",
    """select a.vec_id, round(coalesce(avg(abs(b.e - a.e)), 0.0), 6) as motion from
        (select vec_id, i, embedding[i+1]::double as e from embeddings, range(64) t(i)) a
        left join (select vec_id, i, embedding[i+1]::double as e from embeddings, range(64) t(i)) b
        on b.vec_id = a.vec_id + 1 and a.i = b.i group by a.vec_id""",
)
def _(spark, d):
    e = V.read(spark, d, "embeddings").select("vec_id", "embedding")
    nxt = e.select((C("vec_id") - 1).alias("vec_id"), C("embedding").alias("b"))
    return e.join(nxt, "vec_id", "left").select("vec_id", R(S.average_motion(C("embedding"), C("b"))).alias("motion"))


@query("f18_clamp_motion", "select session_id, event_id, round(greatest(0.0, least(1.0, motion/32.0)), 9) as m from fx_obs")
def _(spark, d):
    return V.obs(spark, d).select(*KEY, R(S.clamp_motion(C("motion")), 9).alias("m"))


@query(
    "f19_receipt",
    """select session_id, usable as accepted, case when usable then 'RUN ACCEPTED' else 'RUN EXCLUDED' end as headline,
       case when usable then '12 / 40 usable · ' || cast(cast(floor(coverage*100+0.5) as bigint) as varchar) || '% capture'
       else regexp_replace(regexp_replace(quality_reason, '^excluded:\\s*', '', 'i'), '^legacy:\\s*', '', 'i') end as detail from fx_sessions""",
)
def _(spark, d):
    s = V.sessions(spark, d)
    return s.select("session_id", *S.receipt(C("usable"), F.lit(12), F.lit(40), C("coverage"), C("quality_reason")))


@query("f20_iso_to_ms", "select event_id, epoch_us(ts)//1000 as ms from events")
def _(spark, d):
    e = V.read(spark, d, "events")
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
    return e.select("event_id", S.iso_to_ms(text).alias("ms"))


@query(
    "f21_duration_text",
    """select session_id, case when a > 0 then cast(s//60 as varchar) || 'm ' || lpad(cast(s%60 as varchar), 2, '0') || 's active'
         when live then 'Live now' else cast(w//60 as varchar) || 'm ' || lpad(cast(w%60 as varchar), 2, '0') || 's' end as shown
       from (select session_id, case when session_id % 3 = 0 then active_duration_ms else 0 end as a, session_id % 3 = 1 as live,
             cast(floor(active_duration_ms/1000.0+0.5) as bigint) as s,
             cast(floor((ended_ms-started_ms)/1000.0+0.5) as bigint) as w from fx_facts)""",
)
def _(spark, d):
    s = V.session_facts(spark, d)
    a = F.when(C("session_id") % 3 == 0, C("active_duration_ms")).otherwise(0)
    end = F.when(C("session_id") % 3 != 1, C("ended_ms"))
    return s.select("session_id", S.duration_text(a, C("started_ms"), end).alias("shown"))


@query(
    "f22_feature_names",
    """select n, name from (select row_number() over (order by s, f) as n, stat || '_' || event_type as name from
       (values (0,'mean'),(1,'std'),(2,'min'),(3,'max'),(4,'delta')) a(s, stat),
       (select event_type, row_number() over (order by event_type) as f from (select distinct event_type from events)))""",
)
def _(spark, d):
    kinds = V.read(spark, d, "events").select("event_type").distinct()
    stats = ["mean", "std", "min", "max", "delta"]
    both = J.expand_grid(kinds, stat=stats)
    rank = F.array_position(F.array(*[F.lit(x) for x in stats]), C("stat"))
    ordered = both.groupBy(rank.alias("s")).agg(F.sort_array(F.collect_set("event_type")).alias("k"), F.first("stat").alias("stat"))
    return ordered.select("s", "stat", F.size("k").alias("w"), F.posexplode("k").alias("f", "event_type")).select(
        ((C("s") - 1) * C("w") + C("f") + 1).cast("long").alias("n"), F.concat_ws("_", "stat", "event_type").alias("name")
    )


@query(
    "f23_field_or",
    "select event_id, cast(coalesce(cast(props->>'$.k' as bigint), 0) as bigint) as k, cast(coalesce(cast(props->>'$.missing' as double), 0.5) as double) as m from events",
)
def _(spark, d):
    return V.read(spark, d, "events").select(
        "event_id", S.field_or(C("props"), "$.k", "bigint", 0).alias("k"), S.field_or(C("props"), "$.missing", "double", 0.5).alias("m")
    )


@query(
    "ud03_sql_functions",
    f"""select session_id, event_id, round(ttf, 6) as ttf, {CLASS_SQL.replace('<= 2 ', '<= 10 ').replace('<= 4 ', '<= 20 ').replace('<= 6 ', '<= 30 ').replace('<= 9 ', '<= 45 ').replace('<= 12 ', '<= 60 ')} as class,
        case when ttf <= 5 then 1 else 0 end as within5 from fx_labelled""",
)
def _(spark, d):
    S.register_sql_functions(spark)
    return (
        V.labelled(spark, d)
        .selectExpr("session_id", "event_id", "ft_ttf(active_duration_ms, active_ms) as t")
        .selectExpr("session_id", "event_id", "round(t, 6) as ttf", "ft_class(t) as class", "ft_within(t, 5) as within5")
    )


# --- quality rules and predicates --------------------------------------------
@query(
    "pf01_session_view",
    """select session_id as id, started_ms as "startedMs", usable as "usableForTraining", valid_frame_count as "validFrameCount",
       round(coverage, 6) as "captureCoverage", session_id % 2 = 0 as "hasRecording" from fx_sessions""",
)
def _(spark, d):
    from foretide.sources import store

    s = V.sessions(spark, d).withColumn(
        "recording_path", F.when(C("session_id") % 2 == 0, F.concat(F.lit("rec/"), C("session_id"))).otherwise("")
    )
    return store.session_view(s).select(
        "id", "startedMs", "usableForTraining", "validFrameCount", R(C("captureCoverage")).alias("captureCoverage"), "hasRecording"
    )


@query(
    "pf02_prediction_view",
    "select session_id, event_id, case when event_id % 13 = 0 then 0 else 7 end as horizons, case when event_id % 13 = 0 then null else round(m4, 9) end as p30 from fx_predictions",
)
def _(spark, d):
    from foretide.sources import store

    p = V.predictions(spark, d)
    doc = F.when(C("event_id") % 13 != 0, store.probability_json(C("m"), digits=12))
    v = store.prediction_view(p.withColumn("failure_probabilities", doc))
    return v.select(
        *KEY, F.size("failure_probabilities").alias("horizons"), R(C("failure_probabilities")["30"], 9).alias("p30")
    )


@query(
    "pf03_validate",
    """select session_id, event_id, case when not (active_ms - 3 >= 0) then 'active_elapsed' when not (motion between 0 and 255) then 'motion' end as reject_reason
       from fx_obs""",
)
def _(spark, d):
    o = V.obs(spark, d).withColumn("active_ms", C("active_ms") - 3)
    return Q.validate(o, Q.frame_rules()).select(*KEY, "reject_reason")


@query(
    "pf04_supported_url",
    r"""select page_id, coalesce(regexp_matches(url, '^https://([a-z0-9.-]+\.)?example\.(com|net|org)(/|$|\?|#)') and regexp_extract(url, '^https://([^/:?#]+)', 1) in ('m.ththth.example.net', 'therin.example.net', 'thther.example.org'), false) as ok from pages""",
)
def _(spark, d):
    hosts = ["m.ththth.example.net", "therin.example.net", "thther.example.org"]
    return V.read(spark, d, "pages").select("page_id", S.supported_url(C("url"), "https", hosts, None).alias("ok"))


@query(
    "pf05_drop_paused",
    """select session_id, event_id from (
        select o.session_id, o.event_id, (select last(l.state order by l.ts_ms, l.event_id) from fx_lifecycle l
          where l.session_id=o.session_id and l.active_ms <= o.active_ms) as state from fx_obs o)
       where coalesce(state, 'active') <> 'paused'""",
)
def _(spark, d):
    return J.drop_paused(V.obs(spark, d), V.lifecycle(spark, d), V.OBS_LINE).select(*KEY)


@query(
    "pf06_run_quality",
    "select session_id, active_duration_ms, valid_frame_count, expected_frame_count, round(coverage, 6) as coverage, quality_reason, usable from fx_sessions",
)
def _(spark, d):
    return V.sessions(spark, d).select(
        "session_id", "active_duration_ms", "valid_frame_count", "expected_frame_count", R(C("coverage")).alias("coverage"), "quality_reason", "usable"
    )


@query("pf07_cohort_runs", "select session_id from fx_cohort")
def _(spark, d):
    return Q.cohort_runs(V.sessions(spark, d)).select("session_id")


LEGACY_SQL = """
with o as (select *, row_number() over (partition by session_id order by ts_ms, event_id) as rn,
                  count(*) over (partition by session_id) as n from fx_obs),
g as (select *, active_ms - lag(active_ms) over (partition by session_id order by rn) as gap,
      sum(case when motion <= 20 then 1 else 0 end) over (partition by session_id order by rn rows between 3 preceding and current row) as low from o),
v as (select session_id, max(n) as n, max(active_ms)-min(active_ms) as span, max(gap) as gap,
      count(case when low >= 4 and rn <= n - 12 then 1 end) as hits from g group by session_id),
fx_verdict as (select session_id, case when n < 32 then 'legacy: insufficient frames' when span < 8000 then 'legacy: fewer than eight seconds'
  when gap > 1500 then 'legacy: capture gap' when hits > 0 then 'legacy: possible pause' else 'usable legacy run' end as reason from v)"""


def legacy(spark, d):
    return Q.legacy_quality(V.obs(spark, d), V.OBS_LINE, max_gap_ms=1500, low_motion=20.0, streak=4)


@query("pf08_legacy_quality", LEGACY_SQL + " select session_id, reason, reason = 'usable legacy run' as usable from fx_verdict")
def _(spark, d):
    return legacy(spark, d).select("session_id", "reason", "usable")


@query(
    "pf09_backfill_legacy",
    LEGACY_SQL
    + """ select f.session_id, case when c.session_id is not null then v.span else f.active_duration_ms end as active_duration_ms,
         case when c.session_id is not null then w.reason = 'usable legacy run' else false end as usable,
         case when c.session_id is not null then w.reason else null end as quality_reason,
         c.idx as collection_index from fx_facts f left join v using (session_id) left join fx_verdict w using (session_id)
         left join (select session_id, row_number() over (order by started_ms, session_id) as idx from fx_facts
           where session_id % 4 = 0 and end_reason = 'game_over') c on c.session_id = f.session_id""",
)
def _(spark, d):
    s = (
        V.session_facts(spark, d)
        .withColumn("active_duration_ms", F.when((C("session_id") % 4 == 0) & (C("end_reason") == "game_over"), F.lit(0)).otherwise(C("active_duration_ms")))
        .withColumn("usable", F.lit(False)).withColumn("quality_reason", F.lit(None).cast("string"))
        .withColumn("collection_index", F.lit(None).cast("long"))
    )
    v = legacy(spark, d)
    return Q.backfill_legacy(s, v, v, RUNS_LINE).select(
        "session_id", "active_duration_ms", "usable", "quality_reason", "collection_index"
    )


@query(
    "pf10_exclude_legacy",
    """select session_id, usable and model_version <> 'legacy-v2' as usable,
       case when usable and model_version = 'legacy-v2' then 'legacy: excluded from official v3 cohort' else quality_reason end as quality_reason from fx_sessions""",
)
def _(spark, d):
    return Q.exclude_legacy(V.sessions(spark, d)).select("session_id", "usable", "quality_reason")


@query(
    "pf11_is_legacy",
    """select session_id, usable and model_version = 'legacy-v2' as legacy from fx_sessions""",
)
def _(spark, d):
    return Q.exclude_legacy(V.sessions(spark, d)).select("session_id", S.is_legacy(C("quality_reason")).alias("legacy"))


@query(
    "pf12_phase",
    """select idx, case when idx < 30 then 'development' when idx < 40 then 'locked_test' else 'evaluation' end as phase from
       (select row_number() over (order by started_ms, session_id) as idx from fx_cohort)""",
)
def _(spark, d):
    return row_numbers(V.cohort(spark, d), RUNS_LINE, "idx").select("idx", Q.phase(C("idx")).alias("phase"))


def cohort_runs(spark, d):
    """Cohort runs numbered by start; the cohort's rules come before any cap."""
    return row_numbers(V.cohort(spark, d), RUNS_LINE, "run")


def runs40(spark, d):
    """The first forty cohort runs, as the fixed study."""
    return W.run_order(V.cohort(spark, d)).withColumn("run", C("run_order").cast("long"))


V.register_ctes(
    {
        "fx_runs": "select *, row_number() over (order by started_ms, session_id) as run from fx_cohort",
        "fx_runs40": "select *, run as run_order from fx_runs where run <= 40",
    }
)


@query(
    "pf13_cohort_violations",
    """select count(case when run between 1 and 30 then 1 end) as runs_inside, count(case when run not between 1 and 30 then 1 end) as runs_outside,
       count(case when lo <> hi then 1 end) as mixed_runs, cast(sum(back) as bigint) as backward_anchors from (
         select run, min(session_id) as lo, max(session_id) as hi, sum(case when active_ms <= prev then 1 else 0 end) as back from (
           select case when r.run % 17 = 0 then 3 else r.run end as run, o.session_id, o.active_ms, lag(o.active_ms) over (partition by session_id order by ts_ms, event_id) as prev
           from fx_obs o join fx_runs r using (session_id)) group by run)""",
)
def _(spark, d):
    # Every seventeenth run claims to be run 3, and the cohort goes beyond run 30.
    runs = cohort_runs(spark, d).select("session_id", F.when(C("run") % 17 == 0, 3).otherwise(C("run")).alias("run"))
    return Q.cohort_violations(V.obs(spark, d).join(runs, "session_id"), V.OBS_LINE, 1, 30)


@query(
    "pf14_count_nonfinite",
    "select count(case when not isfinite(z) then 1 end) as z, count(case when event_id % 60 = 0 then 1 end) as m from (select event_id, case when event_id % 50 = 0 then 'nan'::double when event_id % 70 = 0 then 'inf'::double else m0 end as z from fx_predictions)",
)
def _(spark, d):
    z = F.when(C("event_id") % 50 == 0, float("nan")).when(C("event_id") % 70 == 0, float("inf")).otherwise(F.element_at("m", 1))
    m = F.when(C("event_id") % 60 == 0, F.concat(F.slice("m", 1, 6), F.array(F.lit(float("-inf"))))).otherwise(C("m"))
    return Q.count_nonfinite(V.predictions(spark, d).select(z.alias("z"), m.alias("m")), ["z", "m"])


@query(
    "pf15_select_features",
    "select vec_id, round(embedding[9]::double, 6) as a, round(embedding[17]::double, 6) as b, 56 as tail from embeddings",
)
def _(spark, d):
    e = V.read(spark, d, "embeddings")
    x = Q.select_features(C("embedding"), [8, 16])
    rest = Q.select_features(C("embedding"), [i for i in range(64) if i >= 8])
    return e.select("vec_id", R(x[0]).alias("a"), R(x[1]).alias("b"), F.size(rest).alias("tail"))


@query(
    "pf16_admissible_models",
    """select vec_id from embeddings where vec_id % 2 = 0 and vec_id % 3 <> 0 and label <> 3 and vec_id % 5 <> 0""",
)
def _(spark, d):
    e = V.read(spark, d, "embeddings").select(
        "vec_id",
        (C("vec_id") % 2 == 0).alias("eligible_for_live"),
        F.when(C("vec_id") % 3 != 0, F.array(*[F.lit(h) for h in HORIZONS])).otherwise(F.array(F.lit(5))).alias("horizons"),
        F.when(C("label") != 3, "stack-v2").otherwise("stack-v1").alias("feature_schema"),
        F.size("embedding").alias("feature_count"),
        F.when(C("vec_id") % 5 != 0, "sklearn_personal_survival").otherwise("unknown").alias("kind"),
    )
    from foretide.settings import KNOWN_KINDS

    return Q.admissible_models(e, HORIZONS, "stack-v2", 64, KNOWN_KINDS).select("vec_id")


@query(
    "pf17_compatibility",
    """select field, same from (values ('docs', true), ('langs', true), ('longest', false)) t(field, same)
       where (select count(*) from documents) > 0""",
)
def _(spark, d):
    docs = V.read(spark, d, "documents")
    a = docs.agg(F.count("*").alias("docs"), F.count_distinct("lang").alias("langs"), F.max("n_chars").alias("longest"))
    b = a.withColumn("longest", C("longest") + 1)
    return Q.compatibility(a, b, ["docs", "langs", "longest"])


@query("pf18_subset_runs", "select session_id, run from fx_runs40 where run <= 30 and run not in (5, 14, 17)")
def _(spark, d):
    return Q.subset_runs(runs40(spark, d), [5, 14, 17]).select("session_id", "run")


@query(
    "pf19_by_id",
    "select session_id, active_duration_ms from fx_facts where session_id = (select min(user_id) from events)",
)
def _(spark, d):
    from foretide.sources import store

    lowest = V.read(spark, d, "events").agg(F.min("user_id").alias("session_id"))
    return store.by_ids(V.session_facts(spark, d), lowest).select("session_id", "active_duration_ms")


# --- session aggregates -------------------------------------------------------
@query("a01_usable_count", "select count(*) as usable_runs from fx_sessions where usable and model_version = 'collection-v3'")
def _(spark, d):
    return A.usable_count(V.sessions(spark, d))


RATES = ", ".join(f"round(avg(y{i}), 6) as rate_{h}" for i, h in enumerate(V.FX_HORIZONS))


@query(
    "a02_dataset_summary",
    f"""select count(distinct session_id) as sessions, count(*) as windows, least(count(distinct session_id), 30) as development_runs,
        greatest(0, least(10, count(distinct session_id) - 30)) as locked_runs, {RATES} from fx_labelled""",
)
def _(spark, d):
    s = A.dataset_summary(V.labelled(spark, d), V.FX_HORIZONS)
    return s.select(*s.columns[:4], *[R(C(c)).alias(c) for c in s.columns[4:]])


COLLECTOR_SQL = """select count(*) as total_sessions, count(case when complete then 1 end) as complete_sessions, count(case when not complete then 1 end) as active_sessions,
       count(case when complete and automated then 1 end) as automated_sessions, count(case when complete and not automated then 1 end) as manual_sessions,
       cast(sum(case when complete then n else 0 end) as bigint) as total_frames, cast(sum(case when complete then span else 0 end) as bigint) as total_duration_ms
       from (select session_id, session_id % 3 <> 0 as complete, session_id % 2 = 0 as automated, count(*) as n, max(ts_ms)-min(ts_ms) as span from fx_obs group by session_id)"""


@query("a03_collector_summary", COLLECTOR_SQL)
def _(spark, d):
    s = V.session_facts(spark, d).select("session_id", (C("session_id") % 3 != 0).alias("complete"), (C("session_id") % 2 == 0).alias("automated"))
    return A.collector_summary(s, V.obs(spark, d))


@query("a04_reason_counts", "select quality_reason, count(*) as n from fx_sessions where model_version='collection-v3' and not usable group by 1")
def _(spark, d):
    return A.reason_counts(V.sessions(spark, d).where((C("model_version") == COHORT) & ~C("usable")))


STATUS_SQL = """select count(case when u then 1 end) as usable_runs, greatest(0, 40 - count(case when u then 1 end)) as remaining_runs,
       least(count(case when u then 1 end), 30) as development_runs, least(greatest(0, count(case when u then 1 end) - 30), 10) as locked_runs,
       count(case when model_version='collection-v3' and not u then 1 end) as excluded_runs, count(case when usable and model_version='legacy-v2' then 1 end) as legacy_runs,
       case when count(case when u then 1 end) < 30 then 'development' when count(case when u then 1 end) < 40 then 'locked_test' else 'evaluation' end as phase
       from (select *, usable and model_version='collection-v3' as u from fx_sessions)"""


def status_runs(spark, d):
    return Q.status_usable(Q.exclude_legacy(V.sessions(spark, d)), legacy(spark, d))


@query("a05_collection_status", STATUS_SQL)
def _(spark, d):
    return A.collection_status(status_runs(spark, d))


@query(
    "a06_status_report",
    """select section, count(*) as documents, max(job) as job, max(models) as models from (select 'collection' as section, null as job, null as models union all select 'dataset', null, null union all select 'collector', null, null
       union all select 'reason', null, null from (select distinct quality_reason from fx_sessions where model_version='collection-v3' and not usable)
       union all select 'evaluation', null, 'm' || label from (select distinct label from embeddings)
       union all (select 'job', session_id, null from fx_facts order by ended_ms desc, session_id desc limit 1)) group by section""",
)
def _(spark, d):
    from foretide.plans.stores import evaluations

    runs = status_runs(spark, d)
    s = V.session_facts(spark, d).select("session_id", (C("session_id") % 3 != 0).alias("complete"), (C("session_id") % 2 == 0).alias("automated"))
    doc = A.status_report(
        A.collection_status(runs),
        A.reason_counts(runs.where(C("official") & ~C("usable")), "reason"),
        A.dataset_summary(V.labelled(spark, d), V.FX_HORIZONS),
        A.collector_summary(s, V.obs(spark, d)),
        evaluations(spark, d),
        V.session_facts(spark, d).select(
            C("session_id").alias("job_id"), (C("session_id") % 4).alias("milestone"), C("end_reason").alias("state"), C("ended_ms").alias("updated_ms")
        ),
    )
    field = lambda name: F.max(F.get_json_object("document", f"$.{name}"))
    return doc.where(C("document").startswith("{")).groupBy("section").agg(
        F.count("*").alias("documents"), field("job_id").cast("long").alias("job"), field("model").alias("models")
    )


@query(
    "a11_run_durations",
    "select session_id, round(max(active_ms/1000.0 + ttf), 6) as duration_max, round(median(active_ms/1000.0 + ttf*(1+event_id%3)), 6) as duration_median from fx_labelled group by session_id",
)
def _(spark, d):
    w = V.labelled(spark, d).withColumn("elapsed", C("active_ms") / 1000.0)
    longest = A.run_durations(w).select("session_id", R(C("duration_max")).alias("duration_max"))
    varied = A.run_durations(w.withColumn("ttf", C("ttf") * (1 + C("event_id") % 3)))
    return longest.join(varied.select("session_id", R(C("duration_median")).alias("duration_median")), "session_id")


@query("a12_constant_rate", "select h, round(avg(y), 6) as rate from fx_long group by h")
def _(spark, d):
    return A.constant_rate(V.long_predictions(V.labelled(spark, d))).select("h", R(C("rate")).alias("rate"))


@query(
    "a17_latency_p95",
    """select session_id, round(quantile_cont(motion, 0.95), 6) as p95, round(max(case when rn = k then motion end), 6) as p95_element from (
         select session_id, motion, row_number() over (partition by session_id order by motion) - 1 as rn,
                least(count(*) over (partition by session_id) - 1, cast(floor(count(*) over (partition by session_id) * 0.95) as bigint)) as k from fx_obs)
       group by session_id""",
)
def _(spark, d):
    return A.latency_p95(V.obs(spark, d), "motion", ["session_id"]).select("session_id", R(C("p95")).alias("p95"), R(C("p95_element")).alias("p95_element"))


@query(
    "a17_latency_p95_overall",
    """select round(quantile_cont(motion, 0.95), 6) as p95, round(max(case when rn = k then motion end), 6) as p95_element from (
         select motion, row_number() over (order by motion) - 1 as rn, least(count(*) over () - 1, cast(floor(count(*) over () * 0.95) as bigint)) as k from fx_obs)""",
)
def _(spark, d):
    return A.latency_p95(V.obs(spark, d), "motion").select(R(C("p95")).alias("p95"), R(C("p95_element")).alias("p95_element"))


# --- sorting, top-k, sets -------------------------------------------------------
@query(
    "s01_newest_first",
    "select session_id, row_number() over (order by started_ms desc, session_id desc) as position from fx_facts",
)
def _(spark, d):
    from foretide.operators.timeline import row_numbers

    # The listing itself is orderBy; its positions come from the sliced numbering.
    newest = Timeline((), ("_neg", "_negid"), "_neg", V.HOUR_MS)
    s = V.session_facts(spark, d).withColumn("_neg", -C("started_ms")).withColumn("_negid", -C("session_id"))
    return row_numbers(s, newest, "position").select("session_id", "position")


@query("s02_first_usable", "select session_id, started_ms from fx_cohort order by started_ms, session_id limit 20")
def _(spark, d):
    return V.cohort(spark, d).select("session_id", "started_ms").orderBy("started_ms", "session_id").limit(20)


@query(
    "s03_recent",
    "select session_id from (select session_id, case when session_id % 7 = 0 then null else started_ms end as s from fx_facts) order by s desc nulls last, session_id desc limit 8",
)
def _(spark, d):
    s = V.session_facts(spark, d).withColumn("s", F.when(C("session_id") % 7 != 0, C("started_ms")))
    return W.recent(s, "s", 8, "session_id").select("session_id")


@query("w21_recent_runs", "select session_id, started_ms from fx_facts order by started_ms desc, session_id desc limit 8")
def _(spark, d):
    return W.recent(V.session_facts(spark, d), "started_ms", 8, "session_id").select("session_id", "started_ms")


@query("u02_ordered_distinct", "select session_id, min(event_id) as first_seen from fx_obs group by session_id")
def _(spark, d):
    return V.obs(spark, d).groupBy("session_id").agg(F.min("event_id").alias("first_seen"))


@query(
    "u03_set_difference",
    """select side, count(*) as n from (select 'left' as side from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)
       union all select 'right' from labels l where not exists (select 1 from documents d where l.doc_id = d.doc_id)) group by side""",
)
def _(spark, d):
    a = V.read(spark, d, "documents").select(C("doc_id").cast("long").alias("doc_id"))
    b = V.read(spark, d, "labels").select(C("doc_id").cast("long").alias("doc_id"))
    return J.anchor_differences(a, b, ["doc_id"]).groupBy("side").agg(F.count("*").alias("n"))


@query(
    "u05_event_coverage",
    """select session_id, string_agg(event_type, ',' order by event_type) as kinds, count(*) = 5 as complete from (select distinct session_id, event_type from fx_obs) group by session_id""",
)
def _(spark, d):
    kinds = V.obs(spark, d).select("session_id", "event_type").distinct()
    want = F.array(*[F.lit(k) for k in ("click", "error", "purchase", "signup", "view")])
    return kinds.groupBy("session_id").agg(F.array_sort(F.collect_set("event_type")).alias("k")).select(
        "session_id", F.array_join("k", ",").alias("kinds"), (F.size(F.array_except(want, C("k"))) == 0).alias("complete")
    )


