"""Registered queries: references, fits, evaluation, gates and audits."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from foretide.functions import scalars as S
from foretide.operators import aggregates as A
from foretide.operators import evaluation as E
from foretide.operators import models as M
from foretide.operators import timejoin as J
from foretide.operators.timeline import SLICE, Timeline
from foretide.plans import views as V
from foretide.plans.registry import query
from foretide.plans.sessions import KEY, R, cohort_runs, runs40
from foretide.plans.timelines import marks, windows
from foretide.settings import FOLDS, fresh_path, materialise

C = F.col
FX = V.FX_HORIZONS
CAP = float(FX[-1])


def long_rows(spark, d):
    return V.long_predictions(V.labelled(spark, d), *KEY)


# Alternative forecasts of the same windows: constant rate, average duration, elapsed share.
V.register_ctes(
    {
        "fx_dev": """select l.*, cast(r.run as bigint) as run, l.active_ms/1000.0 as elapsed, row_number() over (partition by l.session_id order by l.ts_ms, l.event_id) as row_id
            from fx_labelled l join fx_runs r using (session_id)""",
        "fx_train": "select * from fx_dev where run <= 24",
        "fx_test": "select * from fx_dev where run > 24",
        "fx_const": "select " + ", ".join(f"avg(y{i}) as c{i}" for i in range(7)) + " from fx_train",
        "fx_avgdur": "select avg(d) as avg_s from (select max(elapsed + ttf) as d from fx_train group by run)",
    }
)
V.register_ctes(
    {
        "fx_refs": "select run, session_id, event_id, ttf, 'average_duration' as name, "
        + ", ".join(f"1.0/(1.0+exp(greatest(-50.0, least(50.0, (avg_s - elapsed - {h})/5.0)))) as p{i}" for i, h in enumerate(FX))
        + ", " + ", ".join(f"y{i}" for i in range(7))
        + " from fx_test, fx_avgdur union all select run, session_id, event_id, ttf, 'constant_rate', "
        + ", ".join(f"greatest({', '.join(f'c{j}' for j in range(i + 1))})" if i else "c0" for i in range(7))
        + ", " + ", ".join(f"y{i}" for i in range(7)) + " from fx_test, fx_const",
        "fx_refbrier": "\nunion all\n".join(f"select name, {i} as h, avg(pow(p{i} - y{i}, 2)) as brier from fx_refs group by name" for i in range(7)),
        "fx_modelbrier": "\nunion all\n".join(f"select {i} as h, avg(pow(m{i} - y{i}, 2)) as brier from fx_test" for i in range(7)),
    }
)


def development(spark, d):
    runs = cohort_runs(spark, d).select("session_id", "run")
    return V.labelled(spark, d).join(runs, "session_id").withColumn("elapsed", C("active_ms") / 1000.0)


def parts(spark, d):
    dev = development(spark, d)
    return dev.where("run <= 24"), dev.where("run > 24")


def references(spark, d):
    train, test = parts(spark, d)
    cols = ["run", *KEY, "ttf", "y"]
    a = M.average_reference(train, test, FX).select(*cols, F.lit("average_duration").alias("name"), "p")
    return a.unionByName(M.constant_reference(train, test, 7).select(*cols, F.lit("constant_rate").alias("name"), "p"))


def long_of(df, p, *keep):
    return V.long_predictions(df.select(*keep, C(p).alias("m"), "y"), *keep)


# --- splits and references ------------------------------------------------------
@query(
    "m01_run_split",
    """select cast(run as bigint) as run, case when n >= 30 then case when run <= 24 then 'fit' when run <= 30 then case when n = 30 then 'validation' else 'calibration' end when run <= 40 then 'test' end
         else case when run <= floor(n*0.7) then 'fit' when run <= least(greatest(floor(n*0.7)+1, floor(n*0.85)), n-1) then 'calibration' else 'test' end end as part, count(*) as n
       from (select r.run, max(r.run) over () as n from fx_obs join fx_runs40 r using (session_id)) group by 1, 2""",
)
def _(spark, d):
    w = V.obs(spark, d).join(runs40(spark, d).select("session_id", "run"), "session_id")
    return M.run_split(w).groupBy("run", "part").agg(F.count("*").alias("n"))


@query(
    "m02_fold_assign",
    """select f.fold, case when run <= a then 'fit' when run <= b then 'calibration' else 'evaluation' end as role, count(*) as n, count(distinct run) as runs
       from fx_obs join fx_runs40 using (session_id), (values (1,9,15,20),(2,14,20,25),(3,19,25,30)) f(fold,a,b,c) where run <= c group by all""",
)
def _(spark, d):
    w = V.obs(spark, d).join(runs40(spark, d).select("session_id", "run"), "session_id")
    per = M.fold_assign(w).groupBy("fold", "role", "run").agg(F.count("*").alias("_n"))
    return per.groupBy("fold", "role").agg(F.sum("_n").alias("n"), F.count("*").alias("runs"))


@query("m05_constant_model", "select h, case when min(y) = max(y) then round(avg(y), 6) end as constant from fx_long where ttf < 1.5 group by h")
def _(spark, d):
    near = V.long_predictions(V.labelled(spark, d).where("ttf < 1.5"))
    return near.groupBy("h").agg(F.when(F.min("y") == F.max("y"), R(F.avg("y"))).alias("constant"))


@query(
    "m06_linear_score",
    "select vec_id, round(" + " + ".join(f"embedding[{i + 1}]::double * {(i % 5 - 2) / 4.0}" for i in range(64)) + " + 0.25, 6) as z from embeddings",
)
def _(spark, d):
    e = V.read(spark, d, "embeddings")
    x = F.transform("embedding", lambda v: v.cast("double"))
    return e.select("vec_id", R(M.linear_score(x, [(i % 5 - 2) / 4.0 for i in range(64)], 0.25)).alias("z"))


DRAW_SQL = "((((({x}) % 2147483647 * 48271 + 11) % 2147483647 * 48271 + 11) % 2147483647 * 48271 + 11) % 2147483647) % {n}"


@query(
    "m08_bootstrap_runs",
    "with n as (select count(*) as n from fx_runs40 where run <= 24) select cast(r.run as bigint) as run, count(*) as multiplicity from fx_runs40 r join (select "
    + DRAW_SQL.format(x="(run - 1)*7919 + 41*104729 + 1", n="n")
    + " as pos from fx_runs40, n where run <= 24) b on b.pos = r.run - 1 where r.run <= 24 group by 1",
)
def _(spark, d):
    runs = runs40(spark, d).where("run <= 24").select("run", (C("run") - 1).alias("pos"))
    return E.bootstrap_multiplicity(runs, 41)


@query(
    "m10_average_duration_reference",
    "select session_id, event_id, " + ", ".join(f"round(p{i}, 6) as p{i}" for i in range(7)) + " from fx_refs where name = 'average_duration'",
)
def _(spark, d):
    return references(spark, d).where("name = 'average_duration'").select(*KEY, *[R(F.element_at("p", i + 1)).alias(f"p{i}") for i in range(7)])


@query(
    "m10_constant_reference",
    "select session_id, event_id, " + ", ".join(f"round(p{i}, 6) as p{i}" for i in range(7)) + " from fx_refs where name = 'constant_rate'",
)
def _(spark, d):
    return references(spark, d).where("name = 'constant_rate'").select(*KEY, *[R(F.element_at("p", i + 1)).alias(f"p{i}") for i in range(7)])


EMP = [f"(count(case when d > elapsed and d <= elapsed + {h} then 1 end) + 0.5)/(count(case when d > elapsed then 1 end) + 1.0)" for h in FX]


@query(
    "f10_empirical_duration",
    "select session_id, event_id, " + ", ".join(f"round({e}, 6) as p{i}" for i, e in enumerate(EMP))
    + " from (select session_id, event_id, elapsed from fx_dev where run > 24), (select median(elapsed + ttf) as d from fx_train group by run) group by session_id, event_id",
)
def _(spark, d):
    train, test = parts(spark, d)
    e = M.empirical_reference(train, test, FX)
    return e.select(*KEY, *[R(F.element_at("p", i + 1)).alias(f"p{i}") for i in range(7)])


@query("m11_controls", "select model, count(*) as n, sum(p) as total from (select 'always' as model, 1.0 as p from fx_test union all select 'never', 0.0 from fx_test) group by model")
def _(spark, d):
    _, test = parts(spark, d)
    return M.controls(test.select(*KEY)).groupBy("model").agg(F.count("*").alias("n"), F.sum(F.element_at("p", 1)).alias("total"))


@query("u01_union_predictions", "select name, count(*) as n, round(avg(p6), 6) as mean_p from (select name, p6 from fx_refs union all select 'model', m6 from fx_test) group by name")
def _(spark, d):
    _, test = parts(spark, d)
    both = references(spark, d).select("name", "p").unionByName(test.select(F.lit("model").alias("name"), C("m").alias("p")))
    return both.groupBy("name").agg(F.count("*").alias("n"), R(F.avg(F.element_at("p", 7))).alias("mean_p"))


# --- evaluation ------------------------------------------------------------------
@query("e01_brier", "select h, round(avg(pow(p - y, 2)), 6) as brier from fx_long group by h")
def _(spark, d):
    return E.brier(long_rows(spark, d)).select("h", R(C("brier")).alias("brier"))


@query(
    "e02_auroc",
    """select h, round(case when pos * neg > 0 then (ranks - pos*(pos+1)/2.0)/(pos*neg) else 0.5 end, 6) as auroc from (
        select h, sum(case when y=1 then r else 0 end) as ranks, sum(y)*1.0 as pos, count(*) - sum(y)*1.0 as neg from (
          select h, y, rank() over (partition by h order by p) + (count(*) over (partition by h, p) - 1)/2.0 as r from fx_long) group by h)""",
)
def _(spark, d):
    return E.auroc(long_rows(spark, d)).select("h", R(C("auroc")).alias("auroc"))


BIN = "case " + " ".join(f"when p >= {k * 0.1!r}::double then {k}" for k in range(9, 0, -1)) + " else 0 end"


@query(
    "e03_ece",
    f"select h, round(sum(abs(sy - sp))/sum(n), 6) as ece from (select h, {BIN} as b, sum(y) as sy, sum(p) as sp, count(*) as n from fx_long group by all) group by h",
)
def _(spark, d):
    return E.ece(long_rows(spark, d)).select("h", R(C("ece")).alias("ece"))


@query(
    "e04_weighted_ece",
    f"""with runs as (select session_id, h, count(*) as n from fx_long group by all), k as (select h, count(*) as runs from runs group by h)
        select b.h, round(sum(abs(dd))/max(k.runs), 6) as weighted_ece from (select l.h, {BIN} as b, sum((y - p)/r.n) as dd from fx_long l join runs r on r.session_id = l.session_id and r.h = l.h group by all) b
        join k on k.h = b.h group by b.h""",
)
def _(spark, d):
    return E.weighted_ece(long_rows(spark, d), "session_id").select("h", R(C("weighted_ece")).alias("weighted_ece"))


@query(
    "e05_strongest_baseline",
    """select m.h, round(m.brier, 6) as brier, b.name as strongest, round(b.brier, 6) as strongest_brier, round(coalesce((b.brier - m.brier)/nullif(b.brier, 0), 0.0), 6) as improvement
       from fx_modelbrier m join (select h, name, brier, row_number() over (partition by h order by brier, name) as k from fx_refbrier) b on b.h = m.h and b.k = 1""",
)
def _(spark, d):
    _, test = parts(spark, d)
    model = E.brier(long_of(test, "m"))
    refs = E.brier(long_of(references(spark, d), "p", "name"), ["name", "h"])
    s = E.strongest_baseline(model, refs)
    return s.select("h", "strongest", *[R(C(c)).alias(c) for c in ("brier", "strongest_brier", "improvement")])


MAE_SQL = "round(coalesce(avg(case when ttf <= {lim} then abs(remaining - least(ttf, 12.0)) end), 12.0), 6) as {name}"


@query(
    "e06_time_mae",
    "select session_id, " + ", ".join(MAE_SQL.format(lim=l, name=n) for l, n in ((12, "mae"), (2, "final_near_mae"), (6, "final_mid_mae"))) + " from fx_labelled group by 1",
)
def _(spark, d):
    t = E.time_mae(V.labelled(spark, d), CAP, 2.0, 6.0, ["session_id"])
    return t.select("session_id", *[R(C(c)).alias(c) for c in ("mae", "final_near_mae", "final_mid_mae")])


@query(
    "e07_warning_metrics",
    """select round(avg(case when pc = ac then 1.0 else 0.0 end), 6) as window_accuracy, (select round(avg(case when lead >= 3 then 1.0 else 0.0 end), 6) from l) as useful_rate,
       (select round(median(lead), 6) from l) as median_lead, (select cast(sum(fe) as bigint) from l) as false_early from (
         select case when ttf <= 2 then 0 when ttf <= 4 then 1 when ttf <= 6 then 2 when ttf <= 9 then 3 when ttf <= 12 then 4 else 5 end as ac,
                case when crossing <= 1 then 0 when crossing <= 3 then 1 else crossing - 2 end as pc from fx_labelled)""".replace(
        "select round(avg(case when pc", "with l as (select session_id, coalesce(max(case when crossing < 7 and ttf <= 12 then ttf end), 0.0) as lead, count(case when crossing < 7 and ttf > 12 then 1 end) as fe from fx_labelled group by 1) select round(avg(case when pc", 1
    ),
)
def _(spark, d):
    from foretide.operators import windows as W

    p = V.labelled(spark, d)
    p = p.withColumn("predicted_class", S.predicted_class(C("crossing"))).withColumn("actual_class", S.actual_class(C("ttf"), FX))
    leads = W.warning_leads(p.withColumn("signal", C("predicted_class") < 5), CAP)
    m = E.warning_metrics(p, leads, 3.0)
    return m.select(*[R(C(c)).alias(c) for c in ("window_accuracy", "useful_rate", "median_lead")], "false_early")


def gate_rows(spark, d):
    """One metrics document per run, some with missing figures."""
    s = V.session_facts(spark, d)
    some = lambda x, k: F.when(C("session_id") % k != 0, x)
    v = (C("active_duration_ms") - 14_000) / 1000.0
    return s.select(
        "session_id", F.lit(40).alias("total_runs"), F.lit(10).alias("evaluated_runs"), some(v, 11).alias("brier_vs_elapsed"),
        some(v + 0.05, 13).alias("brier_vs_average"), (v / 2).alias("mae_vs_elapsed"), (v / 3).alias("mae_vs_average"), some(v + 0.2, 7).alias("useful_rate"),
        some(v / 6, 17).alias("worst_ece"), (v * 5).alias("final10_mae"), some(F.lit(4.0), 19).alias("elapsed_final10_mae"), some(v * 500, 5).alias("latency_p95"),
    )


GATES = {
    "locked_test": "true", "brier_elapsed": "coalesce(a, 0) >= 0.1", "brier_average": "coalesce(b, 0) >= 0.1", "time_elapsed": "v/2 >= 0.1",
    "time_average": "v/3 >= 0.1", "useful_warning": "coalesce(u, 0) >= 0.5", "calibration": "coalesce(w, 1) <= 0.12",
    "final_ten": "v*5 <= 1.1*coalesce(e, 60)", "latency": "coalesce(t < 500, false)",
}


@query(
    "e08_promotion_gates",
    "select session_id, " + ", ".join(f"{g} as gate_{n}" for n, g in GATES.items()) + ", " + " and ".join(f"({g})" for g in GATES.values()) + """ as eligible from (
       select session_id, v, case when session_id % 11 <> 0 then v end as a, case when session_id % 13 <> 0 then v + 0.05 end as b, case when session_id % 7 <> 0 then v + 0.2 end as u,
       case when session_id % 17 <> 0 then v/6 end as w, case when session_id % 19 <> 0 then 4.0 end as e, case when session_id % 5 <> 0 then v*500 end as t
       from (select session_id, (active_duration_ms - 14000)/1000.0 as v from fx_facts))""",
)
def _(spark, d):
    g = E.promotion_gates(gate_rows(spark, d))
    return g.select("session_id", *[f"gate_{n}" for n in GATES], "eligible")


SQUARES = "(" + " + ".join(f"pow(m{i} - y{i}, 2)" for i in range(7)) + ")/7"
V.register_ctes(
    {
        "fx_perrun": f"""select run, avg({SQUARES}) as brier, avg(case when ttf <= 12 then abs(remaining - ttf) end) as mae, avg(case when ttf <= 2 then abs(remaining - ttf) end) as final_near_mae,
        coalesce(avg(case when ttf > 12 then case when m6 >= .5 then 1.0 else 0.0 end end), 0.0) as false_warning_fraction, max(case when m6 >= .5 then ttf end) as first_warning_lead from fx_dev group by run"""
    }
)


def per_run(spark, d):
    dev = development(spark, d).withColumn("alarm", F.element_at("m", 7) >= 0.5)
    return E.per_run_metrics(dev, "run", CAP, 2.0)


RUN_METRICS = ("brier", "mae", "final_near_mae", "false_warning_fraction", "first_warning_lead")


@query("e09_per_run_metrics", "select run, " + ", ".join(f"round({c}, 9) as {c}" for c in RUN_METRICS) + " from fx_perrun")
def _(spark, d):
    return per_run(spark, d).select("run", *[R(C(c), 9).alias(c) for c in RUN_METRICS])


@query("a15_macro_mean", "select " + ", ".join(f"round(avg({c}), 6) as {c}" for c in RUN_METRICS[:4]) + " from fx_perrun")
def _(spark, d):
    return A.macro_mean(per_run(spark, d), RUN_METRICS[:4]).select(*[R(C(c)).alias(c) for c in RUN_METRICS[:4]])


V.register_ctes(
    {
        "fx_folds": """select f.fold, 'model_' || c.c as candidate, avg(pow(m6 - y6, 2))*(0.5 + c.c*0.25) as brier, avg(abs(remaining - ttf))*(0.5 + c.c*0.25) as mae from fx_dev,
            (values (1,15,20),(2,20,25),(3,25,30)) f(fold,b,e), range(4) c(c) where run > b and run <= e group by f.fold, c.c""",
        "fx_foldbase": """select f.fold, avg(pow(m6 - y6, 2)) as base_brier, avg(abs(remaining - ttf)) as base_mae from fx_dev, (values (1,15,20),(2,20,25),(3,25,30)) f(fold,b,e) where run > b and run <= e group by all""",
    }
)


def fold_scores(spark, d):
    """Four synthetic rescalings of one model's fold errors, and the unscaled reference."""
    dev = M.fold_assign(development(spark, d).where("run <= 30")).where("role = 'evaluation'")
    base = dev.groupBy("fold").agg(
        F.avg(F.pow(F.element_at("m", 7) - F.element_at("y", 7), 2)).alias("base_brier"), F.avg(F.abs(C("remaining") - C("ttf"))).alias("base_mae")
    )
    cands = J.expand_grid(base, c=[0, 1, 2, 3]).withColumn("candidate", F.concat(F.lit("model_"), C("c").cast("string")))
    k = 0.5 + C("c") * 0.25
    return cands.select("fold", "candidate", (C("base_brier") * k).alias("brier"), (C("base_mae") * k).alias("mae"), F.lit("reference").alias("base_name"), "base_brier", "base_mae")


def screened(spark, d):
    folds = fold_scores(spark, d)
    # Each candidate fails other gates.
    turn = F.regexp_extract("candidate", r"(\d+)", 1).cast("int")
    result = folds.groupBy("candidate").agg(F.avg("brier").alias("brier"), F.avg("mae").alias("mae"), (F.avg("mae") / 2).alias("final10")).select(
        "*", (F.lit(0.09) + turn * 0.02).alias("worst_ece"), (F.lit(0.55) + turn * 0.1).alias("recall"), (turn * 0.09).alias("false_per_minute")
    )
    base = folds.select("fold", "base_brier", "base_mae").distinct().agg(
        F.lit("reference").alias("name"), F.avg("base_brier").alias("brier"), F.avg("base_mae").alias("mae"), (F.avg("base_mae") / 2).alias("final10")
    )
    return E.screen(result, base, folds, V.cohort(spark, d).select("coverage"))


SCREEN_SQL = """select candidate, round(c.brier, 6) as brier, round(c.mae, 6) as mae, c.brier <= .9*b.brier as probability, c.mae <= .9*b.mae as "time", w.won >= 2 as folds, c.mae/2 <= 1.1*b.mae/2 as final_ten,
       k <= 1 as calibration, k >= 1 as timely, k <= 2 as false_alarms, v.coverage >= .95 as coverage, c.brier <= .9*b.brier and c.mae <= .9*b.mae and w.won >= 2 and c.mae/2 <= 1.1*b.mae/2 and k = 1 and v.coverage >= .95 as qualifies
       from (select candidate, cast(right(candidate, 1) as int) as k, avg(brier) as brier, avg(mae) as mae from fx_folds group by 1) c, (select min(coverage) as coverage from fx_cohort) v, (select avg(base_brier) as brier, avg(base_mae) as mae from fx_foldbase) b,
       (select candidate as cw, count(case when f.brier < g.base_brier and f.mae < g.base_mae then 1 end) as won from fx_folds f join fx_foldbase g using (fold) group by 1) w where w.cw = candidate"""


@query("e11_screen", SCREEN_SQL)
def _(spark, d):
    s = screened(spark, d)
    return s.select("candidate", R(C("brier")).alias("brier"), R(C("mae")).alias("mae"), *s.columns[3:])


@query("s04_rank_candidates", f"select candidate from ({SCREEN_SQL}) where qualifies order by brier, mae limit 1")
def _(spark, d):
    return E.rank_candidates(screened(spark, d)).select("candidate")


@query(
    "s06_replace_incumbent",
    """select name, round(brier, 6) as brier from (select name, avg(brier) as brier, case when name = 'constant_rate' then 0 else 1 end as newer from fx_refbrier group by 1) order by brier, newer limit 1""",
)
def _(spark, d):
    b = E.brier(long_of(references(spark, d), "p", "name"), ["name", "h"]).groupBy("name").agg(F.avg("brier").alias("brier"))
    # The incumbent sorts first among equals: only a strictly lower error replaces it.
    return b.orderBy("brier", F.when(C("name") == "constant_rate", 0).otherwise(1)).limit(1).select("name", R(C("brier")).alias("brier"))


BOOT_X = DRAW_SQL.format(x="s.resample*1009 + k.slot*7919 + 1*104729 + 1", n="n.n")


@query(
    "e12_paired_intervals",
    f"""with pr as (select run, brier, mae, row_number() over (order by run) - 1 as pos from fx_perrun), n as (select count(*) as n from pr),
        means as (select s.resample, avg(brier*0.25 - 0.01) as brier, avg(mae*0.5 - 1.0) as mae from range(5000) s(resample), n, (select pos as slot from pr) k join pr on pr.pos = {BOOT_X} group by 1)
        select metric, round(improvement, 6) as improvement, round(low, 6) as low, round(high, 6) as high, runs_won, runs from (
          select 'brier' as metric, (select avg(brier*0.25 - 0.01) from pr) as improvement, (select quantile_cont(brier, .025) from means) as low, (select quantile_cont(brier, .975) from means) as high,
                 (select count(*) from pr where brier*0.25 > 0.01) as runs_won, (select count(*) from pr) as runs
          union all select 'mae', (select avg(mae*0.5 - 1.0) from pr), (select quantile_cont(mae, .025) from means), (select quantile_cont(mae, .975) from means),
                 (select count(*) from pr where mae*0.5 > 1.0), (select count(*) from pr))""",
)
def _(spark, d):
    base = per_run(spark, d).select("run", "brier", "mae")
    better = base.select("run", (C("brier") * 0.75 + 0.01).alias("brier"), (C("mae") * 0.5 + 1.0).alias("mae"))
    p = E.paired_intervals(better, base, ["brier", "mae"], 1)
    return p.select("metric", *[R(C(c)).alias(c) for c in ("improvement", "low", "high")], "runs_won", "runs")


@query(
    "e13_all_eligible_baselines",
    "select name, round(avg(pow(p6 - y6, 2)), 6) as brier, count(*) as windows, count(case when event_id % 6 = 0 then 1 end) as unsupported from fx_refs group by name",
)
def _(spark, d):
    r = references(spark, d)
    return r.groupBy("name").agg(
        R(F.avg(F.pow(F.element_at("p", 7) - F.element_at("y", 7), 2))).alias("brier"), F.count("*").alias("windows"), F.count(F.when(C("event_id") % 6 == 0, 1)).alias("unsupported")
    )


# --- audits -------------------------------------------------------------------------
V.register_ctes(
    {
        "fx_reviews": """select run, session_id % 8 <> 0 as reviewed, case when session_id % 9 <> 0 then active_duration_ms/1000.0 - 0.1 end as lo,
        case when session_id % 9 = 0 then null when session_id % 10 = 0 then 'nan'::double else active_duration_ms/1000.0 + case when session_id % 4 = 0 then 0.3 else 0.1 end end as hi,
        session_id % 3 <> 0 as av, 0.2 + (session_id % 5)/10.0 as ab from fx_runs40 where run <= 30"""
    }
)


def reviews(spark, d):
    i = C("session_id")
    end = C("active_duration_ms") / 1000.0
    return runs40(spark, d).where("run <= 30").select(
        "run", (i % 8 != 0).alias("reviewed"), F.when(i % 9 != 0, end - 0.1).alias("lo"),
        F.when(i % 9 == 0, F.lit(None)).when(i % 10 == 0, float("nan")).otherwise(end + F.when(i % 4 == 0, 0.3).otherwise(0.1)).alias("hi"),
        (i % 3 != 0).alias("alignment_verified"), (0.2 + (i % 5) / 10.0).alias("alignment_bound"),
    )


TIMING = """case when not reviewed then 'not_visually_reviewed' when lo is null then 'visible_loss_transition_missing' when isnan(hi) then 'invalid_loss_interval'
   when hi <= lo or hi - lo > .25 + 1e-9 then 'loss_uncertainty_exceeds_0.25_seconds' end"""


@query("e14_timing_reasons", f"select cast(run as bigint) as run, {TIMING} as reason, not (av and ab between 0 and 0.5) as pending from fx_reviews")
def _(spark, d):
    return E.timing_reasons(reviews(spark, d)).select("run", "reason", "pending")


@query(
    "e14_timing_gate",
    f"""select count(*) = 30 as complete, cast(count({TIMING}) as bigint) as failures, count(case when not (av and ab between 0 and 0.5) then 1 end) as pending_runs,
        case when count(*) <> 30 then 'incomplete_review' when count({TIMING}) > 0 then 'closed_timing_failure' else 'pending_alignment' end as status, false as forecasting_allowed from fx_reviews""",
)
def _(spark, d):
    return E.timing_gate(reviews(spark, d))


@query(
    "e15_audit_decision",
    """select n as reviewed, i as issues, i - u as incorrect, u as uncertain, c.bad = 0 as alignment_passed, c.n2 as alignment_checks, round((n-i)*1.0/n, 6) as upper_bound,
       case when c.bad = 0 and (n-i)*1.0/n < .9 then 'closed_extraction_failure' else 'not_approved' end as status, false as forecasting_allowed
       from (select count(*) as n, count(case when quality = 0 then 1 end) as i, count(case when quality = 0 and doc_id % 3 = 0 then 1 end) as u from labels), (select count(*) as n2, count(case when abs((session_id % 7)*0.05) + .15 > .5 then 1 end) as bad from fx_facts) c""",
)
def _(spark, d):
    lab = V.read(spark, d, "labels").select(C("doc_id").alias("id"), "quality")
    issues = lab.where("quality = 0").withColumn("kind", F.when(C("id") % 3 == 0, "uncertain").otherwise("incorrect"))
    al = V.session_facts(spark, d).select(((C("session_id") % 7) * 0.05).alias("offset_s"), F.lit(False).alias("search_edge"))
    a = E.audit_decision(lab, issues, al)
    return a.withColumn("upper_bound", R(C("upper_bound")))


@query(
    "e17_alignment_gate",
    "select count(*) as checks, count(case when session_id % 20 = 0 or (session_id % 9)*0.05 + .15 > .5 then 1 end) as failing, count(case when session_id % 20 = 0 or (session_id % 9)*0.05 + .15 > .5 then 1 end) = 0 as passed from fx_facts",
)
def _(spark, d):
    al = V.session_facts(spark, d).select(((C("session_id") % 9) * -0.05).alias("offset_s"), (C("session_id") % 20 == 0).alias("search_edge"))
    return E.alignment_gate(al)


V.register_ctes(
    {
        "fx_truth": "select distinct session_id, active_ms*12//1000 as pos from fx_obs where event_type='purchase' and active_ms % 5 = 0",
        "fx_seconds": "select sum(active_duration_ms)/1000.0 as s from fx_facts",
    }
)
EVENT_SQL = """with recursive tr as (select distinct session_id, active_ms*12//1000 as pos from fx_obs where event_type='purchase'),
ev as (select distinct session_id, active_ms*12//1000 as pos from fx_obs where event_type='click'),
kk as (select session_id, pos, row_number() over (partition by session_id order by pos) as k,
      (select count(*) from tr t where t.session_id = e.session_id and t.pos + 6 < e.pos) as lo,
      (select count(*) from tr t where t.session_id = e.session_id and t.pos - 1 <= e.pos) as hi from ev e),
walk as (select session_id, k, hi, lo as p, lo < hi as hit from kk where k = 1
  union all select kk.session_id, kk.k, kk.hi, greatest(w.p + case when w.hit then 1 else 0 end, kk.lo), greatest(w.p + case when w.hit then 1 else 0 end, kk.lo) < kk.hi
  from walk w join kk on kk.session_id = w.session_id and kk.k = w.k + 1),
fx_score as (select tp as true_positive, fp as false_positive, fn as false_negative, tp*1.0/(tp+fp) as precision, tp*1.0/(tp+fn) as recall, fp*60.0/s as false_per_minute
  from (select count(case when hit then 1 end) as tp, count(case when not hit then 1 end) as fp, (select count(*) from tr) - count(case when hit then 1 end) as fn from walk), fx_seconds)
"""


def summary(spark, d):
    m = J.match_events(*marks(spark, d, "click", "purchase"), ["session_id"], 1, 6)
    secs = V.session_facts(spark, d).agg((F.sum("active_duration_ms") / 1000.0).alias("_s"))
    return A.event_summary(m.join(F.broadcast(secs)), F.max("_s"))


@query("a18_event_summary", EVENT_SQL + "select true_positive, false_positive, false_negative, round(precision, 6) as precision, round(recall, 6) as recall, round(false_per_minute, 6) as false_per_minute from fx_score")
def _(spark, d):
    s = summary(spark, d)
    return s.select("true_positive", "false_positive", "false_negative", *[R(C(c)).alias(c) for c in ("precision", "recall", "false_per_minute")])


@query(
    "e16_measurement_gate",
    EVENT_SQL + """, cov as (select count(distinct pos0) as n from (select session_id*100000 + pos + o.o as pos0 from tr, range(-1, 7) o(o)))
      select true_positive + false_negative >= 20 as enough_events, s - n/12.0 >= 30 as enough_negative_time, precision >= .5 as precision_ok, recall >= .5 as recall_ok, false_per_minute <= 20 as false_rate_ok, supported >= .95 as coverage_ok, ambiguous <= .1 as ambiguity_ok,
      true_positive + false_negative >= 20 and s - n/12.0 >= 30 and precision >= .5 and recall >= .5 and false_per_minute <= 20 and supported >= .95 and ambiguous <= .1 as passed from fx_score, cov, fx_seconds,
      (select avg(case when event_id % 50 <> 0 then 1.0 else 0.0 end) as supported, avg(case when event_id % 9 = 0 then 1.0 else 0.0 end) as ambiguous from fx_obs)""",
)
def _(spark, d):
    (truth,) = marks(spark, d, "purchase")
    covered = truth.select("session_id", F.explode(F.sequence(C("at") - 1, C("at") + 6)).alias("at")).distinct().agg(F.count("*").alias("_n"))
    secs = V.session_facts(spark, d).agg((F.sum("active_duration_ms") / 1000.0).alias("_s"))
    s = summary(spark, d).join(F.broadcast(covered)).join(F.broadcast(secs))
    share = lambda q: F.avg(F.when(q, 1.0).otherwise(0.0))
    support = V.obs(spark, d).agg(share(C("event_id") % 50 != 0).alias("supported_share"), share(C("event_id") % 9 == 0).alias("ambiguous_share"))
    s = s.join(F.broadcast(support)).withColumn("negative_seconds", C("_s") - C("_n") / 12.0)
    g = E.measurement_gate(s, dict(events=20, negative_seconds=30, precision=0.5, recall=0.5, false_per_minute=20, coverage=0.95, ambiguous=0.1))
    return g.select("enough_events", "enough_negative_time", "precision_ok", "recall_ok", "false_rate_ok", "coverage_ok", "ambiguity_ok", "passed")


@query("e18_verify_provenance", "select doc_id, case when doc_id % 11 = 0 then 'missing' else 'changed' end as problem from documents where doc_id % 11 = 0 or doc_id % 7 = 0")
def _(spark, d):
    docs = V.read(spark, d, "documents")
    h = lambda t: S.content_hash(t.cast("binary"))
    manifest = docs.select("doc_id", h(C("text")).alias("sha256"))
    files = docs.where("doc_id % 11 <> 0").select("doc_id", h(F.when(C("doc_id") % 7 == 0, F.concat("text", F.lit("~"))).otherwise(C("text"))).alias("sha256"))
    return E.verify_provenance(manifest, files, "doc_id")


@query(
    "e19_same_frames",
    """select label as run, count(*) as frames_a, count(case when vec_id % 101 <> 0 then 1 end) as frames_b, count(case when vec_id % 101 = 0 or vec_id % 150 = 7 then 1 end) = 0 as same from embeddings group by 1""",
)
def _(spark, d):
    e = V.read(spark, d, "embeddings").select(C("label").alias("run"), C("vec_id").alias("idx"), F.to_json("embedding").alias("t"))
    a = e.select("run", "idx", S.content_hash(C("t").cast("binary")).alias("hash"))
    b = e.where("idx % 101 <> 0").select("run", "idx", S.content_hash(F.when(C("idx") % 150 == 7, F.concat("t", F.lit("~"))).otherwise(C("t")).cast("binary")).alias("hash"))
    return E.same_frames(a, b, ["run"])


@query(
    "e20_report_table",
    "select run, printf('%.5f', round(brier, 5)) as brier, printf('%.2f', round(mae, 2)) as mae from fx_perrun",
)
def _(spark, d):
    return E.report_table(per_run(spark, d), "run", {"brier": 5, "mae": 2})


@query(
    "a14_feature_drift",
    """with st as (select avg(ttf) as mu_ttf, stddev_pop(ttf) as sd_ttf, avg(m0) as mu_m0, stddev_pop(m0) as sd_m0, avg(m6) as mu_m6, stddev_pop(m6) as sd_m6, avg(remaining) as mu_r, stddev_pop(remaining) as sd_r from fx_train),
       z as (select run, 'ttf' as feature, abs((avg(ttf) - any_value(mu_ttf))/any_value(sd_ttf)) as shift from fx_dev, st group by run union all
             select run, 'm0', abs((avg(m0) - any_value(mu_m0))/any_value(sd_m0)) from fx_dev, st group by run union all
             select run, 'm6', abs((avg(m6) - any_value(mu_m6))/any_value(sd_m6)) from fx_dev, st group by run union all
             select run, 'remaining', abs((avg(remaining) - any_value(mu_r))/any_value(sd_r)) from fx_dev, st group by run union all
             select run, 'fixed', 0.0 from fx_dev group by run)
       select run, cast(rk as bigint) as rank, feature, round(shift, 6) as shift from (select *, row_number() over (partition by run order by shift desc, feature) as rk from z) where rk <= 4""",
)
def _(spark, d):
    w = development(spark, d).select("run", "ttf", F.element_at("m", 1).alias("m0"), F.element_at("m", 7).alias("m6"), "remaining", F.lit(1.0).alias("fixed"))
    f = A.feature_drift(w, ["ttf", "m0", "m6", "remaining", "fixed"], C("run") <= 24, 4)
    return f.select("run", C("rank").cast("long").alias("rank"), "feature", R(C("shift")).alias("shift"))


@query(
    "s05_top_drift",
    """with st as (select avg(ttf) as a, stddev_pop(ttf) as b, avg(m0) as c, stddev_pop(m0) as d, avg(m6) as e, stddev_pop(m6) as f from fx_train),
       z as (select run, 'ttf' as feature, abs((avg(ttf) - any_value(a))/any_value(b)) as shift from fx_dev, st group by run union all
             select run, 'm0', abs((avg(m0) - any_value(c))/any_value(d)) from fx_dev, st group by run union all
             select run, 'm6', abs((avg(m6) - any_value(e))/any_value(f)) from fx_dev, st group by run)
       select run, feature from (select *, row_number() over (partition by run order by shift desc, feature) as rk from z) where rk = 1""",
)
def _(spark, d):
    w = development(spark, d).select("run", "ttf", F.element_at("m", 1).alias("m0"), F.element_at("m", 7).alias("m6"))
    return A.feature_drift(w, ["ttf", "m0", "m6"], C("run") <= 24, 1).select("run", "feature")


def members(spark, d):
    """Five members around every forecast: p scaled down by 2 % per member."""
    p = V.labelled(spark, d)
    return J.expand_grid(p, member=[0, 1, 2, 3, 4]).withColumn("p", F.transform("m", lambda x: x * (1 - 0.02 * C("member"))))


V.register_ctes(
    {
        "fx_members": "select session_id, event_id, ttf, k.k as member, " + ", ".join(f"m{i}*(1 - 0.02*k.k) as q{i}" for i in range(7)) + " from fx_labelled, range(5) k(k)",
        "fx_scored": "select session_id, event_id, any_value(ttf) as ttf, " + ", ".join(f"median(q{i}) as q{i}" for i in range(7))
        + f", quantile_cont(r, .1) as low, quantile_cont(r, .9) as high, ({' + '.join(f'stddev_pop(q{i})' for i in range(7))})/7 as disagreement from (select *, {V.trapezoid_sql([f'q{i}' for i in range(7)], FX)} as r from fx_members) group by session_id, event_id",
    }
)


@query("a16_ensemble_median", "select session_id, event_id, " + ", ".join(f"round(q{i}, 9) as p{i}" for i in range(7)) + " from fx_scored")
def _(spark, d):
    m = A.ensemble_median(members(spark, d).select(*KEY, "p"), KEY)
    return m.select(*KEY, *[R(F.element_at("p", i + 1), 9).alias(f"p{i}") for i in range(7)])


SCORED_REM = V.trapezoid_sql([f"q{i}" for i in range(7)], FX)


@query(
    "m13_certainty_contract",
    f"""with q as (select quantile_cont(disagreement, .33) as high, quantile_cont(disagreement, .67) as medium from fx_scored),
        e as (select s.*, abs({SCORED_REM} - least(ttf, 12.0)) as err, q.high as hq, q.medium as mq from fx_scored s, q),
        a as (select any_value(hq) as high, any_value(mq) as medium, avg(case when disagreement <= hq then err end) as high_mae, avg(case when disagreement > hq and disagreement <= mq then err end) as medium_mae from e)
        select round(high, 6) as high, round(medium, 6) as medium, round(high_mae, 6) as high_mae, round(medium_mae, 6) as medium_mae, high_mae <= 4 as high_enabled, medium_mae <= 5 and (not (high_mae <= 4) or high_mae < medium_mae) as medium_enabled from a""",
)
def _(spark, d):
    s = M.score_members(members(spark, d).select(*KEY, "p"), KEY, FX)
    s = s.join(V.labelled(spark, d).select(*KEY, "ttf"), KEY)
    c = M.certainty_contract(s, CAP, 4.0, 5.0)
    return c.select(*[R(C(x)).alias(x) for x in ("high", "medium", "high_mae", "medium_mae")], "high_enabled", "medium_enabled")


@query(
    "m14_score_members",
    f"select session_id, event_id, round({SCORED_REM}, 6) as remaining, round(low, 6) as low, round(high, 6) as high, round(disagreement, 6) as disagreement from fx_scored",
)
def _(spark, d):
    s = M.score_members(members(spark, d).select(*KEY, "p"), KEY, FX)
    return s.select(*KEY, *[R(C(x)).alias(x) for x in ("remaining", "low", "high", "disagreement")])


@query(
    "m16_postmortem",
    "select run, round(avg((" + " + ".join(f"pow(m{i} - y{i}, 2)" for i in range(7)) + ")/7), 6) as brier, " + ", ".join(f"round(avg(m{i}), 6) as mean_p{i}" for i in range(7)) + ", round(max(m6*0.01), 6) as largest_gap from fx_dev group by run",
)
def _(spark, d):
    p = development(spark, d).select("run", C("m").alias("p"), F.transform("m", lambda x: x * 0.99).alias("q"), "y")
    m = M.postmortem(p)
    return m.select("run", *[R(C(c)).alias(c) for c in m.columns[1:]])


# --- reviews and reports ---------------------------------------------------------
@query(
    "a19_review_checkpoint",
    """select count(*) as reviewed, count(case when quality = 1 and toxic = 0 then 1 end) as correct, round(count(case when quality = 1 and toxic = 0 then 1 end)*1.0/count(*), 6) as accuracy,
       (select count(distinct user_id) from events) as clips, (select count(distinct event_type) from events where event_type in ('click', 'error', 'purchase', 'view')) = 4 as events_covered,
       count(*) = 60 and count(case when quality = 1 and toxic = 0 then 1 end) >= ceil(60*.9) and (select count(distinct user_id) from events) = 12
         and (select count(distinct event_type) from events where event_type in ('click', 'error', 'purchase', 'view')) = 4 as passed from labels""",
)
def _(spark, d):
    lab = V.read(spark, d, "labels").select(C("doc_id").alias("id"), (C("quality") == 1).alias("geometry_correct"), (C("toxic") == 0).alias("colours_correct"))
    clips = V.obs(spark, d).select(C("session_id").alias("clip"), F.lit(True).alias("reviewed"), F.array("event_type").alias("events"))
    r = A.review_checkpoint(lab, clips, 60, 0.9, 12, ["click", "error", "purchase", "view"])
    return r.select("reviewed", "correct", R(C("accuracy")).alias("accuracy"), "clips", "events_covered", "passed")


@query(
    "a21_session_stats",
    """select session_id, round(avg(abs(remaining - least(12.0, ttf))), 6) as mae, round(coalesce(max(case when loss_window <> 'none' then ttf end), 0.0), 6) as warning_lead,
       round(avg(case when loss_window = case when ttf <= 2 then 'under_10s' when ttf <= 4 then '10_to_20s' when ttf <= 6 then '20_to_30s' when ttf <= 9 then '30_to_45s' when ttf <= 12 then '45_to_60s' else 'none' end then 1.0 else 0.0 end), 6) as window_accuracy,
       count(case when loss_window <> 'none' and ttf > 12 then 1 end) as false_early from fx_labelled where status='ready' group by 1""",
)
def _(spark, d):
    p = V.labelled(spark, d).where("status = 'ready'")
    actual = S.loss_window(F.element_at(F.array(*[F.lit(k) for k in (0, 2, 4, 5, 6, 7)]), S.actual_class(C("ttf"), FX) + 1))
    s = A.session_stats(p, CAP, actual)
    return s.select("session_id", *[R(C(c)).alias(c) for c in ("mae", "warning_lead", "window_accuracy")], "false_early")


@query(
    "a24_failed_gates",
    """select session_id, array_to_string(list_filter([case when not (valid_frame_count >= 66) then 'frames' end, case when not (active_duration_ms >= 14800) then 'length' end, case when end_reason <> 'game_over' then 'reason' end], lambda x: x is not null), ',') as failed,
       round(least(100.0, valid_frame_count*100.0/70), 6) as progress from fx_facts""",
)
def _(spark, d):
    s = V.session_facts(spark, d)
    gates = F.create_map(
        F.lit("frames"), C("valid_frame_count") >= 66, F.lit("length"), C("active_duration_ms") >= 14_800, F.lit("reason"), C("end_reason") == "game_over"
    )
    f = A.failed_gates(s.select("session_id", gates.alias("gates"), C("valid_frame_count").alias("done"), F.lit(70).alias("target")))
    return f.select("session_id", "failed", R(C("progress")).alias("progress"))


CLIP12 = "greatest(0.0, least(12.0, {x}))"


@query(
    "a25_timeline_series",
    f"""with b as (select s.session_id, s.active_duration_ms as dur, (select avg(q.active_duration_ms)/1000.0 from fx_sessions q where q.usable and q.started_ms < s.started_ms) as base from fx_sessions s)
      select session_id, series, at_ms, round(value, 9) as value from (
        select session_id, 'estimate' as series, active_ms as at_ms, {CLIP12.format(x='remaining')} as value from fx_predictions union all
        select session_id, 'low', active_ms, {CLIP12.format(x='remaining*0.8')} from fx_predictions union all
        select session_id, 'high', active_ms, {CLIP12.format(x='remaining*1.2')} from fx_predictions union all
        select session_id, 'truth', 0, least(12.0, dur/1000.0) from b union all select session_id, 'truth', dur - 12000, 12.0 from b where dur > 12000 union all select session_id, 'truth', dur, 0.0 from b union all
        select session_id, 'average', 0, {CLIP12.format(x='base')} from b where base is not null union all select session_id, 'average', dur, {CLIP12.format(x='base - dur/1000.0')} from b where base is not null union all
        select session_id, 'pause', active_ms, 0.0 from fx_lifecycle where state = 'paused')""",
)
def _(spark, d):
    from foretide.plans.sessions import RUNS_LINE

    p = V.predictions(spark, d).withColumn("low", C("remaining") * 0.8).withColumn("high", C("remaining") * 1.2)
    s = J.prior_baseline(V.sessions(spark, d), RUNS_LINE)
    t = A.timeline_series(p, s, V.lifecycle(spark, d).where("state = 'paused'"), CAP)
    return t.select("session_id", "series", "at_ms", R(C("value"), 9).alias("value"))


@query(
    "a22_ruler_check",
    """select a.session_id, round((a.radius - b.radius)/2.0, 6) as estimated, abs((a.radius - b.radius)/2.0 - a.radius/10.0) <= 5 as within
       from fx_frames a join fx_frames b on b.session_id = a.session_id and b.idx = a.idx + 2 where a.idx = 3 and a.event_id % 4 = b.event_id % 4
       union all select a.session_id, null, false from fx_frames a join fx_frames b on b.session_id = a.session_id and b.idx = a.idx + 2 where a.idx = 3 and a.event_id % 4 <> b.event_id % 4""",
)
def _(spark, d):
    f = coloured_frames(spark, d)
    rulers = f.where("idx = 3").select("session_id", C("idx").alias("start_idx"), (C("idx") + 2).alias("end_idx"), C("radius").alias("start_radius"), (C("radius") * 0.8).alias("end_radius"))
    r = A.ruler_check(rulers, f, ["session_id"], 1.0, 5.0)
    return r.select("session_id", R(C("estimated")).alias("estimated"), "within")


def coloured_frames(spark, d):
    from foretide.plans.timelines import view_frames

    return view_frames(spark, d).withColumn("colour", C("event_id") % 4)


@query(
    "a23_track_agreement",
    """select session_id, count(case when event_id % 4 = 1 then 1 end) as colour_correct, count(*) as reviewed, count(case when radius < p then 1 end) as inward_pairs, count(*) - 1 as possible_pairs from (
        select *, lag(radius) over (partition by session_id order by idx) as p from fx_frames where idx between 2 and 9) group by 1""",
)
def _(spark, d):
    f = coloured_frames(spark, d)
    tracks = f.select("session_id").distinct().select("session_id", F.lit(2).cast("long").alias("start_idx"), F.lit(9).cast("long").alias("end_idx"), F.lit(1).alias("colour"))
    return A.track_agreement(tracks, f, Timeline(("session_id",), ("idx",), "idx", 4))


# --- fitted models (rows-only: fits are compared by metric in the tests) -------------
def fitted_windows(spark, d):
    """Windows of the forty study runs as (run, keys, x, y, ttf), written once: many fits read them."""
    w = windows(spark, d).withColumn("history", J.resample_even(C("history")))
    a = J.aggregate_window(w, ["session_id", SLICE, "event_id", "ttf", "active_ms"], ["motion"])
    runs = runs40(spark, d).select("session_id", "run")
    x = F.array(*[C(f"{s}_motion") for s in ("mean", "std", "min", "max", "delta")], C("active_ms") / 1000.0)
    out = a.join(runs, "session_id").select("run", "session_id", "event_id", "ttf", x.alias("x"), S.failure_targets(C("ttf"), FX).alias("y"))
    return materialise(out, "windows")


def study_folds(df):
    """The study's folds; a run without windows is refused."""
    M.assert_folds(df)
    return FOLDS


@query("m03_logistic")
def _(spark, d):
    w = fitted_windows(spark, d)
    a, b, c = study_folds(w)[-1]
    p = M.predict_horizons(M.fit_horizons(w.where(C("run") <= a), w.where((C("run") > a) & (C("run") <= b)), "x", 7), w.where((C("run") > b) & (C("run") <= c)), "x")
    return p.select("run", "session_id", "event_id", "p")


@query("m04_boosted_trees")
def _(spark, d):
    w = fitted_windows(spark, d)
    a, b, c = study_folds(w)[-1]
    train = M.vectors(w.where(C("run") <= a), "x")
    models = M.together([partial(M.fit, train, "x", F.element_at("y", h + 1), "tree") for h in range(7)])
    return M.predict_horizons(models, w.where((C("run") > b) & (C("run") <= c)), "x").select("run", "session_id", "event_id", "p")


@query("m07_calibrate")
def _(spark, d):
    w = fitted_windows(spark, d)
    a, b, c = study_folds(w)[-1]
    train, cal = [M.vectors(w.where(q), "x") for q in (C("run") <= a, (C("run") > a) & (C("run") <= b))]
    fitted = M.together([partial(M.fit, train, "x", F.element_at("y", h + 1)) for h in range(7)])
    models = M.together([partial(M.calibrate, m, cal, F.element_at("y", h + 1)) for h, m in enumerate(fitted)])
    return M.predict_horizons(models, w.where((C("run") > b) & (C("run") <= c)), "x").select("run", "session_id", "event_id", "p")


@query("m09_ensemble")
def _(spark, d):
    w = fitted_windows(spark, d)
    a, b, c = study_folds(w)[-1]
    run = C("run")
    ens = M.fit_ensemble(w.where(run <= a), w.where((run > a) & (run <= b)), "x", 7)
    got = M.member_predictions(ens, w.where((run > b) & (run <= c)), "x")
    return A.ensemble_median(got, ["run", "session_id", "event_id"])


@query("m10_elapsed_references")
def _(spark, d):
    """The time-only references: logistic and boosted trees on elapsed time alone, for the study's last fold."""
    w = fitted_windows(spark, d).withColumn("t", F.array(F.element_at("x", 6)))
    a, b, c = study_folds(w)[-1]
    run = C("run")
    train, cal, test = w.where(run <= a), w.where((run > a) & (run <= b)), w.where((run > b) & (run <= c))
    parts_ = [
        M.predict_horizons(M.fit_horizons(train, cal, "t", 7, family), test, "t").select("run", "session_id", "event_id", F.lit(f"elapsed_{family}").alias("name"), "p")
        for family in ("logistic", "tree")
    ]
    return parts_[0].unionByName(parts_[1])


@query("m12_candidate_grid")
def _(spark, d):
    w = fitted_windows(spark, d)
    # Screening grows fewer trees than the final fit (m04 grows all of them).
    grid = M.run_grid(w, {"elapsed": [5], "motion": [0, 1, 2, 3, 4]}, ["logistic", "tree"], 7, study_folds(w), trees=10)
    per = grid.select("candidate", "fold", "run", F.explode(F.arrays_zip("p", "y")).alias("_z"))
    return per.groupBy("candidate", "fold", "run").agg(F.avg(F.pow(C("_z.p") - C("_z.y"), 2)).alias("brier"))


@query("m15_freeze_candidate")
def _(spark, d):
    w = fitted_windows(spark, d)
    n = study_folds(w)[-1]
    models = M.fit_horizons(w.where(C("run") <= n[0]), w.where((C("run") > n[0]) & (C("run") <= n[2])), "x", 7)
    return M.freeze(models, fresh_path(spark, "frozen"), {"fit_to": int(n[0]), "calibrate_to": int(n[2]), "purpose": "prospective candidate"})

