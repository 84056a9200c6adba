"""Registered queries: gates fed from a model's forecasts, and reference metrics of every horizon."""

from __future__ import annotations

from pyspark.sql import functions as F

from foretide.functions import scalars as S
from foretide.operators import evaluation as E
from foretide.operators import windows as W
from foretide.plans import views as V
from foretide.plans.forecasts import BIN, CAP, FX, GATES, SQUARES, long_of, parts, references
from foretide.plans.registry import query
from foretide.plans.sessions import R

C = F.col
FIGURES = ("brier_vs_elapsed", "brier_vs_average", "mae_vs_elapsed", "mae_vs_average", "final10_mae", "elapsed_final10_mae", "worst_ece", "useful_rate")
LEFT = V.trapezoid_sql([f"p{i}" for i in range(7)], FX)
V.register_ctes(
    {
        "fx_survivors": f"""select '' as name, run, ttf, {SQUARES} as s, remaining from fx_test
            union all select name, run, ttf, ({" + ".join(f"pow(p{i} - y{i}, 2)" for i in range(7))})/7, {LEFT} from fx_refs""",
        "fx_survival": """select name, avg(s) as brier, coalesce(avg(case when ttf <= 12 then abs(remaining - ttf) end), 12.0) as mae, coalesce(avg(case when ttf <= 2 then abs(remaining - ttf) end), 12.0) as near_mae, count(distinct run) as runs from fx_survivors group by name""",
        "fx_worst": f"""select max(e) as worst_ece from (select h, sum(abs(sy - sp))/sum(n) as e from (select h, {BIN} as b, sum(y) as sy, sum(p) as sp, count(*) as n from fx_long join fx_runs using (session_id) where run > 24 group by all) group by h)""",
        "fx_useful": "select avg(case when lead >= 3 then 1.0 else 0.0 end) as useful_rate from (select session_id, coalesce(max(case when crossing < 7 and ttf <= 12 then ttf end), 0.0) as lead from fx_test group by 1)",
        "fx_figures": """select m.runs as evaluated_runs, (e.brier - m.brier)/e.brier as brier_vs_elapsed, (a.brier - m.brier)/a.brier as brier_vs_average, (e.mae - m.mae)/e.mae as mae_vs_elapsed, (a.mae - m.mae)/a.mae as mae_vs_average,
            m.near_mae as final10_mae, e.near_mae as elapsed_final10_mae, worst_ece, useful_rate from fx_survival m, fx_survival e, fx_survival a, fx_worst, fx_useful where m.name = '' and e.name = 'constant_rate' and a.name = 'average_duration'""",
    }
)


@query(
    "e08_survival_gates",
    "select evaluated_runs, " + ", ".join(f"round({c}, 6) as {c}" for c in FIGURES) + """, evaluated_runs = 10 as gate_locked_test, brier_vs_elapsed >= 0.1 as gate_brier_elapsed, brier_vs_average >= 0.1 as gate_brier_average,
        mae_vs_elapsed >= 0.1 as gate_time_elapsed, mae_vs_average >= 0.1 as gate_time_average, useful_rate >= 0.5 as gate_useful_warning, worst_ece <= 0.12 as gate_calibration, final10_mae <= 1.1*elapsed_final10_mae as gate_final_ten, true as gate_latency,
        evaluated_runs = 10 and brier_vs_elapsed >= 0.1 and brier_vs_average >= 0.1 and mae_vs_elapsed >= 0.1 and mae_vs_average >= 0.1 and useful_rate >= 0.5 and worst_ece <= 0.12 and final10_mae <= 1.1*elapsed_final10_mae as eligible from fx_figures""",
)
def _(spark, d):
    _, test = parts(spark, d)
    seen = test.withColumn("predicted_class", S.predicted_class(C("crossing"))).withColumn("actual_class", S.actual_class(C("ttf"), FX))
    warnings = E.warning_metrics(seen, W.warning_leads(seen.withColumn("signal", C("predicted_class") < 5), CAP), 3.0)
    # The constant rate stands in for the fitted elapsed-time reference, which no twin can fit.
    figures = E.survival_metrics(test.withColumn("p", C("m")), references(spark, d), warnings, FX, CAP, 2.0, elapsed="constant_rate")
    gated = E.promotion_gates(figures.withColumn("total_runs", F.lit(40)).withColumn("latency_p95", F.lit(1.0)))
    return gated.select("evaluated_runs", *[R(C(c)).alias(c) for c in FIGURES], *[f"gate_{n}" for n in GATES], "eligible")


@query(
    "e13_reference_horizons",
    "\nunion all\n".join(f"select name, {i} as h, round(avg(pow(p{i} - y{i}, 2)), 6) as brier, count(*) as windows, count(case when event_id % 6 = 0 then 1 end) as unsupported from fx_refs group by name" for i in range(7)),
)
def _(spark, d):
    r = long_of(references(spark, d).withColumn("unsupported", C("event_id") % 6 == 0), "p", "name", "unsupported")
    return r.groupBy("name", "h").agg(R(F.avg(F.pow(C("p") - C("y"), 2))).alias("brier"), F.count("*").alias("windows"), F.count(F.when(C("unsupported"), 1)).alias("unsupported"))
