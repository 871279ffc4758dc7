"""Registered queries: evaluation and selection (M), split leakage (H4), model report (A8), grids and ranges (C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from veriframe.functions.scores import threshold_decision
from veriframe.operators import evaluation as e
from veriframe.operators import calibration, kernels, margins, neighbours, trees
from veriframe.operators import selection as s
from veriframe.operators.integrity import split_crossings
from veriframe.plans.calibration_sql import calibration_sql
from veriframe.plans.dashboards import rounded
from veriframe.plans.decisions import DECISION_SQL
from veriframe.plans.tree_sql import growth_sql, held_out_sql
from veriframe.registry import query
from veriframe.session import cut_lineage
from veriframe.schemas import CLASS_KEYS, CLASS_OF_KEY, CLASSES, FEATURES

_LABEL_SQL = f"case {DECISION_SQL} when 'verified' then 'Verified' when 'review' then 'Manual Review' else 'Rejected' end"


def threshold_label(columns=None):
    """Threshold decision as a class label, over the named columns or given ones."""
    decision = threshold_decision() if columns is None else threshold_of(columns)
    return F.when(decision == "verified", F.lit(CLASS_OF_KEY["verified"])).when(decision == "review", F.lit(CLASS_OF_KEY["review"])).otherwise(
        F.lit(CLASS_OF_KEY["rejected"]))


def threshold_of(columns):
    face, live, ocr, blur = columns[:4]
    return (
        F.when((face < 50) | (live < 0.5) | (ocr < 0.4) | ((blur < 80) & (face < 65)), F.lit("rejected"))
        .when((face > 80) & (live > 0.75) & (ocr > 0.7), F.lit("verified")).otherwise(F.lit("review"))
    )


def predictions(t):
    return t.labelled_scores.withColumn("predicted", threshold_label())


_PRED = f"pred as (select *, {_LABEL_SQL} predicted from labelled_scores)"
_SPLIT = """
ranked as (select *, row_number() over (partition by target order by md5(concat(cast(request_id as varchar), ':42')), request_id) r,
           count(*) over (partition by target) nc from labelled_scores),
split as (select * exclude (r, nc), case when r <= floor(nc * 0.7e0 + 0.5e0) then 'train' when r <= floor(nc * 0.85e0 + 0.5e0) then 'validation' else 'test' end split from ranked)"""
_SCALED = ("limits as (select " + ", ".join(f"min({f}) lo_{f}, max({f}) hi_{f}" for f in FEATURES) + " from split where split = 'train'),\n"
           "scaled as (select request_id, target, split, " + ", ".join(
               f"greatest(0, least(1, ({f} - lo_{f}) / (hi_{f} - lo_{f}))) {f}" for f in FEATURES) + " from split, limits)")


def split_rows(t):
    return s.stratified_split(t.labelled_scores, "request_id")


def scaled_rows(t):
    rows = split_rows(t)
    return s.apply_min_max(rows, s.fit_min_max(rows.where(F.col("split") == "train")))


@query("m1_min_max_scaling", f"""
with {_SPLIT}, {_SCALED} select request_id, {', '.join(f'round({f}, 6) {f}' for f in FEATURES)} from scaled""")
def _(t):
    return rounded(scaled_rows(t).select("request_id", *FEATURES))


_POWERS = [-1.0, -0.5, 0.0, 0.25, 0.5, 1.0, 1.5, 2.0]


@query("m2_power_likelihood", f"""
with v as (select f feature, x from (select 'blur_score' f, blur_score x from labelled_scores union all
     select 'brightness_score', brightness_score from labelled_scores union all select 'contrast_score', contrast_score from labelled_scores)),
g as (select unnest({_POWERS}::double[]) p),
y as (select feature, p, x, case when p = 0 then ln(1 + x) else (pow(x + 1, p) - 1) / p end y from v, g)
select feature, p "power", round(-count(*) / 2e0 * ln(var_pop(y)) + (p - 1) * sum(ln(1 + x)), 2) log_likelihood from y group by feature, p""")
def _(t):
    long = t.labelled_scores.unpivot([], FEATURES[3:], "feature", "value")
    powers = t.spark.createDataFrame([(f, p) for f in FEATURES[3:] for p in _POWERS], "feature string, power double")
    return rounded(s.power_likelihoods(long, powers), 2)


def _power_search_sql(rows, features, low=-2.0, high=4.0, points=25, rounds=3):
    """CTEs up to ``chosen`` (feature, p): the likelihood's best power, on a grid that is narrowed around the best of the last one."""
    values = " union all ".join(f"select '{f}' feature, {f}::double x from {rows}" for f in features)
    up = "case when abs(p) < 1e-12 then ln(1 + x) else (pow(x + 1, p) - 1) / p end"
    down = "case when abs(p - 2) < 1e-12 then -ln(1 - x) else -(pow(1 - x, 2 - p) - 1) / (2 - p) end"
    step = (high - low) / (points - 1)
    out = [f"power_values as materialized ({values})", f"g0 as (select feature, {low}::double + {step!r}::double * i p from (select distinct feature from power_values), (select unnest(range({points})) i))"]
    for r in range(rounds):
        best = "chosen" if r == rounds - 1 else f"best{r}"
        out.append(f"""{best} as materialized (
  select feature, arg_max(p, score) p from (
    select feature, p, -count(*) / 2e0 * ln(var_pop(case when x >= 0 then {up} else {down} end)) + (p - 1) * sum(sign(x) * ln(1 + abs(x))) score
    from power_values join g{r} using (feature) group by 1, 2) group by 1
)""")
        if r < rounds - 1:
            out.append(f"g{r + 1} as (select feature, p - {step!r}::double + {2 * step / (points - 1)!r}::double * i p from {best}, (select unnest(range({points})) i))")
            step = 2 * step / (points - 1)
    return ",\n".join(out)


_SHAPED = lambda f: f"case when abs(p_{f}) < 1e-12 then ln(1 + {f}) else (pow({f} + 1, p_{f}) - 1) / p_{f} end"  # quality values are not negative


@query("m2_quality_transform", f"""
with {_SPLIT}, train as (select * from split where split = 'train'), {_power_search_sql('train', FEATURES[3:])},
powers as (select {", ".join(f"max(p) filter (where feature = '{f}') p_{f}" for f in FEATURES[3:])} from chosen),
shaped as (select request_id, split, {", ".join(f"{_SHAPED(f)} {f}" for f in FEATURES[3:])} from split, powers),
limits as (select {", ".join(f"min({f}) lo_{f}, max({f}) hi_{f}" for f in FEATURES[3:])} from shaped where split = 'train')
select request_id, {", ".join(f"round(greatest(0, least(1, ({f} - lo_{f}) / (hi_{f} - lo_{f}))), 6) {f}" for f in FEATURES[3:])} from shaped, limits""")
def _(t):
    rows = cut_lineage(split_rows(t), "split")
    powers = s.fit_power(rows.where(F.col("split") == "train"))
    shaped = s.apply_power(rows.select("request_id", "split", *FEATURES[3:]), powers)
    limits = s.fit_min_max(shaped.where(F.col("split") == "train"), FEATURES[3:])
    return rounded(s.apply_min_max(shaped.drop("split"), limits, FEATURES[3:]))


_COARSE = {f: 5 for f in FEATURES} | {"liveness_score": 0.05, "ocr_confidence_score": 0.05, "blur_score": 50}
_COARSE_SQL = ", ".join(f"round({f} / {w}) {f}_r" for f, w in _COARSE.items())


def coarse(rows):
    """All six features in wide steps, so that the sparse test table holds equal vectors."""
    return rows.select(*[c for c in rows.columns if c not in FEATURES], *[F.round(F.col(f) / w).alias(f"{f}_r") for f, w in _COARSE.items()])


@query("m3_duplicate_audit", f"""
select coalesce(sum(n - 1), 0)::bigint duplicates, count(*) filter (where k > 1) conflicts, sum(n)::bigint n_rows
from (select count(*) n, count(distinct target) k from (select target, {_COARSE_SQL} from labelled_scores)
      group by {", ".join(f"{f}_r" for f in FEATURES)})""")
def _(t):
    from veriframe.operators.dashboards import duplicate_vectors

    return duplicate_vectors(coarse(t.labelled_scores).select("target", *[f"{f}_r" for f in FEATURES]), [f"{f}_r" for f in FEATURES])


@query("m4_near_duplicate_pairs", """
with z as (select request_id, face_match_score / 100 / 0.1e0 z0, liveness_score / 100 / 0.001e0 z1, ocr_confidence_score / 100 / 0.001e0 z2,
    ln(1 + blur_score / 4000) / 0.01e0 z3, brightness_score / 200 / 0.1e0 z4, contrast_score / 150 / 0.1e0 z5 from verification_scores)
select count(*) pairs from z a join z b on a.request_id < b.request_id and abs(a.z0 - b.z0) <= 1 and abs(a.z1 - b.z1) <= 1 and abs(a.z2 - b.z2) <= 1
   and abs(a.z3 - b.z3) <= 1 and abs(a.z4 - b.z4) <= 1 and abs(a.z5 - b.z5) <= 1""")
def _(t):
    return neighbours.near_duplicate_pairs(shrunk(t)).agg(F.sum("pairs").alias("pairs"))


def shrunk(t):
    """Scores drawn together by fixed factors, so that the sparse test table has near neighbours."""
    return t.verification_scores.select(
        (F.col("face_match_score") / 100).alias("face_match_score"), (F.col("liveness_score") / 100).alias("liveness_score"),
        (F.col("ocr_confidence_score") / 100).alias("ocr_confidence_score"), (F.col("blur_score") / 4000).alias("blur_score"),
        (F.col("brightness_score") / 200).alias("brightness_score"), (F.col("contrast_score") / 150).alias("contrast_score"))


@query("c7_range_neighbour_join", """
with z as (select request_id, face_match_score / 0.1e0 z0, liveness_score / 0.001e0 z1, ocr_confidence_score / 0.001e0 z2,
    ln(1 + blur_score) / 0.01e0 z3, brightness_score / 0.1e0 z4, contrast_score / 0.1e0 z5 from verification_scores)
select count(*) pairs from z a join z b on a.request_id < b.request_id and abs(a.z0 - b.z0) <= 1 and abs(a.z1 - b.z1) <= 1 and abs(a.z2 - b.z2) <= 1
   and abs(a.z3 - b.z3) <= 1 and abs(a.z4 - b.z4) <= 1 and abs(a.z5 - b.z5) <= 1""")
def _(t):
    return neighbours.near_duplicate_pairs(t.verification_scores).agg(F.sum("pairs").alias("pairs"))


@query("m4_nearest_distance_quantiles", """
with z as (select request_id, face_match_score / 100 / 0.1e0 z0, liveness_score / 100 / 0.001e0 z1, ocr_confidence_score / 100 / 0.001e0 z2,
    ln(1 + blur_score / 4000) / 0.01e0 z3, brightness_score / 200 / 0.1e0 z4, contrast_score / 150 / 0.1e0 z5 from verification_scores),
d as (select a.request_id, min(greatest(abs(a.z0 - b.z0), abs(a.z1 - b.z1), abs(a.z2 - b.z2), abs(a.z3 - b.z3), abs(a.z4 - b.z4), abs(a.z5 - b.z5))) dist
      from z a join z b on a.request_id <> b.request_id group by 1)
select round(quantile_cont(dist, 0), 6) "min", round(quantile_cont(dist, 0.01), 6) p01, round(quantile_cont(dist, 0.5), 6) p50 from d""")
def _(t):
    return rounded(neighbours.nearest_distance_quantiles(shrunk(t)))


@query("m5_stratified_split", f"with {_SPLIT} select request_id, target, split from split")
def _(t):
    return split_rows(t).select("request_id", "target", "split")


@query("h4_cross_split_leakage", f"""
with {_SPLIT}, k as (select bool_or(split = 'train') tr, bool_or(split = 'validation') va, bool_or(split = 'test') te
   from (select split, {_COARSE_SQL} from split) group by {", ".join(f"{f}_r" for f in FEATURES)})
select count(*) filter (where tr and te) train_test, count(*) filter (where tr and va) train_validation, count(*) filter (where va and te) validation_test from k""")
def _(t):
    return split_crossings(coarse(split_rows(t)).select("split", *[f"{f}_r" for f in FEATURES]), "split", [f"{f}_r" for f in FEATURES])


_TRAIN_SQL = f"{_SPLIT}, train as (select * from split where split = 'train')"
_SIGNAL_TREES = [(fold, 1, i) for i in range(len(FEATURES)) for fold in range(5)]
_GRID_TREES = [(fold, leaf, None) for leaf in (5, 20, 50) for fold in range(5)]
_DEPTHS = (3, 5, 8, trees.UNLIMITED_DEPTH)


@query("m6_single_feature_signal", f"""
with {_TRAIN_SQL}, {growth_sql('train', _SIGNAL_TREES, 3)}, {held_out_sql([3])}
select case only_f {' '.join(f"when {i} then '{f}'" for i, f in enumerate(FEATURES))} end feature, round(avg(macro_f1), 6) macro_f1 from f1 join specs using (tree) group by 1""")
def _(t):
    return rounded(trees.single_feature_signal(split_rows(t).where(F.col("split") == "train"), "request_id"))


@query("m7_tree_grid", f"""
with {_TRAIN_SQL}, {growth_sql('train', _GRID_TREES, max(_DEPTHS))}, {held_out_sql(_DEPTHS)}
select max_depth, min_leaf, round(avg(macro_f1), 6) macro_f1 from f1 join specs using (tree) group by 1, 2""")
def _(t):
    return rounded(trees.tune_tree(split_rows(t).where(F.col("split") == "train").drop("split"), "request_id", _DEPTHS))


@query("m8_margin_model")
def _(t):
    rows = cut_lineage(split_rows(t), "split")
    train = rows.where(F.col("split") == "train")
    best = margins.tune_margin_model(train, "request_id").first()
    model = margins.fit_margin_model(train, best["cost"], best["gamma"])
    scored = margins.predict_margins(model, rows.where(F.col("split") == "test"))
    return e.summary(e.confusion_cells(scored)).withColumn("cost", F.lit(best["cost"])).withColumn("gamma", F.lit(best["gamma"]))


_LEVELS = [i / 10 for i in range(1, 10)]
_KERNEL_SQL = f"""{_SPLIT}, {_SCALED},
sv as (""" + " union all ".join(
    f"select target, {lv} lv, {', '.join(f'quantile_cont({f}, {lv}) {f}' for f in FEATURES)} from scaled where split = 'train' group by target" for lv in _LEVELS) + f"""),
k as (select x.request_id, v.target, exp(-({' + '.join(f'pow(x.{f} - v.{f}, 2)' for f in FEATURES)})) kv from scaled x cross join sv v),
dv as (select request_id, sum(case target when 'Verified' then kv when 'Manual Review' then -kv else 0 end) d0,
     sum(case target when 'Verified' then kv when 'Rejected' then -kv else 0 end) d1, sum(case target when 'Manual Review' then kv when 'Rejected' then -kv else 0 end) d2 from k group by 1),
r as (select request_id, 1 / (1 + exp(-d0)) r01, 1 / (1 + exp(-d1)) r02, 1 / (1 + exp(-d2)) r12 from dv),
q as (select request_id, (1-r01)*(1-r01)+(1-r02)*(1-r02) a, r01*r01+(1-r12)*(1-r12) b, r02*r02+r12*r12 c, -(1-r01)*r01 d, -(1-r02)*r02 e, -(1-r12)*r12 f from r),
w as (select request_id, b*c-f*f + e*f-d*c + d*f-b*e w0, e*f-d*c + a*c-e*e + d*e-a*f w1, d*f-b*e + d*e-a*f + a*b-d*d w2 from q)"""


@query("m9_kernel_scoring", f"""
with {_KERNEL_SQL}
select request_id, round(w0 / (w0 + w1 + w2), 6) p_verified, round(w1 / (w0 + w1 + w2), 6) p_review, round(w2 / (w0 + w1 + w2), 6) p_rejected from w""")
def _(t):
    rows = scaled_rows(t)
    model = kernels.prototype_model(rows.where(F.col("split") == "train"))
    return rounded(kernels.score_with_kernel(rows.select("request_id", *FEATURES), model).select("request_id", "p_verified", "p_review", "p_rejected"))


_TEMPERATURES = [0.5, 0.75, 1.0, 1.25, 1.5, 2.0, 3.0]


@query("m10_temperature_losses", f"""
with g as (select unnest({_TEMPERATURES}::double[]) temperature),
x as (select candidate, temperature, target, pow(p_verified, 1 / temperature) v, pow(p_review, 1 / temperature) r, pow(p_rejected, 1 / temperature) j
      from class_probabilities, g)
select candidate, temperature, round(avg(-ln(greatest(2.220446049250313e-16, case target when 'Verified' then v when 'Manual Review' then r else j end / (v + r + j)))), 6) log_loss,
       round(avg(pow(v / (v + r + j) - (target = 'Verified')::int, 2) + pow(r / (v + r + j) - (target = 'Manual Review')::int, 2) + pow(j / (v + r + j) - (target = 'Rejected')::int, 2)), 6) brier
from x group by 1, 2""")
def _(t):
    return rounded(s.temperature_losses(t.class_probabilities, _TEMPERATURES, ["candidate"]))


def _margin_sql(p):
    """A margin of the test table: the logarithm in steps of a fiftieth."""
    return f"floor(ln({p}) * 50) / 50e0"


_HALVES = f"""halves as (
  select candidate, target, {", ".join(f"{_margin_sql(f'p_{k}')} m_{k}" for k in CLASS_KEYS)},
    row_number() over (partition by candidate, target order by md5(concat(cast(request_id as varchar), ':42')), request_id) <= floor(count(*) over (partition by candidate, target) * 0.5e0 + 0.5e0) fit
  from class_probabilities), held as materialized (select * from halves where fit), rest as materialized (select * from halves where not fit)"""


@query("m10_fitted_calibration", f"""
with {_HALVES}, {calibration_sql('held', 'rest')}
select candidate, "method", round(avg(-ln(greatest(2.220446049250313e-16, case target when 'Verified' then p_verified when 'Manual Review' then p_review else p_rejected end))), 6) log_loss,
  round(avg(pow(p_verified - (target = 'Verified')::int, 2) + pow(p_review - (target = 'Manual Review')::int, 2) + pow(p_rejected - (target = 'Rejected')::int, 2)), 6) brier
from calibrated group by 1, 2""")
def _(t):
    rows = t.class_probabilities.selectExpr("request_id", "candidate", "target", *[f"floor(ln(p_{k}) * 50) / 50D as m_{k}" for k in CLASS_KEYS], "concat(candidate, ':', target) as stratum")
    parts = cut_lineage(s.stratified_split(rows, "request_id", target="stratum", parts=(("calibration", 0.5), ("selection", 1.0))), "calibration-halves")
    held, rest = (parts.where(F.col("split") == name).drop("split", "stratum") for name in ("calibration", "selection"))
    scores = [e.calibration_scores(scored, ["candidate"]).select("candidate", F.lit(method).alias("method"), "log_loss", "brier") for method, scored in calibration.calibrate(held, rest).items()]
    return rounded(scores[0].unionByName(scores[1]).unionByName(scores[2]))


def _policy_sql(w, th, m):
    label = f"case when p_review * {w} >= p_rejected and p_review * {w} >= p_verified then 'Manual Review' when p_rejected >= p_verified then 'Rejected' else 'Verified' end"
    return f"case when {label} = 'Verified' and (p_verified < {th} or p_verified - greatest(p_review, p_rejected) < {m}) then 'Manual Review' else {label} end"


@query("m11_decision_policy", f"""
select request_id, candidate, {_policy_sql('1.25e0', '0.5e0', '0.1e0')} label from class_probabilities""")
def _(t):
    return t.class_probabilities.select("request_id", "candidate", s.decide_policy(1.25, 0.5, 0.1).alias("label"))


def _metric_sql(keys):
    """Checking SQL for the metric summary of ``cells`` (one column per confusion cell)."""
    f1 = [f"coalesce(2e0 * n{i}{i} / nullif({' + '.join([f'n{i}{j}' for j in range(3)] + [f'n{j}{i}' for j in range(3)])}, 0), 0)" for i in range(3)]
    support = [f"(n{i}0 + n{i}1 + n{i}2)" for i in range(3)]
    total = " + ".join(support)
    weighted = " + ".join(f"{f} * {n}" for f, n in zip(f1, support))
    return f"""select {keys}, ({total})::bigint n, round((n00 + n11 + n22) / ({total})::double, 6) accuracy, round(({' + '.join(f1)}) / 3, 6) macro_f1,
       round(({weighted}) / ({total}), 6) weighted_f1, n20 rejected_to_verified, n10 review_to_verified, round(n11 / (n10 + n11 + n12)::double, 6) review_recall"""


_CELL_SQL = ", ".join(f"count(*) filter (where target = '{CLASSES[i]}' and predicted = '{CLASSES[j]}') n{i}{j}" for i in range(3) for j in range(3))


_SWEEP = f"""
grid as (select 'probability' policy, w, th, mg from (values (1e0), (1.25e0), (1.5e0), (2e0)) a(w), (values (0e0), (0.5e0), (0.6e0), (0.7e0), (0.8e0)) b(th), (values (0e0), (0.1e0)) c(mg)
         union all select 'native', 1e0, 0e0, 0e0),
crossed as (select candidate, policy, w, th, mg, target, case when policy = 'native' then native_label else {_policy_sql('w', 'th', 'mg')} end predicted from class_probabilities, grid),
cells as (select candidate, policy, w review_multiplier, th verified_threshold, mg verified_margin, {_CELL_SQL} from crossed group by all)"""


@query("c10_policy_cross_join", f"with {_SWEEP} select candidate, policy, review_multiplier, verified_threshold, verified_margin, n00 + n10 + n20 predicted_verified from cells")
def _(t):
    crossed = t.class_probabilities.crossJoin(F.broadcast(s.policy_grid(t.spark)))
    label = F.when(F.col("policy") == "native", F.col("native_label")).otherwise(
        s.decide_policy(F.col("review_multiplier"), F.col("verified_threshold"), F.col("verified_margin")))
    return crossed.groupBy(*s.POLICY_KEYS).agg(F.count_if(label == "Verified").alias("predicted_verified"))


@query("m12_policy_sweep", f"""
with {_SWEEP},
table1 as ({_metric_sql('candidate, policy, review_multiplier, verified_threshold, verified_margin')} from cells),
loss as (select candidate, round(avg(-ln(case target when 'Verified' then p_verified when 'Manual Review' then p_review else p_rejected end)), 6) log_loss from class_probabilities group by 1),
base as (select * from table1 where candidate = 'raw_native_sigmoid' and policy = 'probability' and review_multiplier = 1 and verified_threshold = 0 and verified_margin = 0)
select t.*, l.log_loss, t.macro_f1 >= b.macro_f1 - 1e-12 and t.rejected_to_verified <= b.rejected_to_verified and t.review_to_verified <= b.review_to_verified
       and t.review_recall >= b.review_recall - 1e-12 eligible
from table1 t join loss l on l.candidate = t.candidate cross join base b""")
def _(t):
    return rounded(s.sweep_policies(t.class_probabilities))


@query("m13_metrics", f"with {_PRED}, cells as (select {_CELL_SQL} from pred) {_metric_sql('1 one')} from cells")
def _(t):
    return rounded(e.summary(e.confusion_cells(predictions(t))).select(F.lit(1).alias("one"), "*"))


@query("m13_per_class", f"""
with {_PRED}, c as (select unnest(['Verified', 'Manual Review', 'Rejected']) "class"),
x as (select c."class", count(*) filter (where target = c."class" and predicted = c."class") tp, count(*) filter (where predicted = c."class") pp, count(*) filter (where target = c."class") ap from pred, c group by 1)
select "class", round(coalesce(tp / nullif(pp, 0)::double, 0), 6) "precision", round(tp / ap::double, 6) recall, round(2e0 * tp / (pp + ap), 6) f1, ap support from x""")
def _(t):
    return rounded(e.per_class(e.confusion_cells(predictions(t))))


@query("m13_confusion_matrix", f"""
with {_PRED}, c as (select unnest(['Verified', 'Manual Review', 'Rejected']) k)
select a.k actual, b.k predicted, (select count(*) from pred where target = a.k and pred.predicted = b.k) n from c a, c b""")
def _(t):
    return e.confusion_matrix(e.confusion_cells(predictions(t)))


@query("m14_calibration_scores", """
select candidate, round(avg(-ln(case target when 'Verified' then p_verified when 'Manual Review' then p_review else p_rejected end)), 6) log_loss,
  round(avg(pow(p_verified - (target = 'Verified')::int, 2) + pow(p_review - (target = 'Manual Review')::int, 2) + pow(p_rejected - (target = 'Rejected')::int, 2)), 6) brier
from class_probabilities group by 1""")
def _(t):
    return rounded(e.calibration_scores(t.class_probabilities, ["candidate"]))


_BINS = "with l as (" + " union all ".join(
    f"select candidate, '{c}' \"class\", p_{k} p, (target = '{c}')::int hit from class_probabilities" for k, c in CLASS_OF_KEY.items()) + f"""),
bins as (select candidate, "class", least(9, len(list_filter({e.BIN_EDGES}::double[], lambda x: x <= p)) - 1) bin, count(*) n, avg(p) mean_probability, avg(hit) observed_fraction
 from l group by all)"""


@query("m14_reliability_bins", _BINS + ' select candidate, "class", bin, n, round(mean_probability, 6) mean_probability, round(observed_fraction, 6) observed_fraction from bins')
def _(t):
    return rounded(e.reliability_bins(t.class_probabilities, ["candidate"]))


@query("m14_calibration_error", _BINS + ' select candidate, "class", round(sum(n * abs(mean_probability - observed_fraction)) / sum(n), 6) ece from bins group by all')
def _(t):
    return rounded(e.calibration_error(e.reliability_bins(t.class_probabilities, ["candidate"]), ["candidate"]))


_UNIFORM, _LARGE = e.bootstrap_draw_sql("d1", "d2", "n", lambda d: f"('0x' || substr({d}, 1, 13))::bigint")
_CODE = lambda c: f"case {c} when 'Verified' then 0 when 'Manual Review' then 1 else 2 end"
_DRAWN_F1 = lambda p: "(" + " + ".join(
    f"coalesce(2 * sum(case when a = {c} and {p} = {c} then m else 0 end) / nullif(sum(case when a = {c} then m else 0 end) + sum(case when {p} = {c} then m else 0 end), 0), 0)" for c in range(3)) + ") / 3"


@query("m15_paired_bootstrap", f"""
with cells as (select candidate, {_CODE('target')} a, {_CODE('native_label')} f, {_CODE(_policy_sql('1e0', '0e0', '0e0'))} s, count(*) n from class_probabilities group by all),
steps(small, k, c) as (values {", ".join(f"({n}, {k}, {c!r}::double)" for n, k, c in e.poisson_steps())}),
lists as (select small, list(c order by c) steps from steps group by 1),
digests as (select *, md5(concat_ws(':', 42, repeat, 9 * a + 3 * f + s, 1)) d1, md5(concat_ws(':', 42, repeat, 9 * a + 3 * f + s, 2)) d2 from cells, (select unnest(range(1000)) repeat)),
drawn as (select candidate, repeat, a, f, s, case when n < {e.SMALL_CELL} then len([c for c in steps if c <= {_UNIFORM}])::double else {_LARGE} end m from digests left join lists on small = n),
each as (select candidate, repeat, coalesce((sum(case when a = f then m else 0 end) - sum(case when a = s then m else 0 end)) / nullif(sum(m), 0), 0) acc, {_DRAWN_F1('f')} - {_DRAWN_F1('s')} f1 from drawn group by 1, 2)
select candidate, round(quantile_cont(acc, 0.025), 6) accuracy_difference_low, round(quantile_cont(acc, 0.975), 6) accuracy_difference_high,
  round(quantile_cont(f1, 0.025), 6) macro_f1_difference_low, round(quantile_cont(f1, 0.975), 6) macro_f1_difference_high, count(*) repeats from each group by 1""")
def _(t):
    rows = t.class_probabilities.withColumn("argmax", s.decide_policy(1.0, 0.0, 0.0))
    return rounded(e.paired_bootstrap(rows, "target", "native_label", "argmax", ["candidate"]))


@query("m16_permutation_importance", f"""
with h as (select *, row_number() over (order by md5(concat('home:', cast(request_id as varchar))), request_id) k from labelled_scores),
a as (select rep, {', '.join(f'{f} s_{f}' for f in FEATURES)}, row_number() over (partition by rep order by md5(concat(rep, ':', request_id)), request_id) k
      from labelled_scores, (select unnest(range(20)) rep)),
p as (select a.rep, h.target, h.{', h.'.join(FEATURES)}, {', '.join(f's_{f}' for f in FEATURES)} from h join a on a.k = h.k),
pr as (""" + " union all ".join(
    f"select '{f}' feature, rep, target, {_LABEL_SQL} predicted from (select rep, target, {', '.join(f's_{x} {x}' if x == f else x for x in FEATURES)} from p)" for f in FEATURES) + f"""),
cells as (select feature, rep, {_CELL_SQL} from pr group by 1, 2), {_PRED}, base as (select {_CELL_SQL} from pred),
m as ({_metric_sql('feature, rep').replace(', 6) macro_f1', ', 15) macro_f1')} from cells), mb as ({_metric_sql('1 one').replace(', 6) macro_f1', ', 15) macro_f1')} from base)
select feature, round(avg(mb.macro_f1 - m.macro_f1), 6) importance, round(stddev_pop(mb.macro_f1 - m.macro_f1), 6) std from m, mb group by 1""")
def _(t):
    return rounded(e.permutation_importance(t.labelled_scores, "request_id", threshold_label, repeats=20))


@query("m17_tree_importance", f"""
with {_TRAIN_SQL}, {growth_sql('train', [(-1, 20, None)], 5, folds=1)},
names(i, name) as (values {', '.join(f"({i}, '{f}')" for i, f in enumerate(FEATURES))})
select name feature, round(coalesce(sum(gain), 0) / (select sum(gain) from nodes), 6) importance from names left join nodes on feature = i group by 1""")
def _(t):
    return rounded(trees.tree_importances(trees.fit_tree(split_rows(t).where(F.col("split") == "train").drop("split"), 5, 20)))


_TWO = f"""{_PRED}, native as (select target, native_label predicted from class_probabilities where candidate = 'raw_native_isotonic'),
c1 as (select {_CELL_SQL} from native), c2 as (select {_CELL_SQL} from pred), a as ({_metric_sql('1 one')} from c1), b as ({_metric_sql('1 one')} from c2)"""


@query("m18_release_gate", f"""
with {_TWO}
select a.accuracy new_accuracy, a.macro_f1 new_macro_f1, b.accuracy old_accuracy, b.macro_f1 old_macro_f1,
  a.accuracy > b.accuracy and a.macro_f1 >= b.macro_f1 and a.rejected_to_verified <= b.rejected_to_verified and a.review_to_verified <= b.review_to_verified promoted from a, b""")
def _(t):
    native = t.class_probabilities.where(F.col("candidate") == "raw_native_isotonic").withColumn("predicted", F.col("native_label"))
    gate = e.release_gate(e.summary(e.confusion_cells(native)), e.summary(e.confusion_cells(predictions(t))))
    return rounded(gate.select("new_accuracy", "new_macro_f1", "old_accuracy", "old_macro_f1", "promoted"))


_BAND = "case when face_match_score < 25 then 'below_25' when face_match_score <= 50 then '25_through_50' else 'above_50' end band"


@query("m19_slice_comparison", f"""
with {_PRED}, x as (select 'strong_evidence' slice, * from pred where liveness_score >= 0.9 and ocr_confidence_score >= 0.9
   union all select 'conflicting', * from pred where face_match_score > 50 and (liveness_score < 0.25 or ocr_confidence_score < 0.25))
select slice, {_BAND}, count(*) filter (where predicted = 'Verified') verified, count(*) filter (where predicted = 'Manual Review') review,
       count(*) filter (where predicted = 'Rejected') rejected from x group by 1, 2""")
def _(t):
    return e.band_counts(predictions(t), {"strong_evidence": e.strong_evidence(), "conflicting": e.conflicting_evidence()})


def _profiles(rows):
    return "(values " + ", ".join(f"({a}e0, {b}e0, {c}e0)" for a, b, c in rows) + ") q(b, br, c)"


_PROBE_SQL = _KERNEL_SQL.replace("\nk as (", f"""
probe0 as (select row_number() over () request_id, grid, face, 1e0 live, 1e0 ocr, b, br, c from (
   select 'perfect_evidence' grid, f::double face, b, br, c from range(0, 101) r(f), {_profiles(e.PROBE_QUALITY)}
   union all select 'new_profiles', f + 0.5e0, b, br, c from range(0, 100) r(f), {_profiles(e.UNSEEN_QUALITY)})),
probe as (select request_id, grid, face, """ + ", ".join(
    f"greatest(0, least(1, ({c} - lo_{f}) / (hi_{f} - lo_{f}))) {f}" for c, f in zip(("face", "live", "ocr", "b", "br", "c"), FEATURES)) + """ from probe0, limits),
k as (""").replace("from scaled x cross join sv v", "from probe x cross join sv v")


@query("m19_probe_bands", f"""
with {_PROBE_SQL}
select grid slice, case when face < 25 then 'below_25' when face <= 50 then '25_through_50' else 'above_50' end band,
   count(*) filter (where w0 >= w1 and w0 >= w2) verified, count(*) filter (where not (w0 >= w1 and w0 >= w2) and w1 >= w2) review,
   count(*) filter (where not (w0 >= w1 and w0 >= w2) and w1 < w2) rejected from w join probe p on p.request_id = w.request_id group by 1, 2""")
def _(t):
    rows = split_rows(t)
    train = rows.where(F.col("split") == "train")
    limits = s.fit_min_max(train)
    model = kernels.prototype_model(s.apply_min_max(train, limits))
    grid = e.probe_grid(t.spark)
    scaled = s.apply_min_max(grid.select("*", F.col("face_match_score").alias("face")), limits)
    scored = kernels.score_with_kernel(scaled, model).drop("face_match_score").withColumnRenamed("face", "face_match_score")
    return e.band_counts(scored, {g: F.col("grid") == g for g in ("perfect_evidence", "new_profiles")})


@query("m20_threshold_baseline", f"with {_PRED}, cells as (select {_CELL_SQL} from pred) select * from cells")
def _(t):
    cells = e.confusion_cells(predictions(t))
    return cells.select(*[F.col(c).alias(c.replace("_", "")) for c in cells.columns])


@query("m21_class_weights", """
select request_id, round(count(*) over () / (3e0 * count(*) over (partition by target)), 6) weight from labelled_scores""")
def _(t):
    return rounded(s.class_weights(t.labelled_scores).select("request_id", "weight"))


@query("a8_model_report", f"""
with {_PRED},
x as (select 'thresholds' model, case when blur_score < 100 then 'soft' else 'sharp' end population, target, predicted from pred
   union all select 'candidate', case when p.blur_score < 100 then 'soft' else 'sharp' end, c.target, c.native_label from class_probabilities c join pred p on p.request_id = c.request_id
   where c.candidate = 'power_native_sigmoid'),
cells as (select model, population, {_CELL_SQL} from x group by 1, 2)
{_metric_sql('model, population').replace('bigint n,', 'bigint cases,')}, n00 + n11 + n22 correct_predictions from cells""")
def _(t):
    population = F.when(F.col("blur_score") < 100, "soft").otherwise("sharp").alias("population")
    base = predictions(t).select("request_id", "target", "predicted", population)
    other = t.class_probabilities.where(F.col("candidate") == "power_native_sigmoid").select("request_id", F.col("native_label").alias("predicted"))
    rows = base.select(F.lit("thresholds").alias("model"), "population", "target", "predicted").unionByName(
        base.drop("predicted").join(other, "request_id").select(F.lit("candidate").alias("model"), "population", "target", "predicted"))
    return rounded(e.model_report(e.confusion_cells(rows, ["model", "population"])))
