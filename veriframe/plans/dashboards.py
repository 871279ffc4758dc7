"""Registered queries: dashboards and statistics (G), vectors (L)."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from veriframe.operators import dashboards as g
from veriframe.operators import vectors
from veriframe.operators.decisions import decide_by_threshold
from veriframe.plans.decisions import DECISION_SQL
from veriframe.plans.directory import _LATEST
from veriframe.registry import query
from veriframe.schemas import FEATURES


def rounded(rows, digits=6):
    """Doubles rounded for comparison between engines."""
    return rows.select(*[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in rows.dtypes])


@query("g1_decisions_by_status", f"""
with {_LATEST}, decided as (select request_id, {DECISION_SQL} final_decision from verification_scores)
select coalesce(l.status, 'pending') latest_status, count(*) requests, count(*) filter (where final_decision = 'verified') verified,
       count(*) filter (where final_decision = 'review') review, count(*) filter (where final_decision = 'rejected') rejected
from verification_requests r join decided d on d.request_id = r.request_id join agents a on a.agent_id = r.agent_id
     left join latest l on l.agent_id = r.agent_id group by 1""")
def _(t):
    return g.decisions_by_status(t.agents, t.verification_requests, t.verification_scores, decide_by_threshold)


_TODAY = "1999-03-10"


@query("g1_dashboard_counters", f"""
select (select count(*) from agents) total_agents, count(*) filter (where status = 'pending') pending_verification,
       count(*) filter (where status = 'review') awaiting_review, count(*) filter (where status = 'verified') verified,
       count(*) filter (where status = 'rejected') rejected, count(*) filter (where created_at >= date '{_TODAY}') today_submissions,
       count(*) filter (where created_at >= date '{_TODAY}' and status = 'verified') verified_today,
       count(*) filter (where created_at >= date '{_TODAY}' and status = 'rejected') rejected_today from verification_requests""")
def _(t):
    return g.dashboard_counters(t.agents, t.verification_requests, f"{_TODAY} 15:30:00")


@query("g2_reconciliation", """
select (select count(*) from verification_requests) request_count, (select count(distinct agent_id) from verification_requests) unique_agents,
  (select count(*) from verification_scores) score_count, (select count(*) from kyc_decisions) decision_count,
  (select min(created_at) from verification_requests) first_request, (select max(created_at) from verification_requests) last_request,
  (select min(decided_at) from kyc_decisions) first_decision, (select max(decided_at) from kyc_decisions) last_decision,
  (select count(*) from verification_requests where request_id not in (select request_id from kyc_decisions)) requests_without_decisions,
  (select bool_and(request_id in (select request_id from verification_scores)) from verification_requests) all_requests_have_scores,
  (select count(*) from kyc_decisions where request_id not in (select request_id from verification_requests)) orphan_decisions,
  (select count(*) from kyc_decisions d join verification_requests r on r.request_id = d.request_id where d.final_decision = r.status) status_matches,
  (select count(*) from verification_scores where face_match_score = 0 and liveness_score = 0 and ocr_confidence_score = 0 and blur_score = 0 and brightness_score = 0 and contrast_score = 0) zero_score_rows,
  (select count(*) from verification_scores where not (face_match_score = 0 and liveness_score = 0 and ocr_confidence_score = 0 and blur_score = 0 and brightness_score = 0 and contrast_score = 0)) nonzero_score_rows,
  (select bool_and(abs(verified_probability + review_probability + rejected_probability - 1) < 1e-5) from kyc_decisions) probability_sums_valid""")
def _(t):
    return g.reconciliation(t.verification_requests, t.verification_scores, t.kyc_decisions)


@query("g2_counts_by_value", """
select 'request_status' field, status "value", count(*) n from verification_requests group by status
union all select 'decision_status', final_decision, count(*) from kyc_decisions group by final_decision
union all select 'decision_basis', decision_basis, count(*) from kyc_decisions group by decision_basis""")
def _(t):
    return g.counts_by_value(t.verification_requests, t.kyc_decisions)


def _describe_sql(value, extremes=False):
    extra = f", round(min({value}), 4) \"min\", round(max({value}), 4) \"max\"" if extremes else ""
    levels = ", ".join(f"round(quantile_cont({value}, {p}), 4) {n}" for n, p in g.PERCENTILES.items())
    return f"count({value}) n, round(avg({value}), 4) mean, round(stddev_samp({value}), 4) std{extra}, {levels}"


_LONG = "(" + " union all ".join(f"select target, '{f}' feature, {f} v from labelled_scores" for f in FEATURES) + ")"


@query("g3_describe_by_group", f"""
select coalesce(document_kind, 'none') kind, {_describe_sql('document_blur')} from quality_measurements group by 1""")
def _(t):
    rows = t.quality_measurements.withColumn("kind", F.coalesce("document_kind", F.lit("none")))
    return g.describe(rows, ["kind"], "document_blur")


@query("g4_describe_by_class", f"select target, feature, {_describe_sql('v', True)} from {_LONG} group by target, feature")
def _(t):
    return g.describe_by_class(t.labelled_scores)


@query("g5_central_overlap", f"""
with stats as (select target, case target when 'Verified' then 0 when 'Manual Review' then 1 else 2 end k, feature,
    quantile_cont(v, 0.05) p05, quantile_cont(v, 0.95) p95 from {_LONG} group by target, feature)
select a.feature, a.target class_a, b.target class_b, round(case when least(a.p95, b.p95) >= greatest(a.p05, b.p05) then greatest(a.p05, b.p05) end, 6) low,
       round(case when least(a.p95, b.p95) >= greatest(a.p05, b.p05) then least(a.p95, b.p95) end, 6) high
from stats a join stats b on a.feature = b.feature and a.k < b.k""")
def _(t):
    return rounded(g.central_overlap(t.labelled_scores))


@query("g6_correlations", " union all ".join(
    f"select '{a}' feature_a, '{b}' feature_b, round(corr({a}, {b}), 6) correlation from verification_scores" for a, b in combinations(FEATURES, 2)))
def _(t):
    return rounded(g.correlations(t.verification_scores))


_Q = [("log_blur", "ln(1 + blur_score)"), ("brightness", "brightness_score"), ("contrast", "contrast_score")]


@query("g6_quality_covariance", " union all ".join(
    f"select '{a}' a, '{b}' b, round(covar_samp({ea}, {eb}), 5) covariance, round(avg({ea}), 5) mean_a, round(avg({eb}), 5) mean_b from verification_scores"
    for i, (a, ea) in enumerate(_Q) for b, eb in _Q[i:]))
def _(t):
    return rounded(g.quality_covariance(t.verification_scores), 5)


@query("g7_rates", """
select coalesce(document_kind, 'none') kind, count(*) n, round(avg(document_found::double), 4) rate,
       round(avg((document_blur between 20 and 60)::double) * 100, 1) percent_in_range from quality_measurements group by 1""")
def _(t):
    rows = t.quality_measurements.withColumn("kind", F.coalesce("document_kind", F.lit("none")))
    return g.rates(rows, ["kind"], "document_found", "document_blur", 20, 60)


_PAIR_SCORES = """
scored as (select p.vec_a, p.vec_b, p.pair_type, a.vec_id is not null and b.vec_id is not null faces_detected,
   coalesce(round(greatest(0, least(100, 100 * list_dot_product(a.embedding::double[], b.embedding::double[])
     / (sqrt(list_dot_product(a.embedding::double[], a.embedding::double[])) * sqrt(list_dot_product(b.embedding::double[], b.embedding::double[]))))), 4), 0) score
   from face_pairs p left join embeddings a on a.vec_id = p.vec_a left join embeddings b on b.vec_id = p.vec_b)"""


@query("g8_robust_spread", f"""
with {_PAIR_SCORES}
select round(quantile_cont(score, 0.5), 4) median, round((quantile_cont(score, 0.75) - quantile_cont(score, 0.25)) / 1.34898, 4) spread
from scored where pair_type = 'genuine' and faces_detected""")
def _(t):
    rows = vectors.score_pairs(t.face_pairs, t.embeddings)
    return rounded(g.robust_spread(rows.where((F.col("pair_type") == "genuine") & F.col("faces_detected")), "score"), 4)


@query("g9_moments", "select target, round(avg(face_match_score), 6) mean, round(stddev_samp(face_match_score), 6) std, count(*) n from labelled_scores group by 1")
def _(t):
    return rounded(g.moments(t.labelled_scores, ["target"], "face_match_score"))


@query("g9_moments_above_quantile", """
with edge as (select quantile_cont(ocr_confidence_score, 0.5) e from verification_scores)
select round(avg(ocr_confidence_score), 6) mean, round(stddev_samp(ocr_confidence_score), 6) std, count(*) n, round(max(e), 6) edge
from verification_scores, edge where ocr_confidence_score >= e""")
def _(t):
    return rounded(g.moments_above_quantile(t.verification_scores, "ocr_confidence_score", 0.5))


@query("g10_duplicate_vectors", f"""
select sum(n - 1)::bigint duplicates, count(*) filter (where k > 1) conflicts, sum(n)::bigint n_rows
from (select count(*) n, count(distinct target) k from labelled_scores group by {', '.join(FEATURES)})""")
def _(t):
    return g.duplicate_vectors(t.labelled_scores)


@query("g11_shared_component_error", """
with c as (select component, sum(mass) total, sum(mass) - max(mass) err from mixture_components group by 1)
select component, round(total / (select sum(total) from c), 6) share, round(err / (select sum(total) from c), 6) error_mass,
       round(1 - (select sum(err) / sum(total) from c), 6) accuracy_bound from c""")
def _(t):
    return rounded(g.shared_component_error(t.mixture_components))


# ---- L ---------------------------------------------------------------------------------------
@query("l1_face_match", f"with {_PAIR_SCORES} select vec_a, vec_b, score, faces_detected and score > 70 matched from scored")
def _(t):
    return vectors.score_pairs(t.face_pairs, t.embeddings).select("vec_a", "vec_b", "score", "matched")


@query("c8_pair_join", f"with {_PAIR_SCORES} select vec_a, vec_b, pair_type, faces_detected from scored")
def _(t):
    return vectors.score_pairs(t.face_pairs, t.embeddings).select("vec_a", "vec_b", "pair_type", "faces_detected")


@query("l2_similarity_summary", f"""
with {_PAIR_SCORES}
select pair_type, {_describe_sql('score')}, round(avg(faces_detected::double), 4) detected_rate from scored group by 1""")
def _(t):
    return vectors.similarity_summary(vectors.score_pairs(t.face_pairs, t.embeddings))
