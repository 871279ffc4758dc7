"""Counters, reconciliation and descriptive statistics, each in as few passes as possible."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import functions as F

from veriframe.functions.clock import at
from veriframe.operators.keyed import exact_quantiles, quantile_columns
from veriframe.schemas import CLASSES, FEATURES, FINAL_STATUSES

PERCENTILES = {"p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}


def dashboard_counters(agents, requests, now):
    """All dashboard counters from one pass over requests and one count of agents.

    "Today" counts look at the creation day of a request and its status now.
    """
    today = F.date_trunc("day", at(now))
    fresh = F.col("created_at") >= today
    is_ = lambda s: F.col("status") == s
    counts = requests.agg(
        *[F.count_if(is_(s)).alias(name) for s, name in
          (("pending", "pending_verification"), ("review", "awaiting_review"), ("verified", "verified"), ("rejected", "rejected"))],
        F.count_if(fresh).alias("today_submissions"), F.count_if(fresh & is_("verified")).alias("verified_today"),
        F.count_if(fresh & is_("rejected")).alias("rejected_today"),
    )
    return agents.agg(F.count(F.lit(1)).alias("total_agents")).crossJoin(F.broadcast(counts))  # one row each


def reconciliation(requests, scores, decisions):
    """One row: totals, date ranges, missing and orphan rows, agreement, zero scores, probability sums."""
    status = requests.select("request_id", "agent_id", "status", "created_at", F.lit(1).alias("_r"))
    decided = decisions.select("request_id", "final_decision", "decided_at", F.lit(1).alias("_d"),
                               (F.col("verified_probability") + F.col("review_probability") + F.col("rejected_probability")).alias("_p"))
    scored = scores.select("request_id", F.lit(1).alias("_s"),
                           reduce(lambda a, b: a & b, [F.col(c) == 0 for c in FEATURES]).alias("_zero"))
    rows = status.join(decided, "request_id", "full").join(scored, "request_id", "full")
    has = lambda c: F.col(c).isNotNull()
    return rows.agg(
        F.count("_r").alias("request_count"), F.countDistinct("agent_id").alias("unique_agents"), F.count("_s").alias("score_count"),
        F.count("_d").alias("decision_count"), F.min("created_at").alias("first_request"), F.max("created_at").alias("last_request"),
        F.min("decided_at").alias("first_decision"), F.max("decided_at").alias("last_decision"),
        F.count_if(has("_r") & ~has("_d")).alias("requests_without_decisions"),
        F.bool_and(has("_s") | ~has("_r")).alias("all_requests_have_scores"), F.count_if(has("_d") & ~has("_r")).alias("orphan_decisions"),
        F.count_if(F.col("final_decision") == F.col("status")).alias("status_matches"), F.count_if("_zero").alias("zero_score_rows"),
        F.count_if(~F.col("_zero")).alias("nonzero_score_rows"), F.bool_and(F.abs(F.col("_p") - 1) < 1e-5).alias("probability_sums_valid"),
    )


def counts_by_value(requests, decisions):
    """Counts of request status, decision and decision basis as (field, value, n)."""
    def part(rows, field, column):
        return rows.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(field).alias("field"), "value", "n")

    return part(requests, "request_status", "status").unionByName(part(decisions, "decision_status", "final_decision")).unionByName(
        part(decisions, "decision_basis", "decision_basis"))


def describe(rows, keys, value, extremes=False):
    """n, mean, sample deviation and exact percentiles per group, rounded to 4 digits."""
    data = rows.where(F.col(value).isNotNull() & ~F.isnan(value))
    extra = [F.round(F.min(value), 4).alias("min"), F.round(F.max(value), 4).alias("max")] if extremes else []
    moments = data.groupBy(*keys).agg(
        F.count(value).alias("n"), F.round(F.avg(value), 4).alias("mean"), F.round(F.stddev_samp(value), 4).alias("std"), *extra
    )
    levels = quantile_columns(data, keys, value, PERCENTILES)
    rounded = levels.select(*keys, *[F.round(c, 4).alias(c) for c in PERCENTILES])
    return moments.join(rounded, keys)


def long_features(rows, keys, features=FEATURES):
    """One row per feature value: (keys, feature, value)."""
    return rows.unpivot(keys, features, "feature", "value")


def describe_by_class(labelled):
    return describe(long_features(labelled, ["target"]), ["target", "feature"], "value", extremes=True)


def central_overlap(labelled, classes=CLASSES):
    """Intersection of the central 90 % ranges per feature and class pair; null when disjoint."""
    levels = quantile_columns(long_features(labelled, ["target"]), ["target", "feature"], "value", {"p05": 0.05, "p95": 0.95})
    order = F.create_map(*[x for i, c in enumerate(classes) for x in (F.lit(c), F.lit(i))])
    ranked = levels.withColumn("k", F.try_element_at(order, F.col("target")))
    a, b = ranked.alias("a"), ranked.alias("b")
    low, high = F.greatest("a.p05", "b.p05"), F.least("a.p95", "b.p95")
    # at most three rows per feature on either side
    return a.join(b, (F.col("a.feature") == F.col("b.feature")) & (F.col("a.k") < F.col("b.k"))).select(
        F.col("a.feature").alias("feature"), F.col("a.target").alias("class_a"), F.col("b.target").alias("class_b"),
        F.when(high >= low, low).alias("low"), F.when(high >= low, high).alias("high"),
    )


def correlations(rows, features=FEATURES):
    """Upper triangle of the correlation matrix from one pass."""
    pairs = list(combinations(features, 2))
    wide = rows.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    cells = [F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(f"c{i}").alias("correlation")) for i, (a, b) in enumerate(pairs)]
    return wide.select(F.inline(F.array(*cells)))


def quality_covariance(rows):
    """Means and sample covariance of log1p(blur), brightness and contrast."""
    data = rows.select(F.log1p("blur_score").alias("log_blur"), F.col("brightness_score").alias("brightness"), F.col("contrast_score").alias("contrast"))
    names = data.columns
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    wide = data.agg(*[F.avg(a).alias(f"m_{a}") for a in names], *[F.covar_samp(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("covariance"), F.col(f"m_{a}").alias("mean_a"), F.col(f"m_{b}").alias("mean_b"))
             for i, (a, b) in enumerate(pairs)]
    return wide.select(F.inline(F.array(*cells)))


def rates(rows, keys, flag, value, low, high):
    """Share of true flags (4 digits) and percent of values inside a closed range (1 digit)."""
    inside = F.when(F.col(value).isNotNull(), F.col(value).between(low, high).cast("double"))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col(flag).cast("double")), 4).alias("rate"), F.round(F.avg(inside) * 100, 1).alias("percent_in_range")
    )


def robust_spread(rows, value):
    """Median and interquartile range over 1.34898, in one row."""
    wide = quantile_columns(rows, [], value, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return wide.select(F.col("q50").alias("median"), ((F.col("q75") - F.col("q25")) / 1.34898).alias("spread"))


def moments(rows, keys, value):
    return rows.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("n"))


def moments_above_quantile(rows, value, level):
    """Moments of the values at or above an exact quantile."""
    edge = exact_quantiles(rows, [], value, [level]).select(F.col("quantile").alias("_edge"))
    kept = rows.crossJoin(F.broadcast(edge)).where(F.col(value) >= F.col("_edge"))  # one-row side
    return kept.agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("n"), F.max("_edge").alias("edge"))


def duplicate_vectors(labelled, features=FEATURES):
    """Exact duplicates beyond the first copy, and vectors with more than one label."""
    groups = labelled.groupBy(*features).agg(F.count(F.lit(1)).alias("_n"), (F.min("target") != F.max("target")).alias("_conflict"))
    return groups.agg(F.sum(F.col("_n") - 1).alias("duplicates"), F.count_if("_conflict").alias("conflicts"), F.sum("_n").alias("n_rows"))


def shared_component_error(masses):
    """Unavoidable error mass per observable component and in total, with the accuracy bound.

    ``masses``: component, klass, mass. Components owned by one class cost nothing.
    """
    per_class = masses.groupBy("component", "klass").agg(F.sum("mass").alias("mass"))
    per_component = per_class.groupBy("component").agg(F.sum("mass").alias("total"), F.max("mass").alias("largest"))
    rows = per_component.select("component", "total", (F.col("total") - F.col("largest")).alias("error_mass"))
    overall = rows.agg(F.sum("total").alias("_all"), F.sum("error_mass").alias("_error"))
    return rows.crossJoin(F.broadcast(overall)).select(  # one-row side
        "component", (F.col("total") / F.col("_all")).alias("share"), (F.col("error_mass") / F.col("_all")).alias("error_mass"),
        (1 - F.col("_error") / F.col("_all")).alias("accuracy_bound"),
    )


def decisions_by_status(agents, requests, scores, decide):
    """Valid requests decided and counted by the agent's latest status and by decision."""
    from veriframe.functions.scores import score_errors
    from veriframe.operators.directory import latest_requests

    valid = scores.where(F.size(score_errors()) == 0)
    decided = decide(valid).select("request_id", "final_decision")
    latest = latest_requests(requests).select("agent_id", F.col("status").alias("latest_status"))
    people = agents.select("agent_id").join(latest, "agent_id", "left")
    rows = requests.select("request_id", "agent_id").join(decided, "request_id").join(people, "agent_id")
    return rows.groupBy(F.coalesce("latest_status", F.lit("pending")).alias("latest_status")).agg(
        F.count(F.lit(1)).alias("requests"), *[F.count_if(F.col("final_decision") == s).alias(s) for s in FINAL_STATUSES]
    )
