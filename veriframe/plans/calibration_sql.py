"""Checking SQL of fitted calibration: Newton steps written out, isotonic curves by the max-min formula."""

from __future__ import annotations

from veriframe.schemas import CLASS_KEYS, CLASSES

_M = [f"m_{k}" for k in CLASS_KEYS]
_NORMAL = ", ".join(f"case when s_verified + s_review + s_rejected > 0 then s_{k} / (s_verified + s_review + s_rejected) else 1e0 / 3 end p_{k}" for k in CLASS_KEYS)


def calibration_sql(held, rest, steps=14):
    """CTEs up to ``calibrated`` (candidate, method, target, p_*) over the CTEs ``held`` and ``rest`` (candidate, target, m_*)."""
    long = lambda table: " union all ".join(f"select candidate, '{k}' kind, m_{k} margin, (target = '{c}')::int hit from {table}" for k, c in zip(CLASS_KEYS, CLASSES))
    out = [f"""pts as materialized (select candidate, kind, margin, sum(hit)::bigint hits, count(*) n from ({long(held)}) group by 1, 2, 3),
totals as (select candidate, kind, sum(hits)::double yes, sum(n - hits)::double no from pts group by 1, 2),
soft as materialized (select candidate, kind, margin, n, hits * ((yes + 1) / (yes + 2)) + (n - hits) / (no + 2) soft from pts join totals using (candidate, kind)),
q0 as (select candidate, kind, 0e0 a, ln((no + 1) / (yes + 1)) b from totals)"""]
    for i in range(steps):
        out.append(f"""q{i + 1} as materialized (
  select candidate, kind, a - (bb * ga - ab * gb) / (aa * bb - ab * ab) a, b - (aa * gb - ab * ga) / (aa * bb - ab * ab) b from (
    select candidate, kind, any_value(a) a, any_value(b) b, sum(margin * (soft - n * p)) ga, sum(soft - n * p) gb,
      sum(n * p * (1 - p) * margin * margin) aa, sum(n * p * (1 - p) * margin) ab, sum(n * p * (1 - p)) bb
    from (select *, 1 / (1 + exp(a * margin + b)) p from soft join q{i} using (candidate, kind)) group by 1, 2)
)""")
    own = "case target " + " ".join(f"when '{c}' then m_{k}" for c, k in zip(CLASSES, CLASS_KEYS)) + " end"
    total = " + ".join(f"exp(beta * {m})" for m in _M)
    mean, square = (" + ".join(f"exp(beta * {m}) * {x}" for m, x in zip(_M, xs)) for xs in (_M, [f"{m} * {m}" for m in _M]))
    out.append("t0 as (select distinct candidate, 1e0 beta from pts)")
    for i in range(steps):
        out.append(f"""t{i + 1} as materialized (
  select candidate, any_value(beta) - sum(mean - own) / sum(square - mean * mean) beta
  from (select candidate, beta, {own} own, ({mean}) / ({total}) mean, ({square}) / ({total}) square from {held} join t{i} using (candidate)) group by 1
)""")
    sigmoid = ", ".join(f"1 / (1 + exp(q_{k}.a * m_{k} + q_{k}.b)) s_{k}" for k in CLASS_KEYS)
    joins = " ".join(f"join q{steps} q_{k} on q_{k}.candidate = r.candidate and q_{k}.kind = '{k}'" for k in CLASS_KEYS)
    curve = "\n".join(
        f"""asof join knots l_{k} on l_{k}.candidate = r.candidate and l_{k}.kind = '{k}' and r.m_{k} >= l_{k}.margin
  asof join knots u_{k} on u_{k}.candidate = r.candidate and u_{k}.kind = '{k}' and r.m_{k} <= u_{k}.margin""" for k in CLASS_KEYS)
    line = ", ".join(
        f"case when u_{k}.margin > l_{k}.margin and isfinite(u_{k}.margin) and isfinite(l_{k}.margin) then l_{k}.fit + (u_{k}.fit - l_{k}.fit) * ((r.m_{k} - l_{k}.margin) / (u_{k}.margin - l_{k}.margin)) "
        f"when isfinite(l_{k}.margin) then l_{k}.fit else u_{k}.fit end s_{k}" for k in CLASS_KEYS)
    out.append(f"""numbered as materialized (
  select *, row_number() over w i, (sum(hits) over w)::double s, (sum(n) over w)::double w from pts window w as (partition by candidate, kind order by margin)
), spans as (
  select a.candidate, a.kind, a.i a, b.i b, (b.s - a.s + a.hits) / (b.w - a.w + a.n) mean from numbered a join numbered b on a.candidate = b.candidate and a.kind = b.kind and a.i <= b.i
), fits as (
  select candidate, kind, b i, max(least_mean) fit from (
    select candidate, kind, a, b, min(mean) over (partition by candidate, kind, a order by b desc) least_mean from spans) group by 1, 2, 3
), inner_knots as (select candidate, kind, margin, fit from fits join numbered using (candidate, kind, i)),
knots as materialized (
  select * from inner_knots union all select candidate, kind, '-inf'::double, min(fit) from inner_knots group by 1, 2
  union all select candidate, kind, 'inf'::double, max(fit) from inner_knots group by 1, 2
), calibrated as (
  select candidate, 'sigmoid' as "method", target, {_NORMAL} from (select r.candidate, target, {sigmoid} from {rest} r {joins})
  union all select candidate, 'isotonic', target, {_NORMAL} from (select r.candidate, target, {line} from {rest} r {curve})
  union all select candidate, 'temperature', target, {_NORMAL} from (select candidate, target, {", ".join(f"exp(beta * m_{k}) s_{k}" for k in CLASS_KEYS)} from {rest} join t{steps} using (candidate))
)""")
    return ",\n".join(out)
