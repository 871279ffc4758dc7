"""Checking SQL of the tree queries: the same growth written out level by level."""

from __future__ import annotations

from veriframe.operators.trees import BINS, LEAST_GAIN
from veriframe.schemas import CLASSES, FEATURES

_K = range(len(CLASSES))


def _purity(prefix):
    own = [f"(w{c} * {prefix}{c})" for c in _K]
    return f"(({' + '.join(f'{x} * {x}' for x in own)}) / ({' + '.join(own)}))"


def growth_sql(train, specs, depth, folds=5):
    """CTEs up to ``nodes`` and ``held`` over the CTE ``train`` (request_id, target, features); ``specs``: (fold, min_leaf, feature)."""
    fold = f"(row_number() over (partition by target order by md5(concat(cast(request_id as varchar), ':fold42')), request_id)) % {folds}" if folds > 1 else "0"
    code = " ".join(f"when '{c}' then {i}" for i, c in enumerate(CLASSES))
    bins = ", ".join(f"least({BINS - 1}, floor(({f} - lo_{f}) / case when hi_{f} > lo_{f} then hi_{f} - lo_{f} else 1e0 end * {BINS}))::int" for f in FEATURES)
    limits = ", ".join(f"min({f}) lo_{f}, max({f}) hi_{f}" for f in FEATURES)
    values = ", ".join(f"({i}, {f}, {leaf}, {'null' if only is None else only})" for i, (f, leaf, only) in enumerate(specs))
    counts = ", ".join(f"count(*) filter (where code = {c}) n{c}" for c in _K)
    steps = [f"""tree_rows as materialized (
  select {fold} as fold, case target {code} end code, [{bins}] as bins from {train}, (select {limits} from {train})
), grid(tree, out_fold, min_leaf, only_f) as (values {values}),
sized as (select tree, out_fold, min_leaf, only_f, {counts} from grid join tree_rows on fold <> out_fold group by 1, 2, 3, 4),
specs as materialized (select tree, out_fold, min_leaf, only_f::int as only_f, {', '.join(f"case when n{c} > 0 then (n0 + n1 + n2)::double / (3 * n{c}) else 0e0 end w{c}" for c in _K)} from sized),
a0 as materialized (select tree, 1::bigint as node, fold = out_fold as held, code, bins from tree_rows cross join specs)"""]
    greatest = "greatest(" + ", ".join(f"w{c} * n{c}" for c in _K) + ")"
    label = "case " + " ".join(f"when w{c} * n{c} >= {greatest} then {c}" for c in _K) + " end"
    for level in range(depth + 1):
        split = f"""b{level} as materialized (
  select tree, node, arg_min(feature, place) feature, arg_min(bin, place) bin, max(score) - max(own) gain from (
    select *, row_number() over (partition by tree, node order by score desc, feature, bin) place from (
      select tree, node, feature, bin, {_purity('t')} own, {_purity('l')} + {_purity('r')} score from (
        select *, {', '.join(f't{c} - l{c} r{c}' for c in _K)} from (
          select tree, node, feature, bin, {', '.join(f'(sum(n{c}) over (partition by tree, node, feature order by bin))::bigint l{c}, (sum(n{c}) over (partition by tree, node, feature))::bigint t{c}' for c in _K)}
          from (
            select tree, node, feature, bin, {counts}
            from (select tree, node, code, only_f, unnest(range({len(FEATURES)}))::int feature, unnest(bins) bin from a{level} join specs using (tree) where not held)
            where only_f is null or only_f = feature group by 1, 2, 3, 4))) join specs using (tree)
      where l0 + l1 + l2 >= min_leaf and r0 + r1 + r2 >= min_leaf and r0 + r1 + r2 > 0))
  where place = 1 and score > own * (1 + {LEAST_GAIN!r}::double) group by 1, 2
)""" if level < depth else f"b{level} as (select 0 tree, 0::bigint node, 0 feature, 0 bin, 0e0 gain where false)"
        steps.append(f"""{split}, n{level} as materialized (
  select c.tree, c.node, label, feature, bin, gain from (
    select tree, node, {label} label from (select tree, node, {counts} from a{level} where not held group by 1, 2) join specs using (tree)) c
  left join b{level} b on b.tree = c.tree and b.node = c.node
), h{level} as (
  select a.tree, {level} as level, feature is null leaf, code, label, count(*) n from a{level} a join n{level} using (tree, node) where held group by all
)""")
        if level < depth:
            steps.append(f"""a{level + 1} as materialized (
  select a.tree, a.node * 2 + (bins[feature + 1] > bin)::bigint as node, held, code, bins from a{level} a join n{level} using (tree, node) where feature is not null
)""")
    union = lambda name, columns: " union all ".join(f"select {columns} from {name}{level}" for level in range(depth + 1))
    steps.append(f"nodes as ({union('n', 'tree, node, label, feature, bin, gain')})")
    steps.append(f"held as ({union('h', '*')})")
    return ",\n".join(steps)


def held_out_sql(depths):
    """CTE ``f1`` (tree, max_depth, macro_f1) over ``held``."""
    f1 = []
    for c in _K:
        hits = f"sum(case when code = {c} and label = {c} then n else 0 end)"
        both = f"(sum(case when code = {c} then n else 0 end) + sum(case when label = {c} then n else 0 end))"
        f1.append(f"coalesce((2 * {hits})::double / nullif({both}, 0), 0)")
    return f"""f1 as (
  select tree, max_depth, ({' + '.join(f1)}) / {len(CLASSES)} macro_f1
  from held join (select unnest({list(depths)}) max_depth) on level = max_depth or (leaf and level < max_depth) group by 1, 2)"""
