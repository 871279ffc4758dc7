"""Decision trees of a whole grid, grown together level by level from class counts.

A level of the large nodes is one aggregation: rows of all trees are counted by (tree, node, feature, bin, class), running sums over
a feature's bins give every split's gain in weighted Gini impurity, and the best split of each node sends its rows to the next level.
Rows are never copied for a level: they walk down the splits of the large nodes again, which are collected (at most a few for each
``local_rows`` rows of a tree). A node with at most ``local_rows`` rows to learn from meets its rows in one group, where its subtree is grown to
the end. A tree that may grow deeper starts with the splits of a shallower one, so one tree serves all depths of a grid; held-out
rows walk along, and are counted at each level by their class and their node's label.

Bins have equal width between a feature's smallest and largest value. Ties of gain go to the earlier feature, then to the lower
bin; ties of a label to the earlier class. A node with one class, or without a split that leaves ``min_leaf`` rows on both sides
and lowers the impurity, is a leaf.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from veriframe.operators.selection import folds
from veriframe.schemas import CLASSES, FEATURES
from veriframe.session import cut_lineage

BINS = 256
UNLIMITED_DEPTH = 30  # grids name it as 30
LEAST_GAIN = 1e-9  # as a share of the node's own term
LOCAL_ROWS = 20_000  # a node with at most so many rows to learn from is grown in one group
CHUNK = 1 << 19  # rows that a task counts at a time
_K = range(len(CLASSES))


@dataclass(frozen=True)
class TreeSpec:
    """One tree: the fold it leaves out (-1: none), the rows a leaf needs and the only feature it may use (None: all)."""

    fold: int
    min_leaf: int
    feature: int | None = None


def binned(rows, features=FEATURES, bins=BINS):
    """(fold, code, bins): class code and bin number of every feature; rows with a null feature or class are left out."""
    code = F.coalesce(*[F.when(F.col("target") == c, F.lit(i)) for i, c in enumerate(CLASSES)])
    data = rows.select("fold", code.alias("code"), *[F.col(f).cast("double").alias(f) for f in features]).dropna()
    limits = data.agg(*[f(c).alias(f"{n}_{c}") for c in features for f, n in ((F.min, "lo"), (F.max, "hi"))])

    def number(c):
        width = F.col(f"hi_{c}") - F.col(f"lo_{c}")
        place = F.floor((F.col(c) - F.col(f"lo_{c}")) / F.when(width > 0, width).otherwise(1.0) * bins)
        return F.least(F.lit(bins - 1), place).cast("int")

    return data.crossJoin(F.broadcast(limits)).select(F.col("fold").cast("int").alias("fold"), "code", F.array(*[number(c) for c in features]).alias("bins"))  # one row


def _of_tree(values, kind):
    """SQL text of a constant of each tree; the grid is a list of a few dozen trees."""
    return f"element_at(array({', '.join('null' if v is None else str(v) for v in values)}), tree + 1)::{kind}"


def _weight(specs, c):
    return _of_tree([f"{w[c]!r}D" for _, w in specs], "double")


def _weighted(prefix):
    """Sum of squares of weighted class counts over their sum (SQL text): larger means purer."""
    own = [f"(w{c} * {prefix}{c})" for c in _K]
    return f"try_divide({' + '.join(f'{x} * {x}' for x in own)}, {' + '.join(own)})"


# Written as SQL text: a level is a few plan steps, whatever the number of trees.
_FIT = f"{' + '.join(f'l{c}' for c in _K)} >= min_leaf and {' + '.join(f'r{c}' for c in _K)} >= greatest(min_leaf, 1)"
_LABEL = "case " + " ".join(f"when w{c} * n{c} >= greatest({', '.join(f'w{k} * n{k}' for k in _K)}) then {c}" for c in _K) + " end label"
_RUNNING = [f"sum(n{c}) over (partition by tree, node, feature order by bin rows between unbounded preceding and current row) l{c}" for c in _K]
_WHOLE = [f"sum(n{c}) over (partition by tree, node, feature) t{c}" for c in _K]  # at most one row per bin


def _nodes(cells, specs):
    """(tree, node, n0.., label, feature, bin, gain, low) of counted nodes; the last four are null where a node does not split, low is the number of rows on the lower side."""
    weights = [f"{_weight(specs, c)} w{c}" for c in _K]
    sums = cells.repartition("tree", "node").selectExpr("tree", "node", "feature", "bin", *_RUNNING, *_WHOLE)
    sums = sums.selectExpr("*", *[f"t{c} - l{c} r{c}" for c in _K], *weights, f"{_of_tree([s.min_leaf for s, _ in specs], 'bigint')} min_leaf")
    split = f"case when {_FIT} then struct({_weighted('l')} + {_weighted('r')} score, -feature f, -bin b, {_weighted('t')} own, {' + '.join(f'l{c}' for c in _K)} low) end"
    best = sums.selectExpr("tree", "node", *[f"t{c}" for c in _K], f"{split} split").groupBy("tree", "node").agg(F.expr("max(split) best"), *[F.expr(f"max(t{c}) n{c}") for c in _K])
    better = f"best.score > best.own * (1D + {LEAST_GAIN!r}D)"
    return best.selectExpr("*", *weights).selectExpr(
        "tree", "node", *[f"n{c}" for c in _K], _LABEL, f"case when {better} then -best.f end feature", f"case when {better} then -best.b end bin",
        f"case when {better} then best.score - best.own end gain", f"case when {better} then best.low end low")


@dataclass
class _Top:
    """Splits of one tree's large nodes: entry i goes on to ``low[i]`` or ``low[i] + 1``; an entry without a split is a large node to be counted, a small one or a leaf."""

    node: list
    feature: list
    cut: list
    low: list
    state: list  # "large", "small" or "closed"

    def add(self, node, rows, local_rows):
        self.node.append(node)
        self.feature.append(-1)
        self.cut.append(0)
        self.low.append(-1)
        self.state.append("large" if rows > local_rows else "small" if rows else "closed")

    def split(self, at, feature, cut, below, above, local_rows):
        self.feature[at], self.cut[at], self.low[at], self.state[at] = feature, cut, len(self.node), "closed"
        self.add(self.node[at] * 2, below, local_rows)
        self.add(self.node[at] * 2 + 1, above, local_rows)

    def walk(self, bins):
        """The entry that each row ends in."""
        feature, cut, low = (np.array(x, np.int64) for x in (self.feature, self.cut, self.low))
        at, moving = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while len(moving := moving[feature[at[moving]] >= 0]):
            here = at[moving]
            at[moving] = low[here] + (bins[moving, feature[here]] > cut[here])
        return at


def _chunks(batches):
    """(fold, code, bins) of up to ``CHUNK`` rows at a time."""
    waiting, size = [], 0

    def read():
        table = pa.Table.from_batches(waiting)
        fold, code = (np.asarray(table.column(c), np.int64) for c in ("fold", "code"))
        return fold, code, np.concatenate([b.column("bins").flatten().to_numpy().reshape(len(b), -1) for b in waiting if len(b)])

    for batch in batches:
        if len(batch):
            waiting.append(batch)
            size += len(batch)
        if size >= CHUNK:
            yield read()
            waiting, size = [], 0
    if size:
        yield read()


def _cell_batches(tree, nodes, feature, counts):
    """Counts that are not all zero, from an array (node, bin, class)."""
    at, bin_number = np.nonzero(counts.any(axis=2))
    found = counts[at, bin_number].astype(np.int64)
    number = np.full(len(at), 0)
    names = ["tree", "node", "feature", "bin", *[f"n{c}" for c in _K]]
    columns = [(number + tree).astype(np.int32), nodes[at], (number + feature).astype(np.int32), bin_number.astype(np.int32), *found.T]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)


def _counted(rows, specs, tops):
    """(tree, node, feature, bin, n0..) of the large nodes; feature -1 counts held-out rows."""
    plain = [spec for spec, _ in specs]
    shared = rows.sparkSession.sparkContext.broadcast((plain, tops))  # a few entries for each ``local_rows`` rows of a tree

    def count(batches):
        plain, tops = shared.value
        for fold, code, bins in _chunks(batches):
            width = int(bins.max()) + 1
            for tree, (spec, top) in enumerate(zip(plain, tops)):
                large = np.array([s == "large" for s in top.state])
                if not large.any():
                    continue
                place = np.cumsum(large) - 1
                at = top.walk(bins)
                mine = np.flatnonzero(large[at])
                at, held = place[at[mine]], fold[mine] == spec.fold
                nodes, shape = np.array(top.node, np.int64)[large], (int(large.sum()), width, len(CLASSES))
                for f in range(bins.shape[1]) if spec.feature is None else [spec.feature]:
                    cell = (at * width + bins[mine, f]) * len(CLASSES) + code[mine]
                    yield _cell_batches(tree, nodes, f, np.bincount(cell[~held], minlength=shape[0] * width * len(CLASSES)).reshape(shape))
                kept = np.bincount(at[held] * len(CLASSES) + code[mine][held], minlength=shape[0] * len(CLASSES))
                yield _cell_batches(tree, nodes, -1, kept.reshape(shape[0], 1, len(CLASSES)))

    cells = rows.mapInArrow(count, f"tree int, node bigint, feature int, bin int, {', '.join(f'n{c} bigint' for c in _K)}")
    return cells.groupBy("tree", "node", "feature", "bin").agg(*[F.sum(f"n{c}").alias(f"n{c}") for c in _K])


def _purity(counts, weights):
    own = [weights[c] * counts[:, c] for c in _K]
    return reduce(lambda a, b: a + b, [x * x for x in own]) / reduce(lambda a, b: a + b, own)


def _subtree(spec, weights, node, max_depth, held, code, bins):
    """Levels of one node's subtree: (level, node numbers, counts, label, feature, bin, gain, held-out counts); feature is -1 in leaves.

    The rows of every feature stay sorted by (node, bin); class counts along that order give all splits of a level at once.
    """
    level, numbers = node.bit_length() - 1, np.array([node])
    at, learn = np.zeros(len(code), np.int64), np.flatnonzero(~held)
    features = range(bins.shape[1]) if spec.feature is None else [spec.feature]
    orders = {f: learn[np.argsort(bins[learn, f], kind="stable")] for f in features}
    least = max(spec.min_leaf, 1)
    with np.errstate(all="ignore"):
        while len(numbers):
            size, cells = len(numbers), np.where(at >= 0, at * len(CLASSES) + code, -1)
            total, kept = (np.bincount(cells[rows & (at >= 0)], minlength=size * len(CLASSES)).reshape(size, -1) for rows in (~held, held))
            best, own = np.full(size, -np.inf), _purity(total, weights)
            candidates = []
            for f, order in orders.items() if level < max_depth else ():
                here, value = at[order], bins[order, f]
                last = np.flatnonzero(np.append((here[1:] != here[:-1]) | (value[1:] != value[:-1]), True))
                start = np.concatenate([[0], np.cumsum(np.bincount(here, minlength=size))])[:-1]
                low = np.empty((len(last), len(CLASSES)), np.int64)
                for c in _K:
                    along = np.concatenate([[0], np.cumsum(code[order] == c)])
                    low[:, c] = along[last + 1] - along[start[here[last]]]
                high = total[here[last]] - low
                fit = (low.sum(axis=1) >= spec.min_leaf) & (high.sum(axis=1) >= least)
                owner, low, high = here[last][fit], low[fit], high[fit]
                score = _purity(low, weights) + _purity(high, weights)
                np.fmax.at(best, owner, score)
                candidates.append((owner, np.full(len(owner), f), value[last][fit], score))
            feature, cut, gain = np.full(size, -1), np.zeros(size, np.int64), np.zeros(size)
            if candidates:
                owner, which, value, score = (np.concatenate(x) for x in zip(*candidates))
                top = np.flatnonzero((score == best[owner]) & (score > own[owner] * (1.0 + LEAST_GAIN)))
                found, first = np.unique(owner[top], return_index=True)  # the earlier feature, then the lower bin
                feature[found], cut[found], gain[found] = which[top[first]], value[top[first]], best[found] - own[found]
            yield level, numbers, total, (total * np.array(weights)).argmax(axis=1), feature, cut, gain, kept
            inner = np.flatnonzero(feature >= 0)
            place = np.full(size, -1)
            place[inner] = 2 * np.arange(len(inner))
            going = np.flatnonzero(at >= 0)
            going, gone = going[place[at[going]] >= 0], going[place[at[going]] < 0]
            side = bins[going, feature[at[going]]] > cut[at[going]]
            at[going], at[gone] = place[at[going]] + side, -1
            numbers = (numbers[inner][:, None] * 2 + np.arange(2)).ravel()
            for f, order in orders.items():
                order = order[at[order] >= 0]
                short = at[order].astype(np.uint16 if len(numbers) < 1 << 16 else np.int64)
                orders[f] = order[np.argsort(short, kind="stable")]
            level += 1


def _finished(rows, specs, tops, max_depth, with_nodes):
    """(tree, level, node, n0.., label, feature, bin, gain, leaf, code, n) of the small nodes' subtrees: nodes (code is null) and counts of held-out rows (node is null)."""
    shared = rows.sparkSession.sparkContext.broadcast((specs, tops))

    def dealt(batches):
        specs, tops = shared.value
        for fold, code, bins in _chunks(batches):
            for tree, ((spec, _), top) in enumerate(zip(specs, tops)):
                at = top.walk(bins)
                mine = np.flatnonzero(np.array([s == "small" for s in top.state])[at])
                packed = np.ascontiguousarray(bins[mine], np.int32)
                width = packed.shape[1] * 4
                for lo in range(0, len(mine), 10_000):
                    part, data = mine[lo: lo + 10_000], packed[lo: lo + 10_000].tobytes()
                    offsets = pa.py_buffer(np.arange(0, len(data) + 1, width, np.int32).tobytes())
                    columns = [pa.array(np.full(len(part), tree, np.int32)), pa.array(np.array(top.node, np.int64)[at[part]]), pa.array(fold[part] == spec.fold), pa.array(code[part].astype(np.int32)),
                               pa.Array.from_buffers(pa.binary(), len(part), [None, offsets, pa.py_buffer(data)])]
                    yield pa.RecordBatch.from_arrays(columns, ["tree", "node", "held", "code", "bins"])

    schema = f"tree int, level int, node bigint, {', '.join(f'n{c} bigint' for c in _K)}, label int, feature int, bin int, gain double, leaf boolean, code int, n bigint"
    types = [pa.int32(), pa.int32(), pa.int64(), *[pa.int64() for _ in _K], pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.bool_(), pa.int32(), pa.int64()]
    names = [part.split()[0] for part in schema.split(", ")]

    def grown(key, table):
        tree, node = (k.as_py() for k in key)
        spec, weights = shared.value[0][tree]
        held, code = np.asarray(table.column("held")), np.asarray(table.column("code"), np.int64)
        bins = np.frombuffer(b"".join(table.column("bins").to_pylist()), np.int32).reshape(len(table), -1).astype(np.int64)
        parts = []
        for level, numbers, total, label, feature, cut, gain, kept in _subtree(spec, weights, node, max_depth, held, code, bins):
            leaf, size = feature < 0, len(numbers)
            if with_nodes:
                parts.append([np.full(size, tree), np.full(size, level), numbers, *total.T, label, *[pa.array(x, mask=leaf) for x in (feature, cut, gain)], *[pa.nulls(size)] * 3])
            cells = [(bool(flag), c, k, int(kept[(leaf == flag) & (label == k), c].sum())) for flag in (True, False) for c in _K for k in _K]
            cells = [cell for cell in cells if cell[3]]
            size = len(cells)
            flags, codes, labels, counts = zip(*cells) if cells else ((),) * 4
            parts.append([np.full(size, tree), np.full(size, level), *[pa.nulls(size)] * (1 + len(CLASSES)), labels, *[pa.nulls(size)] * 3, flags, codes, counts])
        columns = [pa.chunked_array([(x if isinstance(x, pa.Array) else pa.array(x)).cast(t) for x in column], t) for column, t in zip(zip(*parts), types)]
        return pa.table(columns, names)

    small = rows.mapInArrow(dealt, "tree int, node bigint, held boolean, code int, bins binary")
    return cut_lineage(small.groupBy("tree", "node").applyInArrow(grown, schema), "tree-small-nodes")


def grow(rows, specs, max_depth, local_rows=LOCAL_ROWS, with_nodes=True):
    """(nodes, held): the trees' nodes, and counts of held-out rows at each level.

    ``rows`` comes from ``binned``. ``nodes``: tree, level, node, n0.., label (class code), feature, bin (null in leaves) and gain;
    the children of node m are 2m (at most that bin) and 2m + 1. ``held``: tree, level, leaf, code, label, n. Without ``with_nodes``
    the nodes below the large ones are not kept.
    """
    sizes = {r["fold"]: [r[f"n{c}"] for c in _K] for r in rows.groupBy("fold").agg(*[F.count_if(F.col("code") == c).alias(f"n{c}") for c in _K]).collect()}  # a row per fold

    def used(spec):
        return [sum(n[c] for fold, n in sizes.items() if fold != spec.fold) for c in _K]

    specs = [(spec, [sum(used(spec)) / (len(CLASSES) * n) if n else 0.0 for n in used(spec)]) for spec in specs]
    tops, nodes, held = [_Top([], [], [], [], []) for _ in specs], [], []
    for (spec, _), top in zip(specs, tops):
        top.add(1, sum(used(spec)), local_rows)
    for level in range(max_depth + 1):
        if not any("large" in top.state for top in tops):
            break
        cells = cut_lineage(_counted(rows, specs, tops), "tree-cells")
        found = _nodes(cells.where("feature >= 0"), specs)
        if level == max_depth:
            found = found.withColumns({c: F.lit(None).cast(t) for c, t in (("feature", "int"), ("bin", "int"), ("gain", "double"), ("low", "bigint"))})
        found = cut_lineage(found.selectExpr("*", f"{level} level"), f"tree-level-{level}")
        nodes.append(found.drop("low"))
        here = cells.where("feature = -1").join(found.selectExpr("tree", "node", "label", "feature is null leaf"), ["tree", "node"])
        codes = ", ".join(f"{c}, n{c}" for c in _K)
        held.append(here.selectExpr("tree", "leaf", "label", f"stack({len(CLASSES)}, {codes}) as (code, n)").where("n > 0").groupBy("tree", "leaf", "code", "label").agg(F.sum("n").alias("n")).selectExpr("*", f"{level} level"))
        splits = found.selectExpr("tree", "node", "feature", "bin", "low", f"{' + '.join(f'n{c}' for c in _K)} n").collect()  # at most a row per ``local_rows`` rows of a tree
        places = [{node: i for i, node in enumerate(top.node)} for top in tops]
        for r in splits:
            top, at = tops[r["tree"]], places[r["tree"]][r["node"]]
            top.state[at] = "closed"
            if r["feature"] is not None:
                top.split(at, r["feature"], r["bin"], r["low"], r["n"] - r["low"], local_rows)
    small = _finished(rows, specs, tops, max_depth, with_nodes)
    nodes.append(small.where("code is null").select("tree", "node", *[f"n{c}" for c in _K], "label", "feature", "bin", "gain", "level"))
    held.append(small.where("code is not null").select("tree", "leaf", "code", "label", "n", "level"))
    union = lambda frames: reduce(lambda a, b: a.unionByName(b), frames)
    return union(nodes), union(held)


def held_out_f1(held, specs, depths):
    """(tree, max_depth, macro_f1): rows stop at a leaf, or where the depth ends."""
    caps = held.sparkSession.createDataFrame([(d,) for d in depths], "max_depth int")
    stopped = held.join(F.broadcast(caps), (F.col("level") == F.col("max_depth")) | (F.col("leaf") & (F.col("level") < F.col("max_depth"))))  # a row per depth
    cell = lambda *conditions: F.sum(F.when(reduce(lambda a, b: a & b, conditions), F.col("n")).otherwise(0))
    f1 = []
    for c in _K:
        hits, both = cell(F.col("code") == c, F.col("label") == c), cell(F.col("code") == c) + cell(F.col("label") == c)
        f1.append(F.when(both > 0, 2 * hits / both).otherwise(0.0))
    return stopped.groupBy("tree", "max_depth").agg((reduce(lambda a, b: a + b, f1) / len(CLASSES)).alias("macro_f1"))


def _with_names(spark, scores, rows, schema):
    return scores.join(F.broadcast(spark.createDataFrame(rows, schema)), "tree")  # a row per tree of the grid


def single_feature_signal(train, key, features=FEATURES, k=5, depth=3):
    """Mean cross-validated macro F1 of a shallow tree on each feature alone."""
    specs = [TreeSpec(fold, 1, i) for i in range(len(features)) for fold in range(k)]
    _, held = grow(cut_lineage(binned(folds(train, key, k), features), "tree-bins"), specs, depth, with_nodes=False)
    named = _with_names(train.sparkSession, held_out_f1(held, specs, [depth]), [(i, features[s.feature]) for i, s in enumerate(specs)], "tree int, feature string")
    return named.groupBy("feature").agg(F.avg("macro_f1").alias("macro_f1"))


def tune_tree(train, key, depths=(3, 5, 8, UNLIMITED_DEPTH), leaves=(5, 20, 50), k=5, features=FEATURES):
    """Tree grid by cross-validated macro F1: max_depth, min_leaf, macro_f1."""
    specs = [TreeSpec(fold, leaf) for leaf in leaves for fold in range(k)]
    _, held = grow(cut_lineage(binned(folds(train, key, k), features), "tree-bins"), specs, max(depths), with_nodes=False)
    named = _with_names(train.sparkSession, held_out_f1(held, specs, depths), [(i, s.min_leaf) for i, s in enumerate(specs)], "tree int, min_leaf int")
    return named.groupBy("max_depth", "min_leaf").agg(F.avg("macro_f1").alias("macro_f1"))


def fit_tree(train, depth, leaf, features=FEATURES):
    """The nodes of one tree on all rows (see ``grow``)."""
    rows = cut_lineage(binned(train.withColumn("fold", F.lit(0)), features), "tree-bins")
    return grow(rows, [TreeSpec(-1, leaf)], depth)[0]


def tree_importances(nodes, features=FEATURES):
    """Each feature's share of the impurity that the tree's splits take away; 0 without a split."""
    names = nodes.sparkSession.createDataFrame(list(enumerate(features)), "feature int, name string")
    gains = nodes.where(F.col("feature").isNotNull()).groupBy("feature").agg(F.sum("gain").alias("gain"))
    every = names.join(gains, "feature", "left").select(F.col("name").alias("feature"), F.coalesce("gain", F.lit(0.0)).alias("gain"))
    total = every.agg(F.sum("gain").alias("total"))
    return every.crossJoin(F.broadcast(total)).select("feature", F.when(F.col("total") > 0, F.col("gain") / F.col("total")).otherwise(0.0).alias("importance"))  # one row
