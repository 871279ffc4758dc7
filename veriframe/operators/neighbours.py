"""Near-duplicate score vectors: L-infinity neighbours within per-feature tolerances."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from veriframe.operators.keyed import quantile_columns
from veriframe.schemas import FEATURES
from veriframe.session import cut_lineage

AXES = ["z0", "z1", "z2", "z3", "z4", "z5"]


def scaled_vectors(scores):
    """Scores divided by their tolerances; blur on a log scale."""
    return scores.select(
        (F.col("face_match_score") / 0.1).alias("z0"), (F.col("liveness_score") / 0.001).alias("z1"),
        (F.col("ocr_confidence_score") / 0.001).alias("z2"), (F.log1p("blur_score") / 0.01).alias("z3"),
        (F.col("brightness_score") / 0.1).alias("z4"), (F.col("contrast_score") / 0.1).alias("z5"),
    )


def weighted_vectors(scores):
    """Distinct scaled vectors with their number of copies."""
    return scaled_vectors(scores).groupBy(*AXES).agg(F.count(F.lit(1)).alias("w"))


@dataclass(frozen=True)
class SplitTree:
    """Cuts of the space into tiles, from medians of a sample: node k goes on to ``left[k]`` or ``right[k]``, a negative number -t-1 is tile t."""

    axis: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    tiles: int

    @classmethod
    def of_sample(cls, sample, tiles):
        axis, cut, left, right, leaves = [], [], [], [], [0]

        def grow(rows, wanted):
            spread = rows.max(axis=0) - rows.min(axis=0) if len(rows) else np.zeros(1)
            if wanted <= 1 or len(rows) < 2 or spread.max() == 0:
                leaves[0] += 1
                return -leaves[0]
            number, best = len(axis), int(spread.argmax())
            values = np.sort(rows[:, best])
            at = values[(len(values) - 1) // 2]
            at = at if at < values[-1] else values[np.searchsorted(values, at) - 1]  # something must lie above the cut
            for own, value in ((axis, best), (cut, at), (left, 0), (right, 0)):
                own.append(value)
            below = rows[:, best] <= at
            left[number] = grow(rows[below], wanted // 2)
            right[number] = grow(rows[~below], wanted - wanted // 2)
            return number

        grow(sample, tiles)
        return cls(np.array(axis, int), np.array(cut, float), np.array(left, int), np.array(right, int), leaves[0])

    def visits(self, vectors, reach):
        """(row, tile) for each tile whose part of the space has a point within ``reach`` (one for all rows or one each) of the row along every cut."""
        if not len(self.axis):
            yield np.arange(len(vectors)), 0
            return
        waiting, reach = [(0, np.arange(len(vectors)))], np.broadcast_to(reach, len(vectors))
        while waiting:
            node, rows = waiting.pop()
            if node < 0:
                yield rows, -node - 1
                continue
            value, far = vectors[rows, self.axis[node]], reach[rows]
            for child, mine in ((self.left[node], value - far <= self.cut[node]), (self.right[node], value + far > self.cut[node])):
                if mine.any():
                    waiting.append((child, rows[mine]))


LEAF = 24  # vectors of a leaf inside a tile
BITS = 4096  # vectors of a leaf whose close pairs are counted by bit sets
CHUNK = 1 << 18  # node pairs (or compared vectors) handled at a time


class _Nodes:
    """A median tree over one set of vectors: boxes, weights and children of every node; children of a leaf are -1."""

    def __init__(self, vectors, weights, leaf=LEAF):
        low, high, left, right, start, stop = [], [], [], [], [], []
        order = np.arange(len(vectors))
        waiting = [(0, len(vectors), -1, 0)]
        while waiting:
            a, b, parent, side = waiting.pop()
            number, own = len(low), vectors[order[a:b]]
            if parent >= 0:
                (left, right)[side][parent] = number
            low.append(own.min(axis=0))
            high.append(own.max(axis=0))
            left.append(-1)
            right.append(-1)
            start.append(a)
            stop.append(b)
            if b - a > leaf:
                middle = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(own[:, (high[-1] - low[-1]).argmax()], middle)]
                waiting += [(a, a + middle, number, 0), (a + middle, b, number, 1)]
        self.low, self.high, self.left, self.right = np.array(low), np.array(high), np.array(left), np.array(right)
        self.start, self.stop = np.array(start), np.array(stop)
        self.vectors, self.weights = vectors[order], weights[order]
        total, square = (np.concatenate([[0], np.cumsum(x)]) for x in (self.weights, self.weights**2))
        self.weight, self.square = total[self.stop] - total[self.start], square[self.stop] - square[self.start]


def _split_pairs(x, y, i, j, same):
    """Node pairs with the larger node (in vectors) replaced by its children; a node with itself gives three pairs."""
    bigger = (x.stop - x.start)[i] >= (y.stop - y.start)[j]
    bigger = (bigger | (y.left[j] < 0)) & (x.left[i] >= 0)
    own = same & (i == j)
    first, second = bigger & ~own, ~bigger & ~own
    pairs = [(x.left[i[first]], j[first]), (x.right[i[first]], j[first]), (i[second], y.left[j[second]]), (i[second], y.right[j[second]])]
    pairs += [(x.left[i[own]], x.left[i[own]]), (x.right[i[own]], x.right[i[own]]), (x.left[i[own]], x.right[i[own]])]
    return np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])


def _first(values, points, after):
    """Per point, the first of the sorted ``values`` for which value - point >= -1 (``after``: > 1) as the subtraction rounds."""
    edge = points + (1 if after else -1)
    margin = 1e-9 * (1 + np.abs(points))  # what lies nearer to the edge is subtracted
    low, high = np.searchsorted(values, edge - margin), np.searchsorted(values, edge + margin, side="right")
    while len(open_ := np.flatnonzero(low < high)):
        middle = (low[open_] + high[open_]) // 2
        gap = values[middle] - points[open_]
        reached = gap > 1 if after else gap >= -1
        high[open_[reached]] = middle[reached]
        low[open_[~reached]] = middle[~reached] + 1
    return low


class _BitSets:
    """Sets of a leaf's vectors as bits: per axis, those of the r smallest values for every r; and those whose weight has a bit set."""

    def __init__(self, vectors, weights):
        n, words = len(vectors), -(-len(vectors) // 64)
        bit = np.uint64(1) << (np.arange(n) % 64).astype(np.uint64)
        self.values, self.below = [], []
        for column in vectors.T:
            order = np.argsort(column)
            sets = np.zeros((n + 1, words), np.uint64)
            sets[np.arange(1, n + 1), order // 64] = bit[order]
            self.values.append(column[order])
            self.below.append(np.bitwise_or.accumulate(sets, axis=0))
        self.planes = []
        for power in range(int(weights.max()).bit_length()):
            mine, plane = np.flatnonzero(weights >> power & 1), np.zeros(words, np.uint64)
            np.bitwise_or.at(plane, mine // 64, bit[mine])
            if len(mine):
                self.planes.append((power, None if len(mine) == n else plane))

    def weight_near(self, points):
        """Weight of the leaf's vectors within distance 1 of each point."""
        close = None
        for axis, (values, below) in enumerate(zip(self.values, self.below)):
            start, stop = (_first(values, points[:, axis], after) for after in (False, True))
            inside = below[stop]
            inside ^= below[start]
            close = inside if close is None else np.bitwise_and(close, inside, out=close)
        return sum(np.bitwise_count(close if plane is None else close & plane).sum(axis=1, dtype=np.int64) << power for power, plane in self.planes)


def _compared(x, y, i, j, same):
    """Weighted close pairs of leaf pairs; only vectors in reach of the other leaf's box are looked up in its bit sets."""
    total, order = 0, np.argsort(j, kind="stable")
    i, j = i[order], j[order]
    for start, stop in zip(*(np.searchsorted(j, np.unique(j), side=side) for side in ("left", "right"))):
        leaf = j[start]
        own = slice(y.start[leaf], y.stop[leaf])
        sets = _BitSets(y.vectors[own], y.weights[own])
        for other in i[start:stop]:
            rows = slice(x.start[other], x.stop[other])
            points, weights = x.vectors[rows], x.weights[rows]
            reach = (np.maximum(y.low[leaf] - points, points - y.high[leaf]).max(axis=1) <= 1) & np.isfinite(points).all(axis=1)
            points, weights = points[reach], weights[reach]
            found = 0
            for at in range(0, len(points), 1024):
                found += int((weights[at: at + 1024] * sets.weight_near(points[at: at + 1024])).sum())
            # a leaf with itself meets each pair from both ends, and each vector itself
            total += (found - int((weights**2).sum())) // 2 if same and other == leaf else found
    return total


def count_close(x, y=None):
    """(whole, compared): weighted pairs within distance 1 of two node trees, or of one with itself (copies of one vector left out)."""
    same = y is None
    y = x if same else y
    whole, met, waiting = 0, [], [(np.zeros(1, int), np.zeros(1, int))]
    while waiting:
        i, j = waiting.pop()
        if len(i) > CHUNK:
            waiting.append((i[CHUNK:], j[CHUNK:]))
            i, j = i[:CHUNK], j[:CHUNK]
        gap = np.maximum(y.low[j] - x.high[i], x.low[i] - y.high[j]).max(axis=1)
        reach = (np.maximum(x.high[i], y.high[j]) - np.minimum(x.low[i], y.low[j])).max(axis=1)
        own = same & (i == j)
        inside = (reach <= 1)
        product = np.where(own, (x.weight[i] ** 2 - x.square[i]) // 2, x.weight[i] * y.weight[j])
        whole += int(product[inside].sum())
        rest = ~inside & (gap <= 1)
        leaves = rest & (x.left[i] < 0) & (y.left[j] < 0)
        met.append((i[leaves], j[leaves]))
        rest &= ~leaves
        if rest.any():
            waiting.append(_split_pairs(x, y, i[rest], j[rest], same))
    return whole, _compared(x, y, *map(np.concatenate, zip(*met)), same)


def _matrix(batch):
    return np.stack([np.asarray(batch.column(a), float) for a in AXES], axis=1) if len(batch) else np.zeros((0, len(AXES)))


_COLUMNS = ", ".join(f"{a} double" for a in AXES)


def _tiled(vectors, tile_rows, sample_per_tile):
    """(tree, rows with their tile, box and weight of every tile): medians of a bounded sample cut the space into tiles of about ``tile_rows`` vectors."""
    n = vectors.count()
    tiles = max(1, -(-n // tile_rows))
    sample = vectors.where(F.pmod(F.xxhash64(*AXES), F.lit(max(n, 1))) < tiles * sample_per_tile).select(*AXES).toArrow()
    sample = _matrix(sample)
    tree = SplitTree.of_sample(sample[np.lexsort(sample.T[::-1])], tiles)

    def placed(batches):
        for batch in batches:
            own, tile = _matrix(batch), np.zeros(len(batch), np.int64)
            for rows, number in tree.visits(own, 0.0):
                tile[rows] = number
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in (*AXES, "w")], pa.array(tile)], [*AXES, "w", "tile"])

    at_home = cut_lineage(vectors.mapInArrow(placed, f"{_COLUMNS}, w bigint, tile bigint"), "tiled-vectors")
    boxes = at_home.groupBy("tile").agg(F.sum("w").alias("w"), *[f(a).alias(f"{p}{a}") for a in AXES for f, p in ((F.min, "lo"), (F.max, "hi"))])
    boxes = {r["tile"]: (np.array([r[f"lo{a}"] for a in AXES]), np.array([r[f"hi{a}"] for a in AXES]), r["w"]) for r in boxes.collect()}  # a row per tile
    return tree, at_home, boxes


def near_duplicate_pairs(scores, tile_rows=None, sample_per_tile=200):
    """Number of row pairs whose scaled distance is at most 1, split by how they were counted.

    Copies of one vector are counted from their multiplicity. Medians of a bounded sample cut the space into tiles of about
    ``tile_rows`` distinct vectors (by default 20 000, and up to 100 000 in large tables); the exact boxes of the tiles are aggregated. A vector visits each tile with a smaller number
    whose box it may reach, unless it is close to the whole box: then it counts with the tile's total and stays at home, so that
    vectors crowded into a unit of space do not meet each other. Inside a tile, median trees of its own vectors and its
    visitors are walked together: pairs of nodes are dropped or counted whole by their boxes, and only leaves compare vectors, by
    bit sets of those within reach along each axis.
    """
    spark = scores.sparkSession
    vectors = cut_lineage(weighted_vectors(scores).dropna(), "vectors")
    tile_rows = tile_rows or min(max(20_000, vectors.count() // 200), 100_000)
    tree, at_home, boxes = _tiled(vectors, tile_rows, sample_per_tile)
    shared = spark.sparkContext.broadcast((tree, boxes))  # one entry per ``tile_rows`` vectors

    def dealt(batches):
        tree, boxes = shared.value
        for batch in batches:
            own, home, weight = _matrix(batch), batch.column("tile").to_numpy(), batch.column("w").to_numpy()
            rows, targets, whole = [np.arange(len(batch))], [home], 0
            for near, tile in tree.visits(own, 1.0 + 1e-6):
                near = near[home[near] > tile]
                if tile not in boxes or not len(near):
                    continue
                low, high, total = boxes[tile]
                reach = np.maximum(np.abs(own[near] - low), np.abs(high - own[near])).max(axis=1)
                gap = np.maximum(own[near] - high, low - own[near]).max(axis=1)
                whole += int(weight[near[reach <= 1]].sum()) * total
                crossing = near[(gap <= 1) & (reach > 1)]
                rows.append(crossing)
                targets.append(np.full(len(crossing), tile))
            rows, targets = np.concatenate(rows), np.concatenate(targets)
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).take(take) for c in (*AXES, "w")], pa.array(targets), pa.array(home[rows] == targets), pa.nulls(len(rows), pa.int64())], names)
            empty = [pa.array([0.0])] * len(AXES)
            yield pa.RecordBatch.from_arrays([*empty, pa.array([0]), pa.array([-1]), pa.array([False]), pa.array([whole])], names)

    names = [*AXES, "w", "tile", "own", "whole"]
    visiting = cut_lineage(at_home.mapInArrow(dealt, f"{_COLUMNS}, w bigint, tile bigint, own boolean, whole bigint"), "tile-visitors")

    def counted(table):
        own, guests = (table.filter(flag) for flag in (table.column("own"), pc.invert(table.column("own"))))
        home = _Nodes(_matrix(own), own.column("w").to_numpy(), BITS)
        whole, compared = count_close(home)
        if len(guests):
            more = count_close(home, _Nodes(_matrix(guests), guests.column("w").to_numpy(), BITS))
            whole, compared = whole + more[0], compared + more[1]
        return pa.table({"kind": ["whole_nodes", "compared"], "pairs": [whole, compared]})

    inside = visiting.where("whole is null").groupBy("tile").applyInArrow(counted, "kind string, pairs bigint")
    identical = vectors.select(F.lit("identical").alias("kind"), (F.col("w") * (F.col("w") - 1) / 2).cast("bigint").alias("pairs"))
    tiled = visiting.where("whole is not null").select(F.lit("whole_tiles").alias("kind"), F.col("whole").alias("pairs"))
    kinds = spark.createDataFrame([(k,) for k in ("identical", "whole_tiles", "whole_nodes", "compared")], "kind string")
    found = identical.unionByName(tiled).unionByName(inside).groupBy("kind").agg(F.sum("pairs").alias("pairs"))
    return kinds.join(found, "kind", "left").select("kind", F.coalesce("pairs", F.lit(0).cast("bigint")).alias("pairs"))


def near_duplicate_pairs_between(first, second):
    """One row: exact duplicates in both tables together, close pairs of rows in all, and those between a row of each table."""
    both = first.select(*FEATURES).unionByName(second.select(*FEATURES))
    total, one, two = (near_duplicate_pairs(rows).agg(F.sum("pairs").alias("n")) for rows in (both, first, second))
    copies = both.groupBy(*FEATURES).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("exact_duplicates"))
    joined = copies.crossJoin(total).crossJoin(one.select(F.col("n").alias("n1"))).crossJoin(two.select(F.col("n").alias("n2")))  # one-row sides
    return joined.select("exact_duplicates", F.col("n").alias("near_pairs"), (F.col("n") - F.col("n1") - F.col("n2")).alias("near_pairs_between"))


def _gaps(nodes, numbers, points):
    return np.maximum(nodes.low[numbers] - points, points - nodes.high[numbers]).max(axis=1)


def nearest_within(nodes, points, bound):
    """Distance of each point to the nearest other vector of a node tree, or ``bound`` (one each) where that is not larger.

    Each point first meets the leaf that the nearer boxes lead to; then only nodes nearer than its best are opened, nearer children first.
    """
    best, columns = np.array(bound, float), np.ascontiguousarray(nodes.vectors.T)

    def meet(rows, leaves):
        for at in range(0, len(rows), max(1, CHUNK // LEAF)):
            mine, leaf = rows[at: at + CHUNK // LEAF], leaves[at: at + CHUNK // LEAF]
            others = nodes.start[leaf][:, None] + np.arange(LEAF)
            others = np.minimum(others, nodes.stop[leaf][:, None] - 1)
            distance = np.abs(columns[0][others] - points[mine, 0][:, None])
            for axis in range(1, len(columns)):
                np.maximum(distance, np.abs(columns[axis][others] - points[mine, axis][:, None]), out=distance)
            distance[distance == 0] = np.inf  # the point itself
            np.minimum.at(best, mine, distance.min(axis=1))

    number, inner = np.zeros(len(points), int), np.arange(len(points))
    while len(inner := inner[nodes.left[number[inner]] >= 0]):
        left, right = nodes.left[number[inner]], nodes.right[number[inner]]
        number[inner] = np.where(_gaps(nodes, left, points[inner]) <= _gaps(nodes, right, points[inner]), left, right)
    meet(np.arange(len(points)), number)
    waiting, met = [(np.arange(len(points)), np.zeros(len(points), int))], number
    while waiting:
        rows, number = waiting.pop()
        if len(rows) > CHUNK:
            waiting.append((rows[CHUNK:], number[CHUNK:]))
            rows, number = rows[:CHUNK], number[:CHUNK]
        near = (number != met[rows]) & (_gaps(nodes, number, points[rows]) < best[rows])
        rows, number = rows[near], number[near]
        leaf = nodes.left[number] < 0
        meet(rows[leaf], number[leaf])
        rows, number = rows[~leaf], number[~leaf]
        if len(rows):
            left, right = nodes.left[number], nodes.right[number]
            first = _gaps(nodes, left, points[rows]) <= _gaps(nodes, right, points[rows])
            waiting += [(rows, np.where(first, right, left)), (rows, np.where(first, left, right))]
    return best


def nearest_distances(scores, tile_rows=20_000, sample_per_tile=100):
    """Distance of every distinct vector to its nearest other row, with the vector's multiplicity.

    Copies have distance 0. The others meet the vectors of their tile (see ``near_duplicate_pairs``), and then those of each other tile
    whose box is nearer than what was found at home: so few vectors leave their tile, however crowded the table. A vector without
    any other row, or with a component that is null or not finite, has a null distance.
    """
    spark = scores.sparkSession
    vectors = cut_lineage(weighted_vectors(scores), "vectors")
    whole = [F.coalesce(F.abs(a) < float("inf"), F.lit(False)) for a in AXES]
    finite = F.forall(F.array(*whole), lambda x: x)
    tree, at_home, boxes = _tiled(vectors.where(finite), tile_rows, sample_per_tile)
    shared = spark.sparkContext.broadcast((tree, boxes))  # one entry per ``tile_rows`` vectors
    names = [*AXES, "tile", "distance"]

    def result(points, tile, distance):
        return pa.table([*[pa.array(c) for c in points.T], pa.array(tile, pa.int64()), pa.array(distance)], names)

    def met_at_home(table):
        own, single = _matrix(table), table.column("w").to_numpy() == 1
        points = own[single]
        distance = nearest_within(_Nodes(own, np.ones(len(own), np.int64)), points, np.full(len(points), np.inf))
        return result(points, np.asarray(table.column("tile"))[single], distance)

    def travelling(batches):
        tree, boxes = shared.value
        for batch in batches:
            own, home, distance = _matrix(batch), batch.column("tile").to_numpy(), np.asarray(batch.column("distance")).copy()
            for row in np.flatnonzero(np.isinf(distance)):  # alone in its tile: some vector is no farther than a box's far corner
                far = [np.maximum(np.abs(own[row] - low), np.abs(high - own[row])).max() for t, (low, high, _) in boxes.items() if t != home[row]]
                distance[row] = np.nextafter(min(far, default=np.inf), np.inf)
            for near, tile in tree.visits(own, distance):
                near = near[home[near] != tile]
                if tile not in boxes or not len(near):
                    continue
                low, high, _ = boxes[tile]
                near = near[np.maximum(own[near] - high, low - own[near]).max(axis=1) < distance[near]]
                yield from result(own[near], np.full(len(near), tile), distance[near]).to_batches()

    def met_abroad(home, guests):
        points, home = _matrix(guests), _matrix(home)
        bound = np.asarray(guests.column("distance"))
        found = nearest_within(_Nodes(home, np.ones(len(home), np.int64)), points, bound)
        return result(points, np.asarray(guests.column("tile")), found).filter(pa.array(found < bound))

    schema = f"{_COLUMNS}, tile bigint, distance double"
    inside = cut_lineage(at_home.groupBy("tile").applyInArrow(met_at_home, schema), "nearest-at-home")
    guests = inside.mapInArrow(travelling, schema)
    abroad = at_home.groupBy("tile").cogroup(guests.groupBy("tile")).applyInArrow(met_abroad, schema)
    found = inside.unionByName(abroad).groupBy(*AXES).agg(F.min("distance").alias("distance"))
    done = vectors.where("w > 1").select(F.lit(0.0).alias("distance"), F.col("w"))
    lost = vectors.where(~finite & (F.col("w") == 1)).select(F.lit(None).cast("double").alias("distance"), F.col("w"))
    found = found.select(F.when(F.col("distance") < float("inf"), F.col("distance")).alias("distance"), F.lit(1).cast("bigint").alias("w"))
    return done.unionByName(found).unionByName(lost)


def nearest_distance_quantiles(scores):
    """Minimum, 1 % and median nearest distance over all rows."""
    return quantile_columns(
        nearest_distances(scores), [], "distance", {"min": 0.0, "p01": 0.01, "p50": 0.5}, weight="w"
    )
