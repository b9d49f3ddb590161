"""Points in regions and points near points (problem 5).

A bounded sample of the points drives a quadtree whose leaves hold about equally many
points. A point is owned by one leaf; a region, or a point to be found near others, is
replicated to every leaf it reaches. Each leaf probes an R-tree that is bulk-loaded from what was
replicated to it, and candidates are refined by exact geometry. A pair could show up in
several leaves only through the replicated side; it is reported in the leaf that owns its
reference point, the point that asks, so none is reported twice.

If the regions pass a check of their size, leaves and trees are sent to the tasks that read
the points, and no point is shuffled. Otherwise points and regions meet by leaf, with
crowded leaves split by salt.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetloom.operators.geometry import BoxTree, QuadTree, in_polygon, parse_polygons
from fleetloom.session import staged

SAMPLE_ROWS = 20_000  # points that shape the quadtree; which pairs are found doesn't depend on them
BROADCAST_BYTES = 8_000_000  # text of regions up to this size is sent to all tasks
LEAF_ROWS = 100_000  # points that one leaf should hold


def quadtree(points: DataFrame, x: str, y: str, leaf_rows: int = LEAF_ROWS, sample_rows: int = SAMPLE_ROWS, least_leaves: int = 64) -> tuple[QuadTree, int]:
    """A quadtree shaped by a sample of at most about ``sample_rows`` points, and the number of points."""
    n = points.count()
    share = min(1.0, sample_rows / max(1, n))
    rows = points.select(x, y).sample(share, seed=7).limit(2 * sample_rows).toPandas()
    most = max(1, min(int(len(rows) * leaf_rows / max(1, n)), len(rows) // least_leaves))
    return QuadTree.build(rows[x].to_numpy(float), rows[y].to_numpy(float), most), n


class Shipped:
    """A value sent once to each executor, together with the code of its classes."""

    def __init__(self, spark: SparkSession, value):
        self._bytes = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @property
    def value(self):
        return cloudpickle.loads(self._bytes.value)


class RegionIndex:
    """For each leaf, an R-tree over the parts of the regions that reach it."""

    def __init__(self, tree: QuadTree, regions: list[tuple[str, list]]):
        self.tree = tree
        self.ids = [i for i, _ in regions]
        self.parts = [(k, rings) for k, (_, polygons) in enumerate(regions) for rings in polygons]
        self.boxes = np.array([[*r[0].min(axis=0), *r[0].max(axis=0)] for _, r in self.parts]).reshape(-1, 4)
        held: dict[int, list[int]] = {}
        for part, box in enumerate(self.boxes):
            for leaf in tree.overlaps(box):
                held.setdefault(int(leaf), []).append(part)
        self.leaves = {leaf: (BoxTree(self.boxes[own]), np.array(own)) for leaf, own in held.items()}

    def contains(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (point, region), each once, however many parts of the region hold the point."""
        leaf = self.tree.leaf(x, y)
        order = np.argsort(leaf, kind="stable")
        cuts = np.flatnonzero(np.diff(leaf[order])) + 1
        points, parts = [], []
        for own in np.split(order, cuts):
            if len(own) and (found := self.leaves.get(int(leaf[own[0]]))):
                p, b = found[0].probe(x[own], y[own])
                points.append(own[p])
                parts.append(found[1][b])
        if not points:
            return np.empty(0, int), np.empty(0, int)
        point, part = np.concatenate(points), np.concatenate(parts)
        keep = np.zeros(len(point), bool)
        order = np.argsort(part, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
            if len(own):
                keep[own] = in_polygon(x[point[own]], y[point[own]], self.parts[part[own[0]]][1])
        region = np.array([k for k, _ in self.parts])[part[keep]]
        pairs = np.unique(np.column_stack([point[keep], region]), axis=0)
        return pairs[:, 0], pairs[:, 1]


def _on_globe(x: Column, y: Column) -> Column:
    return x.between(-180, 180) & y.between(-90, 90)


def regions_of_points(points: DataFrame, regions: DataFrame, *, point_id: str, x: str, y: str, region_id: str, geometry: str, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The regions that contain each point: point_id and region_id, once for each pair.

    Points with a null id or coordinate, or off the globe, are in no region, nor is anything in a
    region with a null id or an unreadable geometry. Rows that are equal count as
    several points. Points on an edge follow the half-open rule of ``in_ring``.
    """
    px, py = F.col(x), F.col(y)
    pts = points.where(F.col(point_id).isNotNull() & _on_globe(px, py)).select(F.col(point_id).alias("pid"), px.cast("double").alias("x"), py.cast("double").alias("y"))
    areas = regions.where(F.col(region_id).isNotNull() & F.col(geometry).isNotNull()).select(F.col(region_id).alias("rid"), F.col(geometry).alias("g"))
    id_types = dict(pts.dtypes)["pid"], dict(areas.dtypes)["rid"]
    schema = f"{point_id} {id_types[0]}, {region_id} {id_types[1]}"
    tree, n = quadtree(pts, "x", "y")
    if (areas.agg(F.sum(F.octet_length("g"))).first()[0] or 0) <= broadcast_bytes:
        known = [(r.rid, p) for r in areas.collect() if (p := parse_polygons(r.g))]
        index = Shipped(points.sparkSession, RegionIndex(tree, known))

        def probe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own = index.value
            ids = np.array(own.ids, dtype=object)
            for f in frames:
                p, r = own.contains(f["x"].to_numpy(), f["y"].to_numpy())
                yield pd.DataFrame({point_id: f["pid"].to_numpy()[p], region_id: ids[r]})

        return pts.mapInPandas(probe, schema)

    salts = _salts(tree, n)
    shipped = Shipped(points.sparkSession, (tree, salts))

    def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, ways = shipped.value
        for f in frames:
            rows = []
            for rid, text in zip(f["rid"], f["g"]):
                polygons = parse_polygons(text)
                leaves = {int(leaf) for rings in polygons or [] for leaf in own.overlaps([*rings[0].min(axis=0), *rings[0].max(axis=0)])}
                rows += [(leaf, s, rid, text) for leaf in leaves for s in range(ways[leaf])]
            yield pd.DataFrame(rows, columns=["leaf", "salt", "rid", "g"])

    def meet(p: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        known = [(rid, polygons) for rid, t in zip(r["rid"], r["g"]) if (polygons := parse_polygons(t))]
        if p.empty or not known:
            return pd.DataFrame({point_id: p["pid"][:0], region_id: r["rid"][:0]})
        own = RegionIndex(shipped.value[0], known)
        a, b = own.contains(p["x"].to_numpy(), p["y"].to_numpy())
        return pd.DataFrame({point_id: p["pid"].to_numpy()[a], region_id: np.array(own.ids, dtype=object)[b]})

    placed = _owned(pts, shipped, f"pid {id_types[0]}, x double, y double")
    replicated = areas.mapInPandas(spread, f"leaf long, salt long, rid {id_types[1]}, g string")
    return placed.groupBy("leaf", "salt").cogroup(replicated.groupBy("leaf", "salt")).applyInPandas(meet, schema)


def _salts(tree: QuadTree, n: int) -> np.ndarray:
    """Into how many parts the points of each leaf are split: one for each LEAF_ROWS expected."""
    expected = tree.weights / max(1, tree.weights.sum()) * n
    return np.maximum(1, np.ceil(expected / LEAF_ROWS)).astype(int)


def _owned(pts: DataFrame, shipped: Shipped, schema: str) -> DataFrame:
    """Points with the leaf that owns them and a salt."""

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, ways = shipped.value
        turn = 0
        for f in frames:
            leaf = tree.leaf(f["x"].to_numpy(), f["y"].to_numpy())
            salt = (np.arange(len(f)) + turn) % ways[leaf]
            turn += len(f)
            yield f.assign(leaf=leaf, salt=salt)

    return pts.mapInPandas(place, f"{schema}, leaf long, salt long")


def near_counts(points: DataFrame, *, point_id: str, x: str, y: str, metres: float) -> DataFrame:
    """For each point, the other points within a distance: point_id, near (their number), nearest_m (null if none).

    ``x`` is longitude, ``y`` latitude. Points at one place are worked on as one, so that copies are
    counted, not paired. Points with a null id or coordinate, or off the globe, have no
    row and aren't counted. Distances are great-circle, over the 180th meridian and the poles too. Whole
    branches of a tree that lie within the distance are counted by their sums, so a dense spot isn't all pairs.
    """
    px, py = F.col(x), F.col(y)
    pts = points.where(F.col(point_id).isNotNull() & _on_globe(px, py)).select(F.col(point_id).alias("pid"), px.cast("double").alias("x"), py.cast("double").alias("y"))
    places = staged(pts.groupBy("x", "y").agg(F.count("*").alias("n")), "places")
    tree, n = quadtree(places, "x", "y", leaf_rows=20_000)
    shipped = Shipped(points.sparkSession, (tree, _salts(tree, n)))

    def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, ways = shipped.value
        for f in frames:
            if f.empty:
                continue
            row, leaf = _leaves_in_reach(own, f["x"].to_numpy(), f["y"].to_numpy(), metres)
            ways_of = ways[leaf]
            salt = np.arange(ways_of.sum()) - np.repeat(np.cumsum(ways_of) - ways_of, ways_of)
            row, leaf = np.repeat(row, ways_of), np.repeat(leaf, ways_of)
            yield f.iloc[row].assign(leaf=leaf, salt=salt)

    def meet(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        ax, ay = p["x"].to_numpy(), p["y"].to_numpy()
        if q.empty or p.empty:
            return pd.DataFrame({"x": ax, "y": ay, "all_near": np.zeros(len(p), np.int64), "apart_m": None})
        near, nearest = CountTree(q["x"].to_numpy(), q["y"].to_numpy(), q["n"].to_numpy()).around(ax, ay, metres)
        return pd.DataFrame({"x": ax, "y": ay, "all_near": near, "apart_m": np.where(np.isinf(nearest), None, nearest)})

    asked = _owned(places.select("x", "y"), shipped, "x double, y double").groupBy("leaf", "salt")
    found = asked.cogroup(places.mapInPandas(spread, "x double, y double, n long, leaf long, salt long").groupBy("leaf", "salt")).applyInPandas(
        meet, "x double, y double, all_near long, apart_m double"
    )
    # a place is near itself: of its own n points, n - 1 are others
    found = found.join(places, ["x", "y"])
    return pts.join(found, ["x", "y"]).select(
        F.col("pid").alias(point_id), (F.col("all_near") - 1).alias("near"), F.when(F.col("n") > 1, F.lit(0.0)).otherwise(F.col("apart_m")).alias("nearest_m")
    )


def _leaves_in_reach(tree: QuadTree, x: np.ndarray, y: np.ndarray, metres: float) -> tuple[np.ndarray, np.ndarray]:
    """Each point with every leaf that has a place within the distance of it: (point, leaf), each pair once."""
    boxes, home = _reach(x, y, metres), tree.leaf(x, y)
    inner = tree.boxes[home]
    alone = (inner[:, 0] < boxes[:, 0]) & (boxes[:, 2] < inner[:, 2]) & (inner[:, 1] < boxes[:, 1]) & (boxes[:, 3] < inner[:, 3])
    points, leaves = [np.flatnonzero(alone)], [home[alone]]
    rim, step = np.flatnonzero(~alone), max(1, 2_000_000 // len(tree.boxes))
    for a in range(0, len(rim), step):
        own = rim[a : a + step]
        b, t = boxes[own][:, None, :], tree.boxes[None, :, :]
        up = (t[..., 1] <= b[..., 3]) & (b[..., 1] <= t[..., 3])
        across = np.zeros(up.shape, bool)
        for turn in (-360.0, 0.0, 360.0):
            across |= (t[..., 0] <= b[..., 2] + turn) & (b[..., 0] + turn <= t[..., 2])
        i, leaf = np.nonzero(up & across)
        points.append(own[i])
        leaves.append(leaf)
    return np.concatenate(points), np.concatenate(leaves).astype(int)


class CountTree:
    """Weighted places in a binary tree of boxes with sums, to count what lies within a distance without looking at each place."""

    LEAF = 16

    def __init__(self, x: np.ndarray, y: np.ndarray, n: np.ndarray):
        order = np.arange(len(x))
        nodes, waiting = [], [(0, len(x))]
        children: list[tuple[int, int]] = []
        while waiting:
            later = []
            for a, b in waiting:
                own = order[a:b]
                nodes.append((a, b, x[own].min(), y[own].min(), x[own].max(), y[own].max(), n[own].sum()))
                if b - a <= self.LEAF:
                    children.append((-1, -1))
                    continue
                v = x[own] if np.ptp(x[own]) > np.ptp(y[own]) else y[own]
                order[a:b] = own[np.argpartition(v, (b - a) // 2)]
                children.append((0, 0))
                later += [(a, a + (b - a) // 2), (a + (b - a) // 2, b)]
            waiting = later
        # nodes are level by level: the children of inner nodes follow in their order
        inner = np.array([c[0] == 0 for c in children])
        self.left = np.where(inner, 1 + 2 * (np.cumsum(inner) - 1), -1)
        table = np.array(nodes)
        self.start, self.end, self.box, self.sums = table[:, 0].astype(int), table[:, 1].astype(int), table[:, 2:6], n[order].astype(np.int64)
        self.total = table[:, 6].astype(np.int64)
        self.x, self.y = x[order], y[order]

    def _bounds(self, x: np.ndarray, y: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest distance that a place in a node's box can have."""
        box = self.box[node]
        low = np.maximum(0.0, np.maximum(box[:, 0] - x, x - box[:, 2])), np.maximum(0.0, np.maximum(box[:, 1] - y, y - box[:, 3]))
        high = np.maximum(np.abs(box[:, 0] - x), np.abs(box[:, 2] - x)), np.maximum(np.abs(box[:, 1] - y), np.abs(box[:, 3] - y))
        across = np.minimum(low[0], np.maximum(0.0, 360.0 - high[0])), np.minimum(high[0], 180.0)
        south, north = np.cos(np.radians(box[:, 1])), np.cos(np.radians(box[:, 3]))
        least, most = np.minimum(south, north), np.where((box[:, 1] <= 0) & (box[:, 3] >= 0), 1.0, np.maximum(south, north))
        here, half = np.cos(np.radians(y)), lambda d: np.sin(np.radians(d) / 2) ** 2
        metres = lambda h: 2 * 6_371_000.0 * np.arcsin(np.sqrt(np.clip(h, 0.0, 1.0)))
        return metres(half(low[1]) + here * least * half(across[0])), metres(half(high[1]) + here * most * half(across[1]))

    def around(self, x: np.ndarray, y: np.ndarray, metres: float, at_once: int = 2000) -> tuple[np.ndarray, np.ndarray]:
        """For each point the weight of all places within the distance, and how far the nearest of those is that isn't at the point itself."""
        near, nearest = np.zeros(len(x), np.int64), np.full(len(x), np.inf)
        for a in range(0, len(x), at_once):
            own = slice(a, a + at_once)
            near[own] = self._count(x[own], y[own], metres)
            nearest[own] = self._nearest(x[own], y[own], metres)
        return near, nearest

    def _places(self, point: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.end[node] - self.start[node]
        return np.repeat(point, size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - self.start[node], size)

    def _count(self, x: np.ndarray, y: np.ndarray, metres: float) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        point, node = np.arange(len(x)), np.zeros(len(x), int)
        while len(point):
            low, high = self._bounds(x[point], y[point], node)
            whole = high <= metres * (1 - 1e-9) - 1e-6
            np.add.at(out, point[whole], self.total[node[whole]])
            rest = ~whole & (low <= metres * (1 + 1e-9) + 1e-6)
            point, node = point[rest], node[rest]
            leaf = self.left[node] < 0
            i, j = self._places(point[leaf], node[leaf])
            within = _haversine(y[i], x[i], self.y[j], self.x[j]) <= metres
            np.add.at(out, i[within], self.sums[j[within]])
            point, node = np.repeat(point[~leaf], 2), np.repeat(self.left[node[~leaf]], 2)
            node[1::2] += 1
        return out

    def _nearest(self, x: np.ndarray, y: np.ndarray, metres: float) -> np.ndarray:
        out = np.full(len(x), np.inf)
        stack = [(np.arange(len(x)), np.zeros(len(x), int))]
        while stack:  # the nearer child first, so that the bound soon is short
            point, node = stack.pop()
            low, _ = self._bounds(x[point], y[point], node)
            rest = low <= np.minimum(out[point], metres) * (1 + 1e-9) + 1e-6
            point, node = point[rest], node[rest]
            leaf = self.left[node] < 0
            i, j = self._places(point[leaf], node[leaf])
            d = _haversine(y[i], x[i], self.y[j], self.x[j])
            some = (d > 0) & (d <= metres)
            np.minimum.at(out, i[some], d[some])
            point, child = point[~leaf], self.left[node[~leaf]]
            if len(point):
                a, b = self._bounds(x[point], y[point], child)[0], self._bounds(x[point], y[point], child + 1)[0]
                first = np.where(a <= b, child, child + 1)
                stack += [(point, 2 * child + 1 - first), (point, first)]
        return out


def _reach(x: np.ndarray, y: np.ndarray, metres: float) -> np.ndarray:
    """Boxes that hold everything within a distance of each point."""
    dy = metres / 111_000.0
    dx = np.minimum(360.0, dy / np.maximum(1e-9, np.cos(np.radians(np.minimum(90, np.abs(y) + dy)))))
    return np.column_stack([x - dx, y - dy, x + dx, y + dy])


def _haversine(lat1, lon1, lat2, lon2) -> np.ndarray:
    up, across = np.sin(np.radians(lat2 - lat1) / 2), np.sin(np.radians(lon2 - lon1) / 2)
    h = up * up + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * across * across
    return 2 * 6_371_000.0 * np.arcsin(np.sqrt(np.minimum(1.0, h)))
