"""Polygons out of text, exact containment, a bulk-loaded R-tree and a quadtree, on arrays."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import numpy as np

Rings = list[np.ndarray]  # the outer ring, then holes; each of shape (n, 2), closed


def _ring(points) -> np.ndarray:
    ring = np.array([[float(p[0]), float(p[1])] for p in points])
    if len(ring) and (ring[0] != ring[-1]).any():
        ring = np.vstack([ring, ring[:1]])
    if len(ring) < 4 or not np.isfinite(ring).all():
        raise ValueError("not a ring")
    return ring


def _from_json(value: dict) -> list[Rings]:
    kind = str(value.get("type")).lower()
    if kind == "feature":
        return _from_json(value["geometry"])
    if kind == "polygon":
        return [[_ring(r) for r in value["coordinates"]]]
    if kind == "multipolygon":
        return [[_ring(r) for r in p] for p in value["coordinates"]]
    raise ValueError("unsupported geometry type")


def _from_wkt(text: str) -> list[Rings]:
    m = re.fullmatch(r"\s*(?:SRID\s*=\s*\d+\s*;)?\s*(MULTIPOLYGON|POLYGON)\s*(?:ZM|Z|M)?\s*(\(.*\))\s*;?\s*", text, re.I | re.S)
    if not m:
        raise ValueError("unsupported text")
    # the nesting of a WKT body is that of a list of lists of points
    body = re.sub(r"[^(),]+", lambda t: f"[{','.join(t[0].split())}]" if t[0].strip() else "", m[2])
    value = json.loads(body.replace("(", "[").replace(")", "]"))
    polygons = [value] if m[1].upper() == "POLYGON" else value
    return [[_ring(r) for r in p] for p in polygons]


def parse_polygons(text: str | None) -> list[Rings] | None:
    """Polygons of a (multi)polygon in GeoJSON, WKT or EWKT; None if the text can't be read.

    Open rings are closed. A polygon without rings, a ring of fewer than three corners and
    any other type of geometry count as unreadable.
    """
    if text is None:
        return None
    try:
        polygons = _from_json(json.loads(text)) if text.lstrip().startswith("{") else _from_wkt(text)
    except (ValueError, TypeError, KeyError, IndexError, AttributeError, RecursionError):
        return None
    return polygons if polygons and all(p for p in polygons) else None


def in_ring(x: np.ndarray, y: np.ndarray, ring: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """Even-odd rule, half open: an edge counts from its lower end up to, not including, its upper end."""
    x1, y1, x2, y2 = ring[:-1, 0], ring[:-1, 1], ring[1:, 0], ring[1:, 1]
    out = np.zeros(len(x), bool)
    step = max(1, block // max(1, len(x1)))
    slope = np.divide(x2 - x1, y2 - y1, out=np.zeros(len(x1)), where=y2 != y1)
    for a in range(0, len(x), step):
        px, py = x[a : a + step, None], y[a : a + step, None]
        out[a : a + step] = (((y1 > py) != (y2 > py)) & (px < slope * (py - y1) + x1)).sum(axis=1) % 2 == 1
    return out


def in_polygon(x: np.ndarray, y: np.ndarray, rings: Rings) -> np.ndarray:
    """Inside the outer ring and in no hole."""
    inside = in_ring(x, y, rings[0])
    for hole in rings[1:]:
        at = np.flatnonzero(inside)
        if len(at):
            inside[at] &= ~in_ring(x[at], y[at], hole)
    return inside


class BoxTree:
    """R-tree over boxes (xmin, ymin, xmax, ymax), bulk-loaded by sorting and tiling, probed with many points at once."""

    def __init__(self, boxes: np.ndarray, fan_out: int = 16):
        self.fan_out = fan_out
        n = len(boxes)
        cx, cy = (boxes[:, 0] + boxes[:, 2]) / 2, (boxes[:, 1] + boxes[:, 3]) / 2
        order = np.argsort(cx, kind="stable")
        slices = max(1, round((n / fan_out) ** 0.5)) if n else 1
        self.order = np.concatenate([s[np.argsort(cy[s], kind="stable")] for s in np.array_split(order, slices)]) if n else order
        self.levels = [boxes[self.order]]
        while len(self.levels[-1]) > fan_out:
            low = self.levels[-1]
            at = np.arange(0, len(low), fan_out)
            self.levels.append(
                np.column_stack([np.minimum.reduceat(low[:, 0], at), np.minimum.reduceat(low[:, 1], at), np.maximum.reduceat(low[:, 2], at), np.maximum.reduceat(low[:, 3], at)])
            )

    def probe(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (point, box) where the box contains the point, edges included."""
        top = self.levels[-1]
        point, node = np.repeat(np.arange(len(x)), len(top)), np.tile(np.arange(len(top)), len(x))
        for depth in range(len(self.levels) - 1, -1, -1):
            box = self.levels[depth][node]
            hit = (box[:, 0] <= x[point]) & (x[point] <= box[:, 2]) & (box[:, 1] <= y[point]) & (y[point] <= box[:, 3])
            point, node = point[hit], node[hit]
            if depth:
                size = len(self.levels[depth - 1])
                child = (node[:, None] * self.fan_out + np.arange(self.fan_out)).ravel()
                point = np.repeat(point, self.fan_out)[child < size]
                node = child[child < size]
        return point, self.order[node]


@dataclass
class QuadTree:
    """Leaves of a quadtree over the globe, in the order of their Morton codes."""

    starts: np.ndarray  # first code of each leaf at the deepest level
    boxes: np.ndarray  # xmin, ymin, xmax, ymax
    weights: np.ndarray  # sampled points in each leaf
    depth: int

    @staticmethod
    def build(x: np.ndarray, y: np.ndarray, most: int, depth: int = 20) -> QuadTree:
        """Split cells until none holds more than ``most`` of the sampled points, or is of the last level."""
        codes = np.sort(morton(x, y, depth))
        starts, boxes, weights = [], [], []
        stack = [(0, 0, 0, 0)]  # level, column, row, code of the cell at its level
        while stack:
            level, col, row, code = stack.pop()
            shift = 2 * (depth - level)
            first, last = np.searchsorted(codes, [code << shift, (code + 1) << shift])
            if last - first > most and level < depth:
                stack += [(level + 1, 2 * col + (q & 1), 2 * row + (q >> 1), 4 * code + q) for q in (3, 2, 1, 0)]
                continue
            w, h = 360 / 2**level, 180 / 2**level
            starts.append(code << shift)
            boxes.append((-180 + col * w, -90 + row * h, -180 + (col + 1) * w, -90 + (row + 1) * h))
            weights.append(last - first)
        return QuadTree(np.array(starts), np.array(boxes), np.array(weights), depth)

    def leaf(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The one leaf that owns each point."""
        return np.searchsorted(self.starts, morton(x, y, self.depth), side="right") - 1

    def overlaps(self, box) -> np.ndarray:
        """Leaves that a box touches."""
        b = self.boxes
        return np.flatnonzero((b[:, 0] <= box[2]) & (box[0] <= b[:, 2]) & (b[:, 1] <= box[3]) & (box[1] <= b[:, 3]))


def morton(x: np.ndarray, y: np.ndarray, depth: int) -> np.ndarray:
    """Interleaved bits of the cell's column and row."""
    n = 1 << depth
    col = np.clip(np.floor((np.asarray(x, float) + 180) / 360 * n), 0, n - 1).astype(np.int64)
    row = np.clip(np.floor((np.asarray(y, float) + 90) / 180 * n), 0, n - 1).astype(np.int64)
    code = np.zeros(len(col), np.int64)
    for bit in range(depth):
        code |= ((col >> bit & 1) << (2 * bit)) | ((row >> bit & 1) << (2 * bit + 1))
    return code
