"""Map outlines: shared arcs of a topology as simplified GeoJSON polygons. An offline tool over small inputs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def decoded(arc: list[list[float]], scale: tuple[float, float], translate: tuple[float, float]) -> np.ndarray:
    """Points of an arc whose steps are quantised differences."""
    return np.cumsum(np.asarray(arc, float), axis=0) * np.asarray(scale) + np.asarray(translate)


def simplified(points: np.ndarray, tolerance: float) -> np.ndarray:
    """The points that stay when each run is replaced by its chord unless a point lies farther than tolerance from it."""
    keep = np.zeros(len(points), bool)
    keep[[0, -1]] = True
    todo = [(0, len(points) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        chord, inner = points[b] - points[a], points[a + 1 : b] - points[a]
        size = np.hypot(*chord)
        away = np.hypot(*inner.T) if size == 0 else np.abs(chord[0] * inner[:, 1] - chord[1] * inner[:, 0]) / size
        far = int(away.argmax())
        if away[far] > tolerance:
            keep[a + 1 + far] = True
            todo += [(a, a + 1 + far), (a + 1 + far, b)]
    return points[keep]


def simplify_arcs(arcs: DataFrame, tolerance: float, digits: int = 4) -> DataFrame:
    """(arc, points) of (arc, points array<array<double>>), each arc by itself."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            done = [np.round(simplified(np.array([list(p) for p in pts], float), tolerance), digits).tolist() for pts in f["points"]]
            yield pd.DataFrame({"arc": f["arc"], "points": done})

    return arcs.select("arc", "points").mapInPandas(run, "arc long, points array<array<double>>")


def ring(numbers: list[int], arcs: dict[int, list[list[float]]]) -> list[list[float]]:
    """The points of a ring given by arc numbers; ~n is arc n reversed. Shared ends are not repeated."""
    out: list[list[float]] = []
    for k in numbers:
        points = arcs[k] if k >= 0 else arcs[~k][::-1]
        out += points[1 if out else 0 :]
    return out


def geojson(topology: dict, name: str, tolerance: float, digits: int = 4) -> dict:
    """The features of one object of a topology, simplified arc by arc so that neighbours keep common borders."""
    t = topology.get("transform", {"scale": (1, 1), "translate": (0, 0)})
    quantised = "transform" in topology
    arcs = {k: np.round(simplified(decoded(a, t["scale"], t["translate"]) if quantised else np.asarray(a, float), tolerance), digits).tolist() for k, a in enumerate(topology["arcs"])}
    features = []
    for g in topology["objects"][name]["geometries"]:
        polygons = [g["arcs"]] if g["type"] == "Polygon" else g["arcs"]
        shapes = [[ring(r, arcs) for r in p] for p in polygons]
        features.append({"type": "Feature", "properties": g.get("properties", {}), "geometry": {"type": g["type"], "coordinates": shapes[0] if g["type"] == "Polygon" else shapes}})
    return {"type": "FeatureCollection", "features": features}
