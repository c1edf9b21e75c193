"""Positions of nodes: clusters, hulls and a force layout, one graph per group."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cluster_count(n: int) -> int:
    return min(8, max(3, math.isqrt(n // 2)))


def kmeans(points: np.ndarray, k: int | None = None, steps: int = 20) -> np.ndarray:
    """Lloyd steps from the first point and then the farthest ones."""
    k = min(len(points), cluster_count(len(points)) if k is None else k)
    if not k:
        return np.empty(0, int)
    centres = [points[0]]
    while len(centres) < k:
        centres.append(points[np.argmax(np.min([((points - c) ** 2).sum(axis=1) for c in centres], axis=0))])
    centres = np.array(centres)
    label = np.full(len(points), -1)
    for _ in range(steps):
        new = ((points[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        if (new == label).all():
            break
        label = new
        for c in range(k):
            if (label == c).any():
                centres[c] = points[label == c].mean(axis=0)
    return label


def convex_hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Corners of the hull, counter-clockwise from the smallest point."""
    p = sorted(set(points))
    if len(p) < 3:
        return p
    turn = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])

    def chain(rows):
        out = []
        for x in rows:
            while len(out) > 1 and turn(out[-2], out[-1], x) <= 0:
                out.pop()
            out.append(x)
        return out[:-1]

    return chain(p) + chain(p[::-1])


def clusters(points: DataFrame) -> DataFrame:
    """``(graph, id, cluster)`` of ``points(graph, id, x, y)``; points go in order of id."""
    kinds = dict(points.dtypes)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("id")
        return pd.DataFrame({"graph": g["graph"], "id": g["id"], "cluster": kmeans(g[["x", "y"]].to_numpy(float))})

    return points.groupBy("graph").applyInPandas(run, f"graph {kinds['graph']}, id {kinds['id']}, cluster long")


def force_layout(n: int, pairs: list[tuple[int, int]], ticks: int = 300, repulsion: float = 300.0, rest: float = 60.0, seed: int = 0) -> np.ndarray:
    """Positions after true repulsion between all nodes, springs along edges and cooling by 0.995 a tick."""
    rng = np.random.default_rng(seed)
    angle = 2 * np.pi * np.arange(n) / max(n, 1)
    x = np.stack((np.cos(angle), np.sin(angle)), axis=1) * 10 * math.sqrt(max(n, 1)) + rng.normal(0, 0.01, (n, 2))
    v, alpha = np.zeros((n, 2)), 1.0
    ends = np.array(pairs, int).reshape(-1, 2)
    a, b = ends.T
    degree = np.bincount(ends.reshape(-1), minlength=n).clip(1)
    shares = degree[ends][..., None] * np.array([1.0, -1.0])[:, None]
    for _ in range(ticks):
        d = x[:, None] - x[None]
        r2 = (d**2).sum(axis=2) + 1.0
        force = repulsion * (d / r2[..., None]).sum(axis=1)
        gap = x[b] - x[a]
        length = np.maximum(np.hypot(gap[:, 0], gap[:, 1]), 1e-6)[:, None]
        pull = 0.1 * (length - rest) * gap / length
        np.add.at(force, ends, pull[:, None] / shares)  # in the order of the edges
        v = np.clip((v + alpha * force) * 0.6, -200, 200)
        x = x + alpha * v * 0.1
        alpha *= 0.995
    return x


def layouts(edges: DataFrame, ticks: int = 300) -> DataFrame:
    """``(graph, id, x, y)`` of each graph of ``edges(graph, src, dst)``."""
    kinds = dict(edges.dtypes)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        names = sorted({*g["src"], *g["dst"]})
        at = {v: i for i, v in enumerate(names)}
        pairs = sorted({(min(at[a], at[b]), max(at[a], at[b])) for a, b in zip(g["src"], g["dst"], strict=True) if a != b})
        x = force_layout(len(names), pairs, ticks)
        return pd.DataFrame({"graph": g["graph"].iloc[0], "id": names, "x": x[:, 0], "y": x[:, 1]})

    # A given number: few bytes take long here, so partitions mustn't be joined by their size.
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return edges.repartition(parts, "graph").groupBy("graph").applyInPandas(run, f"graph {kinds['graph']}, id {kinds['src']}, x double, y double")


def cluster_keywords(clusters: DataFrame, keywords: DataFrame) -> DataFrame:
    """Strongest keyword of each cluster by summed score, ties to the smaller word; ``keywords(id, keyword, score)``."""
    sums = clusters.join(keywords, "id").groupBy("graph", "cluster", "keyword").agg(F.sum("score").alias("score"))
    best = F.min_by("keyword", F.struct(-F.col("score"), F.col("keyword")))
    return sums.groupBy("graph", "cluster").agg(best.alias("keyword"))


def hulls(points: DataFrame) -> DataFrame:
    """``(graph, cluster, corners)`` of ``points(graph, cluster, x, y)``."""
    kinds = dict(points.dtypes)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        corners = [{"x": x, "y": y} for x, y in convex_hull(list(zip(g["x"], g["y"], strict=True)))]
        return pd.DataFrame([(g["graph"].iloc[0], g["cluster"].iloc[0], corners)], columns=["graph", "cluster", "corners"])

    return points.groupBy("graph", "cluster").applyInPandas(run, f"graph {kinds['graph']}, cluster {kinds['cluster']}, corners array<struct<x:double,y:double>>")
