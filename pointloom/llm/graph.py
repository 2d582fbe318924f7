"""Connected components of an edge table, without collecting any part of it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def star_edges(edges: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Replace edges by (node, least node of its component), leaving the components unchanged."""
    a = np.concatenate([x for x, _ in edges])
    b = np.concatenate([y for _, y in edges])
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        while not np.array_equal(new, hop := new[new]):
            new = hop
        if np.array_equal(new, label):
            break
        label = new
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u, v): root is the least node of its component.

    Each round hooks every node to its least neighbour, jumps pointers until they rest on
    local minima and contracts the edges to these; at most half of the nodes remain, so
    rounds are logarithmic in the nodes. Every round's tables are written to the shared
    folder. Degrees are pre-aggregated, so a hub is a key of one row per task.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = materialize(edges, "edges")
    mapping = None
    while not edges.isEmpty():
        both = edges.select(F.col("u").alias("node"), F.col("v").alias("near")).unionByName(edges.select(F.col("v").alias("node"), F.col("u").alias("near")))
        hook = materialize(both.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("root")), "hook")
        while True:
            up = hook.select(F.col("node").alias("root"), F.col("root").alias("top"))
            hop = materialize(hook.join(up, "root").select("node", F.col("top").alias("root"), (F.col("top") != F.col("root")).alias("moved")), "hook")
            moved = not hop.where("moved").isEmpty()
            discard(hook)
            hook = hop.select("node", "root")
            hook._materialized_path = hop._materialized_path
            if not moved:
                break
        if mapping is None:
            mapping = hook
        else:
            up = hook.select(F.col("node").alias("root"), F.col("root").alias("top"))
            old = mapping
            mapping = materialize(mapping.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "roots")
            discard(old)
        a = hook.select(F.col("node").alias("u"), F.col("root").alias("ru"))
        b = hook.select(F.col("node").alias("v"), F.col("root").alias("rv"))
        rest = edges.join(a, "u").join(b, "v").where("ru <> rv")
        rest = rest.select(F.greatest("ru", "rv").alias("u"), F.least("ru", "rv").alias("v")).distinct()
        old, edges = edges, materialize(rest, "edges")
        discard(old)
    if mapping is None:
        mapping = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return mapping
