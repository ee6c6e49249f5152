"""Measures of edges(keys, ch_i, ch_j, w) with ch_i < ch_j."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.kernels import betweenness as between
from ..functions.kernels import laplacian_entropy, min_cut


def both_ways(edges: DataFrame, by: list[str]) -> DataFrame:
    return edges.select(*by, F.col("ch_i").alias("node"), F.col("ch_j").alias("peer"), "w").union(edges.select(*by, F.col("ch_j").alias("node"), F.col("ch_i").alias("peer"), "w"))


def strongest(edges: DataFrame, by: list[str], density: float) -> DataFrame:
    """The strongest edges up to ``density`` of all possible ones; equal ones at the limit all stay."""
    w = W.partitionBy(*by)
    return edges.withColumns({"_r": F.rank().over(w.orderBy(F.col("w").desc())), "_n": F.count("*").over(w)}).where(F.col("_r") <= F.round(F.col("_n") * density)).drop("_r", "_n")


def node_strength(edges: DataFrame, by: list[str]) -> DataFrame:
    """Strength, degree and rank of each node."""
    own = both_ways(edges, by).groupBy(*by, "node").agg(F.sum("w").alias("strength"), F.count_if(F.col("w") > 0).alias("degree"))
    return own.withColumn("hub_rank", F.row_number().over(W.partitionBy(*by).orderBy(F.round("strength", 9).desc(), F.col("node"))))


def weighted_clustering(edges: DataFrame, by: list[str]) -> DataFrame:
    """Mean over each node's pairs of neighbours of the geometric mean of the triangle's weights (over the largest weight)."""
    top = edges.withColumn("w", F.col("w") / F.max("w").over(W.partitionBy(*by))).where("w > 0")
    e = both_ways(top, by)
    a, b, c = e.alias("a"), e.select(*by, "node", F.col("peer").alias("third"), F.col("w").alias("w2")), e.select(*by, F.col("node").alias("peer"), F.col("peer").alias("third"), F.col("w").alias("w3"))
    tri = a.join(b, [*by, "node"]).where("peer < third").join(c, [*by, "peer", "third"], "left")
    return tri.groupBy(*by, "node").agg((F.sum(F.coalesce(F.cbrt(F.col("w") * F.col("w2") * F.col("w3")), F.lit(0.0))) / F.count("*")).alias("clustering"))


def participation(edges: DataFrame, modules: DataFrame, by: list[str]) -> DataFrame:
    """1 - the sum over modules (roi, channel) of the squared share of a node's strength that goes there."""
    m = F.broadcast(modules.select(F.col("channel").alias("peer"), "roi"))
    own = both_ways(edges, by).join(m, "peer").groupBy(*by, "node", "roi").agg(F.sum("w").alias("_k"))
    return own.withColumn("_q", F.col("_k") / F.sum("_k").over(W.partitionBy(*by, "node"))).groupBy(*by, "node").agg((1 - F.sum(F.col("_q") ** 2)).alias("participation"))


def matrix_measures(edges: DataFrame, by: list[str]) -> DataFrame:
    """Minimum cut and Laplacian entropy of each graph; a graph has no more nodes than a session has channels."""

    def run(own: pd.DataFrame) -> pd.DataFrame:
        nodes = sorted({*own["ch_i"], *own["ch_j"]})
        at = {c: i for i, c in enumerate(nodes)}
        w = np.zeros((len(nodes), len(nodes)))
        for r in own.itertuples():
            w[at[r.ch_i], at[r.ch_j]] = w[at[r.ch_j], at[r.ch_i]] = r.w
        return pd.DataFrame([[*own[by].iloc[0], min_cut(w), laplacian_entropy(w)]], columns=[*by, "min_cut", "entropy"])

    return edges.groupBy(*by).applyInPandas(run, ", ".join(f"{c} {dict(edges.dtypes)[c]}" for c in by) + ", min_cut double, entropy double")


def scaled_by_nodes(edges: DataFrame, nodes: DataFrame, by: list[str]) -> DataFrame:
    """Edges with w times the root of the product of their ends' values (by, channel, v); edges whose ends have none go."""
    i, j = (nodes.select(*by, F.col("channel").alias(c), F.col("v").alias(f"_{c}")) for c in ("ch_i", "ch_j"))
    return edges.join(i, [*by, "ch_i"]).join(j, [*by, "ch_j"]).withColumn("w", F.col("w") * F.sqrt(F.col("_ch_i") * F.col("_ch_j"))).drop("_ch_i", "_ch_j")


def shortest_paths(edges: DataFrame, by: list[str], nodes: int) -> DataFrame:
    """Length of the shortest way between each two nodes of each graph, an edge being 1 / w long: (by, a, b, d).

    Ways of up to 1, 2, 4, .. edges are joined with themselves until they can have nodes - 1; a graph is as small as a session has channels.
    """
    e = both_ways(edges.where("w > 0"), by).select(*by, F.col("node").alias("a"), F.col("peer").alias("b"), (1 / F.col("w")).alias("d"))
    steps = 1
    while steps < nodes - 1:
        more = e.join(e.select(*by, F.col("a").alias("b"), F.col("b").alias("c"), F.col("d").alias("d2")), [*by, "b"]).where("a <> c").select(*by, "a", F.col("c").alias("b"), (F.col("d") + F.col("d2")).alias("d"))
        e = e.union(more).groupBy(*by, "a", "b").agg(F.min("d").alias("d"))
        steps *= 2
    return e


def path_measures(paths: DataFrame, by: list[str]) -> DataFrame:
    """Mean length of the shortest ways and global efficiency (mean of one over the length), over connected pairs."""
    return paths.groupBy(*by).agg(F.avg("d").alias("path_length"), F.avg(1 / F.col("d")).alias("efficiency"))


def betweenness(edges: DataFrame, by: list[str]) -> DataFrame:
    """For each node (of two others at least that it is connected with) the mean over pairs of other nodes of the share of their shortest ways that go
    by it, an edge being 1 / w long; of several ways of one length each counts. A graph is as small as a session has channels."""

    def run(own: pd.DataFrame) -> pd.DataFrame:
        nodes = sorted({*own["ch_i"], *own["ch_j"]})
        i, j = (own[c].map({c: k for k, c in enumerate(nodes)}).to_numpy() for c in ("ch_i", "ch_j"))
        length = np.full((len(nodes), len(nodes)), np.inf)
        length[i, j] = length[j, i] = 1 / own["w"].to_numpy()
        found = pd.DataFrame({**{c: own[c].iloc[0] for c in by}, "node": nodes, "betweenness": between(length)})
        return found[found["betweenness"].notna()]

    return edges.where("w > 0").groupBy(*by).applyInPandas(run, ", ".join(f"{c} {dict(edges.dtypes)[c]}" for c in by) + ", node string, betweenness double")


def eigenmodes(edges: DataFrame, by: list[str]) -> DataFrame:
    """Modes of each graph's Laplacian: mode (0 is the smoothest), channel, w, value. A mode's largest entry (of equal ones the first) is above 0."""

    def run(own: pd.DataFrame) -> pd.DataFrame:
        nodes = sorted({*own["ch_i"], *own["ch_j"]})
        at = {c: i for i, c in enumerate(nodes)}
        w = np.zeros((len(nodes), len(nodes)))
        for r in own.itertuples():
            w[at[r.ch_i], at[r.ch_j]] = w[at[r.ch_j], at[r.ch_i]] = r.w
        values, vectors = np.linalg.eigh(np.diag(w.sum(1)) - w)
        vectors = vectors * np.sign(vectors[np.abs(vectors).round(9).argmax(0), np.arange(len(nodes))])
        key = [own[c].iloc[0] for c in by]
        return pd.DataFrame([(*key, k, c, vectors[i, k], values[k]) for k in range(len(nodes)) for i, c in enumerate(nodes)], columns=[*by, "mode", "channel", "w", "value"])

    return edges.groupBy(*by).applyInPandas(run, ", ".join(f"{c} {dict(edges.dtypes)[c]}" for c in by) + ", mode int, channel string, w double, value double")


def mode_shares(modes: DataFrame, maps: DataFrame, by: list[str]) -> DataFrame:
    """Share of each mode in the power of a map (by, channel, v) of the same graph."""
    a = modes.join(maps, [*by, "channel"]).groupBy(*by, "mode").agg(F.sum(F.col("w") * F.col("v")).alias("_a"))
    return a.select(*by, "mode", (F.col("_a") ** 2 / F.nullif(F.sum(F.col("_a") ** 2).over(W.partitionBy(*by)), F.lit(0.0))).alias("share"))
