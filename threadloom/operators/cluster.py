"""Clusters of vectors: density components over cosine pairs, and reduction with k-means."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.operators import pairs
from threadloom.operators.pairs import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """(node, root): least node reachable from each node of the edges (a, b), by minimum labels and pointer jumps."""
    both = checkpointed(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    label = checkpointed(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"))
    while True:
        seen = both.join(label.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("root").alias("near"))
        lower = label.join(seen, label["node"] == seen["a"]).select("node", F.least("root", "near").alias("root"), F.col("root").alias("old"))
        up = lower.select(F.col("node").alias("root"), F.col("root").alias("top"))
        fresh = checkpointed(lower.join(up, "root").select("node", F.col("top").alias("root"), "old"))
        label = fresh.select("node", "root")
        if fresh.filter("root <> old").isEmpty():
            return label


class Forest:
    """Components of rows 0..n-1, each named by its least row."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        at = self.parent[x]
        while (at != (up := self.parent[at])).any():
            at = up
        self.parent[x] = at
        return at

    def link(self, x: np.ndarray, y: np.ndarray) -> None:
        while x.size:
            a, b = self.find(x), self.find(y)
            apart = a != b
            x, y = x[apart], y[apart]
            np.minimum.at(self.parent, np.maximum(a, b)[apart], np.minimum(a, b)[apart])


class _Units:
    """The vectors of a block at length 1, in double and single precision."""

    def __init__(self, block: pairs.Block):
        v = block.vectors
        norm = np.zeros(len(v))
        with np.errstate(all="ignore"):
            for k in range(v.shape[1]):
                norm += v[:, k] * v[:, k]
            norm = np.sqrt(norm)
            self.unit = np.ascontiguousarray((v / norm[:, None]).T).T  # an entry of all vectors lies together
        self.single = self.unit.astype(np.float32)


def _near(x: _Units, y: _Units, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs with at least this cosine: single precision decides where its error can't matter. NaN is above all numbers, as in SQL."""
    doubt = (x.unit.shape[1] + 8) * 2.4e-7
    dot = x.single @ y.single.T
    p, q = np.nonzero(~(dot < cosine - doubt))
    unsure = np.flatnonzero(dot[p, q] <= cosine + doubt)
    exact = np.zeros(unsure.size)
    for k in range(x.unit.shape[1]):
        exact += x.unit[p[unsure], k] * y.unit[q[unsure], k]
    sure = np.ones(p.size, bool)
    sure[unsure] = ~(exact < cosine)
    return p[sure], q[sure]


def near_forest(made: DataFrame, cosine: float, group: int = pairs.GROUP) -> DataFrame:
    """(a, b): keys that hang together by vectors with at least this cosine; a spanning forest of each tile, not its pairs."""
    kind = made.schema["keys"].dataType.elementType.simpleString()

    def each(met: Iterator[tuple[pairs.Block, pairs.Block] | None]) -> Iterator[pa.RecordBatch]:
        first, units, forest = {}, {}, Forest(0)
        keys: list[pa.Array] = []

        def place(b: pairs.Block) -> int:
            if b.id not in first:
                first[b.id], units[b.id] = len(forest.parent), _Units(b)
                forest.parent = np.append(forest.parent, np.arange(len(b.keys)) + first[b.id])
                keys.append(b.keys)
            return first[b.id]

        for both in met:
            if both is not None:
                x, y = both
                if x.size == y.size:
                    i, j = place(x), place(y)
                    p, q = _near(units[x.id], units[y.id], cosine)
                    forest.link(p + i, q + j)
                continue
            root = forest.find(np.arange(len(forest.parent)))
            node = np.flatnonzero(root != np.arange(len(root)))
            if node.size:
                named = pa.concat_arrays(keys)
                yield pa.RecordBatch.from_arrays([named.take(pa.array(root[node])), named.take(pa.array(node))], ["a", "b"])
            first, units, forest, keys = {}, {}, Forest(0), []

    return pairs.tiled(made, each, f"a {kind}, b {kind}", group)


def density(df: DataFrame, key: str, vector: str, cosine: float, least: int = 2, name: str = "cluster", block: int = pairs.BLOCK, group: int = pairs.GROUP) -> DataFrame:
    """(key, cluster): components of the vectors with at least this cosine, numbered from 0 by their least key; -1 below `least` members.

    All pairs are compared, by tiles, and none is written. Vectors that are null, have a null are near nothing; those whose cosine is NaN (zeros, or a NaN among the entries) are near all, as in SQL.
    """
    near = near_forest(checkpointed(pairs.blocks(df, key, vector, block)), cosine, group)
    roots = components(near.filter("a <> b"))
    sizes = roots.groupBy("root").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    numbers = sizes.withColumn(name, F.row_number().over(Window.orderBy("root")) - 1)  # one row a cluster
    member = roots.join(numbers, "root").select(F.col("node").alias(key), name)
    return df.select(key).join(member, key, "left").select(key, F.coalesce(name, F.lit(-1)).cast("int").alias(name))


def reduced_kmeans(df: DataFrame, key: str, vector: str, dims: int = 5, k: int = 10, seed: int = 7, name: str = "cluster") -> DataFrame:
    """(key, cluster) by PCA and seeded k-means."""
    return fitted(df, key, vector, [PCA(k=dims, inputCol="_v", outputCol="_r"), KMeans(k=k, seed=seed, featuresCol="_r", predictionCol=name)], name)


def fitted(df: DataFrame, key: str, vector: str, stages: list, name: str = "cluster") -> DataFrame:
    """(key, cluster) by the caller's estimators; the first reads `_v`, the last writes `name`."""
    rows = df.select(key, array_to_vector(F.col(f"`{vector}`").cast("array<double>")).alias("_v"))
    return Pipeline(stages=stages).fit(rows).transform(rows).select(key, name)
