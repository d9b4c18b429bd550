"""Connected components of a link table.

Each task first contracts its own links by union-find to at most one link per
node; then large-star and small-star rounds (joins and minimum aggregates over
links only) run until every node points at the smallest node of its component.
Links and components stay distributed; a node with very many links is a hot join
key, which Spark's skew handling splits, and its minimum is pre-aggregated.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .frames import batch_of, written


def _contract(batches):
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x
    kind = None
    for batch in batches:
        kind = batch.column(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    if kind is not None:
        out = [(x, root(x)) for x in parent]
        out = [p for p in out if p[0] != p[1]]
        yield batch_of([pa.array([p[k] for p in out], kind) for k in (0, 1)], ["u", "v"])


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One star round; links are (u, v) with u > v, without repeats."""
    if large:  # every larger neighbour of u is linked to the smallest of u and its neighbours
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:  # u and its smaller neighbours are linked to the smallest of them
        least = links.groupBy("u").agg(F.min("v").alias("m"))
        out = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least)
    return out.where(F.col("u") > F.col("v")).distinct()


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """``node, component`` for every node of ``links`` (columns u, v) that is not its component's smallest."""
    kind = links.schema.fields[0].dataType.simpleString()
    links = links.where("u <> v").mapInArrow(_contract, f"u {kind}, v {kind}")
    links = written(links.distinct(), name)
    state = None
    while True:
        links = written(_star(_star(links, large=True), large=False), name)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            return links.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state = tuple(now)
