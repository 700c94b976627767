"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import storage

FEW_EDGES = 500_000  # that one task may hold: 8 MB


def least_ids(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids in order, the smallest id of each one's component): roots go under smaller neighbouring roots until none is left."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while len(a):
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(further := root[root], root):
            root = further
    return ids, ids[root]


def _at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if held := list(batches):
        t = pa.Table.from_batches(held)
        ids, least = least_ids(t.column("a").to_numpy(), t.column("b").to_numpy())
        yield pa.RecordBatch.from_pydict({"id": pa.array(ids), "component": pa.array(least)})


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 100, few: int = FEW_EDGES) -> DataFrame:
    """(id, component) of every id in the edges; a component is named by its smallest id.

    Up to ``few`` edges, counted first, are solved in one task. More of them go in rounds
    on tables, which alternate two steps until nothing changes: each node ties its larger neighbours to its
    smallest neighbour, then its smaller ones.  Every step is a grouped minimum (combined
    before the shuffle) and an equi-join; the minima are written first, so that the join's sides come
    straight from their shuffles and adaptive execution may split a hub's.  The number of rounds grows
    with the logarithm of the longest path.  Each round's edges and the result are written to the shared folder.
    Null ends are ignored.
    """
    if not storage.is_stored(edges):
        edges = storage.stored(edges.select(a, b), "links")
    e = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).filter("a is not null and b is not null")
    if e.count() <= few:
        return storage.stored(e.repartition(1).mapInArrow(_at_once, "id long, component long"), "components")
    alone = e.select(F.col("a").alias("id")).unionByName(e.select(F.col("b").alias("id"))).distinct()
    alone = storage.stored(alone, "ids")
    e = storage.stored(e.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count_if(F.col("b") < F.col("a")).alias("down"), F.count_if(F.col("b") > F.col("a")).alias("up"))
        least = storage.stored(least, "least")
        # stars around their smallest ids: whoever has a smaller neighbour has no other
        if not least.filter((F.col("down") > 1) | ((F.col("down") == 1) & (F.col("up") > 0))).limit(1).count():
            storage.dropped(least)
            break
        large = both.filter("b > a").join(least.select("a", "m"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        tied = large.join(small, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        new = storage.stored(tied.unionByName(small.select("a", F.col("m").alias("b"))).distinct(), "edges")
        storage.dropped(e)
        storage.dropped(least)
        e = new
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    named = alone.join(e.select(F.col("a").alias("id"), F.col("b").alias("component")), "id", "left")
    return storage.stored(named.select("id", F.coalesce("component", "id").alias("component")), "components")
