"""Centroid clustering of vectors with expressions alone, in whole numbers.

Components become integers once, floor(``SCALE`` * x), and are written as a narrow table. In a round each vector meets the centroids as literal arrays: ``zip_with`` and
``aggregate`` sum the squared differences, ``array_min`` over structs of distance and number chooses the nearest, and one sum per component and
cluster, added up in generated code before the shuffle, makes the next centroids. A round moves as many rows as there are tasks and clusters, and the driver sees
one row per cluster. All sums are exact, so the result doesn't depend on the order of rows or the number of tasks.

Only vectors of ``size`` components, none null, NaN or infinite, take part; others are not returned. The first centroids are the vectors whose
digest of seed and id is smallest; a null id sorts last, equal ids by their components. With fewer vectors than ``k`` there are fewer centroids. Equal distances go
to the smaller number; a cluster without vectors keeps its centroid. Repeated rows count each. A component beyond ``LIMIT`` in size would overflow the sums
and raises an error. Columns of the input with the names of added columns are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from quizspark.llm.common import without
from quizspark.plans.storage import written

ADDED = ["cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
SCALE = 1024
LIMIT = 1 << 17  # 64 squares of differences of integers up to 2**27 fit 63 bits


def integers(vector: Column) -> Column:
    """Components as integers."""
    def one(x: Column) -> Column:
        x = x.cast("double")
        return F.when(F.abs(x) < LIMIT, F.floor(x * SCALE)).otherwise(F.raise_error(F.lit(f"a component is {LIMIT} or more")).cast("long"))
    return F.transform(vector, one)


def usable(vector: Column, size: int) -> Column:
    whole = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))  # NaN is greater than all
    return F.coalesce((F.size(vector) == size) & whole, F.lit(False))


def nearest(vector: Column, centroids: Sequence[Sequence[int]]) -> Column:
    """Struct of the squared ``distance`` to the nearest centroid and its number ``cluster``."""
    def apart(c: Sequence[int]) -> Column:
        literal = F.expr("array(" + ", ".join(f"{x}L" for x in c) + ")")  # one call to the JVM, not one per number
        return F.aggregate(F.zip_with(vector, literal, lambda a, b: (a - b) * (a - b)), F.lit(0).cast("long"), lambda s, x: s + x)
    return F.array_min(F.array(*[F.struct(apart(c).alias("distance"), F.lit(i).alias("cluster")) for i, c in enumerate(centroids)]))


def first_centroids(rows: DataFrame, vector: str, id_col: str, k: int, seed: int) -> list[list[int]]:
    """Integers of the vectors whose digest is smallest, in its order."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")).cast("binary"), 256)
    chosen = rows.select(digest.alias("digest"), vector).orderBy(F.col("digest").asc_nulls_last(), vector).limit(k)
    return [list(r[vector]) for r in chosen.collect()]


def next_centroids(rows: DataFrame, vector: str, centroids: list[list[int]]) -> list[list[int]]:
    """Floor of the mean of each cluster, component by component."""
    assigned = rows.select(nearest(F.col(vector), centroids)["cluster"].alias("cluster"), vector)
    sums = assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.expr("array(" + ", ".join(
        f"sum(get({vector}, {i}))" for i in range(len(centroids[0]))) + ")").alias("sums"))
    moved = list(centroids)
    for r in sums.collect():
        moved[r["cluster"]] = [x // r["n"] for x in r["sums"]]
    return moved


def cluster_vectors(vectors: DataFrame, vector: str = "embedding", id_col: str = "vec_id", size: int = 64, k: int = 8, rounds: int = 10,
                    seed: int = 3) -> DataFrame:
    """Every usable row with ``cluster``, ``distance`` (squared), ``cluster_inertia``, ``inertia`` and ``centroid_sha256``."""
    rows = without(vectors, [*ADDED, "__ints"]).where(usable(F.col(vector), size)).withColumn("__ints", integers(F.col(vector)))
    rows = written(rows, "centroid-vectors")
    centroids = first_centroids(rows, "__ints", id_col, k, seed)
    if not centroids:
        empty = {"cluster": "int", "distance": "long", "cluster_inertia": "long", "inertia": "long", "centroid_sha256": "string"}
        return rows.drop("__ints").withColumns({n: F.lit(None).cast(t) for n, t in empty.items()}).limit(0)
    for _ in range(rounds):
        moved = next_centroids(rows, "__ints", centroids)
        if moved == centroids:
            break
        centroids = moved
    found = rows.withColumn("__near", nearest(F.col("__ints"), centroids))
    inertia = {r[0]: r[1] for r in found.groupBy("__near.cluster").agg(F.sum("__near.distance")).collect()}
    texts = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    cluster = F.col("__near.cluster")
    own = F.get(F.array(*[F.lit(inertia.get(i, 0)).cast("long") for i in range(len(centroids))]), cluster)
    return found.withColumns({
        "cluster": cluster, "distance": F.col("__near.distance"), "cluster_inertia": own, "inertia": F.lit(sum(inertia.values())).cast("long"),
        "centroid_sha256": F.get(F.array(*[F.lit(t) for t in texts]), cluster)}).drop("__ints", "__near")
