"""Clustering by centroids (Lloyd's rounds) in whole numbers, with DataFrame functions only.

Vectors become arrays of whole numbers once, in a written table. A round is one pass over it: zip_with and aggregate give the squared
distances to the centroids, which stand in the plan as a literal array, array_min of (distance, number) chooses the cluster, and one
grouping by cluster adds up each component as a column of its own, summed within the tasks before it is shuffled. The driver
holds the centroids only: k rows of as many numbers as a vector has. All arithmetic is exact, so the order of rows has no say.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

#: Whole components beyond it are taken as it, so that no squared distance of up to 256 components passes 64 bits.
MOST = 1 << 26


def whole_vectors(vectors: DataFrame, id: str, vector: str, size: int, scale: int) -> DataFrame:
    """id and v of the vectors with exactly so many components, none of them null or not finite: v holds floor(scale * x)."""
    rows = vectors.select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("x"))
    finite = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    cut = lambda x: F.least(F.greatest(F.floor(scale * x), F.lit(-MOST)), F.lit(MOST))
    return rows.where((F.size("x") == size) & finite).select("id", F.transform("x", lambda x: cut(x).cast("long")).alias("v"))


def first_centroids(rows: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The vectors of the k rows with the smallest sha256 of `seed:id`; of equal ones the smaller vector first. Null ids aren't drawn."""
    drawn = rows.where("id IS NOT NULL").withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256))
    return [list(r.v) for r in drawn.orderBy("h", "v").limit(k).collect()]


def nearest(centroids: list[list[int]]) -> Column:
    """Struct (d, cluster) of the nearest centroid to the column v: squared distance and number, of equal distances the smaller number."""
    known = F.expr("array(" + ", ".join("array(" + ", ".join(f"{x}L" for x in c) + ")" for c in centroids) + ")")
    squares = lambda c: F.zip_with("v", c, lambda x, y: (x - y) * (x - y))
    apart = lambda c: F.aggregate(squares(c), F.lit(0).cast("long"), lambda a, x: a + x)
    return F.array_min(F.transform(known, lambda c, i: F.struct(apart(c).alias("d"), i.cast("int").alias("cluster"))))


def moved(rows: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after a round: the floor of the mean of what is nearest to each; one without vectors stays."""
    sums = [F.sum(F.get("v", F.lit(i))).alias(f"s{i}") for i in range(len(centroids[0]))]
    found = rows.select("v", nearest(centroids)["cluster"].alias("cluster")).groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect()
    out = list(centroids)
    for r in found:
        out[r.cluster] = [r[f"s{i}"] // r.n for i in range(len(centroids[0]))]
    return out


def clustered(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", size: int = 64, k: int = 40, rounds: int = 5, scale: int = 256, seed: int = 2) -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each vector kept by whole_vectors().

    Vectors of another size, null ones and ones with null, NaN or infinite components have no row. Repeated rows each count, in the
    draw of the first centroids too; rows with a null id are clustered but not drawn. Fewer rows than k give fewer clusters, no rows with an id give no rows. Sums that
    pass 64 bits are null (inertia only).
    """
    rows = written(whole_vectors(vectors, id, vector, size, scale))
    centroids = first_centroids(rows, k, seed)
    if not centroids:
        return _shaped(rows.where("false").withColumns({"cluster": F.lit(0), "distance": F.lit(0).cast("long"), "cluster_inertia": F.lit(0).cast("long"), "inertia": F.lit(0).cast("long"), "centroid_sha256": F.lit("")}), id)
    for _ in range(rounds):
        centroids = moved(rows, centroids)
    found = written(rows.select("id", nearest(centroids).alias("_")).select("id", "_.cluster", F.col("_.d").alias("distance")))
    digests = F.expr("array(" + ", ".join(f"sha2('{','.join(map(str, c))}', 256)" for c in centroids) + ")")
    inertia = found.groupBy("cluster").agg(F.try_sum("distance").alias("cluster_inertia")).collect()  # k rows at most
    known = {r.cluster: r.cluster_inertia for r in inertia}
    total = None if None in known.values() or sum(known.values()) >= 1 << 63 else sum(known.values())
    of = F.expr("array(" + ", ".join("NULL" if known.get(c) is None else f"{known[c]}L" for c in range(len(centroids))) + ")").cast("array<bigint>")
    return _shaped(found.withColumns({"cluster_inertia": F.get(of, F.col("cluster")), "inertia": F.lit(total).cast("long"), "centroid_sha256": F.get(digests, F.col("cluster"))}), id)


def _shaped(rows: DataFrame, id: str) -> DataFrame:
    return rows.select(F.col("id").alias(id), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
