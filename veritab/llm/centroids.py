"""Centroid clustering of whole-number vectors by annulus search.

Every component x becomes floor(1024 * x), so that sums, distances and means are exact and no order of
additions shows. Centroids start as the vectors whose salted ids have the smallest hashes. A round
assigns every vector to its nearest centroid and replaces each centroid by its vectors' mean.

The search for the nearest centroid is by norms. Centroids are sorted by norm; the distance to any one
centroid bounds a vector's nearest distance from above, and by the triangle inequality a centroid
whose norm differs from the vector's by more than that bound is farther. Two binary searches give the
centroids within this annulus (its rim included, so equally near ones are seen), and only those are
compared, in whole numbers, ties to the smaller number. Every vector carries the centroid of its first
assignment; its distance, or that to the centroid of the nearest norm if smaller, is the bound. A hint
that has grown old makes the annulus wider, never the answer wrong.

A round is one pass over the table of vectors, in tasks that each keep a sum for a centroid; the sums
of all tasks meet by (centroid, component). The driver sees the centroids alone: k of them.

Defined results. Vectors that are null, of another length, or hold null or non-finite components take
no part, nor do those with a component of 131072 or more either way (distances would leave 64 bits).
Rows count one by one, even if a vec_id repeats or is null; a row without an id is never a first
centroid (without any id there is no result), and where ids repeat the lesser vector comes first. Fewer vectors than centroids make each
a centroid; rows with equal vectors share the centroid of the smallest number. Other columns pass
through, but for those called like an output, in any case. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import carried, importable, table, written

CENTROIDS, ROUNDS, DIMENSIONS, SALT, SCALE = 8, 10, 64, "3:", 1024
#: Components from here on take no part: 64 squares of differences stay within 64 bits.
BEYOND = 1 << 17
OUTPUTS = ("cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
#: Vectors compared in one vectorised step.
STEP = 4096


def whole(vectors: DataFrame, vec: str = "embedding", dimensions: int = DIMENSIONS) -> tuple[DataFrame, list[Column]]:
    """(row, vec_id, v): the vectors that take part, as whole numbers, beside a struct of their other columns; what takes these out."""
    x = F.col(vec).cast("array<double>")
    fine = (F.size(vec) == dimensions) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < BEYOND))
    row, columns = carried(vectors, vec, *OUTPUTS)
    return vectors.where(F.coalesce(fine, F.lit(False))).select(row, "vec_id", F.transform(x, lambda c: F.floor(c * SCALE).cast("long")).alias("v")), columns


def first_centroids(kept: DataFrame, k: int = CENTROIDS, salt: str = SALT) -> np.ndarray:
    """The k vectors with the smallest hashes of their salted ids, in that order."""
    name = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")).cast("binary"), 256)
    found = kept.where("vec_id IS NOT NULL").select(name.alias("name"), "v").orderBy("name", "v").limit(k).collect()
    return np.array([r.v for r in found], np.int64)


class Annuli:
    """Centroids sorted by norm, and the search for the nearest one within each vector's annulus."""

    def __init__(self, centroids: np.ndarray):
        norms = np.sqrt((centroids.astype(np.float64) ** 2).sum(1))
        self.order = np.argsort(norms, kind="stable")
        self.norms, self.sorted = norms[self.order], centroids[self.order]
        self.place = np.argsort(self.order)

    def nearest(self, v: np.ndarray, hints: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid of each row of v, and the squared distance. hints: a centroid near each row."""
        parts = [self._nearest(v[i : i + STEP], None if hints is None else hints[i : i + STEP]) for i in range(0, len(v), STEP)]
        return tuple(np.concatenate([np.zeros(0, np.int64), *[p[k] for p in parts]]) for k in (0, 1))

    def _nearest(self, v: np.ndarray, hints: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        k, norm = len(self.norms), np.sqrt((v.astype(np.float64) ** 2).sum(1))
        above = np.clip(np.searchsorted(self.norms, norm), 0, k - 1)
        below = np.maximum(above - 1, 0)
        start = np.where(np.abs(self.norms[below] - norm) < np.abs(self.norms[above] - norm), below, above)
        bound = self._squared(v, start)
        if hints is not None:
            bound = np.minimum(bound, self._squared(v, self.place[hints]))
        reach = np.sqrt(bound.astype(np.float64))
        reach += 1e-9 * (reach + norm + self.norms[-1]) + 1e-9  # the rim, whatever the last bits of the roots
        low, high = np.searchsorted(self.norms, norm - reach), np.searchsorted(self.norms, norm + reach, side="right")
        best, number = np.full(len(v), np.iinfo(np.int64).max), np.full(len(v), k)
        for step in range(int((high - low).max(initial=0))):
            rows = np.flatnonzero(low + step < high)
            at = low[rows] + step
            got, name = self._squared(v[rows], at), self.order[at]
            better = (got < best[rows]) | ((got == best[rows]) & (name < number[rows]))
            best[rows[better]], number[rows[better]] = got[better], name[better]
        return number, best

    def _squared(self, v: np.ndarray, at: np.ndarray) -> np.ndarray:
        return ((v - self.sorted[at]) ** 2).sum(1)


def _stack(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), width)


def _floor_means(old: np.ndarray, sums: list) -> np.ndarray:
    """The centroids after a round: floor(sum / count), and old where there is no vector."""
    new = old.copy()
    for r in sums:
        new[r["cluster"], r["at"]] = int(r["total"]) // int(r["n"])  # of whole numbers of any size: exact, towards minus infinity
    return new


def clustered(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, vec: str = "embedding", dimensions: int = DIMENSIONS, salt: str = SALT) -> DataFrame:
    """vectors that take part, their vector left out, with cluster, distance, cluster_inertia, inertia and centroid_sha256."""
    spark = vectors.sparkSession
    importable(spark)
    kept, columns = whole(vectors, vec, dimensions)
    centroids = first_centroids(kept, k, salt)
    if not len(centroids):  # no row that takes part has an id
        return kept.where("false").select(*columns, *[F.lit(None).cast(f.dataType).alias(f.name) for f in _outputs()])

    def hinted(batches):
        annuli = Annuli(centroids)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(annuli.nearest(_stack(b.column("v"), dimensions))[0])], names=[*b.schema.names, "hint"])

    rows = written(kept.select("row", "v").mapInArrow(hinted, T.StructType([kept.schema["row"], kept.schema["v"], T.StructField("hint", T.LongType())])), "centroid-vectors")
    points = rows.select("v", "hint")
    for _ in range(rounds):
        sums = points.mapInArrow(_summing(centroids, dimensions), "cluster long, at int, n long, total long").groupBy("cluster", "at")
        centroids = _floor_means(centroids, sums.agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect())

    def assigned(batches):
        annuli = Annuli(centroids)
        for b in batches:
            number, squared = annuli.nearest(_stack(b.column("v"), dimensions), b.column("hint").to_numpy())
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(number.astype(np.int32)), pa.array(squared)], names=["row", "cluster", "distance"])

    out = written(rows.mapInArrow(assigned, T.StructType([kept.schema["row"], *_outputs()[:2]])), "centroid-clusters")
    inertia = {r["cluster"]: int(r["s"]) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    of = spark.createDataFrame([(c, s, sum(inertia.values()), names[c]) for c, s in inertia.items()], T.StructType([_outputs()[0], *_outputs()[2:]]))
    return out.join(F.broadcast(of), "cluster").select(*columns, *OUTPUTS)


def _outputs() -> list:
    return T._parse_datatype_string("cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string").fields


def _summing(centroids: np.ndarray, dimensions: int):
    """A task's sums of the vectors nearest to each centroid, by component."""

    def run(batches):
        annuli, count, total = Annuli(centroids), np.zeros(len(centroids), np.int64), np.zeros((len(centroids), dimensions), np.int64)
        for b in batches:
            v = _stack(b.column("v"), dimensions)
            number, _ = annuli.nearest(v, b.column("hint").to_numpy())
            order = np.argsort(number, kind="stable")
            own, heads = np.unique(number[order], return_index=True)
            count += np.bincount(number, minlength=len(centroids))
            if len(own):
                total[own] += np.add.reduceat(v[order], heads, axis=0)
        full = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(full, dimensions)), pa.array(np.tile(np.arange(dimensions, dtype=np.int32), len(full))), pa.array(np.repeat(count[full], dimensions)), pa.array(total[full].ravel())],
            names=["cluster", "at", "n", "total"],
        )

    return run


def op11_centroids(spark, sf_dir: str) -> DataFrame:
    return clustered(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).select("vec_id", *OUTPUTS)


def oracle_sql(k: int = CENTROIDS, rounds: int = ROUNDS) -> str:
    """The rounds written one after another; nothing is left out of any."""
    steps = [
        "kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings "
        "WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('{SALT}' || CAST(vec_id AS VARCHAR)) AS h, v FROM kept WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT {k}))",
    ]
    squared = "list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, min(struct_pack(d := d, c := c)) AS best FROM (SELECT k.r, c.c, CAST({squared} AS BIGINT) AS d FROM kept k, c{i} c) GROUP BY r)")
        if i < rounds:
            floor = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"
            steps.append(f"s{i} AS (SELECT a.best.c AS c, u.place, count(*) AS n, CAST(sum(u.x) AS HUGEINT) AS s FROM a{i} a JOIN (SELECT r, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM kept) u ON a.r = u.r GROUP BY 1, 2)")
            steps.append(f"m{i} AS (SELECT c, list({floor} ORDER BY place) AS v FROM s{i} GROUP BY c)")
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN m{i} m ON c.c = m.c)")
    return f"""
WITH {", ".join(steps)},
sums AS (SELECT best.c AS c, CAST(sum(best.d) AS BIGINT) AS s FROM a{rounds} GROUP BY 1)
SELECT k.vec_id, CAST(a.best.c AS INTEGER) AS cluster, a.best.d AS distance, s.s AS cluster_inertia, (SELECT CAST(sum(s) AS BIGINT) FROM sums) AS inertia,
       sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM kept k JOIN a{rounds} a ON k.r = a.r JOIN sums s ON a.best.c = s.c JOIN c{rounds} c ON a.best.c = c.c
"""


ORACLE_SQL = oracle_sql()
