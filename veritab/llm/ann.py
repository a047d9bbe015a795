"""Approximate nearest neighbours by largest inner product, over balanced posting lists.

Centroids are fitted on a bounded sample, with a penalty on full clusters. Every vector goes to
its nearest centroid's list and, near boundaries, to up to COPIES lists. A graph of neighbouring
centroids, held in memory, is searched for the lists of a vector or a query; a query looks at the
lists whose centroids are at most a ratio as far as its nearest one. The ratio is taken from the
sample, such that TARGET of the true neighbours there lie in the lists looked at. Inner products
become distances by one more component. Lists and the queries on them are dealt into parts of
bounded size, however full a list is; a part gives each query's best TOP by exact inner products.

Defined results. Vectors that are null, empty, zero or hold null or non-finite components, and
those of another length than the commonest, take no part; nor do rows without vec_id. Rows of
one vec_id are one candidate (its best score) and never each other's neighbour; a repeated query
is answered once, by the least of its vectors in array order. Fewer candidates than TOP give fewer rows; no usable vector, none.
Other columns are not read. Very long vectors are compared like others.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, importable, table, written

TOP = 20
#: Rows that centroids and the ratio are fitted on, at most; rows kept for lower bounds; centroids, at most.
FIT_ROWS, FLOOR_ROWS, CENTROIDS = 20_000, 4096, 4096
COPIES, EDGE_RATIO, NEIGHBOURS, TARGET = 4, 1.15, 24, 0.96
#: Most vectors and queries of a part.
PART_VECTORS, PART_QUERIES = 4096, 1024


def usable(vectors: DataFrame, vec: str = "embedding") -> DataFrame:
    """(vec_id, x) of the vectors that take part, x in double precision."""
    x = F.col(vec).cast("array<double>")
    fine = F.col("vec_id").isNotNull() & F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False)) & F.coalesce(F.exists(x, lambda c: c != 0), F.lit(False))
    rows = vectors.where(fine).select("vec_id", x.alias("x"))
    lengths = rows.groupBy(F.size("x").alias("n")).agg(F.count("*").alias("c"))
    best = lengths.orderBy(F.desc("c"), "n").first()
    return rows.where(F.size("x") == (best["n"] if best else 0))


def _stack(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1) if len(flat) else np.zeros((0, 1))


def lifted(x: np.ndarray, scale: float, longest: float) -> np.ndarray:
    """Vectors scaled, with the component that makes all equally long."""
    x = x / scale
    rest = np.sqrt(np.maximum(longest**2 - (x**2).sum(1), 0))
    return np.concatenate([x, rest[:, None]], 1).astype(np.float32)


def asking(q: np.ndarray, scale: float, longest: float) -> np.ndarray:
    """Queries as long as the longest vector; their order of candidates stays."""
    q = q / scale
    q = q * (longest / np.sqrt((q**2).sum(1, keepdims=True)))
    return np.concatenate([q, np.zeros((len(q), 1))], 1).astype(np.float32)


def _square(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a**2).sum(1)[:, None] - 2 * a @ b.T + (b**2).sum(1), 0)


def balanced_centroids(x: np.ndarray, k: int, rounds: int = 10, seed: int = 5) -> np.ndarray:
    x = np.unique(x, axis=0)
    k = min(k, len(x))
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)]
    full = np.ones(k)
    for _ in range(rounds):
        d = np.concatenate([_square(x[i : i + 4096], c) for i in range(0, len(x), 4096)])
        near = np.argmin(d + 0.1 * d.min(1).mean() * (full - 1), 1)
        size = np.bincount(near, minlength=k)
        total = np.zeros((k, x.shape[1]))
        np.add.at(total, near, x)
        c = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], x[rng.choice(len(x), k)]).astype(np.float32)
        full = size / max(1, size.mean())
    return c


def neighbour_graph(c: np.ndarray, most: int = NEIGHBOURS) -> np.ndarray:
    """Each centroid's nearest ones, and the next in number, so that all are joined."""
    k = len(c)
    m = min(most, k - 1)
    if m < 1:
        return np.zeros((k, 1), np.int64)
    d = _square(c, c)
    np.fill_diagonal(d, np.inf)
    near = np.argpartition(d, m - 1, 1)[:, :m]
    out = np.sort(np.concatenate([near, ((np.arange(k) + 1) % k)[:, None], ((np.arange(k) - 1) % k)[:, None]], 1), 1)
    again = np.concatenate([np.zeros((k, 1), dtype=bool), out[:, 1:] == out[:, :-1]], 1)
    return np.where(again, np.arange(k)[:, None], out)  # a neighbour counts once; a centroid itself is already seen


def graph_search(q: np.ndarray, c: np.ndarray, graph: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The width nearest centroids found for each row, nearest first, and their distances.

    Best-first over the graph for all rows together; a row ends when its width best are expanded.
    """
    n, k = len(q), len(c)
    width = max(1, min(width, k))
    square, own = (c**2).sum(1), (q**2).sum(1)
    entry = np.unique(np.linspace(0, k - 1, min(k, width, 16)).astype(np.int64))
    ids = np.zeros((n, width), np.int64)
    dist = np.full((n, width), np.inf, np.float32)
    done = np.ones((n, width), dtype=bool)
    ids[:, : len(entry)], done[:, : len(entry)] = entry, False
    dist[:, : len(entry)] = own[:, None] - 2 * q @ c[entry].T + square[entry]
    seen = np.zeros((n, k), dtype=bool)
    seen[:, entry] = True
    rows = np.arange(n)
    while len(rows):
        waiting = np.where(done[rows], np.inf, dist[rows])
        pick = np.argmin(waiting, 1)
        live = np.isfinite(waiting[np.arange(len(rows)), pick])
        rows, pick = rows[live], pick[live]
        done[rows, pick] = True
        near = graph[ids[rows, pick]]
        fresh = ~seen[rows[:, None], near]
        seen[rows[:, None], near] = True
        got = own[rows, None] - 2 * np.einsum("nd,nrd->nr", q[rows], c[near]) + square[near]
        all_dist = np.concatenate([dist[rows], np.where(fresh, got, np.inf).astype(np.float32)], 1)
        best = np.argpartition(all_dist, width - 1, 1)[:, :width]
        dist[rows] = np.take_along_axis(all_dist, best, 1)
        ids[rows] = np.take_along_axis(np.concatenate([ids[rows], near], 1), best, 1)
        done[rows] = np.take_along_axis(np.concatenate([done[rows], ~fresh], 1), best, 1)
    order = np.argsort(dist, 1, kind="stable")
    dist = np.take_along_axis(dist, order, 1)
    return np.take_along_axis(ids, order, 1), np.where(np.isfinite(dist), np.sqrt(np.maximum(dist, 0)), np.inf)


def lists_of(x: np.ndarray, c: np.ndarray, graph: np.ndarray) -> list[np.ndarray]:
    """The lists that hold each vector: the nearest one, and those hardly farther (COPIES at most)."""
    ids, dist = graph_search(x, c, graph, 4 * COPIES)
    keep = dist[:, :COPIES] <= EDGE_RATIO * dist[:, :1] + 1e-6
    keep[:, 0] = True
    return [i[k] for i, k in zip(ids[:, :COPIES], keep, strict=True)]


def calibrated(x: np.ndarray, raw: np.ndarray, scale: float, longest: float, c: np.ndarray, graph: np.ndarray, queries: int = 400) -> tuple[float, float, int]:
    """The ratio of distances, the least distance it is of, and the width of the search, that reach TARGET of the sample's neighbours."""
    if len(x) < 2:
        return 1.0, 0.0, len(c)
    held = [set(i.tolist()) for i in lists_of(x, c, graph)]
    some = np.linspace(0, len(x) - 1, min(queries, len(x))).astype(np.int64)
    q = asking(raw[some], scale, longest)
    scores = raw[some] @ raw.T
    scores[np.arange(len(some)), some] = -np.inf
    d = np.sqrt(_square(q, c))
    least = float(np.median(d.min(1)))  # a query that is almost a centroid looks as far as others
    nearest = np.maximum(d.min(1), least)
    top = min(TOP, len(x) - 1)
    best = np.argpartition(-scores, top - 1, 1)[:, :top]
    need = [min(d[i, j] for j in held[v]) / max(nearest[i], 1e-6) for i in range(len(some)) for v in best[i]]
    ratio = float(np.quantile(need, TARGET)) + 1e-4
    return ratio, least, int((d <= ratio * nearest[:, None] + 1e-6).sum(1).max())


def fitted(vectors: DataFrame, scale: float, longest: float, n: int) -> dict:
    """Centroids, their graph, the ratio, the width and rows for lower bounds, made in one task of a bounded sample."""
    sample = vectors.orderBy(F.xxhash64(F.lit("fit"), F.col("vec_id")), "vec_id").limit(FIT_ROWS)

    def run(batches):
        rows = [(b.column("vec_id").to_numpy(), _stack(b.column("x"))) for b in batches if b.num_rows]
        ids, raw = np.concatenate([i for i, _ in rows]), np.concatenate([x for _, x in rows])
        x = lifted(raw, scale, longest)
        k = int(np.clip(round(1.5 * np.sqrt(n)), 1, min(CENTROIDS, max(1, len(x) // 4))))
        c = balanced_centroids(x, k)
        graph = neighbour_graph(c)
        ratio, least, width = calibrated(x, raw, scale, longest, c, graph)
        _, one = np.unique(ids, return_index=True)
        one = np.sort(one)[: min(FLOOR_ROWS, n // 16)]
        yield pa.RecordBatch.from_pydict({"c": [c.ravel().astype(np.float64)], "graph": [graph.ravel()], "k": [len(c)], "ratio": [ratio], "least": [least], "width": [width], "ids": [ids[one]], "rows": [raw[one].ravel()]})

    got = sample.coalesce(1).mapInArrow(run, "c array<double>, graph array<long>, k long, ratio double, least double, width long, ids array<long>, rows array<double>").collect()[0]
    return {"c": np.array(got["c"], np.float32).reshape(got["k"], -1), "graph": np.array(got["graph"], np.int64).reshape(got["k"], -1), "ratio": got["ratio"], "least": got["least"], "width": got["width"], "ids": np.array(got["ids"]), "rows": np.array(got["rows"], np.float64).reshape(len(got["ids"]), len(got["c"]) // got["k"] - 1), "scale": scale, "longest": longest}


def _best(queries: pd.DataFrame, vecs: pd.DataFrame, top: int) -> pd.DataFrame:
    """A part's best top of each query; rows of one vec_id, which are all in one part of a list, count as their best."""
    if not len(queries) or not len(vecs):
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
    q, v = np.stack(queries["x"].to_numpy()), np.stack(vecs["x"].to_numpy())
    qi, vi, floor = queries["query_id"].to_numpy(), vecs["vec_id"].to_numpy(), queries["floor"].to_numpy()
    by_id = np.argsort(vi, kind="stable")
    v, vi = v[by_id], vi[by_id]
    heads = np.flatnonzero(np.concatenate([[True], vi[1:] != vi[:-1]]))
    out = []
    for i in range(0, len(q), 128):
        rough = np.where(qi[i : i + 128, None] == vi, -np.inf, q[i : i + 128] @ v.T)
        least = floor[i : i + 128]
        if len(heads) > top + 1:
            least = np.maximum(least, np.partition(np.maximum.reduceat(rough, heads, axis=1), -top, 1)[:, -top])
        slack = 1e-9 * (np.abs(least) + np.sqrt((q[i : i + 128] ** 2).sum(1)) * np.sqrt((v**2).sum(1).max()))
        a, b = np.nonzero((rough >= np.where(np.isfinite(least), least - slack, -np.inf)[:, None]) & (rough > -np.inf))
        score = (q[i + a] * v[b]).sum(1)  # one order of additions for all: equal vectors tie
        order = np.lexsort((vi[b], -score, a))
        a, b, score = a[order], b[order], score[order]
        found = pd.DataFrame({"query_id": qi[i + a], "vec_id": vi[b], "score": score}).drop_duplicates(["query_id", "vec_id"])
        out.append(found[found.groupby("query_id").cumcount() < top])
    return pd.concat(out)


def neighbours(vectors: DataFrame, is_query, vec: str = "embedding", top: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score: the top nearest found of each row of vectors that is_query picks."""
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    importable(spark)
    rows = written(usable(vectors, vec), "ann-vectors")
    scale = rows.agg(F.max(F.array_max(F.transform("x", F.abs)))).first()[0]
    if scale is None:
        return empty
    n, longest = rows.agg(F.count("*"), F.sqrt(F.max(F.aggregate("x", F.lit(0.0), lambda a, c: a + (c / scale) * (c / scale))))).first()
    shared = spark.sparkContext.broadcast(fitted(rows, scale, longest, n))  # CENTROIDS, FLOOR_ROWS: bounded

    def to_lists(batches):
        m = shared.value
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                lists = lists_of(lifted(_stack(part.column("x")), m["scale"], m["longest"]), m["c"], m["graph"])
                at = np.repeat(np.arange(part.num_rows), [len(x) for x in lists])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(lists), pa.int64()), part.column("vec_id").take(pa.array(at)), part.column("x").take(pa.array(at))], names=["list", "vec_id", "x"])

    def probing(times: int):
        """Probes of a query's lists; with times, of the nearest ones, times as many as a query looks at at most (all, in the end)."""

        def to_probes(batches):
            m = shared.value
            for b in batches:
                for i in range(0, b.num_rows, 256):
                    part = b.slice(i, 256)
                    ids, raw = part.column("vec_id").to_numpy(), _stack(part.column("x"))
                    floor = np.full(len(raw), -np.inf)
                    q = asking(raw, m["scale"], m["longest"])
                    if times > 1:
                        found = np.argsort(_square(q, m["c"]), 1, kind="stable")[:, : times * m["width"]]
                        keep = np.ones(found.shape, dtype=bool)
                    else:
                        found, dist = graph_search(q, m["c"], m["graph"], m["width"] + 8)
                        keep = dist <= m["ratio"] * np.maximum(dist[:, :1], m["least"]) + 1e-6
                        # A lower bound of the last score that counts: that of the sample's last one.
                        sample = np.where(m["ids"] == ids[:, None], -np.inf, raw @ m["rows"].T)
                        if sample.shape[1] > top:
                            floor = np.partition(sample, -top, 1)[:, -top]
                    at = np.repeat(np.arange(len(raw)), keep.sum(1))
                    yield pa.RecordBatch.from_arrays([pa.array(found[keep], pa.int64()), pa.array(ids[at]), part.column("x").take(pa.array(at)), pa.array(floor[at])], names=["list", "query_id", "x", "floor"])

        return to_probes

    postings = written(rows.mapInArrow(to_lists, "list long, vec_id long, x array<double>"), "ann-lists")

    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def search(queries: DataFrame, times: int) -> DataFrame:
        probes = written(queries.repartition(tasks, "vec_id").mapInArrow(probing(times), "list long, query_id long, x array<double>, floor double"), "ann-probes")
        sizes = postings.groupBy("list").agg(F.ceil(F.count("*") / PART_VECTORS).cast("int").alias("nv"))
        sizes = checkpointed(sizes.join(probes.groupBy("list").agg(F.ceil(F.count("*") / PART_QUERIES).cast("int").alias("nq")), "list"))
        parts = F.broadcast(sizes)  # a row a list: CENTROIDS at most
        several = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        held = postings.join(parts, "list").select("list", F.pmod(F.xxhash64("vec_id"), F.col("nv")).cast("int").alias("pv"), several("nq").alias("pq"), "vec_id", "x")
        asked = probes.join(parts, "list").select("list", several("nv").alias("pv"), F.pmod(F.xxhash64("query_id"), F.col("nq")).cast("int").alias("pq"), "query_id", "x", "floor")
        keys = ["list", "pv", "pq"]
        found = asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(lambda q, v: _best(q, v, top), "query_id long, vec_id long, score double")
        once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
        return checkpointed(ranked.where(F.col("rank") <= top).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))

    queries = written(rows.where(is_query).groupBy("vec_id").agg(F.min("x").alias("x")), "ann-queries")
    most = min(top, rows.select("vec_id").distinct().count() - 1)
    if most <= 0:
        return empty
    # Queries whose lists held fewer than they should get look at ever more lists, all of them in the end.
    parts, waiting, times = [], queries, 1
    while True:
        got = search(waiting, times)
        full = got.groupBy("query_id").agg(F.count("*").alias("n")).where((F.col("n") >= most) | F.lit(times > 1 and times * shared.value["width"] >= len(shared.value["c"]))).select("query_id")
        parts.append(got.join(full, "query_id", "left_semi").select(*got.columns))
        waiting = checkpointed(waiting.join(full, waiting.vec_id == full.query_id, "left_anti"))
        if (times > 1 and times * shared.value["width"] >= len(shared.value["c"])) or not waiting.take(1):
            break
        times *= 4
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def op1_ann(spark, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)
