"""SimHash near-duplicates by deletion-variant signatures.

Texts get a 64-bit SimHash of their word shingles. To find fingerprints that differ in at most
four bits, the 64 bits are cut into three segments, so that one segment differs in at most one
bit. Every fingerprint is indexed under each of its 64 variants (a segment with one bit made a
wildcard); those equal in a variant meet, and only verified links leave the meeting.

Work is on distinct fingerprints. A meeting of up to MEET fingerprints gives the links of a
spanning forest, never all pairs. Larger meetings are dealt into chunks: chunks are linked within
themselves, components are formed, and then only fingerprints outside a meeting's main component
are compared with the other chunks, in blocks of at most MEET by MEET.

Defined results. A null text is an empty one; texts without words have fingerprint zero and are
linked like any other. Rows are kept apart even if doc_id repeats. A null doc_id gets a
fingerprint; it names a component only if no row of it has an id (component_id is null then).
Other columns of docs are not read by near_duplicates and stay in deduplicated. Very long texts are
read whole, in steps. An empty table gives an empty one.

A fingerprint meets others on 20 or 21 bits of a segment and its wildcard, so of n fingerprints of
unrelated texts about 64 * n / 2**20 meet each one by chance: comparisons, in vectorised steps of a
task, grow with n squared over 2**14. At 10**9 distinct fingerprints that is 60,000 each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, checkpointed, looked_up, table, written
from .components import components

WORDS, SEED, DISTANCE = 4, 42, 4
#: First bits of the segments, and the end.
SEGMENTS = (0, 21, 42, 64)
MEET = 4096
#: Rows to be dropped are broadcast up to this many (about 50 bytes each).
BROADCAST_ROWS = 200_000
_STEP = 1 << 16


def fingerprint(text: bytes) -> int:
    """The SimHash of one text: bits set in over half the hashes of its shingles."""
    words = text.lower().split()  # of bytes: A-Z only, and white space is \x20 \x09-\x0D
    n = len(words)
    if not n:
        return 0
    if n < WORDS:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    total, count = np.zeros(64, np.int64), n - WORDS + 1
    for k in range(0, count, _STEP):
        m = min(_STEP, count - k)
        spans = zip(starts[k : k + m].tolist(), ends[k + WORDS - 1 : k + WORDS - 1 + m].tolist(), strict=True)
        digests = b"".join([xxhash.xxh64_digest(joined[s:e], SEED) for s, e in spans])
        bits = np.unpackbits(np.frombuffer(digests, np.uint8)).reshape(m, 64)
        whole = m // 255 * 255
        if whole:
            total += bits[:whole].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
        total += bits[whole:].sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > count).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fp") -> DataFrame:
    """docs without the text, with its fingerprint as a signed long."""
    bounded_batches(docs.sparkSession)
    schema = T.StructType([f for f in docs.schema.fields if f.name not in (text, out)] + [T.StructField(out, T.LongType())])
    names = [f.name for f in schema.fields[:-1]]

    def run(batches):
        for b in batches:
            fps = np.fromiter((fingerprint(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in b.column(text)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*[b.column(x) for x in names], pa.array(fps.view(np.int64))], names=[*names, out])

    return docs.mapInArrow(run, schema)


def _near(one: np.uint64, many: np.ndarray, most: int) -> np.ndarray:
    return np.bitwise_count(many ^ one) <= most


def spanning(fps: np.ndarray, most: int = DISTANCE) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links of a spanning forest of the fingerprints that differ in at most most bits."""
    links, rest = [], fps
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            p = queue.pop()
            near = _near(p, rest, most)
            if near.any():
                found, rest = rest[near], rest[~near]
                links.append((np.full(len(found), p), found))
                queue += list(found)
    return links


def _meetings(batches, most: int, meet: int):
    """From (k, fp) sorted by k: links (kind 0), or the members of meetings above meet (kind 1)."""
    carry_k, carry_f, hot = np.zeros(0, np.int64), np.zeros(0, np.uint64), None

    def settle(k: np.ndarray, f: np.ndarray):
        a, b, out_k, out_f = [], [], [], []
        heads = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        sizes = np.diff(np.append(heads, len(k)))
        small = np.repeat(sizes <= 8, sizes)
        for d in range(1, 8):
            i = np.flatnonzero((k[d:] == k[:-d]) & small[d:])
            if not len(i):
                break
            i = i[np.bitwise_count(f[i] ^ f[i + d]) <= most]
            a.append(f[i])
            b.append(f[i + d])
        for h in np.flatnonzero(sizes > 8):
            own = f[heads[h] : heads[h] + sizes[h]]
            if sizes[h] > meet:
                out_k.append(np.full(len(own), k[heads[h]]))
                out_f.append(own)
            else:
                for x, y in spanning(own, most):
                    a.append(x)
                    b.append(y)
        return [np.concatenate(x) if x else np.zeros(0, kind) for x, kind in ((a, np.uint64), (b, np.uint64), (out_k, np.int64), (out_f, np.uint64))]

    def batch(a, b, hk, hf):
        n, m = len(a), len(hk)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat([0, 1], [n, m]).astype(np.int32)), pa.array(np.concatenate([np.zeros(n, np.int64), hk])), pa.array(np.concatenate([a, hf]).view(np.int64)), pa.array(np.concatenate([b, hf]).view(np.int64))],
            names=["kind", "k", "a", "b"],
        )

    for x in batches:
        k = np.concatenate([carry_k, x.column("k").to_numpy()])
        f = np.concatenate([carry_f, x.column("fp").to_numpy().view(np.uint64)])
        if hot is not None:  # the rest of a meeting that is being passed on
            n = int(np.searchsorted(k, hot, side="right"))
            if n:
                yield batch(np.zeros(0, np.uint64), np.zeros(0, np.uint64), k[:n], f[:n])
            k, f, hot = k[n:], f[n:], hot if n == len(k) else None
        if not len(k):
            carry_k, carry_f = k, f
            continue
        last = int(np.searchsorted(k, k[-1]))
        if last:
            yield batch(*settle(k[:last], f[:last]))
        carry_k, carry_f = k[last:], f[last:]
        if len(carry_k) > meet:
            hot = carry_k[0]
            yield batch(np.zeros(0, np.uint64), np.zeros(0, np.uint64), carry_k, carry_f)
            carry_k, carry_f = carry_k[:0], carry_f[:0]
    if len(carry_k):
        yield batch(*settle(carry_k, carry_f))


def _variants(batches):
    """(k, fp) for each fingerprint and bit: the bit's number and its segment without it."""
    bits = np.arange(64, dtype=np.uint64)
    segment = np.searchsorted(np.array(SEGMENTS), np.arange(64), side="right") - 1
    low = np.array(SEGMENTS, dtype=np.uint64)[segment]
    width = np.array([SEGMENTS[s + 1] - SEGMENTS[s] for s in segment], dtype=np.uint64)
    one = np.uint64(1)
    mask = ((one << width) - one) ^ (one << (bits - low))
    for b in batches:
        f = b.column("fp").to_numpy().view(np.uint64)
        k = (((f[:, None] >> low) & mask) << np.uint64(6)) | bits
        yield pa.RecordBatch.from_arrays([pa.array(k.ravel().view(np.int64)), pa.array(np.repeat(f, 64).view(np.int64))], names=["k", "fp"])


def near_links(distinct: DataFrame, most: int = DISTANCE, meet: int = MEET) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect just those within most bits.

    Not every pair of a dense group is listed: the links have the same components as all pairs.
    """
    assert most < 2 * (len(SEGMENTS) - 1), "segments must leave one with at most one differing bit"
    spark = distinct.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = distinct.select("fp").mapInArrow(_variants, "k long, fp long")
    met = written(keyed.repartition(n, "k").sortWithinPartitions("k").mapInArrow(lambda x: _meetings(x, most, meet), "kind int, k long, a long, b long"), "simhash-met")
    links = met.where("kind = 0").select("a", "b")
    hot = met.where("kind = 1").select("k", F.col("a").alias("fp"))
    sizes = hot.groupBy("k").agg(F.count("*").alias("n"))
    if not sizes.take(1):
        return links.distinct()
    sizes = checkpointed(sizes)
    hot = checkpointed(hot.join(sizes, "k").withColumn("chunks", F.ceil(F.col("n") / meet).cast("long")).withColumn("chunk", F.pmod(F.xxhash64("fp", "k"), F.col("chunks"))))

    def within(_, pdf):
        import pandas as pd

        found = spanning(pdf["fp"].to_numpy().astype(np.int64).view(np.uint64), most)
        return pd.DataFrame({"a": np.concatenate([np.zeros(0, np.uint64), *[x for x, _ in found]]).view(np.int64), "b": np.concatenate([np.zeros(0, np.uint64), *[y for _, y in found]]).view(np.int64)})

    first = checkpointed(links.union(hot.groupBy("k", "chunk").applyInPandas(within, "a long, b long")).distinct())
    roots = components(first)
    labelled = hot.join(roots, hot.fp == roots.node, "left").select("k", "fp", "chunks", "chunk", F.coalesce("root", "fp").alias("root"))
    counts = labelled.groupBy("k", "root").agg(F.count("*").alias("c"))
    main = counts.groupBy("k").agg(F.max_by("root", F.struct("c", "root")).alias("main"))
    labelled = checkpointed(labelled.join(main, "k"))
    apart = labelled.where("root <> main")
    apart_sizes = apart.groupBy("k").agg(F.ceil(F.count("*") / F.lit(meet)).cast("long").alias("blocks"))
    blocks = apart.join(apart_sizes, "k").withColumn("block", F.pmod(F.xxhash64("fp", F.lit("block")), F.col("blocks")))
    probes = blocks.select("k", "fp", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.lit(1).alias("side"))
    bases = labelled.join(apart_sizes, "k").select("k", "fp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "chunk", F.lit(0).alias("side"))

    def across(_, pdf):
        import pandas as pd

        f, side = pdf["fp"].to_numpy().astype(np.int64).view(np.uint64), pdf["side"].to_numpy()
        base, a, b = f[side == 0], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for p in f[side == 1]:
            found = base[_near(p, base, most) & (base != p)]
            a.append(np.full(len(found), p))
            b.append(found)
        return pd.DataFrame({"a": np.concatenate(a).view(np.int64), "b": np.concatenate(b).view(np.int64)})

    columns = ["k", "fp", "block", "chunk", "side"]
    second = probes.select(columns).union(bases.select(columns)).groupBy("k", "block", "chunk").applyInPandas(across, "a long, b long")
    return first.union(second).distinct()


def labelled(prints: DataFrame, most: int = DISTANCE, meet: int = MEET) -> DataFrame:
    """prints (with doc_id and fp) with component_id, and root: one fingerprint for each component."""
    distinct = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(near_links(distinct, most, meet)).select(F.col("node").alias("fp"), "root")
    rooted = checkpointed(distinct.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    known = checkpointed(looked_up(rooted, named, "root", rooted.count()).select("fp", "root", "component_id"))
    return looked_up(prints, known, "fp", prints.count())


def near_duplicates(docs: DataFrame, most: int = DISTANCE, meet: int = MEET) -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id reachable over links) of every row of docs."""
    prints = written(fingerprints(docs.select("doc_id", "text")), "simhash-prints")
    return labelled(prints, most, meet).select("doc_id", "fp", "component_id")


def deduplicated(docs: DataFrame, most: int = DISTANCE, meet: int = MEET) -> DataFrame:
    """docs with one row of each component: that with the smallest doc_id (null ids last), then by its text's hash."""
    h = F.xxhash64("text")
    prints = written(fingerprints(docs.select("doc_id", h.alias("h"), "text")), "simhash-prints")
    rows = labelled(prints, most, meet).groupBy("root", "doc_id", "h").agg(F.count("*").alias("n"))
    return first_of_each(docs, checkpointed(rows))


def first_of_each(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """docs with one row of each root of rows (root, doc_id, h: the hash of its text, n: how many)."""
    h = F.xxhash64("text")
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h")).alias("first"))
    first = first.select(F.col("first.doc_id").alias("_fd"), F.col("first.h").alias("_fh"))  # met by row, not by root: a root may have most rows
    judged = rows.join(first, F.col("doc_id").eqNullSafe(F.col("_fd")) & (F.col("h") == F.col("_fh")), "left").select("doc_id", "h", "n", F.col("_fh").isNotNull().alias("_veritab_stays"))
    # What goes, and what stays once of several equal rows; broadcast only if few.
    special = checkpointed(judged.where("NOT _veritab_stays OR n > 1").select(F.col("doc_id").alias("_veritab_d"), F.col("h").alias("_veritab_h"), "_veritab_stays"))
    side = F.broadcast(special) if special.count() <= BROADCAST_ROWS else special
    met = docs.join(side, docs.doc_id.eqNullSafe(side["_veritab_d"]) & (h == side["_veritab_h"]), "left")
    once = met.where("_veritab_h IS NULL").select(*docs.columns)
    if not special.where("_veritab_stays").take(1):
        return once
    return once.union(met.where("_veritab_stays").dropDuplicates(["_veritab_d", "_veritab_h"]).select(*docs.columns))


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
