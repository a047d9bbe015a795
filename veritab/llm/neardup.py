"""Near-duplicates of a corpus by Jaccard similarity of word shingles, each link verified.

Texts are sets of hashed five-word shingles. Sets of SIMILARITY or more are sought by MinHash: they
meet if all ROWS minima of one of BANDS bands are equal, which a pair of similarity 0.8 misses in
all bands in 0.07 % of cases. Sets also meet by SimHash, as simhash.py finds fingerprints within four
bits (at similarity 0.8 they differ in about ten, so this finds the closest only). Pairs that meet are compared by size and by a byte of each minimum, and what
is left exactly, on whole sets; only pairs of SIMILARITY or more become links.

Work is on distinct sets. In meetings of up to NEXT + 2 sets every pair is compared; in larger ones
each set with the first and the preceding one, and those of more than CHUNK sets are dealt into
chunks, whose first sets meet again. What larger meetings leave open - sets that
comparisons have not joined - is settled by an exact prefix-filtered join of those sets: shingles
are ordered by rarity, and two sets of SIMILARITY or more share one of their rarest shingles, as
many as their sizes allow to differ. So thousands of texts that share a passage, or differ in a
word too many, do not meet there. Sets that meet many others even there, but are not of their main
component, are compared with them on whole sets in blocks, which only links leave.

Defined results. Words are as in simhash.py. A text of fewer than five words is one shingle; texts
without words are copies of each other, and so is a null text. Rows are kept apart even if doc_id
repeats.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import HOTS, bounded_batches, checkpointed, looked_up, written
from .components import components
from .simhash import BROADCAST_ROWS, fingerprint, first_of_each, near_links

WORDS, SEED = 5, 42
#: Similarity of a link, as a fraction.
SIMILAR, OF = 4, 5
BANDS, ROWS = 24, 6
#: Pairs go on to the exact comparison with this share of equal minima; at 0.8 that is six deviations below what is expected.
LIKELY = 0.6
NEXT = 16
#: Larger meetings are dealt into chunks of about this size, and so are the pairs of one set.
CHUNK = 256
#: Sizes of sets fall into classes: each size up to EACH, then steps of STEP.
EACH, STEP = 64, 1.02
#: Shingles of a chunk, at most (a longer text is a chunk of its own), where whole sets are compared in blocks.
CELLS = 1 << 19
_STEP = 1 << 10
_R = np.random.default_rng(SEED)
_A = _R.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_B = _R.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingles(text: bytes) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if n < WORDS:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[: n - WORDS + 1].tolist(), ends[WORDS - 1 :].tolist(), strict=True)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in spans), np.uint64, n - WORDS + 1))


def minima(own: np.ndarray) -> np.ndarray:
    """The least value of the set under each of BANDS * ROWS permutations."""
    out = np.full(len(_A), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(own), _STEP):
        np.minimum(out, (own[None, k : k + _STEP] * _A[:, None] + _B[:, None]).min(1), out=out)
    return out


def similar(one: np.ndarray, other: np.ndarray) -> bool:
    both = len(np.intersect1d(one, other, assume_unique=True))
    return OF * both >= SIMILAR * (len(one) + len(other) - both)


def _texts(column):
    return (x.as_buffer().to_pybytes() if x.is_valid else b"" for x in column)


def _id(own: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(own.tobytes()) if len(own) else 0


def sketches(docs: DataFrame) -> DataFrame:
    """docs without the text, with sid (of its set), n (shingles), near (a byte of each minimum), fp (its SimHash) and bands."""
    bounded_batches(docs.sparkSession)
    own = [f for f in docs.schema.fields if f.name != "text"]
    schema = T.StructType([*own, T.StructField("sid", T.LongType()), T.StructField("n", T.LongType()), T.StructField("near", T.BinaryType()), T.StructField("fp", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches):
        for b in batches:
            sids, ns, near, prints, bands = [], [], [], [], []
            for x in _texts(b.column("text")):
                s = shingles(x)
                m = minima(s)
                sids.append(_id(s))
                ns.append(len(s))
                near.append((m & np.uint64(255)).astype(np.uint8).tobytes())
                prints.append(fingerprint(x))
                bands.append([xxhash.xxh64_intdigest(m[k * ROWS : (k + 1) * ROWS].tobytes(), k) for k in range(BANDS)] if len(s) else [])
            flat = np.array([x for own in bands for x in own], np.uint64).view(np.int64)
            at = np.concatenate([[0], np.cumsum([len(x) for x in bands])]).astype(np.int32)
            columns = [pa.array(np.array(sids, np.uint64).view(np.int64)), pa.array(ns, pa.int64()), pa.array(near, pa.binary()), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))]
            yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in own], *columns], names=schema.names)

    return docs.mapInArrow(run, schema)


def _sets(batches):
    for b in batches:
        own = [shingles(x) for x in _texts(b.column("text"))]
        sids = np.array([_id(s) for s in own], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(sids), pa.array([s.tobytes() for s in own], pa.binary())], names=["sid", "s"])


def _listed(batches):
    for b in batches:
        own = [shingles(x) for x in _texts(b.column("text"))]
        sids = np.array([_id(s) for s in own], np.uint64).view(np.int64)
        flat, ends = np.concatenate([np.zeros(0, np.uint64), *own]).view(np.int64), np.cumsum([0, *map(len, own)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(sids), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["sid", "s"])


def _likely(batches):
    for b in batches:
        x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(b.num_rows, -1) for c in ("na", "nb"))
        yield b.select(["a", "b"]).filter(pa.array((x == y).sum(1) >= LIKELY * BANDS * ROWS))


def _links(batches):
    for b in batches:
        fits = [similar(*(np.frombuffer(x.as_buffer(), np.uint64) for x in both)) for both in zip(b.column("sa"), b.column("sb"), strict=True)]
        yield b.select(["a", "b"]).filter(pa.array(fits, pa.bool_()))


def _attached(pairs: DataFrame, sets: DataFrame, value: str, a: str, b: str) -> DataFrame:
    """pairs (a, b) with the value of both; a set with many pairs is dealt over as many tasks as it has chunks of them."""
    chunks = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(CHUNK)).cast("long").alias("chunks"))
    first = sets.join(chunks, sets.sid == chunks.a).select("a", F.col(value).alias(a), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"))
    dealt = pairs.join(chunks, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("chunks")).alias("chunk"))
    other = sets.select(F.col("sid").alias("b"), F.col(value).alias(b))
    return dealt.join(other, "b").join(first, ["a", "chunk"]).select("a", "b", a, b)


def verified(pairs: DataFrame, distinct: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of sids whose whole sets are similar."""
    likely = checkpointed(_attached(pairs, distinct, "near", "na", "nb").mapInArrow(_likely, "a long, b long"))
    wanted = likely.select(F.col("a").alias("sid")).union(likely.select("b")).distinct()
    texts = checkpointed(distinct.join(wanted, "sid").select(F.col("h").alias("_h")))
    side = F.broadcast(texts) if texts.count() <= BROADCAST_ROWS else texts
    whole = docs.select("text").join(side, F.xxhash64("text") == F.col("_h")).select("text")
    sets = written(whole.mapInArrow(_sets, "sid long, s binary").dropDuplicates(["sid"]), "near-sets")
    return checkpointed(_attached(likely, sets, "s", "sa", "sb").mapInArrow(_links, "a long, b long"))


def _ordered(one: str, other: str) -> list:
    return [F.least(one, other).alias("a"), F.greatest(one, other).alias("b")]


def _sized(n: str, m: str):
    return OF * F.least(n, m) >= SIMILAR * F.greatest(n, m)


def met(keyed: DataFrame, total: int) -> DataFrame:
    """(k, sid, n, at, last): each set with those of its meeting k (sid, n) that it is compared with; total: rows of keyed."""
    own = F.struct("sid", "n")
    most = max(CHUNK, total // HOTS)
    hot = checkpointed(keyed.groupBy("k").agg(F.count("*").alias("m")).where(F.col("m") > most).select("k", F.ceil(F.col("m") / most).cast("long").alias("chunks")))
    dealt = keyed.join(F.broadcast(hot), "k", "left")  # HOTS meetings at most
    dealt = dealt.select("k", "sid", "n", F.coalesce(F.pmod(F.xxhash64("sid"), F.col("chunks")), F.lit(-1)).alias("c"))
    heads = dealt.where("c >= 0").groupBy("k", "c").agg(F.min(own).alias("o")).select("k", "o.sid", "o.n", F.lit(-2).cast("long").alias("c"))
    whole = Window.partitionBy("k", "c")
    order = whole.orderBy("sid")
    out = dealt.union(heads).select("k", "c", "sid", "n", F.row_number().over(order).alias("at"), F.count("*").over(whole).alias("m"), F.first(own).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("lead"), F.collect_list(own).over(order.rowsBetween(-NEXT, -1)).alias("last"))
    last = F.when((F.col("m") > NEXT + 2) & (F.size("last") > 0), F.slice("last", -1, 1)).otherwise(F.col("last"))
    return written(out.withColumn("last", F.array_distinct(F.concat(F.array("lead"), last))).drop("lead", "m"), "near-met")


def _pairs(meetings: DataFrame) -> DataFrame:
    near = meetings.where("at > 1").select("sid", "n", F.explode("last").alias("o")).where((F.col("sid") != F.col("o.sid")) & _sized("n", "o.n"))
    return near.select(*_ordered("sid", "o.sid")).distinct()


def _open(meetings: DataFrame, roots: DataFrame, total: int) -> DataFrame:
    """(k, sid, n, root) of meetings of more than NEXT + 2 sets that are not of one component yet."""
    large = meetings.groupBy("k").agg(F.max("at").alias("m")).where(F.col("m") > NEXT + 2).select("k")
    members = meetings.where("c > -2").join(large, "k", "left_semi").select("sid", "k", "n")
    members = checkpointed(members.join(roots.withColumnRenamed("node", "sid"), "sid", "left").select("k", "sid", "n", F.coalesce("root", "sid").alias("root")))
    mixed = members.groupBy("k").agg((F.min("root") < F.max("root")).alias("mixed")).where("mixed").select("k")
    return members.join(mixed, "k", "left_semi")


def size_class(n):
    rough = F.floor(F.log(n / F.lit(float(EACH))) / float(np.log(STEP))).cast("int")
    fits = F.when(n < _start(rough), rough - 1).when(n >= _start(rough + 1), rough + 1).otherwise(rough)
    return F.when(n <= EACH, n).otherwise(EACH + 1 + F.greatest(fits, F.lit(0))).cast("int")


def _start(step):
    return F.ceil(EACH * F.pow(F.lit(STEP), step))


def _least_size(c):
    """The least size of the class."""
    return F.when(c <= EACH, c).otherwise(F.greatest(_start(c - (EACH + 1)), F.lit(EACH + 1))).cast("long")


def rare_keys(sets: DataFrame) -> DataFrame:
    """(k, sid, n) of sets (sid, s): for each class of sizes that may be similar, the rarest shingles of which similar sets share one."""
    each = checkpointed(sets.select("sid", F.explode("s").alias("x")))
    counts = each.groupBy("x").agg(F.count("*").alias("c"))
    ordered = looked_up(each, counts, "x", each.count()).groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("c", "x"))).alias("s"))
    own = checkpointed(ordered.select("sid", F.size("s").cast("long").alias("n"), F.transform("s", lambda v: v["x"]).alias("s")))
    low, high = F.ceil(F.lit(SIMILAR / OF) * F.col("n") - 1e-9), F.floor(F.col("n") * F.lit(OF / SIMILAR) + 1e-9)
    others = own.withColumns({"own": size_class(F.col("n")), "low": low}).withColumn("other", F.explode(F.sequence(size_class(low), size_class(high))))
    shared = F.ceil(F.lit(SIMILAR / (SIMILAR + OF)) * (F.col("n") + F.greatest(_least_size(F.col("other")), F.col("low"))) - 1e-9)
    take = F.greatest(F.least(F.col("n"), F.col("n") - shared + 1), F.lit(1)).cast("int")
    keys = others.select("sid", "n", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), F.explode(F.slice("s", F.lit(1), take)).alias("x"))
    return checkpointed(keys.select(F.xxhash64("x", "a", "b").alias("k"), "sid", "n"))


def _by_simhash(distinct: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets by links of their fingerprints; of equal fingerprints the least set stands for the others."""
    sets = checkpointed(distinct.where("n > 0").select("sid", "n", "fp"))
    first = checkpointed(sets.groupBy("fp").agg(F.min(F.struct("sid", "n")).alias("o")))
    same = looked_up(sets, first, "fp", sets.count()).select("sid", "n", "o")
    ends = near_links(first.select("fp")).join(first.select(F.col("fp").alias("a"), F.col("o").alias("l")), "a").join(first.select(F.col("fp").alias("b"), "o"), "b")
    near = same.union(ends.select("l.sid", "l.n", "o")).where((F.col("sid") != F.col("o.sid")) & _sized("n", "o.n"))
    return near.select(*_ordered("sid", "o.sid")).distinct()


def links(distinct: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets that have the same components as all similar pairs that meet."""
    keyed = distinct.select(F.explode("bands").alias("k"), "sid", "n")
    total = BANDS * distinct.count()
    meetings = met(keyed, total)
    pairs = checkpointed(_pairs(meetings).union(_by_simhash(distinct)).distinct())
    first = verified(pairs, distinct, docs)
    roots = components(first)
    waiting = checkpointed(_open(meetings, roots, total).select("sid").distinct())
    if not waiting.take(1):
        return first
    texts = distinct.join(waiting, "sid").select(F.col("h").alias("_h"))
    whole = written(docs.select("text").join(texts, F.xxhash64("text") == F.col("_h")).select("text").mapInArrow(_listed, "sid long, s array<long>").dropDuplicates(["sid"]), "near-waiting")
    keyed = rare_keys(whole)
    total = keyed.count()
    meetings = met(keyed, total)
    more = checkpointed(_pairs(meetings).join(pairs, ["a", "b"], "left_anti"))
    # What is joined already stands for its links, so each step starts from the components of the last.
    roots = components(_stars(roots).union(verified(more, distinct, docs)))
    return _stars(roots).union(_across(_open(meetings, roots, total), whole))


def _stars(roots: DataFrame) -> DataFrame:
    return roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))


def _across(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between sets that share a rare shingle with many others but are not of their main component.

    Meetings that have sets in common are one cloud. The sets outside a cloud's main component are
    compared with all its sets, whole sets in blocks of bounded size; only links leave a block.
    """
    members = checkpointed(members)
    if not members.take(1):
        return members.select(F.col("sid").alias("a"), F.col("sid").alias("b"))
    clouds = components(members.select(F.col("k").alias("a"), F.col("root").alias("b")).distinct()).withColumnRenamed("root", "cloud")
    sets_of = checkpointed(members.select("sid", "n", F.col("root").alias("node")).distinct())
    rows = checkpointed(looked_up(sets_of, clouds, "node", sets_of.count()).select("cloud", "sid", "n", F.col("node").alias("root")))
    main = rows.groupBy("cloud", "root").agg(F.count("*").alias("c")).groupBy("cloud").agg(F.max_by("root", F.struct("c", "root")).alias("main"), (F.sum("c") - F.max("c")).alias("apart"))
    size = rows.groupBy("cloud").agg(F.greatest(F.least(F.lit(CHUNK), F.floor(F.lit(CELLS) / F.max("n"))), F.lit(1)).cast("long").alias("per"), F.count("*").alias("m"))
    parts = lambda n: F.ceil(F.col(n) / F.col("per")).cast("long")
    rows = checkpointed(rows.join(main.join(size, "cloud").select("cloud", "main", parts("m").alias("chunks"), parts("apart").alias("blocks")), "cloud"))
    several = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    place = lambda salt, n: F.pmod(F.xxhash64("sid", F.lit(salt)), F.col(n))
    probes = rows.where("root <> main").select("cloud", place("block", "blocks").alias("block"), several("chunks").alias("chunk"), "sid", "root", F.lit(1).alias("side"))
    bases = rows.where("blocks > 0").select("cloud", several("blocks").alias("block"), place("chunk", "chunks").alias("chunk"), "sid", "root", F.lit(0).alias("side"))
    return checkpointed(probes.union(bases).join(sets, "sid").groupBy("cloud", "block", "chunk").applyInArrow(_compared, "a long, b long").distinct())


def overlaps(probes: list[np.ndarray], bases: list[np.ndarray]) -> np.ndarray:
    """How many members each of some sets has in common with each of others."""
    flat, of = np.concatenate([*probes, *bases]), np.repeat(np.arange(len(probes) + len(bases)), [len(x) for x in [*probes, *bases]])
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    keep = times[column] > 1
    columns, column = np.unique(column[keep], return_inverse=True)
    of, out, width = of[keep], np.zeros((len(probes), len(bases)), np.int64), 1 << 13
    order = np.argsort(column, kind="stable")
    of, column = of[order], column[order]
    for low in range(0, len(columns), width):
        s, e = np.searchsorted(column, [low, low + width])
        held = np.zeros((len(probes) + len(bases), width), np.float32)
        held[of[s:e], column[s:e] - low] = 1
        out += (held[: len(probes)] @ held[len(probes) :].T).astype(np.int64)
    return out


def _compared(table: pa.Table) -> pa.Table:
    sid, root, side = (table.column(c).to_numpy() for c in ("sid", "root", "side"))
    sets = [np.asarray(x.values, np.int64) for x in table.column("s")]
    p, q = np.flatnonzero(side == 1), np.flatnonzero(side == 0)
    a, b = [], []
    if len(p) and len(q):
        size = np.array([len(x) for x in sets])
        both = overlaps([sets[i] for i in p], [sets[i] for i in q])
        near = OF * both >= SIMILAR * (size[p][:, None] + size[q] - both)
        near &= root[p][:, None] != root[q]
        for i in np.flatnonzero(near.any(1)):
            at = q[near[i]]
            at = at[np.unique(root[at], return_index=True)[1]]  # one link to each component is enough
            a.append(np.full(len(at), sid[p[i]]))
            b.append(sid[at])
    none = np.zeros(0, np.int64)
    return pa.table({"a": pa.array(np.concatenate([none, *a]), pa.int64()), "b": pa.array(np.concatenate([none, *b]), pa.int64())})


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with one row of each component of links: that with the smallest doc_id (null ids last), then by its text's hash."""
    prints = written(sketches(docs.select("doc_id", F.xxhash64("text").alias("h"), "text")), "near-prints")
    distinct = written(prints.dropDuplicates(["sid"]).drop("doc_id"), "near-distinct")
    roots = components(links(distinct, docs))
    rooted = checkpointed(distinct.join(roots, distinct.sid == roots.node).select("sid", "root"))
    rows = looked_up(prints.select("doc_id", "h", "sid"), rooted, "sid", prints.count(), "left").groupBy(F.coalesce("root", "sid").alias("root"), "doc_id", "h").agg(F.count("*").alias("n"))
    return first_of_each(docs, checkpointed(rows))
