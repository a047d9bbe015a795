"""Words of many texts, each looked up once: block dictionaries, and their join back by position.

Texts are read in blocks of about a million words. A block keeps its texts as positions in a
dictionary of its own, and sends each distinct word once to the bucket that the word's checksum
names. Buckets see every distinct word of the corpus, answer for it once, and send the answers
back to the blocks that asked; a block puts the answers in the places of the words.

So a word is shuffled once a block, not once an occurrence, whatever its frequency. A block has a
bounded size. Buckets follow the number of input partitions, so a bucket's distinct words stay as
many; what blocks ask it is looked at one block after the other. Words of one block and bucket
travel packed as one value, which keeps both shuffles small.

Blocks are written to the shared folder, hence block numbers and their texts stay together when a
lost executor makes Spark run a task again; they are bucketed by block, so only answers are
shuffled when the two meet.
"""

from __future__ import annotations

import uuid
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import bounded_batches, partitions_of, shared_dir

#: Words in a block, after which it is closed (a longer text is a block of its own).
BLOCK_WORDS = 1 << 20
#: Distinct words of a block, after which it is closed.
BLOCK_DISTINCT = 250_000

STAGED = "block long, texts binary, words binary"
_PACK = zstandard.ZstdCompressor(level=1)


class Dictionary(dict):
    """Numbers words in order of appearance."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def pack(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays and bytes as one compressed blob."""
    parts = [x if isinstance(x, bytes) else np.ascontiguousarray(x).tobytes() for x in arrays]
    head = np.array([len(parts), *map(len, parts)], dtype=np.int64).tobytes()
    return _PACK.compress(head + b"".join(parts))


def unpack(blob: bytes, *kinds) -> list:
    """What pack() was given: arrays of the dtypes named, bytes where None is named."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes = np.frombuffer(raw, np.int64, n, 8)
    at, out = 8 + 8 * n, []
    for size, kind in zip(sizes, kinds, strict=True):
        out.append(raw[at : at + size] if kind is None else np.frombuffer(raw[at : at + size], kind))
        at += size
    return out


def slices(data: bytes, lengths: np.ndarray) -> list[bytes]:
    ends = np.cumsum(lengths).tolist()
    return [data[s:e] for s, e in zip([0, *ends[:-1]], ends, strict=True)]


def ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_ipc(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def planes(x: np.ndarray, width: int = 4) -> bytes:
    """Whole numbers of width bytes (4 or 8), all lowest bytes first: packs better than the numbers."""
    return np.ascontiguousarray(x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes()


def from_planes(data: bytes, width: int = 4) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(f"<u{width}").ravel()


def pack_words(listed: list[bytes]) -> tuple[bytes, bytes]:
    return planes(np.fromiter(map(len, listed), np.uint32, len(listed))), b"".join(listed)


def unpack_words(lengths: bytes, data: bytes) -> list[bytes]:
    return slices(data, from_planes(lengths).astype(np.int64)) if lengths else []


def staged(docs: DataFrame, split: Callable[[pa.Array], Iterator[list]], name: str, text: str = "text", weight: str | None = None, buckets: int | None = None) -> DataFrame:
    """docs as blocks (block, texts, words), a table in the shared folder that is bucketed by block.

    split: the words (bytes) of each of some texts. texts has the other columns, word counts and
    positions; words has the dictionary in the order of its buckets and, if a weight column is
    named, how often each word occurs in rows where that column is true. The catalogue forgets
    the table at once; its files stay in the shared folder.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    buckets = buckets or max(16, partitions_of(docs))
    kept = [c for c in docs.columns if c != text]
    most_words, most_distinct = BLOCK_WORDS, BLOCK_DISTINCT

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng()
        words, sizes, codes, rows, weights = Dictionary(), [], [], [], []

        def close():
            block = int(rng.integers(1, 1 << 62))
            code = np.concatenate(codes) if codes else np.zeros(0, np.uint32)
            count = np.array(sizes, dtype=np.int64)
            carried = pa.Table.from_batches(rows).combine_chunks()
            listed = list(words)
            n = len(listed)
            of = np.fromiter(map(zlib.crc32, listed), np.int64, n) % buckets
            order = np.lexsort((-np.bincount(code, minlength=n), of))  # by bucket, frequent words first
            asked_of, first = np.unique(of[order], return_index=True)
            bounds = np.append(first, n).astype(np.int64)
            at = np.searchsorted(asked_of, of)
            rank = np.empty(n, np.int64)
            rank[order] = np.arange(n) - bounds[at[order]]
            texts = pack(ipc(carried.to_batches()[0]), count, asked_of, bounds, planes(at[code]), planes(rank[code]))
            tally = b""
            if weight:
                tally = np.bincount(code[np.repeat(np.array(weights, dtype=bool), count)], minlength=n)[order].astype(np.int64).tobytes()
            asks = pack(asked_of, bounds, *pack_words([listed[k] for k in order.tolist()]), tally)
            words.clear()
            for x in (sizes, codes, rows, weights):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([texts], pa.binary()), pa.array([asks], pa.binary())], names=["block", "texts", "words"])

        seen = 0
        for b in batches:
            carried = b.select(kept)
            marks = b.column(weight).to_pylist() if weight else [True] * b.num_rows
            since = 0
            for i, own in enumerate(split(b.column(text))):
                codes.append(np.array(array("I", map(words.__getitem__, own)), dtype=np.uint32))
                sizes.append(len(own))
                weights.append(bool(marks[i]))
                seen += len(own)
                if seen >= most_words or len(words) >= most_distinct:
                    rows.append(carried.slice(since, i + 1 - since))
                    since, seen = i + 1, 0
                    yield close()
            if since < b.num_rows:
                rows.append(carried.slice(since))
        if sizes:
            yield close()

    tag = f"{name}_{uuid.uuid4().hex}"
    made = docs.mapInArrow(run, STAGED).write.option("compression", "uncompressed").option("path", f"{shared_dir(spark).rstrip('/')}/{tag}")
    made.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "block").saveAsTable(tag)
    out = spark.table(tag)
    spark.sql(f"DROP TABLE {tag}")
    return out


def asked(staged_blocks: DataFrame) -> DataFrame:
    """(block, bucket, blob): the words that a block asks a bucket for, and their tallies."""

    def run(batches):
        for b in batches:
            for block, blob in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                asked_of, bounds, lengths, data, tally = unpack(blob.as_py(), np.int64, np.int64, None, None, np.int64)
                listed, ends = unpack_words(lengths, data), bounds.tolist()
                blobs = [pack(*pack_words(listed[lo:hi]), tally[lo:hi]) for lo, hi in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(blobs), pa.int64()), pa.array(asked_of), pa.array(blobs, pa.binary())], names=["block", "bucket", "blob"])

    return staged_blocks.select("block", "words").mapInArrow(run, "block long, bucket long, blob binary")


def answered(staged_blocks: DataFrame, answers: DataFrame, finish: Callable[[pa.Table, np.ndarray, np.ndarray, Iterable], pa.Table], asks: tuple, schema, numbered: bool = False) -> DataFrame:
    """Rows that finish makes of each block: its columns, word counts, positions and answers; behind the block's number, if numbered.

    answers: (block, bucket, blob), for each bucket that the block has asked, in its words' order;
    finish gets the bucket, the numbers of those words and the blob's parts.
    """

    def run(block_rows: pa.Table, answer_rows: pa.Table) -> pa.Table:
        out = []
        for blob in block_rows.column("texts"):
            head, count, asked_of, bounds, at, rank = unpack(blob.as_py(), None, np.int64, np.int64, np.int64, None, None)
            code = bounds[from_planes(at)] + from_planes(rank)
            own = answer_rows.column("bucket").to_pylist()
            place = np.searchsorted(asked_of, np.array(own, np.int64)).tolist()
            got = ((k, slice(int(bounds[i]), int(bounds[i + 1])), *unpack(x.as_py(), *asks)) for k, i, x in zip(own, place, answer_rows.column("blob"), strict=True))
            made = finish(from_ipc(head), count, code, got)
            out.append(made.add_column(0, "block", pa.repeat(block_rows.column("block")[0], made.num_rows)) if numbered else made)
        return pa.concat_tables(out)

    return staged_blocks.select("block", "texts").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)


def streamed(asks: DataFrame, fresh: Callable[[], Callable[[bytes], bytes]]) -> DataFrame:
    """(block, bucket, blob) of answers, ask after ask: fresh() gives what answers the asks of one bucket."""

    def run(batches):
        bucket, answer = None, None
        for b in batches:
            blobs = []
            for k, blob in zip(b.column("bucket").to_pylist(), b.column("blob"), strict=True):
                if k != bucket:
                    bucket, answer = k, fresh()
                blobs.append(answer(blob.as_py()))
            yield pa.RecordBatch.from_arrays([b.column("block"), b.column("bucket"), pa.array(blobs, pa.binary())], names=["block", "bucket", "blob"])

    return asks.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "block long, bucket long, blob binary")
