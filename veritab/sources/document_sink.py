"""One file in order from many tasks: a Spark data source whose commit joins what the tasks wrote.

Rows (block, text) come sorted. Each task writes its rows to a file of its own, with the separators of
their blocks, and reports how many bytes each block has there. The commit walks these reports in the
order of the partitions and streams the files, a chunk at a time, between the openings and closings of
the blocks; so no row, task or process holds the whole. Attempts write files of their own: of a task
that ran twice only the one that was committed is read, and a failed job leaves no file at the path.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

CHUNK = 1 << 22


@dataclass(frozen=True)
class Frame:
    """What stands before a block's rows, between two of them, and after the last."""

    opening: str = ""
    separator: str = "\n"
    closing: str = ""


@dataclass
class Part(WriterCommitMessage):
    """The file of one task: (block, bytes) in order."""

    partition: int
    path: str
    blocks: list[tuple[int, int]]


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.frames = [Frame(*f) for f in json.loads(options["frames"])]
        self.staging = f"{self.path}.parts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Part:
        system, folder = _filesystem(self.staging)
        system.create_dir(folder, recursive=True)
        task = TaskContext.get()
        path, blocks = posixpath.join(folder, f"{task.partitionId():06d}-{uuid.uuid4().hex}"), []
        with system.open_output_stream(path) as out:
            for batch in iterator:
                for block, text in zip(batch.column("block").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    data = text.encode()
                    if not blocks or blocks[-1][0] != block:
                        blocks.append((block, 0))
                    elif separator := self.frames[block].separator:
                        data = separator.encode() + data
                    out.write(data)
                    blocks[-1] = (block, blocks[-1][1] + len(data))
        return Part(task.partitionId(), path, blocks)

    def commit(self, messages: list[Part | None]) -> None:
        system, target = _filesystem(self.path)
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.partition)
        joined = f"{_filesystem(self.staging)[1]}.joined"
        with system.open_output_stream(joined) as out:
            at, begun = 0, False
            out.write(self.frames[0].opening.encode())
            for part in parts:
                with system.open_input_stream(part.path) as rows:
                    for block, size in part.blocks:
                        while at < block:
                            out.write((self.frames[at].closing + self.frames[at + 1].opening).encode())
                            at, begun = at + 1, False
                        if begun:
                            out.write(self.frames[at].separator.encode())
                        begun = True
                        while size:
                            data = rows.read(min(size, CHUNK))
                            if not data:
                                raise OSError(f"{part.path} is shorter than its task said")
                            out.write(data)
                            size -= len(data)
            out.write("".join(f.closing + (self.frames[i + 1].opening if i + 1 < len(self.frames) else "") for i, f in enumerate(self.frames) if i >= at).encode())
        system.move(joined, target)
        self._clear()

    def abort(self, messages: list[Part | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        system, folder = _filesystem(self.staging)
        if system.get_file_info(folder).type != fs.FileType.NotFound:
            system.delete_dir(folder)


class OrderedDocument(DataSource):
    """Format "ordered_document": options path and frames."""

    @classmethod
    def name(cls) -> str:
        return "ordered_document"

    def schema(self) -> str:
        return "block int, text string"

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(dict(self.options))


def write_document(blocks: Sequence[tuple[Frame, DataFrame, Column | str, Sequence[Column | str]]], path: str) -> None:
    """One file at path, which tasks and driver share: for each block its frame, its rows, what is written of a row, and the order of the rows.

    Each block is sorted by columns of its own, nulls first. Rows whose text is null are left out. A file
    that is at path already is replaced, once all rows are written.
    """
    parts = []
    for i, (_, rows, text, order) in enumerate(blocks):
        own = [(F.col(c) if isinstance(c, str) else c).alias(f"o{k}") for k, c in enumerate(order)]
        # Each block has order columns of its own; in other blocks they are null, and block comes first.
        part = rows.select(F.lit(i).alias("block"), (F.col(text) if isinstance(text, str) else text).alias("text"), F.struct(*own).alias(f"_order{i}")).where("text IS NOT NULL")
        parts.append(part)
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    rows.sparkSession.dataSource.register(OrderedDocument)
    frames = json.dumps([(f.opening, f.separator, f.closing) for f, *_ in blocks])
    rows.orderBy("block", *[f"_order{i}" for i in range(len(parts))]).select("block", "text").write.format("ordered_document").option("frames", frames).option("path", path).mode("append").save()


def json_lists(head: dict, lists: Iterable[tuple[str, DataFrame, Sequence[Column | str]]], tail: dict, path: str) -> None:
    """One JSON object at path: head's entries, each list with a row's object a line, and tail's entries."""
    lists, blocks = list(lists), []
    entry = lambda k, v: f"{json.dumps(k)}:{json.dumps(v)}"
    for i, (name, rows, order) in enumerate(lists):
        before = ("{" + "".join(f"{entry(k, v)},\n" for k, v in head.items())) if i == 0 else ",\n"
        after = "\n]" + ("".join(f",\n{entry(k, v)}" for k, v in tail.items()) + "}\n" if i + 1 == len(lists) else "")
        blocks.append((Frame(f"{before}{json.dumps(name)}:[\n", ",\n", after), rows, F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}), order))
    write_document(blocks, path)
