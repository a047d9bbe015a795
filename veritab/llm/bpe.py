"""BPE encoding and decoding with a public tokenizer by a table of distinct words.

Texts are split into the tokenizer's words in Spark tasks; every distinct word of the corpus is
encoded once, in the bucket it falls to, and its ids are joined back to the words' positions
(see blocks.py). Decoding joins ids with the vocabulary's table of pieces - as many rows as the
vocabulary file has ids, so it is broadcast - and joins the pieces' bytes by position.

Defined results. A null text is encoded like an empty one: no tokens, and the digests of nothing.
Special tokens' strings in a text are their ids, as in the tokenizers library. Rows are kept
apart even if doc_id repeats or is null; their other columns pass through, but for those called
like an output. A very long text is a block of its own and encoded whole. An empty table gives
an empty one.
"""

from __future__ import annotations

import hashlib
import json
import os
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks
from .common import table

#: Fixed value: the split of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts with characters from here on are split by the tokenizer's own splitter: what is a letter
#: there may depend on the Unicode version.
_SETTLED = "ɐ"
#: Distinct words of a bucket that a task holds with their ids; beyond, it starts anew (and encodes some again).
KNOWN = 500_000
OUTPUTS = ("n_tokens", "ids", "ids_sha256", "decoded_sha256", "decoded")


def default_file() -> str:
    """The public byte-level vocabulary of 50,257 ids."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@cache
def _tokenizer(file: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(file)
    t.no_truncation()
    t.no_padding()
    return t


@cache
def _splitters(file: str):
    special = [x["content"] for x in json.loads(_tokenizer(file).to_str())["added_tokens"]]
    return regex.compile(PATTERN), regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None, frozenset(special)


def _ordinary(text: str, file: str) -> list[str]:
    if text.isascii() or max(text) < _SETTLED:
        return _splitters(file)[0].findall(text)
    return [text[s:e] for _, (s, e) in _tokenizer(file).pre_tokenizer.pre_tokenize_str(text)]


def split_words(text: str, file: str) -> list[bytes]:
    """The tokenizer's words of a text, in order; joined they are the text."""
    special = _splitters(file)[1]
    if special is None or not special.search(text):
        return [w.encode() for w in _ordinary(text, file)] if text else []
    out, at = [], 0
    for m in special.finditer(text):
        out += _ordinary(text[at : m.start()], file) if m.start() > at else []
        out.append(m[0])
        at = m.end()
    return [w.encode() for w in out + (_ordinary(text[at:], file) if at < len(text) else [])]


def _byte_of_char() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def pieces(file: str) -> list[bytes]:
    """The id-to-piece table: the bytes of each id."""
    t, of = _tokenizer(file), _byte_of_char()
    added = {x["id"]: x["content"].encode() for x in json.loads(t.to_str())["added_tokens"]}
    vocabulary = t.get_vocab(with_added_tokens=True)
    out = [b""] * (max(vocabulary.values(), default=-1) + 1)
    for piece, i in vocabulary.items():
        out[i] = added[i] if i in added else bytes(of[c] for c in piece)
    return out


def _encoding(file: str):
    """What answers the asks of a bucket: each distinct word is encoded once (KNOWN words are held at once)."""

    def fresh():
        ids_of: dict[bytes, bytes] = {}

        def answer(blob: bytes) -> bytes:
            words = blocks.unpack_words(*blocks.unpack(blob, None, None, None)[:2])
            if len(ids_of) > KNOWN:
                ids_of.clear()
            new = [w for w in words if w not in ids_of]
            for k in range(0, len(new), 4096):
                part = new[k : k + 4096]
                encoded = _tokenizer(file).encode_batch_fast([w.decode() for w in part], add_special_tokens=False)
                ids_of.update(zip(part, (np.array(e.ids, dtype="<u4").tobytes() for e in encoded), strict=True))
            found = [ids_of[w] for w in words]
            return blocks.pack(blocks.planes(np.fromiter(map(len, found), np.uint32, len(found)) // 4), blocks.planes(np.frombuffer(b"".join(found), "<u4")))

        return answer

    return fresh


def tokenized(docs: DataFrame, file: str | None = None, outputs: tuple[str, ...] = ("n_tokens", "ids"), text: str = "text", buckets: int | None = None) -> DataFrame:
    """docs without its text, with the outputs named: n_tokens, ids, ids_sha256, decoded_sha256, decoded."""
    file = file or default_file()
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in OUTPUTS])
    kinds = {"n_tokens": T.LongType(), "ids": T.ArrayType(T.IntegerType()), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType(), "decoded": T.StringType()}
    schema = T.StructType([f for f in docs.schema.fields if f.name != text] + [T.StructField(o, kinds[o]) for o in outputs])
    staged = blocks.staged(docs, lambda texts: (split_words(x.as_py() or "", file) for x in texts), "veritab_bpe", text, buckets=buckets)
    answers = blocks.streamed(blocks.asked(staged), _encoding(file))
    piece_table = docs.sparkSession.sparkContext.broadcast(pieces(file))  # a row for each id of the vocabulary file

    def finish(rows: pa.Table, count: np.ndarray, code: np.ndarray, got) -> pa.Table:
        n = int(code.max()) + 1 if len(code) else 0
        ids_of, text_of, many = [b""] * n, [b""] * n, np.zeros(n, np.int64)
        piece = piece_table.value
        for _, place, lengths, ids in got:
            lengths, ids = blocks.from_planes(lengths), blocks.from_planes(ids)
            many[place] = lengths
            listed = [piece[i] for i in ids.tolist()]
            raw, ends = ids.tobytes(), np.cumsum(lengths).tolist()
            for k, s, e in zip(range(place.start, place.stop), [0, *ends[:-1]], ends, strict=True):
                ids_of[k] = raw[4 * s : 4 * e]
                text_of[k] = listed[s] if e - s == 1 else b"".join(listed[s:e])
        made, at = {o: [] for o in outputs}, 0
        for size in count.tolist():
            own = code[at : at + size].tolist()
            at += size
            if "ids" in made or "ids_sha256" in made:
                raw = b"".join([ids_of[k] for k in own])
                if "ids" in made:
                    made["ids"].append(raw)
                if "ids_sha256" in made:
                    made["ids_sha256"].append(hashlib.sha256(raw).hexdigest())
            if "decoded" in made or "decoded_sha256" in made:
                decoded = b"".join([text_of[k] for k in own]).decode("utf-8", "replace")
                if "decoded_sha256" in made:
                    made["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
                if "decoded" in made:
                    made["decoded"].append(decoded)
        total = np.concatenate([[0], np.cumsum(many[code])])
        bounds = total[np.concatenate([[0], np.cumsum(count)])]
        for o in outputs:
            if o == "n_tokens":
                column = pa.array(np.diff(bounds), pa.int64())
            elif o == "ids":
                column = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.frombuffer(b"".join(made.pop("ids")), "<i4")))
            else:
                column = pa.array(made[o], pa.string())
            rows = rows.append_column(o, column)
        return rows

    return blocks.answered(staged, answers, finish, (None, None), schema)


def op4_bpe(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokenized(docs, outputs=("n_tokens", "ids_sha256", "decoded_sha256"))
