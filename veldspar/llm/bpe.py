"""Byte-level BPE with the tokenizers library over Arrow batches.

The library's model is built from a rank file: bytes are mapped to printable characters, and every
pair of ranked pieces whose concatenation is ranked becomes a merge, ordered by the rank of the
result. Texts are cut at single spaces between two visible characters, where a match of the pattern
always begins, so each unit encodes on its own; a bounded table keeps units already encoded, and only
new ones are split by the pattern and go through the library. Memory stays bounded on long texts.

Decoding reverses the byte table. A character split over several tokens decodes whole, as bytes are
joined before UTF-8 is read; ids that stop inside a character give a replacement character there.

Defined results: null and empty texts give no ids; texts of any length are encoded whole; ids may be null or
repeat, and repeated rows each give a row; merges are by rank, and no two have one, so there are no ties; an empty
table gives an empty one; columns besides id and text are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import os
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cache, enter, sha

#: Units kept in a worker's table, and characters given to the library at once.
UNITS, CHUNK = 250_000, 200_000
#: A single space between two visible characters; a match of the pattern begins at it.
CUT = re.compile(r" (?<=\S )(?=\S)")
#: Present where a space is not of that kind.
ODD = re.compile(r" (?:(?<!\S )|(?!\S))")
#: Parts what the library gets into the pattern's matches; the byte table has no such character.
SEP = "\n"


def byte_table() -> list[str]:
    """A printable character for each byte: itself where printable, else the next from U+0100."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    """Encoder and decoder of one rank file and pattern."""

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, models, pre_tokenizers

        ranks, table = read_ranks(path), byte_table()
        shown = lambda piece: "".join(table[b] for b in piece)
        merges = []
        for piece, rank in sorted(ranks.items(), key=lambda kv: kv[1]):
            cuts = [(max(ranks[piece[:i]], ranks[piece[i:]]), i) for i in range(1, len(piece)) if piece[:i] in ranks and piece[i:] in ranks]
            merges += [(shown(piece[:i]), shown(piece[i:])) for most, i in sorted(cuts) if most < rank]
        vocab = {shown(piece): rank for piece, rank in ranks.items()}
        self.tokenizer = Tokenizer(models.BPE(vocab, merges, ignore_merges=True))
        self.tokenizer.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(SEP)
        self.shown = dict(enumerate(table))
        # as the library of the rank file reads the pattern, white space is Unicode's property
        self.matches = regex.compile(pattern.replace("\\s", "\\p{White_Space}").replace("\\S", "\\P{White_Space}")).findall
        back = {c: b for b, c in enumerate(table)}
        size = max(ranks.values()) + 1
        self.pieces: list[bytes | None] = [None] * size
        for text, rank in vocab.items():
            self.pieces[rank] = bytes(back[c] for c in text)
        self.lengths = np.array([len(p or b"") for p in self.pieces], np.int64)
        self.names = [str(i) for i in range(size)]
        self.units: dict[str, bytes] = {}

    @staticmethod
    def cut(text: str) -> tuple[str, list[str]]:
        """The first unit, and what follows the single space that each further unit begins with."""
        first, *rest = text.split(" ") if ODD.search(text) is None else CUT.split(text)
        return first, rest

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        first, rest = self.cut(text)
        try:
            tail = b"".join(map(self.units.__getitem__, rest))
        except KeyError:
            wanted, known = {*rest}, self.units
            self.learn({u for u in wanted if u not in known}, wanted)
            tail = b"".join(map(self.units.__getitem__, rest))
        return np.frombuffer(self.library(first).tobytes() + tail, np.uint32)

    def library(self, text: str) -> np.ndarray:
        """The library's ids for the matches of the pattern in text."""
        if not text:
            return np.zeros(0, np.uint32)
        shown = [m.encode("utf-8", "replace").decode("latin-1").translate(self.shown) for m in self.matches(text)]
        return np.array(self.tokenizer.encode_batch_fast([SEP.join(shown)], add_special_tokens=False)[0].ids, np.uint32)

    def learn(self, new: set[str], wanted: set[str]) -> None:
        """Encode units and keep them. As each cut is one of the pattern's, many are encoded as one text."""
        if len(self.units) + len(new) > UNITS:
            self.units.clear()
            new = wanted
        batch, chars = [], 0
        for u in sorted(new):
            if u and not (u[0].isspace() or u[-1].isspace()):
                batch.append(u)
                chars += len(u)
                if chars >= CHUNK:
                    self._learn(batch)
                    batch, chars = [], 0
            else:
                self._learn([u])
        if batch:
            self._learn(batch)

    def _learn(self, units: list[str]) -> None:
        ids = self.library(" " + " ".join(units))
        ends = np.cumsum(self.lengths[ids])
        cuts = np.searchsorted(ends, np.cumsum([1 + len(u.encode("utf-8", "replace")) for u in units]), "left") + 1
        data, at = ids.tobytes(), 0
        for u, end in zip(units, (4 * cuts).tolist(), strict=True):
            self.units[u] = data[at:end]
            at = end

    def offsets(self, text: str) -> list[tuple[int, int]]:
        """Code point spans of the tokens; those that share a character share its span."""
        ids = self.encode(text)
        ends = np.cumsum(self.lengths[ids])
        of_byte = np.repeat(np.arange(len(text)), [len(c.encode("utf-8", "replace")) for c in text])
        return [(int(of_byte[a]), int(of_byte[b - 1]) + 1) for a, b in zip(ends - self.lengths[ids], ends, strict=True)]

    def decode_bytes(self, ids) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))

    def decode(self, ids) -> str:
        return self.decode_bytes(ids).decode("utf-8", errors="replace")


_CODECS: dict[tuple[str, str], Codec] = cache("bpe")


def codec(path: str, pattern: str) -> Codec:
    """One codec for a worker process and vocabulary."""
    if (key := (path, pattern)) not in _CODECS:
        _CODECS[key] = Codec(path, pattern)
    return _CODECS[key]


def _where(path: str | None, pattern: str | None) -> tuple[str, str]:
    import public_tokenizers

    return path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_offsets: bool = False) -> DataFrame:
    """doc_id, ids array<int>, and with_offsets also starts, ends array<int>. path: a rank file on every executor."""
    path, pattern = _where(path, pattern)

    def run(batches):
        enter("bpe")
        c = codec(path, pattern)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            cols = {"doc_id": b.column(0), "ids": pa.array([c.encode(t) for t in texts], pa.list_(pa.int32()))}
            if with_offsets:
                spans = [c.offsets(t) for t in texts]
                cols |= {n: pa.array([[s[i] for s in x] for x in spans], pa.list_(pa.int32())) for i, n in enumerate(("starts", "ends"))}
            yield pa.RecordBatch.from_pydict(cols)

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    more = ", starts array<int>, ends array<int>" if with_offsets else ""
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, ids array<int>{more}")


def decode(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, text string of a DataFrame with doc_id, ids; null ids give null."""
    path, pattern = _where(path, pattern)

    def run(batches):
        enter("bpe")
        c = codec(path, pattern)
        for b in batches:
            texts = [None if ids is None else c.decode(ids) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None, with_ids: bool = False) -> DataFrame:
    """Encode and decode in one pass: doc_id, with_ids also ids, n_tokens, ids_sha256, decoded_sha256."""
    path, pattern = _where(path, pattern)

    def run(batches):
        enter("bpe")
        c = codec(path, pattern)
        for b in batches:
            lists, n, one, two = [], [], [], []
            for t in b.column(1).to_pylist():
                own = c.encode(t or "")
                ids = own.tolist()
                n.append(len(ids))
                one.append(sha(",".join(map(c.names.__getitem__, ids)).encode()))
                two.append(sha(c.decode_bytes(ids)))
                lists.append(own.astype(np.int32) if with_ids else None)
            cols = {"doc_id": b.column(0)} | ({"ids": pa.array(lists, pa.list_(pa.int32()))} if with_ids else {})
            yield pa.RecordBatch.from_pydict(cols | {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": one, "decoded_sha256": two})

    src = docs.select("doc_id", "text")
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, {'ids array<int>, ' * with_ids}n_tokens long, ids_sha256 string, decoded_sha256 string")
