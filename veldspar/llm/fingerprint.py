"""Document fingerprints by locally consistent parsing.

A level turns a sequence of names into a shorter one. Runs of one name become one name of their
length. Deterministic coin tossing then labels each name by the lowest bit in which it differs from
its left neighbour and the value of that bit; repeated, this leaves labels 0 to 5 of which neighbours
always differ, so local maxima stand at most a few places apart. Phrases begin at local maxima, and a
phrase's name is a hash of its names. A cut depends only on a few names around it: equal substrings
are parsed alike but for their ends, wherever they stand.

Level 0 is the code points. The fingerprint is the ``keep`` smallest phrase names of levels
``first_level`` to ``LEVELS``, 32 bits each, as hexadecimal text; a name that occurs again counts anew,
numbered. The likeness of two fingerprints estimates the Jaccard likeness of the two bags of names
from their ``keep`` smallest.

Defined results: null text is empty; an empty text has an empty fingerprint; two empty fingerprints
are alike (1.0), an empty and another not (0.0); equal texts have equal fingerprints; texts of any length are
read whole; an empty table gives an empty one; columns besides id and text are ignored. For ``neighbours`` ids are
whole numbers or cast to them (others raise): null ids come first, equal ids are ordered by a hash of the text.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import enter, mix64, sha

LEVELS, FIRST_LEVEL, KEEP = 6, 2, 64
CHUNK = 250_000
LONGEST = 64  # more than any phrase has names
_POWERS = np.cumprod(np.full(LONGEST, 0x9E3779B97F4A7C15, np.uint64))


def toss(label: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One round: 2 * (lowest bit that differs from the left neighbour) + that bit of its own."""
    low = label.copy()
    low[1:] ^= label[:-1]
    low[first] = 1  # a first name has no left neighbour; it gets the label of its lowest bit
    low &= ~low + label.dtype.type(1)
    bit = np.bitwise_count(low - label.dtype.type(1))
    bit += bit
    bit += (label & low) != 0
    return bit


def parse_level(names: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level for several sequences: names one after another, starts the place where each begins.

    Every sequence has a name at least. Gives the same for the next level.
    """
    first = np.zeros(len(names), bool)
    first[starts] = True
    begin = first.copy()
    begin[1:] |= names[1:] != names[:-1]
    at = np.flatnonzero(begin)
    x = names[at].astype(np.uint64)
    first = first[at]
    if len(at) < len(names):
        run = np.diff(at, append=len(names))
        long = np.flatnonzero(run > 1)
        x[long] = mix64(x[long] + run[long].astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    starts = np.flatnonzero(first)
    label = x  # names of 64 bits, then labels below 128, 14, 8 and 6
    for _ in range(4):
        label = toss(label, starts)
    peak = first.copy()
    peak[1:-1] |= (label[1:-1] > label[:-2]) & (label[1:-1] >= label[2:])
    last = starts[1:] - 1
    peak[last] = first[last]  # what follows a last name is of another sequence
    second = starts + 1
    second = second[second < len(x)]
    peak[second] = first[second]  # the second name never parts from the first
    cut = np.flatnonzero(peak)
    inside = np.arange(len(x)) - np.repeat(cut, np.diff(cut, append=len(x)))
    value = mix64(x)
    value *= _POWERS[np.minimum(inside, LONGEST - 1)]
    return mix64(np.add.reduceat(value, cut)), np.flatnonzero(first[cut])


def numbered(names: np.ndarray) -> np.ndarray:
    """Distinct names: the second, third... time a name occurs it becomes another."""
    names.sort()
    again = names[1:] == names[:-1]
    if again.any():
        place = np.arange(len(names))
        begin = np.where(np.append(False, again), 0, place)
        nth = place - np.maximum.accumulate(begin)
        names = np.where(nth, mix64(names + nth.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)), names)
    return names


def sketches(texts: list[str], keep: int = KEEP, first_level: int = FIRST_LEVEL) -> list[np.ndarray]:
    """The sorted smallest phrase names of each text."""
    out = [np.zeros(0, np.uint32)] * len(texts)
    at = 0
    while at < len(texts):  # a few hundred thousand characters at once, or one text
        end, chars = at, 0
        while end < len(texts) and (end == at or chars + len(texts[end]) <= CHUNK):
            chars += len(texts[end])
            end += 1
        full = [i for i in range(at, end) if texts[i]]
        at = end
        if not full:
            continue
        names = np.frombuffer("".join(texts[i] for i in full).encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = np.cumsum([0] + [len(texts[i]) for i in full[:-1]])
        levels = []
        for level in range(1, LEVELS + 1):
            names, starts = parse_level(names, starts)
            if level >= first_level:
                levels.append((names, np.append(starts, len(names)).tolist()))
        for k, i in enumerate(full):
            own = numbered(np.concatenate([v[s[k] : s[k + 1]] for v, s in levels]))
            if len(own) > 2 * keep:
                own.partition(keep)
                own = own[:keep]
            own.sort()
            out[i] = np.unique((own[:keep] >> np.uint64(32)).astype(np.uint32))
    return out


def shown(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def read(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u4").astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray, keep: int = KEEP) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both, n = np.unique_counts(np.concatenate([a, b]))
    return float(np.count_nonzero(n[:keep] == 2) / min(keep, len(both)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: int = KEEP) -> DataFrame:
    """doc_id, fingerprint of each row."""

    def run(batches):
        enter("fingerprint")
        for b in batches:
            got = sketches([t or "" for t in b.column(1).to_pylist()], keep)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shown(x) for x in got], pa.string())], ["doc_id", "fingerprint"])

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, fingerprint string")


LOWEST = -(1 << 63)  # the place of null ids in the order


def range_cuts(found: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Cuts by id and, within an id that several of the found quantiles name, by even steps of a hash."""
    ids, times = np.unique(np.array(found, np.int64), return_counts=True)
    steps = [(-(1 << 63)) + (1 << 64) * (j + 1) // m - 1 for m in times.tolist() for j in range(m)]
    return np.repeat(ids, times), np.array(steps, np.int64)


def range_of(cuts: tuple[np.ndarray, np.ndarray], k: np.ndarray, h: np.ndarray) -> np.ndarray:
    """How many cuts stand before each (id, hash)."""
    ids, steps = cuts
    out = np.searchsorted(ids, k, "left")
    same = np.flatnonzero(np.searchsorted(ids, k, "right") > out)
    for a in np.unique(out[same]).tolist():
        own = same[out[same] == a]
        b = np.searchsorted(ids, ids[a], "right")
        out[own] = a + np.searchsorted(steps[a:b], h[own], "left")
    return out


def neighbours(docs: DataFrame, run, schema: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Give run(batches) all documents by ascending id (and hash of the text), each range of them with the document that follows it.

    The batches have range, tail, doc_id, text, by range, then tail, then id; a row with tail = 1 is the
    document after the range's last (after the very last range, the very first document) and belongs to
    another range. Texts are shuffled once: the ranges' bounds and first documents come from ids and hashes alone.
    An id that many documents share, or null, is cut into several ranges.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key, name = F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST)).alias("k"), F.xxhash64(F.col(text_col)).alias("h")
    ids = docs.select(key, name)
    cuts = range_cuts(ids.agg(F.percentile_approx("k", [i / n for i in range(1, n)] or [0.5], 10 * n)).first()[0] or [])

    @F.pandas_udf("int")
    def at(k: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(range_of(cuts, k.to_numpy(np.int64), h.to_numpy(np.int64)).astype(np.int32))

    firsts = {r: tuple(x) for r, x in ids.groupBy(at("k", "h").alias("r")).agg(F.min(F.struct("k", "h"))).collect()}  # n rows at most
    order = sorted(firsts)
    follows = {firsts[r]: order[i - 1] for i, r in enumerate(order)}

    @F.pandas_udf("array<struct<range:int,tail:int>>")
    def targets(k: pd.Series, h: pd.Series) -> pd.Series:
        ranges = range_of(cuts, k.to_numpy(np.int64), h.to_numpy(np.int64)).tolist()
        return pd.Series([[{"range": r, "tail": 0}] + ([{"range": follows[x], "tail": 1}] if x in follows else []) for x, r in zip(zip(k.tolist(), h.tolist(), strict=True), ranges, strict=True)])

    rows = docs.select(key, name, F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    dealt = rows.select(F.explode(targets("k", "h")).alias("t"), "*").select("t.range", "t.tail", "k", "h", "doc_id", "text")
    dealt = dealt.repartitionById(max(1, len(order) and order[-1] + 1), F.col("range"))
    return dealt.sortWithinPartitions("range", "tail", "k", "h").drop("k", "h").mapInArrow(run, schema)


def edited(text: str, after: str) -> str:
    """text with its last quarter of code points replaced by as many first ones of the next text."""
    n = len(text) // 4
    return text[: len(text) - n] + after[:n]


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: int = KEEP) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row."""

    def flush(rows: list[tuple], after: str):
        """rows: (doc_id, text, sketch). All but none are followed by the next of rows; the last by after."""
        texts = [t for _, t, _ in rows]
        nexts = texts[1:] + [after]
        changed = [edited(t, a) for t, a in zip(texts, nexts, strict=True)]
        own = sketches(texts + [after], keep)
        new = sketches(changed, keep)
        return {
            "doc_id": [i for i, _, _ in rows], "n_chars": [len(t) for t in texts],
            "edited_sha256": [sha(t.encode("utf-8", "surrogatepass")) for t in changed],
            "fingerprint": [shown(x) for x in own[:-1]], "edited_fingerprint": [shown(x) for x in new],
            "near_edited": [likeness(a, b, keep) for a, b in zip(own, new, strict=False)],
            "near_next": [likeness(a, b, keep) for a, b in zip(own, own[1:], strict=False)],
        }

    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {id_type}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches):
        enter("fingerprint")
        waiting, chars, at, done = [], 0, None, False
        types = None
        for b in batches:
            types = types or pa.schema([("doc_id", b.schema.field("doc_id").type), ("n_chars", pa.int64()), *((c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")), ("near_edited", pa.float64()), ("near_next", pa.float64())])
            for r, tail, i, t in zip(*(b.column(c).to_pylist() for c in ("range", "tail", "doc_id", "text")), strict=True):
                t = t or ""
                if r != at:
                    waiting, chars, at, done = [], 0, r, False
                if tail and done:  # of several documents with the least id the first follows
                    continue
                if waiting and (tail or chars > CHUNK):
                    yield pa.RecordBatch.from_pydict(flush(waiting, t), types)
                    waiting, chars = [], 0
                if tail:
                    done = True
                else:
                    waiting.append((i, t, None))
                    chars += len(t)

    return neighbours(docs, run, schema, id_col, text_col)
