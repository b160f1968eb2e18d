"""Substring dedup: repeated windows of words are removed, found with a count-min prefilter.

A window is ``window`` consecutive words of one document. A window repeats when its word sequence also
starts at another place, in the same document or another; every word that a repeated window covers is
removed, judged on the input.

1. Each window has an anchor: among the hashes of its ``gram``-word subsequences the smallest, at its
   leftmost place. Equal windows have equal anchors at different places of the corpus, so the number of
   places at which an anchor was chosen is never below the number of places at which a window starts.
   Neighbouring windows mostly share their anchor; there are about 2 / (window - gram + 2) places a word.
2. Each task makes a count-min sketch of the anchors it meets. The sketch is cut into blocks by the
   anchor's hash, each with ``ROWS`` rows of ``WIDTH`` four-bit counters, and sized by the corpus, so that
   the merged sketch overestimates few anchors. Blocks are merged by adding, saturating at ``TOP``.
3. Anchors meet their block of the sketch: each block travels once to each of its PARTS, ahead of the anchors
   dealt there, which come packed. Those that are estimated to be chosen twice or more go back to their documents.
4. A second pass takes the windows of these anchors and groups just these exactly, by the anchor and 64 bits
   of their words. None that repeats is lost, as estimates are never low. A task first counts its own: a window that it meets twice is settled there, and one of each
   leaves the task, so that a passage which many documents share is at most one for each task. The windows
   of one anchor travel as one row to the anchor's partition; those of an anchor estimated at ``TOP``, as
   every task sees alike, are dealt over ``SALTS`` partitions by their own hash.
5. Each document's repeated windows, as runs, are joined to its text and the words they cover are removed.

Nothing is broadcast or collected but the size of the corpus.

Defined results: null and empty texts have no words; texts of any length are taken whole; ids may be null or
repeat: equal rows repeat each other; an empty table gives an empty one; columns besides id and text are free
and not given back.
"""

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_values, durable, enter, mix64, row_key, scratch, sha

WINDOW, GRAM = 35, 8
#: Of one block of the sketch: rows, counters in a row (a power of two), and bytes.
ROWS, WIDTH = 4, 1 << 14
BLOCK = ROWS * WIDTH // 2
TOP, SALTS = 15, 64
#: Partitions over which a block's anchors are dealt.
PARTS = 4
#: Counters for each anchor that is expected.
COUNTERS = 8
#: Bytes of text handled at once, and windows kept before they leave a task.
CHUNK, HELD = 1 << 20, 1_000_000

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64))
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n - 1, 0), base, np.uint64)]))[:n]


_UP, _DOWN = _powers(_BASE, CHUNK), _powers(_INVERSE, CHUNK)


class Words:
    """The words of some texts: where each begins and ends in ``data``, and a 64-bit hash."""

    def __init__(self, texts: list[bytes]):
        self.data = b" ".join(texts)
        n = len(self.data)
        raw = np.frombuffer(self.data, np.uint8)
        visible = np.concatenate([[False], ~_IS_SPACE[raw], [False]])
        edge = np.flatnonzero(visible[1:] != visible[:-1])
        self.begin, self.end = edge[::2], edge[1::2]
        up, down = (_UP, _DOWN) if n <= CHUNK else (_powers(_BASE, n), _powers(_INVERSE, n))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[raw] * up[:n], out=sums[1:])
        self.hash = mix64((sums[self.end] - sums[self.begin]) * down[self.begin] if len(self.begin) else np.zeros(0, np.uint64))
        bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
        #: words[first[i]:first[i + 1]] are those of text i
        self.first = np.searchsorted(self.begin, bounds)


def _sliding_least(x: np.ndarray, k: int) -> np.ndarray:
    """The least of each k neighbours."""
    width, out = 1, x
    while 2 * width <= k:
        out = np.minimum(out[: len(out) - width], out[width:])
        width *= 2
    return np.minimum(out[: len(x) - k + 1], out[k - width : k - width + len(x) - k + 1]) if width < k else out


def anchors(words: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows, the place of each one's anchor, and the hashes of subsequences by place."""
    h, none = words.hash, np.zeros(0, np.int64)
    if len(h) < window:
        return none, none, h
    g, q = h[: len(h) - gram + 1].copy(), np.uint64(0xD6E8FEB86659FD93)
    for i in range(1, gram):
        g *= q
        g += h[i : len(h) - gram + 1 + i]
    g = mix64(g)
    starts = np.arange(len(h) - window + 1)
    last = np.repeat(words.first[1:], np.diff(words.first))[: len(starts)]
    starts = starts[starts + window <= last]
    bits = max(1, len(g).bit_length())
    key = (g >> np.uint64(bits) << np.uint64(bits)) | np.arange(len(g), dtype=np.uint64)
    least = _sliding_least(key, window - gram + 1)
    return starts, (least[starts] & np.uint64((1 << bits) - 1)).astype(np.int64), g


def _cells(hashes: np.ndarray) -> np.ndarray:
    """[anchor, row] -> counter within the anchor's block."""
    out = np.empty((len(hashes), ROWS), np.int64)
    for r in range(ROWS):
        out[:, r] = r * WIDTH + ((hashes >> np.uint64(14 * r % 56)) & np.uint64(WIDTH - 1)).astype(np.int64)
    return out


def _block_of(hashes: np.ndarray, blocks: int) -> np.ndarray:
    return (mix64(hashes) % np.uint64(blocks)).astype(np.int64)


def _packed(counters: np.ndarray) -> bytes:
    c = counters.astype(np.uint8).reshape(-1, 2)
    return (c[:, 0] | c[:, 1] << 4).tobytes()


def estimates(table: np.ndarray, slot: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Estimated counts, up to TOP; table: blocks of packed counters one after another, slot: each anchor's block."""
    cell = _cells(hashes) + (slot * (ROWS * WIDTH))[:, None]
    return ((table[cell >> 1] >> ((cell & 1) * 4).astype(np.uint8)) & 15).min(axis=1, initial=TOP)


def pieces(texts: list[bytes]):
    """Slices of texts of about CHUNK bytes, or one text."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) + 1 <= CHUNK):
            size += len(texts[end]) + 1
            end += 1
        yield at, end
        at = end


def _sketches(src: DataFrame, blocks: int, window: int, gram: int) -> DataFrame:
    """block, cells: each task's sketch, as the touched counters of each block (as often as it counted, TOP times at most)."""

    def run(batches):
        enter("substring_dedup")
        held, n = [], 0

        def flush():
            h = np.concatenate(held)
            block = _block_of(h, blocks)
            flat = np.sort((_cells(h) + (block * (ROWS * WIDTH))[:, None]).ravel())
            keep = np.ones(len(flat), bool)
            keep[TOP:] = flat[TOP:] != flat[:-TOP]
            flat = flat[keep]
            own = flat // (ROWS * WIDTH)
            cut = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            data = (flat % (ROWS * WIDTH)).astype(np.uint16)
            parts = [data[a:b].tobytes() for a, b in itertools.pairwise([*cut.tolist(), len(flat)])]
            return pa.RecordBatch.from_arrays([pa.array(own[cut], pa.int64()), pa.array(parts, pa.binary())], ["block", "cells"])

        for b in batches:
            texts = byte_values(b.column("text"))
            for i, j in pieces(texts):
                w = Words(texts[i:j])
                _, place, g = anchors(w, window, gram)
                if len(place):
                    held.append(g[np.unique(place)])
                    n += len(held[-1])
            if n > HELD:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()

    return src.mapInArrow(run, "block long, cells binary")


def _merged(parts: DataFrame) -> DataFrame:
    """block, data: packed counters."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("substring_dedup")
        total = np.zeros(ROWS * WIDTH, np.uint8)
        block = None
        for b in batches:
            block = b.column("block")[0].as_py()
            for x in b.column("cells").to_pylist():
                c = np.bincount(np.frombuffer(x, np.uint16), minlength=ROWS * WIDTH)
                total = np.minimum(total + np.minimum(c, TOP), TOP).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([_packed(total)], pa.binary())], ["block", "data"])

    return parts.groupBy("block").applyInArrow(add, "block long, data binary")


def _lists(values: np.ndarray, cut: np.ndarray) -> pa.ListArray:
    """values as lists that begin at cut."""
    return pa.ListArray.from_arrays(pa.array(np.append(cut, len(values)).astype(np.int32)), pa.array(values))


def _cuts(*columns: np.ndarray) -> np.ndarray:
    """Where any of the sorted columns changes."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(columns[0]), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _runs(row: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, pa.ListArray, pa.ListArray]:
    """row, begins, ends: windows that start next to each other as one run."""
    order = np.lexsort((start, row))
    row, start = row[order], start[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (start[1:] > start[:-1] + 1)
    begin, end = np.flatnonzero(new), np.flatnonzero(np.append(new[1:], True)) if len(row) else np.zeros(0, np.int64)
    cut = _cuts(row[begin])
    return row[begin][cut], _lists(start[begin].astype(np.int32), cut), _lists(start[end].astype(np.int32), cut)


def _candidates(src: DataFrame, window: int, gram: int) -> DataFrame:
    """Windows that may repeat. Rows with part: one anchor's windows of one row of src, one of each in a task, as
    starts (below zero, -1 - start, if settled already) and digests. Rows without: runs of settled windows.

    src: row, text, places: those of anchors estimated to repeat, doubled, plus 1 if at TOP.
    """

    def run(batches):
        enter("substring_dedup")
        held, n = [], 0

        def flush():
            row, start, place, anchor, hot, digest = (np.concatenate(x) for x in zip(*held, strict=True))
            part = mix64(anchor + np.where(hot, digest % np.uint64(SALTS) + np.uint64(1), np.uint64(0))).view(np.int64)
            order = np.lexsort((digest, part))
            row, start, place, part, digest = row[order], start[order], place[order], part[order], digest[order]
            new = np.zeros(len(row), bool)
            new[_cuts(part, digest.view(np.int64))] = True
            twice = ~new | np.append(~new[1:], False)
            r, begins, ends = _runs(row[twice], start[twice])
            none = pa.nulls(len(r), pa.int64())
            yield pa.RecordBatch.from_arrays([none, pa.array(r), pa.nulls(len(r), pa.list_(pa.int32())), pa.nulls(len(r), pa.list_(pa.int64())), begins, ends], names)
            sign = np.where(twice, -1 - start, start)[new]
            row, place, part, digest = row[new], place[new], part[new], digest[new]
            order = np.lexsort((place, row, part))
            row, place, part, digest, sign = row[order], place[order], part[order], digest[order], sign[order]
            cut = _cuts(part, row, place)
            none = pa.nulls(len(cut), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(part[cut]), pa.array(row[cut]), _lists(sign.astype(np.int32), cut), _lists(digest.view(np.int64), cut), none, none], names)

        names = ["part", "row", "starts", "digests", "begins", "ends"]
        for b in batches:
            texts, ids = byte_values(b.column("text")), np.array(b.column("row").to_pylist(), np.int64)
            listed = b.column("places").to_pylist()
            for i, j in pieces(texts):
                w = Words(texts[i:j])
                at, place, g = anchors(w, window, gram)
                if not len(at):
                    continue
                both = np.concatenate([np.array(p or [], np.int64) + 2 * w.first[k] for k, p in enumerate(listed[i:j])])
                hit, top = both >> 1, both[both & 1 == 1] >> 1
                take = np.isin(place, hit)
                at, place = at[take], place[take]
                if not len(at):
                    continue
                text = np.searchsorted(w.first, at, "right") - 1
                joined = b" ".join([w.data[x:y] for x, y in zip(w.begin.tolist(), w.end.tolist(), strict=True)])
                offset = np.cumsum(np.concatenate([[0], w.end - w.begin + 1]))
                a, z = offset[at].tolist(), (offset[at + window] - 1).tolist()
                digest = np.array([xxhash.xxh3_64_intdigest(joined[x:y]) for x, y in zip(a, z, strict=True)], np.uint64)
                held.append((ids[i + text], at - w.first[text], place - w.first[text], g[place], np.isin(place, top), digest))
                n += len(at)
                if n > HELD:
                    yield from flush()
                    held, n = [], 0
        if n:
            yield from flush()

    return src.mapInArrow(run, "part long, row long, starts array<int>, digests array<long>, begins array<int>, ends array<int>")


def _meeting(found: DataFrame) -> DataFrame:
    """row, begins, ends: the windows, not settled in their task, that two tasks sent."""

    def run(batches):
        enter("substring_dedup")
        held: list[tuple] = []

        def settle(parts):
            part, row, start, digest = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((digest, part))
            part, row, start, digest = part[order], row[order], start[order], digest[order]
            new = np.zeros(len(part), bool)
            new[_cuts(part, digest)] = True
            take = (~new | np.append(~new[1:], False)) & (start >= 0)
            r, begins, ends = _runs(row[take], start[take])
            return pa.RecordBatch.from_arrays([pa.array(r), begins, ends], ["row", "begins", "ends"])

        for b in batches:
            if not len(b):
                continue
            starts = b.column("starts")
            n = np.diff(starts.offsets.to_numpy())
            part = np.repeat(b.column("part").to_numpy(zero_copy_only=False), n)
            row = np.repeat(b.column("row").to_numpy(zero_copy_only=False), n)
            cols = (part, row, starts.flatten().to_numpy(zero_copy_only=False).astype(np.int64), b.column("digests").flatten().to_numpy(zero_copy_only=False))
            edge = int(np.searchsorted(part, part[-1]))  # the last part may go on
            if edge or held and held[-1][0][-1] != part[0]:
                yield settle([*held, tuple(c[:edge] for c in cols)])
                held = []
            held.append(tuple(c[edge:] for c in cols))
        if held:
            yield settle(held)

    rows = found.where("part is not null").select("part", "row", "starts", "digests")
    dealt = rows.repartition(F.col("part")).sortWithinPartitions("part")
    return dealt.mapInArrow(run, "row long, begins array<int>, ends array<int>")


def _sightings(src: DataFrame, window: int, gram: int, blocks: int) -> DataFrame:
    """block, part, and packed row, place, hash of the anchors that a task met there."""

    def run(batches):
        enter("substring_dedup")
        held, n, turn = [], 0, TaskContext.get().partitionId()

        def flush():
            row, place, h = (np.concatenate(x) for x in zip(*held, strict=True))
            block = _block_of(h, blocks)
            order = np.argsort(block, kind="stable")
            row, place, h, block = row[order], place[order], h[order], block[order]
            cut = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
            packs = [[x[a:b].tobytes() for a, b in itertools.pairwise([*cut.tolist(), len(x)])] for x in (row, place.astype(np.int32), h)]
            return pa.RecordBatch.from_arrays([pa.array(block[cut]), pa.array(np.full(len(cut), turn % PARTS, np.int32)), *[pa.array(x, pa.binary()) for x in packs]], ["block", "part", "row", "place", "hash"])

        for b in batches:
            texts, ids = byte_values(b.column("text")), np.array(b.column("row").to_pylist(), np.int64)
            for i, j in pieces(texts):
                w = Words(texts[i:j])
                _, place, g = anchors(w, window, gram)
                place = np.unique(place)
                if len(place):
                    text = np.searchsorted(w.first, place, "right") - 1
                    held.append((ids[i + text], place - w.first[text], g[place]))
                    n += len(place)
            if n > HELD:
                yield flush()
                held, n, turn = [], 0, turn + 1
        if n:
            yield flush()

    return src.mapInArrow(run, "block long, part int, row binary, place binary, hash binary")


def _repeated(src: DataFrame, sketch: DataFrame, window: int, gram: int, blocks: int) -> DataFrame:
    """row, text, places of the documents with anchors estimated to repeat, as ``_candidates`` takes them."""

    def look(batches):
        enter("substring_dedup")
        table = None
        for b in batches:
            rows, places = [], []
            for data, row, place, h in zip(*(b.column(c).to_pylist() for c in ("data", "row", "place", "hash")), strict=True):
                if data is not None:
                    table = np.frombuffer(data, np.uint8)
                    continue
                h = np.frombuffer(h, np.uint64)
                count = estimates(table, np.zeros(len(h), np.int64), h)
                keep = count >= 2
                rows.append(np.frombuffer(row, np.int64)[keep])
                places.append((2 * np.frombuffer(place, np.int32) + (count == TOP))[keep])
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rows)), pa.array(np.concatenate(places).astype(np.int32))], ["row", "place"])

    first = sketch.select("block", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"), "data", *[F.lit(None).cast("binary").alias(c) for c in ("row", "place", "hash")])
    then = _sightings(src, window, gram, blocks).select("block", "part", F.lit(None).cast("binary").alias("data"), "row", "place", "hash")
    dealt = first.unionByName(then).repartition("block", "part").sortWithinPartitions("block", "part", F.col("data").isNull())
    hit = dealt.mapInArrow(look, "row long, place int")
    return src.join(hit.groupBy("row").agg(F.collect_set("place").alias("places")), "row")


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """row (see common.row_key), begins, ends array<int>: runs of the starts of each document's repeated windows."""
    src = docs.select(row_key(id_col, text_col).alias("row"), F.col(text_col).alias("text")).where("text is not null")
    size = src.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    expected = size / 6 * 2 / (window - gram + 2)  # six bytes a word
    blocks = max(1, int(expected * COUNTERS / (ROWS * WIDTH)))
    with scratch(docs.sparkSession) as keep:
        sketch = durable(_merged(_sketches(src, blocks, window, gram)), "sketch")
        found = durable(_candidates(_repeated(src, sketch, window, gram, blocks), window, gram), "windows")
        settled = found.where("part is null").select("row", "begins", "ends")
        runs = settled.unionByName(_meeting(found)).groupBy("row").agg(F.flatten(F.collect_list("begins")).alias("begins"), F.flatten(F.collect_list("ends")).alias("ends"))
        return keep(durable(runs, "runs"))


def covered(n: int, begins: list[int], ends: list[int], window: int) -> np.ndarray:
    """Which of n words the windows of the runs cover."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, np.array(begins, np.int64), 1)
    np.add.at(change, np.array(ends, np.int64) + window, -1)
    return np.cumsum(change[:n]) > 0


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, and the kept words joined by one space as text, or with digest as kept_sha256."""
    windows = repeated_windows(docs, id_col, text_col, window, gram)
    src = docs.select(row_key(id_col, text_col).alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = src.join(windows, "row", "left").select("doc_id", "text", "begins", "ends")

    def run(batches):
        enter("substring_dedup")
        for b in batches:
            n, gone, out = [], [], []
            for data, begins, ends in zip(byte_values(b.column("text")), b.column("begins").to_pylist(), b.column("ends").to_pylist(), strict=True):
                words = data.split()
                n.append(len(words))
                if begins:
                    hit = covered(len(words), begins, ends, window)
                    words = [w for w, h in zip(words, hit.tolist(), strict=True) if not h]
                gone.append(n[-1] - len(words))
                kept = b" ".join(words)
                out.append(sha(kept) if digest else kept.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept_sha256" if digest else "text": pa.array(out, pa.string())})

    return rows.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, {'kept_sha256' if digest else 'text'} string")
