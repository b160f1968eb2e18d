"""Benchmark decontamination by Wu-Manber search over words.

A text's words are its runs of digits, letters a-z (A-Z lowered) and code points from U+0080. The
patterns are the windows of ``window`` consecutive words of the benchmark items; an item of fewer
words, but not none, is one pattern. For each pattern length m the search keeps three tables:
a shift table by word pair (how far the search may advance when the pair ends at the current word),
buckets of the patterns by a hash of their last pair and all their words, and the patterns' text, with
which what a bucket selects is compared. With a pair that no pattern holds the search advances m - 1 words.

Words are numbers (hashes) and tables are arrays, some 8 bytes for each byte of the items. A task advances
many stretches of text at once, each by its own shifts, so a step is a few array operations.

The items are the broadcast side. Their bytes are counted first: up to ``block_bytes`` they make one
block, searched in one pass; a larger benchmark is dealt by hash over as many blocks as needed, each searched
in a pass of its own, and the passes are merged per document.

Defined results: null and empty texts have no words and are never contaminated; texts of any length are searched
whole; items with null text have no patterns; an item with a null id marks words but is not listed or counted;
repeated items count once; repeated document rows each give a row; without documents there are no rows, without
items no hits; columns of docs besides id and text are free, and ``clean`` gives all back under their names.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_values, cache, durable, enter, mix64, row_key, unused
from .substring_dedup import Words, pieces

#: Lower-cases A-Z and turns every byte that is in no word into a space.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes of benchmark text in a block; window ends that a stretch of a text holds.
BLOCK_BYTES, STRETCH = 16 << 20, 512
_LEFT, _STEP = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)


class Text:
    """Words of some texts as numbers, and their bytes with one space between words."""

    def __init__(self, texts: list[bytes]):
        w = Words([t.translate(WORDS) for t in texts])
        self.hash, self.first = w.hash, w.first
        size = w.end - w.begin + 1
        self.at = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
        raw = np.frombuffer(w.data + b" ", np.uint8)
        inside = raw != 32
        self.data = raw[inside | np.concatenate([[False], inside[:-1]])].tobytes()

    def words(self, start: int, m: int) -> bytes:
        return self.data[self.at[start] : self.at[start + m] - 1]

    def pairs(self, ends: np.ndarray) -> np.ndarray:
        """A hash of the word at each place and the one before it."""
        return mix64(self.hash[ends - 1] * _LEFT + self.hash[ends])

    def windows(self, starts: np.ndarray, m: int) -> np.ndarray:
        out = self.hash[starts].copy()
        for i in range(1, m):
            out = out * _STEP + self.hash[starts + i]
        return mix64(out)


class WuManber:
    """Tables for patterns of one length m >= 1: the m words of ``text`` from each of starts, which are of ``items``."""

    def __init__(self, m: int, text: Text, starts: np.ndarray, items: np.ndarray):
        self.m, self.text, self.far = m, text, max(1, m - 1)
        name = text.windows(starts, m)
        order = np.lexsort((items, name))
        name, starts, items = name[order], starts[order], items[order]
        new = np.concatenate([[True], (name[1:] != name[:-1]) | (items[1:] != items[:-1])]) if len(name) else np.zeros(0, bool)
        name, starts, items = name[new], starts[new], items[new]
        #: of pattern k: its hash, a place where it stands, and items[cut[k]:cut[k + 1]]
        self.names, cut = np.unique(name, return_index=True)
        self.starts, self.items, self.cut = starts[cut], items, np.append(cut, len(name))
        if m > 1:
            self.bits = np.uint64(64 - max(8, min(24, (16 * len(self.starts)).bit_length())))
            self.shift = np.full(1 << (64 - int(self.bits)), self.far, np.uint8 if self.far < 256 else np.int64)
            for j in range(1, m):  # the pair that ends at word j
                np.minimum.at(self.shift, self._cell(text.pairs(starts + j)), m - 1 - j)

    def _cell(self, pairs: np.ndarray) -> np.ndarray:
        return (pairs >> self.bits).astype(np.int64)

    def ends(self, text: Text, first: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Places where a pattern may end, of stretches of ends from first up to limit."""
        if self.m == 1:
            return np.concatenate([np.arange(a, b) for a, b in zip(first.tolist(), limit.tolist(), strict=True)]) if len(first) else first
        found, at = [], first
        while len(at):
            shift = self.shift[self._cell(text.pairs(at))].astype(np.int64)
            found.append(at[shift == 0])
            at = at + np.maximum(shift, 1)
            going = at < limit
            at, limit = at[going], limit[going]
        return np.concatenate(found) if found else first

    def search(self, text: Text) -> tuple[np.ndarray, np.ndarray]:
        """Starts of all occurrences, and which pattern it is."""
        m, lows, highs = self.m, text.first[:-1] + self.m - 1, text.first[1:]
        stretches = np.maximum(0, -(-(highs - lows) // STRETCH))
        which = np.repeat(np.arange(len(lows)), stretches)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(stretches) - stretches, stretches)
        first = lows[which] + nth * STRETCH
        starts = self.ends(text, first, np.minimum(first + STRETCH, highs[which])) - (m - 1)
        name = text.windows(starts, m)
        k = np.minimum(np.searchsorted(self.names, name), len(self.names) - 1)
        starts, k = starts[self.names[k] == name], k[self.names[k] == name]
        same = [text.words(a, m) == self.text.words(b, m) for a, b in zip(starts.tolist(), self.starts[k].tolist(), strict=True)]
        same = np.array(same, bool)
        return starts[same], k[same]


class Matcher:
    """One search for each pattern length of a set of items."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        self.ids = [i for i, _ in items]
        text = Text([t for _, t in items])
        size = np.diff(text.first)
        m = np.minimum(window, size)
        self.searches = []
        for length in np.unique(m[m > 0]).tolist():
            own = np.flatnonzero(m == length)
            count = size[own] - length + 1
            item = np.repeat(own, count)
            starts = np.repeat(text.first[own], count) + np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
            self.searches.append(WuManber(length, text, starts, item))

    def find(self, texts: list[bytes]) -> list[tuple[int, list[list[int]], set[str]]]:
        """Of each text: its words, the merged word spans (end exclusive) that occurrences cover, the items that occur."""
        text = Text(texts)
        bounds = text.first
        out = [(n, [], set()) for n in np.diff(bounds).tolist()]
        change, listed = np.zeros(len(text.hash) + 1, np.int64), []
        for s in self.searches:
            starts, k = s.search(text)
            if len(starts):
                np.add.at(change, starts, 1)
                np.add.at(change, starts + s.m, -1)
                of = np.searchsorted(bounds, starts, "right") - 1
                listed += [(d, s.items[s.cut[p] : s.cut[p + 1]]) for d, p in np.unique(np.stack([of, k], 1), axis=0).tolist()]
        for d, items in listed:
            out[d][2].update(self.ids[i] for i in items.tolist() if self.ids[i] is not None)
        if listed:
            covered = np.cumsum(change[:-1]) > 0
            for d in {d for d, _ in listed}:
                edge = np.flatnonzero(np.diff(np.concatenate([[False], covered[bounds[d] : bounds[d + 1]], [False]])))
                out[d][1].extend(edge.reshape(-1, 2).tolist())
        return out


def merged(spans: list) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


_MATCHERS: dict = cache("decontaminate")
_FIELDS = "n_words long, n_hit long, items array<string>, starts array<int>, ends array<int>"
_SERIAL = itertools.count()


def _columns(found: list[tuple[int, list, set]]) -> dict:
    return {
        "n_words": pa.array([n for n, _, _ in found], pa.int64()),
        "n_hit": pa.array([sum(b - a for a, b in s) for _, s, _ in found], pa.int64()),
        "items": pa.array([sorted(i) for _, _, i in found], pa.list_(pa.string())),
        "starts": pa.array([[a for a, _ in s] for _, s, _ in found], pa.list_(pa.int32())),
        "ends": pa.array([[b for _, b in s] for _, s, _ in found], pa.list_(pa.int32())),
    }


def _matched(spark, items: list[tuple[str | None, str]], window: int):
    """A function that a task calls with its batches' text column, for what ``Matcher.find`` says of each."""
    sc = spark.sparkContext
    sent, serial = sc.broadcast(items), (sc.applicationId, next(_SERIAL))

    def of(column) -> list[tuple[int, list, set]]:
        enter("decontaminate")
        if serial not in _MATCHERS:
            _MATCHERS.clear()
            _MATCHERS[serial] = Matcher([(i, t.encode()) for i, t in sent.value], window)
        texts = byte_values(column)
        return [x for i, j in pieces(texts) for x in _MATCHERS[serial].find(texts[i:j])]

    return of


def _pass(src: DataFrame, items: list[tuple[str | None, str]], window: int) -> DataFrame:
    """src: row, doc_id, text. One block of items searched in every document."""
    find = _matched(src.sparkSession, items, window)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"row": b.column("row"), "doc_id": b.column("doc_id")} | _columns(find(b.column("text"))))

    return src.mapInArrow(run, f"row long, doc_id {src.schema['doc_id'].dataType.simpleString()}, {_FIELDS}")


def _merge(passes: DataFrame, n: int) -> DataFrame:
    """n passes over the same documents to one row for each document row."""
    both = passes.groupBy("row", "doc_id").agg(
        (F.count(F.lit(1)) / n).cast("int").alias("copies"), F.max("n_words").alias("n_words"), F.flatten(F.collect_set("items")).alias("items"),
        F.flatten(F.collect_set(F.arrays_zip("starts", "ends"))).alias("spans"))

    def run(batches):
        enter("decontaminate")
        for b in batches:
            found = [(n, merged([[x["starts"], x["ends"]] for x in s]), set(i)) for n, s, i in zip(*(b.column(c).to_pylist() for c in ("n_words", "spans", "items")), strict=True)]
            yield pa.RecordBatch.from_pydict({"row": b.column("row"), "doc_id": b.column("doc_id")} | _columns(found))

    each = both.withColumn("copies", F.explode(F.sequence(F.lit(1), "copies")))
    return each.mapInArrow(run, passes.schema)


def _blocks(benchmark: DataFrame, block_bytes: int, item_col: str, text_col: str) -> list[DataFrame]:
    """item, text of the benchmark in parts of about block_bytes at most, by a count of them."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("text is not null").distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-2 * size // block_bytes)) if size > block_bytes else 1
    return [items] if n == 1 else [items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) for k in range(n)]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document row: row (see common.row_key), doc_id, n_words, n_hit, items (sorted ids), starts and ends of the hit word spans."""
    src = docs.select(row_key(id_col, text_col).alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    passes = [_pass(src, [tuple(r) for r in block.collect()], window) for block in _blocks(benchmark, block_bytes, item_col, item_text_col)]
    out = passes[0]
    for found in passes[1:]:
        out = out.unionByName(found)
    return out if len(passes) == 1 else _merge(out, len(passes))


def flagged(found: DataFrame, percent: int = 5) -> DataFrame:
    """Adds contaminated: some words are hit, and at least so many per cent of all."""
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words")))


def clean(docs: DataFrame, benchmark: DataFrame, percent: int = 5, window: int = 13, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without the contaminated ones: left out by the task that searches them, or with several blocks by a list."""
    blocks = _blocks(benchmark, block_bytes, "item_id", "text")
    if len(blocks) > 1:
        row, same = unused(docs, "row", "id")
        found = flagged(contamination(docs, benchmark, window, block_bytes), percent).where("contaminated")
        gone = durable(found.select(F.col("row").alias(row), F.col("doc_id").alias(same)).distinct(), "contaminated")
        keyed = docs.withColumn(row, row_key()).withColumn(same, F.col("doc_id"))
        return keyed.join(gone, (keyed[row] == gone[row]) & keyed[same].eqNullSafe(gone[same]), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    find, at = _matched(docs.sparkSession, [tuple(r) for r in blocks[0].collect()], window), docs.columns.index("text")

    def run(batches):
        for b in batches:
            hit = [(n, sum(y - x for x, y in s)) for n, s, _ in find(b.column(at))]
            yield b.filter(pa.array([not h or 100 * h < percent * n for n, h in hit], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
