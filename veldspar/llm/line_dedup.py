"""Line dedup within one edit, by a deletion-neighbourhood join.

A text is cut at line feeds; a line is compared without white space around it. A line goes when an earlier
line, in the order of (id, line number), equals it or is near it, whether that line itself stays or goes.
Near are two lines of ``min_chars`` code points or more that are one insertion, deletion or substitution of a
code point apart, and two lines of ``min_words`` words or more that are one such edit of a whole word apart
(words are what stands between white space, so these lines may differ by many code points). The first of such
lines stays. Lines of fewer than ``exact_chars`` code points always stay; those between are compared for equality.

Below, symbols are a line's code points, or its words by hash. Two lines are within one edit just if they
share a variant: the line itself, or the line with one symbol deleted. Variants are keyed by hash. To know
from the key alone that two lines are within one edit, a deletion's key holds its place: equal keys of that
kind are a substitution at that place. An insertion shows as the longer line's deletion without its place
against the shorter line itself. So a key needs no pairs: the earliest line of each key is an aggregate with
partial sums, and a line that thousands share is one row for each task.

To emit variants only where they can meet, each distinct line first emits the hashes of its halves: of
two lines within one edit, the first or the second halves are equal. Lines that share a half with a
different line emit the hashes of the line without each of SEGMENTS segments, which two lines within one
edit share for the segment of the edit. Only deletions in a shared segment are emitted as variants. Each
line that may go is then verified against the text of its earlier partner symbol by symbol.

Defined results: null text stays null; an empty text stays empty; lines and texts of any length are taken
whole; null ids come first in the order; repeated rows (equal id and text) are later lines of the same id and
lose their lines to the first; an empty table gives an empty one; all input columns are kept under their
names, whatever these are, ``text`` is replaced and, where the table has it, ``n_chars`` counts what is left.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, enter, mix64, row_key, scratch, unused

MIN_CHARS, MIN_WORDS, SEGMENTS = 20, 12, 8
#: The two kinds of symbols.
POINTS, WORDS = 0, 1
#: Keys that a task holds before it sends them on.
HELD = 200_000
#: Repeated rows are numbered over so many partitions for each.
SALTS = 64


def trimmed(line: str) -> str:
    return line.strip(" \t\r\n\x0b\x0c")


_hash = xxhash.xxh3_64_intdigest


def words(line: str) -> list[bytes]:
    return line.encode("utf-8", "surrogatepass").split()


def symbols(line: str, unit: int) -> np.ndarray:
    if unit == WORDS:
        return np.array([_hash(w) for w in words(line)], np.uint64)
    return np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def units(line: str, min_chars: int, min_words: int) -> list[int]:
    """The kinds of symbols by which a line is compared for nearness."""
    return [POINTS] * (len(line) >= min_chars) + [WORDS] * (len(line) >= 2 * min_words - 1 and len(words(line)) >= min_words)


def halves(line: str, min_chars: int, min_words: int) -> set[int]:
    """Hashes of which two different lines within one edit share one, the last bit telling the kind of symbols.

    Each line counts as the shorter and as the longer of a pair.
    """
    out: set[int] = set()
    n, data = len(line), line.encode("utf-8", "surrogatepass")
    if n >= min_chars:
        a, b = n // 2, (n - 1) // 2
        if len(data) == n:
            parts = data[:a], data[:b], data[a:], data[b + 1 :]
        else:
            parts = tuple(x.encode("utf-8", "surrogatepass") for x in (line[:a], line[:b], line[a:], line[b + 1 :]))
        out |= {(_hash(x, k >> 1) >> 1 << 1) - (1 << 63) for k, x in enumerate(parts)}
    if n >= 2 * min_words - 1 and (n := len(w := data.split())) >= min_words:
        a, b = n // 2, (n - 1) // 2
        out |= {(_hash(b" ".join(x), 2 + (k >> 1)) | 1) - (1 << 63) for k, x in enumerate((w[:a], w[:b], w[a:], w[b + 1 :]))}
    return out


_BASE = np.uint64(0xA0761D6478BD642F)
_INVERSE = np.uint64(pow(0xA0761D6478BD642F, -1, 1 << 64))
_POWERS, _BACK = (np.cumprod(np.full(1 << 14, x, np.uint64)) for x in (_BASE, _INVERSE))


def segments(n: int):
    """(role, segment, begin, end) of a line of n symbols as the shorter or equal (0) and as the longer (1) of a pair.

    As the longer its layout is that of the shorter, the segment itself one longer.
    """
    for role in (0, 1):
        base = n - role
        for q in range(SEGMENTS):
            yield role, q, base * q // SEGMENTS, base * (q + 1) // SEGMENTS + role


def _sums(points: np.ndarray) -> np.ndarray:
    """The hash of a sequence is the sum of a number for each symbol times a power for its place, so that of a part
    follows from sums to the left and right of it."""
    n = len(points)
    power = _POWERS[:n] if n <= len(_POWERS) else np.cumprod(np.full(n, _BASE, np.uint64))
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(points + np.uint64(1)) * power)])


def masks(points: np.ndarray) -> np.ndarray:
    """For each of ``segments`` the hash of the sequence without it."""
    n, left = len(points), _sums(points)
    role, q, a, b = (np.array(x) for x in zip(*segments(n), strict=True))
    back = _BACK if n <= len(_BACK) else np.cumprod(np.full(n, _INVERSE, np.uint64))
    rest = left[a] + (left[n] - left[b]) * np.where(b > a, back[np.maximum(b - a, 1) - 1], np.uint64(1))
    return mix64(mix64(rest) + mix64(((n - role) * SEGMENTS + q).astype(np.uint64)))


def variants(points: np.ndarray, shared: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the deletions with their places, of the deletions, and of the sequence itself, as far as shared (indices into ``segments``) asks."""
    n, ways, left = len(points), list(segments(len(points))), _sums(points)
    whole = left[-1:]

    def gone(role: int):
        places = [np.arange(a, b) for r, _, a, b in (ways[k] for k in shared) if r == role]
        at = np.unique(np.concatenate(places)) if places else np.zeros(0, np.int64)
        return at, left[at] + (whole - left[at + 1]) * _INVERSE  # what stands right of a deletion moves one place

    at, same = gone(0)
    placed = mix64(same + mix64(at.astype(np.uint64) + (np.uint64(n) << np.uint64(32))))
    plain = np.unique(mix64(gone(1)[1] + np.uint64(n - 1)))
    own = mix64(whole + np.uint64(n))[: int(any(ways[k][0] == 0 for k in shared))]
    return placed, plain, own


def within_one(a, b) -> bool:
    """Whether two sequences are one insertion, deletion or substitution apart, or equal."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


def _occurrences(src: DataFrame, min_chars: int, min_words: int, exact_chars: int) -> DataFrame:
    """row, id, line number, 128-bit digest and half hashes of each line that is compared."""

    def run(batches):
        enter("line_dedup")
        for b in batches:
            rows, ids, lines, h1, h2, half = [], [], [], [], [], []
            for row, i, text in zip(*(b.column(c).to_pylist() for c in ("row", "id", "text")), strict=True):
                for n, line in enumerate(text.split("\n") if text else ()):
                    if len(line := trimmed(line)) >= exact_chars:
                        d = xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass"))
                        rows.append(row)
                        ids.append(i)
                        lines.append(n)
                        h1.append(int.from_bytes(d[:8], "big", signed=True))
                        h2.append(int.from_bytes(d[8:], "big", signed=True))
                        half.append(halves(line, min_chars, min_words))
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()), pa.array(ids, b.schema.field("id").type), pa.array(lines, pa.int32()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(half, pa.list_(pa.int64()))],
                ["row", "id", "line", "h1", "h2", "half"])

    return src.mapInArrow(run, f"row long, id {src.schema['id'].dataType.simpleString()}, line int, h1 long, h2 long, half array<long>")


def _same_row(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """a joined with b, of which row and id are dropped, by row and id; null ids are equal."""
    row, same = unused(a, "row_of_b", "id_of_b")
    b = b.withColumnsRenamed({"row": row, "id": same})
    return a.join(b, (a["row"] == b[row]) & a["id"].eqNullSafe(b[same]), how).drop(row, same)


def _texts(src: DataFrame, wanted: DataFrame) -> DataFrame:
    """place, text, unit of the wanted (row, id, lines); lines: twice a line's number, and 1 more for words."""

    def run(batches):
        enter("line_dedup")
        for b in batches:
            out = []
            for row, i, text, lines in zip(*(b.column(c).to_pylist() for c in ("row", "id", "text", "lines")), strict=True):
                own = text.split("\n")
                out += [(row, i, n >> 1, trimmed(own[n >> 1]), n & 1) for n in lines]
            cols = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), b.schema.field("id").type, pa.int32(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["row", "id", "line", "text", "unit"])

    found = _same_row(src, wanted).select("row", "id", "text", "lines").mapInArrow(run, f"row long, id {src.schema['id'].dataType.simpleString()}, line int, text string, unit int")
    return found.select(F.struct("id", "row", "line").alias("place"), "text", "unit").dropDuplicates(["place", "unit"])


def _masks(lines: DataFrame) -> DataFrame:
    """place, unit, k (index into ``segments``), mask."""

    def run(batches):
        enter("line_dedup")
        for b in batches:
            if len(b):
                unit = np.array(b.column("unit").to_pylist(), np.int32)
                found = np.concatenate([mix64(masks(symbols(t, u)) + np.uint64(u)) for t, u in zip(b.column("text").to_pylist(), unit.tolist(), strict=True)])
                own = np.repeat(np.arange(len(b)), 2 * SEGMENTS)
                k = np.tile(np.arange(2 * SEGMENTS, dtype=np.int32), len(b))
                yield pa.RecordBatch.from_arrays([b.column("place").take(pa.array(own)), pa.array(unit[own]), pa.array(k), pa.array(found.view(np.int64))], ["place", "unit", "k", "mask"])

    return lines.select("place", "text", "unit").mapInArrow(run, f"place {lines.schema['place'].dataType.simpleString()}, unit int, k int, mask long")


def _variants(lines: DataFrame) -> DataFrame:
    """place, kind (of a unit 0: deletion with its place, 1: deletion, 2: the line itself), key. lines have unit and shared."""

    def run(batches):
        enter("line_dedup")
        for b in batches:
            held, n = [], 0

            def flush():
                at, kinds, keys = (np.concatenate(x) for x in zip(*held, strict=True))
                return pa.RecordBatch.from_arrays([b.column("place").take(pa.array(at)), pa.array(kinds), pa.array(keys.view(np.int64))], ["place", "kind", "key"])  # noqa: B023

            for i, (text, unit, shared) in enumerate(zip(*(b.column(c).to_pylist() for c in ("text", "unit", "shared")), strict=True)):
                parts = variants(symbols(text, unit), shared)
                keys = mix64(np.concatenate(parts) + np.uint64(unit))
                held.append((np.full(len(keys), i), np.repeat(np.array([0, 1, 2], np.int8), [len(p) for p in parts]), keys))
                n += len(keys)
                if n > HELD:
                    yield flush()
                    held, n = [], 0
            if held:
                yield flush()

    return lines.select("place", "text", "unit", "shared").mapInArrow(run, f"place {lines.schema['place'].dataType.simpleString()}, kind byte, key long")


def _verified(pairs: DataFrame, min_chars: int, min_words: int) -> DataFrame:
    """place of the pairs (place, text, other) that are near."""

    def near(a: str, b: str) -> bool:
        for unit in set(units(a, min_chars, min_words)) & set(units(b, min_chars, min_words)):
            if within_one(a, b) if unit == POINTS else within_one(words(a), words(b)):
                return True
        return False

    def run(batches):
        enter("line_dedup")
        for b in batches:
            keep = [near(x, y) for x, y in zip(b.column("text").to_pylist(), b.column("other").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("place").filter(pa.array(keep, pa.bool_()))], ["place"])

    return pairs.select("place", "text", "other").mapInArrow(run, f"place {pairs.schema['place'].dataType.simpleString()}")


def _near(src: DataFrame, firsts: DataFrame, min_chars: int, min_words: int, small: int) -> DataFrame:
    """Places (row, id, line) of first lines that have an earlier different line within one edit."""
    each = firsts.select("h1", "row", "id", "line", F.explode("half").alias("half"))
    shared = each.groupBy("half").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a <> b")
    meeting = each.join(shared, "half", "left_semi").select("row", "id", (2 * F.col("line") + F.col("half").bitwiseAND(F.lit(1)).cast("int")).alias("line"))
    wanted = durable(meeting.groupBy("row", "id").agg(F.collect_set("line").alias("lines")), "lines-wanted")
    n = wanted.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("lines")), F.lit(0))).first()
    wanted = F.broadcast(wanted) if 64 * n[0] + 4 * n[1] <= small else wanted
    lines = durable(_texts(src, wanted), "lines-text")
    each = durable(_masks(lines), "line-masks")
    shared = each.groupBy("mask").agg(F.min("place").alias("a"), F.max("place").alias("b")).where("a <> b").select("mask")
    shared = each.join(shared, "mask", "left_semi").groupBy("place", "unit").agg(F.collect_set("k").alias("shared"))
    lines = durable(lines.join(shared, ["place", "unit"]), "lines-close")
    keys = durable(_variants(lines), "line-variants")
    least = lambda k: F.min(F.when(F.col("kind") == k, F.col("place"))).alias(f"m{k}")
    met = keys.groupBy("key").agg(least(0), least(1), least(2), F.count(F.lit(1)).alias("n")).where("n > 1")
    partner = F.when(F.col("kind") == 0, F.col("m0")).when(F.col("kind") == 1, F.col("m2")).otherwise(F.col("m1"))
    pairs = keys.join(met, "key").select("place", partner.alias("partner")).where("partner < place").distinct()
    text = lines.select("place", "text").dropDuplicates(["place"])
    both = pairs.join(text, "place").join(text.select(F.col("place").alias("partner"), F.col("text").alias("other")), "partner")
    return _verified(both, min_chars, min_words).select("place.row", "place.id", "place.line").distinct()


def _removed(src: DataFrame, min_chars: int, min_words: int, exact_chars: int, small: int) -> DataFrame:
    """row, id, removed: the numbers of each document's lines that go."""
    occurrences = durable(_occurrences(src.where("text is not null"), min_chars, min_words, exact_chars), "line-occurrences")
    firsts = durable(occurrences.groupBy("h1", "h2").agg(F.min(F.struct("id", "row", "line")).alias("first"), F.count(F.lit(1)).alias("n"), F.first("half").alias("half")).select("h1", "h2", "first.*", "n", "half"), "line-firsts")
    near = _near(src, firsts, min_chars, min_words, small)
    again = occurrences.join(firsts.where("n > 1").select("h1", "h2", F.struct("id", "row", "line").alias("first")), ["h1", "h2"]).where(F.struct("id", "row", "line") != F.col("first")).select("row", "id", "line")
    return again.unionByName(near).groupBy("row", "id").agg(F.collect_set("line").alias("removed"))


def _later_copy(rows: DataFrame, repeated: DataFrame) -> tuple[DataFrame, DataFrame, Column]:
    """rows (row, id) without and with the repeated ones, and of the latter whether one is not the first of its copies.

    Copies are numbered in SALTS parts and the firsts of the parts then, so that many copies are no one task's.
    """
    salt, nth = unused(rows, "salt", "nth")
    again = _same_row(rows, repeated, "left_semi").withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    again = again.withColumn(nth, F.row_number().over(Window.partitionBy("row", "id", salt).orderBy(F.lit(0))))
    part = F.when(F.col(nth) == 1, -1).otherwise(F.col(salt))
    first = F.row_number().over(Window.partitionBy("row", "id", part).orderBy(salt))
    return _same_row(rows, repeated, "left_anti"), again, (F.col(nth) > 1) | (first > 1)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS, exact_chars: int = 1, small_bytes: int = 32 << 20, counts: bool = False) -> DataFrame:
    """docs with duplicate lines gone. With counts, only id, n_lines, n_removed and text.

    min_chars, min_words: code points and words from which lines are compared for nearness, 2 and more; exact_chars:
    code points from which they are compared for equality.
    small_bytes: a list of lines up to this size, measured before, is broadcast; a longer one is joined.
    """
    if min_chars < 2 or min_words < 2:
        raise ValueError("lines of one symbol are all within one edit")
    exact_chars = max(1, min(exact_chars, min_chars))
    src = docs.select(row_key(id_col, text_col).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    with scratch(docs.sparkSession) as keep:
        removed = keep(durable(_removed(src, min_chars, min_words, exact_chars, small_bytes), "lines-removed"))
    repeated = src.groupBy("row", "id").count().where("count > 1").select("row", "id")
    columns = [id_col, text_col] if counts else docs.columns
    own = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(columns)], row_key(id_col, text_col).alias("row"), F.col(id_col).alias("id"))
    if repeated.isEmpty():
        rows = own.withColumn("later", F.lit(False))
    else:
        once, again, later = _later_copy(own, repeated)
        rows = once.withColumn("later", F.lit(False)).unionByName(again.select(*own.columns, later.alias("later")))
    rows = _same_row(rows, removed, "left")
    text_at, size_at = columns.index(text_col), columns.index("n_chars") if "n_chars" in columns else None

    def run(batches):
        enter("line_dedup")
        for b in batches:
            texts, total, gone = [], [], []
            for text, later, removed in zip(*(b.column(c).to_pylist() for c in (f"c{text_at}", "later", "removed")), strict=True):
                lines = text.split("\n") if text is not None else []
                out = {i for i, line in enumerate(lines) if len(trimmed(line)) >= exact_chars} if later else set(removed or ())
                texts.append("\n".join(line for i, line in enumerate(lines) if i not in out) if text is not None else None)
                total.append(len(lines))
                gone.append(len(out))
            cols = [b.column(f"c{k}") for k in range(len(columns))]
            cols[text_at] = pa.array(texts, pa.string())
            if size_at is not None:
                cols[size_at] = pa.array([None if t is None else len(t) for t in texts], b.schema.field(f"c{size_at}").type)
            more = [pa.array(total, pa.int64()), pa.array(gone, pa.int64())] if counts else []
            yield pa.RecordBatch.from_arrays([*cols, *more], [*columns, *(["n_lines", "n_removed"] if counts else [])])

    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns] + ["n_lines long", "n_removed long"] * counts
    picked = rows.select(*[f"c{k}" for k in range(len(columns))], "later", "removed")
    return picked.mapInArrow(run, ", ".join(fields))
