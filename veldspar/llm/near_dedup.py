"""Near-duplicate documents by MinHash and a multi-index Hamming join.

A document's set is its distinct shingles of ``n`` consecutive words (a text of fewer words is one
shingle). Documents of equal sets form a class with one representative; the rest is about classes.

1. A signature has SYMBOLS = 80 symbols of 14 bits, each the hash of the set's least member under one of
   as many hash functions. Two sets of likeness J differ at a symbol with probability 1 - J: at J = 0.85 the
   distance of their signatures is above 31 with probability 5e-8, at J = 0.8 above 39 with 1e-9.
2. Signatures are cut into 16 chunks of 5 symbols, or for likenesses from 0.8 into 20 of 4. Of two within
   2 * chunks - 1 of each other, some chunk differs in one symbol at most. Each signature is indexed under
   every chunk with each of its symbols left out in turn, so all pairs within that limit share a key.
3. Classes that share a key are compared without emitting the pairs of a key. First each class is held
   against one leader of each of its keys, the least node (nodes are numbered at random), so a tight group
   of any size comes together by as many comparisons as it has index rows.
4. What is left are keys whose classes lie in several components. The classes that such keys connect make a
   group; within it all classes outside its largest component are held against each other and against that
   component. Both are dealt over blocks, as many as the root of their number, of ``BLOCK`` classes at least and ``BLOCK_BYTES`` of
   sets at most. A task gets two blocks with signatures and full sets and compares them there:
   different components, signatures within the limit, then the full sets. Only links that join components
   leave it, so no pairs travel and none is lost.
5. Components follow from the confirmed links, see ``components``.

Defined results: null text and text without words have no shingles and are linked with nothing, as are
documents with a null id (their component is null, and they are kept); repeated rows are linked; an empty
table gives an empty one; texts of any length are taken whole; the column names of ``docs`` besides id and text
are free, and ``kept_rows`` gives them back unchanged. Ids that repeat on different texts are documents of their own.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_values, durable, enter, mix64, row_key, scratch, unused
from .components import components
from .substring_dedup import Words, pieces

SYMBOLS = 80
_FACTORS = mix64(np.arange(1, SYMBOLS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_PLACES = mix64(np.arange(1, SYMBOLS + 1, dtype=np.uint64)) | np.uint64(1)
#: Classes in a block at least, and bytes of sets at most (one set may be longer).
BLOCK, BLOCK_BYTES = 256, 8 << 20
#: Lists up to this size are broadcast.
SMALL = 32 << 20


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles; A-Z are lowered."""
    w = Words([t.lower() for t in texts])
    h, q = w.hash, np.uint64(0xD6E8FEB86659FD93)
    g = h[: max(0, len(h) - n + 1)].copy()
    for i in range(1, n):
        g *= q
        g += h[i : len(h) - n + 1 + i]
    g = mix64(g)
    out = []
    for a, b in itertools.pairwise(w.first.tolist()):
        if b - a >= n:
            out.append(np.unique(g[a : b - n + 1]))
        elif b > a:
            x = np.full(1, b - a, np.uint64)
            for i in range(a, b):
                x = mix64(x * q + h[i])
            out.append(x)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """[set, symbol] of sets that are not empty."""
    x = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), SYMBOLS), np.uint64)
    for k in range(SYMBOLS):
        out[:, k] = np.minimum.reduceat(x * _FACTORS[k], starts)
    return (mix64(out) >> np.uint64(50)).astype(np.uint16)


def keys_of(sig: np.ndarray, chunks: int) -> np.ndarray:
    """[set, key]: for each chunk and symbol left out, a hash of the rest; the last 7 bits say which."""
    terms = (mix64(sig.astype(np.uint64) + np.uint64(1)) * _PLACES).reshape(len(sig), chunks, -1)
    rest = terms.sum(axis=2, dtype=np.uint64)[:, :, None] - terms
    which = np.arange(SYMBOLS, dtype=np.uint64).reshape(chunks, -1)
    hashed = mix64(rest + (which + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F))
    return (hashed >> np.uint64(7) << np.uint64(7) | which).reshape(len(sig), SYMBOLS)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of sorted distinct values."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.sort(np.concatenate([a, b]), kind="stable")
    inter = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * inter >= percent * (len(a) + len(b) - inter) > 0


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """id, row, size (number of shingles), d1, d2 (digest of the set) and sig, null for an empty set."""

    def run(batches):
        enter("near_dedup")
        for b in batches:
            size, d1, d2, sigs = [], [], [], []
            texts = byte_values(b.column("text"))
            for i, j in pieces(texts):
                sets = shingle_sets(texts[i:j], n)
                full = [s for s in sets if len(s)]
                own = iter(signatures(full) if full else ())
                for s in sets:
                    size.append(len(s))
                    d = xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None
                    d1.append(d and int.from_bytes(d[:8], "big", signed=True))
                    d2.append(d and int.from_bytes(d[8:], "big", signed=True))
                    sigs.append(next(own).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("row"), pa.array(size, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(sigs, pa.binary())], ["id", "row", "size", "d1", "d2", "sig"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, row long, size long, d1 long, d2 long, sig binary")


def _keys(classes: DataFrame, chunks: int) -> DataFrame:
    """key, node: the index."""

    def run(batches):
        enter("near_dedup")
        for b in batches:
            if len(b):
                keys = keys_of(_matrix(b.column("sig")), chunks)
                node = np.repeat(b.column("node").to_numpy(zero_copy_only=False), SYMBOLS)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(node)], ["key", "node"])

    return classes.select("node", "sig").mapInArrow(run, "key long, node long")


def _matrix(sigs) -> np.ndarray:
    return np.frombuffer(b"".join(sigs.to_pylist()), np.uint16).reshape(-1, SYMBOLS)


def _members(texts: DataFrame, n: int) -> DataFrame:
    """node, sig, shingles (the sorted hashes) of texts (node, text, sig)."""

    def run(batches):
        enter("near_dedup")
        for b in batches:
            values = byte_values(b.column("text"))
            for i, j in pieces(values):
                sets = [s.tobytes() for s in shingle_sets(values[i:j], n)]
                yield pa.RecordBatch.from_arrays([b.column("node")[i:j], b.column("sig")[i:j], pa.array(sets, pa.binary())], ["node", "sig", "shingles"])

    return texts.mapInArrow(run, "node long, sig binary, shingles binary")


def links_between(a: list, b: list, limit: int, percent: int) -> list[tuple[int, int]]:
    """Links between members of a and of b, (node, component, signature, set) each, that join components.

    All pairs of different components whose signatures differ in up to limit symbols are held against
    each other by their full sets; of links that join the same components one is given.
    """
    if not a:
        return []
    nodes_a, nodes_b = [x[0] for x in a], [x[0] for x in b]
    of_a, of_b = np.array([x[1] for x in a]), np.array([x[1] for x in b])
    sig_a, sig_b = (np.frombuffer(b"".join(x[2] for x in side), np.uint16).reshape(-1, SYMBOLS) for side in (a, b))
    sets_a, sets_b = [np.frombuffer(x[3], np.uint64) for x in a], [np.frombuffer(x[3], np.uint64) for x in b]
    size_a, size_b = np.array([len(x) for x in sets_a]), np.array([len(x) for x in sets_b])
    out: list[tuple[int, int]] = []
    flat = None
    for i in range(len(a)):
        able = np.flatnonzero((of_b != of_a[i]) & (100 * np.minimum(size_b, size_a[i]) >= percent * np.maximum(size_b, size_a[i])))
        if len(able):
            able = able[np.count_nonzero(sig_b[able] != sig_a[i], axis=1) <= limit]
        if not len(able):
            continue
        if len(a) * len(b) > 16:
            if flat is None:  # the sets of b by dense numbers, so that a set is a mask over them
                terms, flat = np.unique(np.concatenate(sets_b), return_inverse=True)
                starts = np.cumsum(size_b) - size_b
                mask = np.zeros(len(terms) + 1, bool)
            at = np.searchsorted(terms, sets_a[i])
            at = at[terms[np.minimum(at, len(terms) - 1)] == sets_a[i]]
            mask[at] = True
            if len(able) > 8:
                inter = np.add.reduceat(mask[flat], starts, dtype=np.int64)[able]
            else:
                inter = np.array([np.count_nonzero(mask[flat[starts[j] : starts[j] + size_b[j]]]) for j in able.tolist()])
            mask[at] = False
            able = able[100 * inter >= percent * (size_b[able] + size_a[i] - inter)]
        else:
            able = able[[linked(sets_a[i], sets_b[j], percent) for j in able.tolist()]]
        for j in able.tolist():
            if (old := of_b[j]) != (new := of_a[i]):
                out.append((nodes_a[i], nodes_b[j]))
                of_b[of_b == old] = new
                of_a[of_a == old] = new
    return out


def _compared(tasks: DataFrame, members: DataFrame, limit: int, percent: int) -> DataFrame:
    """u, v: links between the sides 0 and 1 of each task, or within side 0 where it has no other. tasks: task, side, node, comp."""

    def run(batches):
        enter("near_dedup")
        last, sides = None, ([], [])

        for b in batches:
            u, v = [], []
            task, side, node, comp, sig, sets = (b.column(c).to_pylist() for c in ("task", "side", "node", "comp", "sig", "shingles"))
            for k, t in enumerate(task):
                if t != last:
                    for x, y in links_between(sides[0], sides[1] or sides[0], limit, percent):
                        u.append(x)
                        v.append(y)
                    last, sides = t, ([], [])
                sides[side[k]].append((node[k], comp[k], sig[k], sets[k]))
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])
        rest = links_between(sides[0], sides[1] or sides[0], limit, percent)
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rest], pa.int64()), pa.array([y for _, y in rest], pa.int64())], ["u", "v"])

    rows = tasks.join(members, "node").select("task", "side", "node", "comp", "sig", "shingles")
    return rows.repartition("task").sortWithinPartitions("task").mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, percent: int = 85, small_bytes: int = SMALL, block: int = BLOCK) -> DataFrame:
    """doc_id, row (see common.row_key), n_shingles, component_id, comp of each document row.

    percent: the least likeness of a link, 80 or more. small_bytes: a list of classes up to this size,
    measured before, is broadcast to fetch their texts; a longer one is joined. block: classes in a block
    at least. comp: a number for each component, null where there is none (see the module).
    """
    if percent < 80:
        raise ValueError("the index is laid out for links of 80 per cent and more")
    src = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("row"), F.col(text_col).alias("text"))
    with scratch(docs.sparkSession) as keep:
        return keep(durable(_found(src, n, percent, small_bytes, block, 16 if percent >= 85 else 20), "near-duplicates"))


def _found(src: DataFrame, n: int, percent: int, small_bytes: int, block: int, chunks: int) -> DataFrame:
    sets = durable(_sets(src, n), "sets")
    some = sets.where("d1 is not null and id is not null")
    merged = some.groupBy("d1", "d2").agg(F.min("id").alias("least"), F.min(F.struct("row", "id")).alias("at"), F.first("size").alias("size"), F.first("sig").alias("sig"))
    # xxhash64 maps the 64-bit numbers one to one, so that the least node of a key is one at random
    classes = durable(merged.withColumn("node", F.xxhash64(F.monotonically_increasing_id())), "classes")

    with scratch(src.sparkSession) as keep:
        comps = _components(src, classes, n, percent, small_bytes, block, chunks)
        ids = classes.select("d1", "d2", "least", "node")
        if comps is None:
            ids = ids.withColumnRenamed("node", "comp")
        else:
            ids = ids.join(comps, "node", "left").select("d1", "d2", "least", F.coalesce("comp", "node").alias("comp"))
        ids = keep(durable(ids, "class-components"))
    heads = ids.groupBy("comp").agg(F.min("least").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").select("comp", "head")
    ids = ids.join(heads, "comp", "left").select("d1", "d2", "comp", F.coalesce("head", "least").alias("component_id"))
    linked_rows = some.join(ids, ["d1", "d2"]).select("id", "row", "size", "component_id", "comp")
    rest = sets.where("d1 is null or id is null").select("id", "row", "size", F.col("id").alias("component_id"), F.lit(None).cast("long").alias("comp"))
    return linked_rows.unionByName(rest).withColumnsRenamed({"id": "doc_id", "size": "n_shingles"})


def _components(src: DataFrame, classes: DataFrame, n: int, percent: int, small_bytes: int, block: int, chunks: int) -> DataFrame | None:
    """node, comp of the classes that are linked with another; None if no key is shared."""
    limit = 2 * chunks - 1
    keys = _keys(classes, chunks)
    shared = keys.groupBy("key").agg(F.min("node").alias("v"), F.max("node").alias("b")).where("v <> b").select("key", "v")
    met = durable(keys.join(shared, "key").select("key", "node", "v"), "met")
    nodes = durable(met.select("node").distinct().join(classes, "node").select("node", "at", "size", "sig"), "met-classes")
    many = nodes.count()
    if not many:
        return None
    wanted = nodes.select("node", "sig", F.col("at.row").alias("row"), F.col("at.id").alias("id"))
    wanted = F.broadcast(wanted) if 256 * many <= small_bytes else wanted
    texts = src.join(wanted, ["row", "id"]).groupBy("node").agg(F.first("text").alias("text"), F.first("sig").alias("sig"))
    members = durable(_members(texts, n), "members")

    # each class against the leader of each of its keys
    pairs = durable(met.where("node <> v").select("node", "v").distinct(), "leader-pairs")
    parts = durable(pairs.groupBy("v").agg(F.ceil(F.count(F.lit(1)) / (2 * block)).alias("parts")), "leader-parts")  # apart, so that the join may split a leader's pairs
    led = pairs.join(parts, "v").select(F.xxhash64("v", F.pmod(F.xxhash64("node"), "parts")).alias("task"), F.lit(1).alias("side"), "node")
    lead = parts.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "v").select(F.xxhash64("v", "part").alias("task"), F.lit(0).alias("side"), F.col("v").alias("node"))
    links = durable(_compared(led.unionByName(lead).withColumn("comp", F.col("node")), members, limit, percent), "leader-links")
    comps = components(links)

    # what is left: keys that hold several components
    each = met.select("key", "node", "v").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    several = each.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select("key")
    open_ = durable(each.join(several, "key", "left_semi").select("node", "comp", "v").distinct(), "open")
    groups = components(open_.select(F.col("node").alias("u"), "v")).withColumnRenamed("comp", "grp")
    of = durable(open_.select("node", "comp").distinct().join(groups, "node").join(nodes.select("node", "size"), "node"), "groups")
    size = of.groupBy("grp", "comp").agg(F.count(F.lit(1)).alias("c"), F.sum("size").alias("s"))
    size = size.groupBy("grp").agg(F.max(F.struct("c", "s", "comp")).alias("top"), F.sum("c").alias("n"), F.sum("s").alias("s"))
    blocks = lambda count, total: F.ceil(F.greatest(8 * total / BLOCK_BYTES, F.least(count / F.lit(block), F.sqrt(count)))).cast("int")
    size = size.select("grp", F.col("top.comp").alias("top"), blocks(F.col("n") - F.col("top.c"), F.col("s") - F.col("top.s")).alias("few"), blocks(F.col("top.c"), F.col("top.s")).alias("more"))
    dealt = of.join(size, "grp").withColumn("i", F.pmod(F.xxhash64("node", F.lit(1)), F.when(F.col("comp") == F.col("top"), F.col("more")).otherwise(F.col("few"))))
    up_to = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1)
    place = lambda i, j, kind, side: F.struct(F.xxhash64("grp", i, j, F.lit(kind)).alias("task"), side.alias("side"))
    each_other = F.transform(up_to("few"), lambda j: place(F.least("i", j), F.greatest("i", j), 0, (F.col("i") > j).cast("int")))
    with_top = F.transform(up_to("more"), lambda j: place(F.col("i"), j, 1, F.lit(0)))
    of_top = F.transform(up_to("few"), lambda j: place(j, F.col("i"), 1, F.lit(1)))
    places = F.when(F.col("comp") == F.col("top"), of_top).otherwise(F.concat(each_other, with_top))
    tasks = dealt.select(F.explode(places).alias("at"), "node", "comp").select("at.task", "at.side", "node", "comp")
    more = durable(_compared(tasks, members, limit, percent), "more-links")
    return components(links.unionByName(more))


def kept_rows(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text", small_bytes: int = SMALL) -> DataFrame:
    """docs with one row of each component: one with the component's id. found: of near_duplicates.

    Rows without a component stay. What goes is few against what stays, so it is listed, and the list
    broadcast up to small_bytes; rows that repeat a kept one (id and text) are reduced apart, if there are any.
    """
    row, same = unused(docs, "row", "id")
    listed = found.where("comp is not null")
    heads = listed.where("doc_id = component_id").groupBy("comp").agg(F.min("row").alias("head"))
    gone = durable(listed.join(heads, "comp").where("doc_id <> component_id or row <> head").select(F.col("row").alias(row), F.col("doc_id").alias(same)).distinct(), "gone")
    repeated = durable(listed.where("doc_id = component_id").groupBy("row", "doc_id", "comp").count().where("count > 1").select(F.col("row").alias(row), F.col("doc_id").alias(same)), "repeated")
    few = lambda df: F.broadcast(df) if 64 * df.count() <= small_bytes else df
    columns = docs.columns
    rows = docs.withColumn(row, row_key(id_col, text_col)).withColumn(same, F.col(id_col)).join(few(gone), [row, same], "left_anti")
    if not repeated.isEmpty():
        again = few(repeated)
        rows = rows.join(again, [row, same], "left_anti").unionByName(rows.join(again, [row, same], "left_semi").dropDuplicates([row, same]))
    return rows.select(*[F.col(f"`{c}`") for c in columns])
