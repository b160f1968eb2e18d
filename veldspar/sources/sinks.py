"""Writers: references, labelled test sets, results. An index has its own, see operators.index."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import shared_folder


def write_references(refs: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Files that each hold one JSON array of {vector, label}, gzipped, in order of ref_id; readers.references reads them."""
    label = F.when(F.col("is_fraud"), "fraud").otherwise("legit").alias("label")
    rows = refs.sortWithinPartitions("ref_id").select(F.to_json(F.struct("vector", label)).alias("value"))

    def array(batches):
        """Lines of one array: a task writes one file."""
        before = "["
        for b in batches:
            lines = []
            for text in b.column(0).to_pylist():
                lines.append(before + text)
                before = ","
            yield pa.RecordBatch.from_pydict({"value": pa.array(lines, pa.string())})
        yield pa.RecordBatch.from_pydict({"value": pa.array(["[]" if before == "[" else "]"])})

    rows.mapInArrow(array, "value string").write.mode(mode).option("compression", "gzip").text(path)


def write_test_set(entries: DataFrame, stats: DataFrame, checksum: str, path: str, mode: str = "errorifexists") -> None:
    """One JSON document of checksum, statistics and entries, as readers.test_set reads it. entries: request,
    expected_approved, expected_fraud_score, and position where their order matters; stats: one row.

    Tasks write the entries in ranges of their order, a line each; the ranges are then joined to one file as streams,
    each removed once it is copied. entries are read more than once.
    """
    if mode not in ("errorifexists", "error", "overwrite", "ignore"):
        raise ValueError(f"unknown mode {mode!r}; one of errorifexists, overwrite, ignore")
    spark = entries.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(conf)
    if fs.exists(at):
        if mode == "ignore":
            return
        if mode != "overwrite":
            raise FileExistsError(path)
    head = stats.select(F.to_json(F.struct(*stats.columns)).alias("value")).first()
    if head is None:
        raise ValueError("the statistics have no row")
    order = F.col("position").cast("long") if "position" in entries.columns else F.monotonically_increasing_id()
    body = entries.select(order.alias("at"), F.concat(F.lit(","), F.to_json(F.struct("request", "expected_approved", "expected_fraud_score"), {"ignoreNullFields": "false"})).alias("value"))
    parts = shared_folder(spark, "test-set")
    body.repartitionByRange("at").sortWithinPartitions("at").select("value").write.text(parts)
    folder = jvm.org.apache.hadoop.fs.Path(parts)
    own = folder.getFileSystem(conf)
    ranges = sorted((f.getPath() for f in own.listStatus(folder) if f.getPath().getName().startswith("part-") and f.getLen()), key=lambda f: f.getName())
    if mode == "overwrite":
        fs.delete(at, True)
    out = fs.create(jvm.org.apache.hadoop.fs.Path(at, "_document"), True)  # read by nobody before it is whole
    try:
        out.write(bytearray(f'{{"references_checksum_sha256": {json.dumps(checksum)}, "stats": {head.value}, "entries": [\n'.encode()))
        for i, f in enumerate(ranges):
            lines = own.open(f)
            try:
                if i == 0:
                    lines.read()  # no comma before the first entry
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(lines, out, 1 << 20, False)
            finally:
                lines.close()
            own.delete(f, False)
        out.write(bytearray(b"]}\n"))
    finally:
        out.close()
    own.delete(folder, True)
    fs.rename(jvm.org.apache.hadoop.fs.Path(at, "_document"), jvm.org.apache.hadoop.fs.Path(at, "document.json"))


def write_results(documents: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A json column as lines."""
    documents.select("json").write.mode(mode).text(path)


def write_aggregates(documents: DataFrame, root: str) -> None:
    """dtype, clusters, nprobe, json (of evaluate.aggregate_documents) as <dtype>_K<clusters>_nprobe<n>/aggregate.json.

    A configuration is one row and one file, written through the file system that root is on.
    """
    spark = documents.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for r in documents.select("dtype", "clusters", "nprobe", "json").toLocalIterator():
        at = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{r.dtype}_K{r.clusters}_nprobe{r.nprobe}/aggregate.json")
        out = at.getFileSystem(conf).create(at, True)
        try:
            out.write(bytearray(r.json.encode()))
        finally:
            out.close()


def write_responses(table: DataFrame, path: str, mode: str = "errorifexists") -> None:
    table.coalesce(1).orderBy("fraud_count").write.mode(mode).json(path)  # k + 1 rows
