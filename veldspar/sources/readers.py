"""Readers: labelled references, payloads, labelled test sets, run results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DIMS
from ..schema import PAYLOAD, REFERENCE_JSON, RUN_RESULT, TEST_SET


def references(spark: SparkSession, path: str, dims: int = DIMS, strict: bool = False, parts: int | None = None) -> DataFrame:
    """ref_id, vector array<float>, is_fraud of JSON arrays of {vector, label}, gzipped or not.

    A label other than ``fraud`` is no fraud; strict also refuses a missing one. A vector of other than dims
    components raises. gzip can't be split, so the rows are dealt out at once; write them as Parquet to keep.
    """
    raw = spark.read.schema(REFERENCE_JSON).option("multiLine", True).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)
    right = F.coalesce(F.size("vector") == dims, F.lit(False))
    if strict:
        right = right & F.col("label").isNotNull()
    checked = F.when(right, F.col("vector")).otherwise(F.raise_error(F.concat(F.lit(f"a vector of {dims} components is wanted, this has "), F.coalesce(F.size("vector"), F.lit(0)).cast("string"))))
    # ids follow the order in the file: input files are read whole, each by one task
    out = raw.select(F.monotonically_increasing_id().alias("ref_id"), F.transform(checked, lambda x: x.cast("float")).alias("vector"), F.coalesce(F.col("label") == "fraud", F.lit(False)).alias("is_fraud"))
    return out.repartition(parts) if parts else out


def payloads(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Payload columns of JSON arrays, or of JSON lines."""
    return spark.read.schema(PAYLOAD).option("multiLine", not lines).json(path)


def bodies(spark: SparkSession, path: str) -> DataFrame:
    """JSON texts, one a line, to be parsed by functions.vectorize.parse with rejects."""
    return spark.read.text(path).withColumnRenamed("value", "body")


def split_array(texts: DataFrame, column: str = "body", keep: tuple[str, ...] = ()) -> DataFrame:
    """The objects of texts that are JSON arrays, each as a text of its own, in order: kept columns, position, object."""
    objects = F.from_json(column, "array<variant>")
    return texts.select(*keep, F.posexplode(objects).alias("position", "__v")).select(*keep, "position", F.to_json("__v").alias("object"))


def test_set(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(entries: position, request, expected_approved, expected_fraud_score; stats: one row).

    A document with one entry a line, as sinks.write_test_set writes it, is read in parallel; any other whole.
    """
    laid = _lines_of_test_set(spark, path)
    if laid:
        return laid
    doc = spark.read.schema(TEST_SET).option("multiLine", True).json(path)
    entries = doc.select(F.posexplode("entries").alias("position", "e")).select("position", "e.*")
    return entries, doc.select("references_checksum_sha256", "stats.*")


def _lines_of_test_set(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame] | None:
    """The same of a document whose first line ends where its entries begin, with one entry on each line up to the last; None of any other."""
    value, opening = F.col("value"), '{"request":'
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    head = F.startswith(value, F.lit('{"references_checksum_sha256": ')) & F.endswith(value, F.lit('"entries": ['))
    entry = F.startswith(value, F.lit(opening)) | F.startswith(value, F.lit("," + opening))
    one = entry & (F.locate(opening, value, 3) == 0) & F.endswith(value, F.lit("}"))  # in texts quotes are escaped
    end = value == "]}"
    blocks = lines.groupBy("file", "block").agg(F.count_if(one).alias("n"), F.count_if(head).alias("heads"), F.count_if(end).alias("ends"), F.count_if(~(one | head | end)).alias("others"), F.max(F.when(head, value)).alias("head")).collect()  # a row for each part of the input
    if sum(b.heads for b in blocks) != 1 or sum(b.ends for b in blocks) != 1 or any(b.others for b in blocks):
        return None
    first, before = [], 0
    for b in sorted(blocks, key=lambda b: (b.file, b.block)):
        first.append((b.file, b.block, before))
        before += b.n
    kind = TEST_SET[TEST_SET.index("array<") + len("array<") : -1]
    read = F.from_json(F.ltrim(value, F.lit(",")), kind, {"mode": "FAILFAST"})
    rows = lines.where(entry).withColumn("line", F.monotonically_increasing_id())
    place = F.row_number().over(Window.partitionBy("file", "block").orderBy("line")) - 1
    rows = rows.join(F.broadcast(spark.createDataFrame(first, "file string, block long, before long")), ["file", "block"])
    entries = rows.select((F.col("before") + place).alias("position"), read.alias("e")).select("position", "e.*")
    whole = next(b.head for b in blocks if b.head) + "]}"
    doc = spark.createDataFrame([(whole,)], "value string").select(F.from_json("value", TEST_SET).alias("d"))
    return entries, doc.select("d.references_checksum_sha256", "d.stats.*")


def run_results(spark: SparkSession, root: str) -> DataFrame:
    """One row for each configuration folder <dtype>_K<clusters>_nprobe<n>: its aggregate if it has scores, else its first run, else results.json."""
    doc = spark.read.schema(RUN_RESULT).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(root)
    file = F.input_file_name()
    folder = F.element_at(F.split(file, "/"), -2)
    name = F.element_at(F.split(file, "/"), -1)
    rows = doc.withColumn("folder", folder).withColumn("name", name)
    rows = rows.withColumn("choice", F.when((F.col("name") == "aggregate.json") & F.col("scoring.breakdown").isNotNull(), 0).when(F.rlike("name", F.lit(r"^results_run.*\.json$")), 1).when(F.col("name") == "results.json", 2))
    first = F.row_number().over(Window.partitionBy("folder").orderBy("choice", "name"))
    part = lambda k: F.regexp_extract("folder", r"^(\w+)_K(\d+)_nprobe(\d+)$", k)
    kept = rows.where("choice is not null").withColumn("__n", first).where("__n = 1").drop("__n")
    b = "scoring.breakdown."
    return kept.select(
        F.coalesce("dtype", part(1)).alias("dtype"), part(2).cast("int").alias("clusters"), part(3).cast("int").alias("nprobe"),
        F.coalesce("p99_ms.median", "scoring.raw.p99_ms", F.try_to_number(F.regexp_replace("p99", "ms$", ""), F.lit("999999.99")).cast("double")).alias("p99"),
        *[F.coalesce(b + long, F.lit(0)).alias(short) for short, long in (("tp", "true_positive_detections"), ("tn", "true_negative_detections"), ("fp", "false_positive_detections"), ("fn", "false_negative_detections"), ("err", "http_errors"))],
        F.coalesce("scoring.p99_score.value", F.lit(0.0)).alias("p99_score"), F.coalesce("scoring.detection_score.value", F.lit(0.0)).alias("detection_score"), F.coalesce("scoring.final_score", F.lit(0.0)).alias("final_score"),
        F.coalesce("scoring.p99_score.cut_triggered", F.lit(False)).alias("p99_cut"), F.coalesce("scoring.detection_score.cut_triggered", F.lit(False)).alias("detection_cut"))


def checksum(spark: SparkSession, path: str) -> str:
    """SHA-256 of a file of any size, read as a stream through the file system that path is on."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(at)
    try:
        return jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
    finally:
        stream.close()
