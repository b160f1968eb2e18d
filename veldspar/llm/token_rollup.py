"""Token counts kept by deltas: additive totals by source, language and tokenizer version.

A delta row says by how much a document changes a total: an insert adds its count, a delete takes it
away, a revision does both. A batch of deltas is summed per key (partial sums before the shuffle, so a
source with a third of all rows is one row for each task) and committed under its batch id.

What is committed is what the newest manifest lists: a small numbered file that names the fold (summed
totals and a table of the batch ids in them) and the batches committed since. A commit writes its sums,
then publishes the next manifest by a rename that fails if that number exists; ``compact`` does the same
with a new fold. So a crash between any two steps leaves the manifest before or the one after, a batch id
that is listed is not committed again (a batch replayed after a failure changes nothing), and of two
writers one finds the number taken, reads the newer manifest and tries again. What no manifest lists is
never read; ``compact`` removes what is older than its manifest.

Defined results: null sources and languages are keys of their own; null and empty texts count as documents
of no tokens, texts of any length are counted whole; repeated rows count each; keys whose documents and
tokens are all gone are left out; no batches or empty ones give an empty table; columns of docs besides the
four that are read are free.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEY = ("source", "lang", "tokenizer_version")
SCHEMA = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"

#: Tokens by version: runs without white space; runs of letters and digits, and each other visible character.
TOKENIZERS = {"words-1": r"[^\x20\x09-\x0D]+", "words-2": r"[\p{L}\p{N}]+|[^\x20\x09-\x0D\p{L}\p{N}]"}


def n_tokens(version: str, text_col: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(TOKENIZERS[version])), F.lit(0)).cast("long")


def deltas(docs: DataFrame, version: str, sign: int) -> DataFrame:
    """Inserts (sign 1) or deletes (sign -1) of docs with source, lang, text under a tokenizer version."""
    return docs.select(
        F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.lit(version).alias("tokenizer_version"),
        F.lit(sign).cast("long").alias("n_docs"), (sign * n_tokens(version)).alias("n_tokens"))


def revisions(old: DataFrame, new: DataFrame, old_version: str, new_version: str) -> DataFrame:
    """Documents whose text or tokenizer version changed: their old counts go, their new counts come."""
    return deltas(old, old_version, -1).unionByName(deltas(new, new_version, 1))


class Rollup:
    """Committed batches under a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._at("").getFileSystem(self.conf)

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _listed(self, folder: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self._at(folder))] if self.fs.exists(self._at(folder)) else []

    def _newest(self) -> tuple[int, dict]:
        """Number and content of the newest manifest; 0 and an empty one if there is none."""
        number = max((int(n) for n in self._listed("manifests") if n.isdigit()), default=0)
        if not number:
            return 0, {"fold": None, "since": {}}
        stream = self.fs.open(self._at(f"manifests/{number:010d}"))
        try:
            return number, json.loads(bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def _publish(self, number: int, manifest: dict) -> bool:
        """Make manifest the one of this number; False if there is one."""
        staged = self._at(f"staging/{uuid.uuid4().hex}")
        out = self.fs.create(staged, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        self.fs.mkdirs(self._at("manifests"))
        files = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at("").toUri(), self.conf)
        options = self.spark.sparkContext._gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            files.rename(self.fs.makeQualified(staged), self.fs.makeQualified(self._at(f"manifests/{number:010d}")), options)
        except Exception as e:
            if not self.fs.exists(self._at(f"manifests/{number:010d}")):
                raise
            if "exist" not in str(e).lower():
                raise
            self.fs.delete(staged, False)
            return False
        return True

    def _folded(self, manifest: dict) -> DataFrame:
        """Ids of the batches in the fold: batch."""
        return self.spark.read.schema("batch string").parquet(f"{self.path}/{manifest['fold']}/ids")

    def _has(self, manifest: dict, batch: str) -> bool:
        return batch in manifest["since"] or manifest["fold"] is not None and not self._folded(manifest).where(F.col("batch") == batch).isEmpty()

    def batches(self) -> DataFrame:
        """batch: the ids that are committed."""
        _, manifest = self._newest()
        apart = self.spark.createDataFrame([(b,) for b in sorted(manifest["since"])], "batch string")
        return apart if manifest["fold"] is None else apart.unionByName(self._folded(manifest))

    def commit(self, batch: str, rows: DataFrame) -> bool:
        """Commit a batch; False if its id was committed before, and nothing changes."""
        number, manifest = self._newest()
        if self._has(manifest, batch):
            return False
        folder = f"data/{uuid.uuid4().hex}"
        _summed(rows).coalesce(1).write.parquet(f"{self.path}/{folder}")  # a row for each key
        while not self._publish(number + 1, {**manifest, "since": {**manifest["since"], batch: folder}}):
            number, manifest = self._newest()
            if self._has(manifest, batch):
                self.fs.delete(self._at(folder), True)
                return False
        return True

    def _read(self, manifest: dict) -> DataFrame:
        folders = [*manifest["since"].values(), *([f"{manifest['fold']}/totals"] if manifest["fold"] else [])]
        if not folders:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*[f"{self.path}/{f}" for f in folders])

    def totals(self) -> DataFrame:
        return _summed(self._read(self._newest()[1])).where("n_docs <> 0 or n_tokens <> 0")

    def compact(self) -> None:
        """Fold all batches into one, and remove manifests and sums that are no longer listed."""
        while True:
            number, manifest = self._newest()
            if not manifest["since"]:
                return
            fold = f"data/{uuid.uuid4().hex}"
            _summed(self._read(manifest)).coalesce(1).write.parquet(f"{self.path}/{fold}/totals")
            ids = self.spark.createDataFrame([(b,) for b in sorted(manifest["since"])], "batch string").coalesce(1)
            (ids if manifest["fold"] is None else ids.unionByName(self._folded(manifest))).write.parquet(f"{self.path}/{fold}/ids")
            if self._publish(number + 1, {"fold": fold, "since": {}}):
                break
            self.fs.delete(self._at(fold), True)
        for n in self._listed("manifests"):
            if n.isdigit() and int(n) <= number:
                self.fs.delete(self._at(f"manifests/{n}"), False)
        for f in [*manifest["since"].values(), *([manifest["fold"]] if manifest["fold"] else [])]:
            self.fs.delete(self._at(f), True)


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


def copy_deltas(docs: DataFrame, version: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deletes of the documents whose text occurs with a smaller id too; those with a null id or text stay.

    Digests, keys, ids and counts are shuffled, no texts. Copies of one text are dealt by their ids first and
    then summed by source and language, so that a text that a third of all documents share is no one task's.
    """
    digest = F.unhex(F.sha2(F.col(text_col), 256)).alias("digest")
    key = [F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang")]
    rows = docs.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(digest, *key, F.col(id_col).alias("id"), n_tokens(version, text_col).alias("t"))
    each = rows.groupBy("digest", "source", "lang", "id").agg(F.count(F.lit(1)).alias("n"), F.max("t").alias("t"))
    own = each.groupBy("digest", "source", "lang").agg(F.sum("n").alias("n"), F.min(F.struct("id", "n")).alias("first"), F.max("t").alias("t"))
    least = F.min("first.id").over(Window.partitionBy("digest"))  # a row for each source and language
    gone = own.withColumn("least", least).withColumn("gone", F.col("n") - F.when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(0)).where("gone > 0")
    return gone.select("source", "lang", F.lit(version).alias("tokenizer_version"), (-F.col("gone")).alias("n_docs"), (-F.col("gone") * F.col("t")).alias("n_tokens"))
