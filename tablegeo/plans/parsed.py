"""A store of parses: documents are parsed once for each content, version and choice of pages, many at a time.

A call parses what the store lacks in one plan and reads the rest.  Under the store's folder (any that Spark writes to)
``data/<batch>`` holds a call's rows and ``manifest/<batch>`` the requests that it answered, those without rows, too.
The manifest's folder is renamed into its place after the data are written, so a call that is cut short leaves nothing
that is read, and its documents are parsed by the next one.  Calls may run side by side: if two parse one document,
the same batch is read by all that follow.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegeo.plans.session import state_key_column

ANSWERED = "entry string, batch string"


def working_folder(spark: SparkSession) -> str:
    """A new folder name below the shared one (``spark.checkpoint.dir``, else the checkpoint folder); where all runs on
    one machine and none is set, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            folder = current.get()
        elif spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
            folder = tempfile.mkdtemp(prefix="tablegeo-")
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{folder}/{uuid.uuid4().hex}"


def with_entry(requests: DataFrame) -> DataFrame:
    """Requests (doc_key, version, pages, and more) with ``entry``, what a parse is kept under.  No pages, or null, asks
    for all; a null version is an empty one; requests of no document are left out."""
    asked = requests.filter("doc_key is not null").withColumns({"doc_key": F.col("doc_key").cast("string"), "version": F.coalesce(F.col("version").cast("string"), F.lit(""))})
    key = F.concat_ws("|", state_key_column(F.col("doc_key"), F.col("pages")), F.col("version"))
    return asked.withColumn("entry", F.sha2(key, 256))


class ParseStore:
    """Parses by content, version and pages.  ``doc_key`` names a document's content (``session.content_key``)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _path(self, name: str) -> Any:
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _files(self) -> Any:
        return self._path("manifest").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def batches(self) -> list[str]:
        """The committed calls, one name for each call that parsed something."""
        return sorted(f.getPath().getName() for f in self._files().listStatus(self._path("manifest"))) if self._files().exists(self._path("manifest")) else []

    def manifest(self) -> DataFrame:
        """(entry, batch) of all committed calls."""
        names = self.batches()
        return self.spark.read.schema(ANSWERED).parquet(*(f"{self.folder}/manifest/{n}" for n in names)) if names else self.spark.createDataFrame([], ANSWERED)

    def missing(self, requests: DataFrame) -> DataFrame:
        """The requests that the store has no parse for, each entry once."""
        return with_entry(requests).join(self.manifest().select("entry"), "entry", "left_anti").dropDuplicates(["entry"])

    def parsed(self, requests: DataFrame, parse: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The rows of all requests, and ``reused``: was it in the store before this call?  ``parse`` gets the missing
        requests (their columns and ``entry``) and returns rows with their ``entry``.  Contents stay out of the
        requests, which are shuffled: ``parse`` finds them by doc_key.  Requests twice give their rows once."""
        batch = uuid.uuid4().hex
        self.missing(requests).withColumn("batch", F.lit(batch)).write.parquet(f"{self.folder}/staged/{batch}")
        wanted = self.spark.read.parquet(f"{self.folder}/staged/{batch}")
        if wanted.isEmpty():
            self._files().delete(self._path(f"staged/{batch}"), True)
        else:
            parse(wanted.drop("batch")).withColumn("batch", F.lit(batch)).write.parquet(f"{self.folder}/data/{batch}")
            self._files().mkdirs(self._path("manifest"))
            if not self._files().rename(self._path(f"staged/{batch}"), self._path(f"manifest/{batch}")):
                raise OSError(f"{self.folder}: batch {batch} could not be committed")
        return self.stored(requests).withColumn("reused", F.col("batch") != batch).drop("batch")

    def stored(self, requests: DataFrame) -> DataFrame:
        """What the store has for the requests, with the ``batch`` each row is of.  Only batches that are asked for are
        read; their names, one for each earlier call, are what the driver sees."""
        asked = with_entry(requests).select("entry").distinct()
        found = self.manifest().join(asked, "entry", "left_semi").groupBy("entry").agg(F.min("batch").alias("batch"))
        names = sorted(r.batch for r in found.select("batch").distinct().collect())
        if not names:
            return self.spark.createDataFrame([], ANSWERED)
        rows = self.spark.read.option("mergeSchema", True).parquet(*(f"{self.folder}/data/{n}" for n in names))
        return rows.join(found, ["entry", "batch"], "left_semi")
