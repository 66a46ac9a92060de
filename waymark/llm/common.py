"""What the operators of this subpackage share: intermediate tables, let-bindings, words."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space, tab, line feed, vertical tab, form feed and carriage return.
BLANK = r"[\x20\x09-\x0D]"
BLANK_CHARS = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, one is set if all run on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


_live: "weakref.WeakSet[Tables]" = weakref.WeakSet()


class Tables:
    """Intermediate tables of one run, written as Parquet to the shared folder.

    A written table cuts the lineage: a lost executor costs the tasks that read it, never the plan before it.
    Tables that a returned DataFrame still reads stay until the session ends; drop() removes the others early.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.count = 0
        _live.add(self)

    def put(self, df: DataFrame, codec: str = "zstd") -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.option("compression", codec).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._table_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            self._delete(df._table_path)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def close(self) -> None:
        self._delete(self.root)


@atexit.register
def _close_all() -> None:
    for tables in list(_live):
        try:
            if tables.spark.sparkContext._jsc is not None:
                tables.close()
        except Exception:  # the session is gone, and with it the means to delete
            return


def let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda variable, which the optimizer doesn't inline."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, f"{BLANK}+"), lambda w: w != "")


def crc32_of_id(doc_id: Column) -> Column:
    """Unsigned CRC-32 of the id as text."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files of finished rounds now; it does so when the driver collects its garbage, which in a
    short loop over wide rows may come too late for the disks."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()
