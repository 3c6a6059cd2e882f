"""What the operators of this subpackage share: the work folder, cut tables, shipped code."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space. The same in Python, Java and RE2.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, a local master gets a temporary folder and a cluster a
    folder beside the warehouse, which is shared too.
    """
    sc = spark.sparkContext
    set_by_cluster = sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_unitweave_dir", None)
    if not set_by_cluster:
        if sc.master.startswith("local[") or sc.master == "local":
            set_by_cluster = tempfile.mkdtemp(prefix="unitweave-")
        else:
            set_by_cluster = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_unitweave"
        sc._unitweave_dir = set_by_cluster
    return set_by_cluster.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back.

    The lineage ends there: a lost executor costs the tasks that were running, no
    earlier stage. The committed files are also what makes ids that depend on the
    partitioning stable for whatever reads them later.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._unitweave_path = path
    return back


def drop_cut(df: DataFrame) -> None:
    """Deletes a table made by cut() that nothing reads any more."""
    path = getattr(df, "_unitweave_path", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def ship(spark: SparkSession) -> None:
    """Makes this package importable in the executors' Python workers, once a context."""
    sc = spark.sparkContext
    if getattr(sc, "_unitweave_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    out = os.path.join(tempfile.mkdtemp(prefix="unitweave-code-"), "unitweave_code.zip")
    with zipfile.ZipFile(out, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    sc.addPyFile(out)
    sc._unitweave_shipped = True


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_mod(doc_id: Column, m: int) -> Column:
    """crc32 of the id written as text, modulo m; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % m


def crc32_divides(doc_id: Column, m: int) -> Column:
    """Does m divide the unsigned crc32 of the id as text? Null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % m == 0


def need(df: DataFrame, *names: str) -> DataFrame:
    """Only the columns asked for, so that others, whatever their names, never clash."""
    return df.select(*[df[n] for n in names])
