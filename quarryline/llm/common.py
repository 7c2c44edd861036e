"""Helpers that the corpus operators share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Copies of a hot key's other side in salted joins.
SALTS = 16


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_quarryline_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="quarryline")
    target = os.path.join(folder, "quarryline_pkg.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(target)
    sc._quarryline_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.

    Only where that is unset (tests on one machine) a folder of this machine is taken.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        base = getattr(spark.sparkContext, "_quarryline_local", None)
        if base is None:
            base = "file://" + tempfile.mkdtemp(prefix="quarryline-shared")
            spark.sparkContext._quarryline_local = base
    return base.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark)}/quarryline-{app}/{tag}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop_materialized(df: DataFrame) -> None:
    """Delete the files behind a materialize()d frame that no later plan reads."""
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        if "/quarryline-" in folder:
            remove_path(df.sparkSession, folder)


def hash128(*cols: Column) -> Column:
    """Two independently seeded 64-bit hashes as one comparable struct."""
    return F.struct(F.xxhash64(*cols).alias("a"), F.xxhash64(F.lit(0x5BD1), *cols[::-1]).alias("b"))


def salt(*cols: Column) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(SALTS)).cast("int")


def salts() -> Column:
    """To explode: a row of the small side for each salt."""
    return F.sequence(F.lit(0), F.lit(SALTS - 1))
