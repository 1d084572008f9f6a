"""What the operators share: the folder all executors see, tables that cut lineage, and column helpers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

_own: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one only if it is unset on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="spark-quire-")
        atexit.register(shutil.rmtree, _own["dir"], ignore_errors=True)
    return f"file://{_own['dir']}"


def fresh_dir(spark: SparkSession, tag: str) -> str:
    """A new path below the shared folder (not created yet)."""
    return f"{scratch_root(spark)}/quire/{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder once and read it back: lineage ends here, and a lost executor loses nothing."""
    path = fresh_dir(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` doesn't have (names that differ in case alone are the same to Spark)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_of(name: str) -> Column:
    """A text column in which null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def fold_ascii(c: Column) -> Column:
    """Lower-case A-Z and nothing else (``lower`` alone would fold other alphabets too)."""
    plain = F.length(c) == F.octet_length(c)
    return F.when(plain, F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def fold_bucket(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def hash_sample(rows: DataFrame, key: Column, n: int) -> DataFrame:
    """The rows whose hash is among the ``n`` least distinct ones: a bounded sample that only depends on the rows. The
    hashes alone are sorted; rows with equal keys (copies) come in together, so make them distinct where they may be many."""
    least = rows.select(key.alias("h")).distinct().orderBy("h").limit(n).agg(F.max("h")).first()[0]
    return rows.where(key <= F.lit(least)) if least is not None else rows.limit(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
