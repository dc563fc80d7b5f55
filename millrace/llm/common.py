"""Helpers shared by the operators: tables, the shared folder, skew-safe lookups."""

from __future__ import annotations

import functools
import io
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE = Path(__file__).resolve().parent.parent

#: A word is a run of characters other than space and code points 9 to 13; bytes.split()
#: parts UTF-8 at the same ones.
WORD = r"[^\x20\x09-\x0D]+"
_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))


def lower_words(text: str) -> list[bytes]:
    """The words of a text in UTF-8, A-Z lower-cased and nothing else."""
    return text.encode().translate(_LOWER).split()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once per application."""
    context = spark.sparkContext
    if getattr(context, "_millrace_shipped", False):
        return
    folder = Path(tempfile.mkdtemp(prefix="millrace-code-"))
    target = folder / "millrace_code.zip"
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        for file in sorted(PACKAGE.rglob("*.py")):
            archive.write(file, str(Path(PACKAGE.name) / file.relative_to(PACKAGE)))
    target.write_bytes(buffer.getvalue())
    context.addPyFile(str(target))
    context._millrace_shipped = True


@functools.lru_cache(maxsize=1)
def _local_shared_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="millrace-shared-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session, else
    the checkpoint folder of its context. On one machine, where both are unset (tests), a folder
    of our own; on a cluster that is an error, as each executor would write to its own disk."""
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if path:
        return path.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = _local_shared_dir()
    context.setCheckpointDir(path)
    return path


#: Intermediate tables of this process that were not removed yet.
_STAGED: list[str] = []


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and survives lost executors.
    The table stays until ``forget_staged``, since what is returned may be read any time."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/millrace-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _STAGED.append(path)
    return spark.read.schema(df.schema).parquet(path)


def staged_paths() -> list[str]:
    return list(_STAGED)


def forget_staged(spark: SparkSession, paths: list[str]) -> None:
    """Remove intermediate tables; nothing that reads them may be used any more."""
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _STAGED.remove(name)


def blocks_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def in_two_stages(df: DataFrame) -> DataFrame:
    """Deal an aggregated side by all its columns, evenly, so that a join on its key shuffles
    both sides anew and adaptive execution may split a hot key's partition of the other."""
    return df.repartition(blocks_of(df.sparkSession), *df.columns)


def held_out(key: str, modulus: int) -> Column:
    """crc32 of the key as text has remainder 2; false where the key is null."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % modulus == 2, F.lit(False))
