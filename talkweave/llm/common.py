"""What the operators of this subpackage share: the shared folder, written tables, code shipping."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from talkweave.session import ship  # noqa: F401

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where a public vocabulary file lies on this machine; resolved on the executor that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


def workspace(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a URI without a trailing slash.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session may go without;
    it then gets a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or None
    if base is None:
        base = spark.sparkContext.getCheckpointDir()
        if base is not None:
            base = base.rsplit("/", 1)[0]
    if base is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="talkweave-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/") if "://" in base else "file://" + os.path.abspath(base)


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one. What a result is read from can't be deleted before that
    result has been; the folder is therefore deleted when the application ends, or by dropped()."""
    path = f"{workspace(spark)}/talkweave/{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop)
    fs.deleteOnExit(hadoop)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet below the shared folder and return the reread table.

    This cuts the lineage: a lost executor takes nothing along, since the files are shared.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.mode("append").option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._talkweave_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete the files of a written table that nothing reads any more."""
    path = getattr(df, "_talkweave_path", None)
    if path is None:
        return
    spark = df.sparkSession
    jvm = spark._jvm
    with contextlib.suppress(Exception):  # what stays behind only costs disk
        hadoop = jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shielded(df: DataFrame, needed: tuple[str, ...]):
    """df with its other columns under names that clash with nothing, and a function that gives a
    result its columns back in the old order and under the old names."""
    from pyspark.sql import functions as F

    names = {c: c if c in needed else f"extra_{i}__" for i, c in enumerate(df.columns)}
    hidden = df.select(*[F.col("`" + c.replace("`", "``") + "`").alias(names[c]) for c in df.columns])
    return hidden, lambda out: out.select(*[F.col(names[c]).alias(c) for c in df.columns])


def open_fs(uri: str):
    """The Arrow file system of a URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)
