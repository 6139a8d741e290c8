"""Tables that cut lineage, kept in the folder the cluster shares.

The folder is ``spark.checkpoint.dir``. Where that is unset a folder under the system's temporary
one is set for the session, if all of Spark runs on this machine; on a cluster, where other machines
would not see it, that is an error.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder, set for the session where the cluster names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = f"file://{tempfile.gettempdir()}/grafloom-checkpoints"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/grafloom/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def drop(df: DataFrame) -> None:
    """Delete the files of a table made here that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def model_dir(spark: SparkSession, name: str) -> str:
    """A new folder for files that workers map into memory.

    Mapping needs a mounted file system, so the shared folder must be a ``file:`` URI or a
    plain path here (NFS, Lustre, a mounted object store); any other scheme is an error.
    """
    base = urlparse(shared_dir(spark))
    if base.scheme not in ("", "file"):
        raise ValueError(f"memory mapping needs a mounted shared folder, not {base.scheme}://")
    path = f"{base.path}/grafloom/{uuid.uuid4().hex}/{name}"
    os.makedirs(path)
    return path


def put(path: str, data: bytes) -> None:
    """Write a file whole or not at all: retried and speculative tasks may write it twice."""
    own = f"{path}.{uuid.uuid4().hex}"
    with open(own, "wb") as f:
        f.write(data)
    os.replace(own, path)
