"""A store of fitted Spark ML models by fingerprint: what they were fitted on and how."""

from __future__ import annotations

import hashlib
import json

from pyspark.ml.util import MLReadable, MLWritable
from pyspark.sql import SparkSession


def fingerprint(scope: list, kind: str, **parameters) -> str:
    """One digest of the scope's ids, the kind of model and its parameters."""
    return hashlib.md5(json.dumps([sorted(map(str, scope)), kind, dict(sorted(parameters.items()))], sort_keys=True).encode()).hexdigest()


def path(root: str, key: str) -> str:
    return f"{root.rstrip('/')}/models/{key}"


def store(model: MLWritable, root: str, key: str) -> None:
    """Writes a model, in place of one with the same key."""
    model.write().overwrite().save(path(root, key))


def find(spark: SparkSession, kind: type[MLReadable], root: str, key: str):
    """The stored model, or None."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path(root, key))
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    return kind.load(path(root, key))
