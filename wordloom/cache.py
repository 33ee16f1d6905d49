"""Results that are kept: under a fingerprint of the corpus, the name of what was computed and its parameters.

A second question with the same parameters reads what the first one wrote, in this session or a later one.  Another corpus
has another fingerprint, whatever its path; results of corpora that are gone are dropped by fingerprint."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.storage import shared_dir


def fingerprint(df: DataFrame) -> str:
    """Of a table's rows and columns, in whatever order the rows stand; one pass, a few numbers."""
    names = sorted(df.columns)
    row = [F.xxhash64(F.lit(salt), *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in names)) for salt in (1, 2)]
    r = df.agg(F.count("*").alias("n"), *(F.bit_xor(h).alias(f"x{i}") for i, h in enumerate(row)), *(F.sum(F.pmod(h, F.lit(1 << 31))).alias(f"s{i}") for i, h in enumerate(row))).first()
    return hashlib.sha256(json.dumps([sorted(df.dtypes), *r], default=str).encode()).hexdigest()[:32]


class Results:
    """version: a corpus's fingerprint.  root: the shared folder, unless another one is named."""

    def __init__(self, spark: SparkSession, version: str, root: str | None = None):
        self.spark, self.version = spark, version
        self.root = f"{(root or shared_dir(spark)).rstrip('/')}/wordloom-results"

    @classmethod
    def of(cls, documents: DataFrame, root: str | None = None) -> Results:
        return cls(documents.sparkSession, fingerprint(documents), root)

    def _path(self, path: str) -> tuple[Any, Any]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), at

    def where(self, name: str, params: dict[str, Any]) -> str:
        key = hashlib.sha256(json.dumps([name, params], sort_keys=True, default=str).encode()).hexdigest()[:32]
        return f"{self.root}/{self.version}/{name}-{key}"

    def get(self, name: str, params: dict[str, Any], make: Callable[[], DataFrame]) -> DataFrame:
        """The kept result, or what make gives, which is kept.  A write that did not end leaves no mark of success and is made again."""
        path = self.where(name, params)
        fs, done = self._path(f"{path}/_SUCCESS")
        if not fs.exists(done):
            make().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def drop(self, version: str | None = None) -> None:
        """Forget a version's results; this one's, if none is named."""
        fs, at = self._path(f"{self.root}/{version or self.version}")
        fs.delete(at, True)

    def versions(self) -> list[str]:
        fs, at = self._path(self.root)
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []
