"""A bucketed table of bars into which windows are upserted.

Symbols are dealt over a fixed number of buckets.  An upsert reads and rewrites
only the (namespace, timeframe, bucket) folders that its symbols fall into; the
new files go to a folder of their own, and the table changes when the list of
its folders is replaced, which is one rename.  Until then, and if the job fails,
readers see the old list.  Two upserts at a time cannot both commit: the second
finds the version taken and fails before the list changes.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.resample import BAR
from .bars import SCHEMA

_KEYS = ["namespace", "timeframe", "bucket"]


class BarStore:
    """``path`` is a folder that all executors share; ``buckets`` is fixed when the table is made."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, path: str):
        return self._hadoop.Path(path)

    def _versions(self, ending: str) -> list[int]:
        folder = self._at(f"{self.path}/versions")
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n.removesuffix(ending)) for n in names if n.endswith(ending))

    def manifest(self, version: int | None = None) -> tuple[int, dict[tuple[str, str, int], str]]:
        """The last version (0 before the first), or a given one, and the folder of each (namespace, timeframe, bucket)."""
        last = max(self._versions(".json"), default=0) if version is None else version
        if not last:
            return 0, {}
        text = self.spark.read.option("wholetext", True).text(f"{self.path}/versions/{last:010d}.json").first()[0]
        held = json.loads(text)
        if held["buckets"] != self.buckets:
            raise ValueError(f"{self.path} has {held['buckets']} buckets")
        return last, {(n, t, b): folder for n, t, b, folder in held["folders"]}

    def _read(self, folders: list[str]) -> DataFrame:
        paths = [f"{self.path}/data/{f}" for f in folders]
        return self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)

    def _bucket(self):
        return F.pmod(F.xxhash64("symbol"), F.lit(self.buckets)).cast("int")

    def read(self, namespace: str, timeframe: str, symbols: list[str] | None = None, version: int | None = None) -> DataFrame:
        """Bars of a timeframe; with ``symbols`` only the buckets that can hold them are opened."""
        _, folders = self.manifest(version)
        wanted = None
        if symbols is not None:
            named = self.spark.createDataFrame([(s,) for s in symbols], "symbol string")
            wanted = {r[0] for r in named.select(self._bucket()).collect()}
        df = self._read([f for (n, t, b), f in sorted(folders.items()) if n == namespace and t == timeframe and (wanted is None or b in wanted)])
        return df if symbols is None else df.filter(F.col("symbol").isin(symbols))

    def upsert(self, new: DataFrame, window: int) -> int:
        """Put bars (namespace, timeframe, symbol, ts, prices, volume) over the stored ones and keep the last ``window`` of each symbol; returns the version.

        New bars win; of several new bars of one time the greatest does.
        """
        version, folders = self.manifest()
        if self._versions(".lock")[-1:] > [version]:
            raise RuntimeError(f"an upsert of {self.path} is under way or has died; unlock() after a death")
        cols = ["namespace", "timeframe", *BAR]
        new = new.select(*cols).withColumn("bucket", self._bucket())
        touched = {tuple(r) for r in new.select(*_KEYS).distinct().collect()}  # buckets x timeframes at most
        if not touched:
            return version
        old = self._read([f for k, f in sorted(folders.items()) if k in touched]).withColumn("bucket", self._bucket())
        one = Window.partitionBy("namespace", "timeframe", "bucket", "symbol", "ts").orderBy(F.desc("_new"), *[F.desc_nulls_last(c) for c in BAR[2:]])
        last = Window.partitionBy("namespace", "timeframe", "bucket", "symbol").orderBy(F.desc("ts"))
        both = new.withColumn("_new", F.lit(1)).unionByName(old.withColumn("_new", F.lit(0))).repartition(*_KEYS)
        kept = both.withColumn("_r", F.row_number().over(one)).filter("_r = 1").withColumn("_r", F.row_number().over(last)).filter(F.col("_r") <= window)
        made = uuid.uuid4().hex
        parts = kept.withColumns({f"_{k}": F.col(k) for k in _KEYS}).select(*[f"_{k}" for k in _KEYS], *cols)
        parts.write.partitionBy(*[f"_{k}" for k in _KEYS]).parquet(f"{self.path}/data/{made}")
        folders |= {(n, t, b): f"{made}/_namespace={n}/_timeframe={t}/_bucket={b}" for n, t, b in touched}
        self._commit(version + 1, folders)
        return version + 1

    def _commit(self, version: int, folders: dict[tuple[str, str, int], str]) -> None:
        name = f"{self.path}/versions/{version:010d}"
        if not self._fs.createNewFile(self._at(f"{name}.lock")):
            raise RuntimeError(f"version {version} of {self.path} is taken")
        out = self._fs.create(self._at(f"{name}.writing"), True)
        out.write(bytearray(json.dumps({"buckets": self.buckets, "folders": [[*k, f] for k, f in sorted(folders.items())]}).encode()))
        out.close()
        if not self._fs.rename(self._at(f"{name}.writing"), self._at(f"{name}.json")):
            raise RuntimeError(f"version {version} of {self.path} could not be committed")

    def unlock(self) -> None:
        """Free a version that an upsert took and never committed."""
        for v in set(self._versions(".lock")) - set(self._versions(".json")):
            self._fs.delete(self._at(f"{self.path}/versions/{v:010d}.lock"), False)

    def vacuum(self) -> int:
        """Delete folders that the last version does not name, which older readers may still use; returns how many."""
        _, folders = self.manifest()
        named, gone = set(folders.values()), 0
        pattern = self._at(f"{self.path}/data/*/_namespace=*/_timeframe=*/_bucket=*")
        for status in self._fs.globStatus(pattern) or []:
            if "/".join(status.getPath().toString().split("/")[-4:]) not in named:
                gone += bool(self._fs.delete(status.getPath(), True))
        return gone
