"""Keyed tables that are kept by merging batches of changes, bucket by bucket.

Rows live in buckets by the hash of their key. A batch reads and rewrites the
buckets that it has keys of, and a manifest then names each bucket's folder and, for
each stream of changes, the last batch that is in. Manifests are committed as in
`versions`: whole, numbered and never changed. A batch that comes again, as after
a crash, is already in and changes nothing; of two writers one merges anew into what the other has committed.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.sources.versions import _Files

RULES = ("sum", "max", "newest")


@dataclass
class KeyedTable:
    """keys and, for each other column, its rule: sum and max take old and new values together, newest takes all such columns
    from the row with the greatest `version`, the later one of equal ones; a lower version never replaces a higher one."""

    spark: SparkSession
    folder: str
    schema: str
    keys: list[str]
    rules: dict[str, str]
    version: str | None = None
    buckets: int = 64
    rewritten: list[int] = field(default_factory=list)

    def __post_init__(self) -> None:
        if unknown := set(self.rules.values()) - set(RULES):
            raise ValueError(f"unknown rules {unknown}")
        if "newest" in self.rules.values() and self.version is None:
            raise ValueError("newest needs a version column")
        self.files = _Files(self.spark, self.folder)

    def _manifest(self) -> dict:
        names = sorted((n for n, _ in self.files.names(f"{self.folder}/commits") if n.endswith(".json")), reverse=True)
        return json.loads(self.files.read(f"{self.folder}/commits/{names[0]}")) if names else {"number": 0, "buckets": {}, "applied": {}, "of": self.buckets}

    def _bucket(self, of: int) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(of)).cast("int")

    def _merged(self, rows: DataFrame) -> DataFrame:
        """One row for each key of rows, which have age_: 0 for what the table holds, 1 for changes."""
        aggregates = []
        newest = F.struct(F.col(self.version), F.col("age_")) if self.version else None
        for name, rule in self.rules.items():
            value = {"sum": F.sum(name), "max": F.max(name), "newest": F.max_by(name, newest) if newest is not None else None}[rule]
            aggregates.append(value.alias(name))
        if self.version and self.version not in self.rules:
            aggregates.append(F.max(self.version).alias(self.version))
        return rows.groupBy(*self.keys).agg(*aggregates)

    def rows(self) -> DataFrame:
        """What the table holds."""
        folders = [f"{self.folder}/data/{f}" for f in self._manifest()["buckets"].values()]
        empty = self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else empty

    def apply(self, changes: DataFrame, stream: str, batch: int) -> bool:
        """Merges a batch of changes, unless it is in already; says whether it was merged. Batches of a stream are numbered upwards."""
        columns = self.spark.createDataFrame([], self.schema).columns
        own = self._merged(changes.select(*columns).withColumn("age_", F.lit(1)))
        while True:
            now = self._manifest()
            if now["applied"].get(stream, -1) >= batch:
                return False
            marked = own.select(*columns, self._bucket(now["of"]).alias("bucket_"))
            touched = sorted(r["bucket_"] for r in marked.select("bucket_").distinct().collect())  # a number per bucket at most
            folders = {}
            if touched:
                held = [f"{self.folder}/data/{now['buckets'][str(b)]}" for b in touched if str(b) in now["buckets"]]
                both = marked.withColumn("age_", F.lit(1))
                if held:
                    old = self.spark.read.schema(self.schema).parquet(*held)
                    both = old.select(*columns, self._bucket(now["of"]).alias("bucket_"), F.lit(0).alias("age_")).unionByName(both)
                name = uuid.uuid4().hex
                merged = self._merged(both).select(*columns).withColumn("bucket_", self._bucket(now["of"]))
                # buckets that share a task are files of their own folders
                merged.repartition("bucket_").write.partitionBy("bucket_").parquet(f"{self.folder}/data/{name}")
                folders = {str(b): f"{name}/bucket_={b}" for b in touched}
            after = {"number": now["number"] + 1, "of": now["of"], "buckets": now["buckets"] | folders, "applied": now["applied"] | {stream: batch}}
            if self.files.put_new(f"{self.folder}/commits/{after['number']:020d}.json", json.dumps(after, sort_keys=True).encode()):
                self.rewritten = touched
                return True
            if folders:  # another writer was first: merge into what it has left
                self.files.delete(f"{self.folder}/data/{name}")
