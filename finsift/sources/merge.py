"""Tables with keys that rows are merged into: hash-bucketed Parquet folders and a manifest that is written last.

A merge reads and rewrites only the buckets that its rows fall into. Their new folders become part of the table by the
manifest of the next version, whose file is created last and never overwritten: a merge that fails before leaves the table
as it was, and of two merges that start from one version the later one fails. Old folders stay for readers until vacuum().
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StructType

from finsift.storage import create_bytes, exists, listed, read_bytes, release


class MergeTable:
    """A table at path with unique keys (null keys are equal to each other). buckets counts for a new table only."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 16):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets

    def versions(self) -> list[int]:
        names = listed(self.spark, f"{self.path}/manifest") if exists(self.spark, f"{self.path}/manifest") else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """{version, keys, n, schema, folders by bucket} of a version, the last one if none is named; version 0 is empty."""
        held = self.versions()
        if version is None:
            version = held[-1] if held else 0
        if not version:
            return {"version": 0, "keys": self.keys, "n": self.buckets, "schema": None, "folders": {}}
        return json.loads(read_bytes(self.spark, f"{self.path}/manifest/{version:012d}.json"))

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version; nothing where the table was never written."""
        told = self.manifest(version)
        return self._rows(told, list(told["folders"])) if told["schema"] else None

    def count(self) -> int:
        rows = self.read()
        return rows.count() if rows is not None else 0

    def _rows(self, told: dict, buckets: list[str]) -> DataFrame:
        schema = StructType.fromJson(json.loads(told["schema"]))
        paths = [f"{self.path}/data/{told['folders'][b]}/_bucket={b}" for b in buckets if b in told["folders"]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def merge(self, rows: DataFrame, how: str = "replace", order: str | None = None) -> int:
        """The new version, with rows merged in by key; of rows with the same key the one that is last by `order` wins.

        replace: a row takes the place of the one there was. fill: of each column, and of each entry of a map column, the
        last value that is not null stays. Columns that either side lacks are null there. Without `order`, which of
        several rows wins is decided by their values, the same on every run.
        """
        told = self.manifest()
        data = [c for c in rows.columns if c != order]
        values = [F.to_json(F.struct(f"`{c}`")) for c in data if c not in self.keys] or [F.lit(0)]
        new = rows.select(*(f"`{c}`" for c in data), F.struct(F.lit(1).alias("new"), (F.col(f"`{order}`").cast("long") if order else F.lit(0).cast("long")).alias("place"), F.xxhash64(*values).alias("tie")).alias("_order"))
        bucket = F.pmod(F.xxhash64(*(f"`{k}`" for k in self.keys)), F.lit(told["n"])).cast("int")
        touched = [str(r[0]) for r in new.select(bucket).distinct().collect()]  # at most n
        if not touched:
            return told["version"]
        if told["schema"]:
            zero = F.struct(F.lit(0).alias("new"), F.lit(0).cast("long").alias("place"), F.lit(0).cast("long").alias("tie"))
            new = self._rows(told, touched).withColumn("_order", zero).unionByName(new, allowMissingColumns=True)
        merged = (self._replaced if how == "replace" else self._filled)(new)
        folder = uuid.uuid4().hex
        merged.withColumn("_bucket", bucket).hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/data/{folder}")
        after = told | {"version": told["version"] + 1, "keys": self.keys, "schema": merged.schema.json(), "folders": told["folders"] | dict.fromkeys(touched, folder)}
        create_bytes(self.spark, f"{self.path}/manifest/{after['version']:012d}.json", json.dumps(after).encode())
        return after["version"]

    def _replaced(self, rows: DataFrame) -> DataFrame:
        others = [c for c in rows.columns if c not in (*self.keys, "_order")]
        last = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*(f"`{c}`" for c in others)), "_order").alias("_last")) if others else rows.select(*self.keys).distinct()
        return last.select(*self.keys, "_last.*") if others else last

    def _filled(self, rows: DataFrame) -> DataFrame:
        kinds = {f.name: f.dataType for f in rows.schema.fields}
        others = [c for c in rows.columns if c not in (*self.keys, "_order")]
        flat = [c for c in others if not isinstance(kinds[c], MapType)]
        last = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("_order")))
        out = rows.groupBy(*self.keys).agg(F.count("*").alias("_n"), *(last(f"`{c}`").alias(c) for c in flat))
        for c in (c for c in others if c not in flat):
            # Entries one by one, so that a key with many writes is added up in parts.
            entries = rows.select(*self.keys, "_order", F.explode(f"`{c}`").alias("_key", "_value")).groupBy(*self.keys, "_key").agg(last("_value").alias("_value"))
            one = entries.groupBy(*self.keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("_key", "_value")))).alias(c))
            right = one.select(*(F.col(k).alias(f"_r_{k}") for k in self.keys), c)
            same = [out[k].eqNullSafe(right[f"_r_{k}"]) for k in self.keys]
            condition = same[0]
            for s in same[1:]:
                condition = condition & s
            out = out.join(right, condition, "left").drop(*(f"_r_{k}" for k in self.keys)).withColumn(c, F.coalesce(F.col(c), F.create_map().cast(kinds[c])))
        return out.select(*self.keys, *others)

    def vacuum(self, keep: int = 1) -> int:
        """Deletes all but the last `keep` versions and the folders that only those used; returns the folders deleted."""
        held = self.versions()
        used = {f for v in held[-keep:] for f in self.manifest(v)["folders"].values()}
        gone = [f for f in (listed(self.spark, f"{self.path}/data") if held else []) if f not in used]
        release(self.spark, *(f"{self.path}/manifest/{v:012d}.json" for v in held[:-keep]), *(f"{self.path}/data/{f}" for f in gone))
        return len(gone)
