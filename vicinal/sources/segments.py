"""A versioned store of records: immutable parquet segments, a tombstone table, and a manifest that names the current ones.

Each version of the manifest is one small JSON file, written through Spark's file system, so that the folder may lie in
any store; readers take the newest. A record lives in exactly one segment unless a tombstone of a later generation
hides it. What belongs together is published in one version. Compaction merges the oldest segments and drops what is hidden.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import StoreError

RECORD = "row_num bigint, terms array<string>, values array<float>, metadata map<string,string>"


class SegmentStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # The file system of the path, as Spark sees it.
    def _fs(self, name: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(name)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _versions(self) -> list[int]:
        fs, p = self._fs(f"{self.path}/manifest")
        if not fs.exists(p):
            return []
        return sorted(int(s.getPath().getName().split(".")[0]) for s in fs.listStatus(p) if s.getPath().getName().endswith(".json"))

    def manifest(self) -> dict:
        """generation, segments [{gen, path, rows}], tombstones [{gen, path}]: oldest first."""
        versions = self._versions()
        if not versions:
            return {"generation": 0, "next_row": 0, "segments": [], "tombstones": []}
        rows = self.spark.read.text(f"{self.path}/manifest/{versions[-1]:012d}.json", wholetext=True).first()
        return json.loads(rows[0])

    def publish(self, manifest: dict) -> None:
        """A new version, whole at once: it is written under a name of its own and then renamed. Fails if another writer was first.

        Renaming without overwriting is atomic on HDFS and local disks. An object store whose rename is not must have one writer only.
        """
        version = (self._versions() or [0])[-1] + 1
        fs, p = self._fs(f"{self.path}/manifest/{version:012d}.json")
        _, draft = self._fs(f"{self.path}/manifest/.draft-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(json.dumps(manifest).encode())
        out.close()
        if fs.exists(p) or not fs.rename(draft, p):
            fs.delete(draft, False)
            raise StoreError(f"version {version} of {self.path} was published by another writer")

    def write(self, df: DataFrame, what: str) -> str:
        path = f"{self.path}/{what}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path

    def change(self, records: DataFrame | None = None, gone: DataFrame | None = None, next_row: int | None = None, **more) -> dict:
        """Tombstones for gone in all segments so far, a new segment of records, and anything else the manifest is to say, in one version."""
        m = self.manifest()
        gen = m["generation"]
        if gone is not None:
            gen += 1
            m["tombstones"].append({"gen": gen, "path": self.write(gone.select(F.col("row_num").cast("bigint")), "tombstones")})
        if records is not None:
            gen += 1
            path = self.write(records.select("row_num", "terms", "values", "metadata"), "segment")
            m["segments"].append({"gen": gen, "path": path, "rows": self.spark.read.parquet(path).count()})
        m["generation"] = gen
        if next_row is not None:
            m["next_row"] = next_row
        self.publish(m | more)
        return m | more

    def append(self, records: DataFrame, next_row: int | None = None) -> dict:
        """A new segment of the next generation."""
        return self.change(records, None, next_row)

    def delete(self, row_nums: DataFrame) -> dict:
        """Tombstones that hide these rows in all segments so far."""
        return self.change(None, row_nums)

    def segment(self, entry: dict, m: dict | None = None) -> DataFrame:
        """Visible rows of one segment."""
        m = m or self.manifest()
        rows = self.spark.read.schema(RECORD).parquet(entry["path"])
        hidden = [t["path"] for t in m["tombstones"] if t["gen"] > entry["gen"]]
        return rows.join(self.spark.read.schema("row_num bigint").parquet(*hidden), "row_num", "left_anti") if hidden else rows

    def visible(self) -> DataFrame:
        m = self.manifest()
        out = self.spark.createDataFrame([], RECORD)
        for entry in m["segments"]:
            out = out.unionByName(self.segment(entry, m))
        return out

    def compact(self, most_segments: int) -> dict:
        """Merge the oldest segments into one while there are more than allowed; tombstones that hide nothing any more go."""
        m = self.manifest()
        if len(m["segments"]) <= max(1, most_segments):
            return m
        n = len(m["segments"]) - most_segments + 1
        old = m["segments"][:n]
        merged = self.segment(old[0], m)
        for entry in old[1:]:
            merged = merged.unionByName(self.segment(entry, m))
        path = self.write(merged, "segment")
        # All tombstones are applied to the merged segment, so it counts as younger than those that precede what follows.
        following = m["segments"][n:]
        applied = [t["gen"] for t in m["tombstones"] if not following or t["gen"] < following[0]["gen"]]
        gen = max([old[-1]["gen"], *applied])
        m["segments"] = [{"gen": gen, "path": path, "rows": self.spark.read.parquet(path).count()}, *following]
        oldest = min(s["gen"] for s in m["segments"])
        m["tombstones"] = [t for t in m["tombstones"] if t["gen"] > oldest]
        self.publish(m)
        return m
