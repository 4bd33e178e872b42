"""A table of the latest row of each path, written batch by batch, in sorted generations.

Each batch is a run of its own. ``FAN`` runs of a level are merged into one of the next, of each path the row of
the newest batch; marks of deleted paths go when nothing older is left. So a read meets some ``FAN`` runs a level
and a level for every factor of ``FAN`` in the number of batches, and a row is rewritten once a level. What counts is the
newest manifest, which is renamed into place after its runs are written: a batch that runs again
changes nothing, one that died leaves runs that no manifest names and the next try replaces.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Runs of a level that are merged.
FAN = 8
DELETED, BATCH = "deleted", "batch"


def newest(rows: DataFrame) -> DataFrame:
    """Of each path the row of the newest batch; one row a batch is expected."""
    rest = [c for c in rows.columns if c not in ("path", BATCH)]
    best = rows.groupBy("path").agg(F.max_by(F.struct(*rest, BATCH), BATCH).alias("r"))
    return best.select("path", *(F.col(f"r.{c}") for c in rest), F.col(f"r.{BATCH}"))


class Store:
    def __init__(self, spark: SparkSession, path: str, fan: int = FAN):
        self.spark, self.path, self.fan = spark, path.rstrip("/"), fan
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))

    def _manifests(self) -> list[int]:
        folder = self._at("manifests")
        found = self._fs.listStatus(folder) if self._fs.exists(folder) else []
        return sorted(int(s.getPath().getName()) for s in found if s.getPath().getName().isdigit())

    def manifest(self) -> dict:
        """``batch``, ``schema`` and live ``runs`` (name, level); of an empty store batch -1 and no runs."""
        numbers = self._manifests()
        if not numbers:
            return {"batch": -1, "schema": None, "runs": []}
        stream = self._fs.open(self._at(f"manifests/{numbers[-1]:012d}"))
        try:
            return json.loads(bytes(self._hadoop.thirdparty.com.google.common.io.ByteStreams.toByteArray(stream)))
        finally:
            stream.close()

    def _read(self, manifest: dict, names: list[str]) -> DataFrame:
        schema = StructType.fromJson(manifest["schema"])
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{n}" for n in names)) if names else self.spark.createDataFrame([], schema)

    def rows(self, *columns: str) -> DataFrame | None:
        """The newest row of each path, with these columns or all, marks of deleted ones included; none if nothing was ever written."""
        m = self.manifest()
        if not m["schema"]:
            return None
        every = self._read(m, [n for n, _ in m["runs"]])
        return newest(every.select("path", *columns, BATCH) if columns else every)

    def current(self) -> DataFrame:
        found = self.rows()
        if found is None:
            raise FileNotFoundError(f"nothing was written to {self.path}")
        return found.where(~F.col(DELETED)).drop(DELETED)

    def append(self, batch: int, rows: DataFrame) -> bool:
        """Add a batch of ``path, ..., deleted`` rows and merge where a level is full; false if it was there already."""
        m = self.manifest()
        if batch <= m["batch"]:
            return False
        made = rows.withColumn(BATCH, F.lit(batch).cast("long"))
        m |= {"schema": m["schema"] or made.schema.jsonValue(), "batch": batch}
        name = f"run-{batch:012d}-0"
        made.write.mode("overwrite").parquet(f"{self.path}/{name}")
        runs = m["runs"] + ([[name, 0]] if not self._read(m, [name]).isEmpty() else [])
        level = 0
        while len(full := [n for n, x in runs if x == level]) >= self.fan:
            merged = newest(self._read(m, full))
            if all(x <= level for _, x in runs):  # nothing older is left that a mark could hide
                merged = merged.where(~F.col(DELETED))
            name = f"run-{batch:012d}-{level + 1}"
            merged.write.mode("overwrite").parquet(f"{self.path}/{name}")
            runs = [[name, level + 1], *([n, x] for n, x in runs if x != level)]
            level += 1
        self._publish(m | {"runs": runs})
        return True

    def _publish(self, m: dict) -> None:
        """Put a manifest in place; runs and manifests that neither it nor the one before names are deleted."""
        before = self.manifest()
        draft, final = self._at(f"manifests/.{m['batch']:012d}"), self._at(f"manifests/{m['batch']:012d}")
        stream = self._fs.create(draft, True)
        stream.write(bytearray(json.dumps(m).encode()))
        stream.close()
        self._fs.rename(draft, final)
        live = {n for x in (m, before) for n, _ in x["runs"]}
        for s in self._fs.listStatus(self._at("")):
            if (name := s.getPath().getName()).startswith("run-") and name not in live:
                self._fs.delete(s.getPath(), True)
        for number in self._manifests()[:-2]:
            self._fs.delete(self._at(f"manifests/{number:012d}"), False)
