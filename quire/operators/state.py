"""Tables that move forward from manifest to manifest: sections by batches of edits, rows of unique names by insertions.

A section store is a folder. ``data/<name>/bucket=b`` holds sections by a hash of their id,
``history/<name>`` the versions that a batch made old, and ``manifest/<n>`` says which of
them are the present state: for each bucket the folder that holds it, the history's
folders, and the last batch. A batch reads the buckets that its events touch, and its
events, never what came before them; it writes new folders, and the state moves on in
one step when the next manifest, once it is whole, gets its name. A name is given once, so
of two writers the second fails with Conflict and nothing of it counts. After a crash the
last manifest still tells the whole state; folders that no manifest names don't count.

Batches have growing numbers. A number that isn't above the last one has been applied
already and changes nothing, so a stream may deliver a batch again (``follow``).
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from quire.operators.tagging import TagModel
from quire.operators.workflow import fold_edits, insert_unique
from quire.session import give_name, materialize

BUCKETS = 64


class Conflict(RuntimeError):
    """Another writer moved the state first."""


class _Store:
    """A folder whose state is its last manifest."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path
        self._path = lambda *parts: path("/".join([self.folder, *parts]))
        self._fs = self._path("manifest").getFileSystem(spark._jsc.hadoopConfiguration())

    def _manifest(self) -> dict:
        numbers = [int(n) for s in self._fs.listStatus(self._path("manifest")) if (n := s.getPath().getName()).isdigit()]
        text = self.spark.read.text(f"{self.folder}/manifest/{max(numbers):012d}", wholetext=True).first()[0]
        return json.loads(text)

    def _commit(self, manifest: dict) -> None:
        name = f"{manifest['version']:012d}"
        if not give_name(self.spark, f"{self.folder}/manifest/{name}", json.dumps(manifest)):
            raise Conflict(f"manifest {name} is there already")


class UniqueTable(_Store):
    """Rows whose ``column`` is unique, whoever appends them at the same time.

    An insertion leaves out what the state it has read holds already. If another
    writer has moved the state meanwhile, nothing of the insertion counts, and it is
    made again on the new state: the first to finish keeps a name, the other's row is
    refused. Only names are compared; rows that are there are never rewritten.
    """

    @classmethod
    def create(cls, spark: SparkSession, folder: str, rows: DataFrame, column: str) -> UniqueTable:
        """A new table; of rows of one name the first by id stays."""
        store = cls(spark, folder)
        store._commit({"version": 0, "column": column, "schema": rows.schema.json(), "data": []})
        store.insert(rows)
        return store

    def _read(self, manifest: dict) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(manifest["schema"]))
        paths = [f"{self.folder}/data/{name}" for name in manifest["data"]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def rows(self) -> DataFrame:
        return self._read(self._manifest())

    def insert(self, rows: DataFrame, tries: int = 20) -> DataFrame:
        """Insert what may be inserted; returns the refused rows (by id)."""
        for _ in range(tries):
            manifest = self._manifest()
            _, refused = insert_unique(self._read(manifest), rows, manifest["column"])
            name = uuid.uuid4().hex
            refused = materialize(refused, "refused")
            rows.join(refused.select("id"), "id", "left_anti").select(*rows.columns).write.parquet(f"{self.folder}/data/{name}")
            try:
                self._commit(manifest | {"version": manifest["version"] + 1, "data": [*manifest["data"], name]})
            except Conflict:
                continue
            return refused
        raise Conflict("other writers were always faster")


class SectionStore(_Store):
    def _put(self, sections: DataFrame, buckets: int) -> str:
        name = uuid.uuid4().hex
        placed = sections.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int"))
        placed.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.folder}/data/{name}")
        return name

    def _buckets_of(self, name: str) -> list[int]:
        return [int(s.getPath().getName().split("=")[1]) for s in self._fs.listStatus(self._path("data", name)) if s.isDirectory()]

    @classmethod
    def create(cls, spark: SparkSession, folder: str, sections: DataFrame, buckets: int = BUCKETS) -> SectionStore:
        """A new store with these sections."""
        store = cls(spark, folder)
        name = store._put(sections, buckets)
        store._commit({"version": 0, "batch": -1, "buckets": buckets, "schema": sections.schema.json(), "data": {str(b): name for b in store._buckets_of(name)}, "history": []})
        return store

    def _read(self, manifest: dict, buckets: set[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(manifest["schema"]))
        paths = [f"{self.folder}/data/{name}/bucket={b}" for b, name in manifest["data"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def next_batch(self) -> int:
        return self._manifest()["batch"] + 1

    def sections(self) -> DataFrame:
        return self._read(self._manifest())

    def history(self) -> DataFrame:
        """The versions that edits made old; empty without a column before the first batch."""
        names = self._manifest()["history"]
        return self.spark.read.parquet(*[f"{self.folder}/history/{n}" for n in names]) if names else self.spark.createDataFrame([], "section_id bigint")

    def apply(self, events: DataFrame, batch: int, model: TagModel | None = None) -> bool:
        """Fold a batch of edits into the state; False if it has been applied before."""
        manifest = self._manifest()
        if batch <= manifest["batch"]:
            return False
        n = manifest["buckets"]
        touched = {r[0] for r in events.select(F.pmod(F.xxhash64("section_id"), F.lit(n)).cast("int")).distinct().collect()}
        now, past = fold_edits(self._read(manifest, touched), events, model)
        name = self._put(now, n)
        past.write.parquet(f"{self.folder}/history/{name}")
        self._commit(manifest | {"version": manifest["version"] + 1, "batch": batch, "data": manifest["data"] | {str(b): name for b in self._buckets_of(name)}, "history": [*manifest["history"], name]})
        return True

    def follow(self, edits: DataFrame, checkpoint: str, model: TagModel | None = None) -> StreamingQuery:
        """Apply a stream of edits, each of its batches once, and stop when all that is there is done."""
        return edits.writeStream.foreachBatch(lambda rows, batch: self.apply(rows, batch, model) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
