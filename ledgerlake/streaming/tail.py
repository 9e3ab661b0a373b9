"""The log as a stream: block maps and counts kept up to date, batch by batch.

Each micro-batch writes what it changes: the blocks that it touches, and by how much counts move. State is the last base
with the changes since, and a new base is written every COMPACT batches, so a batch costs its own size. Batch k always works on the
state after batch k - 1, so one that is run again after a failure writes the same. Two steps, as the keys differ: the previous value
by block first, then the count by address.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.running import latest
from ..operators import refcount
from ..operators.state import KEY, MAPS, ORDER, VALUE

STATE = T.StructType([T.StructField("vol_ord", T.IntegerType()), *(T.StructField(n, T.LongType()) for n in ("lba", "pba", "salt", "lsn")), T.StructField("op_seq", T.IntegerType()), T.StructField("op", T.StringType())])
COUNTS = T.StructType([T.StructField("pba", T.LongType()), T.StructField("rc", T.LongType())])


def _names() -> list[str]:
    return ["lsn", "op_seq", "op", *KEY, *VALUE]


def changes(maps: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a batch of map operations changes: the last operation of each block that it touches, and the change of each address's count. Operations at or before a block's last one were seen already and count for nothing."""
    batch = batch.where(F.col("op").isin(*MAPS)).select(*_names())
    old = maps.select(*_names()).join(batch.select(*KEY).distinct(), KEY, "left_semi")
    seen = old.select(*KEY, F.struct("lsn", "op_seq").alias("_seen"))
    fresh = batch.join(seen, KEY, "left").where(F.col("_seen").isNull() | (F.struct("lsn", "op_seq") > F.col("_seen"))).drop("_seen")
    before, after = refcount.deltas(old), refcount.deltas(old.unionByName(fresh))
    moved = after.select("pba", "delta").unionByName(before.select("pba", (-F.col("delta")).alias("delta")))
    return _last(fresh), _summed(moved.withColumnRenamed("delta", "rc"))


def _last(rows: DataFrame) -> DataFrame:
    top = latest(rows.select(*_names()).withColumns({"at": F.col("lsn"), "seq": F.col("op_seq")}), KEY, ORDER, ["op", *VALUE, "at", "seq"])
    return top.select("vol_ord", "lba", "pba", "salt", F.col("at").alias("lsn"), F.col("seq").alias("op_seq"), "op")


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("pba").agg(F.sum("rc").alias("rc")).where("rc <> 0")


def written(spark: SparkSession, path: str) -> list[int]:
    """Numbered folders under path that were written whole, in order."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    found = [f.getPath() for f in fs.listStatus(root) if f.getPath().getName().isdigit()]
    return sorted(int(p.getName()) for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


class Tail:
    """Keeps maps and counts under path; version k is the state after batch k - 1. All that it knows is in the folders, so a new process goes on where the last one stopped."""

    COMPACT = 16

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @property
    def version(self) -> int:
        """The last batch whose maps and counts both stand; maps are written first."""
        return max(written(self.spark, f"{self.path}/counts"), default=0)

    def _read(self, what: str, schema: T.StructType, version: int) -> DataFrame:
        base = max((k for k in written(self.spark, f"{self.path}/{what}-base") if k <= version), default=0)
        paths = [f"{self.path}/{what}-base/{base}"] * (base > 0) + [f"{self.path}/{what}/{k}" for k in range(base + 1, version + 1)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def state(self, version: int) -> tuple[DataFrame, DataFrame]:
        return _last(self._read("maps", STATE, version)), _summed(self._read("counts", COUNTS, version))

    def _batch(self, batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # read twice; a stream's batch must not be made anew in between
        maps, _ = self.state(batch_id)
        for what, df in zip(("maps", "counts"), changes(maps, batch)):
            df.write.mode("overwrite").parquet(f"{self.path}/{what}/{batch_id + 1}")
        batch.unpersist()
        if (batch_id + 1) % self.COMPACT == 0:
            for what, df in zip(("maps", "counts"), self.state(batch_id + 1)):
                if batch_id + 1 not in written(self.spark, f"{self.path}/{what}-base"):
                    df.write.mode("overwrite").parquet(f"{self.path}/{what}-base/{batch_id + 1}")

    def start(self, stream: DataFrame, **trigger) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self._batch).option("checkpointLocation", f"{self.path}/offsets").trigger(**(trigger or {"availableNow": True})).start()

    def live(self) -> DataFrame:
        """vol_ord, lba, pba, salt of mapped blocks at the newest version."""
        return self.state(self.version)[0].where("op <> 'L2pDelete'").select(*KEY, *VALUE)

    def counts(self) -> DataFrame:
        return self.state(self.version)[1]


def op_rate(stream: DataFrame, minutes: int = 5, late: str = "10 minutes") -> DataFrame:
    """Operations by kind in windows of event time; rows later than the watermark are dropped. stream: ts, event_type."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", f"{minutes} minutes"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
