"""A ledger on disk: an append-only log of Parquet files, a versioned catalog, optional checkpoints.

One writer (the driver that holds the Ledger) appends; readers see whole appends only. State is never
stored but as a checkpoint that any reader may ignore: recovery is reading.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..operators import dedup, refcount, remap, snapshot, state
from ..operators.snapshot import InvalidArgument
from ..plans.work import staged
from . import wal
from .schema import MAX_LBA, MAX_VOLUMES, OP_LOG, REJECTED, REQUIRED, SNAPSHOTS, VOLUMES


class Ledger:
    def __init__(self, spark: SparkSession, path: str, volumes: list[Row], snaps: list[Row], sequence: int, top: int, max_volumes: int = MAX_VOLUMES):
        self.spark, self.path, self.max_volumes = spark, path.rstrip("/"), max_volumes
        self._volumes, self._snaps, self._sequence, self._top = volumes, snaps, sequence, top

    # Creation and opening.

    @classmethod
    def create(cls, spark: SparkSession, path: str, max_volumes: int = MAX_VOLUMES) -> Ledger:
        """An empty ledger with volume 0."""
        out = cls(spark, path, [Row(ord=0, src_ord=None, src_lsn=None, created_lsn=0, dropped_lsn=None)], [], 0, 0, max_volumes)
        spark.createDataFrame([], OP_LOG).write.mode("errorifexists").parquet(f"{out.path}/log")
        out._commit()
        return out

    @classmethod
    def open(cls, spark: SparkSession, path: str, max_volumes: int = MAX_VOLUMES) -> Ledger:
        """The catalog of the highest sequence, and the last lsn of the log or checkpoint."""
        path = path.rstrip("/")
        catalog = spark.read.parquet(f"{path}/catalog")
        top = catalog.agg(F.max("sequence")).first()[0]
        rows = catalog.where(F.col("sequence") == top)
        volumes = [Row(**r.volume.asDict()) for r in rows.where("volume is not null").select("volume").collect()]
        snaps = [Row(**r.snapshot.asDict()) for r in rows.where("snapshot is not null").select("snapshot").collect()]
        base = rows.where("volume is null and snapshot is null").first()
        out = cls(spark, path, volumes, snaps, top, 0, max_volumes)
        out._top = max(base.last_lsn, out.log().agg(F.max("lsn")).first()[0] or 0)
        out._forget({r.snap_id: r.lsn for r in out.log().where("op = 'DropSnapshot'").select("snap_id", "lsn").collect()})
        return out

    def _commit(self) -> None:
        self._sequence += 1
        s, v, n = VOLUMES.simpleString(), SNAPSHOTS.simpleString(), self._sequence
        rows = [(n, self._top, None, None), *((n, self._top, tuple(x), None) for x in self._volumes), *((n, self._top, None, tuple(x)) for x in self._snaps)]
        self.spark.createDataFrame(rows, f"sequence long, last_lsn long, volume {s}, snapshot {v}").coalesce(1).write.mode("append").parquet(f"{self.path}/catalog")

    # Reads.

    @property
    def last_lsn(self) -> int:
        return self._top

    def log(self, from_lsn: int | None = None) -> DataFrame:
        log = self.spark.read.schema(OP_LOG).parquet(f"{self.path}/log")
        return log if from_lsn is None else log.where(F.col("lsn") >= from_lsn)

    def snapshots(self, vol: int | None = None, history: bool = False) -> DataFrame:
        """The snapshots that live, of one volume or all; history: dropped ones too, with dropped_lsn."""
        return self.spark.createDataFrame([tuple(s) for s in self._snaps if (vol is None or s.vol_ord == vol) and (history or s.dropped_lsn is None)], SNAPSHOTS)

    def whole(self) -> DataFrame:
        """The log with inherited blocks and ends of volumes spelled out, and changes of counts by themselves: what counts are taken of."""
        log = self.log()
        maps = state.with_inherited(log, self.catalog())
        changes = log.where(F.col("op").isin("Incref", "Decref"))
        return maps.unionByName(changes.select(*maps.columns, "delta"), allowMissingColumns=True)

    def refcounts(self) -> DataFrame:
        """pba, rc with all that snapshots and clones hold."""
        return refcount.current(self.whole(), self.snapshots(history=True))

    def volumes(self) -> list[int]:
        return sorted(v.ord for v in self._volumes if v.dropped_lsn is None)

    def catalog(self) -> DataFrame:
        return self.spark.createDataFrame([tuple(v) for v in self._volumes], VOLUMES)

    def _volume(self, vol: int) -> Row:
        for v in self._volumes:
            if v.ord == vol and v.dropped_lsn is None:
                return v
        raise InvalidArgument(f"unknown volume {vol}")

    def _snapshot(self, snap_id: int) -> Row | None:
        return next((s for s in self._snaps if s.id == snap_id and s.dropped_lsn is None), None)

    def l2p(self, vol: int) -> DataFrame:
        """The volume's block map with what it inherits."""
        self._volume(vol)
        return state.clone_view(self.log(), self.catalog(), vol).drop("own")

    def snapshot_view(self, snap_id: int) -> DataFrame | None:
        s = self._snapshot(snap_id)
        return None if s is None else state.clone_view(self.log(), self.catalog(), s.vol_ord, s.created_lsn).drop("own")

    def forward_index(self) -> DataFrame:
        return dedup.current(self.log())

    def reverse_index(self) -> DataFrame:
        return dedup.reverse_current(self.log())

    # Writes.

    def append(self, ops: DataFrame) -> int:
        """One transaction: ops (columns of OP_LOG without lsn; op_seq gives the order) under one new lsn. All is checked first: an operation that could not be applied leaves nothing behind. Guards are decided now, by counts just before each operation; a remap whose guard fails stands in the record as rejected and does nothing. Empty: the last lsn, and no record."""
        if ops.isEmpty():
            return self._top
        full = self._record(ops)
        self._check(full)
        if not full.where("guard_pba is not null").isEmpty():
            full = self._decided(full)
        return self._write(full)

    def _record(self, ops: DataFrame) -> DataFrame:
        names = [f.name for f in OP_LOG.fields]
        full = ops.select(*((F.col(n).cast(OP_LOG[n].dataType) if n in ops.columns else F.lit(None).cast(OP_LOG[n].dataType)).alias(n) for n in names if n != "lsn"))
        return full.withColumn("lsn", F.lit(self._top + 1).cast("long")).select(*names)

    def _write(self, record: DataFrame) -> int:
        record.write.mode("append").parquet(f"{self.path}/log")
        self._top += 1
        return self._top

    def _decided(self, ops: DataFrame) -> DataFrame:
        """ops with rejected remaps marked. Earlier records were decided when they were appended."""
        guards = [F.lit(None).cast("long").alias(c) for c in ("guard_pba", "guard_min_rc")]
        before, names = self.whole(), ["lsn", "op_seq", "op", "vol_ord", "lba", "pba", "salt", "delta"]
        both = before.select(*names, *guards).unionByName(ops.select(*names, "guard_pba", "guard_min_rc"))
        rejected = remap.guarded(both, self.snapshots(history=True)).where(~F.col("applied")).select("op_seq", F.lit(True).alias("_no"))
        return ops.join(rejected, "op_seq", "left").withColumn("op", F.when(F.col("_no"), REJECTED).otherwise(F.col("op"))).select(*ops.columns)

    def _check(self, ops: DataFrame) -> None:
        names = [f.name for f in OP_LOG.fields]
        complete = F.lit(False)
        for kind, needed in REQUIRED.items():
            have = F.col("op") == kind
            for n in needed:
                have = have & F.col(n).isNotNull()
            complete = complete | have
        bad = ops.where(~F.coalesce(complete, F.lit(False))).first()
        if bad is not None:
            raise InvalidArgument(f"operation {bad.op}: unknown, not for a transaction, or without {' and '.join(n for n in REQUIRED.get(bad.op, names) if bad[n] is None)}")
        if not ops.where((F.col("guard_pba").isNull() != F.col("guard_min_rc").isNull()) | (F.col("guard_pba").isNotNull() & (F.col("op") != "L2pRemap"))).isEmpty():
            raise InvalidArgument("a guard is an address and a count, and stands on a remap")
        if not ops.groupBy("op_seq").count().where("count > 1 or op_seq is null").isEmpty() and not ops.where(F.col("op").isin(*state.MAPS, "Incref", "Decref")).isEmpty():
            raise InvalidArgument("op_seq must tell operations apart")
        known = set(self.volumes())
        unknown = [r.vol_ord for r in ops.where("vol_ord is not null").select("vol_ord").distinct().collect() if r.vol_ord not in known]
        if unknown:
            raise InvalidArgument(f"unknown volumes {sorted(unknown)}")
        if not ops.where((F.col("lba") < 0) | (F.col("lba") >= MAX_LBA)).isEmpty():
            raise InvalidArgument("block outside the addressable range")
        if not ops.where(F.col("op").isin("Incref", "Decref") & ((F.col("delta") < 0) | (F.col("delta") >= 1 << 32))).isEmpty():
            raise InvalidArgument("change outside 0 .. 2^32 - 1")
        if not ops.where(F.col("op") == "Decref").isEmpty():
            touched = ops.where("op = 'Decref'").select("pba").distinct()
            before = self.whole()
            low = refcount.underflows(before.unionByName(ops.select(*before.columns)), self.snapshots(history=True)).join(F.broadcast(touched), "pba", "left_semi").first()
            if low is not None:
                raise InvalidArgument(f"reference count of {low.pba} below zero")

    def outcomes(self, lsn: int) -> DataFrame:
        """One transaction's map operations in order: whether each was applied, what its block held before, and the address it freed, if neither a snapshot nor a clone holds that."""
        done = remap.outcomes(self.whole().where(F.col("lsn") <= lsn), self.snapshots(history=True)).where((F.col("lsn") == lsn) & (F.col("op_seq") < state.INHERITED)).withColumn("applied", F.lit(True))
        rejected = self.log().where((F.col("lsn") == lsn) & (F.col("op") == REJECTED)).select("lsn", "op_seq", F.lit("L2pRemap").alias("op"), "vol_ord", "lba", F.lit(False).alias("applied"))
        return done.unionByName(rejected, allowMissingColumns=True).orderBy("op_seq")

    def range_delete(self, vol: int, start: int, end: int) -> int:
        """Unmaps [start, end), inherited blocks too: a record for each chunk of captured blocks. Returns the last lsn; an empty range writes none."""
        if end <= start:
            self._volume(vol)
            return self._top
        plan = staged(self.spark, remap.range_delete_plan(self.l2p(vol), start, end), "captured")
        for chunk in sorted(r.chunk for r in plan.select("chunk").distinct().collect()):
            self.append(plan.where(F.col("chunk") == chunk).select(F.lit("L2pDelete").alias("op"), F.lit(vol).alias("vol_ord"), "lba", "op_seq"))
        return self._top

    def cleanup(self, dead: DataFrame) -> int:
        """Removes the reverse entries of dead addresses (pba), and forward entries that still point to them, in one record. All touch keys of their own, so they need no order."""
        plan = dedup.cleanup_plan(self.forward_index(), self.reverse_index(), dead)
        kinds = F.array(F.lit("DedupReverseDelete"), F.when(F.col("delete_forward"), "DedupDelete"))
        rows = plan.select("pba", "hash", F.explode(F.array_compact(kinds)).alias("op"))
        return self.append(rows.select("op", "pba", "hash", F.lit(0).alias("op_seq")))

    def take_snapshot(self, vol: int) -> int:
        """Its id, one above the largest ever given."""
        self._volume(vol)
        new = max((s.id for s in self._snaps), default=0) + 1
        self._snaps.append(Row(id=new, vol_ord=vol, created_lsn=self._top, dropped_lsn=None))
        self._commit()
        return new

    def drop_snapshot(self, snap_id: int) -> DataFrame | None:
        """What it released (decrefs and freed addresses), in a record of its own; None if unknown. A ledger that is opened after the record was written but not the catalog finds it in the log."""
        s = self._snapshot(snap_id)
        if s is None:
            return None
        rows = staged(self.spark, snapshot.drop_decrefs(self.whole(), self.snapshots(), snap_id), "drop")
        lsn = self._write(self._record(self.spark.createDataFrame([(0, "DropSnapshot", snap_id)], "op_seq int, op string, snap_id long")))
        self._forget({snap_id: lsn})
        self._commit()
        return rows

    def _forget(self, dropped: dict[int, int]) -> None:
        self._snaps = [Row(**s.asDict() | {"dropped_lsn": dropped[s.id]}) if s.id in dropped else s for s in self._snaps]

    def create_volume(self) -> int:
        return self._new_volume(None, None)

    def clone_volume(self, snap_id: int) -> int:
        """A writable copy of a snapshot; it lives on when the snapshot is dropped."""
        s = self._snapshot(snap_id)
        if s is None:
            raise InvalidArgument(f"unknown snapshot {snap_id}")
        return self._new_volume(s.vol_ord, s.created_lsn)

    def _new_volume(self, src: int | None, lsn: int | None) -> int:
        if len(self.volumes()) >= self.max_volumes:
            raise InvalidArgument(f"{self.max_volumes} volumes are the most")
        new = max(v.ord for v in self._volumes) + 1  # ordinals are not used again
        self._volumes.append(Row(ord=new, src_ord=src, src_lsn=lsn, created_lsn=self._top, dropped_lsn=None))
        self._commit()
        return new

    def drop_volume(self, vol: int) -> bool:
        """False if unknown. Volume 0 and volumes with snapshots stay."""
        if vol == 0 or any(s.vol_ord == vol and s.dropped_lsn is None for s in self._snaps):
            raise InvalidArgument(f"volume {vol} cannot be dropped")
        found = [v for v in self._volumes if v.ord == vol and v.dropped_lsn is None]
        self._volumes = [Row(**v.asDict() | {"dropped_lsn": self._top}) if v in found else v for v in self._volumes]
        if found:
            self._commit()
        return bool(found)

    def checkpoint(self) -> str:
        """Writes the block maps of all volumes as of now, clones whole, and returns the path."""
        path = f"{self.path}/checkpoint/{self._top:020}"
        state.l2p_at(state.with_inherited(self.log(), self.catalog())).write.mode("overwrite").parquet(path)
        return path

    def state_from(self, checkpoint: str, lsn: int) -> DataFrame:
        """The block maps of all volumes: a checkpoint taken at lsn, with the later log, later clones and later ends of volumes on top. Deletes need no place in a checkpoint: in it clones no longer look at their sources."""
        base = self.spark.read.parquet(checkpoint).withColumns({"op_seq": F.lit(-1), "op": F.lit("L2pPut")})
        names = ["lsn", "op_seq", "op", "vol_ord", "lba", "pba", "salt"]
        later = self.catalog().where((F.col("created_lsn") >= lsn) | (F.col("dropped_lsn") >= lsn))
        implied = state.with_inherited(self.log(), self.catalog()).where(F.col("op_seq") >= state.INHERITED) if not later.isEmpty() else None
        rows = base.select(*names).unionByName(self.log(lsn + 1).select(*names))
        return state.l2p_at(rows if implied is None else rows.unionByName(implied.where(F.col("lsn") >= lsn).select(*names)))

    def maps(self) -> DataFrame:
        """The block maps of all volumes, from the newest checkpoint if there is one."""
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(f"{self.path}/checkpoint")
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        done = [str(f.getPath().getName()) for f in fs.listStatus(root) if fs.exists(jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))] if fs.exists(root) else []
        if not done:
            return state.l2p_at(state.with_inherited(self.log(), self.catalog()))
        return self.state_from(f"{self.path}/checkpoint/{max(done)}", int(max(done)))

    @classmethod
    def from_segments(cls, spark: SparkSession, path: str, segments: str, snaps: DataFrame | None = None, max_volumes: int = MAX_VOLUMES) -> Ledger:
        """A new ledger that holds what binary log segments say. snaps: the snapshots that were taken, which that log does not record (id, vol_ord, created_lsn)."""
        out = cls.create(spark, path, max_volumes)
        ops = staged(spark, wal.checked(wal.read_segments(spark, segments)), "replay")
        taken = [] if snaps is None else [Row(id=s.id, vol_ord=s.vol_ord, created_lsn=s.created_lsn, dropped_lsn=None) for s in snaps.select("id", "vol_ord", "created_lsn").collect()]
        wal.to_log(ops).write.mode("append").parquet(f"{out.path}/log")
        out._volumes = wal.volumes_of(ops, {s.id: s.created_lsn for s in taken}, out._volumes)
        out._snaps, out._top = taken, ops.agg(F.max("lsn")).first()[0] or 0
        out._forget({int(r.snap_id): r.lsn for r in ops.where("op = 'DropSnapshot'").collect()})
        out._commit()
        return out
