"""Explicit schemas of the log, the catalog and the index tables. Never inferred: a table of another shape is an error."""

from __future__ import annotations

from pyspark.sql import types as T

L, I, S, B = T.LongType(), T.IntegerType(), T.StringType(), T.BinaryType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v, True) for k, v in fields.items()])


#: One row per operation. A transaction's operations share one lsn and are ordered by op_seq. Values are (pba, salt).
OP_LOG = _struct(lsn=L, op_seq=I, op=S, vol_ord=I, lba=L, pba=L, salt=L, range_end=L, delta=L, guard_pba=L, guard_min_rc=L, hash=S, snap_id=L, src_ord=I)
#: dropped_lsn is null while a snapshot lives; functions also take catalogs without that column.
SNAPSHOTS = _struct(id=L, vol_ord=I, created_lsn=L, dropped_lsn=L)
VOLUMES = _struct(ord=I, src_ord=I, src_lsn=L, created_lsn=L, dropped_lsn=L)

# Tags of the kinds of operation, in the order of the log format.
OP_TAGS = {
    "L2pPut": 0x01, "L2pDelete": 0x02, "L2pRemap": 0x03, "L2pRangeDelete": 0x04,
    "DedupPut": 0x10, "DedupDelete": 0x11, "DedupReversePut": 0x12, "DedupReverseDelete": 0x13,
    "Incref": 0x20, "Decref": 0x21, "DropSnapshot": 0x30,
    "CreateVolume": 0x40, "DropVolume": 0x41, "CloneVolume": 0x42,
}

#: What a transaction may hold, and the columns each kind needs. Range deletes, snapshots and volumes have calls of their own.
REQUIRED = {
    "L2pPut": ("vol_ord", "lba", "pba"), "L2pDelete": ("vol_ord", "lba"), "L2pRemap": ("vol_ord", "lba", "pba"),
    "DedupPut": ("hash", "pba"), "DedupDelete": ("hash",), "DedupReversePut": ("pba", "hash"), "DedupReverseDelete": ("pba", "hash"),
    "Incref": ("pba", "delta"), "Decref": ("pba", "delta"),
}
#: A remap whose guard failed: it stands in its record and does nothing.
REJECTED = "Rejected"

#: Addressable blocks of a volume.
MAX_LBA = 1 << 39
MAX_VOLUMES = 1024
RANGE_DELETE_ROWS = 65_536
