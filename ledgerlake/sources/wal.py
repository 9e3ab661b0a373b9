"""Binary log segments: framed records of tagged operations, read with Spark's binary file source.

A segment is named wal-{first lsn, 20 digits}.log and holds records back to back. A broken record may
only end the newest segment (a torn write); anywhere else it is corruption.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from .schema import OP_LOG, OP_TAGS

# Fixed values of the format. Record: lsn, length of the body, crc32c of the body, little-endian; body: version,
# then for each operation a tag and its fields, big-endian.
HEADER = struct.Struct("<QII")
MOST_BODY = 16 * 1024 * 1024
BODY_VERSION = 0xB1
CRC32C_POLYNOMIAL = 0x82F63B78
LAYOUT = {
    "L2pPut": (("vol_ord", "H"), ("lba", "Q"), ("value", "28s")),
    "L2pDelete": (("vol_ord", "H"), ("lba", "Q")),
    "L2pRemap": (("vol_ord", "H"), ("lba", "Q"), ("value", "28s")),
    "L2pRangeDelete": (("vol_ord", "H"), ("lba", "Q"), ("range_end", "Q")),
    "DedupPut": (("hash", "32s"), ("value", "28s")),
    "DedupDelete": (("hash", "32s"),),
    "DedupReversePut": (("pba", "Q"), ("hash", "32s")),
    "DedupReverseDelete": (("pba", "Q"), ("hash", "32s")),
    "Incref": (("pba", "Q"), ("delta", "I")),
    "Decref": (("pba", "Q"), ("delta", "I")),
    "DropSnapshot": (("snap_id", "Q"),),
    "CreateVolume": (("vol_ord", "H"), ("shard_count", "I")),
    "DropVolume": (("vol_ord", "H"),),
    "CloneVolume": (("src_ord", "H"), ("vol_ord", "H"), ("snap_id", "Q")),
}
#: Lists that follow the fields: name and item format, after a count of four bytes.
LISTS = {"L2pRangeDelete": (("captured", "Q28s"),), "DropSnapshot": (("pages", "Q"), ("pba_decrefs", "Q")), "DropVolume": (("pages", "Q"),), "CloneVolume": (("pages", "Q"),)}
GUARD = struct.Struct(">QI")
_NAMES = {tag: name for name, tag in OP_TAGS.items()}

NUMBERS = ["vol_ord", "lba", "range_end", "pba", "delta", "guard_pba", "guard_min_rc", "snap_id", "src_ord", "shard_count"]
SCHEMA = "path string, lsn long, op_seq int, op string, " + ", ".join(f"{n} decimal(20,0)" for n in NUMBERS) + ", value string, hash string, captured array<struct<lba: decimal(20,0), value: string>>, pages array<decimal(20,0)>, pba_decrefs array<decimal(20,0)>, error string"


class Corruption(ValueError):
    """Bytes that are no log."""


def _table() -> np.ndarray:
    n = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        n = np.where(n & 1, n >> 1 ^ np.uint32(CRC32C_POLYNOMIAL), n >> 1)
    return n


_CRC = _table()
_LANES = 256


def _after_zeros(width: int) -> np.ndarray:
    """For each byte of a register, what it becomes when `width` zero bytes follow: 4 x 256 words."""
    out = np.array([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    for _ in range(width):
        out = _CRC[out & 255] ^ out >> np.uint32(8)
    return out


def crc32c(data: bytes) -> int:
    """The register is linear in the data, so long data are taken as _LANES stretches side by side, a byte of each at a time, and their registers are joined by what the rest of the data does to each."""
    c = np.uint32(0xFFFFFFFF)
    width = len(data) // _LANES
    if width >= 16:
        lanes = np.frombuffer(data, np.uint8, width * _LANES).reshape(_LANES, width).T.astype(np.uint32)
        registers = np.zeros(_LANES, np.uint32)
        for column in lanes:
            registers = _CRC[(registers ^ column) & 255] ^ registers >> np.uint32(8)
        shift = _after_zeros(width)
        for r in registers:
            c = shift[0][c & 255] ^ shift[1][c >> 8 & 255] ^ shift[2][c >> 16 & 255] ^ shift[3][c >> 24] ^ r
        data = data[width * _LANES :]
    c, table = int(c), _CRC.tolist()
    for b in data:
        c = table[(c ^ b) & 255] ^ c >> 8
    return c ^ 0xFFFFFFFF


def encode_op(op: dict) -> bytes:
    name = op["op"]
    out = [bytes([OP_TAGS[name]])]
    for field, kind in LAYOUT[name]:
        x = op[field]
        out.append(struct.pack(f">{kind}", bytes.fromhex(x) if kind.endswith("s") else int(x)))
    if name == "L2pRemap":
        out.append(b"\0" if op.get("guard_pba") is None else b"\1" + GUARD.pack(int(op["guard_pba"]), int(op["guard_min_rc"])))
    for field, kind in LISTS.get(name, ()):
        items = op.get(field) or []
        out.append(struct.pack(">I", len(items)))
        out += [struct.pack(f">{kind}", int(x["lba"]), bytes.fromhex(x["value"])) if kind == "Q28s" else struct.pack(">Q", int(x)) for x in items]
    return b"".join(out)


def encode_record(lsn: int, ops: list[dict]) -> bytes:
    body = bytes([BODY_VERSION]) + b"".join(map(encode_op, ops))
    if len(body) > MOST_BODY:
        raise ValueError(f"a record of {len(body)} bytes")
    return HEADER.pack(lsn, len(body), crc32c(body)) + body


def decode_body(body: bytes) -> list[dict]:
    if not body or body[0] != BODY_VERSION:
        raise Corruption("body of another version")
    out, at = [], 1

    def take(form: str) -> tuple:
        nonlocal at
        s = struct.Struct(f">{form}")
        if at + s.size > len(body):
            raise Corruption("operation cut short")
        at += s.size
        return s.unpack_from(body, at - s.size)

    while at < len(body):
        (tag,) = take("B")
        if tag not in _NAMES:
            raise Corruption(f"unknown tag {tag:#04x}")
        op: dict = {"op": _NAMES[tag]}
        for field, kind in LAYOUT[op["op"]]:
            (x,) = take(kind)
            op[field] = x.hex() if isinstance(x, bytes) else x
        if op["op"] == "L2pRemap":
            (guarded,) = take("B")
            if guarded > 1:
                raise Corruption(f"unknown guard {guarded}")
            if guarded:
                op["guard_pba"], op["guard_min_rc"] = take("QI")
        for field, kind in LISTS.get(op["op"], ()):
            (n,) = take("I")
            if n * struct.calcsize(f">{kind}") > len(body) - at:
                raise Corruption("list cut short")
            op[field] = [{"lba": x[0], "value": x[1].hex()} if kind == "Q28s" else x[0] for x in (take(kind) for _ in range(n))]
        out.append(op)
    return out


def decode_segment(data: bytes) -> Iterator[tuple[int, list[dict] | None, str | None]]:
    """lsn and operations of each record; the first broken one ends the segment as (offset, None, what is wrong)."""
    at = 0
    while at < len(data):
        if len(data) - at < HEADER.size:
            yield at, None, "header cut short"
            return
        lsn, size, crc = HEADER.unpack_from(data, at)
        if size > MOST_BODY:
            yield at, None, f"length {size}"
            return
        body = data[at + HEADER.size : at + HEADER.size + size]
        if len(body) < size:
            yield at, None, "body cut short"
            return
        if crc32c(body) != crc:
            yield at, None, "checksum differs"
            return
        try:
            ops = decode_body(body)
        except Corruption as e:
            raise Corruption(f"record {lsn}: {e}") from e
        yield lsn, ops, None
        at += HEADER.size + size


def _decoded(from_lsn: int):
    """For mapInArrow over path, content: the operations with lsn >= from_lsn, a segment at a time."""
    from decimal import Decimal

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(SCHEMA))

    def number(x):
        return None if x is None else Decimal(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist()):
                rows = []
                for lsn, ops, error in decode_segment(content):
                    if error:
                        rows.append({"path": name, "lsn": lsn, "error": error})
                    elif lsn >= from_lsn:
                        for k, op in enumerate(ops):
                            row = {"path": name, "lsn": lsn, "op_seq": k, **op} | {n: number(op.get(n)) for n in NUMBERS}
                            row |= {n: [number(x) for x in op[n]] for n in ("pages", "pba_decrefs") if n in op}
                            if "captured" in op:
                                row["captured"] = [{"lba": number(x["lba"]), "value": x["value"]} for x in op["captured"]]
                            rows.append(row)
                    if len(rows) >= 1 << 14:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def read_segments(spark: SparkSession, path: str, from_lsn: int = 0) -> DataFrame:
    """The operations of all segments under path with lsn >= from_lsn, in columns of SCHEMA; a torn end is one row with error. One task a segment."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "wal-*.log").load(path).select("path", "content")
    return files.mapInArrow(_decoded(from_lsn), SCHEMA)


def through_segments(log: DataFrame, records_a_segment: int = 4096) -> DataFrame:
    """log written as segments and read from their bytes again, without files."""
    out = segments(log, records_a_segment).select(F.col("name").alias("path"), "content")
    return out.mapInArrow(_decoded(0), SCHEMA).where("error is null").drop("path", "error")


def checked(ops: DataFrame) -> DataFrame:
    """Operations without the torn end. Raises Corruption for a broken record in an older segment, and for lsns that do not rise."""
    newest = ops.agg(F.max("path")).first()[0]
    bad = ops.where(F.col("error").isNotNull() & (F.col("path") != newest)).first()
    if bad is not None:
        raise Corruption(f"{bad.path} at byte {bad.lsn}: {bad.error}")
    good = ops.where("error is null")
    lsns = good.select("path", "lsn").distinct()
    ends = lsns.groupBy("path").agg(F.min("lsn").alias("first"), F.max("lsn").alias("last"))
    overlap = ends.withColumn("before", F.lag("last").over(Window.orderBy("path"))).where("first <= before").first()
    if overlap is not None:
        raise Corruption(f"{overlap.path}: lsn {overlap['first']} after {overlap.before}")
    return good.drop("error", "path")


def _value(column: str) -> tuple[Column, Column]:
    """pba and salt of a value of 28 bytes in hex. salt stands for the 20 bytes after the address: the last 8 of them where the others are zero, else their xxhash64, so other bytes are another salt but for a chance of 2^-64."""
    pba = F.conv(F.substring(column, 1, 16), 16, 10).cast("decimal(20,0)").cast("long")
    rest, low = F.substring(column, 17, 40), F.substring(column, 41, 16)
    plain = rest.startswith("0" * 24) & (F.substring(column, 41, 1) < "8")
    return pba, F.when(plain, F.conv(low, 16, 10).cast("long")).otherwise(F.xxhash64(rest))


def pack(pba: Column, salt: Column) -> Column:
    """The value of 28 bytes in hex that _value takes apart again, of numbers below 2^63."""
    return F.lower(F.concat(F.lpad(F.hex(pba), 16, "0"), F.lit("0" * 24), F.lpad(F.hex(salt), 16, "0")))


def to_log(ops: DataFrame) -> DataFrame:
    """Operations read from segments as OP_LOG, applied in order. A range delete becomes a delete of each captured block; operations of a record are numbered anew, as those need places. Volumes' and snapshots' lives are not map operations: volumes_of, and DropSnapshot rows."""
    captured = F.when(F.col("op") == "L2pRangeDelete", F.col("captured"))
    rows = ops.where(~F.col("op").isin("CreateVolume", "DropVolume", "CloneVolume")).select("*", F.posexplode_outer(captured).alias("place", "block"))
    rows = rows.where("op <> 'L2pRangeDelete' or block is not null")
    ranged = F.col("op") == "L2pRangeDelete"
    pba, salt = _value("value")
    order = Window.partitionBy("lsn").orderBy("op_seq", "place")
    names = {
        "op_seq": F.row_number().over(order) - 1,
        "op": F.when(ranged, "L2pDelete").otherwise(F.col("op")),
        "lba": F.when(ranged, F.col("block.lba")).otherwise(F.col("lba")),
        "pba": F.when(F.col("value").isNotNull(), pba).otherwise(F.col("pba").cast("long")),
        "salt": F.when(F.col("value").isNotNull(), salt),
        "range_end": F.lit(None),
    }
    return rows.select(*(names.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in OP_LOG.fields))


def volumes_of(ops: DataFrame, created: dict[int, int], base: list[Row]) -> list[Row]:
    """The catalog's volumes after the log's volume records, few as volumes are. created: lsns of snapshots, which clones need."""
    out = {v.ord: v for v in base}
    for r in ops.where(F.col("op").isin("CreateVolume", "DropVolume", "CloneVolume")).select("lsn", "op_seq", "op", "vol_ord", "src_ord", "snap_id").orderBy("lsn", "op_seq").collect():
        ord_ = int(r.vol_ord)
        if r.op == "DropVolume":
            out[ord_] = Row(**out[ord_].asDict() | {"dropped_lsn": r.lsn})
        elif r.op == "CreateVolume":
            out[ord_] = Row(ord=ord_, src_ord=None, src_lsn=None, created_lsn=r.lsn, dropped_lsn=None)
        else:
            if int(r.snap_id) not in created:
                raise Corruption(f"record {r.lsn}: clone of unknown snapshot {r.snap_id}")
            out[ord_] = Row(ord=ord_, src_ord=int(r.src_ord), src_lsn=created[int(r.snap_id)], created_lsn=r.lsn, dropped_lsn=None)
    return [out[k] for k in sorted(out)]


def prune(spark: SparkSession, path: str, checkpoint: int) -> list[str]:
    """Deletes segments that hold nothing past the checkpoint, and returns their names. The newest one stays. A segment ends before the first lsn of the next, which its name gives."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = sorted((f.getPath() for f in fs.listStatus(root) if f.getPath().getName().startswith("wal-")), key=lambda p: p.getName())
    gone = [p for p, after in zip(files, files[1:]) if int(after.getName()[4:24]) - 1 <= checkpoint]
    for p in gone:
        fs.delete(p, False)
    return [p.getName() for p in gone]


def segments(log: DataFrame, records_a_segment: int = 4096) -> DataFrame:
    """name, content of segments that hold log (columns of SCHEMA, lsn and op_seq set): for export by any writer of files. Dealt by ranges of lsn, one segment at a time in memory."""
    rows = log.withColumn("_segment", F.expr(f"lsn div {records_a_segment}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, lsn, ops, out = None, None, [], []
        first = None

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"wal-{first:020}.log"]), pa.array([b"".join(out)], pa.binary())], ["name", "content"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["lsn"] != lsn and ops:
                    out.append(encode_record(lsn, ops))
                    ops = []
                if row["_segment"] != now:
                    if out:
                        yield close()
                    now, out, first = row["_segment"], [], row["lsn"]
                lsn = row["lsn"]
                ops.append(row)
        if ops:
            out.append(encode_record(lsn, ops))
            yield close()

    return rows.repartition("_segment").sortWithinPartitions("_segment", "lsn", "op_seq").mapInArrow(run, "name string, content binary")
