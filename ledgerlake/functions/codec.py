"""Fixed-width values as columns: a 28-byte block value and its nine fields, big-endian, both ways without loss."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fields of a block value and their bytes, in order.
FIELDS = (("pba", 8), ("compression", 1), ("unit_compressed_size", 4), ("unit_original_size", 4), ("unit_lba_count", 2), ("offset_in_unit", 2), ("crc32", 4), ("slot_offset", 2), ("flags", 1))
#: Two values lie in one unit iff these are equal.
UNIT_FIELDS = tuple(n for n, _ in FIELDS if n != "offset_in_unit")


def pack_value(value: Column | str) -> Column:
    """Struct to 28 bytes. pba may be a decimal of up to 20 digits for addresses from 2^63."""
    v = F.col(value) if isinstance(value, str) else value
    parts = [F.lpad(F.conv(v[n].cast("string"), 10, 16), 2 * w, "0") for n, w in FIELDS]
    return F.unhex(F.concat(*parts))


def unpack_value(raw: Column | str, wide: bool = False) -> Column:
    """28 bytes to the struct; wide gives pba as decimal(20, 0), else as a long."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    out, at = [], 1
    for n, w in FIELDS:
        number = F.conv(F.hex(F.substring(raw, at, w)), 16, 10)
        out.append(number.cast("decimal(20,0)" if n == "pba" and wide else "long").alias(n))
        at += w
    return F.struct(*out)


def head_pba(raw: Column | str) -> Column:
    """The first 8 bytes, which alone matter to reference counts."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    return F.conv(F.hex(F.substring(raw, 1, 8)), 16, 10).cast("decimal(20,0)")


def same_unit(a: Column, b: Column) -> Column:
    out = F.lit(True)
    for n in UNIT_FIELDS:
        out = out & a[n].eqNullSafe(b[n])
    return out


def released_blocks(slot_offset: Column, unit_compressed_size: Column) -> Column:
    """4 KiB blocks that go when a physical address is freed: one for a packed or small unit, else its size rounded up."""
    return F.when((slot_offset > 0) | (unit_compressed_size < 4096), F.lit(1)).otherwise(F.ceil(unit_compressed_size / F.lit(4096.0))).cast("long")


def reverse_key(pba: Column, hash_hex: Column) -> Column:
    """Key of the reverse index: the address and 24 of the hash's 32 bytes; hashes that share these collide, and the later one holds."""
    return F.concat(F.lpad(F.lower(F.conv(pba.cast("string"), 10, 16)), 16, "0"), F.substring(hash_hex, 1, 48))


def leaf_bytes(units: Column) -> Column:
    """Size of a leaf of 128 entries that share a dictionary of units."""
    return (F.lit(402) + 26 * units).cast("long")
