"""Encoded stream positions and ordered key bytes, as column expressions.

A position is sequential or relaxed; both fit one 64-bit number whose low bit is the kind.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronolith.errors import BAD_KEY

SEPARATOR_HEX = "7C"  # the byte between a stream's name and its position


def encode(position: Column, relaxed: Column | bool = False) -> Column:
    kind = relaxed if isinstance(relaxed, Column) else F.lit(relaxed)
    return F.shiftleft(position.cast("long"), 1).bitwiseOR(kind.cast("int").cast("long"))


def is_relaxed(encoded: Column) -> Column:
    return encoded.bitwiseAND(F.lit(1).cast("long")) == 1


def position(encoded: Column) -> Column:
    return F.shiftright(encoded, 1)


def following(encoded: Column) -> Column:
    """The next position of the same kind."""
    return encoded + 2


def _hex16(x: Column) -> Column:
    return F.lpad(F.hex(x), 16, "0")


def global_key(global_position: Column) -> Column:
    """Upper-case hex of the big-endian key, whose byte order is the numeric order."""
    return _hex16(global_position)


def parse_global_key(key: Column) -> Column:
    """The position of a hex key; null unless the key is exactly eight bytes."""
    return F.when(key.rlike("^[0-9A-F]{16}$"), F.conv(key, 16, 10).cast("long"))


def stream_key(stream_name: Column, encoded: Column) -> Column:
    return F.concat(F.hex(stream_name.cast("binary")), F.lit(SEPARATOR_HEX), _hex16(encoded))


def next_stream_key(stream_name: Column, encoded: Column) -> Column:
    """The key of the stream's next position of the same kind."""
    return stream_key(stream_name, following(encoded))


def max_stream_key(stream_name: Column) -> Column:
    """The key after which no other of the stream can come: all bits of the position are set."""
    return F.concat(F.hex(stream_name.cast("binary")), F.lit(SEPARATOR_HEX), F.lit("F" * 16))


def key_error(parsed: Column) -> Column:
    """Why a key gave no position; null for one that did."""
    return F.when(parsed.isNull(), BAD_KEY)


def parse_stream_key(key: Column) -> Column:
    """struct(stream_name, position_enc); null where the key is short, lacks the separator or names no stream."""
    n = F.length(key)
    name = F.unhex(F.substr(key, F.lit(1), n - 18)).cast("string")
    ok = (n > 18) & (F.substr(key, n - 17, F.lit(2)) == SEPARATOR_HEX)
    return F.when(ok, F.struct(name.alias("stream_name"), F.conv(F.substr(key, n - 15), 16, 10).cast("long").alias("position_enc")))
