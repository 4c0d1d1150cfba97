"""Stream names: ``category-id+...`` as storage splits them and ``component-id:extra`` as entities do.

A separator at the very start is a separator like any other and leaves an empty first part.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The digits of base 32 and the id alphabet in the same order.
BASE32_DIGITS = "0123456789abcdefghijklmnopqrstuv"
ID_ALPHABET = "0123456789abcdefghjkmnpqrstvwxyz"


def _before(text: Column, mark: str) -> Column:
    return F.when(F.instr(text, mark) > 0, F.substring_index(text, mark, 1)).otherwise("")


def category(name: Column) -> Column:
    """Text before the first dash; empty without one."""
    return _before(name, "-")


def stream_id(name: Column) -> Column:
    """Text after the first dash; the whole name without one."""
    return F.substr(name, F.instr(name, "-") + 1)


def cardinal_id(name: Column) -> Column:
    """The stream id before its first plus; empty without one."""
    return _before(stream_id(name), "+")


def correlation_category(metadata: Column) -> Column:
    return category(F.get_json_object(metadata, "$.correlationStreamName"))


def component(name: Column) -> Column:
    """Text before the first dash or colon."""
    return F.regexp_extract(name, "^([^:-]*)", 1)


def entity_id(name: Column) -> Column:
    """Between the first dash and the first colon; null without a dash before the colon."""
    return F.when(name.rlike("^[^:-]*-"), F.regexp_extract(name, "^[^:-]*-([^:]*)", 1))


def extra(name: Column) -> Column:
    """All after the first colon; null without one."""
    return F.when(F.instr(name, ":") > 0, F.substr(name, F.instr(name, ":") + 1))


def build(component_: Column, id_: Column, extras: Column | None = None) -> Column:
    """``component-id`` and, after a colon, the extras joined by commas; empty for an empty component."""
    base = F.concat_ws("-", component_, id_)
    full = base if extras is None else F.when(F.size(extras) > 0, F.concat(base, F.lit(":"), F.array_join(extras, ","))).otherwise(base)
    return F.when(component_ == "", "").otherwise(full)


def encode_id(number: Column) -> Column:
    """Twenty base-32 symbols in groups of 6, 8 and 6, of a non-negative 64-bit number."""
    digits = F.translate(F.lower(F.conv(number.cast("string"), 10, 32)), BASE32_DIGITS, ID_ALPHABET)
    return F.regexp_replace(F.lpad(digits, 20, "0"), "^(.{6})(.{8})(.{6})$", "$1-$2-$3")


def encode_wide_id(number: Column) -> Column:
    """The same of a non-negative number below 2^100, given as decimal(38,0): two halves of 50 bits, ten symbols each."""
    half = F.lit(1 << 50).cast("decimal(38,0)")
    wide = number.cast("decimal(38,0)")
    digits = lambda x: F.lpad(F.lower(F.conv(x.cast("string"), 10, 32)), 10, "0")
    both = F.concat(digits(F.call_function("div", wide, half)), digits((wide % half).cast("long")))
    return F.regexp_replace(F.translate(both, BASE32_DIGITS, ID_ALPHABET), "^(.{6})(.{8})(.{6})$", "$1-$2-$3")
