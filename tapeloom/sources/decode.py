"""Fields of a record as columns: raw cells for filters, decoded values for the result."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.errors import FeedError
from tapeloom.functions import values as V
from tapeloom.sources.layouts import SPARK_TYPES, Field, Version

RAW = "_record"

_PARSE: dict[str, Callable[[Column], Column]] = {
    "u8": V.small_number,
    "u64": V.whole_number,
    "price": V.whole_number,
    "jiffies": V.whole_number,
    "bool_yn": V.flag_of_yn,
    "date_dmmmy": V.date_of_dmmmy,
    "date_ymd": V.date_of_ymd,
    "time_hms": V.seconds_of_hms,
}


def cell(f: Field, raw: str = RAW) -> Column:
    """The bytes of a field as text; offsets count bytes, whatever characters a record holds."""
    return F.substring(F.col(raw), f.offset + 1, f.length).cast("string")


def _value(f: Field, text: Column, strict: bool) -> Column:
    """The value of a cut cell.  Blank is null, but blank text is ''; a bad cell is an error (strict) or null."""
    kind = SPARK_TYPES[f.type]
    refuse = F.raise_error(F.concat(F.lit(f"field {f.name}: bad value '"), text, F.lit("'")))
    if f.type == "str":
        bad = refuse.cast("string") if strict else F.lit(None).cast("string")
        value = F.when(F.is_valid_utf8(text), V.unpad(text, f.pad)).otherwise(bad)
    else:
        value = _PARSE[f.type](text)
        if strict:
            none = F.lit(None).cast(value_type(f))
            value = F.coalesce(value, F.when(V.is_blank(text), none).otherwise(refuse.cast(value_type(f))))
        if f.type == "jiffies":
            value = V.timestamp_of_micros(V.micros_of_ticks(value))
        value = value.cast(kind)
    return value.alias(f.name, metadata=f.spark.metadata)


def decode(df: DataFrame, fields: Sequence[Field], strict: bool = True, keep: Sequence[str] = (), raw: str = RAW) -> DataFrame:
    """Decoded columns of records, after the columns ``keep``: every cell is cut once, then parsed."""
    cells = df.select(*keep, *[cell(f, raw).alias(f"_cell_{f.name}") for f in fields])
    return cells.select(*keep, *[_value(f, F.col(f"_cell_{f.name}"), strict) for f in fields])


def value_type(f: Field) -> str:
    """Type of a value before conversion to the column's type."""
    return {"u8": "smallint", "u64": "bigint", "price": "bigint", "jiffies": "bigint", "bool_yn": "boolean", "date_dmmmy": "date", "date_ymd": "date", "time_hms": "int"}[f.type]


def projection(version: Version, select: list[str] | None) -> list[Field]:
    """The chosen fields in layout order; unknown names and empty choices are errors."""
    if select is None:
        return list(version.fields)
    if not select:
        raise FeedError("the selection is empty")
    for name in select:
        version.field(name)
    wanted = set(select)
    return [f for f in version.fields if f.name in wanted]
