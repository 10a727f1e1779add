"""Attribute-value rows into one wide, typed row per entity.

Names and values are read with built-in expressions; then ``combineByKey``
keeps, for every entity, one register with a slot per column. Merging two
registers keeps the later cell of each slot, which is associative and
commutative, so duplicates and corrections are resolved on the map side and
one register per entity and partition is all that is shuffled.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.session import small_rows

#: Texts that usually stand for no value, in lower case; the default of ``widen``'s ``fillers``.
FILLERS = (
    "", "-", "--", "?", "n/a", "na", "n.a.", "nil", "nil return", "none", "null",
    "not stated", "not available", "see notice", "tbc", "tba", "tbd", "unknown",
)
#: Words for truth values, and multiples in money texts.
TRUE_WORDS = ("true", "yes", "y", "1", "t")
FALSE_WORDS = ("false", "no", "n", "0", "f")
MULTIPLES = {"thousand": 1_000, "k": 1_000, "million": 1_000_000, "mn": 1_000_000, "m": 1_000_000, "billion": 1_000_000_000, "bn": 1_000_000_000}

MAX_COLUMNS = 5_000
#: Input rows per partition of the registers' shuffle.
ROWS_PER_PARTITION = 500_000

SPARK_TYPES = {"int": T.LongType(), "decimal": T.DecimalType(38, 10), "date": T.DateType(), "boolean": T.BooleanType(), "string": T.StringType()}


def name_key(c: Column) -> Column:
    """Letters and digits of a name in lower case: case, separators and outer white space don't count."""
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]+", ""))


def clean_text(c: Column) -> Column:
    """Trimmed, each run of white space made one space."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), r"^ | $", "")


def read_decimal(c: Column) -> Column:
    """A number with separators, currency, unit words, a percent sign or a multiple; else null."""
    number = r"^(?:[a-z]{0,3}\$|[a-z]{3} |€|£|¥)? ?([+-]?[0-9][0-9,]*(?:\.[0-9]+)?|[+-]?\.[0-9]+) ?(" + "|".join(sorted(MULTIPLES, key=len, reverse=True)) + r")?(?:%| ?%| per ?cent| percent)?$"
    c = F.lower(clean_text(c))
    digits = F.regexp_replace(F.regexp_extract(c, number, 1), ",", "")
    unit = F.regexp_extract(c, number, 2)
    scale = F.lit(1).cast("decimal(11,0)")
    for word, times in MULTIPLES.items():
        scale = F.when(unit == word, F.lit(times).cast("decimal(11,0)")).otherwise(scale)
    return F.when(digits != "", digits.try_cast("decimal(27,10)") * scale).cast("decimal(38,10)")


def read_int(c: Column) -> Column:
    """A whole number, bare or with separators, ``.0`` or a unit word around it; else null."""
    c = F.lower(clean_text(c))
    digits = F.regexp_extract(c, r"^(?:[a-z]+ )?([+-]?[0-9][0-9,]*)(?:\.0+)?(?: [a-z ]+)?$", 1)
    return F.when(digits != "", F.regexp_replace(digits, ",", "").try_cast("bigint"))


def read_date(c: Column) -> Column:
    """A day as 2010-07-06, 2010/07/06, 20100706, 6 July 2010, 6 Jul 2010 or July 6, 2010, time left out; else null."""
    c = F.regexp_replace(clean_text(c), r"(?<=^\d{4}-\d{2}-\d{2})[T ].*$", "")
    c = F.initcap(F.regexp_replace(c, r"(?<=\d)(?:st|nd|rd|th)\b", ""))
    out = F.lit(None).cast("date")
    for shape, form in (
        (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"), (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"), (r"^\d{8}$", "yyyyMMdd"),
        (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"), (r"^\d{1,2} [A-Za-z]{4,} \d{4}$", "d MMMM yyyy"),
        (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy"), (r"^[A-Za-z]{4,} \d{1,2}, \d{4}$", "MMMM d, yyyy"), (r"^\d{1,2} May \d{4}$", "d MMMM yyyy"), (r"^May \d{1,2}, \d{4}$", "MMMM d, yyyy"),
    ):
        out = F.coalesce(out, F.when(c.rlike(shape), F.try_to_timestamp(c, F.lit(form)).cast("date")))
    return out


def read_boolean(c: Column) -> Column:
    """True or false in one of the known words; else null."""
    c = F.lower(clean_text(c))
    return F.when(c.isin(*TRUE_WORDS), True).when(c.isin(*FALSE_WORDS), False)


def decimal_text(c: Column) -> Column:
    """A decimal without trailing zeros or exponent."""
    return F.regexp_replace(F.regexp_replace(c.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def cell_text(c: Column, kind: str) -> Column:
    """The typed value as canonical text."""
    if kind == "decimal":
        return decimal_text(c)
    if kind == "date":
        return F.date_format(c, "yyyy-MM-dd")
    return c.cast("string")


def readable(value: Column, kind: Column, fillers: Sequence[str] = FILLERS) -> Column:
    """``value`` as canonical text of the type named by ``kind``, null where it can't be read or is a filler."""
    text = clean_text(value)
    filler = F.lower(text).isin(*fillers)
    typed = (
        F.when(kind == "int", read_int(value).cast("string"))
        .when(kind == "decimal", decimal_text(read_decimal(value)))
        .when(kind == "date", F.date_format(read_date(value), "yyyy-MM-dd"))
        .when(kind == "boolean", read_boolean(value).cast("string"))
        .when(kind == "string", text)
    )
    return F.when(~filler, typed)


def _decode(text: str, kind: str):
    if kind == "int":
        return int(text)
    if kind == "decimal":
        return Decimal(text)
    if kind == "date":
        return dt.date.fromisoformat(text)
    if kind == "boolean":
        return text == "true"
    return text


def widen(rows: DataFrame, types: DataFrame, keys: Sequence[str] = ("source_ref", "language", "item_id"), name: str = "name", value: str = "value", at: str = "recorded_at", fillers: Sequence[str] = FILLERS) -> DataFrame:
    """One row per ``keys`` with a typed column for each name of ``types`` (name, value_type).

    Of several values of a cell, the latest ``at`` that can be read counts; a
    null ``at`` is older than any time; of equal times the greatest text wins.
    Entities with no readable cell at all still get a row of nulls. Nulls in
    ``name`` or ``value`` make no cell. Names outside ``types`` are ignored.
    Rows whose key is null form an entity of that key. ``types`` is the list
    of columns, so it is read to the driver, and refused beyond ``MAX_COLUMNS``;
    empty ``rows`` give no rows. Texts in ``fillers`` are no values.
    Columns not named, whatever they are called, are ignored.
    """
    spark = rows.sparkSession
    declared = sorted({(r["name"], r["value_type"]) for r in small_rows(types.select("name", "value_type").distinct(), MAX_COLUMNS) if r["name"] is not None and r["value_type"] in SPARK_TYPES})
    slots = [n for n, _ in declared]
    kinds = [k for _, k in declared]
    known = spark.createDataFrame([("".join(c for c in n if c.isalnum()).lower(), i, k) for i, (n, k) in enumerate(declared)], "_key string, _slot int, _kind string")
    cells = rows.select(*keys, F.col(name).alias("_name"), F.col(value).alias("_value"), F.col(at).cast("timestamp").alias("_at"))
    cells = cells.join(F.broadcast(known), name_key(F.col("_name")) == F.col("_key"), "left")  # as many rows as columns
    cells = cells.select(F.struct(*keys).alias("k"), "_slot", F.coalesce(F.unix_micros("_at"), F.lit(-(1 << 62))).alias("t"), readable(F.col("_value"), F.col("_kind"), fillers).alias("v"))
    width, n_keys = len(slots), len(keys)

    def start(cell):
        register = [None] * width
        return merge_cell(register, cell)

    def merge_cell(register, cell):
        slot, t, v = cell
        if slot is not None and v is not None and (register[slot] is None or register[slot] < (t, v)):
            register[slot] = (t, v)
        return register

    def merge(a, b):
        for i, cell in enumerate(b):
            if cell is not None and (a[i] is None or a[i] < cell):
                a[i] = cell
        return a

    def encode(pair):
        key, register = pair
        return (*key, *[None if c is None else _decode(c[1], kinds[i]) for i, c in enumerate(register)])

    # Adaptive execution does not size an RDD's shuffle, so the row count (from the file footers) does.
    parts = max(spark.sparkContext.defaultParallelism, -(-rows.count() // ROWS_PER_PARTITION))
    pairs = cells.rdd.map(lambda r: (tuple(r[0]), (r[1], r[2], r[3])))
    wide = pairs.combineByKey(start, merge_cell, merge, numPartitions=parts).map(encode)
    source = rows.schema
    schema = T.StructType([T.StructField(k, source[k].dataType) for k in keys] + [T.StructField(n, SPARK_TYPES[k]) for n, k in declared])
    assert n_keys + width == len(schema)
    return spark.createDataFrame(wide, schema, verifySchema=False)


def long_cells(wide: DataFrame, types: DataFrame, keys: Sequence[str] = ("source_ref", "language", "item_id")) -> DataFrame:
    """The cells of a wide table that are not null, one per row: ``keys``, name, cell_text."""
    kinds = {r["name"]: r["value_type"] for r in small_rows(types.select("name", "value_type").distinct(), MAX_COLUMNS)}
    pairs = [F.struct(F.lit(c).alias("name"), cell_text(F.col(f"`{c}`"), kinds[c]).alias("cell_text")) for c in wide.columns if c not in keys and c in kinds]
    if not pairs:
        return wide.select(*keys, F.lit("").alias("name"), F.lit("").alias("cell_text")).limit(0)
    return wide.select(*keys, F.inline(F.array(*pairs))).where("cell_text is not null")
