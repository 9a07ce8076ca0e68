"""Decoding of nibble-packed attribute records.

A packed row holds one 4-bit code per field (two fields per byte: the even
field in the low nibble), an optional null bitmap (one bit per field,
least-significant bit first) and an optional sparse override list
``array<struct<field_index:int, value:string>>``. Decoding is a pure
projection. Once per row, in its own projection, the blobs' hex digits are
split into arrays and the override list is folded into a map; each field is
then an O(1) array access, a branch-free digit value and a lookup in a
literal value array, whatever the row width. Field expressions are generated
as SQL text in one ``selectExpr`` (planning cost grows with the field count,
not with thousands of Python-to-JVM calls).

Beyond some hundred fields (``spark.sql.codegen.maxFields``) one expression per
field runs without whole-stage code and costs microseconds a value. There
``decode_batches`` unpacks whole Arrow batches instead: a matrix of nibbles, a
matrix of null bits and one dictionary lookup per column.
"""

from __future__ import annotations

import math
from typing import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plurality.functions.sqltext import sql_string
from plurality.session import bounded_broadcast

Fields = Sequence[tuple[str, Sequence[str]]]


def unit_key(record_id: Column, source: Column, row_index: Column) -> Column:
    """Record id, else ``source:row_index`` (uniqueness is not checked)."""
    return F.coalesce(record_id, F.concat(source, F.lit(":"), row_index.cast("string")))


def _digit_sql(array_col: str, pos: int) -> str:
    code = f"ascii(get({array_col}, {pos}))"
    return f"(({code} & 15) + shiftright({code}, 6) * 9)"


def field_code_sql(index: int, short: str = "null") -> str:
    """SQL text of ``field_code`` (same semantics)."""
    byte = index // 2
    value = _digit_sql("_digits", 2 * byte + (1 if index % 2 == 0 else 0))
    otherwise = " WHEN _attr IS NOT NULL THEN 0" if short == "zero" else ""
    return f"CASE WHEN length(_attr) > {byte} THEN {value}{otherwise} END"


def null_bit_sql(index: int) -> str:
    """SQL text of ``null_bit`` (same semantics)."""
    byte, bit = index // 8, index % 8
    nibble = _digit_sql("_bit_digits", 2 * byte + (1 if bit < 4 else 0))
    return f"coalesce(_bits IS NOT NULL AND length(_bits) > {byte} AND (shiftright({nibble}, {bit % 4}) & 1) = 1, false)"


def decoded_value_sql(index: int, values: Sequence[str], short: str = "null") -> str:
    """SQL text of ``decoded_value``: one string per field, so a wide decode is
    one ``selectExpr`` call however many fields it has."""
    lookup = f"get(array({', '.join(sql_string(v) for v in values)}), {field_code_sql(index, short)})"
    return f"coalesce(try_element_at(_ov, {index}), CASE WHEN {null_bit_sql(index)} THEN NULL ELSE {lookup} END)"


def first_override_map(overrides: Column) -> Column:
    """field_index -> value of the FIRST list entry for that field (a NULL
    value is kept, so it shadows later entries and then falls through). NULL
    entries and entries without a field index are passed over."""
    empty = F.create_map().cast(T.MapType(T.IntegerType(), T.StringType()))
    return F.aggregate(
        F.filter(overrides, lambda x: x["field_index"].isNotNull()),
        empty,
        lambda acc, x: F.when(F.array_contains(F.map_keys(acc), x["field_index"]), acc).otherwise(
            F.map_concat(acc, F.create_map(x["field_index"], x["value"]))
        ),
    )


def with_packed_parts(df: DataFrame, key: Column | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Stage, once per row: unit_id, the blobs (for their byte length), their
    hex digits split into arrays (O(1) access per field at any row width),
    and the override map."""
    key = key if key is not None else unit_key(F.col("source_record_id"), F.col("source"), F.col("source_row_index"))
    return df.select(
        key.alias("unit_id"),
        *keep,
        F.col("attributes").alias("_attr"),
        F.split(F.hex("attributes"), "").alias("_digits"),
        F.col("null_bitmap").alias("_bits"),
        F.split(F.hex("null_bitmap"), "").alias("_bit_digits"),
        first_override_map(F.col("attribute_overrides")).alias("_ov"),
    )


def byte_sql(blob: str, position: int) -> str:
    """SQL text: one byte of a binary as an int, NULL beyond its end."""
    return f"CASE WHEN length({blob}) > {position} THEN CAST(conv(hex(substring({blob}, {position + 1}, 1)), 16, 10) AS INT) END"


def picked_value_sql(index: int, values: Sequence[str], short: str = "null") -> str:
    """SQL text of a field's value read straight from the blobs: the bytes of
    this field only, and the first override entry for it."""
    override = f"get(filter(attribute_overrides, x -> x.field_index = {index}), 0).value"
    code = f"(shiftright({byte_sql('attributes', index // 2)}, {4 * (index % 2)}) & 15)"
    if short == "zero":
        code = f"coalesce({code}, CASE WHEN attributes IS NOT NULL THEN 0 END)"
    bit = f"coalesce((shiftright({byte_sql('null_bitmap', index // 8)}, {index % 8}) & 1) = 1, false)"
    lookup = f"get(array({', '.join(sql_string(v) for v in values)}), {code})"
    return f"coalesce({override}, CASE WHEN {bit} THEN NULL ELSE {lookup} END)"


def decode_fields(df: DataFrame, fields: Fields, select: Sequence[str], short: str = "null", keep: Sequence[str] = ()) -> DataFrame:
    """``unit_id`` + the selected fields, in schema order. For a few fields of
    a wide schema: reads only their bytes, without splitting the blobs."""
    wanted = set(select)
    key = unit_key(F.col("source_record_id"), F.col("source"), F.col("source_row_index"))
    cols = [f"{picked_value_sql(i, vals, short)} AS `{name}`" for i, (name, vals) in enumerate(fields) if name in wanted]
    return df.withColumn("unit_id", key).selectExpr("unit_id", *[f"`{k}`" for k in keep], *cols)


def decode_wide(df: DataFrame, fields: Fields, select: Sequence[str] | None = None, short: str = "null",
                keep: Sequence[str] = ()) -> DataFrame:
    """``unit_id`` + one string column per selected field (by name, in schema
    order); unselected fields are never computed."""
    wanted = set(select) if select is not None else None
    staged = with_packed_parts(df, keep=keep)
    cols = [
        f"{decoded_value_sql(i, vals, short)} AS `{name}`"
        for i, (name, vals) in enumerate(fields)
        if wanted is None or name in wanted
    ]
    return staged.selectExpr("unit_id", *[f"`{k}`" for k in keep], *cols)


def _padded(blobs, width: int):
    """(bytes as a rows x width matrix, bytes present per row; none for NULL)."""
    import numpy as np
    import pyarrow as pa

    blobs = blobs.cast(pa.binary())
    _, ends, data = blobs.buffers()
    ends = np.frombuffer(ends, np.int32, len(blobs) + 1, blobs.offset * 4)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)
    size = np.where(blobs.is_valid().to_numpy(zero_copy_only=False), np.diff(ends), 0)
    at = ends[:-1, None] + np.arange(width)
    return np.where(np.arange(width) < size[:, None], data[np.minimum(at, len(data) - 1)], 0), size


def _first_overrides(lists):
    """(row, field, value) of each row's first override entry per field; NULL entries and entries without a field are passed over."""
    import numpy as np
    import pyarrow as pa

    entries = lists.flatten()
    if not len(entries):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), pa.array([], pa.string())
    sizes = np.array([0 if x is None else x for x in lists.value_lengths().to_pylist()])
    row = np.repeat(np.arange(len(lists)), sizes)
    index, values = entries.flatten()
    known = np.flatnonzero(index.is_valid().to_numpy(zero_copy_only=False))
    field = index.take(pa.array(known)).to_numpy(zero_copy_only=False).astype(np.int64)
    row = row[known]
    _, first = np.unique(row * (1 << 32) + field, return_index=True)
    return row[first], field[first], values.take(pa.array(known[first]))


def decode_batches(df: DataFrame, fields: Fields, select: Sequence[str] | None = None, short: str = "null", keep: Sequence[str] = ()) -> DataFrame:
    """``decode_wide`` for wide selections: the same rows, unpacked batch by batch."""
    wanted = set(select) if select is not None else None
    chosen = [(i, name, list(vals)) for i, (name, vals) in enumerate(fields) if wanted is None or name in wanted]
    staged = df.select(unit_key(F.col("source_record_id"), F.col("source"), F.col("source_row_index")).alias("unit_id"), *keep,
                       "attributes", "null_bitmap", "attribute_overrides")
    schema = T.StructType([*[f for f in staged.schema if f.name in ("unit_id", *keep)], *[T.StructField(name, T.StringType()) for _, name, _ in chosen]])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        index = np.array([i for i, _, _ in chosen], np.int64)
        tables = [pa.array(vals, pa.string()) for _, _, vals in chosen]
        limits = np.array([len(vals) for _, _, vals in chosen])
        place = {i: k for k, (i, _, _) in enumerate(chosen)}
        half, eighth = int(index.max(initial=0)) // 2 + 1, int(index.max(initial=0)) // 8 + 1
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                blob, size = _padded(batch.column("attributes"), half)
                bits, _ = _padded(batch.column("null_bitmap"), eighth)
                code = (blob[:, index // 2] >> (4 * (index % 2)).astype(np.uint8)) & 15
                absent = (code >= limits) | ((bits[:, index // 8] >> (index % 8).astype(np.uint8)) & 1 == 1)
                beyond = index // 2 >= size[:, None]
                if short == "zero":
                    beyond &= ~batch.column("attributes").is_valid().to_numpy(zero_copy_only=False)[:, None]
                absent |= beyond
                columns = [table.take(pa.array(code[:, k].astype(np.int32), mask=absent[:, k])) for k, table in enumerate(tables)]
                row, field, value = _first_overrides(batch.column("attribute_overrides"))
                given = value.is_valid().to_numpy(zero_copy_only=False)
                for i in np.unique(field[given]).tolist():
                    if i in place:
                        mine = np.flatnonzero(given & (field == i))
                        mask = np.zeros(batch.num_rows, bool)
                        mask[row[mine]] = True
                        columns[place[i]] = pc.replace_with_mask(columns[place[i]], pa.array(mask), value.take(pa.array(mine)))
                yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in schema if f.name in ("unit_id", *keep)], *columns], schema.names)

    return staged.mapInArrow(run, schema)


def dictionary_frame(spark, fields: Fields) -> DataFrame:
    """Long dictionary ``(field_index, field, code, value)``; bounded by
    fields x 16 codes, hence safe to broadcast."""
    rows = [(i, name, code, v) for i, (name, vals) in enumerate(fields) for code, v in enumerate(vals)]
    return spark.createDataFrame(rows, "field_index int, field string, code int, value string").coalesce(1)


def decode_long(spark, df: DataFrame, fields: Fields, short: str = "null", select: Sequence[str] | None = None) -> DataFrame:
    """Long form ``unit_id, field_index, field, value`` via a broadcast join of
    (field_index, code) against the dictionary; same semantics as the wide
    form. It emits rows x fields rows, so pass ``select`` (field names) for
    wide schemas."""
    wanted = set(select) if select is not None else None
    staged = with_packed_parts(df)
    rows = [
        f"{i}, CASE WHEN {null_bit_sql(i)} THEN CAST(NULL AS INT) ELSE {field_code_sql(i, short)} END, try_element_at(_ov, {i})"
        for i, (name, _) in enumerate(fields)
        if wanted is None or name in wanted
    ]
    long = staged.selectExpr("unit_id", f"stack({len(rows)}, {', '.join(rows)}) AS (field_index, code, override)")
    dic = bounded_broadcast(dictionary_frame(spark, fields), sum(len(v) for _, v in fields))
    joined = long.join(dic.select("field_index", "code", "value"), ["field_index", "code"], "left")
    names = F.array(*[F.lit(name) for name, _ in fields])
    return joined.select(
        "unit_id", "field_index", F.get(names, F.col("field_index")).alias("field"),
        F.coalesce(F.col("override"), F.col("value")).alias("value"),
    )


def effective_overrides(df: DataFrame, fields: Fields) -> DataFrame:
    """Overrides that take effect: first entry per field with a non-NULL
    value, for fields of the schema. ``unit_id, field_index, field, value``."""
    staged = with_packed_parts(df)
    names = F.array(*[F.lit(name) for name, _ in fields])
    return (
        staged.select("unit_id", F.explode("_ov").alias("field_index", "value"))
        .where(F.col("value").isNotNull() & (F.col("field_index") >= 0) & (F.col("field_index") < len(fields)))
        .select("unit_id", "field_index", F.get(names, F.col("field_index")).alias("field"), "value")
    )


def length_audit(df: DataFrame, n_fields: int) -> DataFrame:
    """Rows per (blob status, bitmap status) against the sizes the schema
    implies: ceil(n/2) bytes of codes, ceil(n/8) bytes of bitmap."""
    want_attr, want_bits = math.ceil(n_fields / 2), math.ceil(n_fields / 8)

    def status(col: str, want: int) -> Column:
        n = F.length(F.col(col))
        return (
            F.when(F.col(col).isNull(), F.lit("absent"))
            .when(n < want, F.lit("short"))
            .when(n > want, F.lit("long"))
            .otherwise(F.lit("ok"))
        )

    return df.groupBy(
        status("attributes", want_attr).alias("attributes_status"), status("null_bitmap", want_bits).alias("bitmap_status")
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.length("attributes")).cast("bigint").alias("min_bytes"),
        F.max(F.length("attributes")).cast("bigint").alias("max_bytes"),
    )


def check_encoding(packing: str, row_bytes: int, n_columns: int, expected=("nibble", None, None)) -> list[str]:
    """Driver-side guard of an encoding schema; returns problems (empty = ok)."""
    problems = []
    if packing != expected[0]:
        problems.append(f"unsupported packing {packing!r}")
    if row_bytes * 2 < n_columns:
        problems.append(f"{row_bytes} bytes cannot hold {n_columns} nibble fields")
    if expected[1] is not None and row_bytes != expected[1]:
        problems.append(f"row_bytes {row_bytes} != {expected[1]}")
    if expected[2] is not None and n_columns != expected[2]:
        problems.append(f"column count {n_columns} != {expected[2]}")
    return problems
