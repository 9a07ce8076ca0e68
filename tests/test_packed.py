"""Decode round trip against a small Python packer."""

import random

from plurality.operators.packed import decode_long, decode_wide, effective_overrides, length_audit

FIELDS = [(f"a{i}", [f"v{i}_{j}" for j in range(3 + i % 5)]) for i in range(21)]


def pack(codes, nulls):
    n = len(codes)
    blob = bytearray((n + 1) // 2)
    for i, c in enumerate(codes):
        blob[i // 2] |= (c << 4) if i % 2 else c
    bitmap = bytearray((n + 7) // 8)
    for i in nulls:
        bitmap[i // 8] |= 1 << (i % 8)
    return bytes(blob), bytes(bitmap)


def expected(codes, nulls, overrides, blob_len):
    out = {}
    first = {}
    for fi, v in overrides or []:
        first.setdefault(fi, v)
    for i, (name, vals) in enumerate(FIELDS):
        if first.get(i) is not None:
            out[name] = first[i]
        elif i in nulls:
            out[name] = None
        elif i // 2 >= blob_len:
            out[name] = None
        else:
            out[name] = vals[codes[i]] if codes[i] < len(vals) else None
    return out


def make_rows(n=200, seed=7):
    rnd = random.Random(seed)
    rows, want = [], {}
    for r in range(n):
        codes = [rnd.randrange(16) for _ in FIELDS]
        nulls = {i for i in range(len(FIELDS)) if rnd.random() < 0.2}
        blob, bitmap = pack(codes, nulls)
        if r % 9 == 0:
            blob = blob[:3]
        use_bitmap = r % 4 != 0
        ov = None
        if r % 3 == 0:
            ov = [(rnd.randrange(len(FIELDS)), "ovA"), (rnd.randrange(len(FIELDS)), None), (2, "ovB"), (2, "ovC")]
        rid = None if r % 5 == 0 else f"r{r}"
        key = rid if rid is not None else f"src:{r}"
        rows.append((rid, "src", r, blob, bitmap if use_bitmap else None,
                     [{"field_index": a, "value": b} for a, b in ov] if ov else None))
        want[key] = expected(codes, nulls if use_bitmap else set(), ov, len(blob))
    return rows, want


SCHEMA = ("source_record_id string, source string, source_row_index bigint, attributes binary, null_bitmap binary, "
          "attribute_overrides array<struct<field_index:int,value:string>>")


def test_wide_decode_matches_python(spark):
    rows, want = make_rows()
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.unit_id: {k: r[k] for k, _ in FIELDS} for r in decode_wide(df, FIELDS).collect()}
    assert got == want


def test_long_decode_equals_wide(spark):
    rows, want = make_rows(60, seed=3)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in decode_long(spark, df, FIELDS).collect():
        got.setdefault(r.unit_id, {})[r.field] = r.value
    assert got == want


def test_select_prunes_fields(spark):
    rows, want = make_rows(20)
    df = spark.createDataFrame(rows, SCHEMA)
    out = decode_wide(df, FIELDS, select=["a3", "a7"])
    assert out.columns == ["unit_id", "a3", "a7"]


def test_overrides_first_wins_and_null_falls_through(spark):
    rows = [("k", "s", 0, bytes(11), None, [{"field_index": 2, "value": None}, {"field_index": 2, "value": "late"},
                                             {"field_index": 4, "value": "x"}, {"field_index": 4, "value": "y"}])]
    df = spark.createDataFrame(rows, SCHEMA)
    eff = {(r.field_index, r.value) for r in effective_overrides(df, FIELDS).collect()}
    assert eff == {(4, "x")}
    dec = decode_wide(df, FIELDS).first()
    assert dec["a2"] == FIELDS[2][1][0] and dec["a4"] == "x"


def test_length_audit(spark):
    rows, _ = make_rows(90)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.attributes_status, r.bitmap_status): r.n for r in length_audit(df, len(FIELDS)).collect()}
    assert sum(got.values()) == 90
    assert got.get(("short", "ok"), 0) + got.get(("short", "absent"), 0) == 10


def test_reference_width_round_trip(spark):
    """1,290 nibble fields in 645 bytes, 513 of them selected, as in the
    reference's preparation step."""
    rnd = random.Random(11)
    width = [(f"w{i}", [f"x{i}_{j}" for j in range(4 + i % 8)]) for i in range(1290)]
    chosen = [f"w{i}" for i in range(1290) if i % 5 != 0][:513]
    rows, want = [], {}
    for r in range(12):
        codes = [rnd.randrange(16) for _ in width]
        nulls = {i for i in range(1290) if rnd.random() < 0.1}
        n = len(codes)
        blob = bytearray((n + 1) // 2)
        for i, c in enumerate(codes):
            blob[i // 2] |= (c << 4) if i % 2 else c
        bitmap = bytearray((n + 7) // 8)
        for i in nulls:
            bitmap[i // 8] |= 1 << (i % 8)
        assert len(blob) == 645 and len(bitmap) == 162
        rows.append((f"u{r}", "s", r, bytes(blob), bytes(bitmap), None))
        want[f"u{r}"] = {
            name: (None if i in nulls else (vals[codes[i]] if codes[i] < len(vals) else None))
            for i, (name, vals) in enumerate(width) if name in set(chosen)
        }
    df = spark.createDataFrame(rows, SCHEMA)
    out = decode_wide(df, width, select=chosen)
    assert len(out.columns) == 514
    got = {r.unit_id: {k: r[k] for k in chosen} for r in out.collect()}
    assert got == want


def test_encoding_guard():
    from plurality.operators.packed import check_encoding

    assert check_encoding("nibble", 645, 1290, ("nibble", 645, 1290)) == []
    assert check_encoding("byte", 645, 1290)[0].startswith("unsupported packing")
    assert check_encoding("nibble", 600, 1290)


def test_long_decode_field_filter(spark):
    rows, want = make_rows(30, seed=9)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.unit_id, r.field): r.value for r in decode_long(spark, df, FIELDS, select=["a1", "a20"]).collect()}
    assert {f for _, f in got} == {"a1", "a20"}
    assert all(got[(k, f)] == want[k][f] for k, f in got)


def test_prepare_plan_end_to_end(spark):
    import pytest

    from plurality.plans.prepare import prepare

    rows, want = make_rows(40, seed=21)
    df = spark.createDataFrame(rows, SCHEMA)
    chosen = ["a2", "a5", "a11"]
    back, summary = prepare(spark, df, FIELDS, chosen)
    s = summary.first()
    assert s.rows == 40 and s.attributes == "a11,a2,a5" and s.compression == "zstd"
    got = {r.unit_id: {k: r[k] for k in chosen} for r in back.collect()}
    assert got == {k: {f: v[f] for f in chosen} for k, v in want.items()}
    with pytest.raises(ValueError):
        prepare(spark, df, FIELDS, ["a2", "nope"])
    with pytest.raises(ValueError):
        prepare(spark, df, FIELDS, chosen, packing="byte")
