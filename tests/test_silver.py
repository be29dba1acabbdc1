"""Cleaning rules the given tables cannot reach, on a small dirty export."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from bazaarflow.operators import dq, silver
from bazaarflow.schemas import RAW_COLUMNS, RAW_SCHEMA
from bazaarflow.sources import readers, writers

TS = "2010-12-10 10:00:00"
DIRTY = [
    # (Invoice, StockCode, Description, Quantity, InvoiceDate, Price, Customer ID, Country)
    ("1", "A", "gift", "2", TS, "1.5", "12345.0", "France"),
    ("1", "A", "gift", "2", TS, "1.5", "12345.0", "France"),  # exact copy
    ("1", "A", "gift", "2.0", TS, "1.50", "12345", "France"),  # copy that differs only in number format
    ("1", "B", "  ", "1", TS, "2", "A12.0", "France"),  # blank description, id that is not a number
    ("", "B", "x", "1", TS, "2", "1.0", "France"),  # blank invoice
    ("2", " ", "x", "1", TS, "2", "1.0", "France"),  # blank item
    ("2", "C", "x", "1", "10/12/2010", "2", "1.0", "France"),  # bad date
    ("2", "D", "x", "0", TS, "2", "1.0", "France"),  # zero quantity
    ("2", "E", "x", "x", TS, "2", "1.0", "France"),  # unparsable quantity
    ("3", "F", "x", "-1", TS, "2", "7.0", "France"),  # return
    ("3", "G", "x", "1", TS, "-1", "7.0", "France"),  # negative price
    ("3", "H", "x", "1", TS, "", "7.0", "France"),  # blank price
    ("3", "I", "x", "1", TS, "0", "", ""),  # free line, no user, no country
    ("4", "J", "x", "5", TS, "2", "8.0", "France"),  # these two net to zero
    ("4", "J", "x", "-5", TS, "2", "8.0", "France"),
    ("5", "K", "a", "1", TS, "1.00005", "9.0", "Spain"),  # one grain, two prices
    ("5", "K", "b", "2", TS, "2.0", "9.0", "Spain"),
]


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame(DIRTY, RAW_SCHEMA)


def test_silver_rules(raw):
    rows = {(r.invoice_id, r.item_id): r for r in silver.silver_transactions(raw).collect()}
    assert set(rows) == {("1", "A"), ("1", "B"), ("3", "F"), ("3", "I"), ("5", "K")}
    assert rows["1", "A"].quantity == 2 and rows["1", "A"].line_revenue == 3.0 and rows["1", "A"].user_id == "12345"
    assert rows["1", "B"].item_description is None and rows["1", "B"].user_id == "A12.0"
    assert rows["3", "F"].quantity == -1 and rows["3", "F"].line_revenue == -2.0
    assert rows["3", "I"].user_id is None and rows["3", "I"].country is None
    mixed = rows["5", "K"]
    assert (mixed.quantity, mixed.item_description) == (3, "b")
    assert mixed.unit_price == pytest.approx(1.5, abs=1e-4) and mixed.line_revenue == pytest.approx(5.0001, abs=1e-4)
    assert str(rows["1", "A"].event_date) == "2010-12-10"


def test_typed_lines_keep_every_row(raw):
    typed = silver.typed_lines(raw).collect()
    assert len(typed) == len(DIRTY)
    assert sum(r.event_ts is None for r in typed) == 1 and sum(r.quantity is None for r in typed) == 1


def test_quantity_is_rounded_not_truncated(spark):
    rows = [("1", "A", "x", q, TS, "1", "1", "F") for q in ("0.75", "0.85")]
    assert silver.silver_transactions(spark.createDataFrame(rows, RAW_SCHEMA)).first().quantity == 2


def test_bad_timestamp_ratio(raw, spark):
    row = dq.dq_bad_timestamp_ratio(raw).first()
    assert (row.total_rows, row.bad_timestamp_rows, row.passed) == (len(DIRTY), 1, False)
    empty = dq.dq_bad_timestamp_ratio(spark.createDataFrame([], RAW_SCHEMA)).first()
    assert empty.bad_timestamp_ratio == 0.0 and empty.passed


@pytest.mark.parametrize("text", ["2010-13-01 10:00:00", "2010-12-10", "2010-12-10T10:00:00", "2010-12-10 10:00:00.5", "", None])
def test_other_timestamps_become_null(spark, text):
    rows = [("1", "A", "x", "1", text, "1", "1", "F")]
    assert silver.typed_lines(spark.createDataFrame(rows, RAW_SCHEMA)).first().event_ts is None


def test_empty_silver_is_an_error(spark):
    with pytest.raises(ValueError):
        silver.require_event_bounds(silver.silver_transactions(spark.createDataFrame([], RAW_SCHEMA)))


def test_csv_source_and_sinks(spark, raw, tmp_path):
    path = str(tmp_path / "raw")
    raw.coalesce(1).write.option("header", True).csv(path)
    read = readers.raw_csv_source(spark, path)
    assert tuple(read.columns) == RAW_COLUMNS and read.count() == len(DIRTY)
    clean = silver.silver_transactions(read)
    assert writers.parquet_sink(clean, str(tmp_path / "silver")) == 5
    assert readers.parquet_source(spark, str(tmp_path / "silver"), ["user_id"]).count() == 5
    with pytest.raises(ValueError):
        readers.parquet_source(spark, str(tmp_path / "silver"), ["no_such_column"])
    writers.parquet_to_csv_export(spark, str(tmp_path / "silver"), str(tmp_path / "export"))
    assert spark.read.option("header", True).csv(str(tmp_path / "export")).count() == 5


def test_csv_without_a_column_is_rejected(spark, raw, tmp_path):
    path = str(tmp_path / "short")
    raw.drop("Price").coalesce(1).write.option("header", True).csv(path)
    with pytest.raises(ValueError, match="Price"):
        readers.raw_csv_source(spark, path)


def test_required_columns_lists_what_is_absent(raw):
    missing = dq.dq_required_columns(raw.drop("Price", "Country"), RAW_COLUMNS)
    assert [r.missing_column for r in missing.collect()] == ["Country", "Price"]


def test_panel_reader_prunes_and_rejects_empty(spark, tmp_path):
    path = str(tmp_path / "panel")
    rows = [("u1", "2020-01-01"), ("u2", "2020-02-01"), ("u3", "2020-02-01")]
    df = spark.createDataFrame(rows, "user_id string, day string").selectExpr("user_id", "CAST(day AS DATE) AS as_of_date")
    writers.parquet_sink(df, path, partition_by="as_of_date")
    assert readers.read_panel(spark, path, ["2020-02-01"]).count() == 2
    assert readers.read_panel(spark, path, ["2021-01-01"], allow_empty=True).count() == 0
    with pytest.raises(ValueError):
        readers.read_panel(spark, path, ["2021-01-01"])
    with pytest.raises(ValueError):
        readers.read_panel(spark, path, [])


def test_one_snapshot_is_replaced_and_the_others_stay(spark, tmp_path):
    path = f"file://{tmp_path}/panel"
    days = [f"2020-{month:02d}-01" for month in range(1, 13)]

    def rows(value, dates, users=3):
        cells = [(f"u{u}", value, day) for day in dates for u in range(users)]
        return spark.createDataFrame(cells, "user_id string, value int, day string").selectExpr(
            "user_id", "value", "CAST(day AS DATE) AS as_of_date"
        )

    def stored():
        return {(r.user_id, str(r.as_of_date)): r.value for r in spark.read.parquet(path).collect()}

    assert writers.snapshot_sink(rows(1, days), path, days) == dict.fromkeys(days, 3)
    assert writers.snapshot_sink(rows(2, days[4:5], users=2), path, days[4:5]) == {days[4]: 2}
    expected = {(f"u{u}", day): 1 for u in range(3) for day in days if day != days[4]} | {("u0", days[4]): 2, ("u1", days[4]): 2}
    assert stored() == expected
    manifest = writers.run_manifest({"panel": spark.read.parquet(path)}, {})
    assert {r.as_of_date: r.rows for r in manifest.collect()} == {day: 2 if day == days[4] else 3 for day in days}
    # a row of another snapshot, or of none, stops the write; a date without rows keeps what is stored
    for wrong in (rows(3, days[:2]), rows(3, [days[0]]).unionByName(rows(3, [None]))):
        with pytest.raises(Exception, match="not written"):
            writers.snapshot_sink(wrong, path, days[:1])
    with pytest.raises(ValueError, match=days[1]):
        writers.snapshot_sink(rows(4, days[:1]), path, days[:2])
    with pytest.raises(ValueError):
        writers.snapshot_sink(rows(5, days[:1]), path, [])
    assert stored() == expected | {(f"u{u}", days[0]): 4 for u in range(3)}


def test_csv_round_trip_of_quotes_commas_newlines_and_blanks(spark, tmp_path):
    texts = ['12" RULER, RED', "two\nlines", ' "quoted" ', "", None, "back\\slash", "a,b"]
    columns = ", ".join(f"`{name}` string" for name in RAW_COLUMNS)
    rows = spark.createDataFrame([(str(i), "s", t, "1", "2011-01-01 00:00:00", "1.0", "5", "X") for i, t in enumerate(texts)], columns)
    path = f"file://{tmp_path}/lines"
    rows.write.parquet(f"{path}-parquet")
    writers.parquet_to_csv_export(spark, f"{path}-parquet", path)
    back = {r.Invoice: r.Description for r in readers.raw_csv_source(spark, path).collect()}
    assert back == {str(i): t for i, t in enumerate(texts)}


def test_csv_rows_with_missing_fields_fail(spark, tmp_path):
    (tmp_path / "bad.csv").write_text(",".join(RAW_COLUMNS) + "\n1,2,3\n")
    with pytest.raises(Exception, match="MALFORMED|malformed|FAILFAST"):
        readers.raw_csv_source(spark, f"file://{tmp_path}/bad.csv").collect()


def test_exact_sum_equals_the_decimal_sum(spark):
    """Whole units, ties at the ninth decimal, amounts above a million, NULL alone and among others."""
    amounts = {
        "plain": [0.1, 0.2, 0.3, -12.5],
        "ties": [0.000000005, 1.000000015, 2.5e-9, 7.000000025, -0.000000005],
        "large": [123456789.123456789, -1234567.7654321, 1e6, 999999.99999999, 2e20],
        "mixed": [3.30000000000001, 5e14, 0.1, 0.7, None],
        "null": [None, None],
        "noise": [3 * 1.1, 7 * 0.7, 49 * 1.1, 1e5 * 0.12345678],
    }
    rows = spark.createDataFrame([(name, x) for name, xs in amounts.items() for x in xs], "name string, x double")
    plain = F.sum(F.col("x").cast("decimal(38,8)")).cast("double")
    found = rows.groupBy("name").agg(silver._exact_sum(F.col("x")).alias("own"), plain.alias("plain")).collect()
    assert len(found) == len(amounts)
    assert [row["own"] for row in found] == [row["plain"] for row in found]
