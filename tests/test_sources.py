import shutil
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tapeworks.functions.cells import spark_pattern
from tapeworks.operators import rules
from tapeworks.sources import bars as src
from tapeworks.sources import reference, sinks

COLUMNS = {
    "symbol": "Ticker", "ts": "At", "open": "O", "high": "H", "low": "L", "close": "C", "volume": "Q",
}
FIXED = {"asset_class": "equity", "exchange": "NSE"}
HEAD = "Ticker,At,O,H,L,C,Q\n"
GOOD = "DEMO,2025-01-02T09:16:00+05:30,100.00,101.00,99.50,100.50,1000\n"


def mapping(**changes):
    return src.CsvMapping(**({"provider": "feed", "columns": COLUMNS, "defaults": FIXED} | changes))


def write(tmp_path, text, name="feed.csv"):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


@pytest.mark.parametrize(
    "changes",
    [
        {"columns": COLUMNS | {"colour": "X"}},
        {"defaults": FIXED | {"symbol": "A"}},
        {"defaults": {"exchange": "NSE"}},
        {"delimiter": "::"},
    ],
)
def test_bad_mappings(changes):
    with pytest.raises(ValueError):
        mapping(**changes)


@pytest.mark.parametrize("text", ["", "Ticker,Ticker\n", "Ticker,At,O,H,L,C\n"])
def test_bad_headers(spark, tmp_path, text):
    with pytest.raises(ValueError):
        src.scan_csv(spark, write(tmp_path, text), mapping())


def test_scan_and_validate(spark, tmp_path):
    lines = [
        GOOD,
        GOOD.replace("09:16", "09:17").replace(",1000", ",1000,9"),  # extra cell
        GOOD.replace("09:16", "09:18").replace(",1000", ""),  # missing cell
        GOOD.replace("09:16", "09:19").replace("1000", "1.5"),
        GOOD.replace("09:16", "09:20").replace("+05:30", ""),
        GOOD.replace("09:16", "09:21").replace("99.50", "100.90"),
        GOOD.replace("09:16", "09:22").replace("101.00", "NaN"),
        GOOD.replace("09:16", "09:23").replace("1000", "-1"),
        GOOD.replace("09:16", "09:24").replace("100.50", ""),
        GOOD.replace("09:16", "09:15"),  # goes back
        GOOD.replace("DEMO", "OTHER").replace("100.50", "100.123456"),
    ]
    path = write(tmp_path, "﻿" + HEAD + "".join(lines))
    raw = src.scan_csv(spark, path, mapping())
    assert raw.filter("bad_structure").count() == 2
    checked = rules.validate_bars(raw.filter("NOT bad_structure"))
    found = {r.ts and r.ts.minute: r.reasons for r in checked.orderBy("row_id").collect()}
    reasons = [r.reasons for r in checked.orderBy("row_id").collect()]
    assert reasons[0] == []
    assert reasons[1:6] == [["bad_volume"], ["bad_timestamp"], ["bad_ohlc"], ["bad_price"], ["bad_volume"]]
    assert reasons[6] == ["missing_required"] and "unsupported_scale" in reasons[8]
    assert len(found) > 3
    good = rules.split(checked)[0].filter("symbol = 'DEMO'")
    late = rules.chronology(good, ["source_file", "symbol"])
    assert [r.out_of_order for r in late.orderBy("row_id").collect()] == [False, True]
    first = good.orderBy("row_id").first()
    assert first.ts == datetime(2025, 1, 2, 3, 46) and first.volume == 1000
    with pytest.raises(Exception, match="rejected row"):
        rules.require_clean(checked).collect()


def test_timestamp_patterns(spark):
    from tapeworks.functions.cells import utc_instant

    assert spark_pattern("%d/%m/%Y T%H:%M%z") == "dd/MM/yyyy 'T'HH:mmXX"
    with pytest.raises(ValueError):
        spark_pattern("%Q")
    df = spark.createDataFrame([("02/01/2025 09:16 +0530",)], "t string")
    at = df.select(utc_instant(F.col("t"), "%d/%m/%Y %H:%M %z").alias("a")).first()["a"]
    assert at == datetime(2025, 1, 2, 3, 46)
    assert df.select(utc_instant(F.col("t"), "%d/%m/%Y %H:%M").alias("a")).first()["a"] is None


def test_derivative_rules(spark):
    base = dict(
        asset_class="option", symbol="X", exchange="NSE", ts="2025-01-02T04:00:00Z", open="1",
        high="1", low="1", close="1", volume="1", underlying="U", expiry="2025-01-02",
        strike="10.0", option_type="CE", open_interest="0",
    )
    cases = [
        ({}, []),
        ({"strike": None}, ["option_fields"]),
        ({"asset_class": "future"}, ["option_fields"]),
        ({"underlying": None}, ["derivative_fields_missing"]),
        ({"expiry": "2025-01-01"}, ["after_expiry"]),
        # 19:00 UTC is already the next day in the market zone.
        ({"ts": "2025-01-02T19:00:00Z"}, ["after_expiry"]),
        ({"asset_class": "equity"}, ["equity_with_derivative_fields"]),
        ({"asset_class": "bond"}, ["unknown_enum"]),
        ({"symbol": " X"}, ["bad_name"]),
    ]
    for changes, want in cases:
        row = base | changes
        df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row))
        assert rules.validate_bars(df).first().reasons == want, changes


def test_sinks_are_write_once_and_round_trip(spark, tmp_path):
    raw = src.scan_csv(spark, write(tmp_path, HEAD + GOOD), mapping())
    bars = rules.split(rules.validate_bars(raw))[0]
    out = str(tmp_path / "bars")
    sinks.write_bars(bars, out)
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_bars(bars, out)
    back = src.scan_parquet(spark, out)
    row = back.first()
    assert (row.asset_class, row.year, row.month) == ("equity", 2025, 1)
    assert src.bars_between(back, "DEMO", "2025-01-02 03:46:00", "2025-01-02 03:47:00").count() == 1
    assert src.bars_between(back, "DEMO", "2025-01-02 03:45:00", "2025-01-02 03:46:00").count() == 0
    lines = str(tmp_path / "lines")
    sinks.write_json_lines(bars, lines)
    assert src.scan_json_lines(spark, lines).first().close == row.close


def test_manifest_notices_a_changed_value(spark):
    rows = [("A", datetime(2025, 1, d), float(d)) for d in range(1, 6)]
    bars = spark.createDataFrame(rows, "instrument_id string, ts timestamp, close double")
    kept = sinks.manifest(bars, "feed", "f.csv", "{}", True)
    assert sinks.verify_manifest(kept, sinks.manifest(bars.orderBy("close"), "feed", "f.csv", "{}", True)).count() == 0
    other = bars.withColumn("close", F.when(F.col("close") == 3, 3.5).otherwise(F.col("close")))
    changed = sinks.verify_manifest(kept, sinks.manifest(other, "feed", "f.csv", "{}", True))
    assert {r.field for r in changed.collect()} == {"import_id", "data_sha256"}


def test_calendar_and_contract_documents(spark, tmp_path):
    text = (
        '{"source": "x", "sessions": [{"session_date": "2025-01-02", "opens_at": '
        '"2025-01-02T09:15:00+05:30", "closes_at": "2025-01-02T15:30:00+05:30"}],\n'
        ' "holidays": ["2025-01-03"], "expiries": ["2025-01-30"]}'
    )
    sessions, holidays, expiries = reference.read_calendar(spark, write(tmp_path, text, "c.json"))
    row = sessions.first()
    assert row.opens_at == datetime(2025, 1, 2, 3, 45) and row.special is False
    assert holidays.first()[0] == date(2025, 1, 3) and expiries.count() == 1
    text = '[{"contract_id": "C", "instrument_type": "FUTSTK", "symbol": "X", "lot_size": 10, "tick_size": "0.05"}]'
    assert str(reference.read_contracts(spark, write(tmp_path, text, "k.json")).first().tick_size) == "0.0500"
    with pytest.raises(ValueError):
        reference.latest(holidays, 0)


def test_second_file_with_other_columns_stops_the_scan(spark, tmp_path):
    folder = tmp_path / "feed"
    folder.mkdir()
    (folder / "a.csv").write_text(HEAD + GOOD)
    (folder / "b.csv").write_text(HEAD.replace("O,H", "H,O") + GOOD)
    with pytest.raises(Exception, match="(?i)header"):
        src.scan_csv(spark, str(folder), mapping()).collect()


def test_shared_folder_must_be_named_off_one_machine(spark, monkeypatch):
    from tapeworks import session

    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())


def test_digits_beyond_any_scale_are_seen(spark, tmp_path):
    lines = [GOOD.replace("100.50", x) for x in ("100.50000000000", "100.50000000001", "100.5001", "100.50001")]
    raw = src.scan_csv(spark, write(tmp_path, HEAD + "".join(lines)), mapping())
    rows = rules.validate_bars(raw).orderBy("row_id").select("reasons").collect()
    assert ["unsupported_scale" in r.reasons for r in rows] == [False, True, False, True]


def test_stored_import_is_checked_partition_by_partition(spark, tmp_path):
    rows = [("equity", "A", "NSE", datetime(2025, m, d), i) for i, (m, d) in enumerate([(1, 2), (1, 3), (2, 3), (3, 4)])]
    bars = spark.createDataFrame(rows, "asset_class string, symbol string, exchange string, ts timestamp, volume long")
    path, kept = str(tmp_path / "bars"), str(tmp_path / "leaves")
    sinks.write_bars(bars, path)
    sinks.store_manifest(spark, path, kept)
    assert sinks.verify_import(spark, path, kept).count() == 0
    assert sinks.verify_import(spark, path, kept, full=True).count() == 0
    # One month is written again with another value, one has gone, one is new.
    shutil.rmtree(f"{path}/asset_class=equity/year=2025/month=2")
    shutil.rmtree(f"{path}/asset_class=equity/year=2025/month=3")
    more = spark.createDataFrame(
        [("A", "NSE", datetime(2025, 2, 3), 7), ("A", "NSE", datetime(2025, 4, 3), 7)],
        "symbol string, exchange string, ts timestamp, volume long",
    )
    for month in (2, 4):
        part = more.filter(F.month("ts") == month)
        part.write.parquet(f"{path}/asset_class=equity/year=2025/month={month}")
    found = sinks.verify_import(spark, path, kept).collect()
    got = {(r.month, r.field, r.stored is None, r.found is None) for r in found}
    assert got == {(2, "a", False, False), (2, "b", False, False), (3, "partition", False, True), (4, "partition", True, False)}


def test_digests_keep_cells_apart(spark):
    df = spark.createDataFrame([("a", "bc"), ("ab", "c"), ("", None), (None, "")], "x string, y string")
    assert df.select(sinks.row_digest(df, ["x", "y"]).alias("d")).distinct().count() == 4
