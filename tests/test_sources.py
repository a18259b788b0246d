import datetime
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tidegauge.sources import facts, fails, lists, prices

ROWS = ["20260901|037833100|AAPL|10|APPLE INC|200.1", "20260902|594918104|MSFT|5|SOCIÉTÉ|."]


def ftd_file(folder, name, rows=ROWS, header=fails.HEADER, count=None):
    count = len(rows) if count is None else count
    lines = [header, *rows, f"Trailer record count {count}", "Trailer total quantity of shares 15"]
    (folder / name).write_bytes(("\r\n".join(lines) + "\r\n").encode("latin-1"))


def test_fails_to_deliver_files_are_audited(spark, tmp_path):
    ftd_file(tmp_path, "cnsfails202609a.txt")
    ftd_file(tmp_path, "cnsfails202609b")
    ftd_file(tmp_path, "cnsfails202608a.txt", header="SETTLEMENT DATE|CUSIP")
    ftd_file(tmp_path, "cnsfails202608b.txt", count=9)
    audit = {r["source_file"]: r for r in fails.ftd_file_audit(spark, str(tmp_path)).collect()}
    assert {n for n, r in audit.items() if r["accepted"]} == {"cnsfails202609a.txt", "cnsfails202609b"}
    assert audit["cnsfails202608a.txt"]["reason"] == "unexpected header"
    assert audit["cnsfails202608b.txt"]["reason"] == "rows differ from the trailer's count"
    rows, rejected = fails.load_new_files(spark, str(tmp_path))
    assert rejected.count() == 2
    got = rows.where("source_file = 'cnsfails202609a.txt'").collect()
    assert len(got) == 4  # trailer lines are kept
    assert {r["description"] for r in got} >= {"SOCIÉTÉ", None}
    again, _ = fails.load_new_files(spark, str(tmp_path), rows)
    assert again.count() == 0


def test_zipped_files_read_like_loose_ones(spark, tmp_path):
    loose, zipped = tmp_path / "loose", tmp_path / "zipped"
    loose.mkdir(), zipped.mkdir()
    for name, more in (("cnsfails202609a", {}), ("cnsfails202609b", {"count": 9}), ("cnsfails202608a", {"header": "X"})):
        ftd_file(loose, f"{name}.txt", rows=[*ROWS, "20260903|1|A||B|"], **more)
        with zipfile.ZipFile(zipped / f"{name}.zip", "w") as archive:
            archive.write(loose / f"{name}.txt", f"x/{name.upper()}.TXT")
    for name, members in (("none", []), ("two", ["two", "a/two.txt"])):
        with zipfile.ZipFile(zipped / f"{name}.zip", "w") as archive:
            for member in members:
                archive.write(loose / "cnsfails202609a.txt", member)
    rows, rejected = fails.load_new_zips(spark, str(zipped))
    plain, _ = fails.load_new_files(spark, str(loose))
    values = lambda df: sorted(df.drop("source_file").collect(), key=repr)
    assert values(rows) == values(plain)
    assert {r["source_file"]: r["reason"] for r in rejected.collect()} == {
        "cnsfails202609b.zip": "rows differ from the trailer's count", "cnsfails202608a.zip": "unexpected header",
        "none.zip": "not one file of its own name inside", "two.zip": "not one file of its own name inside",
    }
    again, left = fails.load_new_zips(spark, str(zipped), rows)
    assert again.count() == 0 and left.count() == 4


def test_the_newest_months_are_kept(spark):
    names = [("cnsfails202601b.zip", "/old/1", 1), ("CNSFAILS202601B.zip", "/new/1", 2), ("cnsfails202512a.zip", "/a", 3),
             ("cnsfails202511a.zip", "/b", 4), ("other.zip", "/c", 5), ("cnsfails202512b.zip", "/d", 6)]
    df = spark.createDataFrame(names, "name string, link string, line_no int")
    rows = fails.newest_months(df, 2).collect()
    assert [(r["month"] + r["half"], r["link"]) for r in rows] == [("202512a", "/a"), ("202512b", "/d"), ("202601b", "/new/1")]


def test_price_files_of_each_kind(spark, tmp_path):
    for kind in ("csv", "bars", "adj"):
        (tmp_path / kind).mkdir()
    (tmp_path / "csv" / "BRK-B.csv").write_text("Date,Open,High,Low,Close,Volume\n2026-01-02,1,2,0.5,1.5,100\n")
    bar = {"t": 1767330000000, "o": 1, "h": 2, "l": 0.5, "c": 1.5, "v": 100}
    (tmp_path / "bars" / "AAPL.json").write_text(json.dumps({"results": [bar]}, indent=1))
    day = {"date": "2026-01-02T00:00:00.000Z", "adjOpen": 1, "adjHigh": 2, "adjLow": 0.5, "adjClose": 1.5, "adjVolume": 100}
    (tmp_path / "adj" / "MSFT.json").write_text(json.dumps([day], indent=1))
    rows = (
        prices.scan_prices_csv(spark, str(tmp_path / "csv"))
        .unionByName(prices.scan_prices_bars_json(spark, str(tmp_path / "bars")))
        .unionByName(prices.scan_prices_adj_json(spark, str(tmp_path / "adj")))
        .collect()
    )
    assert {(r["symbol"], str(r["day"]), r["open"], r["close"], r["volume"]) for r in rows} == {
        (s, "2026-01-02", 1.0, 1.5, 100.0) for s in ("BRK-B", "AAPL", "MSFT")
    }


def test_an_unreadable_price_is_an_error(spark, tmp_path):
    (tmp_path / "X.csv").write_text("Date,Open,High,Low,Close,Volume\n2026-01-02,1,2,0.5,N/A,100\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        prices.scan_prices_csv(spark, str(tmp_path)).collect()


SCHEMA = "symbol string, day date, open double, high double, low double, close double, volume double, source string, source_file string"


def price(symbol, close, source="stooq"):
    return (symbol, datetime.date(2026, 1, 2), 1.0, 1.0, 1.0, close, 1.0, source, "f")


def test_only_readable_answers_replace_prices(spark):
    old = spark.createDataFrame([price("A", 1.0), price("B", 1.0), price("C", 1.0)], SCHEMA)
    new = spark.createDataFrame([price("A", 9.0), price("C", 9.0)], SCHEMA)
    at = datetime.datetime(2026, 1, 3)
    answers = spark.createDataFrame(
        [("A", "stooq", "data", at), ("B", "stooq", "no data", at), ("C", "stooq", "unreadable", at)],
        "symbol string, source string, status string, fetched_at timestamp_ntz",
    )
    rows = prices.prices_replace_symbol(old, new, answers)
    assert {r["symbol"]: r["close"] for r in rows.collect()} == {"A": 9.0, "B": 1.0, "C": 1.0}
    log = spark.createDataFrame([("D", "stooq", at, 3)], "symbol string, source string, fetched_at timestamp_ntz, rows int")
    kept = {r["symbol"]: r["rows"] for r in prices.fetch_log(log, answers, rows).collect()}
    assert kept == {"A": 1, "B": 1, "C": 0, "D": 3}


def test_the_first_source_with_data_wins(spark):
    rows = spark.createDataFrame([price("A", 1.0, "tiingo"), price("A", 2.0, "polygon"), price("B", 3.0, "tiingo")], SCHEMA)
    found = prices.price_source_fallback(rows, ["stooq", "polygon", "tiingo"]).collect()
    assert {(r["symbol"], r["close"]) for r in found} == {("A", 2.0), ("B", 3.0)}


def test_due_symbols_never_fetched_first(spark):
    hour = lambda h: datetime.datetime(2026, 1, 1, h)
    log = spark.createDataFrame([("A", hour(3)), ("B", hour(1)), ("C", hour(9))], "symbol string, fetched_at timestamp_ntz")
    wanted = spark.createDataFrame([(s,) for s in "ABCDD"], "symbol string")
    due = prices.prices_due(wanted, log, F.lit("2026-01-01 23:00:00").cast("timestamp_ntz"))
    assert [r["symbol"] for r in due.collect()] == ["D", "B", "A"]


def test_company_facts_and_lists(spark, tmp_path):
    (tmp_path / "frames").mkdir()
    doc = {"taxonomy": "us-gaap", "tag": "Revenues", "ccp": "CY2024", "uom": "USD", "data": [
        {"accn": "1", "cik": 7, "entityName": "A", "loc": "US", "start": "2024-01-01", "end": "2024-12-31", "val": 5},
        {"accn": "2", "cik": 8, "entityName": "B", "loc": "US", "end": "2024-12-31", "val": 6.5}]}
    (tmp_path / "frames" / "us-gaap_Revenues_USD_CY2024.json").write_text(json.dumps(doc, indent=1))
    rows = facts.scan_xbrl_frames(spark, str(tmp_path / "frames")).orderBy("cik").collect()
    assert [(r["cik"], r["frame"], str(r["period_start"]), r["val"]) for r in rows] == [
        (7, "CY2024", "2024-01-01", 5.0), (8, "CY2024", "None", 6.5),
    ]
    (tmp_path / "tickers.json").write_text('{"0":{"cik_str":320193,"ticker":"AAPL","title":"Apple Inc."},"x":{"cik_str":1,"ticker":"B","title":"C"}}')
    listed = facts.scan_keyed_json(spark, str(tmp_path / "tickers.json")).collect()
    assert {(r["cik"], r["ticker"], r["title"]) for r in listed} == {(320193, "AAPL", "Apple Inc."), (1, "B", "C")}


def test_hand_kept_lists(spark, tmp_path):
    (tmp_path / "w.csv").write_text("ticker,cusip,name\n aapl ,037833100, Apple \n,594918104,\nold,037833100,Again\nno,,Nobody\n")
    rows = lists.scan_watchlist(spark, str(tmp_path / "w.csv")).orderBy("line_no").collect()
    assert [(r["cusip"], r["ticker"], r["name"]) for r in rows] == [("037833100", "AAPL", "Apple"), ("594918104", "", "")]
    (tmp_path / "r.csv").write_text("ticker,cusip,period,filings,shares_excl_options,value_excl_options_usd\nA,x,2024Q2,10,20,30\n")
    row = lists.scan_reference_holdings(spark, str(tmp_path / "r.csv")).first()
    assert (str(row["period"]), row["filings"], row["shares"], row["value"]) == ("2024-06-30", 10, 20, 30)


def test_tables_are_written_as_they_come(spark, tmp_path):
    from tidegauge.sources.tables import write_table

    rows = spark.range(300).repartition(3)
    as_planned = write_table(rows, str(tmp_path / "as-planned"), rebalance=False)
    assert len(as_planned.inputFiles()) == 3
    assert sorted(r["id"] for r in as_planned.collect()) == list(range(300))
    assert len(write_table(rows, str(tmp_path / "shaped")).inputFiles()) == 1
