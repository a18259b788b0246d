import datetime

from pyspark.sql import functions as F

from tidegauge.operators import resolve
from tidegauge.streaming import reliability
from tidegauge.streaming.ingest import audited_batch, due_deliveries, stream_ingest

ANSWER = "cusip string, id_type string, id_value string, response string, fetched_at string"


def test_answers_are_classed(spark):
    texts = {
        "us": '{"data":[{"ticker":"X1","exchCode":"LN"},{"ticker":"X2","exchCode":"US","securityType":"ADR"}]}',
        "first": '{"data":[{"ticker":"Y1","exchCode":"LN"}]}',
        "warned": '{"warning":"No identifier found."}',
        "empty": '{"data":[]}',
        "rejected": '{"error":"Invalid idValue format."}',
        "passing": '{"error":"Too many requests"}',
    }
    rows = spark.createDataFrame([(k, "ID_CUSIP", k, v, "t") for k, v in texts.items()], ANSWER)
    parsed = resolve.resolve_answers(rows)
    found = {r["cusip"]: (r["outcome"], r["ticker"]) for r in parsed.collect()}
    assert found == {
        "us": ("found", "X2"), "first": ("found", "Y1"), "warned": ("not found", None), "empty": ("not found", None),
        "rejected": ("not found", None), "passing": ("error", None),
    }
    assert resolve.cache_rows(parsed).count() == 5


def test_share_classes_are_retried(spark):
    rows = spark.createDataFrame(
        [("a", '{"data":[{"ticker":"X"},{"shareClassFIGI":"BBG1"}]}'), ("b", '{"data":[]}')], "cusip string, response string"
    )
    jobs = resolve.share_class_retry(rows).collect()
    assert [(r["cusip"], r["job_type"], r["job_value"]) for r in jobs] == [("a", resolve.SHARE_CLASS, "BBG1")]


def test_names_match_only_without_doubt(spark):
    companies = spark.createDataFrame(
        [("AAPL", "Apple Inc."), ("GOOG", "Alphabet Inc."), ("GOOGL", "Alphabet Inc."), ("MSFT", "MICROSOFT CORP")],
        "ticker string, title string",
    )
    securities = spark.createDataFrame(
        [("037833100", "037833100", "APPLE INC"), ("02079K305", "02079K305", "ALPHABET INC CAP STK CL A"),
         ("594918104", "594918104", "MICROSOFT CORP"), ("67066G104", "67066G104", "MICROSOFT CORP COM"),
         ("000000001", "000000001", "APPLE INC")],
        "cusip string, stock string, name_filed string",
    )
    rows = resolve.issuer_name_match(companies, securities).collect()
    assert [(r["cusip"], r["ticker"], r["detail"]) for r in rows] == [("037833100", "AAPL", "Apple Inc.")]


def test_fallbacks_give_way(spark):
    ask = lambda *codes: spark.createDataFrame([(c,) for c in codes], "cusip string")
    symbols = spark.createDataFrame([("a", "FA", datetime.date(2026, 1, 2)), ("c", "FC", datetime.date(2026, 1, 2))], "cusip string, symbol string, as_of date")
    names = spark.createDataFrame([("a", "NA", "x"), ("b", "NB", "B Inc."), ("d", "ND", "D")], "cusip string, ticker string, detail string")
    rows = resolve.ticker_fallback_cascade(ask("a", "b", "e"), ask("c", "d"), symbols, names)
    assert {(r["cusip"], r["ticker"], r["source"], r["detail"]) for r in rows.collect()} == {
        ("a", "FA", "sec-ftd", None), ("b", "NB", "issuer-name", "B Inc."), ("c", "FC", "sec-ftd", None),
    }
    cache = spark.createDataFrame([("c", False), ("d", False), ("a", True)], "cusip string, found boolean")
    assert {r["cusip"] for r in resolve.asked_again(cache, rows).collect()} == {"a", "d"}
    assert {r["cusip"] for r in resolve.without_answered(rows, ask("a")).collect()} == {"b", "c"}
    new = spark.createDataFrame([("c", True)], "cusip string, found boolean")
    assert {(r["cusip"], r["found"]) for r in resolve.upsert(cache, new).collect()} == {("a", True), ("c", True), ("d", False)}


NOW = datetime.datetime(2026, 10, 2, 12)


def events(spark, rows):
    return spark.createDataFrame(
        [(s, NOW - datetime.timedelta(hours=h, seconds=i), o, None if o == "ok" else f"e{h}") for i, (s, h, o) in enumerate(rows)],
        "source string, at timestamp_ntz, outcome string, error string",
    )


def health(spark, rows):
    table = reliability.source_reliability(events(spark, rows), F.lit(str(NOW)).cast("timestamp_ntz"))
    return {r["source"]: r for r in table.collect()}, table


def test_sources_are_judged_on_the_last_day(spark):
    rows = [("openfigi", 1, "failed")] * 5 + [("sec-ftd", 2, "ok")] * 4 + [("sec", 30, "ok"), ("sec", 26, "failed")]
    found, table = health(spark, rows)
    assert found["openfigi"]["unreliable"] and not found["sec-ftd"]["unreliable"]
    assert (found["sec"]["ok"], found["sec"]["failed"]) == (0, 0)
    assert found["sec"]["last_ok"] is not None and found["sec"]["last_error"] == "e26"
    assert not any(r["uncovered"] for r in reliability.uncovered_needs(table).collect())
    worse, table = health(spark, rows + [("sec-ftd", 3, "throttled")] * 5)
    assert worse["sec-ftd"]["unreliable"]
    assert [r["need"] for r in reliability.uncovered_needs(table).collect() if r["uncovered"]] == ["tickers"]


def test_a_long_run_does_not_push_others_out(spark):
    rows = [("openfigi", 1, "ok")] * 600 + [("sec", 5, "failed")] * 6
    found, _ = health(spark, rows)
    assert found["openfigi"]["ok"] == 600 and found["sec"]["failed"] == 6 and found["sec"]["unreliable"]


def test_keyed_state_keeps_the_last_answer_and_gives_the_batch_result(spark, tmp_path):
    """Runs over hours: each report equals the batch result at its hour; a silent source counts down to zero but
    keeps what it last said; an event on the full hour counts to the hour it ends; an hour reported is not changed
    by an event that comes too late."""
    start = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)
    hour = lambda h: start + datetime.timedelta(hours=h)
    schema = "source string, at timestamp, outcome string, error string"
    deliveries = [
        [("sec", hour(0.5), "ok", None), ("sec", hour(1), "failed", "on the hour"), ("stooq", hour(0.2), "failed", "old"), ("stooq", hour(0.3), "odd", None)],
        [("tiingo", hour(h), "failed", f"e{h}") for h in range(3, 9)] + [("sec", hour(5.5), "throttled", "slow")],
        [("tiingo", hour(20), "ok", None), ("tiingo", hour(25.9), "ok", None), ("tiingo", hour(26.5), "ok", None)],
        [("stooq", hour(2), "ok", None), ("tiingo", hour(60), "ok", None), ("tiingo", hour(62), "ok", None)],
    ]
    arrived, incoming, reports = [], str(tmp_path / "in"), str(tmp_path / "out")
    for rows in deliveries:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(incoming)
        reliability.start_reports(spark.readStream.schema(schema).parquet(incoming), reports, str(tmp_path / "cp")).awaitTermination()
        arrived += rows
    told = spark.read.schema(f"{reliability.REPORT}, unreliable boolean").parquet(reports)
    in_time = spark.createDataFrame([r for r in arrived if r[:2] != ("stooq", hour(2))], schema)
    same = ("source", "ok", "failed", "throttled", "last_ok", "last_error", "unreliable")
    found = {(r["as_of"], r["source"]): tuple(r[c] for c in same) for r in told.collect()}
    assert len(found) == told.count() and len({h for h, _ in found}) == 3
    for as_of in {h for h, _ in found}:
        batch = {r["source"]: tuple(r[c] for c in same) for r in reliability.source_reliability(in_time, F.lit(as_of)).collect()}
        for (h, source), row in found.items():
            assert h != as_of or row == batch[source]
    newest = {r["source"]: r for r in reliability.newest_reports(told).collect()}
    assert len(newest) == 7 and newest["polygon"]["last_ok"] is None
    assert (newest["stooq"]["failed"], newest["stooq"]["last_error"], newest["stooq"]["last_ok"]) == (0, "old", None)
    assert newest["sec"]["last_error"] == "slow" and newest["tiingo"]["ok"] == 1


def loader(spark, tmp_path, **options):
    """Functions that deliver rows, run the load, and read what the table holds."""
    schema = "a string, source_zip string"
    incoming, table = str(tmp_path / "in"), str(tmp_path / "out")
    of = spark.createDataFrame([], schema).schema

    def deliver(name, *rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{incoming}/{name}")

    def run():
        stream_ingest(spark, of, incoming, table, str(tmp_path / "cp"), **options).awaitTermination()
        return sorted((r["a"], r["source_zip"]) for r in spark.read.schema(schema).parquet(table).collect())

    return deliver, run


def test_new_files_are_picked_up_once_and_a_delivery_replaces_the_one_before(spark, tmp_path):
    deliver, run = loader(spark, tmp_path)
    deliver("1", ("1", "x"), ("2", "y"))
    assert run() == run() == [("1", "x"), ("2", "y")]
    deliver("2", ("9", "y"))
    assert run() == [("1", "x"), ("9", "y")]


def test_parts_of_a_delivery_add_up_over_runs_and_batches(spark, tmp_path):
    deliver, run = loader(spark, tmp_path, max_files=1)
    deliver("1", ("1", "x"))
    assert run() == [("1", "x")]
    for part in "2345":
        deliver("1", (part, "x"))
    assert run() == [(n, "x") for n in "12345"]


def test_of_two_deliveries_waiting_the_later_counts(spark, tmp_path):
    deliver, run = loader(spark, tmp_path)
    deliver("2", ("new", "y"))
    deliver("1", ("old", "y"), ("1", "x"))
    assert run() == [("1", "x"), ("new", "y")]
    deliver("1", ("late", "y"))
    assert run() == [("1", "x"), ("new", "y")]


def test_a_delivery_replaces_only_when_it_is_complete(spark, tmp_path):
    declared = [("y", "1", 1), ("y", "2", 2)]
    of = "source_zip string, load_delivery string, expected bigint"
    deliver, run = loader(spark, tmp_path, expected=lambda s: s.createDataFrame(declared, of))
    deliver("1", ("old", "y"))
    deliver("2", ("new", "y"))
    assert run() == [("old", "y")]
    deliver("2", ("newer", "y"))
    assert run() == [("new", "y"), ("newer", "y")]


def test_a_batch_opens_no_earlier_delivery(spark, tmp_path):
    """The landed files of an earlier delivery are spoilt: later ones load without them, and a late declaration is met."""
    declared = [("x", "1", 2), ("y", "1", 1), ("x", "3", 1)]
    expected = lambda session: session.createDataFrame(declared, "source_zip string, load_delivery string, expected long")
    deliver, run = loader(spark, tmp_path, expected=expected)
    deliver("1", ("a", "x"), ("b", "x"), ("c", "y"))
    assert run() == [("a", "x"), ("b", "x"), ("c", "y")]
    spoilt = list((tmp_path / "out-deliveries").glob("source_zip=*/load_delivery=1/*/*.parquet"))
    for file in spoilt:
        file.write_bytes(b"no parquet")
    assert len(spoilt) == 2
    deliver("2", ("d", "x"))  # nothing declares it yet
    assert run() == [("a", "x"), ("b", "x"), ("c", "y")]
    deliver("3", ("e", "x"))
    assert run() == [("c", "y"), ("e", "x")]
    declared.append(("z", "4", 1))
    declared.append(("x", "2", 1))
    deliver("4", ("f", "z"))
    assert run() == [("c", "y"), ("e", "x"), ("f", "z")]


def test_what_is_due_comes_from_counts_and_a_repeated_batch_gives_the_same(spark):
    ledger = spark.createDataFrame(
        [("x", "1", 2, 0), ("x", "2", 1, 1), ("x", "2", 1, 2), ("y", "1", 5, 0), ("z", "1", 1, 2)],
        "source_zip string, load_delivery string, load_rows long, load_batch long",
    )
    held = spark.createDataFrame([("x", "1", 0), ("y", "1", 0), ("x", "2", 2), ("z", "1", 2)], "source_zip string, load_delivery string, load_batch long")
    expected = spark.createDataFrame([("x", "1", 2), ("x", "2", 2), ("y", "1", 5), ("z", "1", 1)], "source_zip string, load_delivery string, expected long")
    due = lambda n, e=expected: sorted(tuple(r) for r in due_deliveries(ledger, held, n, expected=e).collect())
    assert due(0) == [("x", "1"), ("y", "1")]
    assert due(1) == [] and due(1, None) == [("x", "2")]
    assert due(2) == due(2) == [("x", "2"), ("z", "1")]  # as when the batch first ran
    assert due(3) == []


def test_batches_that_disagree_with_their_files_are_left_out(spark):
    batch = spark.createDataFrame([("1", "x"), ("2", "x"), ("3", "y")], "a string, source_zip string")
    expected = spark.createDataFrame([("x", 2), ("y", 2)], "source_zip string, expected bigint")
    assert {r["a"] for r in audited_batch(batch, expected).collect()} == {"1", "2"}
