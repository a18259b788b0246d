import hashlib
import io
import itertools
import random
import zipfile
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tests import market
from tidegauge.operators import filings, identity, positions, reads
from tidegauge.params import Params
from tidegauge.plans.model import STEPS, Model, fingerprint
from tidegauge.sources import archives, zip_pieces
from tidegauge.sources import filings as files

SMALL = Params(median_min_funds=10, min_funds=10, change_min_funds=10, change_min_moved=10, min_positions=2)


def raw_from(spark, folder):
    return {
        table: files.scan_zip_members(spark, str(folder), member, market.COLUMNS[member])
        for member, table in files.MEMBERS.items()
    }


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("zips")
    market.write_zips(folder)
    lookups = spark.createDataFrame(
        [(market.ALDER.code, True, "ALD", "ALDER", "Common Stock"), (market.INDEX.code, True, "DIX", "INDEX", "ETP")],
        "cusip string, found boolean, ticker string, name string, security_type string",
    )
    fallbacks = spark.createDataFrame(
        [(market.BIRCH.code, "BIR", "sec-ftd", None)], "cusip string, ticker string, source string, as_of date"
    )
    raw = raw_from(spark, folder) | {"openfigi": lookups, "ticker_fallbacks": fallbacks}
    return Model(spark, raw, str(tmp_path_factory.mktemp("model")), SMALL)


def test_zip_members_are_read_byte_for_byte(spark, built):
    covers = built.raw["raw_coverpage"]
    assert covers.count() == 3 * market.MANAGERS
    assert covers.where(F.col("FILINGMANAGER_NAME") == 'Manager "7" LLC').count() == 3
    assert {r["source_zip"] for r in covers.select("source_zip").distinct().collect()} == {q[0] for q in market.QUARTERS}


def test_a_missing_member_is_an_error(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "01jun2024-31aug2024_form13f.zip", "w") as archive:
        archive.writestr("SUBMISSION.tsv", "ACCESSION_NUMBER\nx\n")
    with pytest.raises(Exception, match="has no coverpage.tsv"):
        files.scan_zip_members(spark, str(tmp_path), "COVERPAGE", ["ACCESSION_NUMBER"]).collect()


def zipped(spark, **texts):
    """Archives with one member A each, of these bytes."""
    rows = []
    for name, text in texts.items():
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as archive:
            archive.writestr("A.tsv", text)
        rows.append((f"/in/{name}", bytearray(out.getvalue())))
    return spark.createDataFrame(rows, "path string, content binary")


def test_every_column_is_read_as_filed(spark):
    lines = files.archive_lines(zipped(spark, one=b"x\ty\r\n1\t2\r\n\t\xff\xe9", two=b"z\tx\n3\t4\n"), ("A",))
    rows = files.member_rows(lines, "A").select("x", "y", "z", "source_zip", F.hex(F.col("y").cast("binary")).alias("h"))
    got = {(r["x"], r["z"], r["source_zip"], r["h"]) for r in rows.drop("y").collect()}
    assert got == {("1", None, "one", "32"), (None, None, "one", "FFE9"), ("4", "3", "two", None)}


@pytest.mark.parametrize("line", [b"3\t4\t5", b"1", b""])
def test_ragged_lines_are_reported_and_refused(spark, line):
    archives = zipped(spark, one=b"x\ty\n1\t2\n" + line + b"\n", two=b"x\ty\n1\t2\n")
    lines = files.archive_lines(archives, ("A",))
    assert [(r["source_zip"], r["number"]) for r in files.ragged_lines(lines).collect()] == [("one", 2)]
    with pytest.raises(Exception, match="one: line 2 of A has"):
        files.member_rows(lines, "A", ["x"]).collect()


def test_ragged_lines_of_unpacked_files_are_refused(spark, tmp_path):
    (tmp_path / "INFOTABLE.tsv").write_text("A\tB\n1\t2\n3\t4\t5\n")
    with pytest.raises(Exception, match="MALFORMED"):
        files.scan_filing_tsv(spark, str(tmp_path), ["A"]).collect()


def test_archives_are_loaded_once_and_whole(spark, tmp_path):
    incoming, tables = tmp_path / "in", str(tmp_path / "tables")
    market.write_zips(incoming)
    load = lambda: [t.collect() for t in files.load_archives(spark, str(incoming), tables, F.lit("2025-01-01"))]
    held = lambda: {r["source_zip"]: r["count"] for r in spark.read.parquet(f"{tables}/raw_infotable").groupBy("source_zip").count().collect()}
    added, ragged = load()
    first = held()
    assert len(added) == 12 and not ragged
    assert {r["source_zip"]: r["row_count"] for r in added if r["table_name"] == "raw_infotable"} == first
    assert [len(t) for t in load()] == [0, 0]

    def change(quarter, rows):
        if quarter == 0:
            rows["INFOTABLE"].pop()
        if quarter == 1:
            rows["SUMMARYPAGE"][0] = rows["SUMMARYPAGE"][0][:1]
            rows["INFOTABLE"].pop()

    names = [q[0] for q in market.QUARTERS]
    last = (incoming / names[2]).read_bytes()
    market.write_zips(incoming, change)
    (incoming / names[2]).write_bytes(last)
    added, ragged = load()
    assert {r["source_zip"] for r in added} == {names[0]}
    assert {(r["source_zip"], r["member"], r["number"]) for r in ragged} == {(names[1], "SUMMARYPAGE", 1)}
    assert held() == {**first, names[0]: first[names[0]] - 1}


def test_the_market_is_counted(built):
    periods = built.table("periods").orderBy("period").collect()
    assert [r["label"] for r in periods] == ["Q2 2024", "Q3 2024", "Q4 2024"]
    assert [r["complete"] for r in periods] == [True, True, False]
    held = {(r["cusip"], str(r["period"])): r["funds_holding"] for r in built.table("holders").collect()}
    for security in market.EVERY:
        assert tuple(held[security.code, str(p["period"])] for p in periods) == security.reach
    assert built.table("positions").where("price_flag").count() == 0


def test_kinds_come_from_the_type_else_from_the_words(built):
    kinds = {r["cusip"]: (r["kind"], r["ticker"], r["ticker_source"]) for r in built.table("stocks").collect()}
    assert kinds[market.INDEX.code] == ("etf", "DIX", "openfigi")
    assert kinds[market.BIRCH.code] == ("stock", "BIR", "sec-ftd")
    assert kinds[market.CEDAR.code] == ("stock", None, None)


def test_streaks_and_changes(built):
    rows = {(r["cusip"], r["seq"]): r for r in built.table("stock_periods").collect()}
    assert rows[market.BIRCH.code, 3]["streak"] == 2 and rows[market.BIRCH.code, 3]["funds_change"] == 5
    assert rows[market.CEDAR.code, 3]["direction"] == -1 and rows[market.CEDAR.code, 3]["streak"] == 2
    assert rows[market.ALDER.code, 2]["direction"] == 0
    changes = {(r["cusip"], str(r["period"])): r for r in built.table("changes").collect()}
    new = changes[market.BIRCH.code, "2024-09-30"]
    assert (new["opened"], new["added"], new["sold_out"], new["not_yet_filed"]) == (5, 40, 0, 0)
    assert changes[market.CEDAR.code, "2024-09-30"]["sold_out"] == 5


EMPTY = {
    "raw_xbrl_frames": "source_file string, taxonomy string, tag string, unit string, frame string, accn string, cik bigint, "
    "entity_name string, loc string, period_start date, period_end date, val double",
    "raw_sec_tickers": "cik bigint, ticker string, title string",
    "raw_prices": "symbol string, day date, open double, high double, low double, close double, volume double, "
    "source string, source_file string",
}


def test_a_published_model_opens_and_outlives_a_broken_build(spark, built, tmp_path):
    raw = built.raw | {n: spark.createDataFrame([], s) for n, s in EMPTY.items()}
    path = str(tmp_path / "model")
    with pytest.raises(AnalysisException):
        Model.open(spark, path)
    assert Model(spark, dict(raw), path, SMALL).publish() == 1
    first = Model.open(spark, path)
    stocks = sorted(first.table("stocks").collect())
    assert stocks and set(first.tables) == set(STEPS)
    assert first.table("positions").schema == built.table("positions").schema
    broken = Model(spark, raw | {"raw_sec_tickers": spark.createDataFrame([], "other int")}, path, SMALL)
    with pytest.raises(AnalysisException):
        broken.publish()
    assert sorted(Model.open(spark, path).table("stocks").collect()) == stocks
    none = spark.createDataFrame([], raw["openfigi"].schema)
    assert Model(spark, raw | {"openfigi": none}, path, SMALL).publish() == 2
    assert {r["kind"] for r in Model.open(spark, path).table("stocks").collect()} != {r["kind"] for r in stocks}
    assert sorted(first.table("stocks").collect()) == stocks  # earlier readers keep what they opened


def test_names_and_prices_are_read_by_one_step_each():
    readers = lambda raw: {n for n, step in STEPS.items() if raw in step.needs}
    assert readers("raw_infotable") == {"filings", "position_sums", "spelled_names"}
    assert readers("raw_prices") == {"quarter_prices", "market_days"}


def test_new_tickers_rebuild_only_what_reads_them(spark, built):
    other = Model(spark, dict(built.raw), built.path + "/again", SMALL)
    before = {r["cusip"]: r["kind"] for r in other.table("stocks").collect()}
    other.table("stock_periods")
    positions_before = other.table("positions")
    none = spark.createDataFrame([], built.raw["openfigi"].schema)
    other.raw |= {n: spark.createDataFrame([], s) for n, s in EMPTY.items()}
    counts = other.rebuild_after_tickers(none, built.raw["ticker_fallbacks"])
    assert counts["stocks"] == 4 and counts["stock_prices"] == 0
    assert other.table("positions") is positions_before
    after = {r["cusip"]: r["kind"] for r in other.table("stocks").collect()}
    assert before[market.INDEX.code] == "etf" and after[market.INDEX.code] == "other"


def test_refresh_builds_only_what_changes(spark, built):
    raw = built.raw | {n: spark.createDataFrame([], s) for n, s in EMPTY.items()}
    model = Model(spark, dict(raw), built.path + "/refreshed", SMALL, tables=dict(built.tables))
    for name in ("stock_periods", "quarter_prices", "stock_cash_flows"):
        model.table(name)
    held = dict(model.tables)
    answers = raw["openfigi"]
    assert model.refresh({"openfigi": answers.repartition(3).select(*reversed(answers.columns))}) == set()
    assert model.tables == held
    # An answer for a code that nobody holds changes stocks' input, not stocks.
    extra = answers.limit(1).withColumn("cusip", F.lit("999999999"))
    assert model.refresh({"openfigi": answers.unionByName(extra)}) == {"openfigi"}
    assert model.tables == held
    none = spark.createDataFrame([], answers.schema)
    changed = model.refresh({"openfigi": none})
    assert {"openfigi", "stocks", "stock_periods"} <= changed <= {"openfigi", "stocks", "stock_periods", "stock_cash_flows_history", "stock_prices"}
    others = {n: t for n, t in held.items() if not n.startswith("stock") or n == "stock_keys"}
    whole = Model(spark, raw | {"openfigi": none}, built.path + "/whole", SMALL, tables=others)
    for name, old in held.items():
        if name in ("stocks", "stock_periods"):
            assert fingerprint(model.table(name)) == fingerprint(whole.table(name)) != fingerprint(old)
        else:
            assert model.table(name) is old
    # One that breaks off changes nothing, and is done when repeated.
    after = dict(model.tables)
    with pytest.raises(AnalysisException):
        model.refresh({"openfigi": answers, "ticker_fallbacks": spark.createDataFrame([], "other int")})
    assert model.tables == after and model.raw["openfigi"] is none
    assert {"stocks", "stock_periods"} <= model.refresh({"openfigi": answers})
    assert sorted(model.table("stocks").collect()) == sorted(held["stocks"].collect())


def test_fingerprints_tell_tables_apart(spark):
    of = lambda rows, schema="a string, b string": fingerprint(spark.createDataFrame(rows, schema))
    assert of([("x", None), ("y", "z")]) == of([("y", "z"), ("x", None)])
    others = [[("x", None)], [(None, "x")], [("x", None)] * 2, [("x", "")], []]
    assert len({of(rows) for rows in others} | {of([], "a string, b int"), of([], "a string")}) == 7


def amended(spark, rows):
    """Submissions (accession, role, filing day) of one manager and quarter, and the parts in use."""
    subs = spark.createDataFrame(
        [(a, 1, "2024-06-30", d, r) for a, r, d in rows],
        "accession string, cik bigint, p string, d string, role string",
    ).select(
        "accession", "cik", F.to_date("p").alias("period"), F.to_date("d").alias("filing_date"), "role",
        F.lit(1).alias("value_multiplier"),
    )
    periods = subs.select("period").distinct()
    return {r["accession"] for r in filings.filing_parts(subs, periods).collect()}


@pytest.mark.parametrize(
    "rows, used",
    [
        ([("a", "original", "2024-08-01")], {"a"}),
        ([("a", "original", "2024-08-01"), ("b", "restatement", "2024-08-02")], {"b"}),
        ([("a", "original", "2024-08-01"), ("b", "new holdings", "2024-08-02")], {"a", "b"}),
        ([("b", "new holdings", "2024-08-02"), ("c", "restatement", "2024-08-03")], {"c"}),
        ([("a", "restatement", "2024-08-02"), ("b", "new holdings", "2024-08-02")], {"a", "b"}),
        ([("b", "restatement", "2024-08-02"), ("a", "new holdings", "2024-08-02")], {"b"}),
        ([("n", "new holdings", "2024-08-02"), ("m", "new holdings", "2024-08-03")], {"n", "m"}),
        ([("x", "notice", "2024-08-02")], set()),
        ([("a", "original", "2024-08-01"), ("c", "original", "2024-08-01")], {"c"}),
    ],
)
def test_amendments(spark, rows, used):
    assert amended(spark, rows) == used


def test_roles_and_multipliers(spark):
    raw = spark.createDataFrame(
        [("1", "02-JAN-2023", "13F-HR", "0000000007", "30-SEP-2022", "z"), ("2", "03-JAN-2023", "13F-HR/A", "7", "30-SEP-2022", "z"),
         ("3", "03-JAN-2023", "13F-HR/A", "7", "30-SEP-2022", "z"), ("4", "03-JAN-2023", "13F-NT", "7", "30-SEP-2022", "z"),
         ("1", "02-JAN-2023", "13F-HR", "7", "30-SEP-2022", "a")],
        "ACCESSION_NUMBER string, FILING_DATE string, SUBMISSIONTYPE string, CIK string, PERIODOFREPORT string, source_zip string",
    )
    cover = spark.createDataFrame(
        [("1", "RESTATEMENT", None, None, "M", "z"), ("2", "NEW HOLDINGS", "1", None, "M", "z"), ("3", None, None, None, "M", "z")],
        "ACCESSION_NUMBER string, AMENDMENTTYPE string, AMENDMENTNO string, REPORTTYPE string, FILINGMANAGER_NAME string, source_zip string",
    )
    totals = spark.createDataFrame([], "ACCESSION_NUMBER string, TABLEENTRYTOTAL string, TABLEVALUETOTAL string, source_zip string")
    rows = {r["accession"]: r for r in filings.submissions(raw, cover, totals).collect()}
    assert {a: r["role"] for a, r in rows.items()} == {"1": "original", "2": "new holdings", "3": "restatement", "4": "notice"}
    assert rows["1"]["source_zip"] == "z" and rows["1"]["cik"] == 7
    assert [rows[a]["value_multiplier"] for a in "12"] == [1000, 1]


def planned(spark, threshold, build):
    """The plan of `build()` where tables of up to `threshold` bytes are broadcast."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, threshold)
    try:
        return build()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)


def test_filings_are_moved_once(spark):
    raw = spark.createDataFrame(
        [("1", "02-JAN-2023", "13F-HR", "7", "30-SEP-2022", "y"), ("2", "03-JAN-2023", "13F-HR", "8", "30-SEP-2022", "y"),
         ("3", "03-JAN-2023", "13F-HR", "9", "30-SEP-2022", None)],
        "ACCESSION_NUMBER string, FILING_DATE string, SUBMISSIONTYPE string, CIK string, PERIODOFREPORT string, source_zip string",
    )
    cover = spark.createDataFrame(
        [("1", None, None, None, "Y", "y"), ("1", None, None, None, "Z", "z"), ("2", None, None, None, "X", "x"), ("4", None, None, None, "W", "w")],
        "ACCESSION_NUMBER string, AMENDMENTTYPE string, AMENDMENTNO string, REPORTTYPE string, FILINGMANAGER_NAME string, source_zip string",
    )
    totals = spark.createDataFrame(
        [("1", "4", "100", "y"), ("1", "5", "200", "z")], "ACCESSION_NUMBER string, TABLEENTRYTOTAL string, TABLEVALUETOTAL string, source_zip string"
    )
    build = lambda: filings.submissions(raw, cover, totals)
    rows = {r["accession"]: (r["cik"], r["manager_name"], r["table_entry_total"]) for r in build().collect()}
    # What another source says of a filing doesn't count, nor a cover without a submission.
    assert rows == {"1": (7, "Y", 4), "2": (8, None, None), "3": (9, None, None)}
    assert planned(spark, "-1", build).count("Exchange hashpartitioning") == 1


def test_names_need_only_reports_of_latest_periods(spark, tmp_path):
    def written(df, name):
        df.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    many = spark.range(20_000).select(F.sha2(F.col("id").cast("string"), 256).alias("accession"), (F.col("id") < 2).alias("new"))
    day = F.when(F.col("new"), F.lit("2024-03-31")).otherwise("2023-12-31").cast("date")
    parts = written(many.select("accession", day.alias("period")), "parts")
    lines = written(
        many.select(
            F.col("accession").alias("ACCESSION_NUMBER"), F.lit("037833100").alias("CUSIP"), F.lit("A").alias("NAMEOFISSUER"),
            F.lit("COM").alias("TITLEOFCLASS"), F.lit("").alias("FIGI"), F.lit("SH").alias("SSHPRNAMTTYPE"), F.lit("").alias("PUTCALL"),
        ),
        "lines",
    )
    holders = written(
        spark.createDataFrame([("037833100", "2023-12-31", 9), ("037833100", "2024-03-31", 2)], "cusip string, period string, funds int")
        .withColumn("period", F.col("period").cast("date")).coalesce(1), "holders",
    )
    build = lambda: identity.spelled_names(holders, parts, lines)
    # The reports are too many to broadcast, those of the latest period are few: the lines stay where they are.
    assert "hashpartitioning(accession" not in planned(spark, "100000", build)
    assert [(r["latest_period"].isoformat(), r["name"], r["n"]) for r in build().collect()] == [("2024-03-31", "A", 2)]


def test_the_price_check(spark):
    sums = spark.createDataFrame(
        [(c, "X", 100, v) for c, v in ((1, 1000), (2, 1000), (3, 1000), (4, 5000), (5, 1), (6, 200))],
        "cik bigint, cusip string, shares bigint, value bigint",
    ).select("cik", F.to_date(F.lit("2024-06-30")).alias("period"), "cusip", "shares", "value", F.lit(1).alias("lines"))
    rows = {r["cik"]: r for r in positions.positions(sums).collect()}
    assert [rows[c]["price_flag"] for c in (1, 4, 5, 6)] == [False, True, False, True]
    assert rows[5]["value_in_thousands"] and rows[5]["value_checked"] == 1000


def keys_of(spark, edges, codes="abcdxy"):
    holders = spark.createDataFrame([(c,) for c in codes], "cusip string")
    rows = spark.createDataFrame(
        [(o, n, r, f"2024-0{i + 1}-01") for i, (o, n, r) in enumerate(edges)],
        "old_cusip string, new_cusip string, exchange_ratio double, p string",
    ).select("old_cusip", "new_cusip", "exchange_ratio", F.to_date("p").alias("period"))
    return {r["cusip"]: (r["stock"], r["ratio"]) for r in identity.stock_keys(holders, rows).collect()}


def test_chains_of_replacements(spark):
    keys = keys_of(spark, [("a", "b", 0.5), ("b", "c", 4.0), ("a", "d", 9.0)])
    assert keys["a"] == ("c", 2.0) and keys["b"] == ("c", 4.0) and keys["d"] == ("d", 1.0)
    circle = keys_of(spark, [("x", "y", 2.0), ("y", "x", 0.5)])
    assert circle["x"] == ("y", 2.0) and circle["y"] == ("x", 0.5)


def test_long_chains_and_circles_agree_with_a_plain_walk(spark):
    chain = [(f"n{i:03}", f"n{i + 1:03}", 2.0 if i % 2 else 0.5) for i in range(150)]
    ring = [("r0", "r1", 2.0), ("r1", "r2", 3.0), ("r2", "r3", 5.0), ("r3", "r0", 7.0), ("t1", "r2", 11.0), ("t0", "t1", 13.0)]
    more = [("p", "q", 2.0), ("q", "p", 0.25), ("s", "n149", 4.0)]
    edges = chain + ring + more
    onward = {o: (n, r) for o, n, r in edges}
    codes = sorted({c for o, n, _ in edges for c in (o, n)})
    rows = spark.createDataFrame(edges, "old_cusip string, new_cusip string, exchange_ratio double")
    holders = spark.createDataFrame([(c,) for c in codes], "cusip string")
    got = identity.stock_keys(holders, rows.withColumn("period", F.to_date(F.lit("2024-03-31")))).collect()
    assert len(got) == len(codes)
    for row in got:
        at, ratio, seen = row["cusip"], 1.0, {row["cusip"]}
        while at in onward and onward[at][0] not in seen:
            at, step = onward[at]
            ratio *= step
            seen.add(at)
        assert row["stock"] == at and row["ratio"] == pytest.approx(ratio)


def test_a_replaced_identifier_is_found_and_a_coincidence_is_not(spark, tmp_path):
    """From the second quarter on one security trades under another code, two old shares for one new."""

    def replace(seq, rows):
        if seq >= 1:
            for line in rows["INFOTABLE"]:
                if line[4] == market.BIRCH.code:
                    line[4], line[7] = "20B000301", line[7] // 2

    market.write_zips(tmp_path / "zips", replace)
    empty = spark.createDataFrame([], "cusip string, found boolean, ticker string, name string, security_type string")
    none = spark.createDataFrame([], "cusip string, ticker string, source string, as_of date")
    raw = raw_from(spark, tmp_path / "zips") | {"openfigi": empty, "ticker_fallbacks": none}
    model = Model(spark, raw, str(tmp_path / "model"), SMALL)
    found = model.table("cusip_changes").collect()
    assert [(r["old_cusip"], r["new_cusip"], r["partial"]) for r in found] == [(market.BIRCH.code, "20B000301", False)]
    # every holding grew by 50 shares before the exchange
    assert found[0]["exchange_ratio"] == pytest.approx(0.5, rel=0.05)
    held = model.table("holders").where("cusip = '20B000301'").orderBy("period").collect()
    assert [r["funds_holding"] for r in held] == [40, 45, 50]
    assert model.table("holders").where(F.col("cusip") == market.BIRCH.code).count() == 0


def _moves_by_hand(left, opened, p):
    """Pairs of identifiers with at least as many shared movers as a replacement needs, counted one by one."""
    pairs = {}
    for (old, cik, departed), (new, other, arrived) in itertools.product(left, opened):
        if cik == other and old != new:
            pairs.setdefault((old, new, departed, arrived), set()).add(cik)
    return {
        (o, n): len(c) for (o, n, d, a), c in pairs.items()
        if len(c) >= max(p.change_min_moved, a / 2) and len(c) >= min(d / 2, p.change_partial_moved)
    }


def _sides(spark, left, opened):
    frame = lambda rows, names: spark.createDataFrame(rows, names).withColumn("period", F.to_date(F.lit("2024-03-31")))
    return frame(left, "old_cusip string, cik long, departed long"), frame(opened, "new_cusip string, cik long, arrived long")


def test_candidate_pairs_lose_no_replacement(spark):
    """Random movers of every load: all pairs that share enough are candidates."""
    draw, p = random.Random(7), Params(change_min_moved=3, change_partial_moved=5)
    sets = {}
    for code in [f"o{i}" for i in range(25)] + [f"n{i}" for i in range(25)]:
        sets[code] = set(draw.sample(range(40), draw.randint(3, 25)))
    for i in range(10):  # most movers of some old codes go on together
        sets[f"n{i}"] = set(draw.sample(sorted(sets[f"o{i}"]), max(3, len(sets[f"o{i}"]) * 3 // 4)))
    left = [(c, m, len(s)) for c, s in sets.items() if c[0] == "o" for m in s]
    opened = [(c, m, len(s)) for c, s in sets.items() if c[0] == "n" for m in s]
    wanted = _moves_by_hand(left, opened, p)
    for at_once in (identity.PAIRS, 4):
        found = identity.candidate_pairs(*_sides(spark, left, opened), p, at_once).collect()
        assert len(found) == len({(r["old_cusip"], r["new_cusip"]) for r in found})
        assert wanted.keys() <= {(r["old_cusip"], r["new_cusip"]) for r in found} and len(wanted) > 20


def test_a_heavy_manager_forms_no_square_of_pairs(spark):
    """One manager leaves 5,000 identifiers and opens 5,000, each shared with 20 light ones of its own; one pair is
    real. None of the 25,000,000 pairs but that one is formed."""
    heavy, n = 0, 5_000
    movers = spark.range(n * 20).select((F.col("id") % n).alias("i"), (F.col("id") + 1).alias("cik"))
    both = lambda letter, far: movers.select(
        F.concat(F.lit(letter), "i").alias("code"), F.when(F.col("i") == 0, F.col("cik")).otherwise(F.col("cik") + far).alias("cik")
    ).union(spark.range(n).select(F.concat(F.lit(letter), "id"), F.lit(heavy).cast("long")))
    side = lambda letter, far, code, count: both(letter, far).select(
        F.col("code").alias(code), "cik", F.lit(21).cast("long").alias(count), F.to_date(F.lit("2024-03-31")).alias("period")
    )
    left, opened = side("o", 0, "old_cusip", "departed"), side("n", 10**7, "new_cusip", "arrived")
    found = identity.candidate_pairs(left, opened, Params())
    assert [(r["old_cusip"], r["new_cusip"]) for r in found.collect()] == [("o0", "n0")]


def test_gaps_end_a_series_and_empty_quarters_follow_it(spark):
    """Held in Q1, not in Q2, held in Q3 and Q4, gone in Q5: the run is Q3 on."""
    days = ["2024-03-31", "2024-06-30", "2024-09-30", "2024-12-31", "2025-03-31"]
    periods = spark.createDataFrame(
        [(d, i + 1, f"Q{i}", days[i - 1] if i else None) for i, d in enumerate(days)], "p string, seq int, label string, q string"
    ).select(F.to_date("p").alias("period"), "seq", "label", F.to_date("q").alias("prev_period"))
    filers = periods.select("period", F.lit(10).cast("bigint").alias("filers"), F.lit(10).cast("bigint").alias("filings"))
    rows = [("s", days[0], 1), ("s", days[2], 5), ("s", days[3], 8)]
    holders = spark.createDataFrame(rows, "cusip string, p string, funds_holding bigint").select(
        "cusip", F.to_date("p").alias("period"), "funds_holding",
        *(F.lit(100).cast("bigint").alias(c) for c in ("shares_filed", "value_filed", "shares", "value")),
        *(F.lit(0).cast("bigint").alias(c) for c in ("flagged_rows", "thousands_rows", "flagged_shares")),
        F.lit(1.0).alias("median_price"), F.lit(1).cast("bigint").alias("cusips"),
    )
    from tidegauge.operators.holders import stock_periods

    changes = spark.createDataFrame([], "cusip string, period date, bought_shares double, sold_shares double")
    table = stock_periods(holders, changes, periods, filers, None, SMALL)
    series = reads.stock_series(table, holders, periods, filers).orderBy("period").collect()
    assert [(str(r["period"]), r["held"], r["funds"], r["funds_change"], r["streak"]) for r in series] == [
        (days[2], True, 5, None, 0), (days[3], True, 8, 3, 1), (days[4], False, 0, -8, 1),
    ]
    assert series[2]["funds_pct"] == -1.0 and series[0]["funds_prev"] is None


def test_loading_twice_changes_nothing(spark, tmp_path):
    schema = "a string, source_zip string"
    first = spark.createDataFrame([("1", "x"), ("2", "x"), ("3", "y")], schema)
    path = str(tmp_path / "table")
    files.replace_by_source(first, path)
    files.replace_by_source(first.where("source_zip = 'x'"), path)
    files.replace_by_source(spark.createDataFrame([("9", "y")], schema), path)
    rows = files.read_by_source(spark, path, ["a"]).collect()
    assert {(r["a"], r["source_zip"]) for r in rows} == {("1", "x"), ("2", "x"), ("9", "y")}


def test_a_book_is_exported_as_csv(spark, built, tmp_path):
    headers = reads.book_headers(built.table("manager_totals"), built.table("filings"), built.table("periods"))
    book = reads.manager_book(built.table("position_pairs"), headers, built.table("stocks"), built.table("holders"))
    from tidegauge.sources.sinks import export_book_csv

    export_book_csv(book.where("cik = 46"), str(tmp_path / "books"))
    rows = spark.read.csv(str(tmp_path / "books"), header=True, inferSchema=False).where("period = '2024-12-31'").collect()
    got = {r["cusip"]: (r["change"], r["shares"], r["shares_before"]) for r in rows}
    assert got == {
        market.ALDER.code: ("add", "92100", "92050"), market.BIRCH.code: ("new", "92100", "0"),
    }
    assert sum(float(r["weight"]) for r in rows if r["weight"]) == pytest.approx(1.0, abs=1e-5)


def test_layouts_of_one_folder_are_two_scans_however_many_files(spark, tmp_path):
    folder = tmp_path / "q1"
    folder.mkdir()
    for i in range(6):
        (folder / f"part-{i}.tsv").write_text(f"A\tB\n{i}\tx\n" if i % 2 else f"B\tA\ny\t{i}")
    (folder / "part-7.tsv").write_text("")
    scanned = files.scan_filing_tsv(spark, str(tmp_path), ["A", "B", "C"])
    assert sorted((r["A"], r["B"], r["C"], r["source_zip"]) for r in scanned.collect()) == [
        (str(i), "x" if i % 2 else "y", None, "q1") for i in range(6)
    ]
    assert scanned._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 2
    (folder / "part-8.tsv").write_text("A\tB\n1\t2\t3\n")
    with pytest.raises(Exception, match="MALFORMED|malformed|columns"):
        files.scan_filing_tsv(spark, str(tmp_path), ["A"]).collect()


class _Watched(io.BytesIO):
    """A file that remembers the most bytes one read gave."""

    most = 0

    def read(self, size=-1):
        given = super().read(size)
        self.most = max(self.most, len(given))
        return given


def test_an_archive_is_streamed_whatever_its_size():
    """A member of 60 MB in an archive of under 1 MB: no read and no batch grows with it, and numbers run on."""
    out, lines = _Watched(), 3_000_000
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive, archive.open("X/a.TSV", "w", force_zip64=True) as member:
        member.write(b"n\tv\r\n")
        for _ in range(30):
            member.write(b"0123456789\t1234567\r\n" * (lines // 30))
    seen = largest = 0
    for batch in archives.lines_of(out, "file:/in/a.zip", "A"):
        assert batch["number"][0].as_py() == seen
        seen += len(batch)
        largest = max(largest, batch.nbytes)
    assert seen == lines + 1 and largest < 3 * archives.BATCH_BYTES and out.most <= archives.READ_BYTES
    out.seek(0)
    size, digest = archives.digest_of(out)
    assert size == len(out.getvalue()) and digest == hashlib.sha256(out.getvalue()).hexdigest()


def test_known_archives_are_skipped(spark, tmp_path):
    market.write_zips(tmp_path)
    archives = files.archive_files(spark, str(tmp_path))
    tables = raw_from(spark, tmp_path)
    log = files.load_log(tables, archives, F.lit("2025-01-01").cast("timestamp_ntz"))
    assert log.count() == 12
    assert files.archives_to_load(archives, None).count() == 3
    assert files.archives_to_load(archives, log).count() == 0
    changed = archives.withColumn("zip_sha256", F.lit("other"))
    assert files.archives_to_load(changed, log).count() == 3


def test_tsv_columns_may_come_in_another_order(spark, tmp_path):
    for name, text in (("one", 'A\tB\n1\t"x\n\\y\t \n'), ("two", "B\tA\nz\t2")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "INFOTABLE.tsv").write_text(text)
    paths = [str(tmp_path / "one"), str(tmp_path / "two")]
    scanned = files.scan_filing_tsv(spark, paths, ["A", "B", "C"])
    rows = {(r["A"], r["B"], r["C"], r["source_zip"]) for r in scanned.collect()}
    assert rows == {("1", '"x', None, "one"), ("\\y", " ", None, "one"), ("2", "z", None, "two")}
    audit = files.load_row_audit(scanned, files.data_lines(spark, paths))
    assert audit.count() == 0
    short = files.load_row_audit(scanned.where("A <> '1'"), files.data_lines(spark, paths))
    assert [(r["source_zip"], r["loaded"], r["expected"]) for r in short.collect()] == [("one", 1, 2)]
    with pytest.raises(ValueError, match="rows"):
        files.require_empty(short, "rows differ from the file's lines")


def test_weights_are_rounded_as_the_numbers_they_are(spark):
    from tidegauge.sources.sinks import book_csv_rows

    weights = [1 / 128, 3 / 128, 0.1234565, 0.0000005, 0.0000015, 0.25, 1.0]
    rows = [(i, w, "A", None, None, None, "c", "stock", 1, 1.0, 1.0, "hold", 0.0, "p") for i, w in enumerate(weights)]
    book = spark.createDataFrame(
        rows,
        "cik int, weight_now double, name_filed string, name_mixed string, ticker string, title_of_class string, cusip string, "
        "kind string, value_now bigint, shares_now double, shares_prev double, action string, flow double, period string",
    )
    assert [r["weight"] for r in book_csv_rows(book).orderBy("cik").collect()] == [f"{w:.6f}" for w in weights]


def crowded_zips(folder, lines=20_000):
    """The market's archives, the first with so many lines of one filing."""

    def change(quarter, rows):
        if quarter == 0:
            rows["INFOTABLE"] += [["M0001Q0", 100 + n, "ALDER", "COM", "10A000101", "", n, n, "SH", ""] for n in range(lines)]

    market.write_zips(folder, change)


def rows_moved(spark):
    """Rows written to shuffles so far in this session."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    none, gateway = spark._jvm.java.util.ArrayList(), spark.sparkContext._gateway
    stages = context.statusStore().stageList(none, False, False, gateway.new_array(gateway.jvm.double, 0), none)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_scanned_lines_stay_in_the_task_that_reads_them(spark, tmp_path):
    crowded_zips(tmp_path)
    before = rows_moved(spark)
    assert len(files.scan_zip_members(spark, str(tmp_path), "INFOTABLE", ["VALUE"]).collect()) > 20_000
    assert rows_moved(spark) - before < 100


def test_loaded_lines_stay_in_the_task_that_reads_them(spark, tmp_path):
    crowded_zips(tmp_path / "in")
    before = rows_moved(spark)
    added, ragged = files.load_archives(spark, str(tmp_path / "in"), str(tmp_path / "tables"), F.lit("2025-01-01"))
    assert max(r["row_count"] for r in added.collect()) > 20_000 and ragged.isEmpty()
    assert rows_moved(spark) - before < 2_000  # before: every line, several times
    assert spark.read.parquet(str(tmp_path / "tables" / "raw_infotable")).count() > 20_000


def test_archives_are_packed_from_pieces_of_bounded_size(tmp_path, monkeypatch):
    monkeypatch.setattr(zip_pieces, "HELD_BYTES", 2_000)
    lines = [(f"{n % 3}.zip", f"{n}\tx".encode()) for n in range(3_000)]
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.binary())], names=["source_zip", "line"])
    pieces = [p for b in zip_pieces.pieces_of((batch(lines[i : i + 100]) for i in range(0, 3_000, 100)), 1) for p in b.to_pylist()]
    assert all(len(zlib.decompress(p["deflated"])) < 3_000 for p in pieces) and len(pieces) > 10
    ordered = sorted(pieces, key=lambda p: (p["source_zip"], p["place"]))
    made = zip_pieces.archives_of(iter([pa.RecordBatch.from_pylist(ordered)]), str(tmp_path), [("data/a.tsv", b"A"), ("data/b.tsv", b"N\tX")])
    assert [r["source_zip"] for b in made for r in b.to_pylist()] == ["0.zip", "1.zip", "2.zip"] == sorted(p.name for p in tmp_path.iterdir())
    for k in range(3):
        with zipfile.ZipFile(tmp_path / f"{k}.zip") as archive:
            assert archive.read("data/a.tsv") == b"A\n"
            head, *rest = archive.read("data/b.tsv").splitlines()
            assert head == b"N\tX" and sorted(rest) == sorted(line for source, line in lines if source == f"{k}.zip")
