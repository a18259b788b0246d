"""Registered queries against their SQL on the driver's smallest tables: the headline ones, or all
with CHECKS=all."""

import os

import pytest

from bench import HEADLINE
from checks import ORACLES, QUERIES
from checks.compare import compare, connect


@pytest.fixture(scope="module")
def duck(folder):
    return connect(folder)


def test_every_query_has_its_sql():
    assert set(ORACLES) == set(QUERIES)


# Beside the headline: loads from files on disk, audits that have rows to report, streams and their state.
ALSO = (
    "load_archives", "load_archives_log", "scan_zip_members", "load_row_audit_short", "source_reliability_state", "stream_ingest_audited",
    "join_equi_inequality",
)
CHOSEN = sorted(QUERIES) if os.environ.get("CHECKS") == "all" else sorted({*HEADLINE, *ALSO})


@pytest.mark.parametrize("name", CHOSEN)
def test_query_agrees_with_its_sql(spark, folder, duck, name):
    line = compare(spark, duck, folder, name, QUERIES[name], ORACLES.get(name))
    assert line.startswith("ok"), line


def test_the_flagship_query_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


SHARED_CODES = ("pending_keys", "resolve_stage", "ticker_fallback_cascade", "fallback_counts", "asked_again", "upsert_cache")


@pytest.fixture(scope="module")
def many_parts(folder, tmp_path_factory):
    """Parts with numbers of six and of seven digits, several of which share an identifier."""
    path = str(tmp_path_factory.mktemp("parts"))
    for name in os.listdir(folder):
        if name != "part.parquet":
            os.symlink(f"{folder}/{name}", f"{path}/{name}")
    numbers = "SELECT unnest(range(100000, 100100)) UNION ALL SELECT unnest(range(1000000, 1001000))"
    connect(folder).execute(
        f"COPY (SELECT p.* REPLACE (n AS p_partkey) FROM ({numbers}) k(n) JOIN "
        f"(SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS i, count(*) OVER () AS whole FROM part) p ON n % whole = i) "
        f"TO '{path}/part.parquet' (FORMAT parquet)"
    )
    return path


@pytest.mark.parametrize("name", SHARED_CODES)
def test_parts_beyond_six_digits(spark, many_parts, name):
    line = compare(spark, connect(many_parts), many_parts, name, QUERIES[name], ORACLES[name])
    assert line.startswith("ok"), line
