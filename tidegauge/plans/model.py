"""The model's tables in dependency order: each built once by its operator, written, read back."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from tidegauge.operators import calendar, filings, fundamentals, holders, identity, positions, prices
from tidegauge.params import Params
from tidegauge.sources.tables import write_table

MANIFEST = "version bigint, name string, folder string, columns string"

RAW_TABLES = (
    "raw_submission", "raw_coverpage", "raw_summarypage", "raw_infotable", "raw_prices", "raw_xbrl_frames",
    "raw_sec_tickers", "openfigi", "ticker_fallbacks",
)


@dataclass(frozen=True)
class Step:
    build: Callable[..., DataFrame]
    needs: tuple[str, ...]
    partition_by: str | None = None
    takes_params: bool = False


def _windows(raw_submission: DataFrame) -> DataFrame:
    return calendar.filing_windows(raw_submission.select("source_zip").distinct())


STEPS: dict[str, Step] = {
    "submissions": Step(filings.submissions, ("raw_submission", "raw_coverpage", "raw_summarypage")),
    "windows": Step(_windows, ("raw_submission",)),
    "periods": Step(calendar.quarter_spine, ("windows", "submissions")),
    "filing_parts": Step(filings.filing_parts, ("submissions", "periods"), "period"),
    "filings": Step(filings.filings, ("filing_parts", "submissions", "raw_infotable"), "period"),
    "managers": Step(filings.managers, ("submissions",)),
    "position_sums": Step(positions.position_sums, ("filing_parts", "raw_infotable"), "period"),
    "positions": Step(positions.positions, ("position_sums",), "period", True),
    "price_check": Step(positions.price_check, ("positions", "filings"), "period"),
    "cusip_holders": Step(positions.cusip_holders, ("positions",)),
    "cusip_moves": Step(identity.cusip_moves, ("periods", "cusip_holders", "positions", "filings"), None, True),
    "cusip_changes": Step(identity.cusip_changes, ("cusip_moves",), None, True),
    "stock_keys": Step(identity.stock_keys, ("cusip_holders", "cusip_changes")),
    "spelled_names": Step(identity.spelled_names, ("cusip_holders", "filing_parts", "raw_infotable")),
    "securities": Step(identity.securities, ("spelled_names", "stock_keys")),
    "stocks": Step(identity.stocks, ("stock_keys", "cusip_holders", "securities", "openfigi", "ticker_fallbacks")),
    "holders": Step(holders.holders, ("positions", "stock_keys", "cusip_holders"), "period"),
    "filers_total": Step(filings.filers_total, ("periods", "filings")),
    "manager_totals": Step(filings.manager_totals, ("filings", "positions"), "period"),
    "position_pairs": Step(
        lambda pos, keys, per: holders.position_pairs(pos, keys, per, with_first=True),
        ("positions", "stock_keys", "periods"),
        "period",
    ),
    "report_pairs": Step(holders.report_pairs, ("filings", "periods"), "period"),
    "changes": Step(
        lambda pairs, reports, per: holders.changes(after_first(pairs, per), reports),
        ("position_pairs", "report_pairs", "periods"),
        "period",
    ),
    "stock_periods": Step(
        holders.stock_periods, ("holders", "changes", "periods", "filers_total", "stocks"), "period", True
    ),
    "fundamentals_history": Step(fundamentals.fundamentals_history, ("raw_xbrl_frames",), None, True),
    "fundamentals": Step(fundamentals.fundamentals, ("fundamentals_history",)),
    "cover_history": Step(fundamentals.cover_history, ("raw_xbrl_frames",)),
    "stock_cash_flows_history": Step(
        fundamentals.stock_cash_flows_history, ("stocks", "raw_sec_tickers", "fundamentals_history")
    ),
    "stock_cash_flows": Step(fundamentals.stock_cash_flows, ("stock_cash_flows_history",)),
    "quarter_prices": Step(prices.quarter_prices, ("raw_prices",), None, True),
    "market_days": Step(prices.market_days, ("raw_prices",), None, True),
    "stock_prices": Step(prices.stock_prices, ("stocks", "quarter_prices", "market_days", "periods"), None, True),
}

# What is looked at after new tickers: stocks, facts and prices, and everything read through them.
AFTER_TICKERS = (
    "stocks", "stock_periods", "fundamentals_history", "fundamentals", "cover_history", "stock_cash_flows_history",
    "stock_cash_flows", "quarter_prices", "market_days", "stock_prices",
)


def fingerprint(df: DataFrame) -> tuple:
    """Of a table's columns and rows, whatever their order: one aggregate, combined before its shuffle.
    Rows are hashed as text with nulls spelled out, and hashes summed, so that repeated rows count."""
    row = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    hashes = [F.sum(F.xxhash64(F.lit(salt), row).cast("decimal(20,0)")) for salt in ("one", "two")]
    return (*sorted(df.dtypes), *df.agg(F.count(F.lit(1)), *hashes).first())


def after_first(pairs: DataFrame, periods: DataFrame) -> DataFrame:
    """Position pairs of the periods that have one before them."""
    dated = F.broadcast(periods.where(F.col("prev_period").isNotNull()).select("period"))
    return pairs.join(dated, "period", "left_semi")


def levels() -> list[list[str]]:
    """The steps by what they wait for: those of one level need only tables of earlier ones."""
    level: dict[str, int] = {}
    for name, step in STEPS.items():
        level[name] = 1 + max((level[n] for n in step.needs if n in STEPS), default=-1)
    return [[n for n in STEPS if level[n] == i] for i in range(max(level.values()) + 1)]


@dataclass
class Model:
    """Model tables over a set of raw tables, built on first use and kept under `path`.

    A build writes to folders of its own. Readers see it once `publish` has added its row to the manifest,
    a table below `path`, in one file: until then, and after a build that broke off, `open` gives the
    tables published before. Folders of earlier builds stay for those who still read them."""

    spark: SparkSession
    raw: dict[str, DataFrame]
    path: str
    params: Params = Params()
    log: Callable[[str], None] | None = None
    tables: dict[str, DataFrame] = field(default_factory=dict)
    folders: dict[str, str] = field(default_factory=dict)
    generation: str = field(default_factory=lambda: uuid.uuid4().hex)

    @classmethod
    def open(cls, spark: SparkSession, path: str, raw: dict[str, DataFrame] | None = None, params: Params = Params()) -> Model:
        """The model last published under `path`, read where it was written; nothing is built. `raw` is
        needed only to build on."""
        manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
        newest = manifest.where(F.col("version") == manifest.agg(F.max("version")).scalar())
        model = cls(spark, dict(raw or {}), path, params)
        for row in newest.collect():  # one row a table
            schema = T.StructType.fromJson(json.loads(row["columns"]))
            model.tables[row["name"]] = spark.read.schema(schema).parquet(row["folder"]).select(*schema.fieldNames())
            model.folders[row["name"]] = row["folder"]
        if not model.tables:
            raise FileNotFoundError(f"no model has been published under {path}")
        return model

    def publish(self) -> int:
        """Make every table of the model (building what is missing) the one that `open` gives; the number
        of this version."""
        self.build_tables()
        try:
            last = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest").agg(F.max("version")).first()[0] or 0
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            last = 0
        rows = [(last + 1, name, self.folders[name], self.tables[name].schema.json()) for name in STEPS]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        return last + 1

    def plan(self, name: str) -> DataFrame:
        """The named table as a plan over its written inputs, not yet run."""
        step = STEPS[name]
        inputs = [self.table(n) for n in step.needs]
        return step.build(*inputs, self.params) if step.takes_params else step.build(*inputs)

    def table(self, name: str) -> DataFrame:
        if name in self.raw:
            return self.raw[name]
        if name not in self.tables:
            built = self.plan(name)
            started = time.monotonic()
            folder = f"{self.path}/{name}-{self.generation}"
            self.tables[name] = write_table(built, folder, STEPS[name].partition_by)
            self.folders[name] = folder
            if self.log:
                self.log(f"{name}: {time.monotonic() - started:.1f}s")
        return self.tables[name]

    def build_tables(self, at_once: int = 4) -> None:
        """Every table, those that don't wait for each other side by side."""
        for name in {n for step in STEPS.values() for n in step.needs if n not in STEPS}:
            self.table(name)
        with ThreadPoolExecutor(at_once) as pool:
            for names in levels():
                list(pool.map(self.table, names))

    def build_all(self) -> dict[str, int]:
        """Every table; rows per table."""
        self.build_tables()
        return {name: self.table(name).count() for name in STEPS}

    def refresh(self, raw: dict[str, DataFrame]) -> set[str]:
        """Take new raw tables, and build again only what they change; names of all that changed.

        A step runs again if a table it needs has other rows than before (in any order). Where it then
        gives the rows it gave before, its written table is kept and nothing behind it runs. Tables not
        built so far are left to their first use. A refresh that breaks off leaves the model as it was."""
        before = self.raw, dict(self.tables), dict(self.folders), self.generation
        changed = {n for n, new in raw.items() if n not in self.raw or fingerprint(new) != fingerprint(self.raw[n])}
        self.raw = {**self.raw, **raw}
        self.generation = uuid.uuid4().hex
        try:
            for name, step in STEPS.items():
                if changed.isdisjoint(step.needs):
                    continue
                old, folder = self.tables.pop(name, None), self.folders.pop(name, None)
                if old is not None and fingerprint(self.table(name)) == fingerprint(old):
                    self.tables[name] = old
                    if folder:
                        self.folders[name] = folder
                    else:
                        del self.folders[name]
                else:
                    changed.add(name)
        except BaseException:
            self.raw, self.tables, self.folders, self.generation = before
            raise
        return changed

    def rebuild_after_tickers(self, openfigi: DataFrame, ticker_fallbacks: DataFrame) -> dict[str, int]:
        """New identifier answers: what reads stocks is built again where its rows change; rows per table."""
        self.refresh({"openfigi": openfigi, "ticker_fallbacks": ticker_fallbacks})
        return {name: self.table(name).count() for name in AFTER_TICKERS}
