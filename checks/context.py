"""One model per session and input folder, its tables written once to the shared folder."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks import adapter
from checks.settings import PARAMS, digits_of
from tidegauge.plans.model import Model
from tidegauge.session import shared_folder
from tidegauge.sources.tables import write_table

_MODELS: dict[tuple[str, str], "CheckModel"] = {}


class CheckModel(Model):
    """A model whose raw tables are the driver's, mapped and written on first use."""

    folder: str = ""

    def table(self, name: str) -> DataFrame:
        plans = self.__dict__.setdefault("_raw_plans", {})
        if name in plans and name not in self.raw:
            self.raw[name] = write_table(plans[name], f"{self.path}/{name}", rebalance=False)
        return super().table(name)

    def derived(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A read's result written once, for the reads that start from it."""
        if name not in self.tables:
            self.tables[name] = write_table(build(), f"{self.path}/read-{name}")
        return self.tables[name]

    def exported(self, name: str, write: Callable[[str], None]) -> str:
        """A folder written once by `write`."""
        done = self.__dict__.setdefault("_exports", set())
        path = f"{self.path}/export-{name}"
        if name not in done:
            write(path)
            done.add(name)
        return path

    def source(self, name: str) -> DataFrame:
        """One of the driver's tables."""
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def part(self) -> DataFrame:
        return self.source("part")


def model(spark: SparkSession, folder: str) -> CheckModel:
    app = spark.sparkContext.applicationId
    key = (app, folder)
    if key not in _MODELS:
        mark = hashlib.sha256(folder.encode()).hexdigest()[:12]
        made = CheckModel(spark, {}, f"{shared_folder(spark)}/tidegauge-{app}/{mark}", PARAMS)
        made.folder = folder
        made.__dict__["_raw_plans"] = adapter.raw_tables(spark, folder)
        _MODELS[key] = made
    return _MODELS[key]


def tidy(df: DataFrame) -> DataFrame:
    """Floating columns rounded half up, so that the order of additions does not show."""

    def shown(field: T.StructField):
        if not isinstance(field.dataType, T.DoubleType):
            return F.col(field.name)
        scale = float(10 ** digits_of(field.name))
        return (F.floor(F.col(field.name) * scale + 0.5) / scale).alias(field.name)

    return df.select(*map(shown, df.schema))
