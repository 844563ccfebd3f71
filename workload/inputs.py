"""Spark side of the input views."""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import DataFrame, SparkSession

from civicframe.session import tune

from .views import VIEWS, rings_sql


class Inputs:
    """Tables and views of one folder, as lazy DataFrames; a plan is built once, data is not kept."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = tune(spark)
        self.folder = folder

    @cache
    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _sql(self, text: str) -> DataFrame:
        names = set(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", text))
        return self.spark.sql(text, **{n: self.table(n) for n in names})

    @cache
    def view(self, name: str) -> DataFrame:
        return self._sql(VIEWS[name])

    @cache
    def polygons(self, name: str) -> DataFrame:
        return self._sql(rings_sql(name))
