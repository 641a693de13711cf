"""Shared plan inputs built from the driver tables (lazy DataFrames)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from suitewise.operators import impact as D
from suitewise.sources import fixtures as X


class Inputs:
    """Lazily derived inputs for one (session, sf_dir)."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @property
    def history(self) -> DataFrame:
        return X.test_history(self.spark, self.sf_dir)

    @property
    def model_history(self) -> DataFrame:
        return X.model_history(self.spark, self.sf_dir)

    @property
    def changed(self) -> DataFrame:
        return X.changed_files(self.spark, self.sf_dir)

    @property
    def imports(self) -> DataFrame:
        return X.test_imports(self.spark, self.sf_dir)

    @property
    def mapping(self) -> DataFrame:
        # one distinct (test_file, source_file) table feeds both file lists
        pairs = self.history.select("test_file", "source_file").distinct()
        return D.test_source_map(X.test_files(pairs), X.source_files(pairs), source_dir="src/")

    @property
    def impact(self) -> DataFrame:
        return D.impact_scores(self.mapping, self.imports, self.changed)

    @property
    def scores(self) -> DataFrame:
        return X.failure_scores(self.history)

    @property
    def candidates(self) -> DataFrame:
        return X.candidate_tests(self.spark, self.sf_dir, self.history)

    @property
    def change_map(self) -> DataFrame:
        return X.change_map(self.history)
