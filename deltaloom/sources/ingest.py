"""Both sides of a comparison, read and aligned."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from deltaloom.operators.align import align_on_ingest, fold_headers
from deltaloom.sources.readers import read
from deltaloom.spec import DiffConfig, SourceConfig


class DataIngestor:
    """Reads source and target as configured, folds headers if asked, and applies ignore and rename rules."""

    def __init__(self, config: DiffConfig, source: SourceConfig, target: SourceConfig, spark: SparkSession | None = None) -> None:
        self.config, self.source, self.target = config, source, target
        self._spark = spark

    @property
    def spark(self) -> SparkSession:
        return self._spark or SparkSession.builder.getOrCreate()

    def prepare(self, df: DataFrame, is_source: bool) -> DataFrame:
        if self.config.normalize_column_names:
            df = fold_headers(df)
        return align_on_ingest(df, self.config, is_source)

    def get_dataframes(self) -> tuple[DataFrame, DataFrame]:
        return self.prepare(read(self.spark, self.source), True), self.prepare(read(self.spark, self.target), False)
