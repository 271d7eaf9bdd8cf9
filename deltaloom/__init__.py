"""Semantic comparison of two datasets on Spark."""

from deltaloom import datasets
from deltaloom.config import load_config
from deltaloom.plans.diff import DiffEngine
from deltaloom.sources.ingest import DataIngestor
from deltaloom.spec import DiffConfig, DiffRule, DiffSummary, SourceConfig

__version__ = "0.1.0"
__all__ = ["DataIngestor", "DiffConfig", "DiffEngine", "DiffRule", "DiffSummary", "SourceConfig", "datasets", "load_config"]
