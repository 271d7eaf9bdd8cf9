"""The taxi sample, downloaded once and cached."""

from __future__ import annotations

import shutil
import urllib.error
import urllib.request
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

#: Where the sample comes from: pass another address to load_nyc_taxi if this one is not reachable.
SAMPLE_URL = "https://d37ci6vzurychx.cloudfront.net/trip-data/yellow_tripdata_2024-01.parquet"
TIMEOUT_S = 15


def cache_folder() -> Path:
    return Path.home() / ".cache" / "deltaloom"


def _download(url: str, to: Path) -> None:
    part = to.with_suffix(".part")
    to.parent.mkdir(parents=True, exist_ok=True)
    try:
        with urllib.request.urlopen(url, timeout=TIMEOUT_S) as answer, part.open("wb") as out:
            shutil.copyfileobj(answer, out)
        part.replace(to)
    except (urllib.error.URLError, TimeoutError) as problem:
        part.unlink(missing_ok=True)
        to.unlink(missing_ok=True)
        raise RuntimeError(f"The sample could not be downloaded from {url}: {problem}") from problem


def load_nyc_taxi(spark: SparkSession | None = None, url: str = SAMPLE_URL) -> DataFrame:
    """Reads the cached sample; downloads it if it is absent, and once more if the cached file is corrupt."""
    spark = spark or SparkSession.builder.getOrCreate()
    path = cache_folder() / "nyc_taxi.parquet"
    if not path.exists():
        _download(url, path)
    try:
        return spark.read.parquet(str(path))
    except (PySparkException, Py4JJavaError):  # a broken footer comes as the latter
        path.unlink(missing_ok=True)
        _download(url, path)
        return spark.read.parquet(str(path))
