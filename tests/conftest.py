"""A small local session, and fixture files that are made here."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from verisift.plans.fixtures import docx, exif_jpeg, fixture_files, pdf, png, pptx, tar, wav, xlsx, zipped  # noqa: E402, F401  for the tests


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    shared = tmp_path_factory.mktemp("shared")
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{shared}").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    from verisift.sources.session import ship

    ship(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def folder(tmp_path_factory) -> Path:
    top = tmp_path_factory.mktemp("files")
    for name, data in fixture_files().items():
        (top / name).write_bytes(data)
    return top
