from __future__ import annotations

import pathlib
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]

from tidegauge import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    made = session.build(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
        },
    )
    made.sparkContext.setLogLevel("OFF")
    yield made
    made.stop()


@pytest.fixture(scope="session")
def hours():
    """Hourly stamps from 2024-01-01."""
    import pandas as pd

    return lambda n: pd.date_range("2024-01-01", periods=n, freq="h")


@pytest.fixture(scope="session")
def series(spark):
    """A frame (id, ts, x) with hourly stamps from plain values; None stays missing."""
    from datetime import datetime, timedelta

    def make(values, ts=None):
        start = datetime(2024, 1, 1)
        stamps = ts or [start + timedelta(hours=i) for i in range(len(values))]
        rows = [(i, t, None if v is None else float(v)) for i, (t, v) in enumerate(zip(stamps, values, strict=True))]
        return spark.createDataFrame(rows, "id bigint, ts timestamp_ntz, x double")

    return make
