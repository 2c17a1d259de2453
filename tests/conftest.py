import os
import sys
from datetime import datetime, timedelta

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from barlab.session import local_session  # noqa: E402

START = datetime(2024, 1, 1)


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "tests", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def bars(spark):
    """bars(minutes, instruments=None, root='NQ', closes=None) -> bar DataFrame."""

    def build(minutes, instruments=None, root="NQ", closes=None):
        minutes = list(minutes)
        instruments = instruments or [1] * len(minutes)
        closes = closes or [100.0 + m for m in minutes]
        rows = [
            (START + timedelta(minutes=m), root, i, c, c + 1, c - 1, c, float(10 + m))
            for m, i, c in zip(minutes, instruments, closes)
        ]
        return spark.createDataFrame(
            rows,
            "ts timestamp, root string, instrument_id bigint, open double, high double, low double, "
            "close double, volume double",
        )

    return build
