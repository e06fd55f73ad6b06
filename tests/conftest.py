import os
import sys
from datetime import datetime, timedelta, timezone

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from signalloom.session import build_session  # noqa: E402

UTC = timezone.utc
START = datetime(2026, 1, 1, tzinfo=UTC)

SIGNAL_SCHEMA = (
    "run_id string, signal_id string, source string, signal_type string, cleaned_text string, language string, "
    "country_code string, location_mode string, tags array<string>, modalities array<string>, "
    "published_at timestamp, collected_at timestamp"
)
METRIC_SCHEMA = "signal_id string, name string, value double, recorded_at timestamp, unit string"
RUN_SCHEMA = "run_id string, keyword string, timeframe_start timestamp, timeframe_end timestamp"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "4g",
        },
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make(spark):
    """Small signal, metric and run tables."""

    class Make:
        @staticmethod
        def signals(*rows):
            defaults = {
                "run_id": "r1", "source": "youtube", "signal_type": "video", "cleaned_text": "some text here",
                "language": "en", "country_code": None, "location_mode": None, "tags": [],
                "modalities": ["engagement", "text"], "published_at": START, "collected_at": START + timedelta(days=10),
            }
            names = [part.strip().split(" ")[0] for part in SIGNAL_SCHEMA.split(", ")]
            data = [tuple({**defaults, **row}.get(n) for n in names) for row in rows]
            return spark.createDataFrame(data, SIGNAL_SCHEMA)

        @staticmethod
        def metrics(*rows):
            """Rows of (signal, name, value, hours after the start[, unit])."""
            data = [(r[0], r[1], float(r[2]), START + timedelta(hours=r[3]), r[4] if len(r) > 4 else None) for r in rows]
            return spark.createDataFrame(data, METRIC_SCHEMA)

        @staticmethod
        def runs(*rows, days=10, keyword="Demon Slayer"):
            ids = rows or ("r1",)
            return spark.createDataFrame([(i, keyword, START, START + timedelta(days=days)) for i in ids], RUN_SCHEMA)

    return Make


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]
