import sys
from pathlib import Path

import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tidemark.plans.series import series  # noqa: E402
from tidemark.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_session("tests", "local[4]", 4, "4g")
    yield session
    session.stop()


@pytest.fixture
def make(spark):
    """A series frame from {key: [values]} at daily steps (or given days)."""

    def build(data, days=None, bounded=True, segment_rows=1_000_000, **extra):
        rows = []
        for key, values in data.items():
            at = days or range(len(values))
            for i, (day, v) in enumerate(zip(at, values)):
                stamp = pd.Timestamp("2024-01-01") + pd.Timedelta(days=day)
                rows.append((key, stamp.to_pydatetime(), None if v is None else float(v), i))
        df = spark.createDataFrame(rows, "key string, ds timestamp, y double, i int")
        if not extra.get("keep_i"):
            df = df.drop("i")
        most = max(len(v) for v in data.values())
        return series(df, max_rows=most if bounded else None, segment_rows=segment_rows)

    return build


def rows_of(df, *order):
    return df.toPandas().sort_values(list(order) or ["key", "ds"]).reset_index(drop=True)
