from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from finpanel.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests", master="local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false",
        spark__driver__memory="4g", spark__ui__showConsoleProgress="false",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")), spark__sql__legacy__javaCharsets="true",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def series(spark):
    """Panel rows of one or more securities from lists of values: series(A=[...], B=[...], col="amp_pct")."""
    import datetime as dt

    def build(col: str = "amp_pct", **by_code):
        rows = [
            (code, dt.date(2020, 1, 1) + dt.timedelta(days=i), None if x is None else float(x))
            for code, xs in by_code.items() for i, x in enumerate(xs)
        ]
        return spark.createDataFrame(rows, f"stock_code string, date date, {col} double")

    return build
