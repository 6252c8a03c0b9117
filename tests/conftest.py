import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tsfoundry.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_spark("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "6g",
    })
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture()
def series(spark):
    """Make a panel (series_id, idx, y, ...) from column lists."""

    def make(columns: dict, sid: str = "a", start: int = 0):
        names = list(columns)
        rows = [(sid, start + i, *[None if v is None else float(v) for v in vals]) for i, vals in enumerate(zip(*columns.values()))]
        return spark.createDataFrame(rows, "series_id string, idx long, " + ", ".join(f"{n} double" for n in names))

    return make
