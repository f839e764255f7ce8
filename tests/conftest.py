import datetime as dt

import pytest

from aeolith.session import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("spark")
    s = session("local[4]", "tests", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g",
        "spark.checkpoint.dir": f"file://{folder}/shared", "spark.sql.warehouse.dir": str(folder / "warehouse"), "spark.default.parallelism": "2",
    })
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def facts(spark):
    """Four sites, two days by the hour; values rise with site and hour."""
    start = dt.datetime(2012, 1, 31)
    rows = [(g, start + dt.timedelta(hours=h), float(g * 10 + h % 24), float(g * 10 + h % 24) * 1.1 + 1) for g in range(4) for h in range(48)]
    return spark.createDataFrame(rows, "gid long, ts timestamp_ntz, windspeed_80m double, windspeed_100m double").cache()


@pytest.fixture(scope="session")
def meta(spark):
    rows = [(g, 40.0 + g, -105.0 + g, -7 + g, "CO" if g < 2 else "NE") for g in range(4)]
    return spark.createDataFrame(rows, "gid long, latitude double, longitude double, timezone int, state string").cache()
