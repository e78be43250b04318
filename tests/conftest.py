from __future__ import annotations

import datetime as dt

import pytest

from stormline.session import get_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = get_session(
        "tests",
        **{
            "spark.master": "local[4]", "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
            "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false",
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


ORIGIN = dt.datetime(2024, 1, 1)


def at(hours: float) -> dt.datetime:
    return ORIGIN + dt.timedelta(hours=hours)


def hours(stamp: dt.datetime | None) -> float | None:
    return None if stamp is None else (stamp - ORIGIN).total_seconds() / 3600
