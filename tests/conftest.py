import datetime as dt

import pytest

from opslens import schemas as S
from tests.session import make_session

T0 = dt.datetime(2024, 3, 1, 10, 0, 0)


@pytest.fixture(scope="session")
def spark():
    session = make_session(4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_events(spark):
    """rows of (asset_id, source, message, severity[, metric, value[, second]]) -> events in this order."""

    def make(rows):
        out = []
        for i, row in enumerate(rows):
            asset, source, message, severity, *rest = row
            metric, value = (rest + [None, None])[:2]
            second = rest[2] if len(rest) > 2 else i
            out.append((i + 1, asset, source, message, metric, value, severity, T0 + dt.timedelta(seconds=second)))
        return spark.createDataFrame(out, S.EVENT)

    return make


@pytest.fixture(scope="session")
def ids(spark):
    return lambda *names: spark.createDataFrame([(n,) for n in names], "asset_id string")
