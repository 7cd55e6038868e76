import os
import sys
from datetime import datetime, timedelta

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from eventide import schemas  # noqa: E402
from eventide.plans.market import Market  # noqa: E402
from eventide.session import local_session  # noqa: E402

TESTDATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(cores=8, shuffle_partitions=4, memory="4g")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    yield session
    session.stop()


def at(text: str) -> datetime:
    return datetime.fromisoformat(text)


def minutes(start: str, *offsets: int) -> list[datetime]:
    return [at(start) + timedelta(minutes=n) for n in offsets]


@pytest.fixture
def make(spark):
    """Small hand-made tables; anything not given is empty."""

    def build(closes=(), funding=(), oi=(), volume=1.0, **options) -> Market:
        bars = [(s, t, float(c), float(c), float(c), float(c), volume, 1) for s, t, c in closes]
        names = sorted({r[0] for r in [*closes, *funding, *oi]})
        return Market(
            symbols=spark.createDataFrame([(n, n[:-4], n[-4:]) for n in names], schemas.SYMBOLS),
            klines=spark.createDataFrame(bars, schemas.KLINES),
            funding=spark.createDataFrame([(s, t, float(r)) for s, t, r in funding], schemas.FUNDING),
            open_interest=spark.createDataFrame([(s, t, float(v)) for s, t, v in oi], schemas.OPEN_INTEREST),
            premium_index=spark.createDataFrame([], schemas.PREMIUM_INDEX),
            **options,
        )

    return build


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]
