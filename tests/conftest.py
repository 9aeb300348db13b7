import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from apexgrid.session import local_session

SAMPLES = "session_id string, channel string, freq int, sample_idx bigint, value double"


@pytest.fixture(scope="session")
def spark():
    session = local_session(cpus=4, memory="4g", partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make(spark):
    """Samples table from ``{(session, channel): (freq, values)}``."""

    def build(series):
        rows = [
            (s, c, freq, i, float(v)) for (s, c), (freq, values) in series.items() for i, v in enumerate(values)
        ]
        return spark.createDataFrame(rows, SAMPLES)

    return build


@pytest.fixture(scope="session")
def read(spark):
    """Values of a result by key columns, in order: ``{key: [value, ...]}``."""

    def collect(df, keys, order, value="value"):
        out = {}
        for row in df.orderBy(*keys, order).collect():
            key = tuple(row[k] for k in keys)
            out.setdefault(key if len(key) > 1 else key[0], []).append(row[value])
        return out

    return collect
