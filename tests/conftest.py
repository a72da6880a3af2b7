import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from planlens.session import session
    s = session("local[8]", 8, "planlens-tests")
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield s
    s.stop()


@pytest.fixture()
def column(spark):
    """One-column frame with a row number ``i``: column([1, None, 3], "double")."""
    def make(values, kind="double", name="v"):
        return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i long, {name} {kind}")
    return make


@pytest.fixture()
def read():
    def rows(df, col="v", order="i"):
        return [r[col] for r in df.orderBy(order).collect()]
    return rows
