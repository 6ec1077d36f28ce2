import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from affinity.session import build_session

    s = build_session(
        "affinity-tests",
        "local[4]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__driver__memory="4g",
        spark__ui__showConsoleProgress="false",
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def toy(spark):
    """4 users x 4 items: user 4 rated one item, item 4 has one rater."""
    rows = [(1, 1, 5.0), (1, 2, 3.0), (1, 3, 4.0), (2, 1, 4.0), (2, 2, 2.0), (2, 4, 5.0), (3, 2, 4.0), (3, 3, 5.0), (4, 1, 1.0)]
    return spark.createDataFrame(rows, "user_id bigint, item_id bigint, rating double").cache()


@pytest.fixture(scope="session")
def skewed(spark):
    """One user holds a third of all ratings, one item another large share."""
    rows = [(0, i, float(1 + i % 5)) for i in range(60)]
    rows += [(u, 0, float(1 + u % 5)) for u in range(1, 61)]
    rows += [(u, 1 + (u * 7) % 59, float(1 + (u * 3) % 5)) for u in range(1, 61)]
    return spark.createDataFrame(rows, "user_id bigint, item_id bigint, rating double").cache()
