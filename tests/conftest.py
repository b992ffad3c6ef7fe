import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gleaner.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", "local[4]", {
        "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def interactions(spark):
    """Builds an interaction table from (user, item, 'date' or seconds[, category]) tuples."""
    from gleaner.operators.splits import unix

    def build(rows, category=False):
        rows = [(r[0], r[1], unix(r[2]) if isinstance(r[2], str) else r[2], *r[3:]) for r in rows]
        schema = "user_idx int, item_idx int, ts bigint" + (", category_idx int" if category else "")
        return spark.createDataFrame(rows, schema)

    return build


@pytest.fixture
def histories(spark):
    """Builds histories from {user: [items]}."""

    def build(by_user):
        rows = [(u, i, n) for u, items in by_user.items() for n, i in enumerate(items)]
        return spark.createDataFrame(rows, "user_idx int, item_idx int, ts bigint")

    return build


@pytest.fixture
def lists(spark):
    """Builds ranked lists from {user: [items]}; negative ids keep their place."""

    def build(by_user):
        rows = [(u, n + 1, i) for u, items in by_user.items() for n, i in enumerate(items)]
        return spark.createDataFrame(rows, "user_idx int, rank int, item_idx int")

    return build


def ranked(recs):
    """{user: [items by rank]} of a recommendation table."""
    out = {}
    for row in recs.orderBy("user_idx", "rank").collect():
        out.setdefault(row["user_idx"], []).append(row["item_idx"])
    return out
