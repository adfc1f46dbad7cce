import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from oracle import session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    spark = session()
    spark.conf.set("spark.sql.dataFrameQueryContext.enabled", "false")
    yield spark
    spark.stop()


def rows(df, *order):
    """Rows as tuples, sorted by the given columns or as a whole."""
    collected = [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]
    return collected if order else sorted(collected, key=repr)
