import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))

from yardframe.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[8]", "yardframe-tests")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def rows_of():
    """Collected rows as a sorted list of tuples, nulls first."""
    def collect(df, *columns):
        picked = df.select(*columns) if columns else df
        return sorted((tuple(r) for r in picked.collect()),
                      key=lambda r: [(v is not None, str(type(v)), v if v is not None else 0) for v in r])
    return collect
