import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from toposcan.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(app="toposcan-tests")
    yield s
    s.stop()


@pytest.fixture
def rows():
    """Rows of a DataFrame as sorted tuples."""

    def take(df, *cols):
        return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())

    return take
