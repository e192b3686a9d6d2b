import os
import sys

import pytest

HOME = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, HOME)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, (HOME, os.environ.get("PYTHONPATH"))))


@pytest.fixture(scope="session")
def spark():
    from quillstream.session import local_session

    session = local_session(4, 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return "/root/testdata/sf0.001"


def rows(df, *columns):
    """Rows as sorted tuples."""
    return sorted(map(tuple, (df.select(*columns) if columns else df).collect()), key=repr)


@pytest.fixture(scope="session")
def rowset():
    return rows
