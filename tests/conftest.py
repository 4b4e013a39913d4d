import sys
from contextlib import redirect_stdout
from io import StringIO
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).parent.parent), str(Path(__file__).parent)]

from cartwright.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("*", "cartwright-tests")
    yield session
    session.stop()


@pytest.fixture
def conf(spark):
    """Sets session settings for one test."""
    before = {}

    def change(**settings):
        for key, value in settings.items():
            key = key.replace("__", ".")
            before.setdefault(key, spark.conf.get(key))
            spark.conf.set(key, value)

    yield change
    for key, value in before.items():
        spark.conf.set(key, value)


@pytest.fixture
def plan_of():
    """The physical plan as text; final once the DataFrame has been executed."""
    def text(df):
        out = StringIO()
        with redirect_stdout(out):
            df.explain("formatted")
        return out.getvalue()

    return text
