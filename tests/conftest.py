import pytest

from tests.session import make_session


@pytest.fixture(scope="session")
def spark():
    session = make_session("4", **{"spark.sql.shuffle.partitions": "4", "spark.default.parallelism": "4"})
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Rows of a DataFrame as a sorted list of tuples."""

    def collect(df, *columns):
        df = df.select(*columns) if columns else df
        return sorted((tuple(r) for r in df.collect()), key=lambda r: [(x is None, str(x)) for x in r])

    return collect
