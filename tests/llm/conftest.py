import pytest


@pytest.fixture(scope="session")
def rows_of():
    """Rows of a DataFrame as sorted tuples (nulls last)."""
    def collect(df):
        return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, str(x)) for x in r))
    return collect
