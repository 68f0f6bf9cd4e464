"""What the tests share; fixtures are in ``conftest``."""

SF_DIR = "/root/testdata/sf0.001"


def rows(df):
    """Sorted list of tuples."""
    return sorted((tuple(r) for r in df.collect()), key=repr)
