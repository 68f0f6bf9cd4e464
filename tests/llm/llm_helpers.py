from pyspark.sql import functions as F

NAMES = ["_text", "_words", "_row", "row", "key", "hash", "shard", "body", "tie", "owner", "repository", "value", "bucket", "n"]


def clashing(df):
    """Extra columns that bear the names operators use inside."""
    return df.withColumns({n: F.lit("clash") for n in NAMES})


def rows(df):
    """Sorted list of tuples."""
    return sorted((tuple(r) for r in df.collect()), key=repr)
