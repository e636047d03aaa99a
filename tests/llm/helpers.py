import random

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
CLASHES = ["score", "n", "t", "ids", "component", "list", "cluster", "_id", "fp", "slice"]


def clashing(df):
    """The table with more columns, named as operators name their own."""
    for name in CLASHES:
        if name not in df.columns:
            df = df.withColumn(name, F.lit("x"))
    return df


def prose(seed, n, vocabulary=400):
    order = random.Random(seed)
    return " ".join(f"w{order.randrange(vocabulary)}x{order.randrange(vocabulary)}" for _ in range(n))


def rows_of(df):
    return [tuple(r) for r in df.collect()]
