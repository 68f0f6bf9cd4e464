from pyspark.sql import functions as F

from sceneframe.functions import boxes as B


def test_code_digits_of_windows_and_of_other_codes(spark):
    codes = [[1, 0, 0, 1], [0, 1, 1, 0], [0, 0, 1, 0], [1, 1, 0, 1], [2, 0, 0, 1], [1, 0], [], [0, 1, 0, 1, 0]]
    df = spark.createDataFrame([(i, list(map(float, c))) for i, c in enumerate(codes)], "i int, c array<double>")
    got = df.select(B.code_digits(F.col("c"), (2, 2)).alias("t")).collect()
    assert [r.t for r in got] == ["".join(map(str, c)) for c in codes]
    one = spark.range(10).select(B.code_digits(B.onehot_boxes(*[F.col("id")] * 4, kind="double")).alias("t"), B.onehot_boxes(*[F.col("id")] * 4).alias("c"))
    assert all(r.t == "".join(map(str, r.c)) for r in one.collect())
