import numpy as np

from cairn.functions import equality


def test_steps_between_numbers(spark):
    one = np.float64(1.0)
    rows = [(1.0, float(np.nextafter(one, 2)), True), (1.0, 1.0 + 1e-12, False), (0.0, -0.0, True), (-1e-320, 1e-320, False), (float("nan"), float("nan"), False), (2.5, 2.5, True)]
    df = spark.createDataFrame(rows, "a double, b double, want boolean").coalesce(1)
    got = df.select(equality.almost_equal()("a", "b").alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in got)
    assert equality.ulp_distance(np.float32([1]), np.float32([1.0000001]))[0] == 1
