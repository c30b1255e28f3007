"""Ranks and percentiles by ranges against Spark's own."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tissueflow.operators.ranks import percentiles, positions, tile


def test_percentiles_equal_sql(spark):
    for n, expr in ((1, "id"), (2, "id"), (999, "id * 37 % 101"), (500, "sqrt(id)"), (300, "if(id % 3 = 0, null, 5 - id)")):
        df = spark.range(n).select(F.expr(expr).alias("x"))
        want = df.agg(*(F.percentile("x", F.lit(p)).alias(k) for k, p in (("a", 0.01), ("b", 0.5), ("c", 1.0)))).first()
        assert tuple(percentiles(df, "x", a=0.01, b=0.5, c=1.0).first()) == tuple(want)
    assert tuple(percentiles(spark.range(0).selectExpr("id AS x"), "x", a=0.5).first()) == (None,)


def test_tiles_equal_ntile(spark):
    for n in (0, 7, 25, 603):
        df = spark.range(n).select("id", F.expr("id * 7 % 5").alias("k"))
        t, size = positions(df, "k", "id")
        got = {r.id: (r.position, r.b) for r in t.withColumn("b", tile(F.col("position"), size, 25)).collect()}
        by = Window.orderBy("k", "id")
        assert size == n and got == {r.id: (r.p, r.b) for r in df.withColumn("p", F.row_number().over(by)).withColumn("b", F.ntile(25).over(by)).collect()}
