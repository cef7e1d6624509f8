from pyspark.sql import functions as F

from shelfsense.operators import ordering


def test_global_index_keeps_wide_rows(spark):
    """Every row keeps its place when all columns are read and AQE coalesces partitions."""
    n = 30_000
    wide = spark.range(n).select((F.col("id") * 7919 % n).alias("k"), F.repeat(F.sha2(F.col("id").cast("string"), 512), 4).alias("payload"))
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        out = ordering.global_index(wide, [F.col("k")], "pos")
        r = out.agg(F.count("*").alias("n"), F.sum((F.col("k") != F.col("pos")).cast("int")).alias("off"),
                    F.sum(F.length("payload")).alias("len"), F.count_distinct("pos").alias("d")).first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert (r["n"], r["off"], r["len"], r["d"]) == (n, 0, n * 512, n)
