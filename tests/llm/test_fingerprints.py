"""Groups of fingerprints up to six bits apart."""
import random

from pyspark.sql import functions as F

from shelfsense.llm import fingerprints


def test_six_bits_apart_is_near(spark):
    """Each pair within 6 bits is one group, a pair 7 bits apart is none, and pairs meet in one table only."""
    r, rows = random.Random(8), []
    for i in range(90):
        hi, lo = r.getrandbits(63), r.getrandbits(63)
        flips = r.sample(range(126), i % 9)
        rows += [(i, hi, lo), (i, hi ^ sum(1 << f for f in flips if f < 63), lo ^ sum(1 << (f - 63) for f in flips if f >= 63))]
    d = spark.createDataFrame(rows, "i int, hi long, lo long")
    got = d.distinct().join(fingerprints.near_groups(d.select("hi", "lo").distinct()), ["hi", "lo"]).groupBy("i").agg(F.countDistinct("root").alias("n"))
    assert {x["i"]: x["n"] for x in got.collect()} == {i: 2 if i % 9 > 6 else 1 for i in range(90)}
