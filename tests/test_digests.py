"""Order-free digests of large row sets."""

from pyspark.sql import functions as F

from evidquarry.operators import suites


def test_a_set_digest_beyond_a_bigint_wraps(spark):
    rows = spark.range(200_000).select(F.lit("f" * 64).alias("digest"))
    got = suites.set_digest(rows).first()
    total = 200_000 * (2**48 - 1)
    assert got == (200_000, 0, (total + 2**63) % 2**64 - 2**63) and total > 2**63
    assert suites.set_digest(rows.limit(3)).first().sum_digest == 3 * (2**48 - 1)
    assert suites.set_digest(rows.limit(0)).first() == (0, None, None)
