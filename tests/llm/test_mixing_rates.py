from pyspark.sql import functions as F

from tidelog.llm import mixing


def test_what_capped_sources_lack_goes_to_the_others(spark):
    """op6_poisson_mixing: the total is kept, in several rounds of capping."""
    sizes = {"a": 1_000_000, "b": 30_000, "c": 12_000, "d": 1}
    docs = spark.createDataFrame([(i, "x" * n, s) for i, (s, n) in enumerate(sizes.items())] + [(9, None, "e")], "doc_id long, text string, source string")
    got = {r[0]: r[1] for r in mixing.rates(docs).collect()}
    assert abs(sum(got[s] * n for s, n in sizes.items()) / sum(sizes.values()) - 1) < 1e-6
    assert max(got.values()) == got["d"] == got["c"] == 4 and got["e"] == 1
    free = [s for s in sizes if got[s] < 4]
    assert len({round(got[s] * sizes[s] ** 0.5, 3) for s in free}) == 1


def test_given_rates_above_the_cap(spark):
    """op6_poisson_mixing: no copies are lost at large rates."""
    for rate in (60.0, 2000.0):
        mean, = spark.range(4000).select(mixing.poisson_count(F.lit(rate), mixing.uniform(F.col("id"))).alias("n")).agg(F.avg("n")).first()
        assert abs(mean - rate) < 5 * (rate / 4000) ** 0.5
