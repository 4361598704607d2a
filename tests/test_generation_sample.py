"""The reserved lanes of a generation sample are never cut."""

from evidquarry.operators import suites


def test_reserved_cases_stay_beyond_the_size(spark):
    rows = [(i, i, i % 3 != 0, "en" if i % 2 else "es", f"s{i % 5}") for i in range(120)]
    cases = spark.createDataFrame(rows, "case_id long, ord long, answerable boolean, query_language string, section string")
    lanes = {size: [(r.case_id, r.lane) for r in suites.generation_sample(cases, size).collect()] for size in (10, 90, 500)}
    refused = {i for i in range(120) if i % 3 == 0}
    for size, got in lanes.items():
        assert {i for i, lane in got if lane == 0} == refused and len({i for i, _ in got}) == len(got)
        assert sum(lane == 1 for _, lane in got) == 40  # four of ten strata
        assert len(got) == max(80, min(size, 120))
