"""Exact identifiers anywhere in a body, and the order of the kept chunks."""

from evidquarry.operators import scans


def test_identifiers_are_found_anywhere_and_ordered_by_three_keys(spark):
    bodies = ["ends with E12.", "then E12: more", "see src3#9.", "an XE12 and e12/e12", "only E1 2", None, "nothing", "E12 E12 E12 E12"]
    rows = [(i, body, "title", "", f"R{i}", "A-1" if i == 6 else "a-7", "CURRENT" if i == 1 else "OLD") for i, body in enumerate(bodies)]
    chunks = spark.createDataFrame(rows, "chunk_id long, page_content string, title string, structure_path string, reference string, issue_key string, chunk_kind string")
    asked = spark.createDataFrame([(1, "E12"), (1, "R6"), (1, "a-1"), (2, "src3#9"), (2, "R4"), (3, "")], "query_id long, identifier string")
    got = scans.exact_identifier_lookup(chunks, asked, ["reference"], 4).collect()
    assert {(r.query_id, r.rn, r.chunk_id) for r in got} == {(1, 1, 6), (1, 2, 1), (1, 3, 7), (1, 4, 3), (2, 1, 2), (2, 2, 4)}
    plain = scans.exact_identifier_lookup(chunks.drop("issue_key", "chunk_kind"), asked, ["reference"], 12).where("query_id = 1").collect()
    assert [r.chunk_id for r in sorted(plain, key=lambda r: r.rn)] == [7, 3, 0, 1, 6]
