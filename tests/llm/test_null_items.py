"""Benchmark items without an id."""

from strider.llm import decontam


def test_items_without_an_id_are_looked_for(spark):
    a, b, c = "the quick brown fox jumps over the lazy dog again", "seven grey geese went slowly down to the river bank", "nine old men sat in the sun and told many tales"
    bench = spark.createDataFrame([(1, a), (None, b), (None, c)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"so {b}"), (2, f"{a} then {c} and {b}"), (3, "clean words")], "doc_id long, text string")
    got = sorted((r.doc_id, r.item_id or 0, r.distance) for r in decontam.find_leaks(docs, bench).collect())
    assert got == [(1, 0, 0), (2, 0, 0), (2, 0, 0), (2, 1, 0)]
    assert {r.doc_id for r in docs.withColumn("leak", decontam.leaked(bench)).where("leak").collect()} == {1, 2}
