"""Greedy tiles of items that repeat themselves, and of matches that overlap."""

from undertow.llm.tiling import contamination


def test_repeated_phrases_and_overlapping_matches(spark):
    phrase = "alpha beta gamma delta epsilon"
    nine = "one two three four five six seven eight nine"
    docs = [(1, f"intro {' '.join([phrase] * 8)} outro"), (2, "one two three four five and five six seven eight nine"), (3, f"only {phrase} once")]
    bench = spark.createDataFrame([(1, " ".join([phrase] * 8)), (2, nine)], "item_id long, text string")
    got = {r["doc_id"]: (r["item_id"], r["coverage"], r["contaminated"]) for r in contamination(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got[1] == (1, 1.0, True) and got[2] == (2, 1.0, True) and not got[3][2]
