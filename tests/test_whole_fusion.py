"""Fusion lifts what both retrievers rank beyond the wanted number."""

import re

from pyspark.sql import functions as F

from lodestone.operators import accuracy, fusion


def test_a_row_beyond_ten_on_both_sides_is_lifted(spark):
    far = [(i, f"{'apple ' * 3}x{i}", [1.0, 0.0] if i >= 100 else [0.0, 1.0]) for i in [*range(12), *range(100, 112)]]
    rows = [(i, t if i < 100 else "nothing", v) for i, t, v in far] + [(50, "apple other words stand here", [0.9, 0.3])]
    d = spark.createDataFrame(rows, "id int, text string, embedding array<double>")
    asked = spark.createDataFrame([(1, "apple")], "qid int, text string")
    vector = spark.createDataFrame([(1, [1.0, 0.0])], "qid int, vector array<double>")
    got = fusion.hybrid(d.select("id", "text"), asked, d.select("id", "embedding"), vector, 10).collect()
    both = {r.id: r for r in got}
    assert len(got) == 10 and both[50].lexical_rank > 10 and both[50].dense_rank > 10 and both[50].signals == 2


def test_only_texts_of_candidates_are_shuffled(spark):
    """The join keeps texts in their tasks until a candidate's id has picked them, in however many blocks ids go."""
    texts = spark.range(200).select("id", F.concat(F.lit("text "), "id").alias("text")).unionByName(spark.sql("SELECT 7L id, 'again' text UNION ALL SELECT NULL, 'none'"))
    ids = spark.createDataFrame([(i,) for i in (3, 7, 150, 900)], "id long")
    for block in (1 << 17, 1):
        got = accuracy.named_rows(texts, ids, block)
        assert sorted((r.id, r.text) for r in got.collect()) == [(3, "text 3"), (7, "again"), (7, "text 7"), (150, "text 150")]
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and not re.search("SortMergeJoin|ShuffledHashJoin|Exchange hashpartitioning", plan)
