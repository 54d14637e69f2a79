from testweave.llm.common import filtered


def test_filter_keeps_every_key_and_drops_most_others(spark):
    rows = spark.range(5000).selectExpr("id as a", "id * 7 as b", "cast(id as string) as text")
    keys = rows.where("a % 10 = 0").select("a", "b")
    got = {r.a for r in filtered(rows, keys, ["a", "b"]).collect()}
    assert {i for i in range(5000) if i % 10 == 0} <= got and len(got) < 600
    assert filtered(rows, keys.limit(0), ["a", "b"]).count() == 0
    few = filtered(rows, keys, ["a", "b"], 1 << 15)
    assert few.columns == rows.columns and few.where("a % 10 = 0").count() == 500
