from strandlake.llm.survivor import truth_discovery


def test_tells_whether_it_settled(spark):
    rows = [(g, s, "t" if s == "good" or g % 3 == 0 else f"w{s}{g % 2}") for g in range(12) for s in ("good", "x", "y")]
    df = spark.createDataFrame(rows, "g int, src string, a string")
    assert {x["settled"] for x in truth_discovery(df, ["g"], "src", ["a"], rounds=1).collect()} == {False}
    assert {x["settled"] for x in truth_discovery(df, ["g"], "src", ["a"]).collect()} == {True}
