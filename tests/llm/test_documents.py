from strandlake.llm import documents

EASY, HARD = "the cat saw my dog and a hen. ", "notwithstanding institutional considerations perpetuate multidimensional heterogeneity however. "


def test_levels_of_all_posts(spark, tmp_path):
    """Posts of any language and length are scored and profiled; only p9_found asks for English and 40 own words."""
    rows = [(i, (EASY if i % 2 else HARD) * 12, "en", "a") for i in range(20)]
    rows += [(20, HARD * 12, "de", "a"), (21, HARD * 12, None, "b"), (22, HARD, "en", "b"), (23, None, "en", "b"), (24, "> quoted", "fr", None)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 1 if i % 2 else 5) for i in range(20)], "doc_id bigint, rater_id bigint, read_level int").write.parquet(f"{tmp_path}/reading_labels.parquet")
    levels = {x["doc_id"]: x for x in documents.p9_levels(spark, str(tmp_path)).collect()}
    assert sorted(levels) == list(range(25))
    assert levels[20]["level"] >= 3.5 and levels[21]["level"] >= 3.5 and levels[22]["own_words"] == 7 and levels[22]["level"] is not None
    assert all(levels[i]["own_words"] == 0 and levels[i]["level"] is None for i in (23, 24))
    assert sorted(x["doc_id"] for x in documents.p9_found(spark, str(tmp_path)).collect()) == list(range(0, 20, 2))
    boards = {x["source"]: (x["n_posts"], x["n_levels"]) for x in documents.p9_boards(spark, str(tmp_path)).collect()}
    assert boards == {"a": (21, 21), "b": (3, 2), None: (1, 0)}
