"""Models read the rows that were made for them, not the tables again."""

from quaymark.plans import study_queries


def test_rows_of_models_are_made_once(spark):
    for part in study_queries._train_parts(spark, "/root/testdata/sf0.01"):
        files = part.inputFiles()
        assert files and not any("lineitem" in f for f in files)
        assert part.limit(1).count() == 1
