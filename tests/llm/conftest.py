import pytest


@pytest.fixture(scope="session")
def profiles(spark, data):
    from docflow.llm import langid

    d = data.replace("sf0.001", "sf0.01")
    return langid.train(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/common_words.parquet"))
