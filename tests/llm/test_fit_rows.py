"""The rows that models are fitted on."""

from pyspark.sql import functions as F

from veritab.llm import toxicity


def test_labels_of_absent_documents_take_no_places(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(1000, 1040)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1040)], "doc_id long, toxic int")
    rows = toxicity.learning_rows(docs, labels, "toxic", 20)
    assert rows.count() == 20 and rows.where(F.col("y").isNull()).count() == 0
