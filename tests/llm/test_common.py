from pyspark.sql import functions as F

from sanguine.llm.common import smallest


def test_smallest(spark):
    df = spark.range(5000).selectExpr("id doc_id")
    for most in (10, 700, 5000, 9000):
        want = [r.doc_id for r in df.orderBy(F.xxhash64("doc_id")).limit(most).collect()]
        assert [r.doc_id for r in smallest(df, ["doc_id"], most).collect()] == want
    assert smallest(df.limit(0), ["doc_id"], 3).collect() == []
