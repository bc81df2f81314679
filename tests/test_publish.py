import pytest
from pyspark.sql import functions as F

from folioscope.sources import media

URL = "jdbc:derby:memory:publish;create=true"


def statement(spark, sql):
    connection = spark._jvm.java.sql.DriverManager.getConnection(URL)
    try:
        connection.createStatement().execute(sql)
    finally:
        connection.close()


def ids(spark, table="results"):
    return sorted(r.ID for r in media.jdbc_table(spark, URL, table).select(F.col("id").alias("ID")).collect())


def test_rows_come_all_together_once(spark):
    try:
        statement(spark, 'CREATE TABLE results ("id" BIGINT NOT NULL, "title" VARCHAR(20))')
    except Exception as e:  # noqa: BLE001
        pytest.skip(f"no database here: {str(e)[:80]}")
    rows = spark.range(100).select("id", F.lit("a").alias("title")).repartition(4)
    assert media.publish_table(rows, URL, "results", "r1") and ids(spark) == list(range(100))
    assert not media.publish_table(rows, URL, "results", "r1") and ids(spark) == list(range(100))  # the same run again

    # A job that dies while its tasks write: some have written, the table has nothing of it.
    dies = spark.range(200, 300).repartition(4).select("id", F.when(F.col("id") == 299, F.raise_error(F.lit("lost"))).otherwise("b").cast("string").alias("title"))
    with pytest.raises(Exception, match="lost"):
        media.publish_table(dies, URL, "results", "r2")
    assert ids(spark) == list(range(100))
    # One whose rows don't fit the table fails as a whole, and the run may be tried again.
    with pytest.raises(Exception):  # noqa: B017
        media.publish_table(spark.range(200, 300).select("id", F.when(F.col("id") == 250, F.repeat(F.lit("x"), 50)).otherwise("b").alias("title")), URL, "results", "r2")
    assert ids(spark) == list(range(100))
    assert media.publish_table(spark.range(200, 210).select("id", F.lit(None).cast("string").alias("title")), URL, "results", "r2")
    assert ids(spark) == [*range(100), *range(200, 210)]
    assert media.publish_table(rows.limit(0), URL, "results", "r3") and len(ids(spark)) == 110
    with pytest.raises(ValueError):
        media.publish_table(rows, URL, "results", "r'4")
