"""Steps of worked solutions at their edges."""

from pyspark.sql import functions as F

from tessera.functions import texts


def test_steps_keep_their_digits(spark):
    """The step at place k lost k's digits at its ends, and kept its spaces."""
    solution = "0 is where we begin here0\n123456789  is the sum of 1　\n 2 short\n222 is the last of them 2 "
    rows = spark.createDataFrame([(solution,), ("0 a.\n1 b1. 2\x0b2.\x0bno end",)], "text string")
    lines, sentences = (r["s"] for r in rows.select(texts.math_steps(F.col("text")).alias("s")).collect())
    assert lines == ["0 is where we begin here0", "123456789  is the sum of 1", "222 is the last of them 2"]
    assert sentences == ["0 a", "1 b1", "2\x0b2.\x0bno end"]
    kept = rows.select(texts.steps(F.col("text")).alias("s")).first()["s"]
    assert kept == [*lines[:2], "2 short", lines[2]]


def test_first_step_with_a_number(spark):
    rows = spark.createDataFrame([("Alone it stands.\n1232810148878564 is told",)], "text string")
    assert rows.select(texts.first_step_with(texts.math_steps(F.col("text")), F.lit("1232810148878564")).alias("n")).first()["n"] == 2
