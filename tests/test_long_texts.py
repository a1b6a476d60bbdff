"""Expressions stay linear in very long texts."""

import time

from pyspark.sql import functions as F

from folio.functions import polish as Z
from folio.functions import protect as P


def took(spark, made, text):
    df = spark.createDataFrame([(text,)], "text string").select(made(F.col("text")).alias("made"))
    df.collect()  # compiles
    began = time.time()
    out = df.first().made
    assert time.time() - began < 5
    return out


def test_long_texts(spark):
    words = "one two two three " * 5000
    assert took(spark, Z.without_repeats, words) == ("one two three " * 5000).strip()
    assert took(spark, Z.polished, words).startswith("one two three one")
    tags = "<b>x</b> &amp; " * 7000
    held = lambda c: P.protected(c, P.HTML)
    assert took(spark, lambda c: F.size(held(c)["kept"]), tags) == 7000
    assert took(spark, lambda c: P.restored(held(c)["text"], held(c)["kept"]), tags) == tags
    assert took(spark, lambda c: Z.same_places(c, F.concat(c, c)), "ab" * 20_000) == 0.5


def test_restored_keeps_unknown_marks(spark):
    df = spark.createDataFrame([("a @@PRESERVE_1@@ b @@PRESERVE_7@@", ["x", "y @@PRESERVE_0@@"])], "text string, kept array<string>")
    assert df.select(P.restored(F.col("text"), F.col("kept"))).first()[0] == "a y x b @@PRESERVE_7@@"
