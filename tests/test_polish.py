"""Clean-up and formatting on small texts."""

import pytest
from pyspark.sql import functions as F

from folio.functions import polish as Z


def one(spark, made, *texts):
    df = spark.createDataFrame([texts], ", ".join(f"c{i} string" for i in range(len(texts))))
    return df.select(made(*[F.col(f"c{i}") for i in range(len(texts))]).alias("x")).first().x


@pytest.mark.parametrize(
    ("made", "text", "wanted"),
    [
        (Z.without_prompts, "<translation>Hi</translation>\n\n \n\nthere\nTranslation complete ok", "Hi\n\nthere"),
        (Z.consistent_marks, "「a」 ‘b’ c.. d……e --", "\"a\" 'b' c... d...e ——"),
        (Z.mixed_spacing, "汉a 1汉 version2.0 v2.0 汉% 汉 ，", "汉 a 1 汉 version 2.0 v2.0 汉 % 汉，"),
        (Z.without_repeats, " a a\nb  a ", "a b a"),
        (Z.proper_nouns, "脸书 x", "Facebook x"),
        (Z.shorter_chains, "a的b的c", "abc"),
        (Z.without_reasoning_anywhere, "<think>x\ny</think> a\n\n\n\nb [THINKING]q[/THINKING]", "a\n\nb"),
        (Z.has_reasoning, "x <THINK> y", True),
        (Z.has_reasoning, "plain", False),
        (Z.is_han_paragraph, "汉字a", True),
        (Z.hash31, "ab", 97 * 31 + 98),
        (Z.hash31, "", 0),
        (lambda c: Z.formatted(c), " a \r\nb\tc  \n\n", "a\nb    c\n"),
        (lambda c: Z.formatted(c), " \n ", ""),
        (lambda c: Z.formatted(c, 7), "aa bb cc dd\nlongerword x\n\n汉字汉字汉字汉字汉字", "aa bb\ncc dd\nlongerword\nx\n\n汉字汉字汉字汉\n字汉字\n"),
        (Z.xml_declaration, " <?xml version='1.0'?><a/>", "<?xml version='1.0'?>"),
    ],
)
def test_text(spark, made, text, wanted):
    assert one(spark, made, text) == wanted
    assert one(spark, made, None) in (None, "") or made in (Z.has_reasoning,)


def test_places_and_delays(spark):
    assert one(spark, Z.same_places, "abcd", "abXde") == 3 / 5
    assert one(spark, Z.same_places, "", "") == 1.0 and one(spark, Z.same_places, "", "a") == 0.0
    assert [r.x for r in spark.range(8).select(Z.delay(F.col("id"), 0.1, 2, 5).alias("x")).collect()] == pytest.approx([0.1, 0.2, 0.4, 0.8, 1.6, 3.2, 5, 5])
    assert spark.range(1).select(Z.percent(F.lit(1), F.lit(0)).alias("x")).first().x == 0
