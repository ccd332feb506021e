import re

import pytest
from pyspark.sql import functions as F

from labelfold.functions.text import clean_text, py_strip


def py_clean(text, lowercase=True, punctuation=False):
    """Python semantics of the cleaning step, for differential checks."""
    if text is None or text == "":
        return ""
    text = str(text).strip()
    if lowercase:
        text = text.lower()
    if punctuation:
        text = re.sub(r"[^\w\s]", "", text)
    return re.sub(r"\s+", " ", text).strip()


CASES = [
    ("iPhone 15 Pro Max", True, False, "iphone 15 pro max"),
    ("iPhone 15 Pro Max", False, False, "iPhone 15 Pro Max"),
    ("Product, with! punctuation?", False, True, "Product with punctuation"),
    ("Product   with    spaces", True, False, "product with spaces"),
    ("", True, False, ""),
    (None, True, False, ""),
]


@pytest.mark.parametrize("text,lower,punct,expected", CASES)
def test_reference_cases(spark, text, lower, punct, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(clean_text("t", lower, punct).alias("c")).first()["c"] == expected


UNICODE = ["  padded 　", "\x1c sep \x1f", "²½① x", "हिन्दी भाषा", "a‿b",
           "«Привет» №5", "İstanbul", "ΟΔΟΣ", "emoji 😀 ok!", "zero​width",
           "tab\tand\nnewline", "  mixed spaces here  "]


@pytest.mark.parametrize("punct", [False, True])
def test_unicode_matches_python(spark, punct):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(UNICODE)], "i int, t string")
    got = {r["i"]: r["c"] for r in df.select("i", clean_text("t", True, punct).alias("c")).collect()}
    for i, t in enumerate(UNICODE):
        assert got[i] == py_clean(t, True, punct), (t, got[i])


def test_strip_is_python_strip(spark):
    vals = [" x ", "\x1dy\x1e", "　 z  "]
    df = spark.createDataFrame([(v,) for v in vals], "t string")
    out = [r[0] for r in df.select(py_strip("t")).collect()]
    assert out == [v.strip() for v in vals]


def test_cleaning_stays_in_codegen(spark, products):
    plan = products.select(clean_text("product_title")).filter(F.lit(True))._jdf.queryExecution() \
        .executedPlan().toString()
    assert "PythonUDF" not in plan and "ArrowEvalPython" not in plan
