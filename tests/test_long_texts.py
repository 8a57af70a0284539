"""Patterns on long runs of one sign, which must not be read again and again, and as plain patterns read them."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from vellumite.functions import patterns as P
from vellumite.functions import payloads as Y
from vellumite.functions import text as X

RUNS = [" ", "\n", "a", "-", "#", "$", "|", "`", "0", ".", "(", "\\", "!", "*", "a-", "a-\n", "\n ", " -", "#a", "# ", "|a", "1.", "- ", "\t\n", "a ", "中 ", "\u00a0"]
FUNCTIONS = [X.dehyphenate, X.heading_spacing, X.list_spacing, X.collapse_blank_lines, X.join_lines, X.squeeze, X.js_trim, X.chinese_spacing, X.normalize_newlines, X.escape_pattern, X.sanitize_output, X.image_to_html, Y.heading_gap]
#: The same steps as anyone would write them, for a reader that tries every start.
PLAIN = {
    X.dehyphenate: [(rf"([A-Za-z0-9_]+)-{P.S}*\n{P.S}*([A-Za-z0-9_]+)", r"\1\2")],
    X.list_spacing: [(rf"(?m)^({P.S}*[-*+])({P.NS})", r"\1 \2"), (rf"(?m)^({P.S}*[0-9]+[.)])({P.NS})", r"\1 \2")],
    Y.heading_gap: [(rf"([^\n]){P.S}*(#{{1,6}}{P.S})", "\\1\n\n\\2")],
}


@pytest.mark.parametrize("function", FUNCTIONS, ids=lambda f: f.__name__)
def test_a_million_characters(spark, function):
    texts = [(before + r * (1_000_000 // len(r)) + after,) for r in RUNS for before, after in (("", ""), ("x", "y"))]
    df = spark.createDataFrame(texts, "text string").repartition(4)
    began = time.time()
    try:
        out = function(F.col("text"))
    except TypeError:
        pytest.skip("takes more than a text")
    df.select(F.length(out).alias("n")).write.format("noop").mode("overwrite").save()
    assert time.time() - began < 30


@pytest.mark.parametrize("function", PLAIN, ids=lambda f: f.__name__)
def test_as_the_plain_pattern(spark, function):
    rng = random.Random(9)
    texts = ["".join(rng.choice("ab1-*.) \n\n\t\u00a0##\r") for _ in range(rng.randrange(16))) for _ in range(6000)]
    out = [r.x for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", function(F.col("t")).alias("x")).orderBy("k").collect()]
    for text, mine in zip(texts, out, strict=True):
        for pattern, put in PLAIN[function]:
            text = re.sub(pattern, put, text)
        if "\r" not in text or function is not X.list_spacing:  # a line of Python's begins behind \n alone
            assert mine == text
