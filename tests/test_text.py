import re
import string

from pyspark.sql import functions as F

from passages.functions import text as tx

SAMPLES = [
    "",
    "   ",
    "Hello, World! foo?bar",
    "naïve café ÉCOLE 12x",
    "see a.html and fooBar, x_y-z#w end. Next",
    "a.b.c!d ,e",
    "HTTPServer2Go myURLValue",
    "tab\tand\nnew\r\nline nbsp em",
    "emoji 😀😀 done.",
    "straße Straße ΑΒΓ. жук!да",
    "a .html b.htmlc",
    "under_score __x__",
]


def run(spark, column):
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(SAMPLES)], "i int, s string")
    return [r.v for r in rows.select("i", column.alias("v")).orderBy("i").collect()]


def test_document_tokens(spark):
    plain = [
        "".join(c if c.isascii() and c.isalnum() else " " for c in s).lower().split() for s in SAMPLES
    ]
    assert run(spark, tx.document_tokens(F.col("s"))) == plain


def test_query_tokens(spark):
    assert run(spark, tx.query_tokens(F.col("s"))) == [s.lower().split() for s in SAMPLES]
    assert run(spark, tx.query_tokens(F.col("s"), True)) == run(spark, tx.document_tokens(F.col("s")))


def spaced(text):
    out = ""
    for before, c, after in zip(" " + text, text, text[1:] + "x"):
        tight = (before.isalnum() or before == "_") and not after.isspace()
        out += " " + c if c in "?.,!" and tight else c
    return out


def dropped(text):
    blanks = text.translate({ord(c): " " for c in "_-#"})
    return "".join(blanks.split(".html")).translate({ord("."): " "})


def camel(text):
    out = ""
    for before, c in zip(" " + text, text):
        hump = c in string.ascii_uppercase and before in string.ascii_lowercase + string.digits
        out += " " + c if hump else c
    return " ".join(out.split())


def test_clean_up_steps(spark):
    s = F.col("s")
    assert run(spark, tx.space_tight_punctuation(s)) == [spaced(x) for x in SAMPLES]
    assert run(spark, tx.drop_markup_characters(s)) == [dropped(x) for x in SAMPLES]
    assert run(spark, tx.split_camel_case(s)) == [camel(x) for x in SAMPLES]


def test_preprocess(spark):
    plain = [
        " ".join(re.findall(r"\w+|[^\w\s]", camel(dropped(spaced(x))).lower())) for x in SAMPLES
    ]
    assert run(spark, tx.preprocess(F.col("s"))) == plain


def test_strip(spark):
    assert run(spark, tx.strip(F.col("s"))) == [x.strip() for x in SAMPLES]


def test_tokens_join_to_a_prefix(spark):
    counts = run(spark, tx.token_count(F.col("s")))
    assert counts == [len(re.findall(r"[ \t\n\r]*(?:\w+|[^ \t\n\r\w])", x)) for x in SAMPLES]
    for limit in (0, 1, 3, 100):
        for text, cut, n in zip(SAMPLES, run(spark, tx.trim_tokens(F.col("s"), limit)), counts):
            assert text.startswith(cut)
            if limit >= n:
                assert cut == text.rstrip(" \t\n\r")
