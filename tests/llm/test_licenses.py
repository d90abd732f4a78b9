import textwrap

from pyspark.sql import functions as F

from passages.llm import licenses as li
from tests_llm_samples import frame


def found(df):
    return sorted((r.doc_id, r.part, r.license_id, r.n) for r in df.collect())


def test_spellings_of_one_licence(spark):
    mit = li.TEXTS["MIT"]
    rows = [
        (1, "Copyright (c) 2020 Some Body\n\n" + mit.upper().replace(",", " ,").replace("\n", "\r\n"), None, None, 0),
        (2, "prose here\nReleased under the MIT Licence!\nmore\nreleased under the mit license.", None, None, 0),
        (3, mit.replace("free of charge", "for money"), None, None, 0),
        (4, "MIT", None, None, 0),
        (5, "code, then\n\n" + li.TEXTS["Apache-2.0"].replace("\n\n", "\n") + "\n \nmore code", None, None, 0),
    ]
    got = found(li.scan(frame(spark, rows)))
    assert (1, "text", "MIT", 1) in got and (2, "line", "MIT", 2) in got and (5, "paragraph", "Apache-2.0", 1) in got
    assert not [g for g in got if g[0] == 3 and g[1] == "text"]


def test_odd_tables(spark):
    odd = [(1, None, None, None, 0), (2, "", None, None, 0), (3, "Copyright 2020 X\n...", None, None, 0), (4, "word " * 50_000, None, None, 0)]
    docs = frame(spark, odd).withColumn("digest", F.lit(1)).withColumn("unit", F.lit("x")).withColumn("license_id", F.lit("y"))
    assert found(li.scan(docs)) == [] and found(li.scan(frame(spark, []))) == []
    known = spark.createDataFrame([("b", "My own, licence"), ("a", "my OWN license"), ("c", None), ("d", "...")], "license_id string, text string")
    mine = frame(spark, [(7, "My own license", None, None, 0)])
    assert found(li.scan(mine, known)) == [(7, part, "a", 1) for part in ("line", "paragraph", "text")]
    assert found(li.scan(mine, known.limit(0))) == []


def test_large_tables_of_licences_are_joined_by_a_shuffle(spark, monkeypatch):
    docs = frame(spark, [(2, "x\nReleased under the MIT Licence", None, None, 0)])
    want = found(li.scan(docs))
    monkeypatch.setattr(li, "BROADCAST_LICENSES", 1)
    assert found(li.scan(docs)) == want == [(2, "line", "MIT", 1)]


def test_texts_at_every_width(spark):
    """A wrap puts COPYRIGHT HOLDERS at the head of a line, or not; both are one licence."""
    rows, want = [], []
    for name in ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause"):
        for width in (30, 45, 60, 72, 78, 79, 100, 119, 100_000):
            paragraphs = [textwrap.fill(" ".join(p.split()), width) for p in li.TEXTS[name].split("\n\n")]
            for text in (paragraphs, paragraphs[1:]):
                rows.append((len(rows), "Copyright (c) 2020 Some Body. All rights reserved.\n\n" + "\n\n".join(text), None, None, 0))
                want.append((len(rows) - 1, "text", name, 1))
    assert [g for g in found(li.scan(frame(spark, rows))) if g[1] == "text"] == want


def test_whole_texts_and_single_paragraphs(spark):
    rows = [(k, text, None, None, 0) for k, text in enumerate(li.whole_texts().values())]
    got = found(li.scan(frame(spark, rows)))
    assert [g[:3] for g in got if g[1] == "text"] == [(k, "text", name) for k, name in enumerate(li.whole_texts())]
    one = "int main;\n\n" + li.TEXTS["MIT"].split("\n\n")[3].replace("\n", " ") + "\n\nreturn"
    assert (1, "paragraph", "MIT", 1) in found(li.scan(frame(spark, [(1, one, None, None, 0)])))


def test_notices_and_lines_of_the_body(spark):
    notices = ["copyright (c) x", "(c) 2020 x", "© x", "# copyright: x", "copyright 1999, x", "copyright [yyyy] [name]",
               "copyright some body", "copyright the x authors", "copyright by x", "all rights reserved."]
    body = ["copyright holders be liable", "copyright notice, this", "copyright owner or", "(c) you must retain", "copyright", "copyright law"]
    lines = spark.createDataFrame([(x,) for x in notices + body], "line string")
    got = {r.line for r in lines.where(li.words_of(F.col("line")) != "").collect()}
    assert got == set(body)
