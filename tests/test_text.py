import re

import pytest
from hypothesis import given
from hypothesis import settings as hypothesis_settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkrag.functions import text as T


def one(spark, texts, column):
    df = spark.createDataFrame(list(enumerate(texts)), "i long, x string")
    return [r["y"] for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


@pytest.mark.parametrize(("marked", "plain"), [
    ("# Head\n\nSome *bold* and __strong__ words", "Head Some bold and strong words"),
    ("- one\n- two\n* three\n12. four\n3) five", "one two three four five"),
    ("| a | b |\n|---|:-:|\n| 1 | 2 |", "a b 1 2"),
    ("before <!-- gone\nstill --> after", "before after"),
    (r"5 \* 6 \< 7 and snake_case_name", "5 * 6 < 7 and snake_case_name"),
    (r"a \# no heading, \_not emphasis\_", "a # no heading, _not emphasis_"),
    ("Contents ........ 12\n---\nend", "Contents 12 end"),
    ("", ""), ("no marks at all", "no marks at all"),
])
def test_strip_markdown(spark, marked, plain):
    assert one(spark, [marked, None], T.strip_markdown) == [plain, None]


def test_strip_markdown_keeps_private_characters(spark):
    icons = "".join(chr(0xE000 + i) for i in (0, 1, 5, 19, 20, 21, 22, 30)) + chr(0xE100) + chr(0xE014) + chr(0xE101) + chr(0xE015) + chr(0xE105)
    assert one(spark, [f"# **{icons}** \\*x\\* {icons[::-1]} | _y_"], T.strip_markdown) == [f"{icons} *x* {icons[::-1]} y"]


@hypothesis_settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.from_regex(r"[a-z]{1,7}", fullmatch=True), min_size=1, max_size=8), min_size=1, max_size=5))
def test_decoration_leaves_the_words(spark, paragraphs):
    marked = "\n\n".join(("## " if i % 3 == 0 else "- " if i % 3 == 1 else "") + " ".join(f"**{w}**" if j % 2 else w for j, w in enumerate(p)) for i, p in enumerate(paragraphs))
    assert one(spark, [marked], T.strip_markdown) == [" ".join(w for p in paragraphs for w in p)]


def plain_snippets(text, size=8, step=4):
    out = []
    for sentence in re.split(r"(?<=[.!?])\s+|\n+", text):
        w = re.findall(r"\w+", sentence.lower())
        if not w:
            continue
        starts = [0] if len(w) <= size else [*range(0, len(w) - size + 1, step), len(w) - size]
        out += [" ".join(w[s:s + size]) for s in starts]
    return list(dict.fromkeys(out))


def test_snippets_equal_plain_ones(spark):
    texts = ["One two. Three four five!\nsix", "", "... ?!", " ".join(f"w{i}" for i in range(23)) + ". Short one. Short one.", " ".join(f"v{i}" for i in range(8)), " ".join(f"v{i}" for i in range(9))]
    texts += [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text is not null").select("text").limit(60).collect()]
    assert one(spark, texts, T.snippets) == [plain_snippets(t) for t in texts]


def test_highlight(spark):
    terms = ["art", "artist", "c++", ""]
    got = one(spark, ["Artists make art; smart part", "C++ c", "é-art", None], lambda c: T.highlight(c, terms))
    assert got == ["<mark>Artist</mark>s make <mark>art</mark>; smart part", "<mark>C++</mark> c", "é-<mark>art</mark>", None]
    assert one(spark, ["as it is"], lambda c: T.highlight(c, [])) == ["as it is"]


def test_keys_and_headers(spark):
    assert [tuple(r) for r in one(spark, ["a::2024-01-01", "a::b::2024-01-01..2024-01-03", "none"], T.key_parts)] == [("a", "2024-01-01"), ("a::b", "2024-01-01..2024-01-03"), ("none", None)]
    assert one(spark, ["# Room (x) (2024-01-01)\nParticipants: a", "plain"], T.thread_header) == ["Room (x)", None]
