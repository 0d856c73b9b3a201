import random
import re
import zlib
from collections import Counter

import pytest

from sparkrag.llm import queries, spelling


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def counted(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            n[run[:h % len(run)] + run[h % len(run) + 1:] if h % 97 == 0 else run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def edits(word, letters):
    for i in range(len(word) + 1):
        yield from (word[:i] + c + word[i:] for c in letters)
        if i < len(word):
            yield word[:i] + word[i + 1:]
            yield from (word[:i] + c + word[i + 1:] for c in letters)


def plain(n):
    letters, out = {c for w in n for c in w}, {}
    for w in n:
        near = {v for v in edits(w, letters) if v in n and v != w}
        best = min(near, key=lambda v: (-n[v], v), default=None)
        form = best if best and n[best] >= 2 * n[w] else None
        out[w] = [w, form, None, n[w], len(near), n[form] if form else None]
    for w, row in out.items():
        root = w
        while out[root][1]:
            root = out[root][1]
        row[2] = root
    return {tuple(r) for r in out.values()}


def result(df):
    got = [(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()]
    assert len(got) == len({r[0] for r in got})
    return set(got)


def test_index_equals_brute_force():
    r = random.Random(1)
    words = sorted({"".join(r.choice("abß") for _ in range(r.randint(1, 6))) for _ in range(400)})
    index = spelling.PositionIndex(words)
    for w in words[::3] + ["", "zzz", "abababab"]:
        assert sorted(words[i] for i in index.near(w)) == [v for v in words if one_apart(v, w)], w


@pytest.mark.parametrize("options", [{}, {"slice_words": 5, "task_words": 50}])
def test_equals_brute_force(spark, options):
    r = random.Random(2)
    rows = []
    for i in range(200):
        words = ["".join(r.choice("abé") for _ in range(r.randint(4, 8))) for _ in range(40)]
        rows.append((i, " ".join(w.upper() if r.random() < 0.1 else w for w in words * r.randint(1, 3))))
    df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, n int, word string, form int".replace("word string", "word int")).repartition(3)
    want = plain(counted(rows))
    assert any(len(w[0]) > 6 for w in want) and any(w[2] != w[1] and w[1] for w in want)
    assert result(spelling.group_variants(df, **options)) == want


def test_the_query_on_the_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(x) for x in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = plain(counted(rows))
    assert sum(w[1] is not None for w in want) > 100
    assert result(queries.op12_spelling(spark, sf)) == want


def test_odd_rows(spark):
    long = "é" * 3000 + "x" * 3000
    rows = [(1, None), (2, ""), (None, "Straße strasse STRAßE straße"), (None, f"{long} {long}y {long} {long[1:]}"), (5, f"{long}y {long} {long}y"), (6, "naïve naive naive naïve naïve naive naives"), (6, "naïve naive naive naïve naïve naive naives"),
            (7, "abcde\u0000abcde_abcde×abcde÷abcdf abcdf abcdf")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(spelling.group_variants(df)) == plain(counted(rows))
    assert spelling.group_variants(df.where("false")).collect() == []


def test_ties_go_to_the_smallest_word(spark):
    n = {"abcde": 3, "abcdez": 9, "abcd": 1, "abcdf": 9, "abcdé": 9, "aabcde": 9, "abcdea": 9}
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    got = {r["word"]: (r["n_near"], r["form_n"], r["form"]) for r in spelling.neighbours(df).collect()}
    assert got["abcde"] == (6, 9, "aabcde")
    for w in n:
        near = [v for v in n if one_apart(v, w)]
        assert got[w] == (len(near), *min(((-n[v], v) for v in near))[:0], max(n[v] for v in near), min(near, key=lambda v: (-n[v], v)))
