import random
import time

import pytest

from sparkrag.functions.edits import edit_distance
from sparkrag.operators import evaluate


def check(spark, facts, texts):
    f, t = spark.createDataFrame(facts, "query_id long, fact string").repartition(3), spark.createDataFrame(texts, "id long, content string").repartition(3)
    want = {(q, i) for q, x in facts for i, y in texts if x is not None and y is not None and x.lower() in y.lower()}
    got = [(r["query_id"], r["id"]) for r in evaluate.containing(f, t).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    return want


def test_facts_are_found_whatever_their_length(spark):
    facts = [(1, "a b c"), (2, "OO bar ba"), (3, "..!"), (4, ""), (5, None), (6, "none such"), (1, "a b c"), (7, "xfoo bar baz"), (8, "\U0001f600"), (9, "é")]
    texts = [(10, "xa b cd"), (11, "xfoo bar baz"), (12, "well..! A B C"), (13, None), (14, ""), (15, "café \U0001f600!")]
    check(spark, facts, texts)
    check(spark, facts[:3], texts)
    assert evaluate.containing(spark.createDataFrame([], "query_id long, fact string"), spark.createDataFrame(texts, "id long, content string")).collect() == []


def test_facts_inside_words_equal_brute_force(spark):
    r = random.Random(1)
    texts = [(i, " ".join("".join(r.choice("abAB") for _ in range(r.randint(1, 9))) for _ in range(r.randint(0, 60)))) for i in range(150)]
    facts = []
    for q in range(400):
        text = r.choice(texts)[1] or "ab"
        lo = r.randrange(len(text))
        fact = text[lo:lo + r.choice([1, 2, 3, 5, 6, 7, 8, 20, 30, 31, 32, 80])]
        facts.append((q, fact if r.random() < 0.8 else fact + r.choice("ab")))
    facts += [(1000 + q, facts[0][1]) for q in range(300)]  # a fact that many queries ask
    assert len(check(spark, facts, texts)) > 5000


def test_many_facts_take_one_pass(spark):
    n = 20000
    facts = spark.range(n).selectExpr("id as query_id", "concat('the fact of number ', sha2(string(id), 256)) as fact")
    texts = spark.range(400).selectExpr("id", "concat('before ', array_join(transform(sequence(0, 9), i -> concat('THE fact of number ', sha2(string(id * 10 + i), 256), ' x')), ' and '), ' after') as content")
    got = {(r["query_id"], r["id"]) for r in evaluate.containing(facts, texts).collect()}
    assert got == {(i, i // 10) for i in range(4000)}


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_distance_equals_the_table():
    r = random.Random(2)
    for _ in range(600):
        a, b = ([r.choice("abcé")[:1] for _ in range(r.randint(0, 90))] for _ in range(2))
        if r.random() < 0.5:
            b = [x for x in a if r.random() < 0.9]
        assert edit_distance(a, b) == plain_distance(a, b)
    for n in (300, 700):  # long enough for bands, with few and with many edits
        for share in (0.005, 0.05, 0.3, 0.9):
            a = [r.choice("abcdefgh") for _ in range(n)]
            b = [x if r.random() > share else r.choice("abcdefgh") for x in a if r.random() > share / 3] + ["z"] * r.randint(0, 9)
            assert edit_distance(a, b) == edit_distance(b, a) == plain_distance(a, b)


def test_error_rates_of_long_texts(spark):
    """More different words than characters have codes: known edits are counted, in seconds."""
    words = [f"word{i}" for i in range(50000)]
    hyp = [w for i, w in enumerate(words) if i % 100] + ["more"] * 7
    rows = [(1, " ".join(words), " ".join(hyp)), (2, "a b c", "a x c d"), (3, "", "some words"), (4, None, "x"), (5, "Same, text!", "same text")]
    began = time.time()
    got = {r["k"]: r for r in evaluate.error_rates(spark.createDataFrame(rows, "k long, truth string, hyp string")).collect()}
    assert time.time() - began < 60
    assert (got[1]["word_edits"], got[1]["words"]) == (507, 50000) and got[1]["wer"] == pytest.approx(507 / 50000)
    assert (got[2]["word_edits"], got[2]["words"], got[2]["char_edits"], got[2]["chars"]) == (2, 3, 3, 5)
    assert (got[3]["word_edits"], got[3]["words"], got[3]["cer"], got[3]["wer"]) == (2, 0, None, None)
    assert got[4]["word_edits"] is None and got[5]["char_edits"] == 0
