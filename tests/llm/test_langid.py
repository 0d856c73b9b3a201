import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkrag.llm import langid

from .conftest import invented


class Plain:
    """Interpolated Kneser-Ney with dictionaries."""

    def __init__(self, texts, letters):
        full = Counter(g for t in texts for g in self.grams(t))
        self.letters = letters
        self.counts = {4: full}
        for n in (3, 2, 1):
            self.counts[n] = Counter(g[1:] for g in self.counts[n + 1])
        self.total, self.kinds = defaultdict(int), defaultdict(int)
        for n in (1, 2, 3, 4):
            for g, c in self.counts[n].items():
                self.total[n, g[:-1]] += c
                self.kinds[n, g[:-1]] += 1

    @staticmethod
    def grams(text):
        s = ["_", "_", "_"]
        for c in text.lower():
            c = c if c.isalpha() else "_"
            if c != "_" or s[-1] != "_":
                s.append(c)
        return [tuple(s[i - 3:i + 1]) for i in range(3, len(s))]

    def p(self, gram):
        p = 1 / (len(self.letters) + 2)
        for n in (1, 2, 3, 4):
            g = gram[4 - n:]
            if self.total[n, g[:-1]]:
                p = (max(self.counts[n][g] - 0.75, 0) + 0.75 * self.kinds[n, g[:-1]] * p) / self.total[n, g[:-1]]
        return p


@pytest.fixture(scope="module")
def sample(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null")
    return [(r["lang"], r["text"][:6000]) for r in docs.where("doc_id % 9 = 0").select("lang", "text").collect()]


def test_equals_a_plain_model_and_sums_to_one_everywhere(sample):
    m = langid.CharModels(sample)
    for k, lang in enumerate(m.langs):
        texts = [t for x, t in sample if x == lang]
        plain = Plain(texts, {c for _, t in sample for c in t.lower() if c.isalpha()})
        number = {c: i + 2 for i, c in enumerate(m.alphabet)} | {"_": langid.GAP, "?": langid.OTHER}
        pack = lambda g: sum(number[c] << 16 * (3 - i) for i, c in enumerate(g))
        asked = list(dict.fromkeys(g for t in texts + ["zyx qqq", "çßñ ab"] for g in Plain.grams(t) if all(c in number for c in g)))
        got = np.exp(m.log_probs(np.array([pack(g) for g in asked], np.uint64))[:, k])
        assert np.allclose(got, [plain.p(g) for g in asked], rtol=1e-9)
        contexts = list(dict.fromkeys(g[:3] for g in asked))
        every = [number[c] for c in plain.letters] + [langid.GAP, langid.OTHER]
        codes = (np.array([pack(("_", *c)) for c in contexts], np.uint64)[:, None] << np.uint64(16)) | np.array(every, np.uint64)
        assert np.allclose(np.exp(m.log_probs(codes.reshape(-1))[:, k]).reshape(codes.shape).sum(1), 1)
        assert len(contexts) > 1000


def test_memory_of_the_scorer_changes_nothing(sample):
    m = langid.CharModels(sample[:60])
    texts = [t for _, t in sample] + ["", "12"]
    small, large = langid.Scorer(m, 6).entropies(texts), langid.Scorer(m).entropies(texts)
    assert np.allclose(small[0], large[0]) and (small[1] == large[1]).all() and small[1][-2:].tolist() == [0, 0]


def test_held_out_accuracy_and_rejection(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held", F.crc32(F.col("doc_id").cast("string")) % 4 == 2)
    models = langid.fit(docs.where("not held"))
    told = langid.identify(docs.where("held"), models).collect()
    assert sum(r["lang_pred"] == r["lang"] for r in told) / len(told) > 0.95
    assert sum(r["rejected"] for r in told) / len(told) < 0.01
    rng = random.Random(3)
    noise = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(600)) for _ in range(20)]
    noise += [" ".join("".join(chr(rng.randrange(0x3b1, 0x3c9)) for _ in range(6)) for _ in range(60)) for _ in range(20)]
    noise += ["".join(chr(rng.randrange(0x4e00, 0x9000)) for _ in range(200)), "xqzw jkv " * 80]
    odd = langid.identify(spark.createDataFrame([(t,) for t in noise], "text string"), models).collect()
    assert all(r["rejected"] for r in odd)


def test_languages_of_one_rare_script_are_told_apart(spark):
    rng = random.Random(5)
    latin = [("la", invented(i, 60)) for i in range(40)]
    script = lambda lo, hi: "".join(chr(rng.randrange(lo, hi)) for _ in range(80))
    rows = latin + [(k, script(lo, lo + 300)) for k, lo in (("one", 0x4e00), ("two", 0x5a00)) for _ in range(40)]
    models = langid.fit(spark.createDataFrame(rows, "lang string, text string"))
    asked = spark.createDataFrame([("one", script(0x4e00, 0x4e00 + 300)), ("two", script(0x5a00, 0x5a00 + 300))], "want string, text string")
    assert all(r["lang_pred"] == r["want"] for r in langid.identify(asked, models).collect())


def test_sample_is_bounded_and_copies_count_once(spark):
    rows = [("a", invented(i % 30, 40)) for i in range(400)] + [("b", invented(100 + i, 40)) for i in range(60)] + [("c", "б" * 5000)] * 9
    df = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    assert langid.fit(df, 20, 10**9).digest == langid.fit(df.repartition(2), 20, 10**9).digest
    assert langid.fit(df, 20, 100).langs == ["a", "b", "c"]


def test_odd_rows(docs, rows, none):
    models = langid.fit(docs)
    got = langid.identify(docs, models).collect()
    assert len(got) == len(rows)
    for r in got:
        letterless = not any(map(str.isalpha, r["text"] or ""))
        assert (r["lang_pred"] == "und") == letterless and 0 <= r["score"] <= 1
        assert r["rejected"] or not letterless
    assert langid.fit(none) is None
    assert langid.identify(none, models).collect() == []
    assert {r["lang_pred"] for r in langid.identify(docs, None).collect()} == {"und"}
    assert pytest.approx(0) == langid.identify(docs.where("text is null"), models).first()["score"]
    clash = docs.withColumn("Score", F.lit(7))
    assert langid.identify(clash, models, ("l", "s", "e", "r")).first()["Score"] == 7


def test_more_than_sixteen_languages_and_rare_labels(spark):
    """Scores do not change with the number of languages or the size of the table of looked-up n-grams."""
    r = random.Random(5)
    rows = []
    for k in range(20):
        syllables = ["".join(r.choice("abdeghiklmnoprstuvz") for _ in range(3)) for _ in range(6)]
        rows += [(f"l{k:02}", " ".join(r.choice(syllables) + r.choice(syllables) for _ in range(40))) for _ in range(8)]
    models = langid.CharModels(rows)
    texts = [t[:200] for _, t in rows[::7]] + ["", "xyzzy"]
    exact = langid.Scorer(models).entropies(texts)[0]
    assert np.array_equal(exact, langid.Scorer(models, bits=8).entropies(texts)[0]) and np.array_equal(exact, langid.Scorer(models, table_bytes=1).entropies(texts)[0])
    df = spark.createDataFrame(rows + [("rare", "only one text of this label")], "lang string, text string")
    assert langid.fit(df, most_langs=20).langs == sorted({k for k, _ in rows}) and "rare" in langid.fit(df).langs
