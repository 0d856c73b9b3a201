import random
import re

from sparkrag.llm import licenses


def test_base_equals_brute_force(docs, rows):
    got = licenses.scan(docs).collect()
    assert len(got) == len(rows)
    texts = {r[0]: r[1] for r in rows if r[0] is not None}
    for r in got:
        if r["doc_id"] is None:
            continue
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in texts[r["doc_id"]] or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        at = [(i, b) for p, b in licenses.BASE.items() for i in range(len(words)) if words[i:i + len(p.split())] == p.split()]
        assert (r["n_words"], r["n_base"]) == (len(words), len(at))
        assert (r["first_word"], r["last_word"]) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert r["base_labels"] == sorted({b for _, b in at}) and set(r["base_labels"]) <= set(r["labels"])
        assert 0 <= r["score"] <= 1


def test_each_template_is_found_in_prose_and_not_without_its_phrases(spark):
    prose = "ka to mi ren sol software distributed works in compliance with the terms "
    rows = [(i, prose * 3 + re.sub(" ", "\n", text, count=1).upper() + " " + prose) for i, (_, _, text) in enumerate(licenses.TEMPLATES)]
    rows.append((99, prose * 10 + "provided that the above copyright notice and this permission notice appear"))
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (label, _, _) in enumerate(licenses.TEMPLATES):
        assert label in got[i], (i, label, got[i])
    assert got[99] == []


def test_every_template_of_a_file_with_several_is_found(spark):
    short, long = licenses.TEMPLATES[0][2], licenses.TEMPLATES[3][2]
    prose = " ka to mi ren sol " * 20
    rows = [(0, long + prose + short), (1, short + prose + long), (2, prose.join(text for _, _, text in licenses.TEMPLATES))]
    rows += [(10 + i, f"{prose} {short} {i}") for i in range(40)]
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {"apache-2.0", "mit"} <= set(got[0]) and {"apache-2.0", "mit"} <= set(got[1])
    assert {label for label, _, _ in licenses.TEMPLATES} <= set(got[2])


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())


def starts(words, phrase):
    p = phrase.split()
    return [i for i in range(len(words)) if words[i:i + len(p)] == p]


def plain_labels(text, slack=16):
    """Labels of templates all whose mandatory phrases stand in one window, and the largest share of their words there."""
    own = split(text)
    labels, share = {b for p, b in licenses.BASE.items() if starts(own, p)}, 0.0
    for label, keys, template in licenses.TEMPLATES:
        t = template.split()
        begins = [[i - starts(t, k)[0] for i in starts(own, k)] for k in keys]
        for window in {b // slack + d for some in begins for b in some for d in (0, 1)}:
            inside = [[b for b in some if window in (b // slack, b // slack + 1)] for some in begins]
            if all(inside):
                labels.add(label)
                at = max(0, min(map(min, inside)) - slack)
                rare = set(t) - set(licenses.COMMON)
                share = max(share, len(rare & set(own[at:at + len(t) + 3 * slack])) / len(rare))
    return sorted(labels), share


def edited(rng, text, least=0):
    w = text.split()
    for _ in range(rng.randint(least, max(least, len(w) // 3))):  # a licence text that somebody has edited
        j = rng.randrange(len(w))
        w[j:j + 1] = rng.choice([[], ["ka"], [w[j], "to"]])
        w = w or ["ka"]
    return " ".join(w)


def test_labels_equal_plain_ones(spark):
    rng, texts = random.Random(4), []
    for _ in range(80):
        parts = [edited(rng, rng.choice(licenses.TEMPLATES)[2]) for _ in range(rng.randint(0, 3))]
        filler = " ".join(rng.choice(["ka", "to", "software", "merge", "license", "warranty", "mi"]) for _ in range(rng.randint(0, 60)))
        texts.append(f" {filler} ".join(["", *parts, ""]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in licenses.scan(df).collect()}
    for i, text in enumerate(texts):
        labels, share = plain_labels(text)
        assert got[i]["labels"] == labels, i
        assert abs(got[i]["score"] - (0.5 * bool(got[i]["base_labels"]) + 0.5 * share)) < 1e-9
    assert sum(bool(r["labels"]) for r in got.values()) > 30


def test_standing_phrases_give_their_label_whatever_other_documents_hold(spark):
    """Each template's mandatory phrases alone, at their distances, among nothing and among documents that make any word common or rare."""
    rng = random.Random(6)
    rows = []
    for i, (_, keys, text) in enumerate(licenses.TEMPLATES):
        w, keep = text.split(), set()
        for k in keys:
            at = starts(w, k)[0]
            keep |= set(range(at, at + len(k.split())))
        rows.append((i, " ".join(x if j in keep else "zz" for j, x in enumerate(w))))
    rows += [(100, "GNU Affero General Public License v3"), (101, "free software foundation either version 2 of the license"), (102, "// SPDX-License-Identifier: Apache-2.0\nint main() {}")]
    want = [licenses.TEMPLATES[i][0] for i in range(len(licenses.TEMPLATES))] + ["agpl-3.0", "gpl-2.0", "apache-2.0"]
    others = [(1000 + i, edited(rng, rng.choice(licenses.TEMPLATES)[2], 3)) for i in range(60)]
    words = sorted({w for _, _, t in licenses.TEMPLATES for w in t.split()})
    common = [(2000 + i, " ".join(rng.sample(words, 60))) for i in range(40)]
    for more in ([], others, common, others + common):
        got = {r["doc_id"]: r["labels"] for r in licenses.scan(spark.createDataFrame(rows + more, "doc_id long, text string")).collect()}
        for (i, text), label in zip(rows, want, strict=True):
            assert label in got[i], (i, text, label, got[i])


def test_no_rows(none):
    assert licenses.scan(none).collect() == []
