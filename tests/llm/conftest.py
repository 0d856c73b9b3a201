import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block string, row long, size long, term string"


def invented(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(["ka", "to", "mi", "ren", "sol", "u"]) for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Odd rows: nulls, empties, repeats, copies, near copies, shared passages, a very long text."""
    base, passage = invented(1, 60), invented(2, 30)
    near = base.split()
    near[7] = "changed"
    texts = [base, base, " ".join(near), None, "", "  \t\n ", "one", "two words", passage + " " + invented(3, 20), invented(4, 25) + "\n" + passage,
             base.upper(), invented(5, 5000), "Mail a.b@mail.example.com or +1 (456) 555-2186 now", "see 10.0.0.1 and 999.1.1.1, card 4111 1111 1111 1111",
             "Released under the MIT License. x", "12345 678", "çé è " + invented(6, 12), passage]
    out = [(i, t, "en" if i % 2 else "fr", f"s{i % 3}", len(t or ""), "b", 1, 2, "t") for i, t in enumerate(texts)]
    out.append(out[0])  # a repeated row
    out.append((None, base, None, None, None, None, None, None, None))
    out.append((None, None, None, None, None, None, None, None, None))
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
