import random

import pytest

WORDS = "the of and lorem ipsum Ärger straße éclair naïve don't 42 x.y! foo, bar; BAZ".split()


def some_text(r, n):
    return "".join(r.choice(WORDS) + r.choice([" ", " ", " ", "\n", "  ", " \n", "\t"]) for _ in range(n))


@pytest.fixture(scope="session")
def messy():
    """Rows (doc_id, text): nulls, blanks, copies, near copies, repeated rows, a very long text, odd characters."""
    r = random.Random(4)
    base = " ".join(f"w{r.randint(0, 999)}" for _ in range(300))
    near = base.split()
    near[7] = "other"
    long = some_text(r, 30_000)
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, base), (5, base), (6, " ".join(near)), (7, base.upper()), (8, long), (9, "one"), (10, "one two"), (11, "ONE two"), (12, "﻿<|endoftext|> a b<|ENDOFTEXT|>\x1c\x85  c"), (13, "Café ﬁn  STRASSE"), (14, "café fin straße"), (15, "a\nb\na\nb\n" * 30), (16, "😀" * 500), (17, "z" * 5000), (None, "no id"), (None, None), (4, base), (20, "one two three four five six seven eight nine ten eleven")]
    return rows + [(100 + i, some_text(r, r.randint(0, 200))) for i in range(60)]


@pytest.fixture(scope="session")
def docs(spark, messy):
    """The same with columns that the operators use inside, and others."""
    rows = [(i, t, "en", f"s{n % 3}" if n % 11 else None, len(t or ""), 1, n, "x") for n, (i, t) in enumerate(messy)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node int, row long, _length string").repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
