import random

import pytest

#: Column names that operators use inside.
CLASHES = ["key", "run", "digest", "size", "n", "_g", "bucket", "node", "component", "shard", "text_crc32", "label", "score", "a", "b", "_key"]


def make(spark, rows):
    """(doc_id, text) rows as a table with other columns, some of clashing names."""
    extra = ", ".join(f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame([(i, t, None, "src", len(t or ""), *["x"] * len(CLASHES)) for i, t in rows], f"doc_id long, text string, lang string, source string, n_chars long, {extra}")


def awkward_rows():
    """Null, empty, blank, tiny, very long and repeated texts; ties; a null id; repeated rows."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    base, shared = prose(120), prose(40)
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one two"), (6, base), (7, base), (8, base.replace(" ", "\n ")), (9, base + " tail"), (10, base.upper())]
    rows += [(11, prose(30) + " " + shared + " " + prose(30)), (12, prose(25) + " " + shared + " " + prose(20)), (13, "a" * 70_000), (14, "ab" * 500), (15, prose(20_000)), (16, "naïve Ünïcode – 文字 " * 20), (17, "one two")]
    rows += [(18, " ".join(w if k != 50 else "changed" for k, w in enumerate(base.split()))), (19, "\x00\x01 odd \x7f bytes"), (20, "  one two  ")]
    return rows


@pytest.fixture(scope="session")
def awkward(spark):
    return make(spark, awkward_rows())


@pytest.fixture(scope="session")
def odd(spark):
    """The awkward rows with null ids and repeated rows as well."""
    rows = awkward_rows()
    return make(spark, [*rows, rows[5], rows[5], (None, rows[5][1]), (None, None), (None, "only here and nowhere else at all")])


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.limit(0)
