import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
DOC_TYPE = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n, seed):
    pick = random.Random(seed)
    return " ".join(pick.choice(WORDS) + str(pick.randint(0, 99)) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with every awkward case: nulls, empty and very long texts, copies, repeated rows."""
    out = [(i, prose(30 + i, i), "en", f"src{i % 3}", 10) for i in range(24)]
    base = out[5][1].split()
    out += [
        (100, None, "en", "a", None),
        (101, "", None, None, 0),
        (102, " \t\n ", "de", "a", 3),
        (103, out[5][1].replace(" ", "  \n"), "en", "a", 1),  # equal to 5 but for white space
        (104, " ".join(base[:-1] + ["changed"]), "en", "a", 1),  # nearly 5
        (105, out[5][1].upper(), None, "a", 1),
        (106, "one two", "en", "a", 1),
        (107, "ONE two", "en", "a", 1),
        (108, prose(6000, 77), "en", "a", 1),  # very long
        (109, "Grüße an Örtlichkeit ß £ 中文 don't we'll " + "x" * 3000, "de", "a", 1),
        (110, "token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" and mail a.b@mail7.example.com", "en", "a", 1),
        (110, "one id, another text", "en", "b", 2),
        (3, out[3][1], "en", "src0", 10),  # a repeated row
        (None, "no id here at all", "en", None, None),
    ]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOC_TYPE).repartition(3)


@pytest.fixture(scope="session")
def clashing(docs):
    """The same documents, with columns named like what the operators add."""
    from pyspark.sql import functions as F

    names = "keep_id kept row score held_out component component_id n_tokens block kind digest run size place start length"
    return docs.select(*[F.lit("x").alias(n) for n in names.split()], "text", "doc_id", "lang", "source", F.lit(1).alias("a.b"))


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOC_TYPE)
