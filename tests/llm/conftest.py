import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark, sf):
    """The small corpus and rows with nulls, empty, very long, tied and repeated texts."""
    long_text = " ".join(f"w{i % 997} mit License{i % 50}" for i in range(6000)) + " MIT  license"
    twenty = " ".join(f"tok{i}" for i in range(20))
    odd = [
        (100001, None, None, None, None),
        (100002, "", "en", "", 0),
        (None, "A null id. The Apache License!", None, "s", 1),
        (100003, " \n\t ", "en", None, 3),
        (100004, long_text, "en", "z", 5),
        (100005, "MIT license, mit-license GNU General Public\nLicense v3", "en", "z", 5),
        (100006, "one two", None, "z", 5),
        (100007, "ONE two", None, "z", 5),
        (100008, twenty, None, "z", 5),
        (100008, twenty, None, "z", 5),
        (100009, twenty + " extra", None, "é", 5),
        (100010, "x y z " * 40, None, "é", 5),
        (100011, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", None, "é", 5),
    ]
    return spark.read.parquet(f"{sf}/documents.parquet").unionByName(spark.createDataFrame(odd, SCHEMA)).cache()


@pytest.fixture(scope="session")
def rows(docs):
    return [r.asDict() for r in docs.collect()]


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(spark):
    """Columns with the names that the operators use."""
    return spark.createDataFrame([(1, "a b c d e f", "en", "s", 3, "x", 1, 2)], SCHEMA + ", words string, n int, shard int")
