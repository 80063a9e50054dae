import pytest

LONG = " ".join(f"word{i % 5000} and{i % 37}" for i in range(60_000))
PROSE = (
    "The harbour lay quiet under a low grey sky while three small boats came in with the tide and their crews"
    " sorted nets along the wall, talking about the price of herring, a cracked engine block, the new light on the"
    " point and whether rain would hold off until the school fair on Saturday afternoon near the old mill."
)
#: Nulls, empty and very long texts, ties and repeated rows, and columns named like the operators' own.
ODD_ROWS = [
    (1, PROSE),
    (2, PROSE),
    (2, PROSE),
    (3, None),
    (4, ""),
    (5, " \t\n\r\x0b\x0c "),
    (6, "two words"),
    (7, "TWO  words"),
    (8, LONG),
    (9, LONG + " tail"),
    (10, "x" * 300_000),
    (11, "日本語 テキスト 🤗 ñandú"),
    (None, PROSE),
    (None, None),
]
CLASHING = "id n_words kept digest key group length tokens shard bucket number copies label mark a b".split()


@pytest.fixture(scope="session")
def odd_docs(spark):
    rows = spark.createDataFrame(ODD_ROWS, "doc_id long, text string")
    return rows.selectExpr("*", *[f"'c' as `{name}`" for name in CLASHING]).repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
