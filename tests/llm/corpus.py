"""Small documents with the cases that every operator must take."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SMALL = "/root/testdata/sf0.001"


def rows(texts, ids=None):
    return [(i, t, "en", "s", None if t is None else len(t)) for i, t in zip(ids or range(len(texts)), texts)]


EDGES = [
    None, "", " ", "\n\n", "a", "the cat sat on the mat", "the cat sat on the mat", "été déjà vu ½ ﬁ 日本語 🎉 x", "a  b   c\t d \n e ", "word " * 30_000,
    "x" * 50_000, "<|endoftext|> it's <|endoftext|>x", "\x00\x01 \x1c \x85", "password: hunter2hunter2", "K" * 3 + "ſ", "tail  ",
]


def documents(spark, texts=EDGES, ids=None):
    return spark.createDataFrame(rows(list(texts), ids), SCHEMA)


def edge_documents(spark):
    """The edge cases, with a null id and a repeated row."""
    r = rows(EDGES)
    return spark.createDataFrame([*r, (None, "the cat", None, None, None), r[5], r[5]], SCHEMA)


def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")
