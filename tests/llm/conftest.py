"""Fixtures of the training-data operators: odd rows that every operator must take."""
import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that an operator might use for itself
    T.StructField("score", T.StringType()), T.StructField("tokens", T.StringType()), T.StructField("id", T.StringType())])

WORDS = {"en": "the of and river stone walks under quiet morning light over hill with a",
         "de": "der die und fluss stein geht unter stillem morgen licht auf berg mit ein",
         "fr": "le la et fleuve pierre marche sous calme matin lumière sur colline avec un",
         "es": "el los y río piedra camina bajo tranquila mañana luz sobre colina con una"}


def prose(rnd, lang, n):
    return " ".join(rnd.choice(WORDS[lang].split()) + str(rnd.randrange(40)) * (rnd.random() < 0.5) for _ in range(n))


def odd_rows():
    rnd = random.Random(3)
    texts = ["", None, " ", "\n\n", "one", "two words", "a b c d e", "a b c d e", "Zwei\tWörter\r\nzwei\tWörter",
             "x" * 5000, " " * 3000, "tail" + " " * 2000 + "end", "é" * 700 + " ", "\x00 \x1c\x85 nul", "<|endoftext|> plain"]
    rows = [(i, t, None, None, None, "s", "t", "i") for i, t in enumerate(texts)]
    long = prose(rnd, "en", 20000)
    rows += [(100, long, "en", "a", 1, None, None, None), (101, long, "en", "a", 1, None, None, None),
             (None, "a row without an id", None, "a", None, None, None, None),
             (6, "a b c d e", None, None, None, "s", "t", "i"),            # a repeated row
             (102, None, "en", None, None, None, None, None)]
    rows += [(200 + k, prose(rnd, lang, 60), lang, "b", 1, None, None, None)
             for k, lang in enumerate(["en", "de", "fr", "es"] * 15)]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3, "source")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def data_dir(spark, tmp_path_factory):
    """The generated tables of the smallest scale."""
    return "/root/testdata/sf0.001"
