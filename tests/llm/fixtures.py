"""A small documents table with every awkward case, and the given smallest tables."""

import random

from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


def rows():
    rng = random.Random(7)
    words = ["alpha", "Beta", "gamma,", "délta", "the", "of", "x1", "naïve", "Z", "end."]
    say = lambda n: " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(n))
    shared = say(60)
    out = [None, "", "   \n\t ", "word", "two words", "a  b c d \x1c e", "<|endoftext|> and <|startoftext|> inside", "\nlead and trail \n", "x" * 5000, "!!! ???", "日本語 テキスト", say(9000)]
    out += [say(200) + " " + shared + " " + say(100), say(50) + "\n" + shared, shared, shared + " " + shared]
    near = say(400).split()
    for i in range(6):
        copy = list(near)
        copy[50 * i] = "changed"
        out.append(" ".join(copy))
    out += [out[-1], "same same " * 60, "it's we'll 12345 don't", "tail  ", " head"]
    return [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(out)]


def frame(spark, extra=()):
    return spark.createDataFrame([*rows(), *extra], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(docs):
    """docs with further columns named like those the operators make."""
    from pyspark.sql import functions as F

    return docs.select("*", *[F.lit("clash").alias(c) for c in ("fp", "node", "block", "component_id", "n_words", "_group", "_key", "_version", "media", "token", "pos", "slot", "_slot", "shard", "score", "start", "word")])
