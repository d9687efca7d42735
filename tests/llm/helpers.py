"""Small tables with every awkward row."""

import random

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def documents(spark, rows, extra=True):
    """Rows (doc_id, text, source); with columns whose names the operators use inside."""
    df = spark.createDataFrame([(i, t, "en", s, len(t) if t is not None else None) for i, t, s in rows], DOC)
    if extra:
        df = df.selectExpr("*", "1 AS key", "2 AS size", "'x' AS h", "3 AS shard", "4 AS score", "5 AS bucket", "6 AS row",
                           "7 AS th", "8 AS class", "9 AS position", "0 AS y", "1 AS rank")
    return df


def awkward(seed=1, n=60):
    rng = random.Random(seed)
    rows = [(i, sentence(rng, rng.randint(1, 80)), f"s{i % 3}") for i in range(n)]
    long = sentence(rng, 9000)
    return rows + [(1000, None, "s0"), (1001, "", "s1"), (None, "a null id", "s0"), (1002, "no source here", None),
                   (1003, long, "s2"), (1004, "same row twice over and over", "s1"), (1004, "same row twice over and over", "s1"),
                   (1005, " \n\t ", None), (1006, "!!! ...", "s0")]
