import pytest

LONG = " ".join(f"w{i % 997}x{i % 31}" for i in range(30_000))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, one word, a very long text, ties, repeated rows, other scripts."""
    shared = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau"
    near = shared.replace("mu", "MU").split() * 6
    rows = [(1, shared), (2, shared), (3, None), (4, ""), (5, " \t\n"), (6, "one"), (7, "One"), (8, LONG), (9, LONG),
            (None, shared + " extra words here"), (10, "日本語 テキスト é è\nzweite Zeile. Satz zwei! Drei?"),
            (11, " ".join(near)), (12, " ".join([*near[:-1], "changed"])), (13, "x" * 400), (14, "ab" * 300 + "\n" + "x" * 150),
            (2, shared), (15, "<|endoftext|> special  spaces \n\n and  more "), (None, None), (16, "a b"), (16, "c d e")]
    return rows


def frame(spark, rows, extra=True):
    """(doc_id, text, source) with columns whose names clash with those that operators add."""
    docs = spark.createDataFrame([(i, t, None if k % 5 == 0 else f"s{k % 3}") for k, (i, t) in enumerate(rows)],
                                 "doc_id long, text string, source string")
    if extra:
        from pyspark.sql import functions as F

        for c in ("hits", "mix", "cut", "tokens", "quality", "toxicity", "_cut_id", "_near_id", "n_words", "key", "size",
                  "label", "id", "tid", "score"):
            docs = docs.withColumn(c, F.lit(7))
    return docs
