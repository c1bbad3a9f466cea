"""Tables for the tests of the corpus operators."""

import random

WORDS = "the of and a to in is was he for it with as his on be at by had not are but from or have an they which one you".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 9)) for _ in range(n))


def odd_texts():
    """Null, empty, blank, control and wide characters, one very long text."""
    rng = random.Random(5)
    return [None, "", " ", "\n\t \x0b", "▁", "é ü 日本 😀 á", "\x00\x01", "A", "A b", "a B c", "x" * 5000, prose(rng, 60_000), "<|endoftext|> x", "!?!"]


def docs(spark, rows):
    """doc_id and text, among columns whose names operators might use themselves."""
    extra = "key string, node int, words int, list int, n int, _key int, _gone long, _id long, _text string, toxicity string, copies int, n_chars long"
    return spark.createDataFrame(
        [(i, t, "k", 1, 2, 3, 4, 5, 6, 7, "t", "x", 8, len(t or "")) for i, t in rows], f"doc_id long, text string, {extra}"
    )
