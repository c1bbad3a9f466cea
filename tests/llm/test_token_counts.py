import random

import public_tokenizers
from tests.llm.texts import docs, odd_texts, prose
from tokenizers import Tokenizer

from tidelog.llm import token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(spark, rows, **options):
    library = Tokenizer.from_file(PATH)
    got = sorted(tuple(r) for r in token_counts.count_tokens(docs(spark, rows), PATH, **options).collect())
    want = sorted((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    assert got == want


def test_odd_and_repeated_texts(spark):
    check(spark, list(enumerate(odd_texts())) + [(3, "a b"), (3, "a b")])


def test_random_texts_with_a_tiny_table_and_cache(spark):
    rng = random.Random(2)
    marks = ["'s", "'re", "'S", "  ", "\n\n", "\r\n", "\t", "12", "½", "٣", "é", "×", "÷", "ſ", " ", "\x0b", "\x1c", "\x85", "...", "<|endoftext|>", "ab", "日", "́", "_"]
    rows = [(i, "".join(rng.choice(marks) for _ in range(rng.randint(0, 30)))) for i in range(300)] + [(1000, prose(rng, 300))]
    check(spark, rows, entries=5, sample_rows=50, cache_entries=20)


def test_empty_table(spark):
    check(spark, [])
