import random

import numpy as np
import public_tokenizers
import sentencepiece as library
from tests.llm.texts import docs, odd_texts, prose

from tidelog.llm import sentencepiece

PATH = public_tokenizers.path("piece_bpe_32k.model")


def expected(texts):
    return [ids for ids in library.SentencePieceProcessor(model_file=PATH).encode(texts, num_threads=1)]


def test_odd_texts(spark):
    rows = list(enumerate(t for t in odd_texts() if t != "\x00\x01")) + [(2, "same"), (2, "same")]
    got = sorted((r["doc_id"], list(r["pieces"])) for r in sentencepiece.piece_arrays(docs(spark, rows), PATH).collect())
    assert got == sorted((i, ids) for (i, _), ids in zip(rows, expected([t or "" for _, t in rows])))
    back = sentencepiece.round_trip(docs(spark, rows), PATH).collect()
    assert sorted(r["round_trip"] for r in back) == sorted("▁" not in (t or "") for _, t in rows)


def test_random_strings_against_the_library():
    rng = random.Random(1)
    texts = ["".join(rng.choice("aaabcdeé ▁▁  \n日本́😀ßthe ing123...ﬁ") for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += [prose(rng, 200)]
    model = sentencepiece.Model(PATH)
    words = sorted({w for t in texts for w in sentencepiece.marked_words(t)})
    ids = dict(zip(words, model.encode_sorted(words)))
    processor = library.SentencePieceProcessor(model_file=PATH)
    for t, want in zip(texts, expected(texts)):
        got = np.frombuffer(b"".join(ids[w] for w in sentencepiece.marked_words(t)), "<i4")
        assert got.tolist() == want, t
        assert model.decode(got) == processor.decode(want)


def test_neighbours_that_stay_apart_by_definition():
    model = sentencepiece.Model(PATH)
    rng = random.Random(4)
    pieces = sorted(p for p in model.usable if p.isascii())
    for _ in range(4000):
        a, b = rng.choice(pieces), rng.choice(pieces)
        parts = list(a + b)
        while at := [(-model.scores[s], i) for i in range(len(parts) - 1) if (s := parts[i] + parts[i + 1]) in model.scores]:
            i = min(at)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert model.fits(a, b) == (parts == [a, b]), (a, b)


def test_unigram_scores_take_the_best_sum():
    model = sentencepiece.Model(PATH)
    model.bpe = False
    rng = random.Random(6)
    model.scores = {p: -rng.random() * 10 for p in model.ids}
    model.usable = set(model.ids)
    model.grow_automaton()

    def best(word):
        top = [0.0] + [-1e9] * len(word)
        for end in range(1, len(word) + 1):
            for start in range(max(0, end - 16), end):
                if word[start:end] in model.scores:
                    top[end] = max(top[end], top[start] + model.scores[word[start:end]])
        return top[-1]

    names = {i: p for p, i in model.ids.items()}
    words = sorted({"▁" + "".join(rng.choice("theinga") for _ in range(rng.randint(0, 12))) for _ in range(200)})
    for word, ids in zip(words, model.encode_sorted(words)):
        assert abs(sum(model.scores[names[i]] for i in np.frombuffer(ids, "<i4")) - best(word)) < 1e-9


def test_empty_table(spark):
    assert sentencepiece.round_trip(docs(spark, []), PATH).collect() == []
    assert sentencepiece.piece_arrays(docs(spark, []), PATH).collect() == []
    encoded = sentencepiece.encode_documents(docs(spark, [(1, "a b"), (2, None)]), PATH)
    assert [r["decoded"] for r in sentencepiece.decode_documents(encoded, PATH).orderBy("doc_id").collect()] == ["a b", ""]
