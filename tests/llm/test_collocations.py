import random
from collections import Counter

import pytest
from tests.llm.texts import odd_texts

from tidelog.llm import collocations


def corpus(spark, rows):
    return spark.createDataFrame([(i, t, g, 1, "a", "w", 2, "x") for i, (t, g) in enumerate(rows)], "doc_id long, text string, lang string, c int, phrase string, w1 string, f int, part string")


def pieces(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for piece in "".join("\n" if c in ".,;:!?\n\x0b\x0c\r" else " " if c == "\t" else c for c in low).split("\n"):
        yield [w for w in piece.split(" ") if w]


def counted(rows):
    found, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for words in pieces(text):
            total[lang] += len(words)
            for k in range(1, 6):
                found.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    return found, total


def by_hand(rows, least, top):
    found, total = counted(rows)
    scored = {}
    for (lang, w), a in found.items():
        if len(w) > 1 and a >= least:
            cuts = [(1000 * a * total[lang] // (found[lang, w[:k]] * found[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            scored[lang, w] = (a, found[lang, w[:k]], found[lang, w[k:]], total[lang], score)
    out = []
    for lang in total:
        mine = []
        for (g, w), v in scored.items():
            if g == lang and not any(h == lang and len(x) > len(w) and b[0] >= v[0] and any(x[i : i + len(w)] == w for i in range(len(x))) for (h, x), b in scored.items()):
                mine.append((" ".join(w), v))
        mine.sort(key=lambda m: (-m[1][4], -m[1][0], m[0].encode()))
        out += [(lang, rank, p, *v) for rank, (p, v) in enumerate(mine[:top], 1)]
    return sorted(out)


def texts(seed, n=120):
    rng = random.Random(seed)
    vocabulary = [f"{c}{i}" for c in ("é", "w", "Z", "日") for i in range(12)]
    fixed = ["new york city hall", "a a a", "on the other hand", "one two three four five six"]
    rows = []
    for _ in range(n):
        words = []
        for _ in range(rng.randint(0, 60)):
            words.append(rng.choice(fixed) if rng.random() < 0.25 else rng.choice(vocabulary))
            words.append(rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", " ; ", "\x0b"]))
        rows.append(("".join(words), rng.choice(["en", "en", "de", None, "und"])))
    return rows + [(t, "en") for t in odd_texts()[:-4]] + [("x y " * 300, "zz"), (None, None), ("lonely", "q")]


def run(spark, rows, **options):
    found = collocations.mine_collocations(corpus(spark, rows), **options)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, found.collect()))


@pytest.mark.parametrize("seed, least, top, bits", [(1, 5, 2000, 24), (2, 3, 7, 10), (3, 12, 40, 8)])
def test_against_counting_every_phrase(spark, seed, least, top, bits):
    rows = texts(seed)
    got = run(spark, rows, least=least, top=top, bits=bits)
    assert got == by_hand(rows, least, top) and got


def test_all_counts_of_frequent_phrases(spark):
    rows = texts(4)
    found, total = counted(rows)
    got = {(r["lang"], r["phrase"]): r["f"] for r in collocations.phrase_counts(corpus(spark, rows), 6).collect()}
    want = {(g, " ".join(w)): n for (g, w), n in found.items() if n >= 6} | {(g, None): n for g, n in total.items() if n}
    assert got == want


def test_empty_tables(spark):
    assert run(spark, []) == [] and run(spark, [(None, None), ("", "en"), (" \n", "en"), ("a b", "en")]) == []


def test_one_pair_everywhere_and_a_long_text(spark):
    rows = [("the end " * 40 + f"x{i}", "en") for i in range(200)] + [("p q r s t u v " * 3000, "de")]
    assert run(spark, rows) == by_hand(rows, 100, 2000)


def test_stretches_lose_no_window(monkeypatch):
    rng = random.Random(9)
    data = "".join(rng.choice(["ab", "c", "def"]) + rng.choice([" ", "  ", "\n"]) for _ in range(400)).encode()
    whole = collocations._Tokens(data, len(data))

    def windows(tokens):
        rows, times = tokens.windows(tokens.beginnings("en", [], 16))
        words = [*tokens.vocabulary.to_pylist(), None]
        return Counter({tuple(words[c] for c in r): int(n) for r, n in zip(rows, times)})

    want = windows(whole)
    for size in (1, 7, 50):
        monkeypatch.setattr(collocations, "STRETCH", size)
        assert sum((windows(collocations._Tokens(*s)) for s in collocations._stretches(data)), Counter()) == want


def test_scores_beyond_64_bits(spark):
    big = 4_000_000_000_000_000
    rows = [("en", 0, None, 2 * big), ("en", 1, "a", big), ("en", 1, "b", big - 1), ("en", 2, "a b", big - 7)]
    got = collocations.score_candidates(spark.createDataFrame(rows, "lang string, k int, phrase string, f long")).first()
    assert got["score"] == 1000 * (big - 7) * 2 * big // (big * (big - 1))
