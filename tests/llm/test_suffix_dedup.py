import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from tests.llm.texts import docs, odd_texts

from tidelog.llm import suffix_dedup, suffixes


def in_order(text):
    return sorted(range(len(text)), key=lambda i: text[i:])


def shared(text, i, j):
    n = 0
    while max(i, j) + n < len(text) and text[i + n] == text[j + n]:
        n += 1
    return n


@pytest.mark.parametrize("letters", [1, 2, 3, 20])
def test_suffix_arrays_and_common_prefixes(letters):
    rng = random.Random(letters)
    for _ in range(60):
        base = [rng.randint(1, letters) for _ in range(rng.randint(3, 150))]
        text = base * rng.randint(1, 3) + [0]
        array, want = np.array(text), in_order(text)
        smaller = suffixes.classify(array)
        assert smaller.tolist() == [i == len(text) - 1 or text[i:] < text[i + 1 :] for i in range(len(text))]
        leftmost = [i for i in range(1, len(text)) if smaller[i] and not smaller[i - 1]]
        assert suffixes.induce(array, smaller, np.array([i for i in want if i in leftmost])).tolist() == want
        assert suffixes.doubled(array).tolist() == want
        prefixes = suffixes.permuted_common_prefixes(array, np.array(want))
        assert all(prefixes[i] == shared(text, i, j) for j, i in zip(want, want[1:])) and prefixes[want[0]] == 0


def test_recursion_agrees_with_doubling():
    rng = random.Random(5)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(40)]
    raw = " ".join(rng.choice(words) for _ in range(6000)).encode()
    text = np.append(np.frombuffer(raw, np.uint8).astype(np.int64) + 1, 0)
    assert (suffixes.suffix_array(text) == suffixes.doubled(text)).all()


def test_short_repeats_need_no_induction(monkeypatch):
    rng = random.Random(6)
    passages = [bytes(rng.choices(b"abcdefgh ", k=500)) for _ in range(20)]
    raw = b"".join(rng.choice(passages) + bytes(rng.choices(b"abc", k=rng.randint(1, 30))) for _ in range(60))
    text = np.append(np.frombuffer(raw, np.uint8).astype(np.int64) + 1, 0)
    want = suffixes.suffix_array(text).tolist()
    assert want == sorted(range(len(text)), key=lambda i: raw[i:])
    induced, calls = suffixes.induce, []
    monkeypatch.setattr(suffixes, "induce", lambda *a: calls.append(1) or induced(*a))
    assert suffixes.suffix_array(text).tolist() == want and not calls
    # Repeats beyond the limit take induced sorting.
    monkeypatch.setattr(suffixes, "LONG_REPEAT", 100)
    assert suffixes.suffix_array(text).tolist() == want and calls


def by_hand(rows, length):
    seen = Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[k : k + length] for k in range(len(b) - length + 1))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b) + 1)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), len(b) - len(kept), bytes(gone).count(b"\1\0"), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed):
    rng = random.Random(seed)
    say = lambda n: "".join(rng.choice("ab é") for _ in range(n))
    passages = [say(n) for n in (19, 20, 21, 60, 150)]
    rows = [(i, "".join(rng.choice([say(rng.randint(0, 30)), rng.choice(passages)]) for _ in range(rng.randint(0, 7)))) for i in range(80)]
    rows += [(90, "x" * 70), (91, "ab" * 40), (92, passages[4]), (92, passages[4]), (None, passages[3]), (None, "unseen" * 2), (93, say(300)), (94, "z" * 20 + "y" + "z" * 20)]
    return rows + [(200 + k, t) for k, t in enumerate(odd_texts()) if len(t or "") < 10_000]


def run(spark, rows, length=20):
    return sorted(map(tuple, suffix_dedup.repeated_digest(suffix_dedup.drop_repeated(docs(spark, rows), length)).collect()), key=repr)


def test_against_every_string(spark):
    rows = corpus(1)
    assert run(spark, rows) == by_hand(rows, 20)


def test_hot_anchors(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 1)
    rows = corpus(2)
    assert run(spark, rows) == by_hand(rows, 20)


def test_pieces_and_shards(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 37)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 500)
    rows = corpus(3)
    assert run(spark, rows) == by_hand(rows, 20)


def test_longer_strings_than_a_run(spark):
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(700))
    rows = [(1, passage), (2, "q" * 90 + passage[100:560]), (3, passage[300:]), (4, passage[:399]), (5, passage[:200] + "#" + passage[200:])]
    assert run(spark, rows, 400) == by_hand(rows, 400)


def test_passages_of_over_50_words_go_by_their_bytes(spark):
    rng = random.Random(10)
    words = [" ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n)) for n in (59, 70)]
    assert [len(w) for w in words] == [353, 419]
    rows = [(k, f"{k} " * 50 + words[k // 2] + f" {k}" * 50) for k in range(4)]
    removed = {length: [r[2] > 0 for r in run(spark, rows, length)] for length in (250, 400)}
    assert removed == {250: [True] * 4, 400: [False, False, True, True]}
    assert run(spark, rows, 400) == by_hand(rows, 400) and run(spark, rows, 250) == by_hand(rows, 250)


def test_empty_table(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, "short"), (2, None)]) == by_hand([(1, "short"), (2, None)], 20)
