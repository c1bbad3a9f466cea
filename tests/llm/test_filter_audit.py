import random
from itertools import permutations

import numpy as np
from tests.llm.texts import odd_texts, prose

from tidelog.llm import filter_audit

EXTRA = "part string, failed int, key string, good int, toxic string, word int, first_id int"


def corpus(spark, rows):
    return spark.createDataFrame([(i, t, s, "p", 1, "k", 2, "t", 3, 4) for i, t, s in rows], f"doc_id long, text string, source string, {EXTRA}")


def labelled(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, quality int, toxic int, part string")


def failed(rows):
    out = []
    for i, t, _ in rows:
        t = t or ""
        words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in t).split(" ") if w]
        out.append(
            {
                "A": len(words) < 200,
                "B": 100 * len(set(words)) < 50 * len(words),
                "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t),
                "D": any(c in "#$%&*|" for c in t),
                "E": any(j is not None and i is not None and j < i and (u or "") == t for j, u, _ in rows),
            }
        )
    return out


def by_hand(rows, labels):
    fails = failed(rows)
    good, toxic = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    out = {}
    for part in {s or "" for _, _, s in rows}:
        mine = [(f, i) for f, (i, _, s) in zip(fails, rows) if (s or "") == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            alive = mine
            for step, x in enumerate(order, 1):
                lost = [(f, i) for f, i in alive if f[x]]
                total[x] += len(lost)
                all_x = sum(f[x] for f, _ in mine)
                only = sum(f[x] and sum(f.values()) == 1 for f, _ in mine)
                alive = [(f, i) for f, i in alive if not f[x]]
                out[part, "".join(order), step] = [len(alive), len(lost), all_x - len(lost), only, sum(i in good for _, i in lost), sum(i in toxic for _, i in lost), x]
        for (p, _, _), v in out.items():
            if p == part:
                v[-1] = total[v[-1]]
    return {k: tuple(v) for k, v in out.items()}


def run(spark, rows, labels):
    found = filter_audit.audit_filters(corpus(spark, rows), labelled(spark, labels)).collect()
    out = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in found}
    assert len(out) == len(found)
    return out


def sample():
    rng = random.Random(3)
    texts = [prose(rng, n) for n in (50, 199, 200, 260, 400)] + ["same word " * 150, "Big Words " * 120, prose(rng, 210) + " #1", prose(rng, 300) + "|", *odd_texts()]
    rows = [(i, rng.choice(texts), rng.choice(["a", "b", "b", "b", None, ""])) for i in range(160)]
    rows += [(None, texts[3], "a"), (None, texts[3], "b"), (7, texts[4], "b"), rows[9], rows[9], (500, prose(rng, 250), "lone")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 0, 1, None])) for i in range(0, 160, 2)] + [(4, 1, 1), (None, 1, 1), (9999, 1, 1)]
    return rows, labels


def test_all_orders_against_filters_applied_one_by_one(spark):
    rows, labels = sample()
    want = by_hand(rows, labels)
    assert run(spark, rows, labels) == want and len(want) == 4 * 600


def test_empty_tables(spark):
    assert run(spark, [], []) == {}
    got = run(spark, [(1, None, None)], [])
    assert len(got) == 600 and got["", "ABCDE", 1] == (0, 1, 0, 1, 0, 0, 120) and got["", "BACDE", 1] == (1, 0, 0, 0, 0, 0, 0)


def test_one_text_in_most_documents(spark):
    rng = random.Random(4)
    hot = prose(rng, 220)
    rows = [(i, hot, f"s{i % 3}") for i in range(5000)] + [(i, prose(rng, 5), "s0") for i in range(5000, 5100)]
    got = run(spark, rows, [(i, 1, 0) for i in range(0, 5000, 5)])
    assert got["s0", "EABCD", 1][:3] == (101, 1666, 0) and got["s1", "EABCD", 1][:2] == (0, 1667)


def test_positional_popcounts(spark):
    rng = np.random.default_rng(1)
    for n, groups in ((0, 1), (1, 1), (2, 3), (1000, 1), (5000, 700)):
        words = rng.integers(0, 2**32, n, dtype=np.uint64).astype(np.uint32)
        group = np.sort(rng.integers(0, groups, n))
        want = np.zeros((groups, 32), np.int64)
        np.add.at(want, group, ((words[:, None] >> np.arange(32, dtype=np.uint32)) & 1).astype(np.int64))
        assert (filter_audit.popcounts_by_position(words, group, groups) == want).all()


def test_survival_words():
    assert filter_audit.survival_word(0) == 2**32 - 1 and filter_audit.survival_word(31) == 1
    for failed_bits in range(32):
        word = filter_audit.survival_word(failed_bits)
        assert [bool(word >> s & 1) for s in range(32)] == [s & failed_bits == 0 for s in range(32)]
