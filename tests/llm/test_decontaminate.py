import hashlib
import random
import re

import pytest
from tests.llm.texts import docs, odd_texts

from tidelog.llm import decontaminate

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w.decode() for w in WORD.findall(low.encode())]


def by_hand(rows, items, n=10):
    out = []
    for i, text in rows:
        w, hit, names = words(text), set(), set()
        for name, passage in items:
            p = words(passage)
            m = min(n, len(p))
            windows = {tuple(p[k : k + m]) for k in range(len(p) - m + 1)} if p else set()
            for k in range(len(w) - m + 1):
                if tuple(w[k : k + m]) in windows:
                    hit |= set(range(k, k + m))
                    names |= {str(name)} - {"None"}
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def run(spark, rows, items):
    bench = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, window string, ids int")
    return decontaminate.contamination_digest(decontaminate.find_contamination(docs(spark, rows), bench))


def sample(seed=1):
    rng = random.Random(seed)
    say = lambda n, of=6: " ".join(rng.choice("abcdefghijklmn"[:of]) for _ in range(n))
    items = [(i, say(rng.randint(10, 25))) for i in range(12)] + [(20, say(1, 14)), (21, say(4)), (22, ""), (23, None), (None, say(12)), (21, say(11))]
    rows = [(i, say(rng.randint(0, 80))) for i in range(40)]
    rows += [(50 + i, say(5) + " " + t.upper() + "! " + say(9)) for i, t in items if t and i is not None]
    rows += [(7, items[0][1]), (7, items[0][1]), (8, "x " * 30), (None, items[1][1])]
    return rows + list(enumerate(odd_texts(), 200)), items


def test_against_every_window(spark):
    rows, items = sample()
    assert sorted(map(tuple, run(spark, rows, items).collect()), key=repr) == by_hand(rows, items)


def test_items_too_many_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "fits_broadcast", lambda df: False)
    rows, items = sample(2)
    assert sorted(map(tuple, run(spark, rows, items).collect()), key=repr) == by_hand(rows, items)


def test_long_items_only_and_borders(spark):
    passage = " ".join(f"w{i}" for i in range(30))
    cut = passage.split()
    rows = [(1, " ".join(cut[:9])), (2, " ".join(cut[:10])), (3, " ".join(cut[20:])), (4, " ".join(cut[:9]) + " q " + " ".join(cut[9:19]))]
    rows.append((5, passage + " " + passage))
    got = {r["doc_id"]: r["n_hit"] for r in run(spark, rows, [(1, passage)]).collect()}
    assert got == {1: 0, 2: 10, 3: 10, 4: 10, 5: 60}


@pytest.mark.parametrize("rows,items", [([], [(1, "a b")]), ([(1, "a b"), (2, None)], [])])
def test_empty_tables(spark, rows, items):
    assert sorted(map(tuple, run(spark, rows, items).collect()), key=repr) == by_hand(rows, items)


def test_dropping_keeps_rows_and_columns(spark):
    rows, items = sample(3)
    table = docs(spark, rows)
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.drop_contaminated(table, bench)
    clean = sorted(((i, t) for i, t in rows if not by_hand([(i, t)], items)[0][5]), key=repr)
    assert out.dtypes == table.dtypes
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr) == clean


def test_main_path_is_native(spark):
    rows, items = sample()
    plan = run(spark, rows, items)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
