"""Near-duplicates by shingle sets against all pairs."""

import random
import re
from collections import Counter
from math import comb

import pytest

from tessera.llm import minhash
from tests.llm import brute

DOCS = "doc_id long, text string, id string, n int, root int, values int"  # the last four clash with inner names


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def linked(a, b):
    return bool(a) and bool(b) and 100 * len(a & b) >= 85 * len(a | b)


def expected(rows):
    sets = [shingles(r[1]) for r in rows]
    group = brute.classes(sets, linked)
    low = {}
    for r, g in zip(rows, group):
        if r[0] is not None:
            low[g] = min(low.get(g, r[0]), r[0])
    return Counter((r[0], len(s), low.get(g), r[0] == low[g] if g in low and r[0] is not None else g not in low) for r, s, g in zip(rows, sets, group))


def edited(r, words, n):
    words = list(words)
    for _ in range(n):
        words[r.randrange(len(words))] = f"e{r.randrange(10**6)}"
    return words


def corpus(seed):
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(3000)}"
    common = [word() for _ in range(300)]  # a passage that most texts of one kind share
    base = [[word() for _ in range(r.choice([3, 7, 40, 150, 400]))] for _ in range(12)]
    texts = [" ".join(edited(r, w, r.randrange(1 + len(w) // 60))) for w in base for _ in range(r.choice([2, 5, 14]))]
    texts += [" ".join([*edited(r, common, r.randrange(6)), *(word() for _ in range(r.choice([0, 5, 25, 60])))]) for _ in range(60)]
    texts += [" ".join(common[:60] + [word() for _ in range(200)]) for _ in range(30)]
    texts += [t.upper() for t in texts[:5]] + ["", None, " \n\t ", "", "one", "One", "a b c d", "A\tb\nc d", "a " * 300, "b " * 500, "é b c d e f"]
    rows = [(None if i % 19 == 5 else i, t, "x", 1, 2, 3) for i, t in enumerate(texts)]
    return rows + rows[3:6] + [(None, "no other has this text at all", "x", 1, 2, 3), (7, "another text of one id", "x", 1, 2, 3)]


@pytest.mark.parametrize("seed, first, sketch, short, rounds", [(0, 24, 128, 32, 6), (1, 24, 128, 4, 6), (2, 24, 128, 3, 0), (3, 128, 128, 3, 1)])
def test_equals_all_pairs(spark, monkeypatch, seed, first, sketch, short, rounds):
    monkeypatch.setattr(minhash, "ROUNDS", rounds)
    monkeypatch.setattr(minhash, "SHARE", 5)
    monkeypatch.setattr(minhash, "TOGETHER", 7)
    rows = corpus(seed)
    out = minhash.near_duplicates(spark.createDataFrame(rows, DOCS).repartition(3), first=first, sketch=sketch, short=short)
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out.collect()) == expected(rows)


def test_tie_and_just_below(spark):
    """85 of 100 shingles in common link, 84 of 100 do not."""
    word = lambda k, n: [f"{k}{i}" for i in range(n)]
    head = word("c", 89)  # 85 shingles
    rows = [(1, " ".join(head + word("x", 8)), "x", 1, 2, 3), (2, " ".join(word("y", 7) + head), "x", 1, 2, 3)]
    rows += [(3, " ".join([w + "d" for w in head] + word("p", 8)), "x", 1, 2, 3), (4, " ".join(word("q", 8) + [w + "d" for w in head]), "x", 1, 2, 3)]
    out = minhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out} == {1: (93, 1, True), 2: (92, 1, False), 3: (93, 3, True), 4: (93, 4, True)}


def test_empty_table(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []


def test_bound_of_shared_values():
    for m in (1, 7, 24, 128):
        tail = lambda x: sum(comb(m, i) * 0.85**i * 0.15 ** (m - i) for i in range(x))
        assert tail(minhash.needed(m)) <= minhash.MISS * 1.0001 < tail(minhash.needed(m) + 1)


def test_a_pair_meets_in_one_list(spark):
    """Lists that hold the same classes, each with another main component, give a pair once, whichever way round."""
    held = {v: [i for i in range(24) if (i + v) % 5] + [100 + 3 * i + v % 3 for i in range(20)] for v in range(7)}
    rows = [(v, i, 100, 100, None, i % 3) for v, ids in held.items() for i in ids]
    at = spark.createDataFrame(rows, "v long, id long, n long, common long, with_p long, root long").repartition(3)
    finder = minhash.Finder(None, None, minhash.SIMILAR, minhash.FIRST, minhash.SKETCH, minhash.SHORT)
    got = Counter(frozenset((r["a"], r["b"])) for r in finder.outside(at).collect())
    assert set(got) == {frozenset((a, b)) for ids in held.values() for a in ids for b in ids if a % 3 != b % 3}
    assert set(got.values()) == {1}


def rows_by(spark, key, since):
    """How many rows inner joins by ``key`` alone made in what ran after the first ``since`` executions."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store, made = spark._jsparkSession.sharedState().statusStore(), 0
    each = lambda seq: (seq.apply(i) for i in range(seq.size()))
    for run in (e.executionId() for e in each(store.executionsList()) if e.executionId() >= since):
        values = store.executionMetrics(run)
        for node in each(store.planGraph(run).allNodes()):
            if re.search(rf"Join \[{key}#\d+L?\], \[{key}#\d+L?\], Inner", node.desc()):
                told = [values.get(m.accumulatorId()) for m in each(node.metrics()) if m.name() == "number of output rows"]
                made += sum(int(x.get().replace(",", "")) for x in told if x.isDefined())
    return made


def test_rows_of_long_lists_meet_their_class_once(spark, monkeypatch):
    """A class has up to a sketch of them, so they are joined by id once, not again for each step that reads the result."""
    r = random.Random(5)
    common = [f"c{i}" for i in range(400)]
    texts = [" ".join([*common[k % 3 * 9 :], *(f"w{r.randrange(10**6)}" for _ in range(n))]) for k in range(40) for n in (30, 36, 130)]
    rows = [(i, t, "x", 1, 2, 3) for i, t in enumerate(texts)]
    seen, find = {}, minhash.Finder.common_links

    def told(self, lists, found):
        seen.update(rows=lists.count(), classes=lists.select("id").distinct().count(), since=spark._jsparkSession.sharedState().statusStore().executionsCount())
        return find(self, lists, found)

    monkeypatch.setattr(minhash, "ROUNDS", 1)
    monkeypatch.setattr(minhash.Finder, "common_links", told)
    out = minhash.near_duplicates(spark.createDataFrame(rows, DOCS).repartition(3), short=4)
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out.collect()) == expected(rows)
    assert seen["rows"] > 20 * seen["classes"] > 1000
    assert rows_by(spark, "id", seen["since"]) <= seen["rows"] + 5 * seen["classes"]
