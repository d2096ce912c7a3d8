"""Fill-in-middle against a plain version, whole texts and texts in pieces."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from tessera.llm import fill_in_middle as fm
from tests.llm import brute

DOCS = "doc_id long, text string, n string, cuts int, form int, t int"  # the last four clash with inner names


def plain(doc_id, text, rate=100, suffix_first=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < suffix_first:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def corpus():
    r = random.Random(1)
    texts = [None, "", "\n", "a", "a\n", "<P>", "x<<S>y", "<P<M", "é\nü<", "\n" * 9, "<", "<M", "\n<P\n>", "no end" * 50]
    texts += ["".join(r.choices("ab\nñ<€𝄞", k=r.randint(0, 900))) for _ in range(120)] + ["line\n" * 5000, "x" * 20_000]
    rows = [(None if i % 13 == 5 else i, t, "x", 1, 2, 3) for i, t in enumerate(texts)]
    return rows + rows[20:24] + rows[-1:] * 3 + [(i, texts[-2], "x", 1, 2, 3) for i in range(500, 540)] + [(30, "another text\nof one id", "x", 1, 2, 3)]


@pytest.mark.parametrize("piece", [1 << 16, 300, 37])
def test_equals_plain_version(spark, piece):
    rows = corpus()
    made = fm.fill_in_middle(spark.createDataFrame(rows, DOCS).repartition(3), piece=piece)
    want = Counter(plain(r[0], r[1]) for r in rows)
    assert Counter(tuple(r) for r in made.collect()) == want
    digests = fm.digests(made).collect()
    assert Counter((r.doc_id, r.output_sha256) for r in digests) == Counter((r[0], brute.sha(plain(r[0], r[1])[5].encode())) for r in rows)
    assert Counter((r.doc_id, r.restored_sha256) for r in digests) == Counter((r[0], brute.sha((r[1] or "").encode())) for r in rows)


def test_rates_and_empty_table(spark):
    rows = corpus()
    made = fm.fill_in_middle(spark.createDataFrame(rows, DOCS), rate=40, suffix_first=10)
    assert Counter(tuple(r) for r in made.collect()) == Counter(plain(r[0], r[1], 40, 10) for r in rows)
    assert fm.digests(fm.fill_in_middle(spark.createDataFrame([], DOCS))).collect() == []


def test_automaton_equals_regular_expressions():
    """Every split of a text into two: the functions of both parts compose to that of the whole."""
    a, r = fm.automaton(), random.Random(2)
    for _ in range(60):
        text = "".join(r.choices("<PSM>\nx", k=r.randint(1, 400))).encode()
        scan = fm.Scan(a, np.frombuffer(text, np.uint8), np.array([len(text)]))
        state, n = scan.entered()
        assert n[0] == len(re.findall(rb"[^\n]*\n|[^\n]+", text)) and a.found[state[0]] == bool(re.search(rb"<[PSM]>", text))
        starts = [m.start() for m in re.finditer(rb"[^\n]*\n|[^\n]+", text)] + [len(text)]
        assert [int(scan.select(np.array([i]))[0]) for i in range(len(starts))] == starts
        cut = r.randint(0, len(text))
        parts = fm.Scan(a, np.frombuffer(text, np.uint8), np.array([cut, len(text)]))
        after, count = parts.whole()
        assert after[1][after[0]].tolist() == scan.whole()[0][0].tolist()
        assert (count[0] + count[1][after[0]]).tolist() == scan.whole()[1][0].tolist()
