"""Suffix, substring and SimHash deduplication against brute force."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tessera.llm import common, components, lempel_ziv, repeats, simhash, substring_dedup, suffix_dedup
from tessera.llm.common import WORD_GAP

DOCS = "doc_id long, text string, h string, spans int, fp int"  # the last three clash with inner names


def corpus(seed):
    r = random.Random(seed)
    base = ["".join(r.choices("ab ñ\n", k=r.randint(0, 300))) for _ in range(30)]
    texts = []
    for _ in range(80):
        k = r.random()
        if k < 0.3:
            texts.append(r.choice(base))
        elif k < 0.7:
            a, b, c = r.choices(base, k=3)
            texts.append(a[r.randint(0, len(a)) :] + b[: r.randint(0, len(b))] + c)
        else:
            texts.append("".join(r.choices("abcdefgh  ", k=r.randint(0, 400))))
    texts += ["", None, "a" * 700, "ab " * 300, " \n\t "]
    rows = [(None if i % 17 == 5 else i, t, "x", 1, 2) for i, t in enumerate(texts)]
    return rows + rows[3:6]  # repeated rows


@pytest.mark.parametrize("seed, hot, gather, block", [(0, 10**6, 10**6, 200_000), (1, 1, 50, 37), (2, 5, 1000, 500)])
def test_repeats_equal_brute_force(spark, monkeypatch, seed, hot, gather, block):
    for name, value in (("HOT", hot), ("GATHER", gather), ("BLOCK", block)):
        monkeypatch.setattr(repeats, name, value)
    for name, value in (("HOT", hot), ("GATHER", gather), ("SAMPLED", 1)):
        monkeypatch.setattr(lempel_ziv, name, value)
    rows = corpus(seed)
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    width, gram = 20, 6
    seqs = [(r[1] or "").encode() for r in rows]
    want = Counter()
    for r, s, flags in zip(rows, seqs, brute.covered(seqs, width)):
        kept = bytes(x for x, gone in zip(s, flags) if not gone)
        runs = sum(1 for i, f in enumerate(flags) if f and (i == 0 or not flags[i - 1]))
        want[r[0], len(s), sum(flags), runs, brute.sha(kept)] += 1
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeated_bytes(df, width, gram).collect())
    assert got == want
    width, gram = 5, 2
    seqs = [(r[1] or "").encode().split() for r in rows]
    want = Counter()
    for r, s, flags in zip(rows, seqs, brute.covered(seqs, width)):
        want[r[0], len(s), sum(flags), brute.sha(b" ".join(x for x, gone in zip(s, flags) if not gone))] += 1
    out = substring_dedup.remove_repeated_words(df, width, gram)
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out.collect()) == want
    assert all(brute.sha((r.kept or "").encode()) == r.kept_sha256 for r in out.collect())


@pytest.mark.parametrize("seed", range(6))
def test_factors_equal_a_plain_greedy_parser(seed):
    """Each phrase parsed word by word: the longest run that starts elsewhere in the block too, then from the first window that it does not cover."""
    r = random.Random(seed)
    width, gram = 6, 3
    texts = [" ".join(r.choices("abc", k=r.randint(0, 60))) for _ in range(25)]
    texts += [" ".join([*texts[i].split()[: r.randint(0, 60)], "x", *texts[i + 1].split()]) for i in range(10)] + [texts[0], "a " * 80]
    b = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts)), pa.int64()), "h": pa.array([0] * len(texts), pa.int64()), "t": pa.array([t.encode() for t in texts], pa.binary())})
    (rec, windows), *more = lempel_ziv._of_blocks(b, repeats.word_blocks, width, gram)
    assert not more
    sent = lempel_ziv.pack(rec, rec["begin"], windows, np.zeros(len(rec["n"]), np.uint64))
    out = lempel_ziv.factor_block(pa.Table.from_batches([sent]))
    got = sorted((d, s >> 24, (s & 0xFFFFFF) + width - 1) for d, s in zip(out["doc_id"].to_pylist(), out["span"].to_pylist()))

    words = [t.split() for t in texts]
    phrases = [(int(d), int(p), words[d][p : p + n + width - 1]) for d, p, n in zip(rec["doc"], rec["pos"], rec["n"])]
    assert sorted((d, p + i) for d, p, w in phrases for i in range(len(w) - width + 1)) == [(d, i) for d, w in enumerate(words) for i in range(len(w) - width + 1)]
    starts: dict[tuple, list] = {}
    for q, (_, _, w) in enumerate(phrases):
        for j in range(len(w) - width + 1):
            starts.setdefault(tuple(w[j : j + width]), []).append((q, j))

    def common(x, y):
        n = 0
        while n < min(len(x), len(y)) and x[n] == y[n]:
            n += 1
        return n

    want = []
    for q, (d, p, w) in enumerate(phrases):
        i = 0
        while i + width <= len(w):
            longest = max((common(w[i:], phrases[o][2][j:]) for o, j in starts[tuple(w[i : i + width])] if (o, j) != (q, i)), default=0)
            if longest:
                want.append((d, p + i, longest))
            i += longest - width + 1 if longest else 1
    assert got == sorted(want) and want


def test_without_repeats_keeps_columns_and_rows(spark):
    rows = [(1, "a b c d e f", "en", 11), (2, "x a b c d e y", "en", 13), (None, None, None, None), (4, "  two  words ", "de", 13)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long")
    got = {r.doc_id: (r.text, r.lang, r.n_chars) for r in substring_dedup.without_repeats(df, 5, 2).collect()}
    assert got == {1: ("f", "en", 1), 2: ("x y", "en", 3), None: (None, None, None), 4: ("  two  words ", "de", 13)}
    assert substring_dedup.without_repeats(df, 5, 2).columns == df.columns


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert suffix_dedup.remove_repeated_bytes(none).count() == 0
    assert substring_dedup.remove_repeated_words(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.one_of_each(none).count() == 0
    blank = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert [r.n_removed for r in suffix_dedup.remove_repeated_bytes(blank).collect()] == [0, 0]


def test_bucket_ids_are_dealt_evenly(spark):
    ids = common.bucket_ids(spark, 3)
    parts = common.shuffle_parts(spark)
    assert len(set(ids.tolist())) == len(ids) == 3 * parts
    rows = spark.createDataFrame([(int(i),) for i in ids] + [(-7,), (1 << 40,)], "b long").select("b", F.hash("b").alias("k")).collect()
    assert [r.k for r in rows] == common._spread(np.array([r.b for r in rows])).tolist()
    assert set(Counter(r.k % parts for r in rows[:-2]).values()) == {3}


def test_splitters_cut_a_common_opening(spark):
    """All stretches open with the same bytes; they are cut where they differ."""
    r = random.Random(1)
    rows = [(i, 0, b"x" * 30 + bytes(r.choices(b"ab\0", k=20))) for i in range(400)]
    texts = spark.createDataFrame(rows, "doc_id long, h long, t binary")
    still = texts.select("doc_id", "h", F.struct(F.lit(0).cast("long").alias("pos"), F.lit(5).cast("long").alias("n"), F.lit(False).alias("hot")).alias("phrase"))
    cuts = suffix_dedup.splitters(texts, still, 8, 40)
    share = np.bincount(np.searchsorted(cuts, np.array([t[:40] for *_, t in rows], "S40"), side="right"))
    assert len(share) == 8 and share.max() <= 60


def test_multikey_order_sorts_ties_by_later_characters():
    r = np.random.default_rng(0)
    a, b, c = (r.integers(0, 3, 200).astype(np.uint64) for _ in range(3))
    order, begin, group = suffix_dedup.multikey_order(a, iter([lambda e: b[e], lambda e: c[e]]))
    rows = list(zip(a[order], b[order], c[order]))
    assert rows == sorted(rows)
    assert [rows[i] for i in begin] == sorted(set(rows)) and [rows[begin[g]] for g in group] == rows


def test_fingerprints(spark):
    texts = ["", None, "One", "one TWO", "a b c", "a b c d", "é É x y z", " \t\n", "w " * 5000, "a b a b a b a b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.fingerprint for r in simhash.near_duplicates(df).collect()}
    assert got == {i: f"{brute.fingerprint(t):016x}" for i, t in enumerate(texts)}


@pytest.mark.parametrize("subtree", [200_000, 20, 3])
def test_links_equal_all_pairs(spark, monkeypatch, subtree):
    monkeypatch.setattr(simhash, "SUBTREE", subtree)
    r = random.Random(subtree)
    values = {0, (1 << 64) - 1}
    while len(values) < 160:
        x = r.choice([r.getrandbits(64), r.choice(sorted(values)) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)), r.getrandbits(6)])
        values.add(x)
    values = sorted(values)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in values], "fp long")
    root = {row.node: row.root for row in components.components(simhash.links(df)).collect()}
    want = brute.classes(values, lambda a, b: (a ^ b).bit_count() <= 2)
    signed = [x - (1 << 64) if x >> 63 else x for x in values]
    got = [root.get(x, x) for x in signed]
    assert len(set(got)) == len(set(want))
    assert len(set(zip(got, want))) == len(set(want))


@pytest.mark.parametrize("hot", [common.HOT_KEY, 2])
def test_near_duplicates_and_one_of_each(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT_KEY", hot)
    words = [f"w{i}" for i in range(400)]
    near = words[:]
    near[7] = "changed"
    rows = [(5, " ".join(words)), (3, " ".join(words).upper()), (9, " ".join(near)), (7, None), (8, ""), (1, "another text here"), (1, "another text here"), (None, "another text here")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("clash"))
    fps = [brute.fingerprint(t) for _, t in rows]
    cls = brute.classes(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    ids = {c: min(i for (i, _), k in zip(rows, cls) if k == c and i is not None) for c in set(cls)}
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect())
    assert got == Counter((i, f"{f:016x}", ids[c]) for (i, _), f, c in zip(rows, fps, cls))
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([*ids.values(), None])


def test_one_of_each_with_two_texts_of_an_id(spark):
    a, b, c = ("one two three four five six", "seven eight nine ten eleven", "twelve thirteen fourteen fifteen")
    rows = [(5, a), (3, b), (5, b), (5, c), (5, c), (7, c)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"h": F.lit("clash"), "fp": F.lit("clash"), "root": F.lit("clash")})
    assert Counter((r.doc_id, r.text) for r in simhash.one_of_each(df).collect()) == Counter([(5, a), (3, b), (5, c)])


@pytest.mark.parametrize("hot", [common.HOT_KEY, 5, 1])
def test_components_of_a_long_chain_and_a_hub(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT_KEY", hot)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201), (200, 201)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {200: 200, 201: 200}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("hot", [1, 3, 100])
def test_lookup_of_hot_and_other_keys(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT_KEY", hot)
    keys = [1] * 5 + [2] * 2 + [3, 4, None]
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, i int")
    values = spark.createDataFrame([(1, "a", 5), (2, "b", 2), (3, "c", 1), (9, "z", 0)], "k long, v string, n long")
    got = Counter(map(tuple, common.lookup(rows, values, "k").select("k", "i", "v").collect()))
    assert got == Counter((k, i, {1: "a", 2: "b", 3: "c"}[k]) for i, k in enumerate(keys) if k in (1, 2, 3))


def test_word_gap_is_ascii_white_space(spark):
    text = "a\x0b\x0c\r\n\t b\x1c\x85\xa0c"
    got = spark.createDataFrame([(text,)], "t string").select(F.split("t", WORD_GAP).alias("w")).first().w
    assert got == [w.decode() for w in text.encode().split()]


def test_equal_rows_send_one_text(spark, monkeypatch):
    """500 equal rows that share a passage with one other document: results as by brute force, no more texts compared than tasks read."""
    r = random.Random(9)
    text = "".join(r.choices("abcdefgh ", k=600))
    rows = [(7, text, "x", 1, 2)] * 500 + [(8, "start " + text[100:180] + " end", "x", 1, 2), (None, text[300:420], "x", 1, 2)]
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    seqs = [t.encode() for _, t, *_ in rows]
    flags = brute.covered(seqs, 20)
    sent = []
    whole = repeats.open_phrases

    def counted(*a):
        out = whole(*a)
        sent.append(out.where("doc_id = 7 or doc_id is null").groupBy("doc_id", "h", "pos").count().agg(F.max("count")).first()[0])
        return out

    monkeypatch.setattr(repeats, "open_phrases", counted)
    got = Counter((x.doc_id, x.n_removed) for x in suffix_dedup.remove_repeated_bytes(df, 20, 6).collect())
    assert got == Counter((row[0], sum(f)) for row, f in zip(rows, flags)) and len(sent) == 1 and (sent[0] or 0) <= 4
