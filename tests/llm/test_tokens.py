"""Token counts and SentencePiece against the libraries, and the pipeline against brute force."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tessera.llm import piece_bpe, token_count
from tessera.llm.caches import Recent

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", None, " ", "  a", "a ", "▁x ▁▁ y", "日本 𝒳\0é\n\n", " \n \t a  b   c", "<s> <0x41> </s>", "x" * 3000, "don't  it's x", "<|endoftext|> a", "\n", "a\n b", "é̈ ʼn ﬁ", "word " * 4000, "\x1c \x85\xa0 x"]


def random_texts(n=300):
    r = random.Random(5)
    parts = [" ", "  ", "\n", "\t", "'s", "don't", "a", "B", "12", ".", "!!", "é", "\xa0", "<|endoftext|>", "日", "\x1c", " the", " x", "▁"]
    return ["".join(r.choices(parts, k=r.randint(0, 14))) for _ in range(n)]


def test_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    rows = list(enumerate(ODD + random_texts())) + [(None, "a b"), (0, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    t = Tokenizer.from_file(BPE)
    want = sorted((-1 if i is None else i, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in rows)
    out = token_count.token_counts(docs, BPE).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_tokens) for r in out) == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in out)
    assert token_count.token_counts(docs.limit(0), BPE).count() == 0
    words = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))  # no byte-level file: the library counts
    assert token_count._tokenizer(public_tokenizers.path("word_bpe_49k.json")).fast is None and words


def test_pieces_equal_the_library(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = list(enumerate(ODD + random_texts())) + [(None, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_tokens, r.ids, r.decoded) for r in piece_bpe.round_trip(docs, PIECES).collect()}
    for i, x in rows:
        ids = sp.encode(x or "")
        assert got[i] == (len(ids), ",".join(map(str, ids)), sp.decode(ids)), repr(x)
    digests = {r.doc_id: (r.ids_sha256, r.decoded_sha256) for r in piece_bpe.round_trip_digests(docs, PIECES).collect()}
    assert digests == {i: (brute.sha(ids.encode()), brute.sha(text.encode())) for i, (_, ids, text) in got.items()}
    assert piece_bpe.round_trip(docs.limit(0), PIECES).count() == 0


def test_a_difference_is_settled_by_the_library(monkeypatch):
    """Wrong merges, wrong surfaces and a wrong fast counter change no result."""
    from tokenizers import Tokenizer

    texts = ["one two  three", "▁x y", "", "日本 a\n\nb"] * 8
    m = piece_bpe.Model(PIECES)
    monkeypatch.setitem(piece_bpe._models, PIECES, m)
    monkeypatch.setattr(m, "merge", lambda word: [5])
    m.surface = [b"?"] * len(m.surface)
    ids = m.library.encode(texts)
    assert [x[1] for x in piece_bpe.encode_batch(texts, PIECES)] == [",".join(map(str, i)) for i in ids]
    assert [x[2] for x in piece_bpe.encode_batch(texts, PIECES)] == m.library.decode(ids)
    t = token_count.Lengths(BPE)
    monkeypatch.setitem(token_count._loaded, BPE, t)
    t.fast = type("Wrong", (), {"encode_ordinary": lambda self, x: [0] * 99})()
    want = [len(e.ids) for e in Tokenizer.from_file(BPE).encode_batch(texts, add_special_tokens=False)]
    assert token_count.count_batch(texts, BPE, {}) == want and t.fast is None


def test_every_document_is_decoded_by_the_library_too(monkeypatch):
    m = piece_bpe.Model(PIECES)
    monkeypatch.setitem(piece_bpe._models, PIECES, m)
    decode = m.decode
    texts = [f"number {i} of {'x ' * (i % 9)}" for i in range(25)]
    ids = m.library.encode(texts)
    monkeypatch.setattr(m, "decode", lambda x: "wrong" if list(x) == ids[13] else decode(x))
    assert [x[2] for x in piece_bpe.encode_batch(texts, PIECES)] == m.library.decode(ids)
    monkeypatch.setattr(m, "decode", lambda ids: "wrong")
    assert [x[2] for x in piece_bpe.encode_batch(["", *texts[:1]], PIECES)][1] == m.library.decode(ids[0])


def test_pieces_cut_at_single_spaces_only():
    text = " a b\n\nc d  e \tf\xa0 g h "
    assert "".join(token_count.pieces(text)) == text
    assert token_count.pieces(text) == [" a", " b\n\nc", " d  e \tf\xa0 g", " h "]
    assert token_count.pieces("one two") == ["one", " two"] and token_count.pieces("") == []


def test_recent_is_bounded():
    c = Recent(10)
    for i in range(1000):
        c.put(i, i)
        assert c.get(i) == i and c.get(0 if i < 10 else i) is not None and len(c) <= 20


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small corpus with junk, copies, shared passages and leaks."""
    r = random.Random(11)
    vocabulary = [f"{a}{b}" for a in "bcdfgklmnprst" for b in ("an", "ero", "ilu", "om", "ust")]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n)).capitalize() + "."
    shared, item = prose(50), prose(30)
    docs = [(i, prose(r.randint(60, 120))) for i in range(200)]
    docs += [(200 + i, prose(60).upper().replace(" ", "!! ")) for i in range(40)]
    docs += [(300, docs[5][1]), (301, docs[6][1].upper() if False else docs[6][1].replace("B", "b"))]
    docs += [(310, f"{prose(40)} {shared} {prose(40)}"), (311, f"{prose(30)} {shared} {prose(50)}"), (320, f"{prose(40)} {item} {prose(40)}"), (330, "")]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 200), 0) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), shared, dict(docs)


def test_pipeline_against_brute_force(spark, folder):
    import sentencepiece

    import corpus_pipeline

    path, shared, texts = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    names, at = [n for n, _ in corpus_pipeline.STAGES], {}
    df = docs
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, path)
        at[name] = {r.doc_id: r.asDict() for r in df.collect()}
        if name != names[-1]:
            assert df.columns == docs.columns
            df = spark.createDataFrame([tuple(r.values()) for r in at[name].values()], docs.schema)
    first, second, third, fourth, last = (at[n] for n in names)
    assert not any(200 <= i < 240 for i in first) and sum(i < 200 for i in first) >= 195
    prints = {i: brute.fingerprint(r["text"]) for i, r in first.items()}
    order = sorted(prints)
    roots = brute.classes([prints[i] for i in order], lambda a, b: (a ^ b).bit_count() <= 2)
    assert set(second) == {order[k] for k in set(roots)} and 300 not in second
    order = sorted(second)
    seqs = [second[i]["text"].encode().split() for i in order]
    for i, s, flags in zip(order, seqs, brute.covered(seqs, 35)):
        want = b" ".join(w for w, gone in zip(s, flags) if not gone).decode() if any(flags) else second[i]["text"]
        assert third[i]["text"] == want and third[i]["n_chars"] == len(want)
    assert shared not in third[310]["text"] and len(third) == len(second)
    assert set(third) - set(fourth) == {320}
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert all(last[i]["ids"] == sp.encode(r["text"]) and last[i]["decoded"] == r["text"] for i, r in fourth.items())
    assert {r.doc_id for r in corpus_pipeline.run(spark, path).collect()} == set(last)


def test_stages_take_nulls_repeats_clashes_and_empty_tables(spark, folder, tmp_path):
    import corpus_pipeline

    path, shared, texts = folder
    long = " ".join(f"word{i}" for i in range(60_000))
    rows = [(1, texts[1]), (1, texts[1]), (2, None), (3, ""), (None, texts[4]), (None, None), (7, long), (320, texts[320]), (8, "short one")]
    docs = spark.createDataFrame([(i, t, None, "s", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    clash = ("h", "spans", "fp", "root", "cls", "w", "score", "label", "t", "items")
    docs = docs.withColumns({c: F.lit("clash") for c in clash})
    out = {n: f(spark, docs, path) for n, f in corpus_pipeline.STAGES}
    first, second, third, fourth, last = out.values()
    assert all(x.columns == docs.columns for x in (first, second, third, fourth)) and all(r.h == "clash" for r in third.collect())
    ids = lambda df: sorted(-1 if r.doc_id is None else r.doc_id for r in df.collect())
    every = sorted(-1 if i is None else i for i, _ in rows)
    assert ids(second) == [-1, -1, 1, 2, 7, 8, 320] and ids(third) == ids(last) == every and ids(fourth) == [i for i in every if i != 320]
    assert {r.text for r in third.where("doc_id = 1").collect()} == {""} and third.where("doc_id = 7").first().text == long
    assert {(r.n_tokens, r.decoded) for r in last.where("doc_id in (2, 3)").collect()} == {(0, "")}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), path).count() == 0, name
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert ids(corpus_pipeline.keep_quality(spark, docs, str(tmp_path))) == every == ids(corpus_pipeline.drop_leaks(spark, docs, str(tmp_path)))


def test_run_deletes_what_came_before(spark, folder):
    import corpus_pipeline
    from tessera.llm import common

    before = common.written()
    assert corpus_pipeline.run(spark, folder[0]).count() > 0
    assert common.written() == before + 1


def test_entry_lists_everything(spark):
    import __spark_entry__ as e

    found = e.queries()
    assert "pipeline" in found and sum(n.startswith("op") for n in found) == 10
    assert set(e.oracle_sql()) <= set(found)
