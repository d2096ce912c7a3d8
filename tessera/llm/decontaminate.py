"""Benchmark decontamination by templates.

Texts become token sequences in which numbers, names and units are typed
placeholders, so a question with other parameters keeps its template. Windows of
five template tokens are hash-joined with those of the benchmark. Where enough of
an item's windows line up in a document, the slots in them are compared: the same
value of the item must have one value in the document, and windows with another
than its most frequent one do not count. Lower-cased words are windowed besides,
so that copies word for word are found whatever their capitals, numbers or length.

Everything is built-in expressions. Benchmark windows are broadcast only if they
are few (they are counted first), else the join is shuffled. Items with the same
template whose slots are equal to each other at the same places share one class,
so a template costs one match for each such pattern, however many items use it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored, text_of

WINDOW = 5
SIMILARITY = 0.8
#: Tokens of a window that are no placeholders, at least; the others say too little.
LITERALS = 2
#: An item of fewer than ``WINDOW`` words that more documents hold, and more than this share of all, is common speech and no evidence.
COMMON_LEAST = 100
COMMON_SHARE = 0.001
#: Benchmark windows that are broadcast at most, some 40 MB.
BROADCAST_WINDOWS = 1_000_000
#: Documents with a hit whose keys are broadcast at most, some 24 MB; with more, texts are joined by a shuffle.
BROADCAST_FOUND = 1_000_000

#: Placeholders: letters that texts in other scripts lack.
NAME, NUMBER, UNIT = "ꓠ", "ꓓ", "ꓴ"
#: Words that are units after a number.
UNITS = (
    "mm", "cm", "m", "km", "mg", "g", "kg", "ml", "l", "s", "ms", "min", "h", "hz", "khz", "mhz", "ghz", "w", "kw", "v", "j", "kj", "n", "pa",
    "b", "kb", "mb", "gb", "tb", "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles", "ounce", "ounces", "pound", "pounds", "ton", "tons",
    "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years",
    "meter", "meters", "metre", "metres", "liter", "liters", "litre", "litres", "gram", "grams", "degree", "degrees", "percent",
    "dollar", "dollars", "euro", "euros", "cent", "cents",
)

_LETTER = r"[\p{L}\p{N}]"
#: Between tokens: anything but letters and digits, except a point or comma between digits.
_BETWEEN = r"(?:[^\p{L}\p{N}.,]|(?<!\p{N})[.,]|[.,](?!\p{N}))+"


def raw_tokens(text: Column) -> Column:
    return F.array_remove(F.split(text, _BETWEEN), "")


def _kinds(raw: Column) -> Column:
    """Of each raw token its placeholder, empty for a word that stands for itself; units are not looked for.

    A name is a capital followed by a small letter; words in capitals and single
    letters are not.
    """
    return F.transform(raw, lambda x: F.when(x.rlike(r"^\p{N}"), NUMBER).when((x != F.lower(x)) & x.rlike(r"^\p{Lu}\p{Ll}"), NAME).otherwise(""))


def template_tokens(raw: Column, kinds: Column, names: bool = True) -> Column:
    """Tokens, one for one with ``raw``: placeholders, and other words in lower case.

    A passage in capitals or in lower case equals the tokens of its original
    without ``names``.
    """
    low = F.transform(raw, F.lower)
    unit = lambda x, i: (F.get(kinds, i - 1) == NUMBER) & x.isin(*UNITS)
    kind = lambda x, i: F.when(F.get(kinds, i) == NUMBER, NUMBER).when(F.lit(names) & (F.get(kinds, i) == NAME), NAME).when((i > 0) & unit(x, i), UNIT).otherwise(x)
    return F.transform(low, kind)


def _windows(hashes: Column, width: int = WINDOW) -> Column:
    """Hash of each run of ``width`` token hashes; null if there are fewer."""
    starts = F.sequence(F.lit(0), F.size(hashes) - width)
    return F.when(F.size(hashes) >= width, F.transform(starts, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(width)])))


def _short(hashes: Column, size: Column) -> Column:
    """Hash of the first tokens of an item of fewer than ``WINDOW``."""
    whole = F.lit(None).cast("long")
    for n in range(1, WINDOW):
        whole = F.when(size == n, F.xxhash64(*[F.get(hashes, F.lit(k)) for k in range(n)])).otherwise(whole)
    return whole


def _hashes(tokens: Column) -> Column:
    return F.transform(tokens, lambda x: F.xxhash64(x))


def _template_hashes(low: Column, kinds: Column) -> Column:
    """The hashes of the template tokens, from those of the words in lower case."""
    number, name, unit = (_hash_of(x) for x in (NUMBER, NAME, UNIT))
    units = [_hash_of(x) for x in UNITS]

    def one(h: Column, i: Column) -> Column:
        kind = F.get(kinds, i)
        return F.when(kind == NUMBER, number).when(kind == NAME, name).when(h.isin(*units) & (i > 0) & (F.get(kinds, i - 1) == NUMBER), unit).otherwise(h)

    return F.transform(low, one)


def _hash_of(token: str) -> Column:
    return F.xxhash64(F.lit(token))  # folded to a literal


def _is_slot(token: Column) -> Column:
    return token.isin(NAME, NUMBER, UNIT)


def _pattern(raw: Column, tpl: Column) -> Column:
    """For each slot, the number of the first slot with its value: all that the comparison of slots depends on."""
    values = F.transform(F.filter(F.arrays_zip(raw.alias("raw"), tpl.alias("tpl")), lambda x: _is_slot(x["tpl"])), lambda x: F.lower(x["raw"]))
    return F.transform(values, lambda v: F.array_position(values, v))


def item_classes(benchmark: DataFrame) -> DataFrame:
    """Items by template and pattern of equal slots: cls, the item ids, raw and template tokens of the first, and its windows that say enough.

    Each item has two templates, with and without placeholders for names, and its
    words in lower case as a third form, which is ``exact`` and has no slots. There
    an item of fewer than ``WINDOW`` words is one window. ``shaped`` are templates.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), raw_tokens(text_of()).alias("raw")).withColumn("kinds", _kinds(F.col("raw")))
    raw, kinds = F.col("raw"), F.col("kinds")
    forms = ((template_tokens(raw, kinds), False), (template_tokens(raw, kinds, names=False), False), (F.transform(raw, F.lower), True))
    forms = F.array(*[F.struct(tpl.alias("tpl"), F.lit(exact).alias("exact")) for tpl, exact in forms])
    items = items.select("item_id", "raw", F.inline(forms))
    items = items.withColumn("pattern", _pattern(F.col("raw"), F.col("tpl")))
    first = items.groupBy("tpl", "pattern").agg(F.min_by("raw", F.struct("item_id", "raw")).alias("raw"), F.array_sort(F.collect_set("item_id")).alias("items"), F.max("exact").alias("exact"), F.max(~F.col("exact")).alias("shaped"))
    said = lambda i: F.size(F.filter(F.slice("tpl", i + 1, WINDOW), lambda x: ~_is_slot(x))) >= LITERALS
    marked = F.filter(F.transform("windows", lambda w, i: F.struct(i.alias("ipos"), w.alias("w"))), lambda x: said(x["ipos"]))
    whole = F.when(F.col("exact") & F.size("tpl").between(1, WINDOW - 1), F.array(F.struct(F.lit(0).alias("ipos"), _short(F.col("hashes"), F.size("tpl")).alias("w"))))
    out = first.withColumn("hashes", _hashes(F.col("tpl"))).withColumn("windows", _windows(F.col("hashes"))).withColumn("windows", F.coalesce(marked, whole, F.expr("cast(array() as array<struct<ipos:int,w:bigint>>)")))
    return out.select(F.xxhash64("tpl", "pattern").alias("cls"), "items", "raw", "tpl", "exact", "shaped", "windows", F.size("windows").alias("n_windows"))


def _slots(item_raw: Column, item_tpl: Column, doc_raw: Column, shift: Column, at: Column) -> Column:
    """Place, value in the item (a) and value in the document (b) of each slot in the windows that start at ``at``."""
    slots = F.filter(F.transform(item_tpl, lambda x, j: F.struct(j.alias("j"), x.alias("x"))), lambda s: _is_slot(s["x"]) & F.exists(at, lambda i: s["j"].between(i, i + WINDOW - 1)))
    return F.transform(slots, lambda s: F.struct(s["j"].alias("j"), F.lower(F.get(item_raw, s["j"])).alias("a"), F.lower(F.get(doc_raw, s["j"] + shift)).alias("b")))


def _votes(slots: Column) -> Column:
    """Each pair of values (a, b) and the number n of slots that have it."""
    pairs = F.array_distinct(F.transform(slots, lambda s: F.struct(s["a"], s["b"])))
    return F.transform(pairs, lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b"), F.size(F.filter(slots, lambda s: (s["a"] == p["a"]) & (s["b"] == p["b"]))).alias("n")))


def _deviating(slots: Column, votes: Column) -> Column:
    """Places of the slots whose value in the document is not the most frequent one for their value in the item; of equally frequent ones none is."""
    beaten = F.filter(votes, lambda v: F.exists(votes, lambda o: (o["a"] == v["a"]) & (o["b"] != v["b"]) & (o["n"] >= v["n"])))
    return F.transform(F.filter(slots, lambda s: F.exists(beaten, lambda v: (v["a"] == s["a"]) & (v["b"] == s["b"]))), lambda s: s["j"])


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and benchmark item that it holds: doc_id, item_id, n_windows, n_matched, similarity, contaminated (true).

    A document holds an item if ``SIMILARITY`` of the item's windows or more are
    in it, each with consistent slots. Counts are of the item's
    templates, or of its words as they are if only those are found. An item of fewer
    than ``WINDOW`` words is held where all of them follow each other, unless more than
    ``COMMON_LEAST`` documents and ``COMMON_SHARE`` of all rows hold it: then it is common
    speech and none does; one without words is never found. Null and empty texts hold nothing; repeated rows
    give one row; a null doc_id or item_id is carried; empty tables give no rows;
    other columns are ignored.
    """
    found = _found(docs, benchmark)
    each = found.select("doc_id", F.explode("items").alias("item_id"), "shaped", "n_windows", "n_matched")
    most = lambda name: F.coalesce(F.max(F.when(F.col("shaped"), F.col(name))), F.max(name)).alias(name)
    best = each.groupBy("doc_id", "item_id").agg(most("n_matched"), most("n_windows"))
    return best.select("doc_id", "item_id", F.col("n_windows").cast("long"), F.col("n_matched").cast("long"), (F.col("n_matched") / F.col("n_windows")).alias("similarity"), F.lit(True).alias("contaminated"))


def _found(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, h, items, shaped, n_windows, n_matched) for each class found in each text."""
    classes = stored(item_classes(benchmark))
    index = classes.select("cls", F.inline("windows"))
    if index.count() <= BROADCAST_WINDOWS:
        index = F.broadcast(index)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("h"), text_of().alias("t"))
    short = [r[0] for r in classes.where(F.col("exact") & F.size("tpl").between(1, WINDOW - 1)).select(F.size("tpl")).distinct().collect()]
    # one step for each array, so that none is computed again inside a lambda
    tokens = texts.select("doc_id", "h", raw_tokens(F.col("t")).alias("raw"))
    tokens = tokens.select("doc_id", "h", _kinds(F.col("raw")).alias("kinds"), F.transform("raw", lambda x: F.xxhash64(F.lower(x))).alias("low"))
    tokens = tokens.select("doc_id", "h", "low", _template_hashes(F.col("low"), F.col("kinds")).alias("tpl"))
    hashed = tokens.select("doc_id", "h", _windows(F.col("tpl")).alias("w_tpl"), _windows(F.col("low")).alias("w_low"), *[_windows(F.col("low"), n).alias(f"w_{n}") for n in short])
    # a window without placeholders is the same in both forms and counts once
    other = F.transform("w_low", lambda w, i: F.when(~w.eqNullSafe(F.get("w_tpl", i)), w))
    none = F.expr("cast(array() as array<bigint>)")
    every = F.concat(*[F.coalesce(x, none) for x in (F.col("w_tpl"), other, *[F.col(f"w_{n}") for n in short])])
    # outer, as else a filter on the array's size repeats its making; the join drops the nulls.
    # Only positions of template windows are those in the text; others meet no slots.
    windows = hashed.select("doc_id", "h", F.posexplode_outer(every).alias("pos", "w"))
    hits = windows.join(index, "w").groupBy("doc_id", "h", "cls", (F.col("pos") - F.col("ipos")).alias("shift")).agg(F.collect_set("ipos").alias("at"))
    # classes of which enough windows occur at all
    by_class = hits.groupBy("doc_id", "h", "cls").agg(F.collect_list(F.struct("shift", "at")).alias("runs"))
    near = by_class.join(classes.select("cls", "n_windows"), "cls").where(F.size(F.array_distinct(F.flatten("runs.at"))) >= SIMILARITY * F.col("n_windows")).drop("n_windows")
    near = stored(near)
    if short:
        near = _telling(near, classes, docs)
    runs = near.withColumnsRenamed({"doc_id": "of_doc", "h": "of_text"}).hint("shuffle_hash")
    again = _of(texts, near).join(runs, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("h") == F.col("of_text"))).select("doc_id", "h", raw_tokens(F.col("t")).alias("doc_raw"), "cls", "runs").dropDuplicates(["doc_id", "h", "cls"])
    whole = again.join(classes, "cls")

    # one step for each array, so that none is computed again inside a lambda
    whole = whole.withColumn("runs", F.transform("runs", lambda r: F.struct(r["at"].alias("at"), _slots(F.col("raw"), F.col("tpl"), F.col("doc_raw"), r["shift"], r["at"]).alias("slots"))))
    whole = whole.withColumn("runs", F.transform("runs", lambda r: F.struct(r["at"].alias("at"), r["slots"].alias("slots"), _votes(r["slots"]).alias("votes"))))
    whole = whole.withColumn("runs", F.transform("runs", lambda r: F.struct(r["at"].alias("at"), _deviating(r["slots"], r["votes"]).alias("off"))))
    right = F.transform("runs", lambda r: F.filter(r["at"], lambda i: ~F.exists(r["off"], lambda j: j.between(i, i + WINDOW - 1))))
    kept = whole.withColumn("n_matched", F.size(F.array_distinct(F.flatten(right))))
    return kept.where(F.col("n_matched") >= SIMILARITY * F.col("n_windows")).select("doc_id", "h", "items", "shaped", "n_windows", "n_matched")


def _telling(near: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """``near`` without the classes of short items that too many documents hold; there are fewer of those than short items."""
    few = classes.where(F.size("tpl") < WINDOW).select("cls")
    bound = max(COMMON_LEAST, COMMON_SHARE * docs.count())
    common = stored(near.join(few, "cls", "left_semi").groupBy("cls").count().where(F.col("count") > bound).select("cls"))
    return near.join(F.broadcast(common), "cls", "left_anti")


def _of(texts: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``texts`` (doc_id, h, t) that ``found`` names; no text is shuffled where those are few."""
    keys = found.select(F.col("doc_id").alias("of_doc"), F.col("h").alias("of_text")).distinct()
    if keys.count() > BROADCAST_FOUND:
        return texts
    return texts.join(F.broadcast(keys), F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("h") == F.col("of_text")), "left_semi")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with their columns as they are."""
    bad = stored(_found(docs, benchmark).select(F.col("doc_id").alias("_dc_doc"), F.col("h").alias("_dc_text")).distinct())
    bad = F.broadcast(bad) if bad.count() <= BROADCAST_FOUND else bad
    marked = docs.withColumn("_dc_own", F.xxhash64(text_of()))
    on = F.col("doc_id").cast("long").eqNullSafe(F.col("_dc_doc")) & (F.col("_dc_own") == F.col("_dc_text"))
    return marked.join(bad, on, "left_anti").select(docs.columns)
