"""URL filtering with mined association rules, after a list of fixed rules.

Labelled pages become transactions of URL tokens plus an item for a bad label.
FP-growth finds token combinations that often come with it; rules are pruned by
support, confidence and redundancy (a rule adds nothing where a shorter one
holds). For matching, each rule is filed in an inverted index under its rarest
token; a URL looks up its tokens and checks the few rules it finds. The index is
a literal of all rules, so no page is shuffled: none of them holds another and
each is in a share ``SUPPORT`` of the pages, so their number depends on the tokens
of a page and not on the number of pages.
"""

from __future__ import annotations

import json
import math
import zlib

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored

#: Verdict, host and path of each fixed rule.
FIXED = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
SUPPORT = 0.002
LEAST_PAGES = 20
CONFIDENCE = 0.6
#: Parts of the inverted index, by a checksum of the token.
PARTS = 1024
BAD = "label=bad"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty if there is none."""
    raw = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fixed_rule(host: Column, path: Column) -> tuple[Column, Column]:
    """The longest fixed rule that fits and its verdict, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, h, p in sorted(FIXED, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(decision)).otherwise(verdict)
    return rule, verdict


def tokens(url: Column) -> Column:
    """Distinct tokens of a URL: its parts by role; digits count as one token."""
    host, path = host_of(url), path_of(url)
    plain = lambda x: F.regexp_replace(F.lower(x), "[0-9]+", "0")
    labels = F.transform(F.split(host, r"[.\-:]"), lambda x: F.concat(F.lit("host:"), plain(x)))
    pieces = F.transform(F.split(path, r"[/._\-]"), lambda x: F.concat(F.lit("path:"), plain(x)))
    query = F.transform(F.split(F.coalesce(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), F.lit("")), "&"), lambda x: F.concat(F.lit("query:"), plain(F.substring_index(x, "=", 1))))
    whole = F.array(F.concat(F.lit("site:"), host))
    return F.filter(F.array_distinct(F.concat(whole, labels, pieces, query)), lambda x: ~x.rlike(":$"))


def page_document(url: Column) -> Column:
    """The document that a page shows: the last number in its path."""
    return F.regexp_extract(path_of(url), r"(?s)^.*?/([0-9]{1,18})[^0-9/]*/?$", 1).try_cast("long")


def bad_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Transactions of the labelled pages: tokens, and ``BAD`` where the document is of low quality or toxic."""
    bad = (F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc")).agg(F.max(bad.cast("int")).alias("bad"))
    shown = pages.select(F.col("url").cast("string").alias("url")).where("url is not null").withColumn("doc", page_document(F.col("url")))
    both = shown.join(known, "doc")
    return both.select(F.when(F.col("bad") == 1, F.concat(tokens(F.col("url")), F.array(F.lit(BAD)))).otherwise(tokens(F.col("url"))).alias("items"))


def _file(tokens: list[str]) -> list[list[str]]:
    """Tokens by their part of the index."""
    index: list[list[str]] = [[] for _ in range(PARTS)]
    for t in tokens:
        index[_part(t)].append(t)
    return index


def _part(token: str) -> int:
    return zlib.crc32(token.encode()) % PARTS


def thinned(transactions: DataFrame, least: int, confidence: float) -> tuple[list[str], DataFrame]:
    """Tokens that are rules by themselves, and the transactions without what can be in no other rule.

    A token with fewer than ``least`` bad pages is in no rule. One that suffices
    alone is in no longer rule. Of tokens on exactly the same pages one is enough
    (the shortest, then the first); otherwise every subset of them would count.
    """
    bad = F.array_contains("items", BAD).alias("bad")
    each = transactions.select(bad, F.xxhash64("items").alias("h"), F.explode(F.array_remove("items", BAD)).alias("token"))
    counts = each.groupBy("token").agg(F.count("*").alias("n"), F.count_if("bad").alias("k"), F.bit_xor("h").alias("x"), F.sum(F.col("h") % 1_000_003).alias("s")).where(F.col("k") >= least)
    rows = sorted(counts.collect(), key=lambda r: (len(r["token"]), r["token"]))  # each is in a share of the pages: some ten thousand at most
    alone = [r["token"] for r in rows if r["k"] >= confidence * r["n"]]
    first = {(r["n"], r["k"], r["x"], r["s"]): r["token"] for r in reversed(rows) if r["k"] < confidence * r["n"]}
    index = F.from_json(F.lit(json.dumps(_file(list(first.values())))), "array<array<string>>")
    useful = lambda t: F.array_contains(F.get(index, (F.crc32(t.cast("binary")) % PARTS).cast("int")), t)
    return alone, transactions.select(F.filter("items", lambda t: (t == BAD) | useful(t)).alias("items"))


def mine(transactions: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, least: int = LEAST_PAGES) -> list[list[str]]:
    """Token combinations that imply a bad label; all that hold no shorter one, but for tokens that always come with another."""
    total = transactions.count()
    if not total:
        return []
    floor = min(1.0, max(support, least / total))
    alone, rest = thinned(transactions, math.ceil(floor * total), confidence)
    kept = [[t] for t in sorted(alone)]
    model = FPGrowth(itemsCol="items", minSupport=floor, minConfidence=confidence).fit(rest)
    found = model.associationRules.where((F.size("consequent") == 1) & (F.get("consequent", F.lit(0)) == BAD))
    rest = stored(found.select(F.array_sort("antecedent").alias("rule")))
    for n in range(1, (rest.agg(F.max(F.size("rule"))).first()[0] or 0) + 1):
        level = sorted(r["rule"] for r in rest.where(F.size("rule") == n).collect())
        if level:
            kept += level
            rest = rest.where((F.size("rule") > n) & ~_holds(F.col("rule"), level))
    return kept


def _holds(has: Column, rules: list[list[str]]) -> Column:
    """Whether all tokens of some rule are in ``has``, by the inverted index."""
    often: dict[str, int] = {}
    for r in rules:
        for t in r:
            often[t] = often.get(t, 0) + 1
    index: list[list[list[str]]] = [[] for _ in range(PARTS)]
    for r in rules:
        index[_part(min(r, key=lambda t: (often[t], t)))].append(r)
    literal = F.from_json(F.lit(json.dumps(index)), "array<array<array<string>>>")  # folded to a literal once
    part = lambda t: F.get(literal, (F.crc32(t.cast("binary")) % PARTS).cast("int"))
    return F.exists(has, lambda t: F.exists(part(t), lambda r: F.size(F.array_except(r, has)) == 0))


def matches(url: Column, rules: list[list[str]]) -> Column:
    """Whether all tokens of some rule are in the URL."""
    return _holds(tokens(url), rules) if rules else F.lit(False)


def judge(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of ``pages``.

    A null url, or one without ://, has an empty host and path and no rule; its
    tokens are none, so it is allowed. Pages that no fixed and no mined rule fits
    are allowed. Repeated rows are judged alike; null page_ids stay; no rows give
    no rows; without labels only the fixed rules decide; other columns are ignored.
    """
    rules = mine(bad_pages(pages, labels))
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    seen = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("u")).withColumns({"host": host_of(F.col("u")), "path": path_of(F.col("u"))})
    rule, verdict = fixed_rule(F.col("host"), F.col("path"))
    mined = F.when(matches(F.col("u"), rules), F.lit("block")).otherwise(F.lit("allow"))
    return seen.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, mined).alias("verdict"))
