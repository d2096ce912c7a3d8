"""Quality rules whose cutoffs are certified on labelled documents.

Each rule rejects a document whose statistic lies above a cutoff. The cutoffs of all
rules go from lenient to strict together, in one fixed sequence of steps. On each
stratum's labelled good documents a step is certified if so few of them are rejected
by any rule that, were the true rate of false rejections ``RISK`` or more, seeing so
few had an exact binomial probability of at most ``LEVEL`` / strata. Testing a stratum
ends with its first failure (fixed-sequence testing); strata share the level
(Bonferroni). So with confidence 1 - ``LEVEL`` no stratum loses more than ``RISK`` of
its good documents by these rules. How many labels that takes is up to the test alone:
with four strata some 86, if no step rejects one of them. A stratum without a
certified step has the base alone.

Statistics, tests and verdicts are built-in expressions. Statistics are computed
once and stored; no text is shuffled, only the labels, the statistics that they
meet and the counts of the tests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD_GAP, stored, text_of

RISK = 0.05
LEVEL = 0.05
BASE_WORDS = 20
BASE_REPEAT_PERCENT = 30
WINDOW = 8
#: Rules with their cutoffs by step, lenient to strict; a rule with fewer stays at its last.
RULES = {
    "symbol_rate": (2.0, 1.5, 1.0, 0.75, 0.5, 0.35, 0.25, 0.15, 0.1, 0.05),
    "capital_rate": (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15),
    "mark_rate": (2.0, 1.5, 1.0, 0.75, 0.5, 0.35, 0.25, 0.15, 0.1, 0.05),
    "line_rate": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2),
    "repeat_rate": (0.28, 0.25, 0.22, 0.2, 0.15, 0.1, 0.05),
}


def _rate(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))


def _length_without(text: str, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, ""))


def _bind(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once even where the optimizer moves the whole into a filter."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words in windows of ``WINDOW`` hashed words that occur twice or more in the text."""
    starts = F.sequence(F.lit(0), F.size(words) - WINDOW)
    windows = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))

    def covered(marked: Column) -> Column:
        twin = lambda x, i: (x["h"] == F.get(marked, i - 1)["h"]) | (x["h"] == F.get(marked, i + 1)["h"])
        found = F.array_sort(F.transform(F.filter(marked, twin), lambda x: x["i"]))
        begin = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("at"))
        return F.aggregate(found, begin, lambda s, i: F.struct((s["n"] + F.least(F.lit(WINDOW), i - s["at"])).alias("n"), i.alias("at")), lambda s: s["n"])

    def count(hashes: Column) -> Column:
        marked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(hashes) > F.size(F.array_distinct(hashes)), _bind(marked, covered)).otherwise(0)

    return _bind(windows, count)


def statistics(docs: DataFrame, *keep: Column) -> DataFrame:
    """``keep`` and the statistics of every row's whole text."""
    df = docs.select(*keep, text_of().alias("t"))
    df = df.withColumn("w", F.array_remove(F.split("t", WORD_GAP), ""))
    df = df.withColumns(
        {
            "n_words": F.size("w").cast("long"),
            "word_chars": F.length(F.translate("t", " \t\n\x0b\f\r", "")).cast("long"),
            "n_symbols": (F.length("t") - F.length(F.translate("t", "#*$%&|<>", ""))).cast("long"),
            "marks": F.length("t") - F.length(F.translate("t", "!", "")),
            "capitals": F.length("t") - _length_without("t", r"\p{Lu}+"),
            "lines": F.filter(F.split("t", "\n"), lambda x: F.ltrim(x, F.lit(" \t\x0b\f\r")) != ""),
            "wh": F.transform("w", lambda x: F.xxhash64(x)),
        }
    ).drop("t", "w")
    df = df.withColumns(
        {
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
            "n_lines": F.size("lines"),
            "n_repeat_words": F.when(F.col("n_words") > WINDOW, _bind(F.col("wh"), _repeat_words)).otherwise(0).cast("long"),
        }
    ).drop("lines", "wh")
    n = F.col("n_words")
    return df.withColumns(
        {
            "base_failed": (n < BASE_WORDS) | (100 * F.col("n_repeat_words") > BASE_REPEAT_PERCENT * n),
            "symbol_rate": _rate(F.col("n_symbols"), n),
            "capital_rate": _rate(F.col("capitals"), F.col("word_chars")),
            "mark_rate": _rate(F.col("marks"), n),
            "line_rate": _rate(F.col("n_dup_lines"), F.col("n_lines")),
            "repeat_rate": _rate(F.col("n_repeat_words"), n),
        }
    )


def binomial_tail(n: str, k: str, rate: float) -> Column:
    """P(X <= k) for X ~ Bin(n, rate): the logarithm of the last term, and the sum's ratio to it, which is at least 1."""
    first = f"{n} * ln(1 - {rate}D)"
    odds = f"(({n} - i + 1) / i * {rate / (1 - rate)}D)"
    step = f"(s, i) -> named_struct('log', s.log + ln({odds}), 'ratio', 1D + s.ratio / {odds})"
    total = f"aggregate(sequence(1L, {k}), named_struct('log', {first}, 'ratio', 1D), {step}, s -> exp(s.log + ln(s.ratio)))"
    return F.expr(f"CASE WHEN {k} = 0 THEN exp({first}) WHEN {k} > {n} * {rate}D THEN 1D ELSE {total} END")


def labelled(labels: DataFrame) -> DataFrame:
    """All good documents' ids. A document with several labels counts with its lowest."""
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    return known.where("quality = 1").select("doc_id")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang (null as empty) and the statistics of every row, stored."""
    return stored(statistics(docs, F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang"), F.lit("")).alias("lang")))


STEPS = max(map(len, RULES.values()))


def cutoff(rule: str, step: int) -> float:
    return RULES[rule][min(step, len(RULES[rule]) - 1)]


def tests(seen: DataFrame, labels: DataFrame) -> DataFrame:
    """Each stratum's and step's test: n, k (rejected by any rule), p, and whether the sequence is certified so far.

    A labelled id counts once in a stratum, however many rows it has; of different
    rows each rule sees the highest value.
    """
    rows = seen.select("doc_id", "lang", "base_failed", *RULES).join(labelled(labels), "doc_id").where(~F.col("base_failed"))
    good = rows.groupBy("doc_id", "lang").agg(*[F.max(rule).alias(rule) for rule in RULES])
    broken = []
    for step in range(STEPS):
        by_any = F.lit(False)
        for rule in RULES:
            by_any = by_any | (F.col(rule) > cutoff(rule, step))
        broken.append(F.count_if(by_any).alias(f"k{step}"))
    counts = good.groupBy(F.col("lang").alias("stratum")).agg(F.count("*").alias("n"), *broken)
    each = counts.select("stratum", "n", F.posexplode(F.array(*[f"k{step}" for step in range(STEPS)])).alias("step", "k"))
    tried = each.withColumn("p", binomial_tail("n", "k", RISK))
    shared = F.size(F.collect_set("stratum").over(Window.partitionBy(F.lit(1))))  # strata x steps, some hundred rows
    so_far = Window.partitionBy("stratum").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return tried.withColumn("certified", F.min((F.col("p") <= LEVEL / shared).cast("int")).over(so_far) == 1)


def cutoffs(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, dict[str, float]], list[str]]:
    """rule -> stratum -> cutoff of its strictest certified step, and the strata that have one."""
    return _cutoffs(measured(docs), labels)


def _cutoffs(seen: DataFrame, labels: DataFrame) -> tuple[dict[str, dict[str, float]], list[str]]:
    steps = {r["stratum"]: r["step"] for r in tests(seen, labels).where("certified").groupBy("stratum").agg(F.max("step").alias("step")).collect()}
    return {rule: {stratum: cutoff(rule, step) for stratum, step in steps.items()} for rule in RULES}, sorted(steps)


def quality_verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept of every row.

    Null and empty texts have no words and fail the base. Strata are languages,
    null being one of its own. For a language whose labels certify no step the base
    alone decides.
    Repeated rows and null doc_ids are judged like others; no rows give no rows;
    other columns are ignored.
    """
    seen = measured(docs)
    found, _ = _cutoffs(seen, labels)
    broken = F.lit(False)
    for rule, cuts in found.items():
        if cuts:
            table = F.create_map(*[F.lit(x) for pair in sorted(cuts.items()) for x in pair])
            broken = broken | F.coalesce(F.col(rule) > F.try_element_at(table, F.col("lang")), F.lit(False))
    return seen.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~broken).alias("kept"))
