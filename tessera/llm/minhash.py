"""Near-duplicates by Jaccard similarity of word shingles, found with bottom-k sketches.

One hash function orders all shingles; a document's sketch is its ``SKETCH`` lowest
hashes. Documents with equal sets are one class. The lowest retained values of each
class are inverted into lists of the classes that hold them; classes of one short
list are candidates, the bottom of the union of both sketches estimates their
similarity, and what passes is confirmed on the full sets.

Linked sets share at least ``needed(m)`` of the m lowest values of their union, but
for a chance of ``MISS``. A class with fewer of its values in long lists thus shares a
short list with whatever it is linked with. Classes with more values there (those
made of passages that many share) post their whole sketch, where the same holds. What
is left then consists almost wholly of common passages; of its long lists a prefix has
to be compared, rare lists first. Lists are compared with one pivot each, in rounds:
those within one component need no more, and when pivots bring few more links, the
classes outside a list's main component are compared with the others of the list, as
far as the shingles that they share with any other allow a link.
"""

from __future__ import annotations

import math
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import lookup, raw_text, stored
from tessera.llm.components import components

SHINGLE = 5
SEED = 42
#: Linked from this Jaccard similarity on, in hundredths.
SIMILAR = 85
#: Retained values, and how many of them are inverted at first.
SKETCH = 128
FIRST = 24
#: A list of more classes is long; each posting of a short one makes half as many candidates at most.
SHORT = 32
#: Chance that a linked pair shares fewer values than ``needed``.
MISS = 1e-12
#: Rounds of pivots before the rest is compared directly; they end when fewer than one in ``HELPFUL`` comparisons links.
ROUNDS = 6
HELPFUL = 4
#: Rows of one key that one task joins; keys of more have copies of their value.
SHARE = 1_000
#: Classes of one side that a task compares with as many of the other.
TOGETHER = 256
#: So many ids of wanted texts are broadcast (some 24 MB); more are joined by shuffle.
BROADCAST = 1_000_000


def shingle_set(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles. A-Z are lower-cased; fewer words than a shingle are one; no words give none."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.int64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_digest
    if len(words) <= shingle:
        each = [digest(joined, SEED)]
    else:
        ends = list(accumulate(len(w) + 1 for w in words))
        each = [digest(joined[s : e - 1], SEED) for s, e in zip([0, *ends], ends[shingle - 1 :])]
    return np.unique(np.frombuffer(b"".join(each), np.int64))


def needed(m: int, similar: int = SIMILAR) -> int:
    """How many of the m lowest values of a union a linked pair shares at least, but for a chance of ``MISS``.

    Without replacement the tail is lighter than the binomial one that is summed here.
    """
    p, below = similar / 100, 0.0
    for x in range(m + 1):
        below += math.exp(math.lgamma(m + 1) - math.lgamma(x + 1) - math.lgamma(m - x + 1) + x * math.log(p) + (m - x) * math.log(1 - p))
        if below > MISS:
            return x
    return m


def sketches(docs: DataFrame, sketch: int = SKETCH) -> DataFrame:
    """doc_id, h (the text's hash), c1 and c2 (128 bits of the set), n (its size) and values (its lowest hashes, rising) of every row."""

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                sets = [shingle_set(t) for t in part.column(2).to_pylist()]
                keys = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
                low = [s[:sketch] for s in sets]
                values = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(v) for v in low])], pa.int32()), pa.array(np.concatenate(low)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(keys[:, i].copy()) for i in (0, 1)), pa.array([len(s) for s in sets], pa.int64()), values], ["doc_id", "h", "c1", "c2", "n", "values"])

    texts = docs.select(F.col("doc_id").cast("long"), F.xxhash64(raw_text()).alias("h"), raw_text().alias("t"))
    return texts.mapInArrow(run, "doc_id long, h long, c1 long, c2 long, n long, values array<long>")


def spread(rows: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """``rows`` joined with ``values``, which has one row for each key; no task meets more than some ``SHARE`` rows of a key.

    Keys of more rows are broadcast with the number of their copies: at most one for
    each ``SHARE`` rows.
    """
    heavy = stored(rows.groupBy(key).count().where(F.col("count") > SHARE).select(key, F.ceil(F.col("count") / SHARE).cast("int").alias("_copies")))
    if heavy.isEmpty():
        return rows.join(values, key)
    copies = F.coalesce("_copies", F.lit(1))
    dealt = rows.join(F.broadcast(heavy), key, "left").withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), copies).cast("int")).drop("_copies")
    copied = values.join(F.broadcast(heavy), key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), copies - 1))).drop("_copies")
    return dealt.join(copied, [key, "_salt"]).drop("_salt")


def _close(x: Column, y: Column, similar: int) -> Column:
    """Whether two set sizes allow the similarity."""
    return F.least(x, y) * 100 >= F.greatest(x, y) * similar


class Finder:
    """One run over the classes ``sets`` (id, n, values, and doc_id and h of a row) of ``docs``."""

    def __init__(self, docs: DataFrame, sets: DataFrame, similar: int, first: int, sketch: int, short: int):
        self.docs, self.sets, self.similar, self.short = docs, sets, similar, short
        self.levels = sorted({min(first, sketch), sketch})
        self.sketch = sketch
        self.texts: DataFrame | None = None

    def least_shared(self, m: int) -> Column:
        """How many inverted values a class shares at least with whatever it is linked with; sets that fit are counted exactly."""
        exact = F.ceil(F.col("n") * self.similar / 100)
        return F.when(F.col("n") * 100 <= m * self.similar, exact).otherwise(needed(m, self.similar))

    def lists(self, sets: DataFrame, m: int) -> DataFrame:
        """(v, id, n, length) of the m lowest values that several classes hold."""
        posted = sets.select("id", "n", F.explode(F.slice("values", 1, m)).alias("v"))
        held = stored(posted.groupBy("v").agg(F.count("*").alias("length")).where("length > 1"))
        return stored(lookup(posted, held.withColumn("rows", F.col("length")), "v", "rows"))

    def prefixes(self, long: DataFrame) -> DataFrame:
        """Of the classes that may share long lists alone, the rows that have to be compared.

        Whatever such a class of r rows is linked with shares ``least_shared`` of them, so the
        first shared list, rare ones first, is among its first r - least_shared + 1, and
        among those of the other.
        """
        own = Window.partitionBy("id")
        ranked = long.withColumns({"rows": F.count("*").over(own), "nth": F.row_number().over(own.orderBy("length", "v")), "least": self.least_shared(self.posted)})
        return ranked.where((F.col("rows") >= F.col("least")) & (F.col("nth") <= F.col("rows") - F.col("least") + 1)).select("v", "id", "n")

    def short_pairs(self, lists: DataFrame) -> DataFrame:
        """(a, b), a > b, once for each pair of classes in a short list."""
        few = lists.where(F.col("length") <= self.short)
        x, y = (few.select("v", F.col("id").alias(i), F.col("n").alias(f"n_{i}")) for i in ("a", "b"))
        return x.join(y, "v").where((F.col("a") > F.col("b")) & _close(F.col("n_a"), F.col("n_b"), self.similar)).select("a", "b").distinct()

    def estimated(self, pairs: DataFrame) -> DataFrame:
        """(a, b, shared) of the pairs whose union sketch does not rule the similarity out; shared of its values are in both."""
        of = lambda i: self.sets.select(F.col("id").alias(i), F.col("values").alias(f"v_{i}"))
        both = spread(spread(pairs, of("a"), "a"), of("b"), "b")
        low = F.slice(F.array_sort(F.array_union("v_a", "v_b")), 1, self.sketch)
        both = both.select("a", "b", low.alias("low"), F.array_intersect("v_a", "v_b").alias("common"))
        both = both.select("a", "b", F.size("low").alias("size"), F.size(F.array_intersect("common", "low")).alias("shared"))
        bound = F.array(*(F.lit(needed(m, self.similar)) for m in range(self.sketch + 1)))
        return both.where(F.col("shared") >= F.get(bound, "size")).select("a", "b", (F.col("shared") / F.col("size")).alias("shared"))

    def fetch(self, ids: DataFrame) -> None:
        """Keep one text of each class in ``ids``."""
        wanted = stored(ids.distinct().join(self.sets.select("id", F.col("doc_id").alias("_d"), F.col("h").alias("_h")), "id"))
        if wanted.count() <= BROADCAST:
            wanted = F.broadcast(wanted)
        rows = self.docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(raw_text()).alias("h"), raw_text().alias("t"))
        rows = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("h") == F.col("_h"))).select("id", "t")
        self.texts = stored(rows.dropDuplicates(["id"]))

    def measured(self, pairs: DataFrame) -> DataFrame:
        """(a, b, common): how many shingles the full sets of each pair have in common, and whether that links them; kept."""
        similar = self.similar
        of = lambda i: self.texts.select(F.col("id").alias(i), F.col("t").alias(f"t_{i}"))

        def run(batches):
            for b in batches:
                sets: dict[int, np.ndarray] = {}
                common, linked = [], []
                for x, y, tx, ty in zip(*(b.column(c).to_pylist() for c in ("a", "b", "t_a", "t_b"))):
                    if len(sets) > 200:
                        sets.clear()
                    p, q = (sets[i] if i in sets else sets.setdefault(i, shingle_set(t)) for i, t in ((x, tx), (y, ty)))
                    common.append(_common(p, q))
                    linked.append(_similar(p, q, similar))
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(common, pa.int64()), pa.array(linked, pa.bool_())], ["a", "b", "common", "linked"])

        both = spread(spread(pairs.select("a", "b"), of("a"), "a"), of("b"), "b").select("a", "b", "t_a", "t_b")
        return stored(both.mapInArrow(run, "a long, b long, common long, linked boolean"))

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """The (a, b) whose full sets are similar enough; kept."""
        return self.measured(pairs).where("linked").select("a", "b")

    def links(self) -> DataFrame:
        """(a, b) of enough confirmed links that the components are those of all links."""
        sets, pairs = self.sets, []
        for m in self.levels:
            self.posted, lists = m, self.lists(sets, m)
            pairs.append(self.short_pairs(lists))
            long = stored(self.prefixes(lists.where(F.col("length") > self.short)))
            if long.isEmpty():
                long = None
                break
            sets = self.sets.join(long.select("id").distinct(), "id")
        near = pairs[0] if len(pairs) == 1 else pairs[0].union(pairs[1]).distinct()
        near = stored(self.estimated(near))
        ids = near.select(F.col("a").alias("id")).union(near.select(F.col("b").alias("id")))
        self.fetch(ids if long is None else ids.union(long.select("id")))
        best = stored(near.groupBy("a").agg(F.max(F.struct("shared", "b")).alias("m")).select("a", "m.b"))
        found = self.confirmed(best)
        rest = near.join(best, ["a", "b"], "left_anti").select("a", "b")
        found = found.union(self.confirmed(self.apart(rest, found)))
        return found if long is None else self.common_links(long, found)

    def apart(self, pairs: DataFrame, links: DataFrame) -> DataFrame:
        """The pairs that the links, one to a smaller id for each ``a``, do not join yet."""
        while True:
            above = spread(links, links.select(F.col("a").alias("b"), F.col("b").alias("up")), "b").select("a", "up")
            if above.isEmpty():
                break
            links = stored(links.join(above, "a", "left").select("a", F.coalesce("up", "b").alias("b")))
        for i in ("a", "b"):
            pairs = pairs.join(links.select(F.col("a").alias(i), F.col("b").alias(f"r_{i}")), i, "left")
        return pairs.where(F.coalesce("r_a", "a") != F.coalesce("r_b", "b")).select("a", "b")

    def common_links(self, lists: DataFrame, found: DataFrame) -> DataFrame:
        """More links of the classes in the long ``lists`` (v, id, n), to be compared with each other.

        Linked sets have 85 / 185 of the sum of their sizes in common or more, and a class
        has no more in common with any other than ``common``, its shingles that others
        have. So classes with much of their own are left out at once, and a list's first
        pivot is the class with the least of its own, to which most of the others are near.
        """
        at = self.able(lists).withColumns({"root": F.col("id"), "with_p": F.lit(None).cast("long")})
        for r in range(ROUNDS):
            smallest = stored(at.groupBy("v").agg(F.min("n").alias("n_least"), F.count("*").alias("rows")))
            at = lookup(at, smallest, "v", "rows")
            other = F.greatest(F.ceil(F.col("n") * self.similar / 100), "n_least")
            at = stored(at.where(self.enough(F.col("common"), F.col("n") + other)).drop("n_least"))
            first = (F.col("n") - F.col("common")) / F.col("n") if r == 0 else F.lit(0.0)
            pivot = F.min(F.struct(first.alias("own"), F.xxhash64("id", F.lit(r)).alias("order"), "id", "n", "common", "root"))
            pivots = stored(at.groupBy("v").agg(pivot.alias("p"), F.count("*").alias("rows")))
            near = _close(F.col("n"), F.col("p.n"), self.similar) & self.enough(F.least("common", "p.common"), F.col("n") + F.col("p.n"))
            told = lookup(at, pivots, "v", "rows").withColumns({"a": F.greatest("id", "p.id"), "b": F.least("id", "p.id")})
            tried = stored(told.where((F.col("root") != F.col("p.root")) & near).select("a", "b").distinct())
            seen = self.measured(tried)
            new = seen.where("linked").select("a", "b")
            found = found.union(new)
            if r == 0:
                both = seen.select("a", "b", F.col("common").alias("with_p"))
                at = told.drop("with_p").join(both, ["a", "b"], "left").withColumn("with_p", F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(F.col("with_p")))
                at = stored(at.select("v", "id", "n", "common", "with_p", "root"))
            at = self.open_lists(at, found)
            if at.isEmpty():
                return found
            if new.count() * HELPFUL < tried.count():
                break
        return found.union(self.joined(stored(self.outside(at))))

    def able(self, lists: DataFrame) -> DataFrame:
        """The rows of ``lists``, with ``common``, of the classes that have enough in common with others to be linked at all; kept.

        Their rows are joined once and after that choice, as a class has up to ``sketch`` of them.
        """
        classes = lists.select("id", "n").distinct()
        least = F.col("n") + F.ceil(F.col("n") * self.similar / 100)
        some = self.common_sizes(classes.select("id")).join(classes, "id").where(self.enough(F.col("common"), least))
        return stored(lists.join(some.select("id", "common"), "id"))

    def enough(self, common: Column, sizes: Column) -> Column:
        """Whether so many common shingles suffice for a link between sets of so many in all."""
        return common * (100 + self.similar) >= sizes * self.similar

    def open_lists(self, at: DataFrame, found: DataFrame) -> DataFrame:
        """The lists that hold several components of the links, with every row's root."""
        label = _labels(found).withColumnRenamed("node", "id")
        at = stored(at.drop("root").join(label, "id", "left").select("v", "id", "n", "common", "with_p", F.coalesce("root", "id").alias("root")))
        several = at.groupBy("v").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("rows")).where("lo < hi")
        return stored(lookup(at, stored(several.select("v", "rows")), "v", "rows"))

    def outside(self, at: DataFrame) -> DataFrame:
        """(a, b, r) of the classes outside a list's main component with those of its other components r that they can be linked with.

        Two sets that were measured against one pivot have in common at most the lesser of what
        each has of the pivot, and the lesser of what each has besides that others have too.
        A pair meets in the first list alone that holds both: each list tells one class outside its
        main component from the other of any two components, and any list's bounds are exact.
        """
        size = at.groupBy("v", "root").agg(F.count("*").alias("size"))
        main = stored(size.groupBy("v").agg(F.max(F.struct("size", "root")).alias("m"), F.sum("size").alias("rows")).select("v", F.col("m.root").alias("main"), "rows"))
        of = F.array_sort(F.collect_list("v").over(Window.partitionBy("id")))  # of retained values, so few
        at = stored(lookup(at, main, "v", "rows").withColumn("lists", of))
        x = at.where("root <> main").select("v", F.col("lists").alias("l_a"), F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("root").alias("r_a"), F.col("common").alias("c_a"), F.col("with_p").alias("p_a"))
        y = at.select("v", F.col("lists").alias("l_b"), F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("root").alias("r"), F.col("common").alias("c_b"), F.col("with_p").alias("p_b"), (F.col("root") == F.col("main")).alias("in_main"))
        most = F.least("c_a", "c_b")
        by_pivot = F.least("p_a", "p_b") + F.least(F.col("c_a") - F.col("p_a"), F.col("c_b") - F.col("p_b"))
        most = F.when(F.col("p_a").isNotNull() & F.col("p_b").isNotNull(), F.least(most, by_pivot)).otherwise(most)
        able = _close(F.col("n_a"), F.col("n_b"), self.similar) & self.enough(most, F.col("n_a") + F.col("n_b"))
        first = F.get(F.array_intersect("l_a", "l_b"), F.lit(0)) == F.col("v")
        return x.join(y, "v").where((F.col("r_a") != F.col("r")) & (F.col("in_main") | (F.col("a") > F.col("b"))) & able & first).select("a", "b", "r")

    def common_sizes(self, ids: DataFrame) -> DataFrame:
        """(id, common): how many shingles of its full set a class shares with any other of ``ids``."""

        def run(batches):
            for b in batches:
                for lo in range(0, b.num_rows, 200):
                    part = b.slice(lo, 200)
                    sets = [shingle_set(t) for t in part.column(1).to_pylist()]
                    own = np.repeat(part.column(0).to_numpy(), [len(s) for s in sets])
                    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.concatenate(sets))], ["id", "v"])

        posted = stored(self.texts.join(ids, "id", "left_semi").select("id", "t").mapInArrow(run, "id long, v long"))
        held = stored(posted.groupBy("v").agg(F.count("*").alias("rows")).where("rows > 1"))
        return lookup(posted, held, "v", "rows").groupBy("id").agg(F.count("*").alias("common"))

    def joined(self, pairs: DataFrame) -> DataFrame:
        """(a, b): one confirmed link at most from each class ``a`` of ``pairs`` to each block of a component r; kept.

        A component's members and the classes compared with it are dealt into blocks of
        some ``TOGETHER``, and a text is sent once to each pair of blocks that needs it.
        """
        blocks = lambda c: F.ceil(F.count_distinct(c) / TOGETHER).cast("int")
        many = stored(pairs.groupBy("r").agg(blocks("a").alias("n_a"), blocks("b").alias("n_b")).where("n_a > 1 or n_b > 1"))
        dealt = lambda c: F.pmod(F.xxhash64(c), F.coalesce(f"n_{c}", F.lit(1))).alias(f"k_{c}")
        where = ["r", "k_a", "k_b"]
        pairs = stored(pairs.join(F.broadcast(many), "r", "left").select("r", dealt("a"), dealt("b"), "a", "b"))
        ids = pairs.select(*where, F.col("a").alias("id")).union(pairs.select(*where, F.col("b").alias("id"))).distinct()
        none = F.lit(None)
        rows = spread(ids, self.texts, "id").select(*where, "id", "t", none.cast("long").alias("b"))
        rows = rows.union(pairs.select(*where, "a", none.cast("binary"), "b"))
        similar = self.similar

        def run(t: pa.Table) -> pa.Table:
            text = t.filter(pc.is_valid(t["t"]))
            sets = {i: shingle_set(x) for i, x in zip(text["id"].to_pylist(), text["t"].to_pylist())}
            links: dict[int, int] = {}
            told = t.filter(pc.is_valid(t["b"])).sort_by([("id", "ascending"), ("b", "ascending")])
            for a, b in zip(told["id"].to_pylist(), told["b"].to_pylist()):
                if a not in links and _similar(sets[a], sets[b], similar):
                    links[a] = b
            return pa.table({"a": pa.array(links.keys(), pa.int64()), "b": pa.array(links.values(), pa.int64())})

        return stored(rows.groupBy(*where).applyInArrow(run, "a long, b long"))


def _common(p: np.ndarray, q: np.ndarray) -> int:
    """How many values two sorted sets have in common."""
    return len(p) + len(q) - len(np.unique(np.concatenate([p, q])))


def _similar(p: np.ndarray, q: np.ndarray, similar: int) -> bool:
    """Whether the Jaccard similarity of two sorted sets is ``similar`` hundredths or more."""
    common = _common(p, q)
    return 100 * common >= similar * (len(p) + len(q) - common)


def _labels(links: DataFrame) -> DataFrame:
    return components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))


def near_duplicates(docs: DataFrame, similar: int = SIMILAR, first: int = FIRST, sketch: int = SKETCH, short: int = SHORT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs``.

    component_id is the smallest doc_id reachable over links of sets of five-word
    shingles with a Jaccard similarity of ``similar`` hundredths or more; kept says
    that it is the row's own. Null and empty texts have no shingles and are linked
    with nothing, not even each other. Repeated rows are in one component and kept
    alike. A null doc_id is no candidate for component_id, which is null where a
    component has no other; such rows are kept. Ties of the similarity are linked.
    No rows give no rows; other columns are ignored.
    """
    marked = stored(sketches(docs, sketch))
    sets = marked.where("n > 0").groupBy("c1", "c2", "n").agg(F.count("*").alias("rows"), F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "h")).alias("one"), F.first("values").alias("values"))
    sets = stored(sets.select(F.monotonically_increasing_id().alias("id"), "c1", "c2", "n", "rows", "least", "one.doc_id", "one.h", "values"))
    label = stored(_labels(Finder(docs, sets, similar, first, sketch, short).links()))
    rooted = sets.select("id", "c1", "c2", "rows", "least").join(label.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    rooted = stored(rooted)
    joint = stored(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")))
    ids = stored(lookup(rooted, joint, "root").select("c1", "c2", "component_id", F.col("rows").alias("n")))
    some = lookup(marked.where("n > 0").select("doc_id", "c1", "c2", F.col("n").alias("n_shingles")), ids, ["c1", "c2"]).select("doc_id", "n_shingles", "component_id")
    none = marked.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return some.unionByName(none).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))
