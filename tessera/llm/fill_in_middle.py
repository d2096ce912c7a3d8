"""Fill-in-middle transformation by a parallel scan of a finite automaton.

Lines, and whether a text holds one of the markers, are what one automaton over
UTF-8 bytes says. Texts are cut into blocks, and every block is run from all
states at once: it gives its transition function and, for each start state, how
many lines begin in it. Functions compose associatively, so a segmented scan of
them gives each block's entry state and line number, and the block with a wanted
line is selected and run again from its entry state. Texts longer than ``PIECE``
are cut into pieces that different tasks run; their functions are composed by
text, and only the pieces that hold a cut are run again. The output is assembled
from byte positions by built-in functions.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import lookup, raw_text, stored

#: Marks before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 7
#: Of a hundred documents, how many are rearranged, and how many of those have the suffix first.
RATE = 100
SUFFIX_FIRST = 50
#: Bytes of a piece, of a block, and of blocks that are run together.
PIECE = 1 << 16
BLOCK = 128
TOGETHER = 1 << 22


@dataclass(frozen=True)
class Automaton:
    """``step`` and ``begins`` are by state and class of byte; class 0 leaves the state as it is and stands for no byte."""

    classes: np.ndarray
    step: np.ndarray
    begins: np.ndarray
    found: np.ndarray


def automaton(markers: tuple[str, ...] = (PREFIX, SUFFIX, MIDDLE)) -> Automaton:
    """Lines and markers in one: a state is (inside a line, the longest beginning of a marker that was just read or found)."""
    marks = [m.encode() for m in markers]
    letters = sorted({b"\n"[0], *b"".join(marks)})
    classes = np.ones(256, np.uint8)
    classes[letters] = np.arange(2, len(letters) + 2)

    def after(seen: bytes | None, byte: bytes) -> bytes | None:
        if seen is None or any((seen + byte).endswith(m) for m in marks):
            return None
        return next(tail for i in range(len(seen) + 2) if any(m.startswith(tail := (seen + byte)[i:]) for m in marks))

    number, wait, rows = {(False, b""): 0}, deque([(False, b"")]), []
    other = bytes([next(b for b in range(128) if b not in letters)])
    while wait:
        inside, seen = wait.popleft()
        row = [number[inside, seen]]
        for byte in [other, *(bytes([x]) for x in letters)]:
            to = (byte != b"\n", after(seen, byte))
            if to not in number:
                number[to] = len(number)
                wait.append(to)
            row.append(number[to])
        rows.append(row)
    step = np.array(rows, np.uint8)
    states = list(number)
    kind = np.array([(2 if seen is None else 0) + inside for inside, seen in states])
    while True:  # states that no text tells apart are one
        _, first, same = np.unique(np.c_[kind, kind[step]], axis=0, return_index=True, return_inverse=True)
        if len(first) == len(np.unique(kind)):
            break
        kind = same.ravel()
    order = np.argsort(first)
    new = np.argsort(order)[same.ravel()].astype(np.uint8)
    keep = first[order]
    begins = np.zeros((len(keep), len(letters) + 2), bool)
    begins[[not states[k][0] for k in keep], 1:] = True
    return Automaton(classes, new[step[keep]], begins, np.array([states[k][1] is None for k in keep]))


def run_blocks(a: Automaton, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the blocks data[begin:end] of ``BLOCK`` bytes at most, by start state: the state after each, and the lines that begin in it."""
    states = len(a.step)
    width = a.step.shape[1]
    after = np.tile(np.arange(states, dtype=np.uint8), (len(begin), 1))
    count = np.zeros((len(begin), states), np.int64)
    part = np.zeros((len(begin), states), np.uint8)
    step, begins = a.step.ravel(), a.begins.ravel().astype(np.uint8)
    for j in range(int((end - begin).max(initial=0))):
        at = begin + j
        byte = np.where(at < end, a.classes[data[np.minimum(at, len(data) - 1)]], 0)
        key = after * np.uint8(width) + byte[:, None].astype(np.uint8)
        part += begins.take(key)
        after = step.take(key)
        if j % 250 == 249:
            count += part
            part[:] = 0
    return after, count + part


def entries(own: np.ndarray, after: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Compose functions of one owner in order: (state after, lines through) for state 0 at the owner's start, and each row's rank.

    Rows of an owner follow each other. A doubling scan: each row takes in the
    rows before it that it has not yet, as many as it has itself.
    """
    first = np.r_[True, own[1:] != own[:-1]] if len(own) else np.zeros(0, bool)
    rank = np.arange(len(own)) - np.maximum.accumulate(np.where(first, np.arange(len(own)), 0))
    after, count = after.astype(np.int64), count.copy()
    d = 1
    while d <= rank.max(initial=0):
        i = np.flatnonzero(rank >= d)
        count[i] = count[i - d] + np.take_along_axis(count[i], after[i - d], 1)
        after[i] = np.take_along_axis(after[i], after[i - d], 1)
        d *= 2
    return after[:, 0], count[:, 0], rank


def nth_line(a: Automaton, data: np.ndarray, begin: np.ndarray, end: np.ndarray, state: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """In the blocks data[begin:end] entered in ``state``, where the ``nth`` line (from 0) begins."""
    found = np.full(len(begin), -1)
    state, nth = state.astype(np.int64), nth.copy()
    for j in range(int((end - begin).max(initial=0))):
        at = begin + j
        byte = np.where(at < end, a.classes[data[np.minimum(at, len(data) - 1)]], 0)
        here = a.begins[state, byte]
        found = np.where(here & (nth == 0) & (found < 0), at, found)
        nth -= here
        state = a.step[state, byte].astype(np.int64)
    return found


class Scan:
    """The blocks of consecutive texts, run and composed."""

    def __init__(self, a: Automaton, data: np.ndarray, ends: np.ndarray, state: np.ndarray | None = None):
        """Texts of ``data`` end at ``ends``; where ``state`` is given they are entered in it, else in state 0."""
        self.a, self.data = a, data
        self.begins = np.r_[0, ends[:-1]].astype(np.int64)
        size = ends - self.begins
        blocks = -(-size // BLOCK)
        self.own = np.repeat(np.arange(len(size)), blocks)
        nth = np.arange(len(self.own)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        self.begin = self.begins[self.own] + nth * BLOCK
        self.end = np.minimum(self.begin + BLOCK, ends[self.own])
        self.after, self.count = run_blocks(a, data, self.begin, self.end)
        self.blocks, self.state = blocks, np.zeros(len(size), np.int64) if state is None else state
        self.first, self.last = np.cumsum(blocks) - blocks, np.cumsum(blocks) - 1

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        """Each text's function: by start state, the state after it and the lines that begin in it."""
        after = np.tile(np.arange(len(self.a.step)), (len(self.blocks), 1))
        count = np.zeros(after.shape, np.int64)
        some = self.blocks > 0
        for s in range(len(self.a.step)):
            to, n, _ = entries(self.own, *self._from(np.full(len(self.blocks), s)))
            after[some, s], count[some, s] = to[self.last[some]], n[self.last[some]]
        return after, count

    def _from(self, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Functions of which the first of each text starts in ``state``, whatever is asked."""
        after, count = self.after.copy(), self.count.copy()
        i = np.flatnonzero(self.blocks > 0)
        at = self.first[i]
        after[at] = self.after[at, state[i]][:, None]
        count[at] = self.count[at, state[i]][:, None]
        return after, count

    def entered(self) -> tuple[np.ndarray, np.ndarray]:
        """State and lines of each text at its end; what ``select`` needs is kept."""
        to, through, rank = entries(self.own, *self._from(self.state))
        head = rank == 0
        self.into = np.where(head, self.state[self.own], np.r_[0, to[:-1]])
        self.before = np.where(head, 0, np.r_[0, through[:-1]])
        self.through = through
        state, n = self.state.copy(), np.zeros(len(self.blocks), np.int64)
        some = self.blocks > 0
        state[some], n[some] = to[self.last[some]], through[self.last[some]]
        return state, n

    def select(self, nth: np.ndarray) -> np.ndarray:
        """Where in each text its ``nth`` line (from 0) begins; its size if it has no such line. After ``entered``."""
        size = np.bincount(self.own, self.end - self.begin, len(self.blocks)).astype(np.int64)
        # numbers of lines rise within a text: one sorted key for all texts
        span = int(max(self.through.max(initial=0), nth.max(initial=0))) + 2
        block = np.searchsorted(self.own * span + self.through, np.arange(len(nth)) * span + nth, side="right")
        there = (block < len(self.own)) & (self.own[np.minimum(block, max(0, len(self.own) - 1))] == np.arange(len(nth))) if len(self.own) else np.zeros(len(nth), bool)
        b = block[there]
        out = size
        out[there] = nth_line(self.a, self.data, self.begin[b], self.end[b], self.into[b], nth[there] - self.before[b]) - self.begins[there]
        return out

    def points(self) -> np.ndarray:
        """Code points before each byte, and in all."""
        return np.r_[0, np.cumsum((self.data & 0xC0) != 0x80)]


def _parts(texts: pa.Array):
    """(from, to) of rows that together have some ``TOGETHER`` bytes."""
    size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + TOGETHER)))
        yield lo, hi
        lo = hi


def _join(texts: list) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"".join(texts), np.uint8)
    return data, np.cumsum([len(t) for t in texts]).astype(np.int64)


_CUTS = "n long, found boolean, a long, b long, a_chars long, b_chars long"


def _whole_cuts(a: Automaton):
    """Of a text and two numbers: its lines, whether it holds a marker, and where the smaller and the larger number modulo n + 1 cut it."""

    def cuts(text: pa.Array, x: pa.Array, y: pa.Array) -> pa.Array:
        columns = [[] for _ in range(6)]
        for lo, hi in _parts(text):
            data, ends = _join(text.slice(lo, hi - lo).to_pylist())
            scan = Scan(a, data, ends)
            state, n = scan.entered()
            two = [np.asarray(v.slice(lo, hi - lo)) % (n + 1) for v in (x, y)]
            points = scan.points()
            cut = [scan.select(v) for v in (np.minimum(*two), np.maximum(*two))]
            chars = [points[scan.begins + c] - points[scan.begins] for c in cut]
            for out, new in zip(columns, (n, a.found[state], *cut, *chars)):
                out.append(pa.array(new))
        names = [f.split()[0] for f in _CUTS.split(", ")]
        return pa.StructArray.from_arrays([pa.concat_arrays(c) for c in columns], names)

    return F.arrow_udf(cuts, _CUTS)


def _piece_functions(a: Automaton):
    def run(batches):
        for batch in batches:
            texts = batch.column(2)
            for lo, hi in _parts(texts):
                part = batch.slice(lo, hi - lo)
                scan = Scan(a, *_join(part.column(2).to_pylist()))
                after, count = scan.whole()
                points = scan.points()
                chars = np.diff(points[np.r_[scan.begins, len(scan.data)]])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(after.tolist(), pa.list_(pa.int64())), pa.array(count.tolist(), pa.list_(pa.int64())), pa.array(chars)], ["key", "piece", "bytes", "after", "count", "chars"])

    return run


_COMPOSED = "key string, lines long, found boolean, through array<long>, state array<long>, base array<long>, chars array<long>"


def _compose(a: Automaton):
    """The functions of one text's pieces -> its lines, whether it holds a marker, and by piece the lines, state, bytes and code points behind it."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("piece")
        to, through, _ = entries(np.zeros(t.num_rows, np.int64), np.array(t["after"].to_pylist()), np.array(t["count"].to_pylist()))
        behind = [through, to, *(np.cumsum(t[c].to_numpy()) for c in ("size", "chars"))]
        lists = [pa.array([x.tolist()], pa.list_(pa.int64())) for x in behind]
        return pa.Table.from_arrays([t["key"].slice(0, 1).combine_chunks(), pa.array([int(through[-1])]), pa.array([bool(a.found[to[-1]])]), *lists], ["key", "lines", "found", "through", "state", "base", "chars"])

    return run


def _piece_cuts(a: Automaton):
    """The ``nth`` line of a piece entered in ``state``: where in it that begins, and the code points before."""

    def cuts(texts: pa.Array, state: pa.Array, nth: pa.Array) -> pa.Array:
        columns = [[], []]
        for lo, hi in _parts(texts):
            into, want = (np.asarray(v.slice(lo, hi - lo)) for v in (state, nth))
            scan = Scan(a, *_join(texts.slice(lo, hi - lo).to_pylist()), into)
            scan.entered()
            at, points = scan.select(want), scan.points()
            for out, new in zip(columns, (at, points[scan.begins + at] - points[scan.begins])):
                out.append(pa.array(new))
        return pa.StructArray.from_arrays([pa.concat_arrays(c) for c in columns], ["at", "points"])

    return F.arrow_udf(cuts, "at long, points long")


def _giant_cuts(rows: DataFrame, a: Automaton, piece: int) -> DataFrame:
    """(key, x, y, n_rows, cuts) of texts that several tasks run: key is the text's digest; copies of a text are run once."""
    cut = F.transform(F.sequence(F.lit(0), ((F.length("t") - 1) / piece).cast("int")), lambda i: F.substring(F.col("t"), i * piece + 1, F.lit(piece)))
    pieces = rows.select("key", F.posexplode(cut).alias("piece", "bytes")).groupBy("key", "piece").agg(F.first("bytes").alias("bytes"))
    run = stored(pieces.mapInArrow(_piece_functions(a), "key string, piece int, bytes binary, after array<long>, count array<long>, chars long"))
    numbers = stored(rows.groupBy("key", "x", "y").agg(F.count("*").alias("n_rows")))
    functions = run.select("key", "piece", "after", "count", "chars", F.length("bytes").cast("long").alias("size"))
    composed = functions.groupBy("key").applyInArrow(_compose(a), _COMPOSED)
    composed = stored(composed.join(numbers.groupBy("key").agg(F.count("*").alias("n")), "key"))

    both = lookup(numbers, composed, "key").withColumn("nth", F.explode(F.array(F.col("x") % (F.col("lines") + 1), F.col("y") % (F.col("lines") + 1))))
    both = both.withColumn("piece", F.size(F.filter("through", lambda v: v <= F.col("nth"))))
    before = lambda c: F.coalesce(F.get(c, F.col("piece") - 1), F.lit(0)).alias(c)
    both = both.select("key", "x", "y", "n_rows", "lines", "found", F.concat_ws(" ", "key", "piece").alias("where"), (F.col("nth") - before("through")).alias("nth"), *(before(c) for c in ("state", "base", "chars")))
    both = stored(both)
    held = both.groupBy("where").agg(F.count("*").alias("n"))
    held = held.join(run.select(F.concat_ws(" ", "key", "piece").alias("where"), "bytes"), "where")
    inside = lookup(both, held, "where").withColumn("cut", _piece_cuts(a)("bytes", "state", "nth"))
    inside = inside.select("key", "x", "y", "n_rows", "lines", "found", (F.col("base") + F.col("cut.at")).alias("base"), (F.col("chars") + F.col("cut.points")).alias("chars"))
    # a cut behind the last line is the text's end and lies in no piece
    behind = both.join(held.select("where"), "where", "left_anti").select(inside.columns)
    ends = inside.unionByName(behind).groupBy("key", "x", "y", "n_rows", "lines", "found").agg(*(f(c).alias(n) for c, x, y in (("base", "a", "b"), ("chars", "a_chars", "b_chars")) for f, n in ((F.min, x), (F.max, y))))
    return ends.select("key", "x", "y", "n_rows", F.struct(F.col("lines").alias("n"), "found", "a", "b", "a_chars", "b_chars").alias("cuts"))


def numbers(doc_id: Column, seed: int = SEED) -> list[Column]:
    """The first four 8-digit groups of the hex sha256 of "seed:doc_id", as numbers; a null id is no digits."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, piece: int = PIECE) -> DataFrame:
    """doc_id, n (lines), form, prefix_chars, middle_chars and output of every row of ``docs``.

    Whole texts, cut at ends of lines chosen by the id. Form is plain, psm or spm;
    plain texts (empty ones, ones that hold a marker, and ids outside the rate) stay
    as they are, with null for both lengths. A null text is empty. A null doc_id
    is cut like an id without digits. Repeated rows give repeated rows; ids with
    several texts cut each by its own lines; no rows give no rows; other columns
    are ignored.
    """
    a = automaton()
    x, y, h3, h4 = numbers(F.col("doc_id").cast("long"), seed)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw_text().alias("t"), x.alias("x"), y.alias("y"), (h3 % 100 < rate).alias("chosen"), (h4 % 100 < suffix_first).alias("turned"))
    small = rows.where(F.length("t") <= piece).withColumn("cuts", _whole_cuts(a)("t", "x", "y"))
    large = rows.where(F.length("t") > piece).withColumn("key", F.sha2("t", 256))
    if large.isEmpty():
        return _assemble(small)
    place = F.concat_ws(" ", "key", "x", "y").alias("place")
    cuts = _giant_cuts(large, a, piece).select(place, "cuts", "n_rows")
    whole = lookup(large.select("*", place), cuts, "place", "n_rows").select(small.columns)
    return _assemble(small.unionByName(whole))


def _assemble(rows: DataFrame) -> DataFrame:
    cut = lambda name: F.col(f"cuts.{name}")
    t = F.col("t")
    part = lambda lo, n: F.substring(t, (lo + 1).cast("int"), n.cast("int"))
    prefix, middle, suffix = part(F.lit(0), cut("a")), part(cut("a"), cut("b") - cut("a")), part(cut("b"), F.length(t) - cut("b"))
    mark = lambda m: F.lit(m).cast("binary")
    psm = F.concat(mark(PREFIX), prefix, mark(SUFFIX), suffix, mark(MIDDLE), middle)
    spm = F.concat(mark(SUFFIX), suffix, mark(PREFIX), prefix, mark(MIDDLE), middle)
    form = F.when((F.length(t) == 0) | cut("found") | ~F.col("chosen"), "plain").when(F.col("turned"), "spm").otherwise("psm")
    rows = rows.withColumn("form", form)
    moved = F.col("form") != "plain"
    return rows.select(
        "doc_id",
        cut("n").alias("n"),
        "form",
        F.when(moved, cut("a_chars")).alias("prefix_chars"),
        F.when(moved, cut("b_chars") - cut("a_chars")).alias("middle_chars"),
        F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(t).cast("string").alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text that a transformed one was made from, by its markers alone: it holds none itself, so each occurs once."""
    head = F.substring_index(output, MIDDLE, 1)
    middle = F.substring(output, F.length(head) + 1 + len(MIDDLE), F.length(output))

    def sides(first: str, second: str) -> tuple[Column, Column]:
        left = F.substring(F.substring_index(head, second, 1), F.lit(len(first) + 1), F.length(head))
        return left, F.substring(head, F.length(left) + len(first) + len(second) + 1, F.length(head))

    (prefix, suffix), (back, front) = sides(PREFIX, SUFFIX), sides(SUFFIX, PREFIX)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(front, middle, back)).otherwise(output)


def digests(made: DataFrame) -> DataFrame:
    """``fill_in_middle``'s rows with digests of the output and of the text rebuilt from it instead of the output."""
    back = restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(back.cast("binary"), 256).alias("restored_sha256"))
