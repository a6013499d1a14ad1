"""All pairs of records whose sets of values overlap enough, by pigeonhole partitioning.

If the Jaccard similarity of R and S is at least t, they differ in at most
H = (1-t)/(1+t) * (|R|+|S|) values. The universe of values is split into segments
whose number depends on the length of the shorter set. S gives each segment a
budget b: 0 leaves it out, 1 asks for the same content, 2 also for one deletion on
either side. If the budgets sum to H+1, one segment must match within its budget,
so an equi-join on segment signatures finds every pair. S spends its budgets on the
segments with the rarest expected content; each very frequent value is a segment
of its own and comes last. Where crowded segments leave the budgets of some set
short, every value of the sets in that length group is a segment of its own as well.

Only (signature, record) travels; what is matched is looked up in a table of sizes
and bitmaps, and what passes that is verified on the whole sets. Contents are hashed
by a sum of mixed values, so a deletion is a subtraction and all signatures of an
Arrow batch are computed with numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import Workspace

SIGNATURES = "key long, cid long"
SIZES = "cid long, size int, bits_a long, bits_b long"
#: The most frequent values that become segments of their own: at most this many, each in more sets than the second number.
HOT_VALUES, HOT_SETS = 4096, 64


def length_groups(longest: int) -> np.ndarray:
    """Upper bounds of the length groups: each about half wider than the one before."""
    out, hi = [], 0
    while hi < longest:
        lo = hi + 1
        hi = lo + lo // 2
        out.append(hi)
    return np.array(out or [1], dtype=np.int64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer (public splitmix constants)."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _columns(batch: pa.RecordBatch):
    """Record ids, sizes of their sets, and per value its record's number, the value and its mix."""
    cid = batch.column(0).to_numpy(zero_copy_only=False)
    lists = batch.column(1)
    size = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    value = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return cid, size, np.repeat(np.arange(len(size)), size), value, _mix(value)


def _slices(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        for at in range(0, b.num_rows, 2000):
            yield b.slice(at, 2000)


def _sizes(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``SIZES``: size and a bitmap of 128 bits of every set."""
    for batch in _slices(it):
        with np.errstate(over="ignore"):
            cid, size, rec, _, mixed = _columns(batch)
        bit = (mixed >> np.uint64(40)) & np.uint64(127)
        bits = [np.zeros(len(size), np.uint64) for _ in range(2)]
        for half in range(2):
            on = (bit >> np.uint64(6)) == half
            np.bitwise_or.at(bits[half], rec[on], np.uint64(1) << (bit[on] & np.uint64(63)))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (cid, size.astype(np.int32), bits[0].view(np.int64), bits[1].view(np.int64))], names=["cid", "size", "bits_a", "bits_b"])


class Signer:
    """Signatures of a batch of sets for one threshold."""

    def __init__(self, t: Fraction, highs: np.ndarray, hot: np.ndarray, hot_sets: np.ndarray):
        self.num, self.den = t.numerator, t.denominator
        self.highs, self.hot, self.hot_sets = highs, hot, hot_sets
        self.segments = (5 * (self.most_differing(highs, highs) + 1) + 3) // 4
        self.singles = np.zeros(len(highs), bool)  # groups in which every value is a segment too

    def most_differing(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((self.den - self.num) * (a + b)) // (self.den + self.num)

    def _hot(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.hot, value)
        return (at < len(self.hot)) & (self.hot[np.minimum(at, len(self.hot) - 1)] == value) if len(self.hot) else np.zeros(len(value), bool), at

    def _groups(self, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For the own length group and those below it that may hold partners: its number, and for which sets it may."""
        own = np.searchsorted(self.highs, size)
        least = -((-size * self.num) // self.den)  # shortest partner
        for j in range(len(self.highs)):
            g = own - j
            ok = (g >= 0) & (self.highs[np.maximum(g, 0)] >= least)
            if not ok.any():
                break
            yield np.maximum(g, 0), ok

    def index(self, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(it):
            with np.errstate(over="ignore"):
                cid, size, rec, value, mixed = _columns(batch)
                yield self._out(cid, *self._index(np.searchsorted(self.highs, size), rec, mixed, self._hot(value)[0]))

    def probe(self, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(it):
            with np.errstate(over="ignore"):
                cid, size, rec, value, mixed = _columns(batch)
                for g, ok in self._groups(size):
                    keys, recs, _ = self._probe(g, ok, size, rec, mixed, *self._hot(value))
                    yield self._out(cid, keys, recs)

    def short(self, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Numbers of the length groups for which the budgets of some set fall short."""
        found: set[int] = set()
        for batch in _slices(it):
            with np.errstate(over="ignore"):
                _, size, rec, value, mixed = _columns(batch)
                for g, ok in self._groups(size):
                    found.update(g[self._probe(g, ok, size, rec, mixed, *self._hot(value), count=True)[2]].tolist())
        yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.int32())], names=["g"])

    @staticmethod
    def _out(cid: np.ndarray, key: np.ndarray, rec: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(cid[rec])], names=["key", "cid"])

    def _cells(self, g, rec, mixed, cold):
        """Cold values by (record, segment): order, start of each cell, and per cell record, segment, values, content."""
        r, m = rec[cold], mixed[cold]
        seg = ((m >> np.uint64(8)) % self.segments[g[r]].astype(np.uint64)).astype(np.int64)
        order = np.lexsort((seg, r))
        r, m, seg = r[order], m[order], seg[order]
        new = np.ones(len(r), bool)
        new[1:] = (r[1:] != r[:-1]) | (seg[1:] != seg[:-1])
        start = np.flatnonzero(new)
        cell = np.cumsum(new) - 1
        n = np.diff(np.append(start, len(r)))
        content = np.add.reduceat(m, start) if len(start) else np.zeros(0, np.uint64)
        return m, cell, r[start], seg[start], n, content

    def _key(self, g, seg, content, deleted: bool) -> np.ndarray:
        place = (g.astype(np.uint64) << np.uint64(32)) + (seg.astype(np.uint64) << np.uint64(1)) + np.uint64(deleted)
        return _mix(content + _mix(place))

    def _index(self, g, rec, mixed, is_hot):
        m, cell, crec, cseg, n, content = self._cells(g, rec, mixed, ~is_hot)
        full = self._key(g[crec], cseg, content, False)
        some = n[cell] >= 3  # budgets of 2 are spent on contents of two values or more
        c = cell[some]
        dele = self._key(g[crec[c]], cseg[c], content[c] - m[some], True)
        own = is_hot | self.singles[g[rec]]
        return np.concatenate([full, dele, self._single(g, rec[own], mixed[own])]), np.concatenate([crec, crec[c], rec[own]])

    def _single(self, g, rec, mixed) -> np.ndarray:
        """Each value as a segment of its own."""
        return self._key(g[rec], np.full(len(rec), (1 << 31) - 1), mixed, False)

    def _probe(self, g, ok, size, rec, mixed, is_hot, at, count: bool = False):
        """``(keys, records, short)`` of sets against one length group; ``count``: only which sets fall short."""
        need = self.most_differing(size, np.minimum(self.highs[g], size)) + 1
        use = ok[rec]
        m, cell, crec, cseg, n, content = self._cells(g, rec, mixed, use & ~is_hot)
        two = np.flatnonzero(n >= 2)
        h = np.flatnonzero(use & is_hot)
        # Units of budget, cheapest first: contents of three values or more, pairs, single values, one deletion of the larger and of pairs, frequent values.
        unit_rec = np.concatenate([crec, crec[two], rec[h]])
        short = ok & (np.bincount(unit_rec, minlength=len(size)) < need)
        if count:
            return None, None, short
        frequent = 5.0 + self.hot_sets[at[h]] if len(h) else np.zeros(0)
        cost = np.concatenate([np.where(n >= 3, 0.0, np.where(n == 2, 1.0, 2.0)), np.where(n[two] >= 3, 3.0, 4.0), frequent])
        order = np.lexsort((cost, unit_rec))
        sr = unit_rec[order]
        chosen = np.zeros(len(order), bool)
        chosen[order] = np.arange(len(order)) - np.searchsorted(sr, sr, "left") < need[sr]
        nc = len(crec)
        full, near, hot = np.flatnonzero(chosen[:nc]), two[chosen[nc : nc + len(two)]], h[chosen[nc + len(two) :]]
        # Values crowded into few segments can leave the budgets short: then the finest partition,
        # of which as many values suffice as S can lack and still be similar.
        if short.any():
            full, near, hot = full[~short[crec[full]]], near[~short[crec[near]]], hot[~short[rec[hot]]]
            v = np.flatnonzero(short[rec])
            rare = np.where(is_hot[v], self.hot_sets[np.minimum(at[v], len(self.hot_sets) - 1)], 0) if len(self.hot_sets) else np.zeros(len(v))
            order = np.lexsort((rare, rec[v]))
            r = rec[v][order]
            enough = size[r] - -((-size[r] * self.num) // self.den) + 1
            hot = np.concatenate([hot, v[order][np.arange(len(r)) - np.searchsorted(r, r, "left") < enough]])
        near_cell = np.zeros(nc, bool)
        near_cell[near] = True
        some = near_cell[cell] if nc else np.zeros(0, bool)
        c = cell[some]
        keys = [
            self._key(g[crec[full]], cseg[full], content[full], False),
            self._key(g[crec[near]], cseg[near], content[near], True),  # the partner has one value more
            self._key(g[crec[c]], cseg[c], content[c] - m[some], False),  # the partner has one value less
            self._single(g, rec[hot], mixed[hot]),
        ]
        return np.concatenate(keys), np.concatenate([crec[full], crec[near], crec[c], rec[hot]]), short


def set_classes(df: DataFrame, id: str, values: str, where=None) -> tuple[DataFrame, DataFrame]:
    """``(id, rep)`` of every record that has values, and ``(rep, values)`` of each different set.

    where: which values count, as a function of a Column; nulls and repeats never do.
    """
    keep = (lambda v: v.isNotNull()) if where is None else (lambda v: v.isNotNull() & where(v))
    clean: Column = F.array_sort(F.array_distinct(F.filter(F.col(values).cast("array<bigint>"), keep)))
    sets = df.filter(F.col(id).isNotNull()).select(F.col(id).alias("id"), clean.alias("values")).filter(F.size("values") > 0)
    classes = Workspace(df.sparkSession, "classes").save(sets.groupBy("values").agg(F.min("id").alias("rep")).select("rep", "values"))
    # Records find their class by 128 bits of hash, so their values travel once only.
    mark = [F.xxhash64("values").alias("h1"), F.xxhash64(F.lit(1), F.reverse("values")).alias("h2")]
    return sets.select("id", *mark).join(classes.select("rep", *mark), ["h1", "h2"]).select("id", "rep").distinct(), classes


def similar_sets(classes: DataFrame, threshold: str | Fraction) -> DataFrame:
    """``(rep_a, rep_b, overlap, size_a, size_b)`` for every pair of different sets with Jaccard >= threshold, rep_a < rep_b.

    classes: ``(rep, values)`` as ``set_classes`` gives them: sorted, distinct, not
    empty; equal sets are one row, so copies never multiply here. ``threshold`` is
    exact ("0.6" or a Fraction) and must lie above 0. Empty input gives no rows.
    """
    t = Fraction(threshold)
    if not 0 < t <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    spark = classes.sparkSession
    space = Workspace(spark, "sets")
    classes = classes.select(F.col("rep").alias("cid"), "values")
    sizes = space.save(classes.mapInArrow(_sizes, SIZES))
    longest = sizes.agg(F.max("size")).first()[0] or 1
    counts = classes.select(F.explode("values").alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    hot = sorted((r[0], r[1]) for r in counts.filter(F.col("n") > HOT_SETS).orderBy(F.desc("n"), "v").limit(HOT_VALUES).collect())
    signer = Signer(t, length_groups(longest), np.array([v for v, _ in hot], np.int64), np.array([n for _, n in hot], np.int64))
    short = [r[0] for r in classes.mapInArrow(signer.short, "g int").distinct().collect()]  # at most one row a length group
    signer.singles[short] = True

    index, probes = classes.mapInArrow(signer.index, SIGNATURES), classes.mapInArrow(signer.probe, SIGNATURES)
    r, s = index.alias("r"), probes.alias("s")
    num, den = t.numerator, t.denominator
    found = r.join(s, F.col("r.key") == F.col("s.key")).filter("r.cid <> s.cid").select(F.least("r.cid", "s.cid").alias("rep_a"), F.greatest("r.cid", "s.cid").alias("rep_b")).distinct()
    a, b = (sizes.select(F.col("cid").alias(f"rep_{x}"), *[F.col(c).alias(f"{c}_{x}") for c in ("size", "bits_a", "bits_b")]) for x in "ab")
    small, large = F.least("size_a", "size_b"), F.greatest("size_a", "size_b")
    # Differing bits of two 128-bit maps never exceed the differing values.
    apart = F.bit_count(F.col("bits_a_a").bitwiseXOR(F.col("bits_a_b"))) + F.bit_count(F.col("bits_b_a").bitwiseXOR(F.col("bits_b_b")))
    near = (apart * (den + num) <= (small + large) * (den - num)) & (small * den >= large * num)
    pairs = found.join(a, "rep_a").join(b, "rep_b").filter(near).select("rep_a", "rep_b")
    out = pairs.join(classes.select(F.col("cid").alias("rep_a"), F.col("values").alias("va")), "rep_a").join(classes.select(F.col("cid").alias("rep_b"), F.col("values").alias("vb")), "rep_b")
    out = out.select("rep_a", "rep_b", F.size(F.array_intersect("va", "vb")).alias("overlap"), F.size("va").alias("size_a"), F.size("vb").alias("size_b"))
    return out.filter(F.col("overlap") * den >= (F.col("size_a") + F.col("size_b") - F.col("overlap")) * num)


def expand_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """``(record_a, record_b)``, smaller first: every pair of records behind pairs of sets, and of copies of one set."""
    a = members.select(F.col("rep").alias("rep_a"), F.col("id").alias("x"))
    b = members.select(F.col("rep").alias("rep_b"), F.col("id").alias("y"))
    across = pairs.select("rep_a", "rep_b").join(a, "rep_a").join(b, "rep_b").select(F.least("x", "y").alias("record_a"), F.greatest("x", "y").alias("record_b"))
    copies = a.join(b, (F.col("rep_a") == F.col("rep_b")) & (F.col("x") < F.col("y"))).select(F.col("x").alias("record_a"), F.col("y").alias("record_b"))
    return across.unionByName(copies)
