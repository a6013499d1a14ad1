"""Seeding kernels against definitions written out letter by letter."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.functions.kmers import FULL, RESIDUES, CODONS, aa_seeds, below_share, decode_expr, dna_seeds, encode_expr, mix64, mix64_steps, open_frames, residues_expr, revcomp_expr, short_name
from strandloom.params import SketchParams, with_presets

COMP = str.maketrans("ACGT", "TGCA")


def mixed(x):
    x = ~(x + (x << 21)) & FULL
    x ^= x >> 24
    x = (x * 265) & FULL
    x ^= x >> 14
    x = (x * 21) & FULL
    x ^= x >> 28
    return (x + (x << 31)) & FULL


def code(s):
    v = 0
    for c in s:
        v = v * 4 + "ACGT".index(c)
    return v


def slow_seeds(s, p):
    out = []
    for i in range(20, len(s)):
        w = s[i - 20 : i + 1]
        if "N" in s[i - p.mask_span + 1 : i + 1].upper():
            continue
        w = w.upper().replace("N", "A")
        f, r = code(w), code(w.translate(COMP)[::-1])
        low = 4**p.k - 1
        a, b = f & low, r & low
        h = mixed(min(a, b))
        if h < FULL // p.c:
            out.append((i, min(a, b), a < b, min(f, r) if h < FULL // p.marker_c else -1))
    return out


def rand(n, seed=1, letters="ACGT"):
    return "".join(random.Random(seed).choices(letters, k=n))


@pytest.mark.parametrize("letters", ["ACGT", "ACGTN", "ACGTn" + "ACGT" * 20])
def test_dna_seeds(letters):
    p = SketchParams(c=5, k=15, marker_c=20)
    s = rand(3000, 3, letters)
    assert [tuple(x) for x in zip(*(a.tolist() for a in dna_seeds(s.encode(), p)))] == slow_seeds(s, p)


def test_other_strand_gives_the_same_sets():
    p = SketchParams(c=3, marker_c=9)
    s = rand(4000, 5)
    a, b = dna_seeds(s.encode(), p), dna_seeds(s.translate(COMP)[::-1].encode(), p)
    assert sorted(a[1].tolist()) == sorted(b[1].tolist()) and sorted(a[3].tolist()) == sorted(b[3].tolist())


def test_degenerate_sequences():
    p = SketchParams(c=1, marker_c=1)
    assert len(dna_seeds(b"N" * 1320, p)[0]) == 0
    assert len(dna_seeds(b"ACGT" * 10, p)[0]) == 0 and len(dna_seeds(b"", p)[0]) == 0
    assert len(aa_seeds(b"AC", SketchParams.amino_acid())[0]) == 0
    with pytest.raises(ValueError):
        SketchParams(k=17)
    with pytest.raises(ValueError):
        SketchParams(c=2000)
    assert with_presets(SketchParams(), "medium", "small_genomes") == SketchParams(c=30, marker_c=200)
    with pytest.raises(ValueError):
        with_presets(SketchParams(), "fast", "slow")


def slow_frames(s):
    last_f, last_r, out = [0] * 3, [0] * 3, []
    aa = lambda c: CODONS[code(c)]
    for i in range(2, len(s)):
        ph, at = i % 3, i - 2
        if aa(s[at : i + 1]) == "*":
            if last_f[ph] and at - last_f[ph] > 30:
                out.append((last_f[ph], at, ph))
            last_f[ph] = at
        if aa(s[at : i + 1].translate(COMP)[::-1]) == "*":
            if last_f[ph] and at - last_r[ph] > 45:
                out.append((last_r[ph], at, ph + 3))
            last_r[ph] = at
    return sorted(out, key=lambda o: o[0] - o[1])


def slow_aa(s, p):
    out = []
    for start, end, ph in slow_frames(s):
        codons = [s[i : i + 3] for i in range(start, end + 1, 3)]
        if ph > 2:
            codons = [c.translate(COMP)[::-1] for c in codons]
        res = [RESIDUES[CODONS[code(c)]] for c in codons]
        for n in range(9, len(res)):
            w = res[n - 9 : n + 1]
            short, long = w[-p.k :], w
            if ph > 2:
                short, long = short[::-1], long[::-1]
            v = lambda x: sum(a << (5 * (len(x) - 1 - i)) for i, a in enumerate(x))
            h = mixed(v(short))
            if h < FULL // p.c:
                out.append((start + 3 * n + 2, v(short), ph < 3, v(long) if h < FULL // p.marker_c else -1))
    return out


def test_frames_and_residue_seeds():
    p = SketchParams(c=2, k=6, marker_c=6, use_aa=True)
    for seed in range(6):
        s = rand(2500, seed)
        assert open_frames(s.encode()) == slow_frames(s)
        assert [tuple(x) for x in zip(*(a.tolist() for a in aa_seeds(s.encode(), p)))] == slow_aa(s, p)


def test_expressions_equal_kernels(spark):
    v = [0, 1, 2**42 - 1, 123456789, 2**30 - 1]
    df = mix64_steps(spark.createDataFrame([(x,) for x in v], "x long"), "x", "h")
    got = [r for r in df.withColumn("low", below_share(F.col("h"), 7)).orderBy("x").collect()]
    want = sorted((x, int(mix64(np.array([x], np.uint64))[0])) for x in v)
    assert [(r.x, r.h & FULL) for r in got] == want and [r.low for r in got] == [h < FULL // 7 for _, h in want]
    assert all(mixed(x) == h for x, h in want)
    s = rand(21)
    r = spark.createDataFrame([(s, " head one"), ("acgu", "x")], "s string, n string").select(encode_expr(F.col("s")).alias("e"), decode_expr(encode_expr(F.col("s")), 21).alias("d"), revcomp_expr(F.col("s")).alias("r"), residues_expr(F.col("s")).alias("a"), short_name(F.col("n")).alias("n")).collect()
    assert r[0].e == code(s) and r[0].d == s and r[0].r == s.translate(COMP)[::-1] and r[0].a == "".join(CODONS[code(s[i : i + 3])] for i in range(0, 21, 3))
    assert r[1].e == code("ACGT") and r[1].r == "ACGT" and [x.n for x in r] == ["head", "x"]
