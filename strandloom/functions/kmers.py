"""Seeds and markers of nucleotide sequences: numpy kernels, and the same as SQL expressions.

A window of 21 bases that ends at i gives two codes, of its strand and of the other.
The seed is the smaller of their low 2k bits, the marker the smaller whole code. A
seed is kept if its mixed value falls below a share 1/c of the 64-bit range, a
marker if the same value falls below 1/marker_c.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import MARKER_K, MARKER_K_AA, ORF_FORWARD, ORF_REVERSE, SketchParams

FULL = (1 << 64) - 1
#: Bases as two bits; U is T, everything else counts as A.
_CODE = np.zeros(256, np.uint64)
for _bases, _v in (("Cc\x01", 1), ("Gg\x02", 2), ("TtUu\x03", 3)):
    for _b in _bases:
        _CODE[ord(_b)] = _v
#: Amino acids of the codons AAA, AAC, AAG ... TTT, and their numbers (fixed values; R has its last one).
CODONS = "KNKNTTTTRSRSIIMIQHQHPPPPRRRRLLLLEDEDAAAAGGGGVVVV*Y*YSSSS*CWCLFLF"
RESIDUES = {"A": 0, "N": 2, "D": 3, "C": 4, "E": 5, "F": 6, "G": 7, "H": 8, "I": 9, "K": 10, "L": 11, "M": 12, "P": 13, "Q": 14, "R": 15, "S": 16, "T": 17, "V": 18, "W": 19, "Y": 20, "*": 21}
_RESIDUE = np.array([RESIDUES[a] for a in CODONS], np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """Invertible mix of 64-bit integers with wrapping arithmetic."""
    u = np.uint64
    with np.errstate(over="ignore"):
        x = ~(x + (x << u(21)))
        x = x ^ (x >> u(24))
        x = x + (x << u(3)) + (x << u(8))
        x = x ^ (x >> u(14))
        x = x + (x << u(2)) + (x << u(4))
        x = x ^ (x >> u(28))
        return x + (x << u(31))


def base_codes(seq: bytes) -> np.ndarray:
    return _CODE[np.frombuffer(seq, np.uint8)]


def window_codes(codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of every window of k bases and of its reverse complement, by doubling the window."""
    u = np.uint64
    f, r, have = codes, u(3) - codes, 1
    done: tuple | None = None
    n = k
    while n:
        if n & 1:
            if done is None:
                done = (f, r, have)
            else:  # `done` covers the older bases
                df, dr, dh = done
                m = len(codes) - dh - have + 1
                done = ((df[:m] << u(2 * have)) | f[dh : dh + m], dr[:m] | (r[dh : dh + m] << u(2 * dh)), dh + have)
        n >>= 1
        if n:
            m = len(codes) - 2 * have + 1
            if m <= 0:
                return codes[:0], codes[:0]
            f, r = (f[:m] << u(2 * have)) | f[have : have + m], r[:m] | (r[have : have + m] << u(2 * have))
            have *= 2
    return done[0], done[1]


def dna_seeds(seq: bytes, p: SketchParams) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(pos, kmer, canonical, marker)`` of the kept windows; marker is -1 where the seed is no marker."""
    none = np.zeros(0, np.int64)
    if len(seq) < 2 * MARKER_K:
        return none, none, none.astype(bool), none
    raw = np.frombuffer(seq, np.uint8)
    f, r = window_codes(_CODE[raw], MARKER_K)
    low = np.uint64((1 << (2 * p.k)) - 1)
    sf, sr = f & low, r & low
    kmer = np.minimum(sf, sr)
    h = mix64(kmer)
    keep = h < np.uint64(FULL // p.c)
    masked = np.flatnonzero((raw == ord("N")) | (raw == ord("n")))
    if len(masked):
        end = np.arange(MARKER_K - 1, len(seq))
        last = np.searchsorted(masked, end, "right") - 1
        near = np.where(last >= 0, masked[np.maximum(last, 0)], -p.mask_span - 1)
        keep &= end - near >= p.mask_span
    at = np.flatnonzero(keep)
    marker = np.where(h[at] < np.uint64(FULL // p.marker_c), np.minimum(f[at], r[at]).astype(np.int64), -1)
    return at + MARKER_K - 1, kmer[at].astype(np.int64), sf[at] < sr[at], marker


def open_frames(seq: bytes) -> list[tuple[int, int, int]]:
    """``(start, end, phase)`` between stop codons, longest first; phases 3 to 5 are the other strand.

    Nothing is emitted before a first stop of the forward strand in the phase, also
    for the other strand, whose frames may therefore start at 0.
    """
    codes = base_codes(seq)
    if len(codes) < 3:
        return []
    f, r = window_codes(codes, 3)
    stop = np.uint64(RESIDUES["*"])
    out = []
    for phase in range(3):
        ends = np.arange(len(f)) + 2
        mine = ends % 3 == phase
        fs = (ends - 2)[mine & (_RESIDUE[f.astype(int)] == stop)].tolist()
        rs = (ends - 2)[mine & (_RESIDUE[r.astype(int)] == stop)].tolist()
        for a, b in zip(fs, fs[1:]):
            if a and b - a > ORF_FORWARD:
                out.append((b, 0, a, b, phase))
        first = next((x for x in fs if x), None)
        for a, b in zip([0, *rs], rs):
            if first is not None and b >= first and b - a > ORF_REVERSE:
                out.append((b, 1, a, b, phase + 3))
    out.sort(key=lambda o: (o[2] - o[3], o[0], o[1]))
    return [(a, b, ph) for _, _, a, b, ph in out]


def aa_seeds(seq: bytes, p: SketchParams) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Like ``dna_seeds`` for residues of five bits inside the open frames of both strands."""
    out: list[tuple[np.ndarray, ...]] = []
    codes = base_codes(seq)
    if len(codes) >= 2 * MARKER_K_AA:
        f, r = window_codes(codes, 3)
        for start, end, phase in open_frames(seq):
            forward = phase < 3
            at = np.arange(start, end + 1, 3)  # first base of each codon
            at = at[at < len(f)]
            res = _RESIDUE[(f if forward else r)[at].astype(int)]
            m = len(res) - MARKER_K_AA + 1
            if m <= 0:
                continue
            word = np.zeros((2, m), np.uint64)
            for row, size in enumerate((MARKER_K_AA, p.k)):
                off = MARKER_K_AA - size
                for j in range(size):
                    part = res[off + j : off + j + m]
                    word[row] |= part << np.uint64(5 * (size - 1 - j if forward else j))
            h = mix64(word[1])
            keep = np.flatnonzero(h < np.uint64(FULL // p.c))
            pos = at[keep + MARKER_K_AA - 1] + 2
            marker = np.where(h[keep] < np.uint64(FULL // p.marker_c), word[0][keep].astype(np.int64), -1)
            out.append((pos, (word[1][keep] & np.uint64(0xFFFFFFFF)).astype(np.int64), np.full(len(keep), forward), marker))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(bool), none
    return tuple(np.concatenate(x) for x in zip(*out))


# The same in SQL expressions, for columns of codes and short strings.


def _add(a: Column, b: Column) -> Column:
    """Wrapping sum of two BIGINTs: halves are added apart, so nothing overflows."""
    low = F.lit(0xFFFFFFFF)
    lo = a.bitwiseAND(low) + b.bitwiseAND(low)
    hi = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) + F.shiftrightunsigned(lo, 32)
    return F.shiftleft(hi.bitwiseAND(low), 32).bitwiseOR(lo.bitwiseAND(low))


def mix64_steps(df, c: str, out: str):
    """``mix64`` of BIGINT column ``c`` as column ``out``; one projection a step keeps the expressions small."""
    def step(f):
        nonlocal df
        df = df.withColumn(out, f(F.col(out)))

    df = df.withColumn(out, F.col(c))
    step(lambda x: F.bitwise_not(_add(x, F.shiftleft(x, 21))))
    step(lambda x: x.bitwiseXOR(F.shiftrightunsigned(x, 24)))
    step(lambda x: _add(_add(x, F.shiftleft(x, 3)), F.shiftleft(x, 8)))
    step(lambda x: x.bitwiseXOR(F.shiftrightunsigned(x, 14)))
    step(lambda x: _add(_add(x, F.shiftleft(x, 2)), F.shiftleft(x, 4)))
    step(lambda x: x.bitwiseXOR(F.shiftrightunsigned(x, 28)))
    step(lambda x: _add(x, F.shiftleft(x, 31)))
    return df


def below_share(h: Column, c: int) -> Column:
    """Is the hash, read as unsigned, below floor((2^64 - 1) / c)?"""
    t = FULL // c
    sign = -(1 << 63)
    limit = (t if t < 1 << 63 else t - (1 << 64)) ^ sign
    limit = limit - (1 << 64) if limit >= 1 << 63 else limit
    return h.bitwiseXOR(F.lit(sign)) < F.lit(limit)


def encode_expr(kmer: Column) -> Column:
    """Code of a short string of ACGT(U)."""
    return F.conv(F.translate(F.upper(kmer), "ACGTU", "01233"), 4, 10).cast("long")


def decode_expr(code: Column, k: int) -> Column:
    """String of k bases of a code."""
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def revcomp_expr(seq: Column) -> Column:
    return F.reverse(F.translate(F.upper(seq), "ACGTU", "TGCAA"))


def residues_expr(seq: Column) -> Column:
    """Residue letters of the codons from the first base on; a rest of one or two bases is left out."""
    table = F.array(*[F.lit(a) for a in CODONS])
    digits = F.translate(F.upper(seq), "ACGTU", "01233")
    codons = F.filter(F.split(digits, r"(?<=\G...)"), lambda x: F.length(x) == 3)
    return F.array_join(F.transform(codons, lambda x: F.element_at(table, F.conv(x, 4, 10).cast("int") + 1)), "")


def short_name(name: Column) -> Column:
    """Header up to the first white space."""
    return F.split_part(F.regexp_replace(F.trim(name), r"\s+", " "), F.lit(" "), F.lit(1))
