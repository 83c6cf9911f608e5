"""Plain Python versions of what the k-mer operators compute."""

import re
from collections import Counter


def rc(w):
    return w[::-1].translate(str.maketrans("ACGT", "TGCA"))


def runs(seq):
    return re.findall("[ACGT]+", seq.translate(str.maketrans("acgt", "ACGT")))


def count(seqs, k):
    return Counter(min(r[i : i + k], rc(r[i : i + k])) for s in seqs for r in runs(s) for i in range(len(r) - k + 1))


_SEED = {"A": 0x3C8BFBB395C60474, "C": 0x3193C18562A02B4C, "G": 0x20323ED082572324, "T": 0x295549F54BE24456}


def nthash(w):
    def one(w):
        h = 0
        for c in w:
            h = ((h << 1) | (h >> 63)) & (2**64 - 1)
            h ^= _SEED[c]
        return h

    return one(w) ^ one(rc(w))


def minimizer(w, m):
    return min(nthash(w[i : i + m]) for i in range(len(w) - m + 1))


def superkmers(run, k, m, longest):
    """(position, bases, hash) by walking along the run."""
    out, start, h = [], None, None
    for i in range(len(run) - k + 1):
        now = minimizer(run[i : i + k], m)
        if start is None or now != h or i + k - start > longest:
            if start is not None:
                out.append((start, i - 1 + k - start, h))
            start, h = i, now
    if start is not None:
        out.append((start, len(run) - start, h))
    return out
