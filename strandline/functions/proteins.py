"""Amino acid scores."""

from __future__ import annotations

import numpy as np

# The BLOSUM62 scores of the 20 amino acids, lower triangle in the order of AMINO_ACIDS.
AMINO_ACIDS = "ARNDCQEGHILKMFPSTWYV"
BLOSUM62 = """
4
-1 5
-2 0 6
-2 -2 1 6
0 -3 -3 -3 9
-1 1 0 0 -3 5
-1 0 0 2 -4 2 5
0 -2 0 -1 -3 -2 -2 6
-2 0 1 -1 -3 0 0 -2 8
-1 -3 -3 -3 -1 -3 -3 -4 -3 4
-1 -2 -3 -4 -1 -2 -3 -4 -3 2 4
-1 2 0 -1 -3 1 1 -2 -1 -3 -2 5
-1 -1 -2 -3 -1 0 -2 -3 -2 1 2 -1 5
-2 -3 -3 -3 -2 -3 -3 -3 -1 0 0 -3 0 6
-1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4 7
1 -1 1 0 -1 0 0 0 -1 -2 -2 0 -1 -2 -1 4
0 -1 0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1 1 5
-3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1 1 -4 -3 -2 11
-2 -2 -2 -3 -2 -1 -2 -3 2 -1 -1 -2 -1 3 -3 -2 -2 2 7
0 -3 -3 -3 -1 -2 -2 -3 -3 3 1 -2 1 -1 -2 -2 0 -3 -1 4
"""


def protein_scores() -> np.ndarray:
    """Scores by byte value: BLOSUM62 for amino acids, -1 for any other letter, -4 for a stop against anything but a stop (1)."""
    out = np.full((256, 256), -1, np.int64)
    out[ord("*"), :] = out[:, ord("*")] = -4
    out[ord("*"), ord("*")] = 1
    for i, line in enumerate(BLOSUM62.split("\n")[1:-1]):
        for j, score in enumerate(map(int, line.split())):
            a, b = ord(AMINO_ACIDS[i]), ord(AMINO_ACIDS[j])
            out[a, b] = out[b, a] = score
    return out


def base_scores(match: int, mismatch: int) -> np.ndarray:
    """Scores by byte value: match for equal bases but N, mismatch for all others."""
    out = np.full((256, 256), mismatch, np.int64)
    for base in b"ACGT":
        out[base, base] = match
    return out
