"""Cells, symmetry operations, sequence pairing and superposition, on numpy arrays."""

from __future__ import annotations

from functools import lru_cache
from itertools import product

import numpy as np

#: Hall symbols of the 65 groups without mirrors or inversions, by Hermann-Mauguin name, in the order of the
#: International Tables; then other settings and names of the same groups.
HALL = {
    "P 1": "P 1", "P 1 2 1": "P 2y", "P 1 21 1": "P 2yb", "C 1 2 1": "C 2y",
    "P 2 2 2": "P 2 2", "P 2 2 21": "P 2c 2", "P 21 21 2": "P 2 2ab", "P 21 21 21": "P 2ac 2ab",
    "C 2 2 21": "C 2c 2", "C 2 2 2": "C 2 2", "F 2 2 2": "F 2 2", "I 2 2 2": "I 2 2", "I 21 21 21": "I 2b 2c",
    "P 4": "P 4", "P 41": "P 4w", "P 42": "P 4c", "P 43": "P 4cw", "I 4": "I 4", "I 41": "I 4bw",
    "P 4 2 2": "P 4 2", "P 4 21 2": "P 4ab 2ab", "P 41 2 2": "P 4w 2c", "P 41 21 2": "P 4abw 2nw",
    "P 42 2 2": "P 4c 2", "P 42 21 2": "P 4n 2n", "P 43 2 2": "P 4cw 2c", "P 43 21 2": "P 4nw 2abw",
    "I 4 2 2": "I 4 2", "I 41 2 2": "I 4bw 2bw",
    "P 3": "P 3", "P 31": "P 31", "P 32": "P 32", "R 3": "R 3",
    "P 3 1 2": "P 3 2", "P 3 2 1": "P 3 2=", "P 31 1 2": "P 31 2 (0 0 4)", "P 31 2 1": "P 31 2=", "P 32 1 2": "P 32 2 (0 0 2)",
    "P 32 2 1": "P 32 2=", "R 3 2": "R 3 2=",
    "P 6": "P 6", "P 61": "P 61", "P 65": "P 65", "P 62": "P 62", "P 64": "P 64", "P 63": "P 6c",
    "P 6 2 2": "P 6 2", "P 61 2 2": "P 61 2 (0 0 5)", "P 65 2 2": "P 65 2 (0 0 1)", "P 62 2 2": "P 62 2 (0 0 4)",
    "P 64 2 2": "P 64 2 (0 0 2)", "P 63 2 2": "P 6c 2c",
    "P 2 3": "P 2 2 3", "F 2 3": "F 2 2 3", "I 2 3": "I 2 2 3", "P 21 3": "P 2ac 2ab 3", "I 21 3": "I 2b 2c 3",
    "P 4 3 2": "P 4 2 3", "P 42 3 2": "P 4n 2 3", "F 4 3 2": "F 4 2 3", "F 41 3 2": "F 4d 2 3", "I 4 3 2": "I 4 2 3",
    "P 43 3 2": "P 4acd 2ab 3", "P 41 3 2": "P 4bd 2ab 3", "I 41 3 2": "I 4bd 2c 3",
}
SETTINGS = {
    "P 2": "P 2y", "P 21": "P 2yb", "C 2": "C 2y", "A 1 2 1": "A 2y", "I 1 2 1": "I 2y", "P 1 1 2": "P 2", "P 1 1 21": "P 2c", "B 1 1 2": "B 2",
    "P 21 2 2": "P 2a 2a", "P 2 21 2": "P 2 2b", "P 2 21 21": "P 2bc 2", "P 21 2 21": "P 2ac 2ac",
    "H 3": "R 3", "R 3 :H": "R 3", "R 3 :R": "P 3*", "H 3 2": "R 3 2=", "R 3 2 :H": "R 3 2=", "R 3 2 :R": "P 3* 2",
}
#: Translations of the lattices and of the letters in a symbol.
LATTICE = {
    "P": [(0, 0, 0)], "A": [(0, 0, 0), (0, 1 / 2, 1 / 2)], "B": [(0, 0, 0), (1 / 2, 0, 1 / 2)], "C": [(0, 0, 0), (1 / 2, 1 / 2, 0)], "I": [(0, 0, 0), (1 / 2, 1 / 2, 1 / 2)],
    "F": [(0, 0, 0), (0, 1 / 2, 1 / 2), (1 / 2, 0, 1 / 2), (1 / 2, 1 / 2, 0)], "R": [(0, 0, 0), (2 / 3, 1 / 3, 1 / 3), (1 / 3, 2 / 3, 2 / 3)],
}
GLIDE = {"a": (1 / 2, 0, 0), "b": (0, 1 / 2, 0), "c": (0, 0, 1 / 2), "n": (1 / 2, 1 / 2, 1 / 2), "w": (0, 0, 1 / 4), "d": (1 / 4, 1 / 4, 1 / 4)}

#: BLOSUM62, lower triangle by rows in this order of residues.
RESIDUES = "ARNDCQEGHILKMFPSTWYV"
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

#: Three-letter names of the residues, in the same order.
NAMES = "ALA ARG ASN ASP CYS GLN GLU GLY HIS ILE LEU LYS MET PHE PRO SER THR TRP TYR VAL".split()
THREE_TO_ONE = dict(zip(NAMES, RESIDUES, strict=True)) | {"MSE": "M"}


def _turn(order: int, axis: str) -> np.ndarray:
    """Rotation about an axis: z, y or x, ``'`` for a - b, ``=`` for a + b, ``*`` for the body diagonal."""
    cyclic = {"z": (0, 1, 2), "x": (1, 2, 0), "y": (2, 0, 1)}
    if axis == "*":
        return np.array([[0.0, 0, 1], [1, 0, 0], [0, 1, 0]])
    if axis in "'=":
        k = -1.0 if axis == "'" else 1.0
        return np.array([[0, k, 0], [k, 0, 0], [0, 0, -1]])
    plane = {1: [[1, 0], [0, 1]], 2: [[-1, 0], [0, -1]], 3: [[0, -1], [1, -1]], 4: [[0, -1], [1, 0]], 6: [[1, -1], [1, 0]]}[order]
    out = np.zeros((3, 3))
    i, j, k = cyclic[axis]
    out[np.ix_((i, j), (i, j))] = plane
    out[k, k] = 1
    return out


def generators(symbol: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rotation, translation) of each part of a Hall symbol of rotations; its shift of origin in twelfths is in brackets."""
    body, _, base = symbol.partition("(")
    parts, first = body.split()[1:], 0
    origin = np.array([float(x) / 12 for x in base.rstrip(")").split()]) if base else np.zeros(3)
    out = []
    for place, part in enumerate(parts):
        order, rest = int(part[0]), part[1:]
        if place == 0:
            axis, first = "z", order
        elif place == 1:
            axis = "x" if first in (2, 4) else "'"
        else:
            axis = "*"
        for c in rest:
            if c in "xyz'=*":
                axis = c
        r, t = _turn(order, axis), np.zeros(3)
        for c in rest:
            if c.isdigit():
                t["xyz".index(axis) if axis in "xyz" else 2] += int(c) / order
            elif c in GLIDE:
                t += GLIDE[c]
        out.append((r, t + origin - r @ origin))
    return out


@lru_cache(maxsize=256)
def symmetry_ops(group: str | None) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rotation, translation) of each operation, the identity first; no group is P 1, an unknown one an error."""
    name = "".join((group or "P 1").split()).upper()
    symbol = next((h for known in (HALL, SETTINGS) for n, h in known.items() if n.replace(" ", "") == name), None)
    if symbol is None:
        raise ValueError(f"unknown space group {group!r}")
    found: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}

    def add(r: np.ndarray, t: np.ndarray) -> bool:
        t = np.round(t * 24).astype(int) % 24 / 24
        key = (*r.astype(int).ravel().tolist(), *np.round(t * 24).astype(int).tolist())
        return found.setdefault(key, (r, t))[1] is t

    for shift in LATTICE[symbol[0]]:
        add(np.eye(3), np.array(shift, float))
    grown = generators(symbol)
    new = list(found.values())
    while new:
        made = []
        for r, t in new:
            for gr, gt in grown:
                before = len(found)
                add(gr @ r, gr @ t + gt)
                if len(found) > before:
                    made.append(list(found.values())[-1])
        new = made
    return list(found.values())


def orthogonal(cell) -> np.ndarray:
    """Matrix from fractional to Cartesian coordinates (a along x, c* along z)."""
    a, b, c = cell[:3]
    ca, cb, cg = np.cos(np.radians(np.asarray(cell[3:6], float)))
    sg = np.sqrt(1 - cg * cg)
    v = np.sqrt(max(0.0, 1 - ca * ca - cb * cb - cg * cg + 2 * ca * cb * cg))
    return np.array([[a, b * cg, c * cb], [0, b * sg, c * (ca - cb * cg) / sg], [0, 0, c * v / sg]])


def volume(cell) -> float:
    return float(np.linalg.det(orthogonal(cell)))


def nearest_images(waters: np.ndarray, protein: np.ndarray, cell, group: str, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Each water moved to its symmetry copy nearest to the protein, and that distance.

    The operation acts on the protein; its inverse, with the lattice shift, on the water. Of equal distances the first
    protein atom, then the first operation, counts. Shifts next to the nearest one are tried where the cell is skewed.
    """
    m = orthogonal(cell)
    inv = np.linalg.inv(m)
    fw, fp = waters @ inv.T, protein @ inv.T
    skewed = np.abs(np.asarray(cell[3:6], float) - 90).max() > 1e-6
    near = np.array(list(product((-1, 0, 1), repeat=3)) if skewed else [(0, 0, 0)], float)
    ops = symmetry_ops(group)
    out, dist = waters.copy(), np.full(len(waters), np.inf)
    if not len(protein):
        return out, dist
    images = [fp @ r.T + t for r, t in ops]
    for a in range(0, len(waters), block):
        w = fw[a : a + block]
        best = np.full((len(w), len(fp)), np.inf)
        which = np.zeros((len(w), len(fp)), int)
        shift = np.zeros((len(w), len(fp), 3))
        for k, image in enumerate(images):
            delta = w[:, None] - image[None]
            base = np.round(delta)
            for n in near:
                d = np.linalg.norm((delta - base - n) @ m.T, axis=2)
                own = d < best - 1e-12
                best[own], which[own] = d[own], k
                shift[own] = (base + n)[own]
        first = best.argmin(1)
        rows = np.arange(len(w))
        dist[a : a + block] = best[rows, first]
        for i in rows:
            r, t = ops[which[i, first[i]]]
            out[a + i] = m @ np.linalg.solve(r, w[i] - t - shift[i, first[i]])
    return out, dist


def substitution(table: str = BLOSUM62) -> np.ndarray:
    rows = [list(map(int, line.split())) for line in table.strip().splitlines()]
    s = np.zeros((len(rows), len(rows)))
    for i, row in enumerate(rows):
        s[i, : i + 1] = row
        s[: i + 1, i] = row
    return s


def paired_positions(a: str, b: str, opening: float = 10.0, extension: float = 1.0) -> list[tuple[int, int]]:
    """Positions paired by the best global alignment with affine gaps; gaps at the ends cost nothing.

    A gap of n costs ``opening + (n - 1) * extension``. Unknown residues score -1 against all. Pairs come before gaps on
    ties.
    """
    s, at = substitution(), {c: i for i, c in enumerate(RESIDUES)}
    n, m = len(a), len(b)
    if not n or not m:
        return []
    low = -1e18
    match = np.full((n + 1, m + 1), low)
    up, left = np.full((n + 1, m + 1), low), np.full((n + 1, m + 1), low)
    match[0, 0] = 0
    up[1:, 0], left[0, 1:] = 0, 0
    ib = [at.get(c, -1) for c in b]
    for i in range(1, n + 1):
        ia = at.get(a[i - 1], -1)
        score = np.array([s[ia, j] if ia >= 0 and j >= 0 else -1.0 for j in ib])
        best = np.maximum(np.maximum(match[i - 1, :-1], up[i - 1, :-1]), left[i - 1, :-1])
        match[i, 1:] = best + score
        o, e = (0.0, 0.0) if i == n + 1 else (opening, extension)
        up[i, 1:] = np.maximum(np.maximum(match[i - 1, 1:], left[i - 1, 1:]) - o, up[i - 1, 1:] - e)
        free = m  # in the last column a gap is an end gap
        up[i, free] = max(match[i - 1, free], left[i - 1, free], up[i - 1, free])
        lo, le = (0.0, 0.0) if i == n else (opening, extension)
        open_left = np.maximum(match[i], up[i]) - lo
        for j in range(1, m + 1):
            left[i, j] = max(open_left[j - 1], left[i, j - 1] - le)
    out, i, j = [], n, m
    state = int(np.argmax([match[n, m], up[n, m], left[n, m]]))
    while i and j:
        if state == 0:
            out.append((i - 1, j - 1))
            i, j = i - 1, j - 1
            state = int(np.argmax([match[i, j], up[i, j], left[i, j]]))
        elif state == 1:
            o, e = (0.0, 0.0) if j == m else (opening, extension)
            i -= 1
            state = int(np.argmax([match[i, j] - o, up[i, j] - e, left[i, j] - o]))
        else:
            o, e = (0.0, 0.0) if i == n else (opening, extension)
            j -= 1
            state = int(np.argmax([match[i, j] - o, up[i, j] - o, left[i, j] - e]))
    return out[::-1]


def kabsch(fixed: np.ndarray, mobile: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proper rotation and shift that bring the mobile points onto the fixed ones with least squares."""
    cf, cm = fixed.mean(0), mobile.mean(0)
    u, _, vt = np.linalg.svd((mobile - cm).T @ (fixed - cf))
    flip = np.diag([1.0, 1.0, np.sign(np.linalg.det(vt.T @ u.T)) or 1.0])
    r = vt.T @ flip @ u.T
    return r, cf - r @ cm


def rmsd(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.sqrt(((a - b) ** 2).sum(1).mean()))


def superpose(fixed_xyz: np.ndarray, fixed_seq: str, mobile_xyz: np.ndarray, mobile_seq: str, least: int = 10) -> dict | None:
    """Pairs by sequence, then fits; None below ``least`` common positions."""
    pairs = paired_positions(fixed_seq, mobile_seq)
    if len(pairs) < least:
        return None
    f, m = fixed_xyz[[p for p, _ in pairs]], mobile_xyz[[q for _, q in pairs]]
    r, t = kabsch(f, m)
    return {"n_common_ca": len(pairs), "rmsd_before": round(rmsd(f, m), 3), "rmsd_after": round(rmsd(f, m @ r.T + t), 3), "rotation": r, "shift": t}
