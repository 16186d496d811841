"""The largest eigenpairs of a symmetric matrix by contour integration.

The eigenvectors of an interval are what a circle around it lets through: (1 / 2 pi i) times the integral of
(z - V)^-1 Y over the circle, by quadrature a weighted sum of solves of complex shifted matrices. Rayleigh-Ritz in the
span of that sum gives the pairs, and is repeated with them until their residuals are at rounding level. The number of
eigenvalues in the interval is known beforehand from the inertia of V shifted by its ends, so none can be missed. The
matrix is dimensions x dimensions, whatever the number of rows it was gathered from.
"""

from __future__ import annotations

NODES = 8
ROUNDS = 40
# Eigenvalues nearer than this share of the matrix's norm are one group.
GAP = 1e-9
# A residual, as a share of the norm, from which on rounds end as soon as they stop to halve it.
ENOUGH = 1e-12


def tridiagonal(matrix):
    """(diagonal, squares of the off-diagonal) of an orthogonally similar tridiagonal matrix, by reflections."""
    import numpy as np

    a = np.array(matrix, float)
    n = len(a)
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        length = np.sqrt(x @ x)
        if length == 0.0:
            continue
        x[0] += length if x[0] >= 0 else -length
        x /= np.sqrt(x @ x)
        a[k + 1 :] -= 2 * np.outer(x, x @ a[k + 1 :])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ x, x)
    return np.diag(a).copy(), np.diag(a, -1) ** 2


def above(line, shifts):
    """How many eigenvalues lie above each shift: the positive pivots of the shifted matrix, by Sylvester's law of inertia."""
    import numpy as np

    diagonal, squares = line
    shifts = np.asarray(shifts, float)
    tiny = np.finfo(float).tiny
    pivot = diagonal[0] - shifts
    count = (pivot > 0).astype(int)
    for d, s in zip(diagonal[1:], squares):
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        pivot = d - shifts - s / pivot
        count += pivot > 0
    return count


def intervals(line, wanted: int) -> list[tuple[float, float, int]]:
    """(low, high, count) around each group of close eigenvalues, the largest first, for wanted eigenvalues or more.

    The ends lie in the gaps to the next groups, equally far from the group, so the circle tells it apart well.
    """
    import numpy as np

    diagonal, squares = line
    off = np.sqrt(np.concatenate([[0], squares])) + np.sqrt(np.concatenate([squares, [0]]))
    bottom, top = float((diagonal - off).min()), float((diagonal + off).max())
    size = max(abs(bottom), abs(top)) or 1.0
    bottom, top = bottom - size, top + size

    def bracket(count: int) -> tuple[float, float]:
        """Narrow bounds of the count-th largest eigenvalue."""
        low, high = bottom, top
        for _ in range(200):
            if high - low <= 4e-16 * size:
                break
            at = np.linspace(low, high, 18)[1:-1]
            enough = np.flatnonzero(above(line, at) >= count)
            i = enough[-1] if len(enough) else -1
            low, high = (at[i] if i >= 0 else low), (at[i + 1] if i + 1 < len(at) else high)
        return low, high

    found, gap_above = [], np.inf
    upper = bracket(1)[1]
    for count in range(1, len(diagonal) + 1):
        last_low = bracket(count)[0]
        next_high = bracket(count + 1)[1] if count < len(diagonal) else -np.inf
        gap = last_low - next_high
        if gap > GAP * size:
            margin = min(gap, gap_above, size) / 2
            low, high = last_low - margin, upper + margin
            held = above(line, [low, high])
            found.append((low, high, int(held[0] - held[1])))
            if count >= wanted:
                break
            upper, gap_above = next_high, gap
    return found


def projected(matrix, basis, low: float, high: float, nodes: int = NODES):
    """The quadrature of the resolvent over the circle through low and high, applied to basis."""
    import numpy as np

    at, weights = np.polynomial.legendre.leggauss(nodes)
    center, radius = (low + high) / 2, (high - low) / 2
    out = np.zeros(basis.shape)
    identity = np.eye(len(matrix))
    for x, w in zip(at, weights):
        # Upper half of the circle; the lower half is its conjugate.
        turn = np.exp(1j * np.pi * (x + 1) / 2)
        solved = np.linalg.solve((center + radius * turn) * identity - matrix, basis.astype(complex))
        out += (w / 2) * (radius * turn * solved).real
    return out


def largest(matrix, wanted: int):
    """(eigenvalues, unit eigenvectors in columns): the wanted largest pairs, falling; of equal ones any orthogonal choice."""
    import numpy as np

    matrix = (np.asarray(matrix, float) + np.asarray(matrix, float).T) / 2
    n = len(matrix)
    wanted = min(wanted, n)
    size = np.abs(matrix).sum(1).max() if n else 0.0
    if size == 0.0:
        return np.zeros(wanted), np.eye(n)[:, :wanted]
    scaled = matrix / size
    parts = [_inside(scaled, *x) for x in intervals(tridiagonal(scaled), wanted)]
    basis, _ = np.linalg.qr(np.column_stack(parts))
    values, turn = np.linalg.eigh(basis.T @ scaled @ basis)
    order = np.argsort(-values, kind="stable")[:wanted]
    return values[order] * size, (basis @ turn)[:, order]


def _inside(matrix, low: float, high: float, count: int):
    """The count eigenvectors whose eigenvalues lie between low and high."""
    import numpy as np

    n = len(matrix)
    basis = np.random.default_rng(20).normal(size=(n, min(n, count + max(2, count // 2))))
    best = None
    for _ in range(ROUNDS):
        basis, _ = np.linalg.qr(projected(matrix, basis, low, high))
        values, turn = np.linalg.eigh(basis.T @ matrix @ basis)
        basis = basis @ turn
        inside = np.flatnonzero((values > low) & (values < high))
        if len(inside) < count:
            continue
        # A mixture of eigenvectors from both sides can have its quotient inside; its residual gives it away.
        residual = np.linalg.norm(matrix @ basis - basis * values, axis=0)[inside]
        inside, worst = inside[np.argsort(residual)[:count]], np.sort(residual)[count - 1]
        settled = best is not None and best[0] < ENOUGH and worst >= best[0] / 2
        if best is None or worst < best[0]:
            best = (worst, basis[:, inside])
        if settled:
            break
    if best is None or best[0] > ENOUGH:
        raise ArithmeticError(f"not all of {count} eigenvalues between {low} and {high} were found")
    return best[1]
