"""Transition kernels that are kept by their structure: a step of a filter costs what the structure needs, not the square of the latents.

A kernel has rows that sum to 1. `ahead(v)` is v K for row vectors v, `behind(r)` is K r for columns r, both along the last axis, whatever axes stand before it.
"""

from __future__ import annotations

import numpy as np


class Kernel:
    size: int

    def ahead(self, v: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def behind(self, r: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def dense(self) -> np.ndarray:
        return self.ahead(np.eye(self.size))


class Dense(Kernel):
    def __init__(self, matrix: np.ndarray) -> None:
        self.matrix, self.back, self.size = np.ascontiguousarray(matrix), np.ascontiguousarray(matrix.T), len(matrix)

    def ahead(self, v: np.ndarray) -> np.ndarray:
        return v @ self.matrix

    def behind(self, r: np.ndarray) -> np.ndarray:
        return r @ self.back


class SameRows(Kernel):
    """Every row is the same distribution, uniform by default: rank one."""

    def __init__(self, size: int, row: np.ndarray | None = None) -> None:
        self.size, self.row = size, np.full(size, 1.0 / size) if row is None else row

    def ahead(self, v: np.ndarray) -> np.ndarray:
        return v.sum(-1, keepdims=True) * self.row

    def behind(self, r: np.ndarray) -> np.ndarray:
        return np.broadcast_to((r @ self.row)[..., None], r.shape)


class Staying(Kernel):
    def __init__(self, size: int) -> None:
        self.size = size

    def ahead(self, v: np.ndarray) -> np.ndarray:
        return v

    behind = ahead


class LowRank(Kernel):
    """left (size, rank) times right (rank, size)."""

    def __init__(self, left: np.ndarray, right: np.ndarray) -> None:
        self.left, self.right, self.size = np.ascontiguousarray(left), np.ascontiguousarray(right), len(left)

    @staticmethod
    def of(matrix: np.ndarray, tolerance: float = 1e-14) -> Kernel:
        """A smooth matrix by its singular vectors, those above the tolerance of the largest; dense where that saves nothing. What is left out would be lost in rounding anyway."""
        u, s, vt = np.linalg.svd(matrix)
        rank = int((s > tolerance * s[0]).sum())
        return LowRank(u[:, :rank] * s[:rank], vt[:rank]) if 2 * rank < len(matrix) else Dense(matrix)

    def ahead(self, v: np.ndarray) -> np.ndarray:
        return (v @ self.left) @ self.right

    def behind(self, r: np.ndarray) -> np.ndarray:
        return (r @ self.right.T) @ self.left.T


class Product(Kernel):
    """Independent steps along the axes of a grid, latents in row-major order: applied one axis after the other."""

    def __init__(self, parts: list[Kernel]) -> None:
        self.parts, self.shape = parts, tuple(p.size for p in parts)
        self.size = int(np.prod(self.shape))

    def _along(self, v: np.ndarray, step: str) -> np.ndarray:
        out = v.reshape(*v.shape[:-1], *self.shape)
        for k, part in enumerate(self.parts):
            axis = v.ndim - 1 + k
            out = np.moveaxis(getattr(part, step)(np.moveaxis(out, axis, -1)), -1, axis)
        return out.reshape(v.shape)

    def ahead(self, v: np.ndarray) -> np.ndarray:
        return self._along(v, "ahead")

    def behind(self, r: np.ndarray) -> np.ndarray:
        return self._along(r, "behind")


class Blocks(Kernel):
    """Latents of one block after those of the other, no step between them: several mazes, decoded at once."""

    def __init__(self, parts: list[Kernel]) -> None:
        self.parts, self.cuts = parts, np.cumsum([0, *(p.size for p in parts)])
        self.size = int(self.cuts[-1])

    def _each(self, v: np.ndarray, step: str) -> np.ndarray:
        return np.concatenate([getattr(p, step)(v[..., a:b]) for p, a, b in zip(self.parts, self.cuts[:-1], self.cuts[1:], strict=True)], -1)

    def ahead(self, v: np.ndarray) -> np.ndarray:
        return self._each(v, "ahead")

    def behind(self, r: np.ndarray) -> np.ndarray:
        return self._each(r, "behind")


def of_matrix(matrix: np.ndarray) -> Kernel:
    """A dense kernel, or its rank-one form if all rows are equal."""
    return SameRows(len(matrix), matrix[0]) if (matrix == matrix[0]).all() else Dense(matrix)


def moving(size: int, variance: float) -> np.ndarray:
    """The matrix of kernels.move_kernel: exp(-(i - j)^2 / variance^2), rows made to sum to 1."""
    w = np.exp(-(np.subtract.outer(np.arange(size), np.arange(size)) ** 2) / variance**2)
    return w / w.sum(1, keepdims=True)


class Steps:
    """One step of a switching model: the dynamics change by `switch`, then the latent by the new dynamics' kernel. States are (..., dyn, latent)."""

    #: States up to which one matrix over (dynamics, latent) is cheaper than its parts.
    JOINT = 256

    def __init__(self, kernels: np.ndarray | list[Kernel], switch: np.ndarray) -> None:
        self.parts = [k if isinstance(k, Kernel) else of_matrix(k) for k in kernels]
        self.switch, self.dyn, self.size = np.asarray(switch, float), len(self.parts), self.parts[0].size
        self.joint = None
        if self.dyn * self.size <= self.JOINT:
            every = np.stack([k.dense() for k in self.parts])
            n = self.dyn * self.size
            self.joint = np.ascontiguousarray(np.einsum("de,eij->diej", self.switch, every).reshape(n, n))
            self.joint_back = np.ascontiguousarray(self.joint.T)

    def ahead(self, now: np.ndarray) -> np.ndarray:
        """What is predicted for the next row."""
        if self.joint is not None:
            return (now.reshape(*now.shape[:-2], -1) @ self.joint).reshape(now.shape)
        mixed = np.moveaxis(np.tensordot(now, self.switch, ([-2], [0])), -1, -2)
        return np.stack([k.ahead(mixed[..., e, :]) for e, k in enumerate(self.parts)], -2)

    def behind(self, later: np.ndarray) -> np.ndarray:
        """The expectation of `later` over the next row, from each state."""
        if self.joint is not None:
            return (later.reshape(*later.shape[:-2], -1) @ self.joint_back).reshape(later.shape)
        onward = np.stack([k.behind(later[..., e, :]) for e, k in enumerate(self.parts)], -2)
        return np.moveaxis(np.tensordot(onward, self.switch, ([-2], [1])), -1, -2)
