"""Sparse matrices in compressed rows, and their product after Gustavson."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Terms that a product forms at a time; a row of more is formed alone.
MOST_TERMS = 2_000_000


@dataclass(frozen=True)
class Csr:
    """Row i holds the columns ``indices[indptr[i]:indptr[i + 1]]`` with the values ``data`` at the same places."""

    indptr: np.ndarray
    indices: np.ndarray
    data: np.ndarray
    n_cols: int

    @property
    def n_rows(self) -> int:
        return len(self.indptr) - 1

    @staticmethod
    def of_runs(lengths: np.ndarray) -> Csr:
        """Row i covers the next ``lengths[i]`` columns: tokens over the bytes of a text."""
        indptr = np.zeros(len(lengths) + 1, np.int64)
        np.cumsum(lengths, out=indptr[1:])
        n = int(indptr[-1])
        return Csr(indptr, np.arange(n), np.ones(n, np.int64), n)

    @staticmethod
    def of_labels(labels: np.ndarray, n_cols: int) -> Csr:
        """Row i has one entry, in column ``labels[i]``: tokens in their groups."""
        return Csr(np.arange(len(labels) + 1), labels, np.ones(len(labels), np.int64), n_cols)

    def transposed(self) -> Csr:
        order = np.argsort(self.indices, kind="stable")
        indptr = np.zeros(self.n_cols + 1, np.int64)
        np.cumsum(np.bincount(self.indices, minlength=self.n_cols), out=indptr[1:])
        rows = np.repeat(np.arange(self.n_rows), np.diff(self.indptr))
        return Csr(indptr, rows[order], self.data[order], self.n_rows)

    def rows(self) -> np.ndarray:
        """Row of each entry."""
        return np.repeat(np.arange(self.n_rows), np.diff(self.indptr))


def product(a: Csr, b: Csr, most_terms: int = MOST_TERMS) -> Iterator[tuple[int, Csr]]:
    """Rows of ``a`` times ``b``, as (first row, matrix of the next rows).

    Row i of the product is the sum of the rows k of ``b`` for the entries (i, k) of ``a``, each times its value; equal
    columns are added up. Rows are taken together as long as they form at most ``most_terms`` terms.
    """
    terms = np.diff(b.indptr)[a.indices]
    upto = np.concatenate([[0], np.cumsum(terms)])[a.indptr]  # terms of all rows before each
    row = 0
    while row < a.n_rows:
        end = max(row + 1, int(np.searchsorted(upto, upto[row] + most_terms, "right")) - 1)
        yield row, _rows(a, b, row, end)
        row = end


def _rows(a: Csr, b: Csr, first: int, end: int) -> Csr:
    own = slice(a.indptr[first], a.indptr[end])
    through, values = a.indices[own], a.data[own]
    counts = np.diff(b.indptr)[through]
    before = np.cumsum(counts) - counts
    at = np.arange(counts.sum()) + np.repeat(b.indptr[through] - before, counts)
    rows = np.repeat(np.repeat(np.arange(end - first), np.diff(a.indptr[first : end + 1])), counts)
    cell, term = rows * b.n_cols + b.indices[at], np.repeat(values, counts) * b.data[at]
    if len(cell) > 1 and (cell[1:] < cell[:-1]).any():
        order = np.argsort(cell, kind="stable")
        cell, term = cell[order], term[order]
    new = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
    indptr = np.zeros(end - first + 1, np.int64)
    np.cumsum(np.bincount(cell[new] // max(b.n_cols, 1), minlength=end - first), out=indptr[1:])
    return Csr(indptr, cell[new] % max(b.n_cols, 1), np.add.reduceat(term, new) if len(new) else term, b.n_cols)
