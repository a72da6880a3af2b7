"""Distributed discrete Fourier transform of one series of any length, in n log n work.

A chirp turns the transform of n values into a convolution of ``2 ** bits`` values, which three groupings work out.  The
index is a pair (row, column) of a grid; the first grouping transforms the columns, the second the rows, where the spectrum
is multiplied and its rows go back, the third the columns again.  A task holds some columns or rows of the grid at a time,
about the root of the length each; nothing is gathered.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values of one group: as many columns or rows of the grid as fit.
GROUP_VALUES = 1 << 17
MOST_VALUES = 1 << 32  # fixed value: up to here the square of an index fits an unsigned number of 64 bits
GRID = "line long, place long, n long, re double, im double, chirp_re double, chirp_im double"


def _grid(n: int) -> tuple[int, int]:
    """Rows and columns of the grid for n values: together the power of two from 2 n - 1 on."""
    bits = (2 * n - 2).bit_length()
    return 1 << (bits + 1) // 2, 1 << bits // 2


def _chirp(j: np.ndarray, n: int) -> np.ndarray:
    """exp(pi i j^2 / n), the square reduced as an integer."""
    j = j.astype(np.uint64)
    return np.exp(1j * np.pi / n * (j * j % np.uint64(2 * n)).astype(float))


def _turn(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    return np.exp(-2j * np.pi / size * (np.outer(a, b) % size))


def _lines(t: pa.Table) -> tuple[int, int, int, np.ndarray]:
    """n, rows and columns of the grid, and the distinct lines of a group."""
    n = t["n"][0].as_py()
    return n, *_grid(n), np.unique(t["line"].to_numpy())


def _rows(line: np.ndarray, n: int, values: np.ndarray, chirp: np.ndarray | None = None) -> pa.Table:
    """Values [line, place] as rows, by their new lines: what was the place is grouped next."""
    m, k = values.shape
    chirp = np.zeros_like(values) if chirp is None else chirp
    return pa.table({"line": np.tile(np.arange(k), m), "place": np.repeat(line, k), "n": np.full(m * k, n),
                     "re": values.real.ravel(), "im": values.imag.ravel(), "chirp_re": chirp.real.ravel(), "chirp_im": chirp.imag.ravel()})


def _filled(t: pa.Table, lines: np.ndarray, width: int, name: str = "") -> np.ndarray:
    out = np.zeros((len(lines), width), complex)
    at = np.searchsorted(lines, t["line"].to_numpy()), t["place"].to_numpy()
    out[at] = t[f"{name}re"].to_numpy() + 1j * t[f"{name}im"].to_numpy()
    return out


def _columns(t: pa.Table) -> pa.Table:
    """Columns of the grid, times the chirp, transformed; beside them the chirp itself."""
    n, rows, cols, lines = _lines(t)
    index = lines[:, None] + cols * np.arange(rows)
    back = rows * cols - index
    own = np.where(index < n, _chirp(np.minimum(index, n - 1), n), np.where(back < n, _chirp(np.minimum(back, n - 1), n), 0))
    values = _filled(t, lines, rows) * np.where(index < n, own.conj(), 0)
    turn = _turn(lines, np.arange(rows), rows * cols)
    return _rows(lines, n, np.fft.fft(values) * turn, np.fft.fft(own) * turn)


def _spectrum_rows(t: pa.Table) -> pa.Table:
    """Rows of the grid: the rest of both transforms, their product, and the first half of its way back."""
    n, rows, cols, lines = _lines(t)
    product = np.fft.fft(_filled(t, lines, cols)) * np.fft.fft(_filled(t, lines, cols, "chirp_"))
    return _rows(lines, n, np.fft.ifft(product) * _turn(lines, np.arange(cols), rows * cols).conj())


def _powers(t: pa.Table) -> pa.Table:
    """The columns back; the chirp that is left has length one, so the power needs none."""
    n, rows, cols, lines = _lines(t)
    found = np.abs(np.fft.ifft(_filled(t, lines, rows))) ** 2 / n
    k = lines[:, None] + cols * np.arange(rows)
    inside = k < n
    return pa.table({"k": k[inside], "n": np.full(int(inside.sum()), n), "power": found[inside]})


def power_spectrum(rows: DataFrame) -> DataFrame:
    """(k, n, power) for every k below n, from (i, d, n): value d at index i of n values; power is |DFT|^2 / n."""
    bits = F.length(F.bin(2 * F.col("n") - 2))
    two = lambda b: F.pow(F.lit(2.0), F.floor(b)).cast("long")
    by = lambda df, across: df.groupBy("n", F.floor(F.col("line") / F.greatest(F.lit(1), F.lit(GROUP_VALUES) / across)).alias("group"))
    height, width = two((bits + 1) / 2), two(bits / 2)
    checked = F.when(F.col("n") <= MOST_VALUES, F.col("n")).otherwise(F.raise_error(F.lit(f"a series of more than {MOST_VALUES} values")))
    none = F.lit(0.0)
    grid = rows.filter("n > 1").select((F.col("i") % width).alias("line"), F.floor(F.col("i") / width).alias("place"), checked.cast("long").alias("n"),
                                       F.col("d").cast("double").alias("re"), none.alias("im"), none.alias("chirp_re"), none.alias("chirp_im"))
    first = by(grid, height).applyInArrow(_columns, GRID)
    second = by(first, width).applyInArrow(_spectrum_rows, GRID)
    return by(second, height).applyInArrow(_powers, "k long, n long, power double")
