"""Discrete Fourier sums of series of any length by a four-step transform.

A sum of any length n is a convolution with a chirp, of a length L that is a power of two and at least 2n.
L = R * C is laid out as a matrix, and a transform of length L becomes transforms of its rows, a twist by
powers of exp(-2 pi i / L), an exchange that turns rows into columns, and transforms of the columns.
Forward and inverse transform meet in the columns, so a series takes three exchanges in all: rows to
groups of matrix rows, tiles to groups of columns, and tiles back.  The work is n log n; a task holds a
group of rows or columns of at most some ``PIECE`` numbers, and tiles are packed arrays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE = 1 << 16     # complex numbers that a task transforms at once, or one row of the matrix if that is longer

_TILES = pa.schema([("post", pa.string()), ("n", pa.int64()), ("src", pa.int64()), ("dst", pa.int64()), ("data", pa.list_(pa.float64()))])
_TILES_DDL = "post string, n bigint, src bigint, dst bigint, data array<double>"
_SUMS = pa.schema([("post", pa.string()), ("n", pa.int64()), ("k", pa.int64()), ("re", pa.float64()), ("im", pa.float64())])
_SUMS_DDL = "post string, n bigint, k bigint, re double, im double"


def shape(n: int) -> tuple[int, int]:
    """Rows and columns of the matrix of a series of n values."""
    bits = (2 * n - 1).bit_length()
    return 1 << (bits - bits // 2), 1 << (bits // 2)


def lines(length: int, count: int, piece: int) -> int:
    """How many of ``count`` lines of this length one task takes."""
    return min(count, max(1, piece // length))


def chirp(m: np.ndarray, n: int) -> np.ndarray:
    """exp(-i pi m^2 / n), the square reduced before it loses digits."""
    return np.exp(-1j * np.pi * ((m * m) % (2 * n)) / n)


def _twist(a: np.ndarray, b: np.ndarray, size: int, sign: int) -> np.ndarray:
    return np.exp(sign * 2j * np.pi * (np.outer(a, b) % size) / size)


def _tiles(post: str, n: int, src: int, parts: list[np.ndarray], width: int) -> pa.Table:
    """Matrices of equal shape, cut into tiles of ``width`` columns; the tiles of a place are packed together."""
    out = []
    for d, at in enumerate(range(0, parts[0].shape[1], width)):
        packed = np.concatenate([np.ascontiguousarray(p[:, at: at + width]).view(np.float64).ravel() for p in parts])
        out.append((post, n, src, d, packed))
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _TILES)], schema=_TILES)


def _joined(table: pa.Table, parts: int, width: int) -> list[np.ndarray]:
    """The tiles of a group of columns put together in the order of their sources."""
    order = np.argsort(table.column("src").to_numpy(), kind="stable")
    data = table.column("data").combine_chunks()
    blocks = [np.asarray(data[int(i)].values).view(np.complex128).reshape(parts, -1, width) for i in order]
    whole = np.concatenate(blocks, axis=1)
    return [whole[p] for p in range(parts)]


def _rows(piece: int):
    """Values of a group of matrix rows -> transformed rows of the series and of the chirp, in tiles."""

    def run(key, table):
        post, n, g = key[0].as_py(), key[1].as_py(), key[2].as_py()
        r, c = shape(n)
        size, taken = r * c, lines(c, r, piece)
        first = g * taken
        m, x = table.column("m").to_numpy(), table.column("x").to_numpy()
        a = np.zeros((taken, c), complex)
        a[m % r - first, m // r] = x * chirp(m, n)
        row, place = np.arange(first, first + taken), np.arange(c)
        m = row[:, None] + r * place[None, :]
        near = np.minimum(m, size - m)                    # the chirp is even, and zero between both ends
        b = np.where(near < n, np.conj(chirp(near, n)), 0)
        turn = _twist(row, place, size, -1)
        return _tiles(post, n, g, [np.fft.fft(a, axis=1) * turn, np.fft.fft(b, axis=1) * turn], lines(r, c, piece))

    return run


def _columns(piece: int):
    """A group of columns: end of the forward transform, product, begin of the inverse one."""

    def run(key, table):
        post, n, h = key[0].as_py(), key[1].as_py(), key[2].as_py()
        r, c = shape(n)
        width = lines(r, c, piece)
        a, b = _joined(table, 2, width)
        y = np.fft.ifft(np.fft.fft(a, axis=0) * np.fft.fft(b, axis=0), axis=0)
        column = np.arange(h * width, h * width + width)
        y = (y * _twist(np.arange(r), column, r * c, 1)).T
        return _tiles(post, n, h, [y], lines(c, r, piece))

    return run


def _back(piece: int):
    """A group of rows of the result: end of the inverse transform and the sums of frequencies 1..n/2."""

    def run(key, table):
        post, n, g = key[0].as_py(), key[1].as_py(), key[2].as_py()
        r, c = shape(n)
        taken = lines(c, r, piece)
        y = np.fft.ifft(_joined(table, 1, taken)[0], axis=0)
        k = np.arange(g * taken, g * taken + taken)[None, :] + r * np.arange(c)[:, None]
        wanted = (k >= 1) & (k <= n // 2)
        k, y = k[wanted], y[wanted]
        z = y * chirp(k, n)
        return pa.Table.from_arrays([pa.array([post] * len(k), pa.string()), pa.array(np.full(len(k), n)), pa.array(k), pa.array(z.real.copy()), pa.array(z.imag.copy())], schema=_SUMS)

    return run


def fourier_sums(values: DataFrame, piece: int | None = None) -> DataFrame:
    """(post, n, k, re, im) of sum_m x_m exp(-2 pi i m k / n) for k = 1..n/2.

    ``values`` holds (post, n, m, x), every m from 0 to n - 1 once; posts of fewer than four values have none.
    """
    piece = piece or PIECE
    bits = F.length(F.conv((2 * F.col("n") - 1).cast("string"), 10, 2))
    half = F.floor(bits / 2).cast("int")
    r, c = F.expr("shiftleft(1L, _bits - _half)"), F.expr("shiftleft(1L, _half)")
    taken = F.least(r, F.greatest(F.lit(1).cast("bigint"), F.floor(F.lit(piece) / c)))
    rows = values.filter("n >= 4").withColumn("_bits", bits.cast("int")).withColumn("_half", half)
    rows = rows.select("post", F.col("n").cast("bigint").alias("n"), F.floor(F.pmod(F.col("m"), r) / taken).cast("bigint").alias("g"), F.col("m").cast("bigint").alias("m"), F.col("x").cast("double").alias("x"))
    first = rows.groupBy("post", "n", "g").applyInArrow(_rows(piece), _TILES_DDL)
    second = first.groupBy("post", "n", "dst").applyInArrow(_columns(piece), _TILES_DDL)
    return second.groupBy("post", "n", "dst").applyInArrow(_back(piece), _SUMS_DDL)
