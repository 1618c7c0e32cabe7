"""Tables of a fixed size that sum up a whole column: word counts by cell, and Bloom filters.

Each task fills its own part, parts are combined by cell before and after one
shuffle, and the driver gets one array whose size is a parameter: it does not grow
with the data. A table that is too small for the data only becomes less sharp.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilmoch.llm.codepoints import mix64

#: Cells of one row of the count table, and its rows; a word's count is the least of its cells.
CELLS, ROWS = 1 << 18, 2
#: 64-bit words of a Bloom filter (8 MB), and bits per entry.
BLOOM_WORDS, BLOOM_BITS = 1 << 20, 4
_STEPS = 8
_PART = 1 << 15


def _packed(cells: DataFrame, size: int, kind: type) -> np.ndarray:
    """``(cell, v)`` rows as one array of the given size: packed by ranges of cells first, so what reaches the driver is of one size whatever the data."""

    def pack(t: pa.Table) -> pa.Table:
        at = t["cell"].to_numpy()
        out = np.zeros(_PART, kind)
        out[at % _PART] = t["v"].to_numpy().astype(np.int64).view(np.uint64).astype(kind)
        return pa.table({"part": pa.array([int(at[0]) // _PART], pa.int32()), "bytes": pa.array([out.tobytes()], pa.binary())})

    out = np.zeros(size, kind)
    for r in cells.groupBy(F.shiftright("cell", 15).alias("_p")).applyInArrow(pack, "part int, bytes binary").toArrow().to_pylist():
        out[r["part"] * _PART : (r["part"] + 1) * _PART] = np.frombuffer(r["bytes"], kind)
    return out


def _cells(words: np.ndarray) -> np.ndarray:
    """ROWS x words: the cell of each word in each row of the count table."""
    w = np.ascontiguousarray(words, np.int32).view(np.uint32).astype(np.uint64)
    return np.stack([(mix64(w + np.uint64((r + 1) << 40)) >> np.uint64(46)).astype(np.int64) + r * CELLS for r in range(ROWS)])


def count_codes(df: DataFrame, words: str) -> np.ndarray:
    """uint8 table of ROWS x CELLS: eight times the binary logarithm of the occurrences of each cell's words in an int array column."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ROWS * CELLS, np.int64)
        for batch in batches:
            w = np.asarray(batch.column(words).flatten())
            if len(w):
                for cell in _cells(w):
                    np.add.at(total, cell, 1)
        at = np.flatnonzero(total)
        for i in range(0, len(at), 1 << 17):
            part = at[i : i + (1 << 17)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(total[part])], ["cell", "n"])

    counts = df.select(words).where(F.col(words).isNotNull()).mapInArrow(count, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    code = F.least(F.lit(255), F.floor(F.lit(float(_STEPS)) * F.log2("n")) + 1)  # 0 is left to words that never occur
    return _packed(counts.select("cell", code.cast("bigint").alias("v")), ROWS * CELLS, np.uint8)


def codes_of(words: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The count code of each word."""
    return codes[_cells(words)].min(axis=0) if len(words) else np.zeros(0, np.uint8)


def code_counts() -> np.ndarray:
    """The number of occurrences that each of the 256 codes stands for."""
    return np.where(np.arange(256) > 0, 2.0 ** ((np.arange(256) - 1) / _STEPS), 0.0)


def _bits(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word and mask of each hash's bits in a Bloom filter: all bits of an entry lie in one word."""
    h = mix64(hashes.astype(np.uint64) ^ np.uint64(0x2545F4914F6CDD1D))
    mask = np.zeros(len(h), np.uint64)
    for j in range(BLOOM_BITS):
        mask |= np.uint64(1) << ((h >> np.uint64(6 * j)) & np.uint64(63))
    return (h >> np.uint64(44)).astype(np.int64), mask


def bloom(df: DataFrame, column: str) -> np.ndarray:
    """Bloom filter of a bigint column's values: a table of BLOOM_WORDS 64-bit words; nulls are left out."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BLOOM_WORDS, np.uint64)
        for batch in batches:
            at, mask = _bits(batch.column(column).to_numpy(zero_copy_only=False).view(np.uint64))
            np.bitwise_or.at(bits, at, mask)
        at = np.flatnonzero(bits)
        for i in range(0, len(at), 1 << 17):
            part = at[i : i + (1 << 17)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(bits[part].view(np.int64))], ["cell", "b"])

    cells = df.select(column).where(F.col(column).isNotNull()).mapInArrow(fill, "cell int, b bigint")
    return _packed(cells.groupBy("cell").agg(F.bit_or("b").alias("v")), BLOOM_WORDS, np.uint64)


def in_bloom(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which hashes may be in the filter; every one that is passes."""
    at, mask = _bits(hashes)
    return (bits[at] & mask) == mask
