"""How many files a set of rows becomes."""

from __future__ import annotations

from collections.abc import Iterable


def files_for(total_bytes: int, target_bytes: int) -> int:
    """Range partitions of about the target size; the file that ends the data may be smaller."""
    return max(1, -(-total_bytes // max(1, target_bytes)))


def greedy_cuts(sizes: Iterable[int], target_bytes: int) -> list[int]:
    """Rows in each file if a file closes after the row that makes it larger than the target.

    The exact rule for rows that come one after another on one machine; files_for() is its
    distributed form.
    """
    cuts, rows, held = [], 0, 0
    for n in sizes:
        rows, held = rows + 1, held + n
        if held > target_bytes:
            cuts.append(rows)
            rows, held = 0, 0
    return [*cuts, rows] if rows else cuts
