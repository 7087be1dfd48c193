"""A driver-side cursor over a view in comparator order, moving either way between bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.model import InvalidArgsError
from keystrata.operators.keys import host_sort_key, is_descending


class Cursor:
    """Steps over a view (key, value, sort_key); reads pages of ``page`` rows, so a range is never held whole.

    The view is what it was built from: later commits are not seen. Seeks stay within the view's bounds. Any mix of
    ``next`` and ``prev`` gives what a cursor over the sorted rows gives; past either end the cursor is invalid.
    """

    def __init__(self, view: DataFrame, comparator: str = "memcmp", page: int = 256):
        self.view, self.comparator, self.page = view, comparator, page
        self._down = is_descending(comparator)
        self._rows: list[tuple[bytes, bytes, bytes]] = []
        self._at = 0

    def _load(self, forward: bool, start: bytes | None, inclusive: bool) -> None:
        """A page in the given direction from a sort key; kept in comparator order, the cursor on its near end."""
        column = F.col("sort_key")
        up = forward != self._down
        d = self.view
        if start is not None:
            k = F.lit(start)
            d = d.filter((column >= k if inclusive else column > k) if up else (column <= k if inclusive else column < k))
        rows = d.orderBy(column.asc() if up else column.desc()).limit(self.page).select("sort_key", "key", "value").collect()
        found = [(bytes(r[0]), bytes(r[1]), bytes(r[2])) for r in rows]
        self._rows = found if forward else found[::-1]
        self._at = 0 if forward else len(found) - 1

    @property
    def valid(self) -> bool:
        return 0 <= self._at < len(self._rows)

    def _row(self) -> tuple[bytes, bytes, bytes]:
        if not self.valid:
            raise InvalidArgsError("the cursor is not on a row")
        return self._rows[self._at]

    @property
    def key(self) -> bytes:
        return self._row()[1]

    @property
    def value(self) -> bytes:
        return self._row()[2]

    def seek_to_first(self) -> "Cursor":
        self._load(True, None, True)
        return self

    def seek_to_last(self) -> "Cursor":
        self._load(False, None, True)
        return self

    def seek(self, target: bytes) -> "Cursor":
        """The first row at or after the target."""
        self._load(True, host_sort_key(target, self.comparator), True)
        return self

    def seek_for_prev(self, target: bytes) -> "Cursor":
        """The last row at or before the target."""
        self._load(False, host_sort_key(target, self.comparator), True)
        return self

    def next(self) -> "Cursor":
        last = self._row()[0]
        self._at += 1
        if not self.valid:
            self._load(True, last, False)
        return self

    def prev(self) -> "Cursor":
        last = self._row()[0]
        self._at -= 1
        if not self.valid:
            self._load(False, last, False)
        return self
