"""Comparisons of positions that Spark pushes into raster sources, where they narrow the window that is read."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql.datasource import EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, IsNotNull, LessThan, LessThanOrEqual


def _range(f: Filter) -> tuple[float, float] | None:
    """From and to, without the end, of a comparison with whole numbers; None for what a range can't say."""
    values = list(f.value) if isinstance(f, In) else [getattr(f, "value", 0)]
    if not values or not all(type(v) is int for v in values):
        return None
    low, high = min(values), max(values)
    match f:
        case EqualTo() | EqualNullSafe() | In():
            return low, high + 1
        case GreaterThan():
            return low + 1, float("inf")
        case GreaterThanOrEqual():
            return low, float("inf")
        case LessThan():
            return float("-inf"), high
        case LessThanOrEqual():
            return float("-inf"), high + 1
        case IsNotNull():  # positions never are
            return float("-inf"), float("inf")
    return None


class PushedWindow:
    """For readers with ``positions`` (names of columns of positions) and ``window`` (from and to, without the end, of each axis).

    Ranges are read exactly, so Spark need not look at them again; a list of values narrows the window to its ends and is left
    to Spark as well, as are all other filters.
    """

    positions: tuple[str, ...] = ("y", "x")

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        window, left = list(self.window), []
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            limits = _range(f) if name in self.positions else None
            if limits:
                at = self.positions.index(name)
                low, high = window[at]
                low = int(max(low, limits[0]))
                window[at] = (low, max(low, int(min(high, limits[1]))))
            if not limits or isinstance(f, In):
                left.append(f)
        self.window = tuple(window)
        return left


def wants(options) -> bool:
    """Whether the option pushdown is on. Spark refuses readers that take filters unless its setting is on too, and shares what was
    pushed between all uses of a loaded frame; :func:`leafgrid.sources.rasters.open_raster` sees to both."""
    return str(options.get("pushdown", "false")).lower() == "true"
