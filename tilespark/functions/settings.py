"""The rules that a run's settings follow, stated once: for one run as Python values, for many as Columns."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilespark.functions import labels
from tilespark.functions import mercator as m

PLACES = ("{z}", "{x}", "{y}")


def lacks(template: Any, part: str) -> Any:
    return ~F.contains(template, F.lit(part)) if isinstance(template, Column) else part not in template


def beyond(chunk: Any, kind: Any) -> Any:
    """Whether a chunk is too long for its format; unknown formats have no limit here."""
    if isinstance(chunk, Column):
        return F.coalesce(chunk > labels.longest_side(kind), F.lit(False))
    return chunk > labels.LONGEST_SIDE.get(kind, chunk)


#: (what is said, the rule that is broken) in the order in which they are told. Each takes the settings by name; both forms share the operators.
RULES: list[tuple[str, Callable[[Mapping[str, Any]], Any]]] = [
    ("-zoom must be 0-23", lambda s: (s["max_zoom"] < 0) | (s["max_zoom"] > 23)),
    ("-min-zoom must be between 0 and -zoom", lambda s: (s["min_zoom"] < 0) | (s["min_zoom"] > s["max_zoom"])),
    ("-q must be 1-100", lambda s: (s["quality"] < 1) | (s["quality"] > 100)),
    ("-j must be 1-64", lambda s: (s["workers"] < 1) | (s["workers"] > 64)),
    ("-max-tiles must be positive", lambda s: s["max_tiles"] < 1),
    (f"-chunk must be at least {m.TILE}", lambda s: s["chunk"] < m.TILE),
    ("-coverage must be in (0, 1]", lambda s: (s["coverage"] <= 0) | (s["coverage"] > 1)),
    ("-detail must be >= 0", lambda s: s["detail"] < 0),
    ("-url must contain {z}, {x} and {y}", lambda s: (s["url"] != "") & (lacks(s["url"], "{z}") | lacks(s["url"], "{x}") | lacks(s["url"], "{y}"))),
    ("-chunk exceeds the longest side of the format", lambda s: beyond(s["chunk"], s["format"])),
]
#: Settings that break no rule; what a caller doesn't give has these values.
DEFAULTS: dict[str, Any] = {"max_zoom": 23, "min_zoom": 1, "quality": 90, "workers": 16, "max_tiles": 20_000, "chunk": 8192, "coverage": 0.5, "detail": 0.2, "url": "", "format": "png"}


def error_of(**given: Any) -> str | None:
    """The first rule that settings break."""
    known = DEFAULTS | given
    return next((said for said, broken in RULES if broken(known)), None)


def check(**given: Any) -> None:
    said = error_of(**given)
    if said:
        raise ValueError(said)


def error_column(**given: Column) -> Column:
    """The same for a table with a setting a column; null where no rule is broken."""
    known = {k: given.get(k, F.lit(v)) for k, v in DEFAULTS.items()}
    return F.coalesce(*[F.when(broken(known), said) for said, broken in RULES])
