"""Source adapters by jurisdiction id. New ones are added with ``register``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from spendlake.sources import disclosure, ocds, portals

Adapter = Callable[..., DataFrame]

_ADAPTERS: dict[str, Adapter] = {}


def register(source: str, adapter: Adapter) -> None:
    """``adapter`` maps raw rows to notices with a ``reject_reason`` column."""
    _ADAPTERS[source] = adapter


def available() -> list[str]:
    return sorted(_ADAPTERS)


def adapter(source: str) -> Adapter:
    if source not in _ADAPTERS:
        raise KeyError(f"unknown source {source!r}; available: {', '.join(available())}")
    return _ADAPTERS[source]


register("federal", ocds.to_notices)
register("nsw", portals.nsw_notices)
register("vic", portals.vic_notices)
register("sa", portals.sa_notices)
register("qld", disclosure.to_notices)
register("wa", portals.wa_notices)
