"""Fact providers: the extension point through which frameworks are added.

A provider turns a table of files into named fact tables. Facts of all providers are united
and go through the same graph, so a new framework never touches the operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

FactProvider = Callable[[DataFrame], dict[str, DataFrame]]

_REGISTRY: dict[str, FactProvider] = {}


def register(name: str, provider: FactProvider) -> None:
    _REGISTRY[name] = provider


def providers() -> dict[str, FactProvider]:
    return dict(_REGISTRY)


def unite_facts(batches: list[dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """Union of fact batches by name; a column one batch lacks is NULL there."""
    out: dict[str, DataFrame] = {}
    for batch in batches:
        for name, facts in batch.items():
            out[name] = out[name].unionByName(facts, allowMissingColumns=True) if name in out else facts
    return out


def collect_facts(files: DataFrame, names: list[str] | None = None) -> dict[str, DataFrame]:
    """Run the registered providers over the files of all projects."""
    chosen = names if names is not None else list(_REGISTRY)
    return unite_facts([_REGISTRY[n](files) for n in chosen])
