"""Registry specifications: one record per dictionary, read by one engine."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from varlex import fixed
from varlex.functions.text import template_fields

ROW_INDEX = "row_index"


@dataclass(frozen=True)
class RegistrySpec:
    """How one registry's rows become store rows.

    ``fill`` maps canonical columns to defaults; ``None`` means every null
    becomes an empty string.  ``on_missing`` says what happens when nothing
    has landed: ``raise``, ``seed`` or ``skip``.
    """

    key: str
    display: str
    source: str
    columns: list[str]
    id: str
    indicator: str
    document: str
    short_name: str
    metadata: Mapping[str, str] = field(default_factory=dict)
    rename: Mapping[str, str] = field(default_factory=dict)
    fill: Mapping[str, str] | None = None
    backfill: list[str] = field(default_factory=list)
    language: str | None = None
    dedup: str | None = None
    cap: int | None = None
    detect: bool = False
    on_missing: str = "raise"
    seed: list[Mapping[str, str]] = field(default_factory=list)

    @property
    def needs_row_index(self) -> bool:
        return ROW_INDEX in template_fields(self.id) | template_fields(self.indicator)

    @property
    def unique_ids(self) -> bool:
        """Whether rows without duplicates have different ids: the id is the key, put into a text."""
        return bool(self.dedup) and template_fields(self.id) == {self.dedup} and self.id.count("{%s}" % self.dedup) == 1


def _load(table: Mapping[str, Mapping]) -> dict[str, RegistrySpec]:
    return {key: RegistrySpec(key=key, **values) for key, values in table.items()}


MODEL_SPECS = _load(fixed.MODEL_REGISTRIES)
HASH_SPECS = _load(fixed.HASH_REGISTRIES)


def select_specs(
    specs: Mapping[str, RegistrySpec], keys: Iterable[str] = ("all",)
) -> dict[str, RegistrySpec]:
    """Chosen registries in the order asked for; ``all`` expands to every one."""
    wanted = list(keys)
    unknown = [k for k in wanted if k != "all" and k not in specs]
    if unknown:
        raise ValueError(f"unknown registries {unknown}; choose from {[*specs, 'all']}")
    return dict(specs) if "all" in wanted else {k: specs[k] for k in wanted}
