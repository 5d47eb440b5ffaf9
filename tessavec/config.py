"""What a collection promises about its rows."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

DISTANCES = ("dot", "cosine")


@dataclass(frozen=True)
class CollectionConfig:
    """``indexed``: item fields promoted to columns of their own, by name and SQL type.

    ``paths``: where an indexed field stands in the item, as a JSON path, if not at the top under its name.
    ``partition_size``: rows are dealt into parts of so many ordinals, each a folder of its own in storage.
    """

    dim: int
    distance: str = "dot"
    max_count: int | None = None
    metadata_max_bytes: int | None = None
    partition_size: int | None = None
    indexed: dict[str, str] = field(default_factory=dict)
    paths: dict[str, str] = field(default_factory=dict)

    def healthy(self) -> bool:
        return self.dim > 0 and self.distance in DISTANCES and (self.partition_size is None or self.partition_size > 0)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def from_json(text: str) -> CollectionConfig:
        return CollectionConfig(**json.loads(text))
