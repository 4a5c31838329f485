"""Column roles: which column is the entity key, the response, and so on.  Rows carry their data by name, never by place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Roles:
    key: str
    response: str
    auxiliary: str | None = None
    group: str | None = None
    timestamp: str | None = None
    features: str | None = None

    def columns(self) -> list[str]:
        return list(dict.fromkeys(c for c in (self.key, self.response, self.auxiliary, self.group, self.timestamp, self.features) if c))
