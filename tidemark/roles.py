"""Column roles: which column is the time, the target, the entity and so on."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Roles:
    """Names of the columns a job works on.

    ``entity`` splits a table into independent series; without it the whole
    table is one series.  ``tie`` makes (time, tie) a total order, which
    every positional operator needs.
    """

    time: str = "timestamp"
    target: str = "price"
    entity: str | None = None
    tie: tuple[str, ...] = ()
    numeric: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    extra: tuple[str, ...] = field(default=())

    @property
    def by(self) -> tuple[str, ...]:
        return (self.entity,) if self.entity else ()

    @property
    def order(self) -> tuple[str, ...]:
        return (self.time, *self.tie)

    def model_columns(self, columns: list[str]) -> list[str]:
        """Every column except the time and the target, in table order."""
        return [c for c in columns if c not in (self.time, self.target)]
