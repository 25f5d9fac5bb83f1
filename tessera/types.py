"""Metadata of tables, columns and keys."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

CATEGORICAL, NUMERICAL, DATETIME, TIMEDELTA, NON_STD = "categorical", "numerical", "datetime", "timedelta", "non_std"
OTHER = "__other__"


@dataclass
class ForeignKey:
    table: str
    columns: list[str]
    parent: str
    parent_columns: list[str]
    containment: float = 1.0
    nullable: bool = True
    unique: bool = False


@dataclass
class TableSpec:
    """What is declared of a table."""

    name: str
    primary_key: str | None = None
    foreign_keys: list[ForeignKey] = field(default_factory=list)
    timeseries: bool = False
    static_ids: list[str] = field(default_factory=list)
    sortby: list[str] = field(default_factory=list)
    kinds: dict[str, str] = field(default_factory=dict)
    styles: dict[str, str] = field(default_factory=dict)
    domain: dict[str, dict] = field(default_factory=dict)
    max_degree: int = 200

    def keys(self) -> set[str]:
        return {c for c in [self.primary_key] if c} | {c for f in self.foreign_keys for c in f.columns}

    @classmethod
    def from_config(cls, name: str, config: dict) -> TableSpec:
        """From a plain mapping, as a configuration file has it."""
        many = lambda v: [] if v is None else [v] if isinstance(v, str) else list(v)
        fks = [ForeignKey(name, many(f.get("child_column_names")), f["parent_table_name"], many(f.get("parent_column_names"))) for f in config.get("foreign_keys") or []]
        kinds = {c: k for k in (CATEGORICAL, NUMERICAL, DATETIME, TIMEDELTA, NON_STD) for c in many(config.get(f"{k}_columns"))}
        pk = many(config.get("primary_key"))
        return cls(name, pk[0] if pk else None, fks, bool(config.get("timeseries")), many(config.get("static_ids")), many(config.get("sortby")), kinds, dict(config.get("placeholder_styles") or {}), dict(config.get("column_kwargs") or {}), int(config.get("max_degree") or 200))


@dataclass
class ColumnSpec:
    """What the encoder knows of a column."""

    name: str
    kind: str
    dtype: str = "string"
    categories: list = field(default_factory=list)
    tail: list = field(default_factory=list)
    tail_table: str | None = None  # a table (k, v) of the tail, where it is too long for a list
    tail_size: int = 0
    null_ratio: float = 0.0
    low: float = 0.0
    high: float = 1.0
    median: float = 0.0
    std: float = 1.0
    granularity: float = 0.0
    decimals: int | None = None
    integral: bool = False
    transform: str | None = None
    domain_source: str = "data"
    mirror_of: str | None = None
    style: str = "token"
    formats_table: str | None = None  # of an identifier: tables of its formats and of salted digests of its values
    known_table: str | None = None
    salt: str = ""

    def to_json(self) -> dict:
        return asdict(self)


def to_json(obj) -> str:
    """Dataclasses and plain values as JSON; NaN and infinities as null."""

    def clean(v):
        if hasattr(v, "__dataclass_fields__"):
            v = asdict(v)
        if isinstance(v, dict):
            return {str(k): clean(x) for k, x in v.items()}
        if isinstance(v, (list, tuple, set)):
            return [clean(x) for x in v]
        if isinstance(v, float) and (v != v or v in (float("inf"), float("-inf"))):
            return None
        return v if isinstance(v, (str, int, float, bool, type(None))) else str(v)

    return json.dumps(clean(obj), sort_keys=True)
