"""Sum-product networks: their nodes, leaves and parameters. structure.py learns them, descent.py samples them."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import descent, quantiles, structure
from tessera.operators.dp import PrivacyLedger
from tessera.types import CATEGORICAL, NON_STD, ColumnSpec


@dataclass
class SPNParams:
    """M16."""

    beta: int = 100_000
    private: bool = False
    epsilon: float = 2.0
    p_value: float = 0.05
    max_clusters: int = 4
    max_depth: int = 4
    structure_fraction: float = 0.35
    seed: int = 0


@dataclass
class Node:
    """kind: sum, product, categorical, histogram or constant."""

    kind: str
    scope: list[str]
    weights: list[float] = field(default_factory=list)
    children: list[Node] = field(default_factory=list)
    codes: list[float] = field(default_factory=list)
    probs: list[float] = field(default_factory=list)
    edges: list[float] = field(default_factory=list)
    null: float = 0.0
    value: float | None = None

    def to_json(self) -> dict:
        return asdict(self)

    @classmethod
    def from_json(cls, d: dict) -> Node:
        return cls(**d | {"children": [cls.from_json(c) for c in d.get("children", [])]})

    def count(self) -> int:
        return 1 + sum(c.count() for c in self.children)


class SPN:
    def __init__(self, params: SPNParams, specs: list[ColumnSpec], root: Node | None = None, ledger: PrivacyLedger | None = None):
        self.params, self.specs, self.root, self.ledger = params, {s.name: s for s in specs}, root, ledger

    @property
    def columns(self) -> list[str]:
        return [c for c, s in self.specs.items() if s.kind != NON_STD]

    # learning

    def fit(self, encoded: DataFrame) -> SPN:
        """M6: from an encoded frame; deterministic but for noise under privacy."""
        p = self.params
        if p.private and self.ledger is None:
            self.ledger = PrivacyLedger(p.epsilon, max(len(self.columns), 1), p.max_depth, p.structure_fraction, measured_domain=any(s.domain_source == "data" for s in self.specs.values()))
        specs = {c: self.specs[c] for c in self.columns}
        node = lambda kind, scope, weights, children: Node(kind, scope, weights, children)
        leaves = lambda rows, groups: make_leaves(rows, {n: [specs[c] for c in o.scope] for n, o in groups.items()}, self.ledger)
        self.root = structure.grow(encoded, specs, p, self.ledger, dependent, node, leaves) if specs else None
        return self

    # sampling

    def sample(self, rows: DataFrame, rid: str, seed: int, stream: str, evidence: dict[str, Column] | None = None) -> DataFrame:
        """Rows with a value of every column; evidence columns are copied and shape the choice of components."""
        out = descent.sample(rows, self.root, self.columns, rid, seed, stream, evidence) if self.columns else rows
        return out.withColumns({c: F.lit(0.0) for c, s in self.specs.items() if s.kind == NON_STD})

    # persistence

    def to_json(self) -> dict:
        return {"engine": "SPN", "params": asdict(self.params), "specs": [s.to_json() for s in self.specs.values()], "root": self.root.to_json(), "privacy": self.ledger.report() if self.ledger else None}

    @classmethod
    def from_json(cls, d: dict) -> SPN:
        return cls(SPNParams(**d["params"]), [ColumnSpec(**s) for s in d["specs"]], Node.from_json(d["root"]))


def chi_square(cells: dict[tuple[float, float], float]) -> tuple[float, int]:
    """The statistic (with Yates' correction for two by two) and its degrees of freedom."""
    rows, cols = sorted({x for x, _ in cells}), sorted({y for _, y in cells})
    n = sum(cells.values())
    rs = {x: sum(cells.get((x, y), 0) for y in cols) for x in rows}
    cs = {y: sum(cells.get((x, y), 0) for x in rows) for y in cols}
    df = (len(rows) - 1) * (len(cols) - 1)
    stat = 0.0
    for x in rows:
        for y in cols:
            e = rs[x] * cs[y] / n if n else 0
            if e > 0:
                d = abs(cells.get((x, y), 0) - e)
                stat += (max(d - min(0.5, d), 0) if df == 1 else d) ** 2 / e
    return stat, df


def chi_square_p(stat: float, df: int) -> float:
    """Upper tail of the chi-square distribution, by the incomplete gamma function (series below, continued fraction above)."""
    if df <= 0:
        return 1.0
    a, x = df / 2, stat / 2
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-15:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - front * total)
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return min(1.0, front * h)


def dependent(cells: dict[tuple[float, float], float], p_value: float = 0.05) -> bool:
    """M8: too few rows to tell count as dependent, constants as independent."""
    if sum(cells.values()) < 20:
        return True
    if len({x for x, _ in cells}) < 2 or len({y for _, y in cells}) < 2:
        return False
    return chi_square_p(*chi_square(cells)) < p_value


def make_leaves(rows: DataFrame, groups: dict[int, list[ColumnSpec]], ledger: PrivacyLedger | None = None) -> dict[int, list[Node]]:
    """{group: leaves of its columns} from rows with `_node`: one aggregate for figures, exact edges, one count by column and bin.

    Under privacy every code of the domain, every bin and the null are noisy counts, whether they occur or not.
    """
    specs = {s.name: s for cols in groups.values() for s in cols}
    num = [c for c, s in specs.items() if s.kind != CATEGORICAL]
    edges: dict[tuple[int, str], list[float]] = {}
    n: dict[int, int] = dict.fromkeys(groups, 0)
    some: dict[tuple[int, str], int] = {}
    if ledger:
        edges = {(g, s.name): [s.low + (s.high - s.low) * i / 16 for i in range(17)] for g, cols in groups.items() for s in cols if s.kind != CATEGORICAL}
    else:
        for r in rows.groupBy("_node").agg(F.count("*").alias("n"), *[F.count(F.col(f"`{c}`")).alias(f"n_{c}") for c in num]).collect():
            n[r["_node"]] = r["n"]
            some |= {(r["_node"], c): r[f"n_{c}"] for c in num}
        bins = lambda k: min(32, max(4, int(math.sqrt(max(k, 1)))))
        mine = {(g, s.name) for g, cols in groups.items() for s in cols}
        shares = lambda g, c, k: [i / bins(k) for i in range(bins(k) + 1)] if (g, c) in mine else []
        edges = {k: sorted(set(v)) for k, v in quantiles.grouped(rows, "_node", num, shares).items() if v}
    for e in edges.values():
        if len(e) > 1:
            e[-1] = math.nextafter(e[-1], math.inf)
    names = list(specs)
    whole = {c for c in names if specs[c].kind == CATEGORICAL}
    look = {g: [(s.name, names.index(s.name), np.array(edges.get((g, s.name), []), float)) for s in cols] for g, cols in groups.items()}

    def cells(g, values):
        for c, i, e in look.get(g, ()):
            x, null = values[c]
            b = x if c in whole else np.clip(np.searchsorted(e, x, "right") - 1, 0, max(len(e) - 2, 0))
            for v, k in zip(*(a.tolist() for a in np.unique(np.where(null, -1.0, b), return_counts=True)), strict=True):
                yield i, 0, v, 0.0, k

    counts: dict[tuple[int, str], dict[float, float]] = {}
    of = rows.select("_node", *[F.col(f"`{c}`").cast("double").alias(c) for c in names])
    for (g, c, _, b, _), k in structure.counted(of, cells).items():
        counts.setdefault((g, names[c]), {})[b] = k
    return {g: [_leaf(s, counts.get((g, s.name), {}), edges.get((g, s.name), []), n[g], some.get((g, s.name), 0), ledger) for s in cols] for g, cols in groups.items()}


def _leaf(s: ColumnSpec, got: dict[float, float], e: list[float], n: int, some: int, ledger: PrivacyLedger | None) -> Node:
    """A leaf of the counts by bin (-1: null): of n rows some have a value."""
    if s.kind == CATEGORICAL:
        codes = [-1.0, *(float(i) for i in range(len(s.categories)))] if ledger else sorted(got)
        v = [got.get(c, 0.0) for c in codes]
        if ledger:
            v = ledger.counts(v, ledger.per_column, f"column_{s.name}")
        t = sum(v) or 1.0
        return Node("categorical", [s.name], codes=codes, probs=[x / t for x in v]) if codes else Node("constant", [s.name])
    if len(e) < 2:
        if 0 < some < n:
            return Node("histogram", [s.name], probs=[1.0], edges=[e[0], math.nextafter(e[0], math.inf)], null=1 - some / n)
        return Node("constant", [s.name], value=e[0] if e else None)
    v, null = [got.get(float(i), 0.0) for i in range(len(e) - 1)], got.get(-1.0, 0.0)
    if ledger:  # one histogram with the nulls as a bin of their own, so that the budget is spent once (Q6)
        v = ledger.counts([*v, null], ledger.per_column, f"column_{s.name}")
        null = v.pop()
    t = sum(v)
    return Node("histogram", [s.name], probs=[x / t for x in v] if t else [1 / len(v)] * len(v), edges=e, null=null / ((t + null) or 1.0))
