"""Differential privacy: budget, mechanisms and a ledger that adds up what was spent.

Noise falls on aggregates, on the driver. It comes from the operating system's entropy unless a test asks for a seed (Q3).
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass, field


def _noise(scale: float, rng: random.Random) -> float:
    u = rng.random() - 0.5
    return -scale * math.copysign(1.0, u) * math.log(max(1 - 2 * abs(u), 1e-300))


@dataclass
class Entry:
    stage: str
    mechanism: str
    epsilon: float
    count: int = 1


@dataclass
class PrivacyLedger:
    """35 % of epsilon for structure, shared by levels, and the rest for parameters, shared by columns and the weights of sums.

    A level's share goes to sizes (a fifth), tables and centres (two fifths each). Nodes of different rows compose in parallel; nodes that
    a product sets apart are of the same rows and divide what their parent had, so a row meets each share once at most. A (stage,
    mechanism) is therefore charged in full once, and groups add up: what is spent is never above epsilon, whatever the tree.
    """

    epsilon: float
    columns: int
    max_depth: int = 4
    structure: float = 0.35
    seed: int | None = None
    measured_domain: bool = False
    entries: dict[tuple[str, str], Entry] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.rng = random.SystemRandom() if self.seed is None else random.Random(self.seed)

    @property
    def per_level(self) -> float:
        return self.epsilon * self.structure / max(self.max_depth, 1)

    @property
    def per_column(self) -> float:
        return self.epsilon * (1 - self.structure) / (max(self.columns, 1) + 1)

    @property
    def per_weights(self) -> float:
        """A level's part of what a column has: the weights of its sums."""
        return self.per_column / max(self.max_depth, 1)

    def noise(self, scale: float) -> float:
        return _noise(scale, self.rng)

    def record(self, stage: str, mechanism: str, epsilon: float) -> None:
        e = self.entries.setdefault((stage, mechanism), Entry(stage, mechanism, 0.0, 0))
        e.epsilon, e.count = max(e.epsilon, epsilon), e.count + 1

    def counts(self, values: list[float], epsilon: float, stage: str, sensitivity: float = 1.0) -> list[float]:
        """Laplace noise, never below zero; all zero becomes all one."""
        self.record(stage, "laplace", epsilon)
        out = [max(v + _noise(sensitivity / epsilon, self.rng), 0.0) for v in values]
        return out if any(out) else [1.0] * len(out)

    def node_size(self, n: float, level: int, share: float = 1.0) -> float:
        """D3: a fifth of a level's share."""
        e = 0.2 * self.per_level
        self.record(f"level{level}", "node_size", e)
        return max(n + self.noise(1 / (e * share)), 0.0)

    def contingency(self, cells: list[float], pairs: int, level: int, share: float = 1.0) -> list[float]:
        """Two fifths of a level's share over all pairs, sensitivity 2."""
        e = 0.4 * self.per_level
        self.record(f"level{level}", "contingency", e)
        return [max(v + self.noise(2 * max(pairs, 1) / (e * share)), 0.0) for v in cells]

    def kmeans_share(self, level: int) -> float:
        """Two fifths of a level's share, for all rounds of all its nodes."""
        e = 0.4 * self.per_level
        self.record(f"level{level}", "kmeans", e)
        return e

    def weights(self, values: list[float], level: int, share: float = 1.0) -> list[float]:
        """Rows of a sum's children, of which none loses its place: noisy, never below zero, all one where all are zero."""
        self.record(f"level{level}", "weights", self.per_weights)
        out = [max(v + self.noise(1 / (self.per_weights * share)), 0.0) for v in values]
        return out if any(out) else [1.0] * len(out)

    def report(self) -> dict:
        spent = sum(e.epsilon for e in self.entries.values())
        caveats = ["domains were measured from data, so the guarantee holds only given them"] if self.measured_domain else []
        return {"epsilon": self.epsilon, "spent": spent, "entries": [vars(e) for e in self.entries.values()], "caveats": caveats}


def degree_histogram(counts: dict[int, int], epsilon: float, cap: int, ledger: PrivacyLedger) -> dict[int, float]:
    """At most 16 bins over 0..cap, noised; bins up to 1/epsilon are dropped, the rest spread within. None left: uniform (Q5)."""
    width = max(1, -(-(cap + 1) // 16))
    bins = [0.0] * (-(-(cap + 1) // width))
    for d, n in counts.items():
        bins[min(d, cap) // width] += n
    noisy = ledger.counts(bins, epsilon, "degrees")
    keep = {b: v for b, v in enumerate(noisy) if v > 1 / epsilon}
    if not keep:
        return {d: 1 / (cap + 1) for d in range(cap + 1)}
    out: dict[int, float] = {}
    total = sum(keep.values())
    for b, v in keep.items():
        inside = [d for d in range(b * width, (b + 1) * width) if d <= cap]
        for d in inside:
            out[d] = v / total / len(inside)
    return out
