"""Learning a sum-product network a level at a time.

Rows carry the ids of the nodes that they are in, one for each group of columns that products have set apart. Whatever a level needs of its
nodes comes from jobs over all of them together: one grouped count for sizes, one for the tables of all pairs of columns, one aggregate a
Lloyd round for all nodes and seeds, and one pass that moves rows to the next level. Jobs grow with depth, not with nodes.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import quantiles
from tessera.operators.dp import PrivacyLedger
from tessera.sources.tables import settled
from tessera.types import CATEGORICAL, ColumnSpec

SEEDS, ROUNDS, PRIVATE_ROUNDS = 4, 10, 3
#: Different rows of a node that first centres are chosen from.
CANDIDATES = 512


@dataclass
class Open:
    """A node whose rows and columns are known and whose kind is not."""

    id: int
    scope: list[str]
    share: float = 1.0  # of a level's budget: columns that a product parts are of the same rows
    fill: Callable | None = None  # takes the finished node
    dims: list[int] = field(default_factory=list)


# Features


def features(specs: list[ColumnSpec], private: bool) -> tuple[Column, dict[str, list[int]], list[str]]:
    """(array of all features of a row, {column: its places}, numeric columns by place or '').

    Categories of at most 24 values are signed one-hot (a scaled code where private, or where there are more); numbers are as they are,
    or scaled by their domain where private.
    """
    out: list[Column] = []
    at: dict[str, list[int]] = {}
    numeric: list[str] = []
    for s in specs:
        c = F.col(f"`{s.name}`").cast("double")
        if s.kind == CATEGORICAL and 2 <= len(s.categories) <= 24 and not private:
            got = [F.when(c == float(v), 1.0).otherwise(-1.0) for v in range(len(s.categories))]
        elif s.kind == CATEGORICAL:
            got = [2 * F.coalesce(c, F.lit(0.0)) / max(len(s.categories) - 1, 1) - 1]
        elif private:
            got = [F.greatest(F.least(2 * (F.coalesce(c, F.lit((s.low + s.high) / 2)) - s.low) / (s.high - s.low) - 1, F.lit(1.0)), F.lit(-1.0))]
        else:
            got = [c]
        at[s.name] = list(range(len(out), len(out) + len(got)))
        numeric += [s.name if s.kind != CATEGORICAL and not private else ""] * len(got)
        out += got
    return F.array(*out), at, numeric


def scaled(g: Column, d: Column, fill: Column, shift: Column, scale: Column) -> Column:
    """A node's features of a row: gaps filled, shifted and scaled."""
    pick = lambda i: (F.coalesce(F.element_at(g, F.element_at(d, i) + 1), F.element_at(fill, i)) - F.element_at(shift, i)) * F.element_at(scale, i)
    return F.transform(F.sequence(F.lit(1), F.size(d)), pick)


def lloyd_step(feats: DataFrame, centres: dict[tuple[int, int], np.ndarray]) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray, float]]:
    """{(node, seed): (rows by cluster, sums by cluster and dimension, cost)} of one assignment, of equals to the first; feats: _node, x.

    One pass over all nodes, seeds and clusters: tasks add up what their rows give, and one aggregate adds up the tasks.
    """
    wide = max(c.shape[1] for c in centres.values())
    by: dict[int, list] = {}
    for (n, s), c in centres.items():
        by.setdefault(n, []).append((s, c))

    def run(batches):
        got = {n: [(s, c, np.zeros(len(c)), np.zeros(len(c)), np.zeros((len(c), wide))) for s, c in many] for n, many in by.items()}
        for b in batches:
            node, begin = b.column("_node").to_numpy(), b.column("x").offsets.to_numpy()[:-1]
            values = b.column("x").values.to_numpy(zero_copy_only=False)
            for n in np.unique(node).tolist():
                d = got[n][0][1].shape[1] if n in got else 0
                at = begin[node == n]
                for lo in range(0, len(at) if d else 0, 4096):
                    x = values[at[lo : lo + 4096, None] + np.arange(d)]
                    for _, c, rows, cost, sums in got[n]:
                        far = ((x[:, None] - c) ** 2).sum(-1)
                        k = far.argmin(1)
                        rows += np.bincount(k, minlength=len(c))
                        cost += np.bincount(k, far[np.arange(len(k)), k], len(c))
                        sums[:, :d] += (k == np.arange(len(c))[:, None]).astype(float) @ x
        out = [(n, s, k, rows[k], cost[k], sums[k]) for n, many in got.items() for s, _, rows, cost, sums in many for k in np.flatnonzero(rows).tolist()]
        if out:
            yield pa.RecordBatch.from_pydict({c: pa.array([r[i] for r in out], kind) for i, (c, kind) in enumerate((("node", pa.int32()), ("s", pa.int32()), ("k", pa.int32()), ("n", pa.float64()), ("cost", pa.float64()), ("sums", pa.list_(pa.float64()))))})

    each = feats.select("_node", "x").mapInArrow(run, "node int, s int, k int, n double, cost double, sums array<double>")
    total = each.groupBy("node", "s", "k").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"), F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(wide)]).alias("sums"))
    out = {key: (np.zeros(len(c)), np.zeros(c.shape), 0.0) for key, c in centres.items()}
    for r in total.collect():
        n, sums, cost = out[r["node"], r["s"]]
        n[r["k"]] = r["n"]
        sums[r["k"]] = r["sums"][: sums.shape[1]]
        out[r["node"], r["s"]] = (n, sums, cost + r["cost"])
    return out


def lloyd(feats: DataFrame, centres: dict[tuple[int, int], np.ndarray], rounds: int = ROUNDS) -> tuple[dict, dict]:
    """(centres, last step) after some rounds, or fewer where nothing moves any more. A cluster that loses all rows keeps its centre."""
    centres = {key: np.asarray(c, float) for key, c in centres.items()}
    for _ in range(rounds):
        step = lloyd_step(feats, centres)
        new = {key: np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres[key]) for key, (n, sums, _) in step.items()}
        moved = max(float(np.abs(new[key] - centres[key]).max(initial=0)) for key in centres)
        centres = new
        if moved < 1e-4:
            break
    return centres, lloyd_step(feats, centres)


def first_centres(feats: DataFrame, ks: dict[int, int], seed: int, seeds: int = SEEDS) -> dict[tuple[int, int], np.ndarray]:
    """Centres far from each other, chosen by weight and distance among different rows of each node, drawn by their hash.

    About CANDIDATES different rows a node come to the driver, whatever its size; only the choice of first centres rests on them.
    """
    h = F.xxhash64(F.lit(seed), "x")
    n = feats.groupBy("_node").agg(F.approx_count_distinct(h, 0.02).alias("_n"))
    kept = feats.join(F.broadcast(n), "_node").filter(F.pmod(h, F.lit(1 << 20)) * F.col("_n") <= F.lit(CANDIDATES << 20))
    by: dict[int, list] = {}
    for r in kept.groupBy("_node", "x").agg(F.count("*").alias("n")).orderBy("_node", "x").collect():
        by.setdefault(r["_node"], []).append((r["x"], r["n"]))
    out = {}
    for node, k in ks.items():
        points, weights = (np.array([v[i] for v in by.get(node, [])], float) for i in (0, 1))
        if not len(points):
            continue
        for s in range(seeds):
            rng = np.random.default_rng([seed, node, s])
            got = [points[rng.choice(len(points), p=weights / weights.sum())]]
            for _ in range(k - 1):
                far = weights * np.min([((points - c) ** 2).sum(1) for c in got], axis=0)
                got.append(points[rng.choice(len(points), p=far / far.sum())] if far.sum() > 0 else points[0])
            out[node, s] = np.array(got)
    return out


def private_centres(feats: DataFrame, ks: dict[int, int], shares: dict[int, float], dims: dict[int, int], ledger: PrivacyLedger, level: int, rounds: int = PRIVATE_ROUNDS) -> dict[int, np.ndarray]:
    """Lloyd's rounds on features in [-1, 1] with noise on counts and sums; a centre of less than one row starts anew."""
    rng = ledger.rng
    fresh = lambda d: [rng.uniform(-1, 1) for _ in range(d)]
    centres = {n: np.array([fresh(dims[n]) for _ in range(k)]) for n, k in ks.items()}
    for _ in range(rounds):
        step = lloyd_step(feats, {(n, 0): c for n, c in centres.items()})
        for n, c in centres.items():
            counts, sums, _ = step[n, 0]
            scale = 2 * (dims[n] + 1) / (ledger.kmeans_share(level) * shares[n] / rounds)
            for j in range(len(c)):
                noisy = counts[j] + ledger.noise(scale)
                total = np.array([v + ledger.noise(scale) for v in sums[j]])
                c[j] = np.clip(total / noisy, -1, 1) if noisy >= 1 else fresh(dims[n])
    return centres


# Independence


def counted(rows: DataFrame, cells: Callable) -> dict[tuple[int, int, int, float, float], float]:
    """{(node, a, b, x, y): rows} of rows with `_node` and columns of numbers.

    cells(node, {column: (values, where they are null)}) gives (a, b, x, y, n) of the rows of a node in a batch. Tasks add up theirs, and
    one aggregate adds up the tasks.
    """

    def run(batches):
        got: dict = {}
        for b in batches:
            node = b.column("_node").to_numpy()
            values = {c: (b.column(c).to_numpy(zero_copy_only=False), b.column(c).is_null().to_numpy(zero_copy_only=False)) for c in b.schema.names if c != "_node"}
            for n in np.unique(node).tolist():
                at = np.flatnonzero(node == n)
                for *key, k in cells(n, {c: (v[at], null[at]) for c, (v, null) in values.items()}):
                    key = (n, *key)
                    got[key] = got.get(key, 0) + k
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64())
        if got:
            yield pa.RecordBatch.from_pydict({c: pa.array([(*key, k)[i] for key, k in got.items()], kinds[i]) for i, c in enumerate(("node", "a", "b", "x", "y", "n"))})

    each = rows.mapInArrow(run, "node int, a int, b int, x double, y double, n double")
    return {tuple(r[:5]): r["n"] for r in each.groupBy("node", "a", "b", "x", "y").agg(F.sum("n").alias("n")).collect()}


def edges_of(rows: DataFrame, nodes: dict[int, Open], specs: dict[str, ColumnSpec], private: bool) -> tuple[dict[int, dict[str, list[float]]], dict]:
    """M9: inner octile edges of each node's numeric columns, and each node's (median, mean, deviation) of them; of the domain if private."""
    numeric = [c for c, s in specs.items() if s.kind != CATEGORICAL]
    if private:
        inner = {c: [specs[c].low + (specs[c].high - specs[c].low) * i / 8 for i in range(1, 8)] for c in numeric}
        return {n: {c: inner[c] for c in o.scope if c in inner} for n, o in nodes.items()}, {}
    if not numeric:
        return {n: {} for n in nodes}, {}
    cuts = quantiles.grouped(rows, "_node", numeric, lambda g, c, n: [i / 8 for i in range(9)])
    moments = rows.groupBy("_node").agg(*[f for c in numeric for f in (F.avg(f"`{c}`").alias(f"a_{c}"), F.stddev_pop(f"`{c}`").alias(f"s_{c}"))]).collect()
    stats = {(r["_node"], c): (cuts[r["_node"], c][4] if (r["_node"], c) in cuts else 0.0, r[f"a_{c}"] or 0.0, r[f"s_{c}"] or 0.0) for r in moments for c in numeric}
    return {n: {c: sorted(set(cuts.get((n, c), [])))[1:-1] for c in o.scope if c in numeric} for n, o in nodes.items()}, stats


def tables(rows: DataFrame, nodes: dict[int, Open], specs: dict[str, ColumnSpec], edges: dict[int, dict[str, list[float]]]) -> dict[tuple[int, int, int], dict[tuple[float, float], float]]:
    """{(node, a, b): {(bin, bin): rows}} of every pair of columns in each node's scope, by their places in specs; one grouped count."""
    names = list(specs)
    whole = {c for c in names if specs[c].kind == CATEGORICAL}
    look = {n: ({c: np.array(edges[n].get(c, []), float) for c in o.scope}, [(names.index(a), names.index(b)) for a, b in combinations(o.scope, 2)]) for n, o in nodes.items()}

    def cells(n, values):
        inner, pairs = look[n]
        bins = {}
        for c, e in inner.items():
            x, null = values[c]
            b = np.where(null, -1.0, x if c in whole else np.searchsorted(e, x, "right"))
            bins[names.index(c)] = np.unique(b, return_inverse=True)
        for a, b in pairs:
            (u, i), (v, j) = bins[a], bins[b]
            k = np.bincount(i * len(v) + j, minlength=len(u) * len(v))
            for at in np.flatnonzero(k).tolist():
                yield a, b, float(u[at // len(v)]), float(v[at % len(v)]), int(k[at])

    of = rows.select("_node", *[F.col(f"`{c}`").cast("double").alias(c) for c in names])
    out: dict = {(n, a, b): {} for n, (_, pairs) in look.items() for a, b in pairs}
    for (n, a, b, x, y), k in counted(of, cells).items():
        out[n, a, b][x, y] = k
    return out


def parts_of(scope: list[str], depends: Callable[[str, str], bool]) -> list[list[str]]:
    """M7: groups of columns that depend on each other, in the scope's order."""
    group = {c: c for c in scope}

    def top(c: str) -> str:
        while group[c] != c:
            c = group[c]
        return c

    for a, b in combinations(scope, 2):
        if depends(a, b) and top(a) != top(b):
            group[top(a)] = top(b)
    out: dict[str, list[str]] = {}
    for c in scope:
        out.setdefault(top(c), []).append(c)
    return list(out.values())


def _domain(s: ColumnSpec) -> list[float]:
    return [-1.0, *(float(i) for i in range(len(s.categories) if s.kind == CATEGORICAL else 8))]


# Growing


def grow(df: DataFrame, specs: dict[str, ColumnSpec], params, ledger: PrivacyLedger | None, dependent: Callable, node: Callable, leaves_of: Callable):
    """The root of a network over the columns of specs. node(kind, scope, weights, children) makes inner nodes; leaves_of(rows, groups)
    makes {group: nodes} from rows with a column `_node`.

    Without privacy the result depends on the data alone. With it, sizes, tables, centres, weights and leaves are noisy, and no count as it
    is decides anything; at the greatest depth nothing is measured but leaves.
    """
    private = ledger is not None
    names = list(specs)
    g, place, numeric = features(list(specs.values()), private)
    root: list = []
    level = {0: Open(0, names, fill=root.append)}
    groups: dict[int, Open] = {}
    none = F.array().cast("array<int>")
    rows = settled(df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in names]).withColumns({"_open": F.array(F.lit(0)), "_leaf": none}), "level")
    last = 0
    for depth in range(params.max_depth + 1):
        if not level:
            break
        ends, parted, split = _decide(rows, level, specs, params, ledger, depth, dependent, g, place, numeric)
        base, new, decided = min(level), {}, {}
        for n, o in level.items():
            if n in ends:
                groups[n] = o
                decided[n] = ([], [n], [], [], [], [], None)
            elif n in parted:
                kids = [Open(last + i, scope) for i, scope in enumerate(parted[n], 1)]
                last += len(kids)
                several = [k for k in kids if len(k.scope) > 1]
                made = _collector(o, node, "product", o.scope, [], len(kids))
                for i, k in enumerate(kids):
                    k.share, k.fill = o.share / max(len(several), 1), made(i)
                    (new if len(k.scope) > 1 else groups)[k.id] = k
                decided[n] = ([k.id for k in several], [k.id for k in kids if len(k.scope) == 1], [], [], [], [], None)
            else:
                centres, weights, look = split[n]
                kids = [Open(last + i, o.scope, o.share) for i in range(1, len(centres) + 1)]
                last += len(kids)
                made = _collector(o, node, "sum", o.scope, [w / sum(weights) for w in weights], len(kids))
                for i, k in enumerate(kids):
                    k.fill = made(i)
                    new[k.id] = k
                decided[n] = ([k.id for k in kids], [], *look, centres.tolist())
        rows = settled(_moved(rows, base, [decided.get(n) for n in range(base, max(level) + 1)], g), "level")
        level = new
    for n, leaves in leaves_of(rows.select(F.explode("_leaf").alias("_node"), *[F.col(f"`{c}`") for c in names]), groups).items():
        o = groups[n]
        o.fill(leaves[0] if len(leaves) == 1 else node("product", o.scope, [], leaves))
    return root[0]


def _collector(o: Open, node: Callable, kind: str, scope: list[str], weights: list[float], n: int) -> Callable:
    """fill functions of n children; the last one to come makes the parent."""
    got: dict = {}

    def of(i: int) -> Callable:
        def fill(child) -> None:
            got[i] = child
            if len(got) == n:
                o.fill(node(kind, scope, weights, [got[j] for j in range(n)]))

        return fill

    return of


def _decide(rows: DataFrame, level: dict[int, Open], specs, params, ledger: PrivacyLedger | None, depth: int, dependent: Callable, g: Column, place, numeric) -> tuple[set, dict, dict]:
    """(nodes that end in leaves, {node: groups of columns}, {node: (centres, weights, features)})."""
    if depth >= params.max_depth:
        return set(level), {}, {}
    names = list(specs)
    counts = {n: 0.0 for n in level} | {r["n"]: float(r["c"]) for r in rows.select(F.explode("_open").alias("n")).groupBy("n").agg(F.count("*").alias("c")).collect()}
    size = {n: ledger.node_size(counts[n], depth, o.share) if ledger else counts[n] for n, o in level.items()}
    test = {n: o for n, o in level.items() if len(o.scope) > 1 and size[n] >= params.beta and (ledger or counts[n] >= 2)}
    ends = set(level) - set(test)
    if not test:
        return ends, {}, {}
    of = rows.select(F.explode(F.filter("_open", lambda n: n.isin(*test))).alias("_node"), *names)
    edges, stats = edges_of(of, test, specs, ledger is not None)
    cells = tables(of, test, specs, edges)
    parted: dict[int, list[list[str]]] = {}
    for n, o in test.items():
        pairs = list(combinations(o.scope, 2))
        table = {}
        for a, b in pairs:
            got = cells[n, names.index(a), names.index(b)]
            if ledger:  # every cell of the domain is noisy, whether it occurs or not
                keys = [(x, y) for x in _domain(specs[a]) for y in _domain(specs[b])]
                got = dict(zip(keys, ledger.contingency([got.get(k, 0.0) for k in keys], len(pairs), depth, o.share), strict=True))
            table[a, b] = got
        parts = parts_of(o.scope, lambda a, b, table=table: dependent(table[a, b], params.p_value))
        if len(parts) > 1:
            parted[n] = parts
    ks = {n: min(params.max_clusters, max(2, int(size[n] // params.beta) or 2)) for n in test if n not in parted}
    if not ks:
        return ends, parted, {}
    look = {n: _lookup(n, test[n].scope, place, numeric, stats) for n in ks}
    table = rows.sparkSession.createDataFrame([(n, *v) for n, v in look.items()], "_node int, d array<int>, fill array<double>, shift array<double>, scale array<double>")
    wide = rows.select(g.alias("g"), F.explode(F.filter("_open", lambda n: n.isin(*ks))).alias("_node")).join(F.broadcast(table), "_node")  # a row a node
    feats = settled(wide.select("_node", scaled(F.col("g"), *[F.col(c) for c in ("d", "fill", "shift", "scale")]).alias("x")), "features")
    split: dict = {}
    if ledger:
        centres = private_centres(feats, ks, {n: test[n].share for n in ks}, {n: len(look[n][0]) for n in ks}, ledger, depth)
        step = lloyd_step(feats, {(n, 0): c for n, c in centres.items()})
        for n, c in centres.items():
            split[n] = (c, ledger.weights(step[n, 0][0].tolist(), depth, test[n].share), look[n])
    else:
        centres, step = lloyd(feats, first_centres(feats, ks, params.seed))
        for n in ks:
            seed = min((s for s in range(SEEDS) if (n, s) in step), key=lambda s: (step[n, s][2], s))
            got = step[n, seed][0]
            if (got > 0).sum() < 2:
                ends.add(n)
            else:
                split[n] = (centres[n, seed][got > 0], got[got > 0].tolist(), look[n])
    return ends, parted, split


def _lookup(n: int, scope: list[str], place: dict[str, list[int]], numeric: list[str], stats: dict) -> tuple[list, list, list, list]:
    """Places of a scope's features, and what fills, shifts and scales each."""
    d = [i for c in scope for i in place[c]]
    fill, shift, scale = [], [], []
    for i in d:
        mid, mean, std = stats.get((n, numeric[i]), (0.0, 0.0, 1.0)) if numeric[i] else (0.0, 0.0, 1.0)
        fill.append(float(mid))
        shift.append(float(mean))
        scale.append(1.0 / std if std > 0 and math.isfinite(std) else 0.0)
    return d, fill, shift, scale


def _moved(rows: DataFrame, base: int, decided: list, g: Column) -> DataFrame:
    """Rows at the next level: a product's rows go to all its children, a sum's rows to the child of the nearest centre, of equals the first."""
    keep = [c for c in rows.columns if c not in ("_open", "_leaf")]
    empty = ([], [], [], [], [], [], None)
    table = [[np.array(x, float if i > 2 else np.int32) if x is not None else None for i, x in enumerate(d or empty)] for d in decided]

    def lists(column):
        off = column.offsets.to_numpy()
        return off - off[0], column.values.to_numpy()[off[0] : off[-1]]

    def label(x, null, d, fill, shift, scale, centres):
        out = np.zeros(len(x), int)
        for lo in range(0, len(x), 4096):
            v = np.where(null[lo : lo + 4096, d], fill, x[lo : lo + 4096, d])
            out[lo : lo + 4096] = ((((v - shift) * scale)[:, None] - centres) ** 2).sum(-1).argmin(1)
        return out

    def joined(off, ends, parts):
        """A list array of a list a row: first those of off and ends, then parts, which are (off, values) too."""
        size = np.diff(off) + np.diff(parts[0])
        begin = np.r_[0, np.cumsum(size)]
        out = np.zeros(begin[-1], np.int32)
        spread = lambda o, at: np.repeat(at - o[:-1], np.diff(o)) + np.arange(o[-1])
        out[spread(off, begin[:-1])] = ends
        out[spread(parts[0], begin[:-1] + np.diff(off))] = parts[1]
        return pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(out, pa.int32()))

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            off, node = lists(b.column("_open"))
            features = b.column("_g").flatten()
            x = features.to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            null = features.is_null().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            row = np.repeat(np.arange(b.num_rows), np.diff(off))
            entries = {n: np.flatnonzero(node == n) for n in np.unique(node).tolist()}
            moved = []
            for which in (0, 1):  # kids, leaves
                pick = {n: table[n - base][which] for n in entries}
                one = {n for n in entries if which == 0 and table[n - base][-1] is not None}
                size = np.zeros(len(node), int)
                for n, at in entries.items():
                    size[at] = 1 if n in one else len(pick[n])
                begin = np.r_[0, np.cumsum(size)]
                out = np.zeros(begin[-1], np.int32)
                for n, at in entries.items():
                    if n in one:
                        out[begin[at]] = pick[n][label(x[row[at]], null[row[at]], *table[n - base][2:])]
                    else:
                        out[begin[at][:, None] + np.arange(len(pick[n]))] = pick[n]
                moved.append((begin[off], out))
            none = np.zeros(b.num_rows + 1, int), np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), joined(*none, moved[0]), joined(*lists(b.column("_leaf")), moved[1])], [*keep, "_open", "_leaf"])

    sent = rows.select(*[F.col(f"`{c}`") for c in keep], "_open", "_leaf", g.alias("_g"))
    return sent.mapInArrow(run, T.StructType([*(rows.schema[c] for c in keep), rows.schema["_open"], rows.schema["_leaf"]]))
