"""Sampling a sum-product network by descent: likelihoods of evidence upward, one draw a sum node downward.

Nodes are laid out by depth. A row holds the nodes that it has reached, one for each group of columns; a product passes it on to all its
children, a sum to one of them, and leaves end it. So the work of a row follows the depth and the nodes on its way, and sums beside each
other are drawn apart instead of being multiplied out. The network goes with the plan, of a checked size, and tasks draw a batch at a time.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.rng import SCALE
from tessera.functions.scalar import bind

FLOOR = 1e-12
#: Numbers of a network that a plan may hold: some 64 MB.
LARGEST = 8_000_000
_NODE = "array<struct<kind:string,kids:array<int>,logw:array<double>,cum:array<double>,c:int,i:int>>"
_LEAF = "array<struct<kind:string,cum:array<double>,probs:array<double>,codes:array<double>,edges:array<double>,nul:double>>"


def leaf_entry(leaf) -> dict:
    """What draws and densities need of a leaf. A constant value is a category of its own; a constant null stays one."""
    cum, c = [], 0.0
    for p in leaf.probs:
        c += p
        cum.append(c)
    if leaf.kind == "constant" and leaf.value is None:
        return {"kind": "constant", "cum": [1.0], "probs": [1.0], "codes": [], "edges": [], "nul": 1.0}
    if leaf.kind == "constant":
        return {"kind": "categorical", "cum": [1.0], "probs": [1.0], "codes": [float(leaf.value)], "edges": [], "nul": 0.0}
    return {"kind": leaf.kind, "cum": cum, "probs": [float(p) for p in leaf.probs], "codes": [float(x) for x in leaf.codes], "edges": [float(x) for x in leaf.edges], "nul": float(leaf.null)}


class Layout:
    """A network by depth: levels[d] are its nodes, whose kids are places in levels[d + 1]; leaves[c] are the leaves of a column."""

    def __init__(self, root, columns: list[str]):
        self.columns = columns
        self.levels: list[list[dict]] = []
        self.leaves: list[list[dict]] = [[] for _ in columns]
        now = [root]
        while now:
            entries, following = [], []
            for n in now:
                e = {"kind": n.kind if n.kind in ("sum", "product") else "leaf", "kids": [], "logw": [], "cum": [], "c": -1, "i": -1}
                if e["kind"] == "leaf":
                    e["c"] = columns.index(n.scope[0])
                    e["i"] = len(self.leaves[e["c"]])
                    self.leaves[e["c"]].append(leaf_entry(n))
                else:
                    e["kids"] = list(range(len(following), len(following) + len(n.children)))
                    following += n.children
                if e["kind"] == "sum":
                    total, upto = sum(n.weights), 0.0
                    e["logw"] = [math.log(max(w / total, FLOOR)) for w in n.weights]
                    for w in n.weights:
                        upto += w / total
                        e["cum"].append(upto)
                entries.append(e)
            self.levels.append(entries)
            now = following
        size = sum(4 + 3 * len(e["kids"]) for x in self.levels for e in x) + sum(2 + 2 * len(v["cum"]) + len(v["codes"]) + len(v["edges"]) for x in self.leaves for v in x)
        if size > LARGEST:
            raise ValueError(f"the network has {size} numbers, more than the {LARGEST} that a plan may hold: raise beta, or lower max_depth or max_clusters")

    def level(self, d: int) -> Column:
        return F.from_json(F.lit(json.dumps(self.levels[d])), _NODE)

    def leaf(self, c: int) -> Column:
        return F.from_json(F.lit(json.dumps(self.leaves[c])), _LEAF)


def log_density(leaf: Column, x: Column) -> Column:
    """The logarithm of a leaf's probability (a histogram's density) of a value, never below the floor's."""
    at = F.array_position(leaf["codes"], x)
    cat = F.when(at > 0, F.element_at(leaf["probs"], at.cast("int"))).otherwise(FLOOR)
    k = F.size(F.filter(leaf["edges"], lambda e: e <= x))
    width = F.try_element_at(leaf["edges"], k + 1) - F.try_element_at(leaf["edges"], F.greatest(k, F.lit(1)))
    inside = F.try_element_at(leaf["probs"], F.greatest(k, F.lit(1))) / F.greatest(width, F.lit(FLOOR)) * (1 - leaf["nul"])
    hist = F.when(x.isNull(), leaf["nul"]).when((k >= 1) & (k <= F.size(leaf["probs"])), inside).otherwise(FLOOR)
    p = F.when(leaf["kind"] == "categorical", cat).when(leaf["kind"] == "histogram", hist).when(x.isNull(), 1.0).otherwise(FLOOR)
    return F.log(F.greatest(p, F.lit(FLOOR)))


def _scores(node: Column, below: Column) -> Column:
    """Logarithms of a sum's weights times its children's likelihoods."""
    return F.zip_with(node["logw"], node["kids"], lambda w, k: w + F.element_at(below, k + 1))


def upward(rows: DataFrame, net: Layout, evidence: dict[str, Column]) -> DataFrame:
    """rows with `_up0`, `_up1`, ...: the log likelihood of the evidence under each node of a depth. Columns without evidence count as 1."""
    given = {net.columns.index(c): e for c, e in evidence.items()}
    out = rows.withColumns({f"_ev{c}": e.cast("double") for c, e in given.items()})
    out = out.withColumns({f"_ld{c}": _of_leaves(net.leaf(c), F.col(f"_ev{c}")) for c in given})
    for d in range(len(net.levels) - 1, -1, -1):
        below = F.col(f"_up{d + 1}") if d + 1 < len(net.levels) else F.array().cast("array<double>")
        out = out.withColumn(f"_up{d}", _likelihoods(net.level(d), below, list(given)))
    return out.drop(*[f"_{k}{c}" for k in ("ev", "ld") for c in given])


def _of_leaves(leaves: Column, x: Column) -> Column:
    return F.transform(leaves, lambda leaf: log_density(leaf, x))


def _likelihoods(level: Column, below: Column, given: list[int]) -> Column:
    """Log likelihoods of a depth's nodes from those below; columns without evidence count as 1."""

    def of(n: Column) -> Column:
        leaf = F.lit(0.0)
        for c in given:
            leaf = F.when(n["c"] == c, F.element_at(F.col(f"_ld{c}"), n["i"] + 1)).otherwise(leaf)
        product = F.aggregate(n["kids"], F.lit(0.0), lambda s, k: s + F.element_at(below, k + 1))
        mixed = bind(_scores(n, below), lambda s: bind(F.array_max(s), lambda top: top + F.log(F.aggregate(s, F.lit(0.0), lambda a, v: a + F.exp(v - top)))))
        return F.when(n["kind"] == "leaf", leaf).when(n["kind"] == "product", product).otherwise(mixed)

    return F.transform(level, of)


def shares(node: Column, below: Column | None) -> Column:
    """Cumulative probabilities of a sum's children, given the likelihoods below it (none: its weights)."""
    if below is None:
        return node["cum"]
    none = F.array().cast("array<double>")
    last = lambda a: F.coalesce(F.try_element_at(a, F.size(a)), F.lit(0.0))
    upto = lambda e: F.aggregate(e, none, lambda a, v: F.concat(a, F.array(F.when(F.size(a) > 0, last(a)).otherwise(0.0) + v)))
    e = bind(_scores(node, below), lambda s: bind(F.array_max(s), lambda top: F.transform(s, lambda v: F.exp(v - top))))
    return bind(upto(e), lambda a: F.transform(a, lambda v: v / last(a)))


def posterior(rows: DataFrame, root, columns: list[str], evidence: dict[str, Column], name: str = "posterior") -> DataFrame:
    """M1: rows and the cumulative probabilities of the root's children given evidence, as downward() draws from them."""
    net = Layout(root, columns)
    out = upward(rows, net, evidence)
    out = out.withColumn(name, shares(F.element_at(net.level(0), 1), F.col("_up1")))
    return out.drop(*[f"_up{d}" for d in range(len(net.levels))])


def _drawing(net: Layout, given: list[str], keep: list[str], seed: int, stream: str):
    """What a task does to batches of columns keep, `_r` (row ids as text) and `_e_...` (evidence): the same descent for all rows of a batch.

    Nodes of a depth are taken in turn, each with the rows that have reached it. Whatever it needs goes with the function, so that
    executors need not have this package.
    """
    levels, leaves, columns, floor, scale = net.levels, net.leaves, net.columns, FLOOR, SCALE
    at_once = max(64, min(4096, 4_000_000 // sum(map(len, levels))))

    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        arrays = [[{k: np.array(v, float) if isinstance(v, list) else v for k, v in leaf.items()} for leaf in column] for column in leaves]

        def uniforms(name, ids):
            head = f"{seed}|{name}"
            texts = (head if r is None else f"{head}|{r}" for r in ids)
            return np.fromiter((int(hashlib.md5(t.encode()).hexdigest()[:13], 16) for t in texts), float, len(ids)) / scale

        def log_density(leaf, x, null):
            p = np.full(len(x), floor)
            if leaf["kind"] == "categorical":
                order = np.argsort(leaf["codes"])
                codes = leaf["codes"][order]
                at = np.minimum(np.searchsorted(codes, x), len(codes) - 1)
                hit = (codes[at] == x) & ~null
                p[hit] = leaf["probs"][order[at[hit]]]
            elif leaf["kind"] == "histogram":
                k = np.searchsorted(leaf["edges"], x, "right") - 1
                inside = (k >= 0) & (k < len(leaf["probs"]))
                density = leaf["probs"] / np.maximum(np.diff(leaf["edges"]), floor) * (1 - leaf["nul"])
                p[inside] = density[k[inside]]
                p[null] = leaf["nul"]
            else:
                p[null] = 1.0
            return np.log(np.maximum(p, floor))

        def below(node, up):
            return up[node["kids"][0] : node["kids"][-1] + 1]

        def upward(evidence, n):
            ld = {c: [log_density(leaf, *evidence[c]) for leaf in arrays[c]] for c in evidence}
            up = [None] * (len(levels) + 1)
            for d in range(len(levels) - 1, -1, -1):
                up[d] = np.zeros((len(levels[d]), n))
                for j, node in enumerate(levels[d]):
                    if node["kind"] == "leaf":
                        if node["c"] in ld:
                            up[d][j] = ld[node["c"]][node["i"]]
                    elif node["kind"] == "product":
                        up[d][j] = below(node, up[d + 1]).sum(0)
                    else:
                        s = np.array(node["logw"])[:, None] + below(node, up[d + 1])
                        top = s.max(0)
                        up[d][j] = top + np.log(np.exp(s - top).sum(0))
            return up

        def downward(ids, up):
            place = np.zeros((len(columns), len(ids)), int)
            at = {0: np.arange(len(ids))}
            for d, level in enumerate(levels):
                following = {}
                for j, rows in at.items():
                    node = level[j]
                    if node["kind"] == "leaf":
                        place[node["c"], rows] = node["i"]
                    elif node["kind"] == "product":
                        following |= dict.fromkeys(node["kids"], rows)
                    else:
                        u = uniforms(f"{stream}:{d}|{j}", ids[rows])
                        if up is None:
                            k = np.searchsorted(np.array(node["cum"]), u, "right")
                        else:
                            s = np.array(node["logw"])[:, None] + below(node, up[d + 1])[:, rows]
                            upto = np.exp(s - s.max(0)).cumsum(0)
                            k = (upto / upto[-1] <= u).sum(0)
                        k = np.minimum(k, len(node["kids"]) - 1)
                        for i in np.unique(k).tolist():
                            following[node["kids"][i]] = rows[k == i]
                at = following
            return place

        def draw(leaf, u):
            cum, nul = leaf["cum"], leaf["nul"]
            if leaf["kind"] == "categorical":
                return leaf["codes"][np.minimum(np.searchsorted(cum, u, "right"), len(cum) - 1)]
            out = np.full(len(u), np.nan)
            if leaf["kind"] == "histogram":
                some = u >= nul
                v = (u[some] - nul) / max(1 - nul, floor)
                i = np.minimum(np.searchsorted(cum, v, "right"), len(cum) - 1)
                before = np.where(i > 0, cum[i - 1], 0.0)
                share = np.clip((v - before) / np.maximum(cum[i] - before, floor), 0.0, 1.0)
                lo, hi = leaf["edges"][i], leaf["edges"][i + 1]
                out[some] = lo + share * (hi - lo)
            return out

        for batch in batches:
            for lo in range(0, batch.num_rows, at_once):
                part = batch.slice(lo, at_once)
                ids = np.array(part.column("_r").to_pylist(), object)
                held = {c: part.column(f"_e_{c}") for c in given}
                evidence = {columns.index(c): (x.to_numpy(zero_copy_only=False), x.is_null().to_numpy(zero_copy_only=False)) for c, x in held.items()}
                place = downward(ids, upward(evidence, len(ids)) if given else None)
                out = []
                for i, c in enumerate(columns):
                    if c in held:
                        out.append(held[c])
                        continue
                    u, v = uniforms(f"{stream}:{c}", ids), np.zeros(len(ids))
                    for k in np.unique(place[i]).tolist():
                        at = place[i] == k
                        v[at] = draw(arrays[i][k], u[at])
                    out.append(pa.array(v, pa.float64(), mask=np.isnan(v)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *out], [*keep, *columns])

    return run


def sample(rows: DataFrame, root, columns: list[str], rid: str, seed: int, stream: str, evidence: dict[str, Column] | None = None) -> DataFrame:
    """Rows with a value of every column; evidence columns are copied and shape what is drawn of the others.

    Draws depend on (seed, stream, node, row id) alone. Rows keep their other columns.
    """
    evidence = {c: e for c, e in (evidence or {}).items() if c in columns}
    keep = [c for c in rows.columns if c not in columns]
    sent = rows.select(*[F.col(f"`{c}`") for c in keep], F.col(rid).cast("string").alias("_r"), *[e.cast("double").alias(f"_e_{c}") for c, e in evidence.items()])
    schema = T.StructType([*(sent.schema[c] for c in keep), *(T.StructField(c, T.DoubleType()) for c in columns)])
    return sent.mapInArrow(_drawing(Layout(root, columns), list(evidence), keep, seed, stream), schema)


def draw_leaf(u: Column, leaf: Column) -> Column:
    """M3-M5: a value from a leaf's cumulative arrays; what is left of the uniform places it within its bin."""
    cum, codes, edges, null = (leaf.getField(k) for k in ("cum", "codes", "edges", "nul"))
    place = lambda x: F.least(F.size(F.filter(cum, lambda c: c <= x)), F.size(cum) - 1)

    def within(v: Column, i: Column) -> Column:
        before = F.when(i > 0, F.try_element_at(cum, F.greatest(i, F.lit(1)))).otherwise(0.0)
        share = (v - before) / F.greatest(F.try_element_at(cum, i + 1) - before, F.lit(FLOOR))
        lo, hi = F.try_element_at(edges, i + 1), F.try_element_at(edges, i + 2)
        return lo + F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * (hi - lo)

    hist = bind((u - null) / F.greatest(1 - null, F.lit(FLOOR)), lambda v: bind(place(v), lambda i: within(v, i)))
    kind = leaf.getField("kind")
    return F.when(kind == "categorical", F.try_element_at(codes, place(u) + 1)).when((kind == "histogram") & (u >= null), hist)
