"""Gradient-boosted trees grown best leaf first over histograms, many models by the same passes.

Cues are cut into fixed cells and rows of equal context, group, symbol, label and cells are counted once: passes read these counts, not the rows.
Every view of the rows (see ``manyfit``) gets bins of about equal count, made once from cell counts by leaving its
groups out. Models whose view has few counted rows are grown by one task each, all at once. For larger views a pass over all tasks sums gradient, curvature
and rows per (fit, node, feature, bin); the driver finds best splits in those sums, whose number does not grow with the rows. A pass looks one level ahead in all
leaves, so a tree takes about as many passes as it is deep. Both ways grow the same trees. Symbols are features of their own (this symbol or not).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strophe.operators.manyfit import SHARED, GroupSums, gathered
from strophe.session import stored

#: Cells a unit of a cue, and cells on either side of zero; values beyond fall into the last ones.
CELLS, REACH = 128, 1 << 13
#: Bins of a cue at most, and histograms that may reach the driver unsummed in one pass.
SIZE, DIRECT = 256, 1500
#: Counted rows of a view at most for one task to grow its trees; it decides the plan only.
NEAR = 1 << 18


@dataclass(frozen=True)
class Boost:
    """Settings of one model; rows as in ``manyfit.Fit``."""

    name: str
    ctx: int
    out: frozenset[int]
    leaves: int = 8
    rounds: int = 60
    rate: float = 0.05
    l2: float = 10.0
    min_rows: int = 40

    @property
    def view(self):
        return self.ctx, self.out


@dataclass
class Tree:
    """Splits in order: (node, feature, bin, left, right); rows with a bin up to ``bin``, or of another symbol, go left."""

    splits: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    values: dict[int, float] = field(default_factory=dict)


@dataclass
class Boosted:
    fit: Boost
    start: float
    bins: np.ndarray
    trees: list[Tree]

    def upto(self, rounds: int, name: str) -> Boosted:
        """The same model stopped earlier."""
        return Boosted(Boost(name, self.fit.ctx, self.fit.out, self.fit.leaves, rounds, self.fit.rate, self.fit.l2, self.fit.min_rows), self.start, self.bins, self.trees[:rounds])


def cells(x: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(x * CELLS), -REACH, REACH - 1).astype(np.int64) + REACH


def counted(rows: DataFrame, cues: Sequence[str], seen: Sequence[tuple[int, int]]) -> DataFrame:
    """(ctx, g, s, y, a cell per cue, n): rows of the (context, group) pairs in ``seen`` by what trees can tell apart."""
    cell = lambda c: (F.greatest(F.least(F.floor(F.col(c) * CELLS), F.lit(REACH - 1)), F.lit(-REACH)) + REACH).cast("int")
    mine = rows.join(F.broadcast(rows.sparkSession.createDataFrame(list(seen), "ctx int, g int")), ["ctx", "g"])
    return mine.groupBy("ctx", "g", "s", "y", *[cell(c).alias(c) for c in cues]).agg(F.count(F.lit(1)).cast("double").alias("n"))


def cell_counts(table: DataFrame, cues: Sequence[str]) -> np.ndarray:
    """A row (ctx, g, cue, cell, n) each of counted rows: bounded by contexts x groups x cells."""
    flat = table.select("ctx", "g", "n", F.posexplode(F.array(*cues)).alias("cue", "cell"))
    t = flat.groupBy("ctx", "g", "cue", "cell").agg(F.sum("n").cast("long").alias("n")).toArrow()
    return np.column_stack([c.to_numpy().astype(np.int64) for c in t.columns])


def binned(counts: Sequence, view, cues: int, bins: int = 255) -> np.ndarray:
    """Bin of every cell, per cue: a bin for each cell in use while they are few, else bins of about equal count."""
    ctx, out = view
    have = np.zeros((cues, 2 * REACH), dtype=np.int64)
    c, g, cue, cell, n = np.asarray(counts, dtype=np.int64).reshape(-1, 5).T
    mine = np.isin(c, (SHARED, ctx)) & ~np.isin(g, list(out))
    np.add.at(have, (cue[mine], cell[mine]), n[mine])
    table = np.zeros((cues, 2 * REACH), dtype=np.uint8)
    for k, row in enumerate(have):
        used = row > 0
        if used.sum() <= bins:
            table[k] = np.maximum(np.cumsum(used) - 1, 0)
        else:
            table[k] = np.minimum((np.cumsum(row) - row) * bins // row.sum(), bins - 1)
    return table


def _bins_of(cell: np.ndarray, table: np.ndarray) -> np.ndarray:
    return np.column_stack([table[k][cell[:, k]] for k in range(len(table))])


def equal_rows(columns: Sequence[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray]:
    """First row of every distinct one, and the place of each row among those; columns come with a bound of their whole numbers from 0."""
    code, size = np.zeros(len(columns[0][0]), dtype=np.int64), 1
    for values, bound in columns:
        if size * bound >= 1 << 62:
            found, code = np.unique(code, return_inverse=True)
            size = len(found)
        code, size = code * bound + values, size * bound
    _, first, place = np.unique(code, return_index=True, return_inverse=True)
    return first, place


def nodes_of(tree: Sequence[tuple[int, int, int, int, int]], b: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Node of every row after the splits; features from the number of cues on are symbols."""
    node = np.zeros(len(s), dtype=np.int64)
    for parent, feature, at, left, right in tree:
        here = np.flatnonzero(node == parent)
        if feature < b.shape[1]:
            goes = b[here, feature] > at
        else:
            goes = s[here] == feature - b.shape[1]
        node[here] = np.where(goes, right, left)
    return node


def predicted(trees: Sequence[Tree], b: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Sum of the trees."""
    total = np.zeros(len(s))
    for tree in trees:
        node = nodes_of(tree.splits, b, s)
        value = np.zeros(1 + max([0, *tree.values]))
        for k, v in tree.values.items():
            value[k] = v
        total += value[node]
    return total


class _Grower:
    """One tree while it grows: nodes with known best splits, leaves, and nodes to look at in the next pass."""

    def __init__(self, fit: Boost):
        self.fit, self.best, self.children, self.stats, self.next_id = fit, {}, {}, {}, 1
        self.wanted = [0]

    def look_ahead(self) -> list[tuple[int, int, int, int, int]]:
        """Splits of all known nodes, real or not: what rows have to follow to reach the wanted nodes."""
        return [(n, self.best[n][1], self.best[n][2], *self.children[n]) for n in sorted(self.children)]

    def learn(self, found: dict[int, tuple]) -> None:
        for node in self.wanted:
            hit = found.get(node)
            self.best[node] = hit[:3] if hit else (0.0, -1, -1)
            if hit:
                self.stats.setdefault(node, hit[3:5])
                self.children[node] = (self.next_id, self.next_id + 1)
                self.stats[self.next_id], self.stats[self.next_id + 1] = hit[5:7], (hit[3] - hit[5], hit[4] - hit[6])
                self.next_id += 2
        _, leaves = self.chosen()
        unknown = [n for n in leaves if n not in self.best]
        self.wanted = [] if len(leaves) >= self.fit.leaves or not unknown else [c for n in self.children for c in self.children[n] if c not in self.best]

    def chosen(self) -> tuple[list[int], list[int]]:
        """Nodes split and leaves left, best gain first, as far as gains are known."""
        split, leaves = [], [0]
        while len(leaves) < self.fit.leaves and all(n in self.best for n in leaves):
            top = max(leaves, key=lambda n: (self.best[n][0], -n))
            if self.best[top][0] <= 0:
                break
            split.append(top)
            leaves = [n for n in leaves if n != top] + list(self.children[top])
        return split, leaves

    def tree(self) -> Tree:
        split, leaves = self.chosen()
        value = lambda n: -self.fit.rate * self.stats[n][0] / (self.stats[n][1] + self.fit.l2) if n in self.stats else 0.0
        return Tree([(n, self.best[n][1], self.best[n][2], *self.children[n]) for n in split], {n: value(n) for n in leaves})


def best_split(found: np.ndarray, cues: int, l2: float, min_rows: int) -> tuple | None:
    """(gain, feature, bin, G, H, left G, left H) of one node from its (cues * 256 + symbols, 3) sums of gradient, curvature and rows.

    Bins of a cue are cut between any two, a symbol is cut off; both sides keep ``min_rows`` rows. Ties go to the lower feature and bin.
    """
    by_cue, by_symbol = found[:cues * SIZE].reshape(cues, SIZE, 3), found[cues * SIZE:]
    total = by_symbol.sum(axis=0)
    left = np.concatenate([np.cumsum(by_cue, axis=1).reshape(-1, 3), total - by_symbol])
    right = total - left
    ok = (left[:, 2] >= min_rows) & (right[:, 2] >= min_rows) & (left[:, 1] >= 1e-3) & (right[:, 1] >= 1e-3)
    score = lambda v: v[..., 0] ** 2 / (v[..., 1] + l2)
    gain = np.where(ok, score(left) + score(right) - score(total), 0.0)
    # equal cuts differ by rounding only
    at = int(np.argmax(gain >= gain.max() - 1e-10 * abs(gain.max())))
    if gain[at] <= 1e-12:
        return None
    feature, cut = (at // SIZE, at % SIZE) if at < cues * SIZE else (cues + at - cues * SIZE, 0)
    return float(gain[at]), feature, cut, float(total[0]), float(total[1]), float(left[at, 0]), float(left[at, 1])


class _Views:
    """Which fits see a context, and a row's place among them: rows carry one score per fit of their context only."""

    def __init__(self, fits: Sequence[Boost]):
        self.ctx = [f.ctx for f in fits]

    def of(self, ctx: int) -> list[int]:
        return [i for i, c in enumerate(self.ctx) if ctx in (SHARED, c)]


def _batch(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, ...]:
    """ctx, g, s, y, cells and count of a batch of counted rows."""
    ctx, g, s, y = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
    return ctx, g, s, y, np.column_stack([batch.column(4 + i).to_numpy(zero_copy_only=False) for i in range(k)]), batch.column(4 + k).to_numpy(zero_copy_only=False)


def _node_sums(b: np.ndarray, s: np.ndarray, node: np.ndarray, wanted: Sequence[int], parts: Sequence[np.ndarray], symbols: int) -> np.ndarray:
    """(wanted nodes * (cues * 256 + symbols), parts): sums of ``parts`` by bin and symbol of every wanted node."""
    k = b.shape[1]
    width = k * SIZE + symbols
    slot = np.full(max(node.max(), *wanted) + 1, -1)
    slot[wanted] = np.arange(len(wanted))
    of = slot[node]
    m = np.flatnonzero(of >= 0)
    code = of[m, None] * width + np.concatenate([b[m] + np.arange(k) * SIZE, k * SIZE + s[m][:, None]], axis=1)
    return np.column_stack([np.bincount(code.ravel(), weights=np.repeat(v[m], k + 1), minlength=len(wanted) * width) for v in parts])


def _grown_in_tasks(rows: DataFrame, cues: Sequence[str], symbols: int, models: Sequence[Boosted], weights: Sequence[np.ndarray], keys: Sequence[tuple[int, int]]) -> None:
    """Grow every model in a task of its own, from the counted rows of its view: at most ``NEAR`` each."""
    spark, k = rows.sparkSession, len(cues)
    given = spark.sparkContext.broadcast([(m.fit, m.start, m.bins) for m in models])

    def grow(key: tuple, t: pa.Table) -> pa.Table:
        i = key[0].as_py()
        fit, start, bins = given.value[i]
        s, y, *cell, n, w = (c.to_numpy() for c in t.columns[1:])
        b = _bins_of(np.column_stack(cell), bins)
        first, place = equal_rows([(s, symbols), (y, 2), *((b[:, j], SIZE) for j in range(k))])
        b, s, y, n, w = b[first], s[first], y[first], np.bincount(place, n), np.bincount(place, w)
        score, out = np.full(len(s), start), []
        for at in range(fit.rounds):
            p = 1 / (1 + np.exp(-score))
            parts, grower = (w * (p - y), w * p * (1 - p), n), _Grower(fit)
            while grower.wanted:
                sums = _node_sums(b, s, nodes_of(grower.look_ahead(), b, s), grower.wanted, parts, symbols).reshape(len(grower.wanted), -1, 3)
                found = {node: best_split(v, k, fit.l2, fit.min_rows) for node, v in zip(grower.wanted, sums)}
                grower.learn({node: split for node, split in found.items() if split})
            tree = grower.tree()
            score += predicted([tree], b, s)
            out += [(i, at, *split, 0.0) for split in tree.splits] + [(i, at, node, -1, 0, 0, 0, v) for node, v in tree.values.items()]
        return pa.table([pa.array(c, pa.float64() if j == 7 else pa.int32()) for j, c in enumerate(zip(*out))] if out else [[]] * 8, schema=shape)

    shape = pa.schema([*((c, pa.int32()) for c in ("fit", "tree", "node", "feature", "bin", "left", "right")), ("value", pa.float64())])
    seen = [(i, c, g, float(w[g])) for i, (m, w) in enumerate(zip(models, weights)) for c, g in keys if c in (SHARED, m.fit.ctx) and g not in m.fit.out]
    mine = rows.join(F.broadcast(spark.createDataFrame(seen, "fit int, ctx int, g int, w double")), ["ctx", "g"])
    # more partitions than models, so that few meet in one
    mine = mine.select("fit", "s", "y", *cues, "n", (F.col("n") * F.col("w")).alias("w")).repartition(4 * len(models), "fit")
    t = mine.groupBy("fit").applyInArrow(grow, "fit int, tree int, node int, feature int, bin int, left int, right int, value double").toArrow()
    trees = [[Tree([], {}) for _ in range(m.fit.rounds)] for m in models]
    order = np.lexsort([t.column(c).to_numpy() for c in ("node", "tree", "fit")])  # a parent's number is below its children's
    for i, at, node, feature, cut, left, right, value in zip(*(c.to_numpy()[order].tolist() for c in t.columns)):
        if feature < 0:
            trees[i][at].values[node] = value
        else:
            trees[i][at].splits.append((node, feature, cut, left, right))
    for m, grown in zip(models, trees):
        m.trees.extend(grown)


def _histograms(rows: DataFrame, cues: Sequence[str], symbols: int, views: _Views, bins, jobs: Sequence[tuple], tasks: int) -> dict[tuple[int, int], np.ndarray]:
    """(fit, node) -> sums of gradient, curvature and rows per bin. A task returns its non-empty bins; with many tasks they are summed
    by a shuffle first, so the driver sees fits x nodes x bins at most ``DIRECT`` times over. ``jobs``: trees not yet in the
    stored scores, weight by group, splits to follow, wanted nodes; ``bins``: broadcast bin tables by fit."""
    k, width = len(cues), len(cues) * SIZE + symbols

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ctx, g, s, y, cell, n = _batch(batch, k)
            offsets = batch.column(5 + k).offsets.to_numpy()
            known = batch.column(5 + k).values.to_numpy(zero_copy_only=False)
            for c in np.unique(ctx):
                here = np.flatnonzero(ctx == c)
                for place, i in enumerate(views.of(c)):
                    trees, weight, splits, wanted = jobs[i]
                    if not wanted:
                        continue
                    at = here[weight[g[here]] > 0]
                    if len(at) == 0:
                        continue
                    b = _bins_of(cell[at], bins.value[i])
                    score = known[offsets[at] + place] + predicted(trees, b, s[at])
                    p, w = 1 / (1 + np.exp(-score)), n[at] * weight[g[at]]
                    found = _node_sums(b, s[at], nodes_of(splits, b, s[at]), wanted, (w * (p - y[at]), w * p * (1 - p), n[at]), symbols)
                    total[i] = total[i] + found if i in total else found
        for i, found in total.items():
            used = np.flatnonzero(found[:, 2])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(used), i), pa.int32()), pa.array(np.array(jobs[i][3])[used // width], pa.int32()), pa.array(used % width, pa.int32()),
                 *(pa.array(found[used, j]) for j in range(3))], ["fit", "node", "at", "g", "h", "n"])

    parts = rows.mapInArrow(run, "fit int, node int, at int, g double, h double, n double")
    if tasks * sum(len(j[3]) for j in jobs) > DIRECT:
        parts = parts.groupBy("fit", "node", "at").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))
    t = parts.toArrow()
    col = {c: t.column(c).to_numpy() for c in t.column_names}
    out = {(i, target): np.zeros((width, 3)) for i, j in enumerate(jobs) for target in j[3]}
    order = np.lexsort((col["node"], col["fit"]))
    which = col["fit"][order].astype(np.int64) * (1 << 32) + col["node"][order]
    keys, starts = np.unique(which, return_index=True)
    for code, rows_ in zip(keys.tolist(), np.split(order, starts[1:])):
        for j, v in enumerate("ghn"):
            out[code >> 32, code & 0xFFFFFFFF][:, j] += np.bincount(col["at"][rows_], weights=col[v][rows_], minlength=width)
    return out


def _with_scores(rows: DataFrame, cues: Sequence[str], views: _Views, bins, starts: Sequence[float], trees: Sequence[Sequence[Tree]]) -> DataFrame:
    """Counted rows with ``known``: score by ``trees`` of every model of their context, on top of the scores they carry, if any, else of ``starts``."""
    k = len(cues)
    cols, carried = ["ctx", "g", "s", "y", *cues, "n"], "known" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ctx, _, s, _, cell, _ = _batch(batch, k)
            sizes = np.zeros(len(s), dtype=np.int64)
            for c in np.unique(ctx):
                sizes[ctx == c] = len(views.of(c))
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            if carried:
                old = batch.column(5 + k)
                new = old.values.to_numpy(zero_copy_only=False)[old.offsets[0].as_py():old.offsets[-1].as_py()].copy()
            else:
                new = np.zeros(offsets[-1])
            for c in np.unique(ctx):
                here = np.flatnonzero(ctx == c)
                for place, i in enumerate(views.of(c)):
                    at = offsets[here] + place
                    new[at] += predicted(trees[i], _bins_of(cell[here], bins.value[i]), s[here]) + (0.0 if carried else starts[i])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5 + k)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(new))], [*cols, "known"])

    types = dict(rows.dtypes)
    return stored(rows.select(*cols, *(["known"] if carried else [])).mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in cols) + ", known array<double>"), "boosting")


def boosted_fit(rows: DataFrame, cues: Sequence[str], fits: Sequence[Boost], sums: GroupSums, symbols: int, refresh: int = 8) -> list[Boosted]:
    """Boosted logistic trees for all fits at once: ``rounds`` trees of at most ``leaves`` leaves each, grown best gain first, leaf values
    shrunk by ``l2`` and ``rate``, groups weighted equally. Passes over large views store the scores by earlier trees every ``refresh`` rounds.

    A fit that sees no rows or one label only gets no splits; ties go to the lower feature and bin. Rows need no null.
    """
    spark = rows.sparkSession
    seen = [k for k in sums.keys if any(k[0] in (SHARED, f.ctx) and k[1] not in f.out for f in fits)]
    table = stored(counted(rows, cues, seen), "boosting-cells")
    counts = cell_counts(table, cues)
    per = {(r["ctx"], r["g"]): r for r in table.groupBy("ctx", "g").agg(F.sum(F.col("y") * F.col("n")).alias("p"), F.count(F.lit(1)).alias("size")).collect()}
    cuts = {v: binned(counts, v, len(cues)) for v in {f.view for f in fits}}
    models, weights, near = [], [], []
    for f in fits:
        w = sums.weights(f.view)
        mine = [(k, row[0]) for k, row, ok in zip(sums.keys, sums.sums, sums.seen(f.view)) if ok]
        yes, all_ = sum(w[k[1]] * float(per[k]["p"]) for k, _ in mine), sum(w[k[1]] * n for k, n in mine)
        rate = min(max(yes / all_, 1e-12), 1 - 1e-12) if all_ else 0.5
        models.append(Boosted(f, float(np.log(rate / (1 - rate))), cuts[f.view], []))
        weights.append(w)
        near.append(sum(per[k]["size"] for k, _ in mine) <= NEAR)
    few, many = ([i for i, one in enumerate(near) if one == side] for side in (True, False))
    if few:
        _grown_in_tasks(table, cues, symbols, [models[i] for i in few], [weights[i] for i in few], sums.keys)
    if many:
        _grown_by_passes(table, cues, symbols, [models[i] for i in many], [weights[i] for i in many], refresh)
    return models


def _grown_by_passes(table: DataFrame, cues: Sequence[str], symbols: int, models: Sequence[Boosted], weights: Sequence[np.ndarray], refresh: int) -> None:
    """Grow all models together by passes over the counted rows; scores are stored every ``refresh`` rounds."""
    spark, fits, starts = table.sparkSession, [m.fit for m in models], [m.start for m in models]
    views, bins = _Views(fits), spark.sparkContext.broadcast([m.bins for m in models])
    table, at = _with_scores(table, cues, views, bins, starts, [[] for _ in models]), 0
    tasks = table.rdd.getNumPartitions()
    for t in range(max((f.rounds for f in fits), default=0)):
        if t - at == refresh:
            table, at = _with_scores(table, cues, views, bins, starts, [m.trees[at:] for m in models]), t
        growers = [_Grower(f) for f in fits]
        for g, f in zip(growers, fits):
            if t >= f.rounds:
                g.wanted = []
        while any(g.wanted for g in growers):
            jobs = [(m.trees[at:], w, g.look_ahead(), g.wanted) for m, w, g in zip(models, weights, growers)]
            found: dict[int, dict[int, tuple]] = {i: {} for i in range(len(fits))}
            for (i, node), sums_ in _histograms(table, cues, symbols, views, bins, jobs, tasks).items():
                if split := best_split(sums_, len(cues), fits[i].l2, fits[i].min_rows):
                    found[i][node] = split
            for i, g in enumerate(growers):
                if g.wanted:
                    g.learn(found[i])
        for m, g, f in zip(models, growers, fits):
            if t < f.rounds:
                m.trees.append(g.tree())


def boosted_scores(rows: DataFrame, cues: Sequence[str], models: Sequence[Boosted], key: str = "key", on: str | None = None) -> DataFrame:
    """(key, model, score): score of every row under every model, or under the models whose name starts with the row's ``on`` and a bar."""
    k, by_name = len(cues), {}
    for m in models:
        by_name.setdefault(m.fit.name.rsplit("|", 1)[0] if on else "", []).append(m)
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in gathered(batches):
            t = pa.Table.from_batches(held).combine_chunks()
            s = t.column(1).fill_null(-1).to_numpy()
            cell = cells(np.column_stack([t.column(2 + i).to_numpy() for i in range(k)]))
            if on:
                coded = t.column(2 + k).combine_chunks().dictionary_encode()
                of, known = coded.indices.to_numpy(), coded.dictionary.to_pylist()
            else:
                of, known = np.zeros(len(s), dtype=np.int64), [""]
            for j, name in enumerate(known):
                mine = by_name.get(name, [])
                at = np.flatnonzero(of == j) if mine else []
                if len(at) == 0:
                    continue
                # equal rows are scored once
                first, place = equal_rows([(s[at] + 1, int(s.max()) + 2), *((cell[at, i], 2 * REACH) for i in range(k))])
                keys = t.column(0).take(pa.array(at)).combine_chunks()
                for m in mine:
                    score = m.start + predicted(m.trees, _bins_of(cell[at[first]], m.bins), s[at[first]])
                    yield pa.RecordBatch.from_arrays([keys, pa.repeat(m.fit.name, len(at)), pa.array(score[place])], [key, "model", "score"])

    return rows.select(key, "s", *cues, *([on] if on else [])).mapInArrow(run, f"{key} {kind}, model string, score double")
