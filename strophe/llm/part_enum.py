"""Set similarity join on word shingles with PartEnum signatures.

Sets of one size band whose Jaccard similarity reaches the threshold differ in at most k
elements. The domain of shingle hashes is cut into n1 groups of n2 partitions; some group then
holds at most k2 = k // n1 of the differences, so at least n2 - k2 of its partitions agree.
Every subset of n2 - k2 partitions of a group is hashed into one signature: similar sets share
at least one. A signature over no elements says nothing and is left out; small sets draw several
independent cuts, which makes it certain in practice that a shared one remains.

Equal sets are one class, in a task before anything is shuffled, and over the corpus by their
hash. Classes that share a signature are tried in rounds: first against one leader of each part of
a group, then, where a group still spans several components, against the nearest member of another
component, and at last against every member of another component. A bound from bucket counts that
never rejects a similar pair goes before the exact check of whole sets. So groups of similar copies
cost about one pair a member, and no link that could join two components is lost. After the first round only members
with an untried pair within the bound go on, the followers of one leader as a group of their own: where unrelated
sets or several clusters merely share a signature, nothing goes on to the later rounds.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strophe.llm.common import bounded_batches, maybe_in, written
from strophe.llm.components import components

SHINGLE = 5
PERCENT = 80
BUCKETS = 256
#: Sets remembered by a task so that equal ones emit their signatures once; words remembered for their hash.
SEEN_CLASSES, SEEN_WORDS = 100_000, 150_000
#: Members of a signature group that a task holds at once; the blocks of a larger group meet in pairs.
BLOCK = 2048
#: Comparisons spent on the untried pairs of a group, at least, and as a multiple of those with leaders; a denser group goes on whole.
LOOKED, TIMES = 1 << 19, 32

U = np.uint64


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser (every bit of the input moves every bit of the output)."""
    with np.errstate(over="ignore"):
        x = x + U((0x9E3779B97F4A7C15 * (2 * salt + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def distinct_sorted(x: np.ndarray) -> np.ndarray:
    """Distinct values in order; for arrays of a text's size several times faster than ``np.unique``."""
    x = np.sort(x)
    return x[np.concatenate((np.ones(min(len(x), 1), bool), x[1:] != x[:-1]))]


class Shingler:
    """Sorted distinct 64-bit hashes of the word shingles of a text (A-Z lower-cased)."""

    def __init__(self, width: int):
        import xxhash

        self.width, self.hash, self.words = width, xxhash.xxh3_64_intdigest, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "replace").lower().split()
        known = self.words
        if len(known) > SEEN_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = self.hash(w)
        h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        k = min(self.width, len(h))
        if not k:
            return h
        with np.errstate(over="ignore"):
            s = h[:len(h) - k + 1] + U(k)
            for i in range(1, k):
                s = s * U(0x9E3779B97F4A7C15) + h[i:len(h) - k + 1 + i]
        return distinct_sorted(mixed(s))


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set; the sums do not depend on order."""
    return int(mixed(s, 1).sum(dtype=np.uint64).astype(np.int64)), int(mixed(s, 2).sum(dtype=np.uint64).astype(np.int64))


@lru_cache(maxsize=4096)
def band_edges(percent: int) -> tuple[int, ...]:
    """Smallest sizes of the bands: each ends where its first size could no longer meet the next."""
    edges = [1]
    while edges[-1] < 1 << 40:
        edges.append(max(edges[-1] + 1, edges[-1] * 100 // percent + 1))
    return tuple(edges)


def bands(size: int, percent: int) -> list[int]:
    """The band of a set as the smaller partner and, where it may be the larger one, the band below."""
    edges = band_edges(percent)
    own = int(np.searchsorted(edges, size, side="right")) - 1
    return [own] if own == 0 or (edges[own] - 1) * 100 < size * percent else [own, own - 1]


def parameters(band: int, percent: int) -> tuple[int, int, int, int]:
    """(n1, n2, k2, cuts) of a band. k: the most elements in which two similar sets can differ whose
    smaller one has the band's largest size a and whose larger one a * 100 / percent."""
    a = band_edges(percent)[band + 1] - 1
    largest = a * 100 // percent
    k = (100 - percent) * (a + largest) // (100 + percent)
    if k == 0:
        return 1, 1, 0, 1
    n2, k2 = (3, 1) if a <= 256 else (2, 1)
    return k // (k2 + 1) + 1, n2, k2, 4 if a <= 40 else 2 if a <= 256 else 1


@lru_cache(maxsize=4096)
def cuts_of(band: int, percent: int) -> tuple:
    """(n1, n2, subsets, edges between partitions, a salt for each (cut, subset, group)) of a band."""
    n1, n2, k2, cuts = parameters(band, percent)
    edges = np.array([i * (1 << 64) // (n1 * n2) for i in range(1, n1 * n2)], dtype=np.uint64)
    subsets = list(itertools.combinations(range(n2), n2 - k2))
    salts = [np.stack([mixed(np.arange(n1, dtype=np.uint64), ((band * 8 + cut) * 64 + j) * 4 + 5) for j in range(len(subsets))], axis=1) for cut in range(cuts)]
    member = np.zeros((n2, len(subsets)), dtype=np.uint64)
    for j, chosen in enumerate(subsets):
        member[list(chosen), j] = 1
    return n1, n2, edges, salts, member


def signatures(s: np.ndarray, percent: int) -> np.ndarray:
    """Signatures of one set of hashes, sorted ascending."""
    found, cut_of = [], {}
    with np.errstate(over="ignore"):
        for band in bands(len(s), percent):
            n1, n2, edges, salts, member = cuts_of(band, percent)
            for cut, salt in enumerate(salts):
                if cut not in cut_of:
                    h = s if cut == 0 else np.sort(mixed(s, 100 + cut))
                    cut_of[cut] = h, np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(h, 3), dtype=np.uint64)))
                h, total = cut_of[cut]
                at = np.empty(len(edges) + 2, dtype=np.int64)
                at[0], at[1:-1], at[-1] = 0, np.searchsorted(h, edges), len(h)
                part = total[at]
                sums = (part[1:] - part[:-1]).reshape(n1, n2) @ member
                some = (at[1:] - at[:-1]).reshape(n1, n2).astype(np.uint64) @ member > 0
                found.append((sums + salt)[some])
    return distinct_sorted(mixed(np.concatenate(found))).view(np.int64)


def sketch(s: np.ndarray) -> bytes:
    """Elements per hash bucket; the sum of absolute differences never exceeds the number of differing elements."""
    counts = np.bincount((s & U(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def may_link(size_a, size_b, gap, percent: int):
    """Whether sets with these sizes that differ in at least ``gap`` elements can reach the similarity."""
    return (100 + percent) * gap <= (100 - percent) * (size_a + size_b)


def _sets(docs: DataFrame, shingle: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, k1, k2, sketch) of every row, and (sig, k1): signatures, once per class and task."""
    def slim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Shingler(shingle)
        for batch in batches:
            rows = [(len(s), *set_key(s), sketch(s)) for s in map(cut, batch.column(1).to_pylist())]
            n, k1, k2, sk = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()),
                                              pa.array(sk, pa.binary())], ["doc_id", "n", "k1", "k2", "sketch"])

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, seen = Shingler(shingle), set()
        for batch in batches:
            keys, sigs, held = [], [], 0
            for text in batch.column(0).to_pylist():
                s = cut(text)
                key = set_key(s)
                if len(s) and key not in seen:
                    seen = seen if len(seen) < SEEN_CLASSES else set()
                    seen.add(key)
                    sigs.append(signatures(s, percent))
                    keys.append(np.full(len(sigs[-1]), key[0], dtype=np.int64))
                    held += len(sigs[-1])
                    if held > 200_000:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs)), pa.array(np.concatenate(keys))], ["sig", "k1"])
                        keys, sigs, held = [], [], 0
            if sigs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs)), pa.array(np.concatenate(keys))], ["sig", "k1"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return (docs.select("doc_id", "text").mapInArrow(slim, f"doc_id {kind}, n long, k1 long, k2 long, sketch binary"),
            docs.select("text").mapInArrow(signed, "sig long, k1 long"))


def _dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows of a key in one task, sorted by all columns in ``keys``; the first column decides the task."""
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(width, *keys[:-1]).sortWithinPartitions(*keys)


def _shared(rows: DataFrame) -> DataFrame:
    """(g, k1): members of signatures that two or more classes share; signatures with the same members are
    one group g. Rows come sorted, so a task holds one run; a run over BLOCK goes on under its signature."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(g: np.ndarray, k: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(g), pa.array(k)], ["g", "k1"])

        current, held, long = None, np.zeros(0, np.int64), False
        for batch in batches:
            sig, k = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if long:
                cut = int(np.searchsorted(sig, current, side="right"))
                if cut:
                    more = k[:cut][k[:cut] != np.concatenate((held, k[:cut - 1]))]
                    yield out(np.full(len(more), current), more)
                    held, sig, k = k[cut - 1:cut], sig[cut:], k[cut:]
                long = not len(sig)
                held = held if long else held[:0]
            if len(held) and not long:
                sig, k = np.concatenate((np.full(len(held), current), sig)), np.concatenate((held, k))
            if not len(sig):
                continue
            new = np.concatenate(([True], (sig[1:] != sig[:-1]) | (k[1:] != k[:-1])))
            sig, k = sig[new], k[new]
            start = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
            size, tail = np.diff(start), start[-1]
            many = size > 1
            if many.any():
                sums = np.add.reduceat(mixed(k[:tail].view(np.uint64), 9), start[:-1])[many]
                yield out(np.repeat(sums.view(np.int64), size[many]), k[:tail][np.repeat(many, size)])
            current, held = sig[-1], k[tail:]
            if len(held) > BLOCK:
                yield out(np.full(len(held), current), held)
                long, held = True, held[-1:]
        if len(held) > 1:
            yield out(np.full(len(held), mixed(held.view(np.uint64), 9).sum(dtype=np.uint64)).view(np.int64), held)

    return _dealt(rows, "sig", "k1").mapInArrow(run, "g long, k1 long")


def untried(n: np.ndarray, c: np.ndarray, x: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Positions of members that hold the pairs within the bound other than ``pairs``, those of each leader with its followers: the
    followers of one leader, with its position, and, with -1, members that have such a pair outside their own part."""
    m = len(n)
    part, pairs = np.arange(m), [p for p in pairs if len(p[1])]
    for a, b in pairs:
        part[b] = a[0]
    followers = np.flatnonzero(part != np.arange(m))
    if sum(len(b) * (m - 1 - len(b)) for _, b in pairs) > max(LOOKED, TIMES * m * (m - len(followers))):
        yield -1, np.arange(m)
        return
    yield from ((a[0], b) for a, b in pairs if len(b) > 1)
    left = np.zeros(m, bool)
    for i in followers:
        ok = (c != c[i]) & (part != part[i])
        ok[ok] = may_link(n[i], n[ok], np.abs(x[i] - x[ok]).sum(axis=1), percent)
        left |= ok
        left[i] |= ok.any()
    yield -1, np.flatnonzero(left)


def _pairs(members: DataFrame, percent: int, how: str) -> DataFrame:
    """(a, ka, b, kb): candidate pairs, within the bound, of groups (g, id, k1, c, n, sketch) with components c;
    and, after ``star``, (a, ka, g): members (id a, key ka) of smaller groups g that hold all untried pairs.

    ``star``: one leader for each part of a group that lies within its bound. ``nearest``: each member outside the
    group's largest component with the nearest member of another component. ``all``: every pair of
    different components.

    Groups over BLOCK members are dealt into blocks whose number is counted; each pair of blocks is a
    group of its own, so that a task never holds more than two blocks."""
    def of_group(n: np.ndarray, c: np.ndarray, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions of the pairs in a group sorted by id."""
        if how == "nearest":
            names, size = np.unique(c, return_counts=True)
            for i in np.flatnonzero(c != names[size.argmax()]):
                others = np.flatnonzero(c != c[i])
                gap = np.abs(x[i] - x[others]).sum(axis=1)
                j = others[gap.argmin()]
                if may_link(n[i], n[j], gap.min(), percent):
                    yield np.array([min(i, j)]), np.array([max(i, j)])
            return
        rest = np.arange(len(n))
        while len(rest) > 1:
            i, others = rest[0], rest[1:]
            ok = c[others] != c[i]
            ok[ok] = may_link(n[i], n[others[ok]], np.abs(x[i] - x[others[ok]]).sum(axis=1), percent)
            yield np.full(ok.sum(), i), others[ok]
            rest = others[~ok] if how == "star" else others

    names = ["a", "ka", "b", "kb", "g"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in itertools.chain(batches, [None]):
            rows = held if batch is None else [c.to_numpy() for c in batch.columns[:7]] + [
                np.frombuffer(b"".join(batch.column(7).to_pylist()), np.uint8).reshape(batch.num_rows, BUCKETS)]
            if batch is not None and held is not None:
                rows = [np.concatenate(z) for z in zip(held, rows, strict=True)]
            if rows is None or not len(rows[0]):
                continue
            g, x, y, k, k1, c, n, sk = rows
            start = np.flatnonzero(np.concatenate(([True], (g[1:] != g[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1]))))
            end = np.concatenate((start[1:], [len(g)]))
            if batch is not None:  # the last group may go on
                held = [z[start[-1]:] for z in rows]
                start, end = start[:-1], end[:-1]
            two = start[end - start == 2]
            gap = np.abs(sk[two].astype(np.int16) - sk[two + 1]).sum(axis=1)
            two = two[(c[two] != c[two + 1]) & may_link(n[two], n[two + 1], gap, percent)]
            found, left = [(two, two + 1)], [(two[:0], g[:0])]
            for i, j in zip(start[end - start > 2], end[end - start > 2], strict=True):
                own = n[i:j], c[i:j], sk[i:j].astype(np.int16)
                pairs = list(of_group(*own))
                found += [(i + a, i + b) for a, b in pairs]
                for leader, at in untried(*own, pairs, percent) if how == "star" else ():
                    name = g[i] if leader < 0 else mixed((g[i:i + 1] ^ k[i + leader]).view(np.uint64), 11).view(np.int64)[0]
                    left.append((i + at, np.full(len(at), name)))
            a, b = (np.concatenate([f[h] for f in found]) for h in (0, 1))
            at, group = (np.concatenate([f[h] for f in left]) for h in (0, 1))
            yield pa.RecordBatch.from_arrays([*(pa.array(z) for z in (k[a], k1[a], k[b], k1[b])), pa.nulls(len(a), pa.int64())], names)
            yield pa.RecordBatch.from_arrays([pa.array(k[at]), pa.array(k1[at]), *[pa.nulls(len(at), pa.int64())] * 2, pa.array(group)], names)

    size = members.groupBy("g").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > BLOCK)
    size = written(size, "sizes")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    big = members.join(size, "g").withColumn("_mine", F.pmod(F.xxhash64("id"), blocks).cast("int"))
    big = big.withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    big = big.withColumn("_x", F.least("_mine", "_other")).withColumn("_y", F.greatest("_mine", "_other"))
    small = members.join(size, "g", "left_anti").withColumn("_x", F.lit(0)).withColumn("_y", F.lit(0))
    cols = ["g", "_x", "_y", "id", "k1", "c", "n", "sketch"]
    dealt = _dealt(small.select(cols).union(big.select(cols)), "g", "_x", "_y", "id")
    return dealt.mapInArrow(run, "a long, ka long, b long, kb long, g long")


def _elements(pairs: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """(id, k1, elements): the sets of the representatives in any of the pairs, cut anew from the texts; where
    ids repeat, with more rows than asked for."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(shingle)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [shingles(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([set_key(x)[0] for x in sets], pa.int64()),
                                                  pa.array([x.tobytes() for x in sets], pa.binary())], ["id", "k1", "elements"])

    texts = maybe_in(docs.select(F.col("doc_id").alias("id"), "text"), pairs.select(F.explode(F.array("a", "b")).alias("id")), "id")
    return texts.mapInArrow(cut, "id long, k1 long, elements binary")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs whose whole sets reach the similarity."""
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in (2, 3))
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                both = int((x[at] == y).sum())
                if 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([c.take(pa.array(keep, pa.int64())) for c in batch.columns[:2]], ["a", "b"])

    def side(id_: str, key: str, value: str) -> DataFrame:
        own = maybe_in(sets, pairs.select(F.col(id_).alias("id")), "id")
        return own.select(F.col("id").alias(id_), F.col("k1").alias(key), F.col("elements").alias(value))

    both = pairs.join(side("a", "ka", "x"), ["a", "ka"]).join(side("b", "kb", "y"), ["b", "kb"])
    return both.select("a", "b", "x", "y").mapInArrow(check, "a long, b long").distinct()


def near_duplicate_classes(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links: one row per row of ``docs``; doc_id is an integer.

    A text's set: its distinct shingles of ``shingle`` words, or all its words as one if it has
    fewer. Two sets are linked when 100 * |intersection| >= ``percent`` * |union|; component_id is
    the smallest doc_id reachable by links. n_links counts the links found between the row's class of
    equal sets and other classes (enough to join each component, not all).

    Null texts and texts without words have the empty set: no links, component_id is their own id.
    Rows with a null doc_id join rows of an equal set; a set that no row with an id has stays
    alone with a null component_id. Repeated rows come out as often as they came in; rows that
    share an id are linked through their texts alone. Other columns are ignored.
    """
    docs = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    slim, sigs = _sets(docs, shingle, percent)
    slim = written(slim, "slim")
    full = slim.where("n > 0")
    classes = written(full.groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch")), "classes")
    shared = written(_shared(sigs).distinct(), "shared")
    members = shared.join(classes.where("rep IS NOT NULL").select("k1", F.col("rep").alias("id"), "n", "sketch"), "k1")
    members = written(members.select("g", "id", "k1", "n", "sketch"), "members")
    tried = edges = None
    found = members.withColumn("c", F.col("id"))
    for how in ("star", "nearest", "nearest", "all"):
        made = written(_pairs(found, percent, how), "made")
        pairs = made.where("g IS NULL").select("a", "ka", "b", "kb").distinct()
        pairs = written(pairs if tried is None else pairs.join(tried, ["a", "ka", "b", "kb"], "left_anti"), "pairs")
        if tried is None:  # later rounds see only what holds untried pairs
            members = made.where("g IS NOT NULL").select("g", F.col("a").alias("id"), F.col("ka").alias("k1")).distinct()
        links = written(_verified(pairs, written(_elements(pairs, docs, shingle), "sets"), percent), "links")
        tried = pairs if tried is None else tried.unionByName(pairs)
        if edges is None or links.count():  # else the components are as before
            edges = links if edges is None else edges.unionByName(links)
            labels = components(edges)
            found = members.join(labels.withColumnRenamed("v", "id"), "id", "left").withColumn("c", F.coalesce("c", "id"))
            still = found.groupBy("g").agg(F.min("c").alias("_a"), F.max("c").alias("_b")).where("_a <> _b").select("g")
            found = found.join(written(still, "open"), "g", "left_semi")
            found = written(found.join(classes.select("k1", F.col("rep").alias("id"), "n", "sketch"), ["k1", "id"]), "open-members")
            if found.isEmpty():
                break
    degree = edges.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    named = classes.join(labels.withColumnRenamed("v", "rep"), "rep", "left").join(degree, "rep", "left")
    named = written(named.select("k1", "k2", "n", F.coalesce("c", "rep").alias("component_id"), F.coalesce("links", F.lit(0)).alias("links")), "named")
    out = full.join(named, ["k1", "k2", "n"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("links").cast("long").alias("n_links"))
    alone = slim.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(alone)
