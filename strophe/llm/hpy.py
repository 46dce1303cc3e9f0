"""Hierarchical Pitman-Yor language model: trained on counts of the whole corpus, scoring all documents.

Restaurants: one per previous word, all with the unigram restaurant as parent, whose parent is the
uniform distribution over the known words and one unknown word. Seating is sampled
by Gibbs sweeps: a sweep seats all customers of a dish in a restaurant anew, one after the
other (in blocks of a sixteenth of those seated once a dish has many), given the totals and the
parent's probabilities of the sweep before. The predictive probabilities of the sweeps after the first
are averaged level by level, which keeps every distribution normalised.

What is kept where: counts of all words and of all pairs (previous word, word) are tables keyed by word hashes,
pre-aggregated in the tasks. A sweep seats pairs row by row, so a frequent previous word is spread by its dishes;
only sums per word meet. A pair that was seen once has one table in every sweep and is not seated again. Words
with at least 1 / ``heavy_words`` of all tokens (so at most that many), and pairs of them by the rules of ``contexts`` and
``dishes``, are a cache in all tasks; other words and pairs of documents are shuffled to the tables.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strophe.llm.common import bounded_batches, written

#: At most so many words, contexts and context dishes are a cache in the tasks: those with 1 / bound of the tokens.
HEAVY_WORDS, CONTEXTS, DISHES = 100_000, 2_000, 200_000
#: Words a task remembers at once.
SEEN_WORDS = 200_000
SMALL = 1 << 20
END = b""


def word_hash(word: bytes, digest) -> int:
    """64 bits as a signed integer, never in [0, SMALL): those numbers stand for heavy words."""
    h = digest(word)
    h = h - (1 << 64) if h >= 1 << 63 else h
    return h + (1 << 40) if 0 <= h < SMALL else h


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased words and the end."""
    return [*(text or "").encode("utf-8", "replace").lower().split(), END]


class Codes:
    """Words to numbers: the place of a heavy word, or the hash of another."""

    def __init__(self, heavy: np.ndarray):
        import xxhash

        self.digest, self.place, self.known = xxhash.xxh3_64_intdigest, {int(h): i for i, h in enumerate(heavy)}, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > SEEN_WORDS:
            known.clear()
        for w in words:
            if w not in known:
                h = word_hash(w, self.digest)
                known[w] = self.place.get(h, h)
        return np.fromiter((known[w] for w in words), dtype=np.int64, count=len(words))


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, c): tokens of every word hash, the end included."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        found: Counter = Counter()

        def out() -> pa.RecordBatch:
            h = pa.array([word_hash(w, xxhash.xxh3_64_intdigest) for w in found], pa.int64())
            return pa.RecordBatch.from_arrays([h, pa.array(list(found.values()), pa.int64())], ["h", "c"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                found.update(words_of(text))
                if len(found) > SEEN_WORDS:
                    yield out()
                    found.clear()
        yield out()

    return bounded_batches(docs).select("text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def pair_key(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """64 bits of a pair of word hashes; pairs with the same first word never clash."""
    def mixed(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    return mixed(mixed(u.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) + w.astype(np.uint64)).view(np.int64)


def pair_counts(docs: DataFrame) -> DataFrame:
    """(u, w, c): tokens of every word after every previous word, both as hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, held, size = Codes(np.zeros(0, np.int64)), [], 0
        end = codes([END])

        def out() -> pa.RecordBatch:
            w = np.concatenate(held)
            u = np.concatenate((end, w[:-1]))  # texts end with END, which also stands before the next one
            _, at, c = np.unique(pair_key(u, w), return_index=True, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(u[at]), pa.array(w[at]), pa.array(c.astype(np.int64))], ["u", "w", "c"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.append(codes(words_of(text)))
                size += len(held[-1])
                if size > 2_000_000:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return bounded_batches(docs).select("text").mapInArrow(run, "u long, w long, c long").groupBy("u", "w").agg(F.sum("c").alias("c"))


def seat(customers: np.ndarray, weight: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish after seating its customers in turn; ``weight``: of opening a table."""
    tables = np.minimum(customers, 1).astype(np.int64)
    n, active = 1, np.flatnonzero(customers > 1)
    while len(active):
        step = max(1, n // 16)
        k = np.minimum(step, customers[active] - n)
        b = weight[active] if np.ndim(weight) else weight
        tables[active] += rng.binomial(k, b / (n - discount * tables[active] + b))
        n += step
        active = active[customers[active] > n]
    return tables


@dataclass
class Model:
    """The tables of the model and the bounded part of it that is sent to the tasks that score."""

    heavy: np.ndarray          # hashes
    parent: np.ndarray         # averaged probability of each heavy word in the unigram restaurant
    left: np.ndarray           # averaged share of each heavy word's own restaurant that goes to the parent
    log_base: np.ndarray       # log10 of the base probability of each heavy word
    codes: np.ndarray          # cached dishes, sorted: context * len(heavy) + word
    own: np.ndarray            # averaged share of a cached dish that comes from its own restaurant
    gain: np.ndarray           # log10 of what that adds to the parent's share
    contexts: int              # heavy words that are contexts of the cache
    unknown: float
    tokens: int
    vocabulary: int
    table: DataFrame           # h, c, p, b of every word
    shares: DataFrame          # k, u, w, c, own, gain of every pair
    rare: int                  # words below this count are not heavy
    discounts: tuple[float, float]

    @cached_property
    def backoff(self) -> np.ndarray:
        """Averaged share of each context of the cache that is not its cached dishes': the parent's and that of other dishes."""
        known = self.table.sparkSession.createDataFrame([(int(h), i) for i, h in enumerate(self.heavy[:self.contexts])], "u long, i int")
        sums = self.shares.join(F.broadcast(known), "u").groupBy("i").agg(F.sum("own").alias("s")).toPandas()
        every = np.zeros(self.contexts)
        every[sums["i"].to_numpy(np.int64)] = sums["s"]
        return every + self.left[:self.contexts] - np.bincount(self.codes // max(len(self.heavy), 1), self.own, minlength=self.contexts)


def discount_of(ones: int, twos: int) -> float:
    return min(max(ones / (ones + 2 * twos) if ones + 2 * twos else 0.5, 0.1), 0.9)


def train(docs: DataFrame, heavy_words: int = HEAVY_WORDS, contexts: int = CONTEXTS, dishes: int = DISHES,
          sweeps: int = 4, burn_in: int = 1, strengths: tuple[float, float] = (1.0, 1.0), seed: int = 1) -> Model:
    """The model of ``docs``. ``heavy_words``, ``contexts`` and ``dishes`` bound the cache, not the model."""
    words = written(word_counts(docs), "words")
    n, v, ones, twos = words.agg(F.sum("c"), F.count(F.lit(1)), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
    n = n or 0
    pairs = written(pair_counts(docs), "pairs")
    pair_ones, pair_twos = pairs.agg(F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
    d0, d1 = discount_of(ones, twos), discount_of(pair_ones, pair_twos)
    s0, s1 = strengths
    h = 1.0 / (v + 1)
    once = F.col("c") == 1
    first = _sums(pairs, dish=("w", once), context=("u", once), tables=("u", F.lit(True)))
    total_t = float(v)
    q = (F.col("c") - d0 + (s0 + d0 * v) * h) / (s0 + n)
    # each token of a context word is followed by one, the end by the next text's first: c is its number of customers
    state = written(words.join(first, "h", "left").select("h", "c", F.col("dish").alias("once_dish"), F.col("context").alias("once_context"), "tables",
                                                          q.alias("q"), F.lit(0.0).alias("sum_q"), F.lit(0).cast("long").alias("sum_t")), "state")
    seats = pairs.where(~once).withColumn("total", F.lit(0).cast("long"))
    unknown = 0.0
    for sweep in range(sweeps):
        after = int(sweep >= burn_in)
        opened = seats.join(state.select(F.col("h").alias("u"), (s1 + d1 * F.col("tables")).alias("_o")), "u").join(
            state.select(F.col("h").alias("w"), "q"), "w").select("u", "w", "c", "total", (F.col("_o") * F.col("q")).alias("b"))
        seats = written(_seated(opened, d1, [seed, sweep, 1]).select("u", "w", "c", (F.col("total") + after * F.col("t")).alias("total"), "t"), "seats")
        now = _sums(seats, dish=("w", F.col("t")), context=("u", F.col("t")))
        joined = state.join(now, "h", "left").select(
            "h", "once_dish", "once_context", F.col("c").alias("customers"), "sum_q", "sum_t", (F.col("once_dish") + F.coalesce("dish", F.lit(0))).alias("c"),
            (F.col("once_context") + F.coalesce("context", F.lit(0))).alias("tables"), F.lit((s0 + d0 * total_t) * h).alias("b"))
        state = written(_seated(joined, d0, [seed, sweep, 0]).drop("b"), "state")
        total_c, total_t = (float(x or 0) for x in state.agg(F.sum("c"), F.sum("t")).first())
        q = (F.col("c") - d0 * F.col("t") + (s0 + d0 * total_t) * h) / (s0 + total_c)
        state = state.select("h", F.col("customers").alias("c"), "once_dish", "once_context", "tables", q.alias("q"), (F.col("sum_q") + after * q).alias("sum_q"),
                             (F.col("sum_t") + after * F.col("tables")).alias("sum_t"))
        unknown += after * (s0 + d0 * total_t) * h / (s0 + total_c)
        seats = seats.drop("t")
    m = sweeps - burn_in
    table = written(state.select("h", "c", (F.col("sum_q") / m).alias("p"), ((s1 + d1 * F.col("sum_t") / m) / (s1 + F.col("c"))).alias("b")), "probabilities")
    every = seats.unionByName(pairs.where(once).withColumn("total", F.lit(m).cast("long")))
    context = table.select(F.col("h").alias("u"), "b", F.col("c").alias("_n"))
    own = (F.col("c") - d1 * F.col("total") / m) / (s1 + F.col("_n"))
    shares = every.join(context, "u").withColumn("own", own).join(table.select(F.col("h").alias("w"), "p"), "w").select(
        "u", "w", "c", "own", F.log10(1 + F.col("own") / (F.col("b") * F.col("p"))).alias("gain"))
    shares = written(_keyed(shares), "shares")
    known = table.where(F.col("c") * heavy_words >= max(n, 1)).orderBy(F.desc("c"), "h").toPandas()
    heavy, c = known["h"].to_numpy(np.int64), known["c"].to_numpy(np.int64)
    many = int((c * contexts >= n).sum())
    cached = shares.where(F.col("c") * dishes >= max(n, 1)).toPandas()
    place = {int(x): i for i, x in enumerate(heavy)}
    u, w = (np.array([place.get(x, -1) for x in cached[k]], np.int64) for k in ("u", "w"))
    kept = np.flatnonzero((u >= 0) & (u < many) & (w >= 0))
    code = u[kept] * max(len(heavy), 1) + w[kept]
    kept, code = kept[np.argsort(code)], np.sort(code)
    return Model(heavy, known["p"].to_numpy(float), known["b"].to_numpy(float), np.log10((c + 1) / (n + v + 1)), code, cached["own"].to_numpy(float)[kept],
                 cached["gain"].to_numpy(float)[kept], many, unknown / m if n else 1.0, n, v, table, shares, -(-n // heavy_words), (d0, d1))


def _sums(rows: DataFrame, **parts: tuple[str, object]) -> DataFrame:
    """(h, one sum per part): a part is a key column and what is summed."""
    each = [F.struct(F.col(key).alias("h"), *[(value.cast("long") if k == name else F.lit(0).cast("long")).alias(k) for k in parts]) for name, (key, value) in parts.items()]
    return rows.select(F.explode(F.array(*each)).alias("s")).select("s.*").groupBy("h").agg(*[F.sum(k).alias(k) for k in parts])


def _seated(rows: DataFrame, discount: float, seed: list[int]) -> DataFrame:
    """``rows`` with t, the sampled tables of c customers; b: weight of opening one. Write the result before any
    other use: a repeated task may draw anew, and only what one task has written counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                c, b = batch.column("c").to_numpy(), batch.column("b").to_numpy()
                rng = np.random.default_rng([*seed, abs(batch.column(0)[0].as_py()), abs(batch.column(1)[0].as_py())])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(seat(c, b, discount, rng))], [*batch.schema.names, "t"])

    return rows.mapInArrow(run, ", ".join(f"{k} {t}" for k, t in [*rows.dtypes, ("t", "long")]))


def _keyed(rows: DataFrame) -> DataFrame:
    """``rows`` with k, the key of (u, w)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = pair_key(batch.column("u").to_numpy(), batch.column("w").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(k), *batch.columns], ["k", *batch.schema.names])

    return rows.mapInArrow(run, ", ".join(f"{k} {t}" for k, t in [("k", "long"), *rows.dtypes]))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score: one row per distinct (doc_id, text).

    base_score: add-one unigram log10 probability; score: log10 probability under the model. A null
    or empty text is the end alone. Null ids are an id of their own; rows repeated whole come out once;
    other columns are ignored. With nothing to train on every token is unknown.
    """
    heavy, log_base, codes, gain, trained = model.heavy, model.log_base, model.codes, model.gain, model.tokens > 0
    # the contexts of a text are its words: each stands once before a word
    log_word = np.log10(model.parent) + np.log10(model.left)
    width, many = max(len(heavy), 1), model.contexts
    kind = docs.schema["doc_id"].dataType
    names = ["h", "doc_id", "v", "kind", "val"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Codes(heavy)
        end = code([END])
        for batch in batches:
            texts, ids, versions = batch.column(1).to_pylist(), batch.column(0), batch.column(2).to_numpy()
            held, rows, size = [], [], 0
            for i, text in enumerate(texts):
                w = code(words_of(text))
                u = np.concatenate((end, w[:-1]))
                frequent = (w >= 0) & (w < width) & (len(heavy) > 0)
                hw = w[frequent]
                score, cached = log_word[hw].sum(), np.zeros(len(w), bool)
                if len(codes):
                    key = np.where(frequent & (u >= 0) & (u < many), u * width + w, -1)
                    at = np.minimum(np.searchsorted(codes, key), len(codes) - 1)
                    cached = codes[at] == key
                    score += gain[at[cached]].sum()
                rare, tf = np.unique(w[~frequent], return_counts=True)
                full = np.where(frequent, heavy[np.where(frequent, w, 0)], w) if len(heavy) else w
                before = np.concatenate((full[-1:], full[:-1]))
                pair, pf = np.unique(pair_key(before[~cached], full[~cached]), return_counts=True) if trained else (rare[:0], tf[:0])
                spread = np.int64(hash((int(versions[i]), i)) & 0x7FFFFFFFFFFFFFF)
                kinds = np.repeat(np.array([0, 6, *range(1, 6)], np.int32), [len(rare), len(pair), 1, 1, 1, 1, 1])
                held.append((np.concatenate((rare, pair, np.full(5, spread))), kinds,
                             np.concatenate((tf.astype(float), pf.astype(float), [len(w), len(hw), log_base[hw].sum() if len(heavy) else 0.0, score, 1.0]))))
                rows.append(len(rare) + len(pair) + 5)
                size += rows[-1]
                if size > 200_000 or i == len(texts) - 1:
                    at = np.repeat(np.arange(i + 1 - len(rows), i + 1), rows)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[0] for x in held])), ids.take(pa.array(at)), pa.array(versions[at]),
                                                      pa.array(np.concatenate([x[1] for x in held])), pa.array(np.concatenate([x[2] for x in held]))], names)
                    held, rows, size = [], [], 0

    base = bounded_batches(docs).select("doc_id", "text", F.hash(F.coalesce("text", F.lit(""))).alias("v"))
    rows = base.mapInArrow(run, f"h long, doc_id {kind.simpleString()}, v int, kind int, val double")
    # words and pairs in one table: one shuffle of the documents' rows
    looked_up = model.table.where(F.col("c") < model.rare).select("h", "c", F.log10(F.col("p") * F.col("b")).alias("x"), F.lit(0).alias("kind")).unionByName(
        model.shares.select(F.col("k").alias("h"), F.lit(0).cast("long").alias("c"), F.col("gain").alias("x"), F.lit(6).alias("kind")))
    joined = rows.join(looked_up, ["h", "kind"], "left")
    rare, pair = F.col("kind") == 0, F.col("kind") == 6
    add_one = F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(float(model.tokens + model.vocabulary + 1)))
    s = lambda kind_no, extra: F.sum(F.when(F.col("kind") == kind_no, F.col("val")).when(rare, F.col("val") * extra).otherwise(0.0))
    sums = joined.groupBy("doc_id", "v").agg(
        F.sum(F.when(F.col("kind") == 1, F.col("val"))).alias("n"), s(2, F.col("c").isNotNull().cast("int")).alias("k"), s(3, add_one).alias("b"),
        F.sum(F.when(F.col("kind") == 4, F.col("val")).when(rare, F.col("val") * F.coalesce("x", F.lit(math.log10(model.unknown))))
              .when(pair, F.col("val") * F.coalesce("x", F.lit(0.0))).otherwise(0.0)).alias("s"), F.sum(F.when(F.col("kind") == 5, F.col("val"))).alias("m"))
    return sums.select("doc_id", (F.col("n") / F.col("m")).cast("long").alias("n_tokens"), (F.col("k") / F.col("m")).cast("long").alias("n_known"),
                       F.lit(model.tokens).cast("long").alias("train_tokens"), (F.col("b") / F.col("m")).alias("base_score"), (F.col("s") / F.col("m")).alias("score"))
