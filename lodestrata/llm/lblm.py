"""LM scoring: a log-bilinear model trained with noise-contrastive estimation.

Words are lowered A-Z; a text is its words and one end. Every word has a symbol: the
3,071 most frequent words and the end have one each, all others share bins. Symbols lie
in GROUPS groups of MEMBERS. Frequent words are sorted by their reversed spelling and
cut into groups, so that a group shares its endings; another word joins the group where
its reversed spelling falls, in a bin by its first letters (ties between equally
frequent words: the smaller word is frequent).

The vectors of the ORDER symbols before a word (ends at the beginning) are weighed by
position and added up. One matrix product with the groups' vectors gives, with a bias
and normalised in full, the probability of the word's group; one with the vectors of the
group's members that of the symbol. Within a bin a word has its smoothed share of the
bin's training count. So the probabilities of all words and of one unknown word in each
bin sum to one.

Every training token trains, in shards of about SHARD_TOKENS tokens. A document's shard
and its place there follow from its hash, not from files or partitions. A task runs
noise-contrastive estimation in numpy over its shard, with noise from the unigrams of
the groups and within them. Each of ROUNDS rounds takes the next part of every shard's
tokens, in shuffled order, from the parameters that all shards reached together: their
mean, weighed by tokens.

Word counts come from all training documents. Words more frequent than a cut reach the
tasks as sorted hashes with counts, at most LOCAL words whatever the corpus; the counts
of the rarer words of each document are found by a join, whose keys are never frequent.
A word outside the sorted hashes that meets one of them by its XXH3 hash takes its
count, with a chance under 1e-13 a word.

Cases: null and empty texts are one end; very long texts are read whole, and a shard is
as long as its longest document if that is longer; without training documents every
count is zero and the network is at its start; null doc_ids count as the empty text for
the split; repeated rows return repeated rows; an empty table returns no rows; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import bounded_batches, crc_mod, fresh, texts, written

#: Groups of symbols; a group's frequent words, then its bins.
GROUPS, FREQUENT, BINS = 64, 48, 16
MEMBERS = FREQUENT + BINS
SYMBOLS = GROUPS * MEMBERS
ORDER, WIDTH = 4, 16
SHARD_TOKENS, ROUNDS = 2_000_000, 2
NOISE, INNER_NOISE, CHUNK, RATE, SEED = 24, 8, 8192, 0.1, 4
#: Tokens that are scored at once.
SCORED = 1 << 15
#: Of these, tokens whose scores fit a core's cache.
CACHED = 1 << 12
#: Words whose counts are sent to every task, at most: 16 bytes each.
LOCAL = 1 << 20
#: Distinct words that a task counts or remembers before it lets go.
REMEMBERED = 300_000
SMOOTH = 0.1
#: Stands for the end among tokens; no word is a blank.
END_WORD = b" "
#: Columns of a row of averaged parameters.
ROW = 64


def words(text: bytes) -> list[bytes]:
    return text.lower().split()


def sums(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Rows of WIDTH added up by their place ``at``, of n places. Two columns are added at a
    time, as the parts of a complex number."""
    pairs = WIDTH // 2
    out = np.zeros(n * pairs, np.complex64)
    np.add.at(out, (at[:, None] * pairs + np.arange(pairs)).ravel(), rows.reshape(-1).view(np.complex64))
    return out.view(np.float32).reshape(n, WIDTH)


def log_softmax_at(vectors: np.ndarray, bias: np.ndarray, h: np.ndarray, picked: np.ndarray) -> np.ndarray:
    """Normalised log probability of the vector picked for each row of h."""
    scores = vectors @ h.T
    scores += bias[:, None]
    own = scores[picked, np.arange(len(picked))]
    if scores.max() > 60 or own.min() < -60:  # else the sums of powers are far from the bounds of a float
        top = scores.max(axis=0)
        scores -= top
        own -= top
    np.exp(scores, out=scores)
    return own - np.log(np.ones(len(vectors), np.float32) @ scores)


def pushed(x: np.ndarray) -> np.ndarray:
    """-1 / (1 + exp(-x)), in place of x."""
    np.negative(x, out=x)
    with np.errstate(over="ignore"):
        np.exp(x, out=x)
    x += 1
    return np.divide(-1, x, out=x)


class Network:
    """unigram: probability of each symbol, 0 for symbols that no word has."""

    def __init__(self, unigram: np.ndarray):
        rng = np.random.default_rng(SEED)
        draw = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
        self.of_group = unigram.reshape(GROUPS, MEMBERS).sum(axis=1)
        self.of_member = unigram.reshape(GROUPS, MEMBERS) / self.of_group[:, None]
        self.context, self.weigh = draw(SYMBOLS, WIDTH), np.full((ORDER, WIDTH), 1 / ORDER, np.float32)
        self.group, self.group_bias = draw(GROUPS, WIDTH), np.log(self.of_group).astype(np.float32)
        self.member = np.zeros((SYMBOLS, WIDTH), np.float32)
        self.member_bias = np.log(np.maximum(self.of_member.ravel(), 1e-30)).astype(np.float32)
        # what learning asks of the noise at every step
        self.noise = np.log(NOISE * self.of_group).astype(np.float32)
        self.inner_noise = np.log(INNER_NOISE * np.maximum(self.of_member.ravel(), 1e-30)).astype(np.float32)
        self.group_up_to, self.member_up_to = np.cumsum(self.of_group), np.cumsum(self.of_member, axis=1)

    def parts(self) -> list[np.ndarray]:
        return [self.context, self.weigh, self.group, self.group_bias, self.member, self.member_bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for p in self.parts():
            p[...] = flat[at : at + p.size].reshape(p.shape)
            at += p.size

    def hidden(self, before: np.ndarray) -> np.ndarray:
        """Vectors of the symbols before, weighed by position and added up."""
        tables = self.context * self.weigh[:, None, :]
        h = np.take(tables[0], before[0], axis=0)
        more = np.empty_like(h)
        for o in range(1, ORDER):
            h += np.take(tables[o], before[o], axis=0, out=more, mode="clip")
        return h

    def log10(self, before: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Normalised log10 probability of each symbol; before[o] is the symbol o + 1 places back."""
        out = np.empty(len(symbols))
        for at in range(0, len(symbols), SCORED):
            y = symbols[at : at + SCORED]
            g = y // MEMBERS
            h = self.hidden(before[:, at : at + SCORED])
            value = np.empty(len(y))
            for a in range(0, len(y), CACHED):
                value[a : a + CACHED] = log_softmax_at(self.group, self.group_bias, h[a : a + CACHED], g[a : a + CACHED])
            order = np.argsort(g.astype(np.int16), kind="stable")
            ends = np.searchsorted(g[order], np.arange(GROUPS + 1))
            h, inside, more = np.take(h, order, axis=0), y[order] % MEMBERS, np.empty(len(y))
            for k in np.flatnonzero(np.diff(ends)).tolist():
                own = slice(k * MEMBERS, (k + 1) * MEMBERS)
                for a in range(ends[k], ends[k + 1], CACHED):
                    b = min(a + CACHED, ends[k + 1])
                    more[a:b] = log_softmax_at(self.member[own], self.member_bias[own], h[a:b], inside[a:b])
            value[order] += more
            out[at : at + SCORED] = value
        return out / math.log(10)

    def learn(self, before: np.ndarray, y: np.ndarray, rng: np.random.Generator, squares: list[np.ndarray]) -> None:
        """One step of noise-contrastive estimation with Adagrad; the noise is shared."""
        order = np.argsort((y // MEMBERS).astype(np.int16), kind="stable")
        before, y = np.take(before, order, axis=1), y[order]
        g, n = y // MEMBERS, len(y)
        ends = np.searchsorted(g, np.arange(GROUPS + 1))
        sizes = np.diff(ends)
        held = np.flatnonzero(sizes)
        h = self.hidden(before)
        # groups against noise groups
        k = np.minimum(np.searchsorted(self.group_up_to, rng.random(NOISE)), GROUPS - 1)
        own = np.repeat(self.group, sizes, axis=0)
        pull = -pushed(np.repeat(self.noise - self.group_bias, sizes) - np.einsum("bw,bw->b", h, own))
        push = h @ self.group[k].T
        push += self.group_bias[k] - self.noise[k]
        pushed(push)
        dh = push @ self.group[k]
        own *= pull[:, None]
        dh += own
        d_group, d_group_bias = np.zeros_like(self.group), np.zeros_like(self.group_bias)
        np.add.at(d_group, k, push.T @ h)
        np.add.at(d_group_bias, k, np.ones(n, np.float32) @ push)
        d_group_bias[held] += np.add.reduceat(pull, ends[held])
        # members against noise members of their group
        drawn = (self.member_up_to[:, None, :] < (rng.random((GROUPS, INNER_NOISE)) * self.member_up_to[:, -1:])[:, :, None]).sum(axis=2)
        drawn = np.minimum(drawn, MEMBERS - 1) + MEMBERS * np.arange(GROUPS)[:, None]
        own = np.take(self.member, y, axis=0)
        inner = -pushed(np.take(self.inner_noise - self.member_bias, y) - np.einsum("bw,bw->b", h, own))
        own *= inner[:, None]
        dh += own
        vectors, columns = self.member[drawn], np.ascontiguousarray(self.member[drawn].transpose(0, 2, 1))
        push, each = np.empty((n, INNER_NOISE), np.float32), [(q, slice(ends[q], ends[q + 1])) for q in held.tolist()]
        for q, rows in each:
            np.matmul(h[rows], columns[q], out=push[rows])
        push += np.repeat((self.member_bias - self.inner_noise)[drawn], sizes, axis=0)
        pushed(push)
        both, d_drawn = np.column_stack((pull, push)), np.zeros((GROUPS, 1 + INNER_NOISE, WIDTH), np.float32)
        for q, rows in each:
            np.matmul(both[rows].T, h[rows], out=d_drawn[q])
            dh[rows] += push[rows] @ vectors[q]
        d_group += d_drawn[:, 0]
        h *= inner[:, None]
        d_member, d_member_bias = sums(y, h, SYMBOLS), np.bincount(y, inner, SYMBOLS).astype(np.float32)
        d_member += sums(drawn.ravel(), np.ascontiguousarray(d_drawn[:, 1:]), SYMBOLS)
        np.add.at(d_member_bias, drawn[held].ravel(), np.add.reduceat(push, ends[held], axis=0).ravel())
        # symbols before, by their distance
        added = np.stack([sums(b, dh, SYMBOLS) for b in before])
        d_weigh, d_context = np.einsum("osw,sw->ow", added, self.context), np.einsum("osw,ow->sw", added, self.weigh)
        for p, d, q in zip(self.parts(), (d_context, d_weigh, d_group, d_group_bias, d_member, d_member_bias), squares):
            d /= n
            q += d * d
            p += RATE * d / (np.sqrt(q) + 1e-6)


def contexts(symbols: np.ndarray, place: np.ndarray, at: np.ndarray, end: int) -> np.ndarray:
    """Symbols before each position at, one row a distance; place: a position in its text."""
    here, before = place[at], np.empty((ORDER, len(at)), np.int64)
    for o in range(1, ORDER + 1):
        before[o - 1] = np.where(here >= o, symbols[at - o], end)
    return before


def places(sizes: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... anew for each text of so many tokens."""
    return (np.arange(sizes.sum(), dtype=np.int64) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)


@dataclass
class Counts:
    """What the tasks need to know of the training words, bounded by SYMBOLS and LOCAL."""

    frequent: dict[bytes, tuple[int, int]]  # word: symbol, count; the end is one
    bounds: list[bytes]  # reversed spelling of the first word of each group but the first
    tokens: int
    distinct: int
    bin_tokens: np.ndarray
    bin_words: np.ndarray
    cut: int = 0
    hashes: np.ndarray | None = None
    numbers: np.ndarray | None = None

    @classmethod
    def over(cls, top: list[tuple[bytes, int]], ends: int, tokens: int, distinct: int) -> Counts:
        known = dict(sorted([*top, (END_WORD, ends)], key=lambda x: x[0][::-1]))
        frequent = {w: (i // FREQUENT * MEMBERS + i % FREQUENT, n) for i, (w, n) in enumerate(known.items())}
        bounds = [w[::-1] for i, w in enumerate(known) if i and i % FREQUENT == 0]
        return cls(frequent, bounds, tokens, distinct, np.zeros(SYMBOLS), np.zeros(SYMBOLS))

    @property
    def end(self) -> int:
        return self.frequent[END_WORD][0]

    def bin_of(self, word: bytes) -> int:
        return int(self.bins_of([word])[0])

    def bins_of(self, words: list[bytes]) -> np.ndarray:
        groups = np.array([bisect_right(self.bounds, w[::-1]) for w in words], np.int64)
        return groups * MEMBERS + FREQUENT + np.array([zlib.crc32(w[:3]) for w in words], np.int64) % BINS

    def base_norm(self) -> float:
        return math.log10(self.tokens + SMOOTH * (self.distinct + 1))

    def inner_norm(self, symbols: np.ndarray) -> np.ndarray:
        return np.log10(self.bin_tokens[symbols] + SMOOTH * (self.bin_words[symbols] + 1))

    def unigram(self) -> np.ndarray:
        mass = np.zeros(SYMBOLS)
        for s, n in self.frequent.values():
            mass[s] = n + SMOOTH
        bins = np.arange(SYMBOLS) % MEMBERS >= FREQUENT
        mass[bins] = (self.bin_tokens + SMOOTH * (self.bin_words + 1))[bins]
        return mass / mass.sum()


def word_counts(training: DataFrame) -> DataFrame:
    """(word, n) of all training texts; the words are bytes."""
    bounded_batches(training.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in texts(batch):
                held.update(words(text))
                if len(held) > REMEMBERED:
                    yield out()
                    held.clear()
        yield out()

    return training.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def count(training: DataFrame, limit: int = LOCAL) -> tuple[Counts, DataFrame]:
    """Counts of the training texts, and the rarer words (word, n) that tasks do not hold."""
    spark = training.sparkSession
    vocabulary = written(word_counts(training))
    ends = training.count()
    totals = vocabulary.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    top = vocabulary.orderBy(F.desc("n"), "word").limit(GROUPS * FREQUENT - 1).collect()
    counts = Counts.over([(bytes(r.word), r.n) for r in top], ends, totals[1] + ends, totals[0] + int(ends > 0))
    place = spark.sparkContext.broadcast(counts)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, tokens, distinct = place.value, np.zeros(SYMBOLS), np.zeros(SYMBOLS, np.int64)
        for batch in batches:
            found = batch.column("word").to_pylist()
            other = np.array([w not in c.frequent for w in found], bool)
            s = c.bins_of(found)[other]
            tokens += np.bincount(s, batch.column("n").to_numpy()[other], SYMBOLS)
            distinct += np.bincount(s, minlength=SYMBOLS)
        at = np.flatnonzero(distinct)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(tokens[at].astype(np.int64)), pa.array(distinct[at])], names=["symbol", "n", "w"])

    for r in vocabulary.mapInArrow(add_up, "symbol int, n long, w long").groupBy("symbol").agg(F.sum("n").alias("n"), F.sum("w").alias("w")).collect():
        counts.bin_tokens[r.symbol], counts.bin_words[r.symbol] = r.n, r.w

    # the largest counts whose words are at most ``limit``: by exact count below 64, then by eighths of a power of two
    step = F.when(F.col("n") < 64, F.col("n")).otherwise(16 + F.floor(F.log2("n") * 8)).cast("int")
    steps = vocabulary.groupBy(step.alias("step")).agg(F.min("n").alias("n"), F.count("*").alias("w")).orderBy(F.desc("step")).collect()
    held, counts.cut = 0, (steps[0].n if steps else 0) + 2**62
    for r in steps:
        if held + r.w > limit:
            break
        held, counts.cut = held + r.w, r.n

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = [xxhash.xxh3_64_intdigest(w) for w in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(h, np.uint64).view(np.int64)), batch.column("n")], names=["h", "n"])

    found = vocabulary.where(F.col("n") >= counts.cut).mapInArrow(digest, "h long, n long").toArrow()  # at most ``limit`` rows
    hashes, numbers = found.column("h").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(hashes)
    hashes, numbers = hashes[order], numbers[order]
    if (hashes[1:] == hashes[:-1]).any():  # two words of one hash: all counts by join
        hashes, numbers, counts.cut = hashes[:0], numbers[:0], 2**62
    counts.hashes, counts.numbers = hashes, numbers
    return counts, vocabulary.where(F.col("n") < counts.cut)


class _Slots(dict):
    """Places of words; a word that is asked for the first time takes the next."""

    def __missing__(self, word: bytes) -> int:
        self[word] = slot = len(self)
        return slot


class _Lookup:
    """What is known of each word, with a bounded memory of recent ones, by their slots:
    symbol, known, base, inner, by join (the count is not here; base and inner then lack
    log10(count + SMOOTH))."""

    def __init__(self, counts: Counts):
        self.counts = counts
        self.forget()

    def forget(self) -> None:
        c = self.counts
        self.slot = _Slots(zip(c.frequent, range(len(c.frequent))))
        n = np.array([n for _, n in c.frequent.values()], float)
        kinds = ((np.int16, [s for s, _ in c.frequent.values()]), (bool, n > 0), (float, np.log10(n + SMOOTH) - c.base_norm()), (float, np.zeros(len(n))), (bool, np.zeros(len(n))))
        self.columns = [np.zeros(2 * REMEMBERED, kind) for kind, _ in kinds]
        for column, (_, first) in zip(self.columns, kinds):
            column[: len(n)] = first

    def slots(self, tokens: list[bytes]) -> np.ndarray:
        if len(self.slot) > REMEMBERED:
            self.forget()
        first = len(self.slot)
        slots = np.fromiter(map(self.slot.__getitem__, tokens), np.int64, len(tokens))
        last = len(self.slot)
        if last > first:
            if last > len(self.columns[0]):
                self.columns = [np.concatenate((x, np.zeros(last, x.dtype))) for x in self.columns]
            new = list(islice(reversed(self.slot), last - first))[::-1]
            c = self.counts
            symbols = c.bins_of(new)
            n, here = np.zeros(len(new)), np.zeros(len(new), bool)
            if len(c.hashes):
                h = np.array(list(map(xxhash.xxh3_64_intdigest, new)), np.uint64)
                at = np.minimum(np.searchsorted(c.hashes, h), len(c.hashes) - 1)
                here = c.hashes[at] == h
                n = np.where(here, c.numbers[at], 0)
            share = np.where(here, np.log10(n + SMOOTH), 0.0)
            for column, x in zip(self.columns, (symbols, here, share - c.base_norm(), share - c.inner_norm(symbols), ~here)):
                column[first:last] = x
        return slots


_held: dict[str, _Lookup] = {}


def encode(docs: DataFrame, counts: Counts, keep: tuple[str, ...]) -> tuple[DataFrame, list[str]]:
    """A written table: the kept columns and those whose names come second: a row number,
    a hash of the row, symbols, n_tokens, known, base, inner, and the words to be joined."""
    spark = docs.sparkSession
    bounded_batches(spark)
    number, mark, *rest = names = fresh(docs.select(*keep), "_row", "_hash", "_symbols", "_tokens", "_known", "_base", "_inner", "_rare")
    sent = spark.sparkContext.broadcast(counts)
    key = str(np.random.default_rng().integers(1 << 62))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _held:
            _held.clear()
            _held[key] = _Lookup(sent.value)
        lookup = _held[key]
        for batch in batches:
            tokens, lengths = [], []
            for t in texts(batch):
                found = words(t)
                tokens += found
                tokens.append(END_WORD)
                lengths.append(len(found) + 1)
            slots = lookup.slots(tokens)
            symbols, known, base, inner, joined = (x[slots] for x in lookup.columns)
            sizes = np.array(lengths, np.int64)
            starts = np.cumsum(sizes) - sizes
            total = lambda x: np.add.reduceat(x, starts) if len(starts) else x[:0]
            rare = np.flatnonzero(joined)
            owner = np.searchsorted(starts, rare, side="right") - 1
            _, first, times = np.unique(owner << 32 | slots[rare], return_index=True, return_counts=True)  # texts in order
            offsets = np.concatenate(([0], np.cumsum(np.bincount(owner[first], minlength=len(sizes)))))
            pairs = pa.StructArray.from_arrays([pa.array(list(map(tokens.__getitem__, rare[first].tolist())), pa.binary()), pa.array(times)], names=["word", "times"])
            arrays = [
                *(batch.column(k) for k in (*keep, mark)), pa.array([symbols[a : a + n].tobytes() for a, n in zip(starts.tolist(), lengths)], pa.binary()), pa.array(sizes), pa.array(total(known.astype(np.int64))),
                pa.array(total(base)), pa.array(total(inner)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, mark, *rest])

    kept = "".join(f"`{k}` {docs.schema[k].dataType.simpleString()}, " for k in keep)
    schema = f"{kept}{mark} long, " + ", ".join(f"{c} {t}" for c, t in zip(rest, ("binary", "long", "long", "double", "double", "array<struct<word:binary,times:long>>")))
    own = docs.select(*keep, F.xxhash64(*keep, "text").alias(mark), *(["text"] if "text" not in keep else []))
    return written(own.mapInArrow(run, schema).withColumn(number, F.monotonically_increasing_id())), names


def train(encoded: DataFrame, symbols: str, mark: str, counts: Counts, shard_tokens: int = SHARD_TOKENS) -> Network:
    """Rounds of noise-contrastive passes over shards of the encoded training documents."""
    spark = encoded.sparkSession
    network = Network(counts.unigram())
    shards = max(1, math.ceil(counts.tokens / shard_tokens))
    dealt = encoded.select(F.pmod(F.col(mark), F.lit(shards)).alias("shard"), F.col(mark).alias("mark"), F.col(symbols).alias("symbols")).repartition(shards, "shard")
    size = len(network.flat())
    columns = [f"c{i}" for i in range(ROW)]
    for turn in range(ROUNDS):
        sent = spark.sparkContext.broadcast((network, counts.end))

        def run(key: tuple, rows: pa.Table) -> pa.Table:
            network, end = sent.value
            own = Network.__new__(Network)
            own.__dict__.update({k: v.copy() for k, v in network.__dict__.items()})
            parts = [np.frombuffer(b, np.int16) for b in rows.sort_by("mark").column("symbols").to_pylist()]
            symbols, place = np.concatenate(parts), places(np.array([len(p) for p in parts]))
            rng = np.random.default_rng((SEED, key[0].as_py()))
            part = np.array_split(rng.permutation(len(symbols)), ROUNDS)[turn]
            squares = [np.zeros_like(p) for p in own.parts()]
            for a in range(0, len(part), CHUNK):
                at = part[a : a + CHUNK]
                own.learn(contexts(symbols, place, at, end), symbols[at].astype(np.int64), rng, squares)
            flat = np.zeros(-(-size // ROW) * ROW)
            flat[:size] = own.flat()
            table = (flat * len(part)).reshape(-1, ROW)
            arrays = [pa.array(np.arange(len(table), dtype=np.int32)), pa.array(np.full(len(table), len(part), np.int64)), *(pa.array(np.ascontiguousarray(c)) for c in table.T)]
            return pa.Table.from_arrays(arrays, names=["at", "weight", *columns])

        mean = dealt.groupBy("shard").applyInArrow(run, "at int, weight long, " + ", ".join(f"{c} double" for c in columns))
        mean = mean.groupBy("at").agg(F.sum("weight").alias("weight"), *[F.sum(c).alias(c) for c in columns]).toPandas()
        if len(mean) and (mean["weight"] > 0).all():
            mean = mean.sort_values("at")
            network.load((mean[columns].to_numpy() / mean[["weight"]].to_numpy()).ravel()[:size])
    return network


def rate(encoded: DataFrame, names: list[str], counts: Counts, network: Network, rare: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """Per encoded row: the kept columns, n_tokens, n_known, base_score, score."""
    bounded_batches(encoded.sparkSession)
    number, _, symbols, *sized, words_ = names
    value_, row_, known_, share_ = fresh(encoded, "_value", "_of", "_more", "_share")
    sent = encoded.sparkSession.sparkContext.broadcast((network, counts.end))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network, end = sent.value
        for batch in batches:
            parts = [np.frombuffer(b, np.int16) for b in batch.column(symbols).to_pylist()]
            found = np.concatenate(parts) if parts else np.zeros(0, np.int16)
            sizes = np.array([len(p) for p in parts], np.int64)
            place = places(sizes)
            value = np.empty(len(found))
            for a in range(0, len(found), SCORED):
                at = np.arange(a, min(a + SCORED, len(found)))
                value[at] = network.log10(contexts(found, place, at, end), found[at].astype(np.int64))
            total = np.add.reduceat(value, np.cumsum(sizes) - sizes) if parts else value
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*keep, number, *sized)), pa.array(total)], names=[*keep, number, *sized, value_])

    kept = "".join(f"`{k}` {encoded.schema[k].dataType.simpleString()}, " for k in keep)
    scored = encoded.select(*keep, number, *sized, symbols).mapInArrow(run, f"{kept}{number} long, {sized[0]} long, {sized[1]} long, {sized[2]} double, {sized[3]} double, {value_} double")
    each = encoded.select(F.col(number).alias(row_), F.explode(words_).alias("x")).select(row_, "x.word", "x.times")
    met = each.join(rare, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    met = met.groupBy(row_).agg(F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias(known_), F.sum(F.col("times") * F.log10(F.col("n") + SMOOTH)).alias(share_))
    share, known = F.coalesce(share_, F.lit(0.0)), F.coalesce(known_, F.lit(0))
    joined = scored.join(met, scored[number] == met[row_], "left")
    return joined.select(*keep, F.col(sized[0]).alias("n_tokens"), (F.col(sized[1]) + known).alias("n_known"), (F.col(sized[2]) + share).alias("base_score"), (F.col(value_) + F.col(sized[3]) + share).alias("score"))


@dataclass
class Model:
    counts: Counts
    network: Network
    rare: DataFrame


def fit(training: DataFrame, limit: int = LOCAL) -> Model:
    """training: doc_id, text."""
    counts, rare = count(training, limit)
    encoded, names = encode(training, counts, ("doc_id",))
    return Model(counts, train(encoded, names[2], names[1], counts), rare)


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row: the kept columns, n_tokens, n_known, base_score, score."""
    encoded, names = encode(docs, model.counts, keep)
    return rate(encoded, names, model.counts, model.network, model.rare, keep)


def held_out_scores(docs: DataFrame, limit: int = LOCAL) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. Texts are
    encoded once, for training and for scoring."""
    marked = docs.select("doc_id", (crc_mod("doc_id", 10) == 0).alias("held_out"), "text")
    counts, rare = count(marked.where("NOT held_out"), limit)
    encoded, names = encode(marked, counts, ("doc_id", "held_out"))
    network = train(encoded.where("NOT held_out"), names[2], names[1], counts)
    scored = rate(encoded, names, counts, network, rare, ("doc_id", "held_out"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(counts.tokens).cast("long").alias("train_tokens"), "base_score", "score")
