"""Language ID by cross-parsing entropy over suffix automata.

Labelled text of each language builds a suffix automaton. A text is parsed against each
language from left to right into the longest phrases that occur in that language's
text; n phrases against a training text of N characters cost n * log2(N) bits, and the
language with the fewest bits a character wins (ties: the smaller name). The score is
the winner's share of exp(-bits) over all languages, with bits capped to stay finite.

Only letters matter: upper case folds to lower, runs of other characters count as one
blank. Texts are parsed whole, in lanes of LANE characters side by side (a phrase ends
with its lane), with the automata as one transition table in numpy; every character of
the training texts counts, those beyond the ALPHABET most frequent ones by sorted
transitions. A training text under LEAST_CHARS costs as one of that length.

Training takes at most SAMPLE_DOCS labelled texts of each language in the order of their
hash, those of MIN_CHARS to MAX_CHARS first, then short ones (up to SHORT_DOCS texts
while there are under LEAST_CHARS) and the first MAX_CHARS of long ones; and at most
TRAIN_CHARS folded characters in all languages together, so that the table stays bounded;
equal texts count once.

Cases: null texts and texts without a letter get ``und`` and score 0, as does any text
where no label is known; null langs never train; repeated rows return repeated rows;
null doc_ids count as the empty text for the split; an empty table returns no rows;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.common import crc_mod, scan

SAMPLE_DOCS = 64
MIN_CHARS, MAX_CHARS = 200, 8000
TRAIN_CHARS = 120_000
LANE = 512
UND = "und"
BATCH_CHARS = 1 << 20
#: Characters with a column of their own in the table; rarer ones have sorted transitions.
ALPHABET = 96
#: Texts of a language whose texts are short, and the training length below which a phrase costs no less.
SHORT_DOCS = 640
#: Parts of a language that are ranked side by side before their first ones meet.
PARTS = 16
LEAST_CHARS = SAMPLE_DOCS * MIN_CHARS
#: Folded code point of every character: itself in lower case if a letter, else a blank.
_FOLD: np.ndarray | None = None


def fold(text: str) -> np.ndarray:
    """Code points of the folded text, runs of non-letters as one blank; empty without letters."""
    global _FOLD
    if _FOLD is None:
        table = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            if (ch := chr(c)).isalpha():
                low = ch.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _FOLD = table
    x = _FOLD[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    if not (x != 32).any():
        return x[:0]
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != 32) | (x[:-1] != 32)
    return x[keep]


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of each state; state 0 is the root."""
    step, link, length, last = [{}], [-1], [0], 0
    for c in text:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step


class Languages:
    """Automata of all languages in one table; entry = 2 * next row + (a phrase began)."""

    def __init__(self, train: dict[str, list[str]], limit: int = TRAIN_CHARS):
        self.names = sorted(train)
        share = limit // max(1, len(self.names))
        corpora = []
        for name in self.names:
            parts, used = [], 0
            for t in train[name]:
                f = fold(t)
                if used and used + len(f) > share:
                    continue  # the next text that fits
                parts.append(np.concatenate((f, [10])))
                used += len(f) + 1
            corpora.append(np.concatenate(parts)[: max(share, 1)] if parts else np.zeros(0, np.uint32))
        seen, times = np.unique(np.concatenate(corpora) if corpora else np.zeros(0, np.uint32), return_counts=True)
        alphabet = seen[np.lexsort((seen, -times))]
        alphabet = alphabet[alphabet != 10]
        # class 0: in no training text; 1: ends of training texts, in no parsed text
        self.width = min(len(alphabet) + 2, ALPHABET)
        self.classes = np.zeros(0x110000, np.int32)
        self.classes[alphabet] = np.arange(2, len(alphabet) + 2)
        self.span = len(alphabet) + 2
        rare: dict[int, int] = {}
        tables, self.roots, at = [], [], 0
        self.bits = np.array([np.log2(max(LEAST_CHARS, len(c))) for c in corpora])
        for c in corpora:
            codes = np.where(c == 10, 1, self.classes[c])
            states = suffix_automaton(codes.tolist())
            table = np.full((len(states), self.width), -1, np.int32)
            for s, out in enumerate(states):
                for k, t in out.items():
                    if k >= self.width:
                        rare[(s + at) * self.width * self.span + k] = 2 * (t + at) * self.width + (s == 0)
                    elif k > 1:
                        table[s, k] = t
            first = np.where(table[0] >= 0, table[0], 0)
            entry = np.where(table >= 0, 2 * (table + at) * self.width, 2 * (first + at) * self.width + 1)
            entry[0] = 2 * (first + at) * self.width + 1  # from the root every character begins a phrase
            self.roots.append(at * self.width)
            tables.append(entry)
            at += len(states)
        keys = np.fromiter(rare, np.int64, len(rare))
        order = np.argsort(keys)
        self.keys, self.entries = keys[order], np.fromiter(rare.values(), np.int32, len(rare))[order]
        self.table = np.concatenate(tables).astype(np.int32).ravel() if tables else np.zeros(0, np.int32)

    def _rare(self, state: np.ndarray, classes: np.ndarray, root: int) -> np.ndarray:
        """Entries for classes without a column: on from the state, else anew from the root."""
        out = np.full(len(classes), 2 * root + 1, np.int32)
        for start in (np.full(len(classes), root, np.int64), state.astype(np.int64)):
            key = start * self.span + classes
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            out = np.where(self.keys[at] == key, self.entries[at], out)
        return out

    def phrases(self, folded: list[np.ndarray]) -> np.ndarray:
        """Phrase counts, one row a text and one column a language."""
        out = np.zeros((len(folded), len(self.names)), np.int64)
        lanes, owner = [], []
        for i, f in enumerate(folded):
            for s in range(0, len(f), LANE):
                lanes.append(f[s : s + LANE])
                owner.append(i)
        if not lanes:
            return out
        size = np.array([len(x) for x in lanes])
        order = np.argsort(-size, kind="stable")
        grid = np.zeros((LANE, len(lanes)), np.int32)
        for j, o in enumerate(order.tolist()):
            grid[: size[o], j] = self.classes[lanes[o]]
        beyond = [np.flatnonzero(g >= self.width) for g in grid]
        unknown = [g[b] for g, b in zip(grid, beyond)]
        grid[grid >= self.width] = 0
        active = np.searchsorted(-size[order], -np.arange(LANE), side="left")  # lanes longer than t
        owners = np.array(owner)[order]
        for k, root in enumerate(self.roots):
            state = np.full(len(lanes), root, np.int32)
            count = np.zeros(len(lanes), np.int32)
            for t in range(LANE):
                n = active[t]
                if not n:
                    break
                v = self.table[state[:n] + grid[t, :n]]
                if len(beyond[t]):
                    v[beyond[t]] = self._rare(state[beyond[t]], unknown[t], root)
                count[:n] += v & 1
                state[:n] = v >> 1
            np.add.at(out[:, k], owners, count)
        return out

    def predict(self, batch: list[str | None]) -> list[tuple[str, float]]:
        result: list[tuple[str, float]] = [(UND, 0.0)] * len(batch)
        if not self.names:
            return result
        folded = [fold(t) if t else np.zeros(0, np.uint32) for t in batch]
        at = [i for i, f in enumerate(folded) if len(f)]
        bits = self.phrases([folded[i] for i in at]) * self.bits
        best = bits.argmin(axis=1)
        weight = np.exp(-np.minimum(bits - bits.min(axis=1, keepdims=True), 700.0)) if at else bits
        for i, b, w in zip(at, best.tolist(), weight):
            result[i] = (self.names[b], float(w[b] / w.sum()))
        return result


_built: dict[int, Languages] = {}


def _languages(train: dict[str, list[str]]) -> Languages:
    """Built once in a worker process; what is sent is the bounded training text."""
    key = hash(tuple((k, *v) for k, v in sorted(train.items())))
    if key not in _built:
        _built.clear()
        _built[key] = Languages(train)
    return _built[key]


def training_texts(labelled: DataFrame, sample: int = SAMPLE_DOCS) -> dict[str, list[str]]:
    """Per language, at most ``sample`` texts in hash order. Only hashes and lengths are
    ranked (one row a distinct text), first within parts of a language, then the first
    ones of all its parts, so that no task ranks a language; the texts of the few that are
    left are read in a second pass."""
    size = F.char_length("text")
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", F.when(size > MAX_CHARS, F.left("text", F.lit(MAX_CHARS))).otherwise(F.col("text")).alias("text"), (~size.between(MIN_CHARS, MAX_CHARS)).alias("odd"), (size < MIN_CHARS).alias("short"))
    hashed = rows.select("lang", F.xxhash64("text").alias("h"), "odd", "short").groupBy("lang", "h").agg(F.min("odd").alias("odd"), F.min("short").alias("short"))
    best = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("h"))
    most = F.when(~F.col("odd"), F.lit(sample)).when(F.col("short"), F.lit(SHORT_DOCS)).otherwise(F.lit(sample))
    parts = hashed.withColumn("part", F.pmod("h", F.lit(PARTS)))
    first = parts.withColumn("place", best("lang", "part", "odd", "short")).where(F.col("place") <= most)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("odd", "h"))
    top = first.withColumn("rank", rank).where(F.col("rank") <= max(sample, SHORT_DOCS)).where((F.col("rank") <= sample) | F.col("short")).select("lang", "h", "rank")
    picked = rows.withColumn("h", F.xxhash64("text")).join(F.broadcast(top), ["lang", "h"]).groupBy("lang", "rank").agg(F.min("text").alias("text"))
    train: dict[str, list[str]] = {}
    for r in sorted(picked.collect(), key=lambda r: (r.lang, r.rank)):
        held = train.setdefault(r.lang, [])
        if len(held) < sample or sum(map(len, held)) < LEAST_CHARS:
            held.append(r.text)
    return train


def identify(docs: DataFrame, train: dict[str, list[str]], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row of docs: the kept columns, lang_pred, score, from the text alone."""
    sent = docs.sparkSession.sparkContext.broadcast(train)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        held = _languages(sent.value)
        whole = batch.column("text").to_pylist()
        found, part, chars = [], [], 0
        for t in whole:
            part.append(t)
            chars += len(t or "")
            if chars >= BATCH_CHARS:
                found += held.predict(part)
                part, chars = [], 0
        found += held.predict(part)
        arrays = [*(batch.column(k) for k in keep), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
        return pa.RecordBatch.from_arrays(arrays, names=[*keep, "lang_pred", "score"])

    kept = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    return scan(docs, run, f"{kept}, lang_pred string, score double", *dict.fromkeys((*keep, "text")))


def held_out_predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; trained on documents that are not held out."""
    held_out = crc_mod("doc_id", 3) == 1
    train = training_texts(docs.where(~held_out).select("lang", "text"))
    return identify(docs, train).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
