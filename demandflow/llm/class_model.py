"""Score texts with a Brown class-based bigram model.

The `clustered` most frequent words are put into classes by the exchange algorithm: each word moves to
the class that raises the likelihood of the class bigrams most. Sweeps run on Spark: words are dealt
out, each task moves its words against the classes of the sweep before, and the table of classes (one
number a clustered word) is renewed between sweeps. The further words that tasks are sent then join the class
that raises the likelihood most, against these classes, in one pass over the texts, which are read as numbers
once the words that tasks are sent are known. Words too rare to be
sent belong to classes by their last letters, which a task can tell without a lookup; so does a sent word that
no class gains from. The end of a text is a class of its own.

P(text) is the product of P(class | class before) and P(word | class), both smoothed; a word not seen in
training shares one place of its class with all such words.

The vocabulary grows with the corpus, so only a bounded number of frequent words is sent to the tasks;
the counts of all others reach the texts by a shuffle join.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandflow.llm.common import binary_texts, slices
from demandflow.session import checkpoint, cut_lineage


@dataclass(frozen=True)
class ClassParams:
    clustered: int = 2_000  # most frequent words that are clustered
    classes: int = 48  # classes of clustered words
    spellings: int = 64  # classes of other words, by their last two letters
    sweeps: int = 5
    parts: int = 12  # tasks a sweep's words are dealt out to
    moved_share: float = 0.5  # of a task's words that may move in one sweep, so that the parts do not all move at once
    sent_words: int = 200_000  # most frequent words whose counts and classes are sent to all tasks
    placed: bool = True  # sent words that are not clustered join the class of greatest gain, else that of their last letters
    transition_weight: float = 20.0  # times a class's own share counts in what follows a class
    emission_add: float = 1.0


PIECE = 1_000  # pairs of units in a row of coded text


def words_of(raw: bytes) -> list[bytes]:
    return raw.lower().split()


def spelling(word: bytes, p: ClassParams) -> int:
    """Class among `spellings` of a word that is not clustered."""
    return zlib.crc32(word[-2:]) % p.spellings


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over all texts; each task sums up before the shuffle, within bounded memory. The end is not in it."""

    def run(batches):
        counts: Counter = Counter()
        for batch in slices(batches, "text"):
            for raw in binary_texts(batch.column("text")).to_pylist():
                counts.update(words_of(raw))
            if len(counts) > 400_000:
                yield flushed(counts)
                counts = Counter()
        yield flushed(counts)

    def flushed(counts):
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], ["word", "c"])

    return texts.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def coded(texts: DataFrame, sent: dict[bytes, int], p: ClassParams) -> DataFrame:
    """(units): the texts as int32 numbers in rows of `PIECE` pairs, so that later passes read no words.

    Units: sent words, then spelling classes, then the end. A task's texts follow one another with an end between
    them; a row begins with the last unit of the row before, so every pair of neighbours is in one row.
    """
    shared = texts.sparkSession.sparkContext.broadcast(sent)
    base = len(sent)
    end = np.array([base + p.spellings], np.int32)

    def run(batches):
        of = _Units(shared.value, base, p)
        for batch in slices(batches, "text"):
            parts = [end]
            for raw in binary_texts(batch.column("text")).to_pylist():
                words = words_of(raw)
                parts += [np.fromiter(map(of.__getitem__, words), np.int32, len(words)), end]
            u = np.concatenate(parts)
            yield pa.RecordBatch.from_arrays([pa.array([u[i : i + PIECE + 1].tobytes() for i in range(0, len(u) - 1, PIECE)], pa.binary())], ["units"])

    return texts.mapInArrow(run, "units binary")


def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(units, units that follow them) of rows of `coded`."""
    for batch in slices(batches, "units"):
        flat = np.frombuffer(b"".join(batch.column("units").to_pylist()), np.int32)
        ends = np.cumsum(pc.binary_length(batch.column("units")).to_numpy(zero_copy_only=False)) // 4
        inside = np.ones(len(flat) - 1, bool)
        inside[ends[:-1] - 1] = False
        yield flat[:-1][inside], flat[1:][inside]


def _pairs(pieces: DataFrame, top: list[bytes], clustered: int, p: ClassParams) -> DataFrame:
    """(a, b, n): how often unit b follows unit a. Units: clustered words, then spelling classes, then the end."""
    units = clustered + p.spellings + 1
    spelled = [clustered + spelling(w, p) for w in top[clustered:]]
    of_unit = pieces.sparkSession.sparkContext.broadcast(np.concatenate([np.arange(clustered), spelled, np.arange(clustered, units)]).astype(np.int64))

    def run(batches):
        held: list[np.ndarray] = []
        size = 0
        for a, b in neighbours(batches):
            held.append(of_unit.value[a] * units + of_unit.value[b])
            size += len(a)
            if size > 4_000_000:
                yield summed(held)
                held, size = [], 0
        if held:
            yield summed(held)

    def summed(held):
        code, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(code // units, pa.int32()), pa.array(code % units, pa.int32()), pa.array(n, pa.int64())], ["a", "b", "n"])

    return pieces.mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


class _Units(dict):
    """Unit of a word; what is not sent is remembered up to a number."""

    def __init__(self, sent: dict[bytes, int], base: int, p: ClassParams):
        super().__init__(sent)
        self.base, self.p = base, p

    def __missing__(self, word: bytes) -> int:
        unit = self.base + spelling(word, self.p)
        if len(self) < self.base + 200_000:
            self[word] = unit
        return unit


def moved(words: list[int], follows: dict[int, tuple[np.ndarray, np.ndarray]], precedes: dict[int, tuple[np.ndarray, np.ndarray]], classes: np.ndarray, table: np.ndarray, k: int, most: int) -> list[tuple[int, int]]:
    """(word, new class) for up to `most` words that gain most by moving, against fixed classes of the others.

    The likelihood of class bigrams is sum f(N(c, d)) - sum f(N(c, .)) - sum f(N(., d)) with f(x) = x log x.
    `table` is N; moving a word takes its pairs out of its class's row and column and puts them in another's.
    """
    f = lambda x: x * np.log(np.maximum(x, 1))
    row, column = table.sum(axis=1), table.sum(axis=0)
    moves = []
    for w in words:
        none = (np.zeros(0, np.int64), np.zeros(0))
        (to, n_to), (by, n_by) = follows.get(w, none), precedes.get(w, none)
        own = n_to[to == w].sum()  # pairs of the word with itself
        out = np.bincount(classes[to[to != w]], n_to[to != w], len(table))
        into = np.bincount(classes[by[by != w]], n_by[by != w], len(table))
        here = classes[w]
        # The table without the word.
        t = table.copy()
        t[here] -= out
        t[:, here] -= into
        t[here, here] -= own
        r, c = row.copy(), column.copy()
        r[here] -= out.sum() + own
        c[here] -= into.sum() + own
        c -= out
        r -= into
        # The gain of each target class: changed cells, then changed sums. Other sums regain what they lost, alike for each.
        cells = (f(t[:k] + out) - f(t[:k])).sum(axis=1) + (f(t[:, :k] + into[:, None]) - f(t[:, :k])).sum(axis=0)
        d = np.arange(k)
        both = t[d, d]
        cells += f(both + out[:k] + into[:k] + own) - f(both + out[:k]) - f(both + into[:k]) + f(both)
        r2, c2 = r + into, c + out
        sums = f(r2[:k] + out.sum() + own) - f(r2[:k]) + f(c2[:k] + into.sum() + own) - f(c2[:k])
        gain = cells - sums
        best = int(gain.argmax())
        if gain[best] > gain[here] + 1e-6:
            moves.append((gain[best] - gain[here], w, best))
    moves.sort(key=lambda m: (-m[0], m[1]))
    return [(w, c) for _, w, c in moves[:most]]


def class_table(pairs: np.ndarray, classes: np.ndarray, size: int) -> np.ndarray:
    """N(c, d) from rows (a, b, n)."""
    return np.bincount(classes[pairs[:, 0]] * size + classes[pairs[:, 1]], pairs[:, 2], size * size).reshape(size, size)


def likelihood(t: np.ndarray) -> float:
    """Of class bigrams, but for what no class changes."""
    f = lambda x: float((x * np.log(np.maximum(x, 1))).sum())
    return f(t) - f(t.sum(axis=0)) - f(t.sum(axis=1))


def exchange(pairs: DataFrame, clustered: int, p: ClassParams) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """(class of each unit, class bigram table, log-likelihood after each sweep).

    `pairs` has a row a pair of units. Each sweep is one Spark job over the pairs, grouped by word; a
    class a unit and the class table come to the driver, bounded by the parameters. A sweep's moves are
    taken only if they raise the likelihood together, else half of them, and so on.
    """
    spark = pairs.sparkSession
    units = clustered + p.spellings + 1
    k = min(p.classes, max(1, clustered))
    size = k + p.spellings + 1
    classes = np.concatenate([np.arange(clustered) % k, k + np.arange(p.spellings + 1)]).astype(np.int64)
    either = pairs.where(F.col("a") < clustered).select(F.col("a").alias("w"), F.lit(True).alias("follows"), F.col("b").alias("u"), "n").union(pairs.where(F.col("b") < clustered).select(F.col("b"), F.lit(False), F.col("a"), "n"))
    # A word has at most two rows a unit, so a part is bounded by the parameters whatever the corpus.
    dealt = checkpoint(either.repartition(p.parts, F.pmod("w", F.lit(p.parts))).sortWithinPartitions("w", "follows", "u"))

    def summed(at: np.ndarray) -> np.ndarray:
        """The class table, aggregated from the pairs on Spark."""
        names = spark.createDataFrame([(int(i), int(c)) for i, c in enumerate(at)], "u int, c int")
        table = np.zeros((size, size))
        rows = pairs.join(F.broadcast(names.toDF("a", "ca")), "a").join(F.broadcast(names.toDF("b", "cb")), "b").groupBy("ca", "cb").agg(F.sum("n")).collect()
        for a, b, n in rows:
            table[a, b] = n
        return table

    table = summed(classes)
    history = [likelihood(table)]
    for _ in range(p.sweeps if clustered > 1 else 0):
        now, state = spark.sparkContext.broadcast((classes, table)), (k, p.moved_share)

        def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, t = now.value  # noqa: B023
            follows, precedes = {}, {}
            rows = [np.column_stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("w", "follows", "u", "n")]) for b in batches]
            rows = np.concatenate(rows) if rows else np.zeros((0, 4), np.int64)
            for side, out in ((1, follows), (0, precedes)):
                own = rows[rows[:, 1] == side]
                words, first = np.unique(own[:, 0], return_index=True)
                for w, part in zip(words.tolist(), np.split(own, first[1:])):
                    out[w] = part[:, 2], part[:, 3].astype(float)
            words = sorted(set(follows) | set(precedes))
            new = moved(words, follows, precedes, at, t, state[0], math.ceil(len(words) * state[1]))  # noqa: B023
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in new], pa.int32()), pa.array([c for _, c in new], pa.int32())], ["w", "c"])

        moves = [(r.w, r.c) for r in dealt.mapInArrow(sweep, "w int, c int").collect()]
        moves.sort()
        while moves:
            new = classes.copy()
            new[[w for w, _ in moves]] = [c for _, c in moves]
            if likelihood(t := summed(new)) > history[-1]:
                classes, table = new, t
                break
            moves = moves[::2] if len(moves) > 1 else []
        history.append(likelihood(table))
        if not moves:
            break
    return classes, table, history


def gains(contexts: Iterator[np.ndarray], classes: np.ndarray, table: np.ndarray, k: int) -> Iterator[tuple[int, int]]:
    """(word, class) for words that raise the likelihood by leaving their class for one of the first k.

    Contexts are rows (word, code, n) in order of words: the class that follows, or `len(table)` and the class
    before. Every word is weighed against `table` as it is, so the order of words does not matter. The part of
    the likelihood that a word changes is in the cells of its contexts and in its class's two sums; what both sides
    of a word do to one cell is weighed a side at a time.
    """
    f = lambda x: x * np.log(np.maximum(x, 1))
    size = len(table)
    cells = np.concatenate([table.T, table])  # a row a code, a column a class
    known = f(cells)
    sums = table.sum(axis=1), table.sum(axis=0)

    def judged(words: np.ndarray, gain: np.ndarray, follows: np.ndarray, before: np.ndarray) -> Iterator[tuple[int, int]]:
        here = classes[words]
        join, leave = gain[:, :k].copy(), gain[:, k].copy()
        for total, n in zip(sums, (follows, before)):
            join -= f(total[:k] + n[:, None]) - f(total[:k])
            leave -= f(total[here]) - f(total[here] - n)
        best = join.argmax(axis=1)
        chosen = join[np.arange(len(words)), best] > leave + 1e-6
        yield from zip(words[chosen].tolist(), best[chosen].tolist())

    held = None  # figures of the last word so far, which may go on
    for rows in contexts:
        w, code, n = rows[:, 0], rows[:, 1], rows[:, 2].astype(float)
        words, first = np.unique(w, return_index=True)
        own = cells[code, classes[w]]
        change = np.column_stack([f(cells[code, :k] + n[:, None]) - known[code, :k], f(own) - f(own - n)])
        gain = np.add.reduceat(change, first)
        follows, before = (np.add.reduceat(np.where(side, n, 0.0), first) for side in (code < size, code >= size))
        if held is not None and held[0][0] == words[0]:
            gain[0] += held[1][0]
            follows[0] += held[2][0]
            before[0] += held[3][0]
        elif held is not None:
            yield from judged(*held)
        yield from judged(words[:-1], gain[:-1], follows[:-1], before[:-1])
        held = words[-1:], gain[-1:], follows[-1:], before[-1:]
    if held is not None:
        yield from judged(*held)


def place(pieces: DataFrame, clustered: int, classes: np.ndarray, table: np.ndarray, p: ClassParams) -> tuple[np.ndarray, np.ndarray]:
    """(class of each sent word, class bigram table) once the words after the first `clustered` have joined classes.

    `classes` are those so far of the sent words, by number. Two passes over the coded texts: one for what stands beside
    each such word, one for the new table. What reaches the driver is bounded by the parameters.
    """
    spark = pieces.sparkSession
    base, size = len(classes), len(table)
    k = size - p.spellings - 1
    rest = np.arange(k, size)  # classes by last letters, and the end
    state = spark.sparkContext.broadcast((classes, table))

    def contexts(batches):
        cls = np.concatenate([state.value[0], rest])
        held: list[np.ndarray] = []
        held_size = 0
        for a, b in neighbours(batches):
            left, right = (a >= clustered) & (a < base), (b >= clustered) & (b < base)
            held += [a[left] * np.int64(2 * size) + cls[b[left]], b[right] * np.int64(2 * size) + size + cls[a[right]]]
            held_size += len(held[-2]) + len(held[-1])
            if held_size > 4_000_000:
                yield summed(held)
                held, held_size = [], 0
        if held_size:
            yield summed(held)

    def summed(held):
        code, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(code // (2 * size), pa.int32()), pa.array(code % (2 * size), pa.int32()), pa.array(n, pa.int64())], ["w", "code", "n"])

    def judge(batches):
        rows = (np.column_stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("w", "code", "n")]) for b in batches if b.num_rows)
        new = list(gains(rows, *state.value, k))
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in new], pa.int32()), pa.array([c for _, c in new], pa.int32())], ["w", "c"])

    # Dealt by word before they are added up, so that the sum and the words' rows need one shuffle.
    beside = pieces.mapInArrow(contexts, "w int, code int, n long").repartition("w").groupBy("w", "code").agg(F.sum("n").alias("n"))
    moves = sorted((r.w, r.c) for r in beside.sortWithinPartitions("w").mapInArrow(judge, "w int, c int").collect())

    def renewed(of_sent: np.ndarray) -> np.ndarray:
        of_unit = spark.sparkContext.broadcast(np.concatenate([of_sent, rest]))

        def run(batches):
            total = np.zeros(size * size, np.int64)
            for a, b in neighbours(batches):
                total += np.bincount(of_unit.value[a] * size + of_unit.value[b], minlength=size * size)
            cells = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(total[cells], pa.int64())], ["cell", "n"])

        out = np.zeros(size * size)
        for cell, n in pieces.mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n")).collect():
            out[cell] = n
        return out.reshape(size, size)

    if not moves:
        return classes, table
    new = classes.copy()
    new[[w for w, _ in moves]] = [c for _, c in moves]
    return new, renewed(new)


@dataclass(frozen=True)
class ClassModel:
    """What the tasks need: frequent words with class and count, log10 tables, and what the rest needs of its classes."""

    sent: list[bytes]
    sent_classes: np.ndarray
    sent_counts: np.ndarray
    steps: np.ndarray  # log10 P(class | class before)
    tokens: int  # training tokens, ends among them
    vocabulary: int  # distinct training tokens
    class_tokens: np.ndarray
    class_words: np.ndarray
    params: ClassParams
    clustered_classes: int
    least_sent: int  # words that are not sent have at most this count

    @property
    def words(self) -> dict[bytes, tuple[int, int]]:
        """(class, count) of the words that are sent."""
        return dict(zip(self.sent, zip(self.sent_classes.tolist(), self.sent_counts.tolist())))

    def emission(self, c: float, cls: int) -> float:
        """log10 P(word | class) of a word seen c times; 0 for all unseen words of the class together."""
        add = self.params.emission_add
        return math.log10((c + add) / (self.class_tokens[cls] + add * (self.class_words[cls] + 1)))

    def base(self, c: float) -> float:
        return math.log10((c + 1) / (self.tokens + 1 * (self.vocabulary + 1)))


def train(texts: DataFrame, p: ClassParams = ClassParams()) -> tuple[ClassModel, DataFrame, list[float]]:
    """(model, counts of all words, likelihood by sweep) from rows with `text`; a null text is empty."""
    counts = cut_lineage(word_counts(texts))
    ends = texts.count()
    # The largest counts that at most `sent_words` words have; a count has one word at least, so as many counts will do.
    least_sent, number = 0, 0
    for r in counts.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c")).limit(p.sent_words + 1).collect():
        number += r.n
        if number > p.sent_words:
            least_sent = r.c
            break
    top = sorted(((bytes(r.word), r.c) for r in counts.where(F.col("c") > least_sent).collect()), key=lambda x: (-x[1], x[0]))
    clustered = min(p.clustered, len(top))
    pieces = cut_lineage(coded(texts, {word: i for i, (word, _) in enumerate(top)}, p))
    pairs = cut_lineage(_pairs(pieces, [word for word, _ in top], clustered, p))
    classes, table, history = exchange(pairs, clustered, p)
    k = min(p.classes, max(1, clustered))
    size = k + p.spellings + 1
    of_sent = np.array([classes[i] if i < clustered else k + spelling(word, p) for i, (word, _) in enumerate(top)], np.int64)
    if p.placed and len(top) > clustered:
        of_sent, table = place(pieces, clustered, of_sent, table, p)
        history.append(likelihood(table))
    # Tokens and distinct words by class: sent words from the list, others by their spelling.
    tokens, words = np.zeros(size), np.zeros(size)
    sent_counts = np.array([c for _, c in top], np.int64)
    np.add.at(tokens, of_sent, sent_counts)
    np.add.at(words, of_sent, 1)

    def spelled(batches):
        n, v = np.zeros(p.spellings), np.zeros(p.spellings)
        for b in batches:
            for word, c in zip(b.column("word").to_pylist(), b.column("c").to_pylist()):
                n[(at := spelling(word, p))] += c
                v[at] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(p.spellings), pa.int32()), pa.array(n.astype(np.int64), pa.int64()), pa.array(v.astype(np.int64), pa.int64())], ["cls", "n", "v"])

    rows = counts.where(F.col("c") <= F.lit(least_sent)).mapInArrow(spelled, "cls int, n long, v long").groupBy("cls").agg(F.sum("n"), F.sum("v")).collect()
    for cls, n, v in rows:
        tokens[k + cls] += n
        words[k + cls] += v
    tokens[-1], words[-1] = ends, 1 if ends else 0
    share = (tokens + 1) / (tokens.sum() + size)
    steps = np.log10((table + p.transition_weight * share) / (table.sum(axis=1, keepdims=True) + p.transition_weight))
    model = ClassModel([w for w, _ in top], of_sent, sent_counts, steps, int(tokens.sum()), int(words.sum()), tokens, words, p, k, least_sent)
    return model, counts, history


def score(docs: DataFrame, model: ClassModel, counts: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, n_known, base_score, score (log10 probabilities).

    Null and empty texts are their end alone. Rows are told apart by their place in the input, so repeated
    rows give repeated rows; an empty table gives none; other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[doc_id].dataType.simpleString()
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    # A row for each text's own figures, and one for each word of it whose count the task does not know. The former
    # carry a word that no text has (it begins with a space), a different one each, so that the join spreads them.
    schema = f"word binary, code long, row long, own struct<doc_id:{kind},n_tokens:bigint,n_known:bigint,base_score:double,score:double>"

    def run(batches):
        from pyspark import TaskContext

        m = shared.value
        p, k = m.params, m.clustered_classes
        end = len(m.steps) - 1
        known = {w: (cls, m.emission(c, cls), m.base(c)) for w, cls, c in zip(m.sent, m.sent_classes.tolist(), m.sent_counts.tolist())}
        n_end = int(m.class_tokens[-1])
        end_emission, end_base = m.emission(n_end, end), m.base(n_end)
        row = TaskContext.get().partitionId() << 40
        for batch in slices(batches, "text", 1_000_000):
            out: list[list] = [[], [], [], []]
            for name, raw in zip(batch.column("doc_id"), binary_texts(batch.column("text")).to_pylist()):
                tokens = words_of(raw)
                total, base, seen, cls_of, rest = end_emission, end_base, int(n_end > 0), {}, {}
                for word, tf in Counter(tokens).items():
                    if (x := known.get(word)) is None:
                        cls_of[word] = k + spelling(word, p)
                        rest[word] = tf
                    else:
                        cls_of[word] = x[0]
                        total += tf * x[1]
                        base += tf * x[2]
                        seen += tf
                at = np.array([end, *map(cls_of.__getitem__, tokens), end])
                total += float(m.steps[at[:-1], at[1:]].sum())
                own = {"doc_id": name.as_py(), "n_tokens": len(tokens) + 1, "n_known": seen, "base_score": base, "score": total}
                out[0] += [b" %d" % row, *rest]
                out[1] += [0, *(cls_of[w] << 40 | tf for w, tf in rest.items())]
                out[2] += [row] * (1 + len(rest))
                out[3] += [own] + [None] * len(rest)
                row += 1
            figures = pa.struct([("doc_id", batch.schema.field("doc_id").type), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
            kinds = [pa.binary(), pa.int64(), pa.int64(), figures]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], ["word", "code", "row", "own"])

    parts = d.mapInArrow(run, schema)
    add, k = model.params.emission_add, model.clustered_classes
    below = F.array(*[F.lit(float(model.class_tokens[i] + add * (model.class_words[i] + 1))) for i in range(len(model.steps))])
    c, tf = F.coalesce("c", F.lit(0)), F.expr("code & 1099511627775")
    base = float(model.tokens + 1 * (model.vocabulary + 1))
    joined = parts.join(counts.where(F.col("c") <= F.lit(model.least_sent)), "word", "left")

    def figure(name: str, of_word: Column) -> Column:
        return F.sum(F.when(F.col("own").isNull(), of_word).otherwise(F.col(f"own.{name}"))).alias(name)

    return joined.groupBy("row").agg(
        F.max("own.doc_id").alias("doc_id"),
        F.max("own.n_tokens").alias("n_tokens"),
        figure("n_known", F.when(c > 0, tf).otherwise(0)),
        figure("base_score", tf * F.log10((c + 1) / F.lit(base))),
        figure("score", tf * F.log10((c + add) / F.element_at(below, (F.shiftright("code", 40) + 1).cast("int")))),
    ).drop("row")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    model, counts, _ = train(docs.where(~held_out).select("text"))
    scored = score(docs, model, counts)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


QUERIES = {"op1_class_model": (query, None)}
