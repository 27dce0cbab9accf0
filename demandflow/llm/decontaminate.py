"""Find and remove benchmark passages in documents with a generalised suffix automaton.

The automaton holds the word sequences of all items. A document's words stream through it; the
longest matching length at each word tells which windows end there. Items are few against the
documents; they are cut into shards of bounded size, each becoming one automaton, and every
document passes each shard's. Automata are broadcast as many at a time as tasks may hold; what is
beyond follows in further passes over the documents, which carry their hits along.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from demandflow.llm.common import binary_texts, slices
from demandflow.session import cut_lineage

#: Window length in words, and the share of a document's words (one in twenty) that makes it contaminated.
WINDOW, SHARE = 13, 20
#: Bytes that are not part of a word become spaces, A-Z become a-z; all bytes over 0x7F stay.
FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else 0x20 if b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in range(256)
)


@dataclass(frozen=True)
class DecontaminateParams:
    window: int = WINDOW
    share: int = SHARE  # contaminated: hits are at least one word in `share`
    shard_bytes: int = 16_000_000  # item text in one automaton, about; a single longer item is held whole
    held_bytes: int = 64_000_000  # item text in all automata of one pass over the documents


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def _numbers(*first: int) -> Callable[[], array]:
    return lambda: array("i", first)


@dataclass
class Automaton:
    """Suffix automaton of several word sequences; `items` and `short` mark windows by state.

    Words are numbered. Nearly every state goes on with one word only, so a state is five numbers in
    arrays; only what else follows it is in a dict.
    """

    window: int
    ids: dict[bytes, int] = field(default_factory=dict)  # number of each word of the items
    length: array = field(default_factory=_numbers(0))
    link: array = field(default_factory=_numbers(-1))
    word: array = field(default_factory=_numbers(-1))  # a word that follows the state
    to: array = field(default_factory=_numbers(-1))  # the state this word leads to
    more: dict[int, dict[int, int]] = field(default_factory=dict)  # the same for other words
    full: array = field(default_factory=_numbers())  # the state up the links that holds the last `window` words
    items: dict[int, set[str]] = field(default_factory=dict)  # state of a full window: items that hold it
    short: dict[int, dict[int, set[str]]] = field(default_factory=dict)  # state: whole short items ending there
    ends: dict[int, int] = field(default_factory=dict)  # state: nearest state up the links with a short item

    def _step(self, state: int, word: int) -> int:
        """The state a word leads to, or -1."""
        if self.word[state] == word:
            return self.to[state]
        others = self.more.get(state)
        return -1 if others is None else others.get(word, -1)

    def _lead(self, state: int, word: int, to: int) -> None:
        if self.word[state] in (-1, word):
            self.word[state], self.to[state] = word, to
        else:
            self.more.setdefault(state, {})[word] = to

    def _state(self, length: int, link: int, word: int = -1, to: int = -1) -> int:
        for numbers, value in ((self.length, length), (self.link, link), (self.word, word), (self.to, to)):
            numbers.append(value)
        return len(self.length) - 1

    def _grow(self, last: int, word: int) -> int:
        """The state of `last`'s sequence with one more word; shared sequences share states."""
        known = self._step(last, word)
        if known != -1:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, word, known)
        new = self._state(self.length[last] + 1, 0)
        state = last
        while state != -1 and (known := self._step(state, word)) == -1:
            self._lead(state, word, new)
            state = self.link[state]
        if state != -1:
            self.link[new] = known if self.length[known] == self.length[state] + 1 else self._split(state, word, known)
        return new

    def _split(self, state: int, word: int, known: int) -> int:
        """Part the shorter sequences of `known` off, those that end in `state` plus the word."""
        part = self._state(self.length[state] + 1, self.link[known], self.word[known], self.to[known])
        if known in self.more:
            self.more[part] = dict(self.more[known])
        self.link[known] = part
        while state != -1 and self._step(state, word) == known:
            self._lead(state, word, part)
            state = self.link[state]
        return part

    @classmethod
    def of(cls, items: list[tuple[str, list[bytes]]], window: int) -> Automaton:
        a = cls(window)
        for _, words in items:
            last = 0
            for word in words:
                last = a._grow(last, a.ids.setdefault(word, len(a.ids)))
        by_length = sorted(range(len(a.length)), key=a.length.__getitem__)  # links lead to shorter sequences
        a.full = array("i", range(len(a.length)))
        for state in by_length[1:]:
            if a.length[a.link[state]] >= window:
                a.full[state] = a.full[a.link[state]]
        for item, words in items:
            state = 0
            for place, word in enumerate(words):  # an item's words are all in the automaton, from its start on
                state = a._step(state, a.ids[word])
                if place + 1 >= window:
                    a.items.setdefault(a.full[state], set()).add(item)
                    continue
                if place == len(words) - 1:
                    a.short.setdefault(state, {}).setdefault(len(words), set()).add(item)
        for state in by_length:
            up = state if state in a.short else a.ends.get(a.link[state], -1)
            if up != -1:
                a.ends[state] = up
        return a

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word ranges (merged, end exclusive) inside window occurrences, and the items hit."""
        spans: list[list[int]] = []
        found: set[str] = set()
        seen: set[int] = set()
        window, ends, any_short = self.window, self.ends, bool(self.ends)

        def mark(start: int, end: int) -> None:
            while spans and spans[-1][1] >= start:
                start = min(start, spans.pop()[0])
            spans.append([start, end])

        state = held = 0
        ids, length, link, follows, leads, step = self.ids, self.length, self.link, self.word, self.to, self._step
        for place, word in enumerate(words):
            number = ids.get(word)
            if number is None:
                state = held = 0
                continue
            if follows[state] == number:
                state = leads[state]
            else:
                while (to := step(state, number)) == -1:  # the start goes on with every word
                    state = link[state]
                    held = length[state]
                state = to
            held += 1
            if held >= window:
                mark(place + 1 - window, place + 1)
                if (full := self.full[state]) not in seen:
                    seen.add(full)
                    found |= self.items[full]
            if any_short and state in ends:
                up = ends[state]
                while up != -1:
                    for size, names in self.short[up].items():
                        if size <= held:
                            mark(place + 1 - size, place + 1)
                            found |= names
                    up = ends.get(link[up], -1)
        return [(a, b) for a, b in spans], found


HITS = pa.struct([("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("items", pa.list_(pa.string()))])
HITS_SCHEMA = "struct<spans:array<struct<start:int,end:int>>,items:array<string>>"


def _hits(ranges: list[list[tuple[int, int]]], names: list[set[str]]) -> pa.Array:
    return pa.array([{"spans": [{"start": a, "end": b} for a, b in r], "items": sorted(n)} for r, n in zip(ranges, names)], HITS)


def _searched(docs: DataFrame, text: str, items: DataFrame, item_id: str, item_text: str, p: DecontaminateParams, finish: Callable, schema) -> DataFrame:
    """What `finish` (batch, texts, their words, ranges hit, items hit) makes of each batch of documents.

    Items (id as string) go by a hash into shards; rows without id or words take no part. As many automata
    as `held_bytes` allow are searched in one pass. Only if there are more, documents are written with
    their hits so far and read again for the next pass.
    """
    spark = docs.sparkSession
    t = items.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null")
    total = t.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-int(total) // p.shard_bytes))
    together = max(1, p.held_bytes // p.shard_bytes)
    carried = "hits" + "_" * max(map(len, docs.columns))  # no column has this name

    def automaton(k: int) -> Automaton:
        rows = (t if n == 1 else t.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)).collect()
        return Automaton.of([(r.i, w) for r in sorted(rows) if (w := words_of(r.t.encode()))], p.window)

    for start in range(0, n, together):
        automata = [spark.sparkContext.broadcast(automaton(k)) for k in range(start, min(start + together, n))]
        first, last = start == 0, start + together >= n

        def run(batches, automata=automata, first=first, last=last):
            for batch in slices(batches, text):
                raws = binary_texts(batch.column(batch.schema.get_field_index(text))).to_pylist()
                words = [words_of(raw) for raw in raws]
                ranges, names = [[] for _ in words], [set() for _ in words]
                if not first:
                    before = batch.column(batch.num_columns - 1).to_pylist()
                    ranges = [[(s["start"], s["end"]) for s in x["spans"]] for x in before]
                    names = [set(x["items"]) for x in before]
                    batch = batch.select(range(batch.num_columns - 1))
                for a in automata:
                    for row, own in enumerate(words):
                        more, found = a.value.search(own)
                        ranges[row], names[row] = merged(ranges[row], more), names[row] | found
                yield finish(batch, raws, words, ranges, names) if last else batch.append_column(carried, _hits(ranges, names))

        if last:
            return docs.mapInArrow(run, schema)
        with_hits = StructType([*docs.drop(carried).schema.fields, *StructType.fromDDL(f"{carried} {HITS_SCHEMA}").fields])
        docs = cut_lineage(docs.mapInArrow(run, with_hits))
        for used in automata:
            used.destroy()
    raise AssertionError("the last pass returns")


def contamination(docs: DataFrame, items: DataFrame, p: DecontaminateParams = DecontaminateParams(), doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items (sorted ids), spans of words, contaminated.

    Null and empty texts have no words and no hits; items without id or words take no part, equal
    items are hit together; repeated rows give repeated rows, an empty table none.
    """
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()

    def finish(batch, raws, words, ranges, names):
        n_words, n_hit = [len(w) for w in words], [sum(b - a for a, b in r) for r in ranges]
        spans, ids = _hits(ranges, names).flatten()
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), spans, ids], ["doc_id", "n_words", "n_hit", "spans", "items"])

    schema = f"doc_id {kind}, n_words long, n_hit long, spans array<struct<start:int,end:int>>, items array<string>"
    out = _searched(d, "text", items, item_id, item_text, p, finish, schema)
    return out.withColumn("n_items", F.size("items").cast("long")).withColumn("contaminated", F.expr(f"n_hit > 0 and {p.share} * n_hit >= n_words"))


def merged(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of word ranges."""
    if not a or not b:
        return a or b
    out: list[tuple[int, int]] = []
    for start, end in sorted(a + b):
        if out and out[-1][1] >= start:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def word_bounds(raw: bytes) -> np.ndarray:
    """Byte ranges of a text's words, one row each."""
    inside = np.frombuffer(raw.translate(FOLD), np.uint8) != 0x20
    edges = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
    return edges.reshape(-1, 2)


def cleaned(docs: DataFrame, items: DataFrame, p: DecontaminateParams = DecontaminateParams(), doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", drop: bool = True) -> DataFrame:
    """All columns of the documents, without what is contaminated.

    With `drop`, documents over the coverage limit go whole and others stay as they are. Without, all
    documents stay and every hit word range is cut out of the text.
    """
    share = p.share

    def finish(batch, raws, words, found, names):
        at = batch.schema.get_field_index(text)
        keep, texts = [], []
        for raw, null, own, ranges in zip(raws, batch.column(at).is_null().to_pylist(), words, found):
            hit = sum(b - a for a, b in ranges)
            keep.append(not (drop and hit and share * hit >= len(own)))
            if ranges and not drop:
                bounds, parts, last = word_bounds(raw), [], 0
                for a, b in ranges:
                    parts.append(raw[last : bounds[a, 0]])
                    last = int(bounds[b - 1, 1])
                raw = b"".join([*parts, raw[last:]])
            texts.append(None if null else raw)
        if not drop:
            new = pa.array(texts, pa.binary()).cast(batch.schema.field(at).type)
            batch = batch.set_column(at, batch.schema.field(at), new)
        return batch.filter(pa.array(keep, pa.bool_()))

    return _searched(docs, text, items, item_id, item_text, p, finish, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    c = contamination(docs, items)
    return c.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


QUERIES = {"op3_decontamination": (query, None)}
