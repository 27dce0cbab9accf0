"""Token counts under a unigram vocabulary, by dynamic programming shared over a trie.

Distinct words (with the space mark before them) are inserted into a trie. Each node holds the best
forward score of its prefix and the tokens on that path, computed once from the nodes above it;
a word's count is read off its last node. Documents add their words' counts up. The trie ends at a
depth; what a word has beyond needs the scores of as many prefixes as the longest piece has characters,
so memory does not grow with a word.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandflow.llm.common import binary_texts, slices

SPACE_MARK = "▁"  # stands for the space before a word, as in the vocabulary file


@dataclass(frozen=True)
class CountParams:
    model_path: str = "/opt/tokenizers/piece_bpe_32k.model"  # read by the driver, its pieces are sent to the tasks
    nodes: int = 800_000  # trie nodes and words a task holds at most; it starts afresh beyond
    depth: int = 256  # characters of a word that become nodes; further ones are worked on in a window of the longest piece


def read_pieces(path: str) -> tuple[dict[str, float], float]:
    """(log-probability of each piece, that of a byte of a character without piece).

    The file orders pieces by rank and scores them by it, not by probability. Zipf's law on the rank,
    normalised, gives the unigram probabilities; a byte is as likely as the last piece.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    total = math.log(sum(1 / (rank + 1) for rank in range(len(ids))))
    return {model.id_to_piece(i): -math.log(rank + 1) - total for rank, i in enumerate(ids)}, -math.log(len(ids) + 1) - total


class Trie(dict):
    """Token count by word, computed on first use."""

    def __init__(self, pieces: dict[str, float], byte_score: float, most: int, depth: int):
        self.byte_score, self.most, self.depth = byte_score, most, depth
        self.longest = max(map(len, pieces), default=1)
        # Scores by piece, and None by any other ending of one: without an entry no longer piece can end here.
        self.endings: dict[str, float | None] = {piece[i:]: None for piece in pieces for i in range(1, len(piece))} | pieces
        self._fresh()

    def _fresh(self) -> None:
        self.clear()
        self.child: dict[int, int] = {}
        self.score, self.count = [0.0], [0]

    def _best(self, text: str, end: int, scores: list[float], counts: list[int]) -> tuple[float, int]:
        """Forward score and tokens of the first `end` characters; the lists end with those of one character less.

        Of equal scores the path of fewer tokens counts. A character without piece is as many tokens
        as it has bytes.
        """
        size = len(text[end - 1].encode("utf-8", "replace"))
        best, tokens = scores[-1] + size * self.byte_score, counts[-1] + size
        for start in range(end - 1, -1, -1):
            own = self.endings.get(text[start:end], 0)
            if own == 0:
                break
            if own is not None:
                new = scores[start - end] + own
                if new > best or new == best and counts[start - end] + 1 < tokens:
                    best, tokens = new, counts[start - end] + 1
        return best, tokens

    def __missing__(self, word: bytes) -> int:
        """Insert a word: only nodes that no earlier word made are computed."""
        if len(self.score) > self.most or len(self) > self.most:
            self._fresh()
        text = SPACE_MARK + word.decode("utf-8", "replace")
        node, child, score, count = 0, self.child, self.score, self.count
        scores, counts = [0.0], [0]
        for end in range(1, min(len(text), self.depth) + 1):
            key = node << 21 | ord(text[end - 1])
            node = child.get(key)
            if node is None:
                best, tokens = self._best(text, end, scores, counts)
                node = child[key] = len(score)
                score.append(best)
                count.append(tokens)
            scores.append(score[node])
            counts.append(count[node])
        if len(text) <= self.depth:
            self[word] = counts[-1]
            return counts[-1]
        for end in range(self.depth + 1, len(text) + 1):
            best, tokens = self._best(text, end, scores, counts)
            scores.append(best)
            counts.append(tokens)
            if len(scores) > 64 * self.longest:
                del scores[: -self.longest], counts[: -self.longest]
        return counts[-1]


def count_tokens(docs: DataFrame, p: CountParams = CountParams(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words (white-space separated), n_tokens.

    Null and empty texts have none of either; repeated rows give repeated rows, an empty table none;
    other columns are not looked at. A very long word is worked on whole, in memory that does not grow with it.
    """
    pieces, byte_score = read_pieces(p.model_path)
    shared = docs.sparkSession.sparkContext.broadcast(pieces)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        trie = Trie(shared.value, byte_score, p.nodes, p.depth)
        for batch in slices(batches, "text"):
            words, tokens = [], []
            for raw in binary_texts(batch.column("text")).to_pylist():
                found = raw.split()
                words.append(len(found))
                tokens.append(sum(map(trie.__getitem__, found)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, n_words long, n_tokens long")


def query(spark, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op6_token_counts": (query, None)}
