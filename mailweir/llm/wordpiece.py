"""Word-piece token counts with a linear longest-match automaton.

The vocabulary is a trie. Where no child fits the next byte, a node's failure link leads to the node
that is reached after greedy longest matches have taken pieces off the front of what was read, and its
pop count is the number of those pieces. A word is thus read once, without going back, and its count
is the sum of the pops: pieces are never built.

Words are the runs between white space (bytes 09-0D and 20). Pieces are byte strings, those that begin
a word and those that continue one. A word that can't be cut into pieces counts as one unknown token.

Defined results: null and empty texts have no words. A column named like an output is replaced.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from mailweir.llm.bpe import byte_letters, load, vocabulary
from mailweir.llm.common import add_columns, read_table, texts_of, worker_model

#: Words that a worker remembers; it starts anew beyond that.
CACHE_WORDS = 500_000


class LongestMatch:
    """The automaton of two sets of pieces."""

    def __init__(self, begins: set[bytes], continues: set[bytes]) -> None:
        self.step: list[dict[int, int]] = [{}, {}]  # 0: start of a word, 1: after a piece
        piece = [False, False]
        for root, words in ((0, begins), (1, continues)):
            for word in words:
                node = root
                for byte in word:
                    to = self.step[node].get(byte)
                    if to is None:
                        to = self.step[node][byte] = len(self.step)
                        self.step.append({})
                        piece.append(False)
                    node = to
                piece[node] = node > 1
        self.fail: list[int] = [-1] * len(piece)
        self.pops: list[int] = [0] * len(piece)
        queue = [0, 1]
        for node in queue:
            for byte, to in self.step[node].items():
                queue.append(to)
                if piece[to]:
                    self.fail[to], self.pops[to] = 1, 1
                    continue
                at, pops = self.fail[node], self.pops[node]
                while at >= 0 and byte not in self.step[at]:
                    pops += self.pops[at]
                    at = self.fail[at]
                if at >= 0:
                    self.fail[to], self.pops[to] = self.step[at][byte], pops

    def count(self, word: bytes) -> int:
        """Pieces of a word by greedy longest match, 0 if it can't be cut."""
        step, fail, pops = self.step, self.fail, self.pops
        node = total = 0
        for byte in word:
            to = step[node].get(byte)
            while to is None:
                total += pops[node]
                node = fail[node]
                if node < 0:
                    return 0
                to = step[node].get(byte)
            node = to
        while node > 1:
            total += pops[node]
            node = fail[node]
        return total if node == 1 else 0


def pieces_of_byte_bpe(content: bytes) -> tuple[set[bytes], set[bytes]]:
    """Word pieces by rule from a byte-level vocabulary: entries with a leading space begin a word, the others continue one."""
    letters = byte_letters()
    tokens = [bytes(letters[c] for c in t) for t in json.loads(content)["model"]["vocab"] if all(c in letters for c in t)]
    inner = [t for t in tokens if len(t.split()) == 1]
    return {t[1:] for t in inner if t[:1] == b" " and t.split() == [t[1:]]}, {t for t in inner if t.split() == [t]}


class WordCounter:
    """Counts of words and tokens of whole texts, with a bounded memory of words."""

    def __init__(self, content: bytes) -> None:
        self.automaton = LongestMatch(*pieces_of_byte_bpe(content))
        self.known: dict[bytes, int] = {}

    def text(self, text: bytes) -> tuple[int, int, int]:
        """Words, tokens, unknown words."""
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        known, words = self.known, text.split()
        for word in set(words).difference(known):
            known[word] = self.automaton.count(word)
        counts = [known[w] for w in words]
        unknown = counts.count(0)
        return len(words), sum(counts) + unknown, unknown


def token_counts(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Add n_words, n_tokens and n_unknown of every whole text; map-only."""
    shared = load(df.sparkSession, path)

    def make():
        counter = worker_model("wordpiece", shared.value, WordCounter)

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            found = [counter.text(t or b"") for t in texts_of(batch.column(text))]
            return [pa.array([f[k] for f in found], pa.int64()) for k in range(3)]

        return work

    return add_columns(df, text, [("n_words", "bigint"), ("n_tokens", "bigint"), ("n_unknown", "bigint")], make, models=True)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word-piece counts of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, vocabulary("byte_bpe_50k.json")).select("doc_id", "n_words", "n_tokens", "n_unknown")
