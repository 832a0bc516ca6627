"""Token counts: greedy longest-match word pieces, counted by one pass of an automaton.

The vocabulary is a trie. A node that is no token has a failure link to the node of what is left
after the longest tokens at its start are popped, and the number of tokens popped on the way, both
computed once (Song et al., "Fast WordPiece Tokenization", 2021). A word is then read character by
character; pieces are never built. A word that the vocabulary cannot spell counts as one unknown
token.

A text is cut into words by a pattern (runs of letters, single digits, runs of other signs, in lower
case by default) and each word's UTF-8 bytes are spelt in the vocabulary's byte alphabet. The last sign
of a word carries the end-of-word mark, and the two are one sign, in the vocabulary as in the word: the
signs of the mark match no text. So the piece that ends a word is one with the mark; where the longest
piece would reach the word's end without it, the longest that leaves a rest is taken, and a word that
no piece with the mark can close is unknown, one token. Counts of words seen before are kept in a table of at most `CACHE` words per
task, emptied when full.

Null and empty texts have 0 tokens. A long word costs time linear in its length. Repeated rows get a
row each, an empty table an empty result. The vocabulary file is read by the driver; its size bounds
what is sent to the tasks.
"""

from __future__ import annotations

import json
from collections import Counter, deque
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
import regex
from pyspark.sql import DataFrame

from winnow.llm.common import with_fields

VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
WORD = r"[\p{L}\p{M}]+|\p{N}|[^\s\p{L}\p{M}\p{N}]+"
END = "</w>"
CACHE = 500_000


def byte_alphabet() -> dict[int, str]:
    """Printable Latin-1 bytes stand for themselves, the others for the signs from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def closed(word: str, end: str) -> Sequence[str]:
    """The signs of a word, the end mark and the last sign as one."""
    return [*word[:-1], word[-1] + end] if word and end else word


class Automaton:
    """Trie with failure links and popped-token counts. Node 0 is the start of a word; `rest` the
    start of what follows a token, which differs where continuations carry a mark such as `##`. Tokens
    that carry the mark `end` hold it as part of their last sign."""

    def __init__(self, tokens: Iterable[str], continuation: str = "", end: str = "") -> None:
        self.next: list[dict[str, int]] = [{}]
        token = [False]

        def add(root: int, word: Sequence[str]) -> None:
            node = root
            for sign in word:
                if sign not in self.next[node]:
                    self.next[node][sign] = len(self.next)
                    self.next.append({})
                    token.append(False)
                node = self.next[node][sign]
            token[node] = True

        self.rest = 0
        if continuation:
            self.rest = 1
            self.next.append({})
            token.append(False)
        def signs(word: str) -> Sequence[str]:
            return closed(word.removesuffix(end), end) if end and word.endswith(end) else word

        for word in tokens:
            if continuation and word.startswith(continuation):
                if word != continuation:
                    add(self.rest, signs(word[len(continuation) :]))
            elif word != end:
                add(0, signs(word))
        self.fail: list[int] = [-1] * len(self.next)
        self.popped: list[int] = [0] * len(self.next)
        queue = deque({0, self.rest})
        while queue:
            parent = queue.popleft()
            for sign, node in self.next[parent].items():
                queue.append(node)
                if token[node]:
                    self.fail[node], self.popped[node] = self.rest, 1
                    continue
                at, count = self.fail[parent], self.popped[parent]
                while at >= 0 and sign not in self.next[at]:
                    count += self.popped[at]
                    at = self.fail[at]
                if at >= 0:
                    self.fail[node], self.popped[node] = self.next[at][sign], count

    def count(self, word: Sequence[str]) -> int:
        """Number of greedy longest-match pieces; 1 when the word cannot be spelt, 0 when empty."""
        if not word:
            return 0
        nodes, fail, popped = self.next, self.fail, self.popped
        node = total = 0
        for sign in word:
            after = nodes[node].get(sign)
            while after is None:
                total += popped[node]
                node = fail[node]
                if node < 0:
                    return 1
                after = nodes[node].get(sign)
            node = after
        while node != self.rest or not total:
            total += popped[node]
            node = fail[node]
            if node < 0:
                return 1
        return total


def read_tokens(path: str) -> list[str]:
    with open(path, encoding="utf-8") as file:
        return list(json.load(file)["model"]["vocab"])


class Counting:
    def __init__(self, tokens: list[str], pattern: str, end: str) -> None:
        self.automaton = Automaton(tokens, end=end)
        self.word, self.end = regex.compile(pattern), end
        self.alphabet = byte_alphabet()
        self.known: dict[str, int] = {}

    def of_word(self, word: str) -> int:
        found = self.known.get(word)
        if found is None:
            spelt = "".join(map(self.alphabet.__getitem__, word.encode("utf-8", "replace")))
            found = self.automaton.count(closed(spelt, self.end))
            if len(self.known) >= CACHE:
                self.known.clear()
            self.known[word] = found
        return found

    def of_text(self, text: str | None) -> tuple[int, int]:
        """Number of words and of tokens."""
        words = Counter(self.word.findall((text or "").lower()))
        return words.total(), sum(n * self.of_word(w) for w, n in words.items())


def count_tokens(
    docs: DataFrame, *, vocabulary: str = VOCABULARY, pattern: str = WORD, end: str = END, text_col: str = "text"
) -> DataFrame:
    """All columns but the text, with n_words and n_tokens added; a map, no shuffle."""
    tokens = read_tokens(vocabulary)
    keep = docs.drop(text_col, "n_words", "n_tokens")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counting = Counting(tokens, pattern, end)
        for batch in batches:
            out = batch.drop(columns=[text_col])
            counts = [counting.of_text(t) for t in batch[text_col]]
            out["n_words"] = [c[0] for c in counts]
            out["n_tokens"] = [c[1] for c in counts]
            yield out

    schema = with_fields(keep.schema, n_words="bigint", n_tokens="bigint")
    return docs.select(*keep.columns, text_col).mapInPandas(run, schema)


def token_counts(docs: DataFrame) -> DataFrame:
    return count_tokens(docs.select("doc_id", "text"))
