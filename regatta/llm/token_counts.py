"""Token counts by heap-and-linked-list byte-pair merging; no ids are made.

The symbols of a pretoken stand in a linked list, its adjacent pairs that have a merge rule in a heap
by rank and then place. The lowest pair is popped and merged, its neighbours' new pairs are pushed,
pairs whose ends have changed since are passed over. The count is the symbols at the start less the
merges, so no token is ever looked up or given out. It takes n log n steps for a pretoken of n bytes,
also for one without any white space in it.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from regatta.llm.chunks import WHITE, Memory, cutter

LIMIT = 1024
# Stretches, and pretokens, whose counts a worker remembers, in each of two generations, and the longest
# of them; texts whose new stretches are worked out together.
MEMORY = 500_000
REMEMBERED_LENGTH = 64
TOGETHER = 64


class TokenCounter:
    """Counts of one byte-level vocabulary, as the library gives them for whole texts.

    Added tokens inside a text count one each, as the library's default has it. Vocabularies of another
    kind are refused, not approximated.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        model, before = rules["model"], rules["pre_tokenizer"] or {}
        plain = (
            model["type"] == "BPE" and not rules["normalizer"] and not model.get("ignore_merges")
            and not model.get("dropout") and not model.get("continuing_subword_prefix")
            and not model.get("end_of_word_suffix") and before.get("type") == "ByteLevel"
            and before.get("use_regex", True) and not before.get("add_prefix_space")
        )
        added = rules["added_tokens"]
        if not plain or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError(f"not a plain byte-level BPE vocabulary: {path}")
        vocab: dict[str, int] = model["vocab"]
        self.ids = vocab
        self.rank: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for rule in model["merges"]:
            left, right = rule.split(" ") if isinstance(rule, str) else rule
            self.rank.setdefault((vocab[left], vocab[right]), len(self.made))
            self.made.append(vocab[left + right])
        names = sorted((t["content"] for t in added), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, names))) if names else None
        self.pretokens = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.cut = cutter()
        self.known = Memory(MEMORY)
        self.pieces = Memory(MEMORY)

    def merged(self, pretoken: str) -> int:
        """Tokens of one pretoken, given as the vocabulary's letters for its bytes."""
        symbols = [self.ids[letter] for letter in pretoken]
        n = count = len(symbols)
        if n < 2:
            return n
        rank, made = self.rank.get, self.made
        heap = [
            (r, at) for at, pair in enumerate(zip(symbols, symbols[1:])) if (r := rank(pair)) is not None
        ]
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # What stands behind the end, and what a merge has taken away: no rule knows it.
        symbols.append(-1)
        while heap:
            r, at = heapq.heappop(heap)
            gone = after[at] if symbols[at] >= 0 else n
            if rank((symbols[at], symbols[gone])) != r:
                continue
            right = after[gone]
            symbols[at], symbols[gone] = made[r], -1
            after[at] = right
            count -= 1
            if (left := before[at]) >= 0 and (found := rank((symbols[left], symbols[at]))) is not None:
                heapq.heappush(heap, (found, left))
            if right < n:
                before[right] = at
                if (found := rank((symbols[at], symbols[right]))) is not None:
                    heapq.heappush(heap, (found, at))
        return count

    def _learn(self, stretches: set[str]) -> None:
        """Counts of new stretches: one pass over all that have a border on both sides, others alone."""
        whole = [s for s in stretches if s[0] in WHITE and s[-1] not in WHITE]
        alone = [s for s in stretches if s[0] not in WHITE or s[-1] in WHITE]
        for part in ([whole] if whole else []) + [[s] for s in alone]:
            pretokens = self.pretokens("".join(part))
            new = self.pieces.missing({p for p, _ in pretokens})
            pieces = self.pieces.now
            for pretoken in new:
                pieces[pretoken] = self.merged(pretoken)
            at = end = 0
            for stretch in part:
                end += len(stretch)
                total = 0
                while at < len(pretokens) and pretokens[at][1][0] < end:
                    total += pieces[pretokens[at][0]]
                    at += 1
                self.known.now[stretch] = total
            for pretoken in new:
                if len(pretoken) > REMEMBERED_LENGTH:
                    del pieces[pretoken]

    def count_all(self, texts: list[str]) -> list[int]:
        """Counts of some texts; what is new in them is worked out together."""
        added = self.added
        marked = [added is not None and added.search(t) is not None for t in texts]
        parts = [added.split(t) if m else [t] for t, m in zip(texts, marked)]
        cut = [[s for part in some for s in self.cut.findall(part)] for some in parts]
        self.known.turn()
        self.pieces.turn()
        new = self.known.missing(set().union(*cut))
        self._learn(new)
        known = self.known.now
        totals = [len(some) - 1 + sum(map(known.__getitem__, of)) for some, of in zip(parts, cut)]
        for stretch in new:
            if len(stretch) > REMEMBERED_LENGTH:
                del known[stretch]
        return totals


_WORKERS: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    """One memory for each Python worker: it outlives the task."""
    if path not in _WORKERS:
        _WORKERS[path] = TokenCounter(path)
    return _WORKERS[path]


def token_count(text: Column, path: str) -> Column:
    """Tokens of every text as a column; the texts alone go to Python, in Arrow batches."""

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokens = counter(path)
        for batch in batches:
            texts = batch.tolist()
            counts = [n for at in range(0, len(texts), TOGETHER) for n in tokens.count_all(texts[at: at + TOGETHER])]
            yield pd.Series(counts, dtype="int64")

    return counted(F.coalesce(text, F.lit("")))


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` of every row of ``docs``.

    A null text is an empty one: no bytes, no tokens. A null id stays null, repeated rows are counted
    each, an empty table gives no rows, other columns are not read whatever they are called. A text of
    any length is counted whole, in memory that grows with its longest pretoken alone.
    """
    text = F.coalesce("text", F.lit(""))
    counted = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        token_count(F.col("text"), path).alias("n_tokens"),
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
