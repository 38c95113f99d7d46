"""Alignment of two tokenizers' tokens by merge-path partitioning of their ends.

Both tokenizers spell the same bytes, so their tokens are two ascending lists of byte offsets, and an
alignment is the merging of these lists. Diagonal binary searches cut the merge into pieces of equal
work that know nothing of one another. A piece emits the offsets where tokens of both lists end inside
it; an end that the diagonal parts (the A token before it, the B token behind) is emitted by the border.
Stitched in order, the emitted offsets close the groups, also those open across borders.

Tokens that end together have one a suffix of the other, so the possible pairs are known from the two
vocabularies alone, whatever the corpus: a link is the number of its pair, and the corpus-wide counts
are an array of that known length, the only thing that is broadcast.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from regatta.llm.chunks import WHITE, Memory, cutter
from regatta.operators.common import cut_lineage

# Steps of merging in one piece.
PIECE_WORK = 1 << 15
# Bytes of text that are coded and aligned together; a longer text is taken alone.
TOGETHER_BYTES = 1 << 20
# Stretches whose ids a worker remembers, in each of two generations, and the longest of them.
MEMORY = 150_000
REMEMBERED_LENGTH = 64
# New stretches that are coded in one call.
TOGETHER = 4096

ALIGNED = (
    "doc_id long, a_ids array<int>, b_ids array<int>, a_sizes array<int>, b_sizes array<int>, links array<int>"
)
DIGESTS = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<int>"
)


class Alphabet:
    """The tokens' bytes of a byte-level vocabulary A and a piece vocabulary B, and their possible pairs."""

    def __init__(self, a_path: str, b_path: str):
        # A task has one core; the library would start a thread for each core of the machine.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        letters = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(map(letters.__getitem__, token))
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            byte = self.b.is_byte(i)
            self.b_bytes.append(bytes([int(piece[1:-1], 16)]) if byte else piece.replace("▁", " ").encode())
        if not all(self.a_bytes) or not all(self.b_bytes):
            raise ValueError("a token without bytes has no place in an alignment")
        self.a_length = np.array(list(map(len, self.a_bytes)))
        self.b_length = np.array(list(map(len, self.b_bytes)))
        self._number_pairs()

    def _number_pairs(self) -> None:
        """All ``(A id, B id)`` of which one is a suffix of the other, in ascending order."""
        spelled: dict[bytes, list[int]] = {}
        for i, octets in enumerate(self.b_bytes):
            spelled.setdefault(octets, []).append(i)
        a_of = {octets: i for i, octets in enumerate(self.a_bytes)}
        found = [
            a << 32 | b
            for a, octets in enumerate(self.a_bytes) for at in range(len(octets))
            for b in spelled.get(octets[at:], ())
        ] + [
            a_of[octets[at:]] << 32 | b
            for b, octets in enumerate(self.b_bytes) for at in range(1, len(octets)) if octets[at:] in a_of
        ]
        self.pairs = np.array(sorted(found), np.int64)
        self.pair_b = (self.pairs & 0xFFFFFFFF).astype(np.int64)

    def links(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.pairs, a.astype(np.int64) << 32 | b).astype(np.int32)


class PairCoder(Alphabet):
    """Ids of whole texts in both vocabularies, remembered by stretch."""

    def __init__(self, a_path: str, b_path: str):
        super().__init__(a_path, b_path)
        # A border before a white-space character holds for B if no piece goes on over it.
        inner = {c for t in self.b_bytes if len(t) > 1 for c in t.decode("utf-8", "ignore")} - {" "}
        self.white = "".join(c for c in WHITE if c not in inner)
        spaced = (t.decode("utf-8", "ignore") for t in self.b_bytes)
        self.parted = not any(x not in self.white and y in self.white for t in spaced for x, y in zip(t, t[1:]))
        self.cut = cutter(self.white)
        self.unsafe = [c for c in WHITE if c in inner]
        self.known = Memory(MEMORY)

    def _code(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of a text that begins with a space; None if a vocabulary does not spell it."""
        octets = text.encode()
        a = self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids
        b = self.b.encode(text[1:], num_threads=1)
        if b"".join(map(self.a_bytes.__getitem__, a)) != octets:
            return None
        if b"".join(map(self.b_bytes.__getitem__, b)) != octets:
            return None
        return np.array(a, "<u4"), np.array(b, "<u4")

    def _learn(self, stretches: list[str]) -> None:
        """Ids of new stretches behind a first one that gives every other its border."""
        lead = " x"
        coded = self._code(lead + "".join(stretches))
        if coded is None:
            if len(stretches) == 1:
                self.known.now[stretches[0]] = None
            else:
                half = len(stretches) // 2
                self._learn(stretches[:half])
                self._learn(stretches[half:])
            return
        ends = np.cumsum([len(lead), *(len(s.encode()) for s in stretches)])
        sides = []
        for ids, length in zip(coded, (self.a_length, self.b_length)):
            token_ends = np.cumsum(length[ids])
            cuts = np.searchsorted(token_ends, ends)
            if (token_ends[cuts] != ends).any():
                raise ValueError("a token goes over the border of two stretches")
            octets, cuts = ids.tobytes(), (4 * (cuts + 1)).tolist()
            sides.append([octets[s:e] for s, e in zip(cuts, cuts[1:])])
        self.known.now.update(zip(stretches, zip(*sides)))

    def code_all(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Ids of every text in A and B as little-endian unsigned 32-bit bytes; none where it is not spelled."""
        self.known.turn()
        whole = [not self.parted or any(c in text for c in self.unsafe) for text in texts]
        cut = [
            [] if not text else [" " + text] if alone else self.cut.findall(" " + text)
            for text, alone in zip(texts, whole)
        ]
        new = self.known.missing(set().union(*cut))
        for stretches in (c for c, alone in zip(cut, whole) if alone and c):
            coded = self._code(stretches[0])
            self.known.now[stretches[0]] = coded and tuple(ids.tobytes() for ids in coded)
        rest = [s for s in new if s not in self.known.now]
        inside = [s for s in rest if s[0] in self.white and s[-1] not in WHITE and len(s) <= REMEMBERED_LENGTH]
        for at in range(0, len(inside), TOGETHER):
            self._learn(inside[at: at + TOGETHER])
        for stretch in set(rest).difference(inside):
            self._learn([stretch])
        known = self.known.now
        out = []
        for stretches in cut:
            ids = list(map(known.__getitem__, stretches))
            out.append(tuple(map(b"".join, zip(*ids))) if ids and None not in ids else (b"", b""))
        for stretch in new:
            if len(stretch) > REMEMBERED_LENGTH:
                del known[stretch]
        for stretches, alone in zip(cut, whole):
            if alone and stretches:
                known.pop(stretches[0], None)
        return out


_WORKERS: dict[tuple, Alphabet] = {}


def worker(kind: type, a_path: str, b_path: str) -> Alphabet:
    """One of a kind for each Python worker: it outlives the task."""
    key = (kind, a_path, b_path)
    if key not in _WORKERS:
        _WORKERS[key] = kind(a_path, b_path)
    return _WORKERS[key]


def diagonal_cuts(a: np.ndarray, b: np.ndarray, work: int) -> tuple[np.ndarray, np.ndarray]:
    """How many of ``a`` and of ``b`` come before each diagonal of the merge; ``a`` goes first on ties."""
    total = len(a) + len(b)
    diagonal = np.append(np.arange(0, total, work), total)
    low, high = np.maximum(0, diagonal - len(b)), np.minimum(diagonal, len(a))
    while (open_ := low < high).any():
        middle = (low + high) // 2
        first = np.zeros(len(diagonal), bool)
        at = middle[open_]
        first[open_] = a[at] <= b[diagonal[open_] - at - 1]
        low = np.where(open_ & first, middle + 1, low)
        high = np.where(open_ & ~first, middle, high)
    return low, diagonal - low


def common_ends(a: np.ndarray, b: np.ndarray, work: int = PIECE_WORK) -> tuple[np.ndarray, np.ndarray]:
    """Where the strictly ascending ``a`` and ``b`` hold the same value: index in ``a``, index in ``b``."""
    cut_a, cut_b = diagonal_cuts(a, b, work)
    emitted_a, emitted_b = [], []
    for a0, a1, b0, b1 in zip(cut_a, cut_a[1:], cut_b, cut_b[1:]):
        mine, others = a[a0:a1], b[b0:b1]
        if len(mine) and len(others):
            place = np.searchsorted(others, mine)
            place[place == len(others)] = 0
            hit = np.flatnonzero(others[place] == mine)
            emitted_a.append(hit + a0)
            emitted_b.append(place[hit] + b0)
        # The border's own: A's end before the diagonal, B's equal end behind it.
        if a1 and b1 < len(b) and a[a1 - 1] == b[b1]:
            emitted_a.append(np.array([a1 - 1]))
            emitted_b.append(np.array([b1]))
    if not emitted_a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(emitted_a), np.concatenate(emitted_b)


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = np.append(0, np.cumsum(counts)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)))


def _aligned(coder: PairCoder, ids: pa.Array, texts: list[str], work: int) -> pa.RecordBatch:
    """The texts' tokens as one line of bytes, merged piece by piece: a text's end is always an end of both."""
    coded = coder.code_all(texts)
    a = np.frombuffer(b"".join(c[0] for c in coded), "<u4")
    b = np.frombuffer(b"".join(c[1] for c in coded), "<u4")
    n_a = np.array([len(c[0]) // 4 for c in coded], np.int64)
    n_b = np.array([len(c[1]) // 4 for c in coded], np.int64)
    at_a, at_b = common_ends(np.cumsum(coder.a_length[a]), np.cumsum(coder.b_length[b]), work)
    groups = np.searchsorted(at_a, np.cumsum(n_a)) if len(at_a) else np.zeros(len(texts), np.int64)
    groups = np.diff(groups, prepend=0)
    columns = [
        ids, _lists(a, n_a), _lists(b, n_b),
        _lists(np.diff(at_a, prepend=-1), groups), _lists(np.diff(at_b, prepend=-1), groups),
        _lists(coder.links(a[at_a], b[at_b]), groups),
    ]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "a_ids", "b_ids", "a_sizes", "b_sizes", "links"])


Batches = Iterator[pa.RecordBatch]


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def _align(a_path: str, b_path: str, work: int) -> Callable[[Batches], Batches]:
    def aligned(batches: Batches) -> Batches:
        coder = worker(PairCoder, a_path, b_path)
        for batch in batches:
            octets, start = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)), 0
            while start < len(batch):
                before = octets[start - 1] if start else 0
                end = max(start + 1, int(np.searchsorted(octets, before + TOGETHER_BYTES, "right")))
                part = batch.slice(start, end - start)
                yield _aligned(coder, part.column(0), part.column(1).to_pylist(), work)
                start = end

    return aligned


def align_documents(docs: DataFrame, a_path: str, b_path: str, work: int = PIECE_WORK) -> DataFrame:
    """Tokens, groups and links of every row of ``docs``: see ``ALIGNED``.

    ``a_sizes`` and ``b_sizes`` are the tokens of each group in order, ``links`` the numbers of the pairs
    of tokens that end together (``Alphabet.pairs``): one closes each group, as no token is without bytes.
    A text that is null or empty, or that a vocabulary does not spell (one with U+2581 in it), has no
    tokens and empty lists. A null id stays null, repeated rows are aligned each, an empty table gives no
    rows, other columns are not read. A text of any length is aligned whole, in pieces of ``work`` steps.
    """
    return _rows(docs).mapInArrow(_align(a_path, b_path, work), ALIGNED)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column, and how many each row has."""
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())


def _digest(batches: Batches) -> Batches:
    size, shown = 0, []
    for batch in batches:
        (a, n_a), (b, n_b), (size_a, groups), (size_b, _) = (_flat(batch.column(i)) for i in range(1, 5))
        end_a, end_b = np.cumsum(size_a, dtype=np.int64), np.cumsum(size_b, dtype=np.int64)
        code = np.empty(len(a) + len(b), np.int64)
        if (most := max(a.max(initial=0), b.max(initial=0))) >= size:
            # Every id with the mark behind it, within its group and at the end of A's or B's part.
            size = 1 << max(16, int(most).bit_length())
            shown = [b"%d%s" % (i, mark) for mark in (b",", b"|", b";") for i in range(size)]
        a, b = a.astype(np.int64), b.astype(np.int64)
        a[end_a - 1] += size
        b[end_b - 1] += 2 * size
        # A's tokens come before those of B in every group.
        code[np.arange(len(a)) + np.repeat(end_b - size_b, size_a)] = a
        code[np.arange(len(b)) + np.repeat(end_a, size_b)] = b
        ends = np.cumsum(n_a.astype(np.int64) + n_b).tolist()
        written = [
            hashlib.sha256(b"".join(map(shown.__getitem__, code[s:e].tolist()))[:-1]).hexdigest() if s < e else ""
            for s, e in zip([0, *ends], ends)
        ]
        counts = (pa.array(n.astype(np.int64)) for n in (n_a, n_b, groups, groups))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *counts, pa.array(written, pa.string()), batch.column(5)],
            ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"],
        )


def group_digests(aligned: DataFrame) -> DataFrame:
    """Counts and the digest of ``a1,a2|b1;a3|b2,b3`` (decimal ids, groups in order) of every aligned row.

    Without tokens the digest is empty. ``links`` are passed on for ``rate_links``.
    """
    return aligned.mapInArrow(_digest, DIGESTS)


def link_counts(rows: DataFrame, n_pairs: int) -> DataFrame:
    """``(pair, n)``: how often each pair is linked; a task sends one row for each pair it has seen."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(n_pairs, np.int64)
        for batch in batches:
            links = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            n += np.bincount(links, minlength=n_pairs)
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(n[seen])], ["pair", "n"])

    each = rows.select("links").mapInArrow(counted, "pair int, n long")
    return each.groupBy("pair").agg(F.sum("n").alias("n"))


def rate_links(rows: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Replaces ``links`` by ``n_best`` and ``count_sum`` under the counts of all rows together.

    The counts reach the driver and the tasks as one array, whose length the vocabularies give before any
    row is read (the pairs of which one token is a suffix of the other).
    """
    pairs = Alphabet(a_path, b_path)
    counts = np.zeros(len(pairs.pairs), np.int64)
    seen = link_counts(rows, len(counts)).toArrow()
    counts[seen["pair"].to_numpy()] = seen["n"].to_numpy()
    most = np.zeros(len(pairs.b_bytes), np.int64)
    np.maximum.at(most, pairs.pair_b, counts)
    shared = rows.sparkSession.sparkContext.broadcast((counts, counts == most[pairs.pair_b]))
    others = [c for c in rows.columns if c != "links"]

    def rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, best = shared.value
        for batch in batches:
            links, n = _flat(batch.column(batch.num_columns - 1))
            ends = np.append(0, np.cumsum(n))
            sums = (np.diff(np.append(0, np.cumsum(x[links], dtype=np.int64))[ends]) for x in (best, count))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *map(pa.array, sums)], [*others, "n_best", "count_sum"]
            )

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*others).schema)
    return rows.select(*others, "links").mapInArrow(rated, f"{schema}, n_best long, count_sum long")


def alignment_report(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Counts, digest and rated links of every row; the texts are coded once, the links written once.

    Aligned batches go to their digests within the worker, not through the JVM and a second worker.
    """
    align = _align(a_path, b_path, PIECE_WORK)
    digests = _rows(docs).mapInArrow(lambda batches: _digest(align(batches)), DIGESTS)
    return rate_links(cut_lineage(digests), a_path, b_path)
