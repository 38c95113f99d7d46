"""Packing of token pieces into windows by Karmarkar-Karp multiway differencing.

A document's ids are cut into whole windows and one rest. Pieces are dealt by a hash into shards of
about ``SHARD_PIECES``; in a shard every whole window is a sequence, and the rests are partitioned:
two partial partitions with the largest imbalances merge, the fullest windows of one onto the emptiest
of the other, until one is left. Its windows are near equal, so with as few windows as the sum allows
almost nothing is padded; when a window would exceed the capacity, there are more windows, as long as
they pad little. Rests that cannot fit so (all just above half a window, say) stay in as few windows
as the sum allows, are cut at the window's edge, and what is cut off goes to the windows with most room.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from regatta.operators.common import cut_lineage

CAPACITY = 4096
# Fixed value of the contract: the id that ends every document.
END_ID = 2
# Pieces per shard: enough windows for a low share of padding, small enough for one task's memory.
SHARD_PIECES = 1024
# Rests are cut at multiples of so many ids: a worker keeps the checksum of the ids before each.
GRID = 16
# One window more for every so many before rests are cut instead: a share of padding below 0.4 %.
WINDOWS_PER_SPARE = 256
# Distinct words whose ids a worker remembers, in each of two generations.
MEMORY_WORDS = 500_000
# Letters that composition leaves alone, and up to three marks, which the rules part from them.
PLAIN_WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]{0,3})")

# A missing id would turn a pandas column into doubles, so ids travel as text.
PIECES = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long"
CUT = f"{PIECES}, marks binary"
PACKED = f"{PIECES}, sequence_id long, offset long"


class WordIds:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, remembered by word.

    The vocabulary's rules never look across ASCII white space, so a text's ids are those of its
    words in order. Plain new words (letters, perhaps a few marks behind them) need none of those
    rules: they go to the vocabulary's merges together, and the ids that end a word part them again.
    All other words go through the whole tokenizer one by one. Words seen of late are remembered in
    two generations of bounded size.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.fresh: dict[bytes, bytes] = {}
        self.stale: dict[bytes, bytes] = {}
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        ends = [i for token, i in rules["model"]["vocab"].items() if token.endswith("</w>")]
        self.ends = np.zeros(max(rules["model"]["vocab"].values()) + 1, bool)
        self.ends[ends] = True
        rules |= {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"},
                  "added_tokens": []}
        self.merges = Tokenizer.from_str(json.dumps(rules))
        self.marks: dict[str, bytes] = {}
        # Bytes as the letters the vocabulary writes them with; white space stays between words.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.letters = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in shown)}
        self.letters.pop(32)

    def _ids(self, text: str) -> bytes:
        coded = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0]
        return np.array(coded.ids, "<u4").tobytes()

    def _learn(self, words: set[bytes]) -> None:
        plain, cores = [], []
        for word in words:
            if (old := self.stale.get(word)) is not None:
                self.fresh[word] = old
            elif (m := PLAIN_WORD.fullmatch(text := word.decode("utf-8", "replace"))) is not None:
                core, mark = m.groups()
                if mark not in self.marks:
                    self.marks[mark] = self._ids(mark)
                plain.append((word, self.marks[mark]))
                cores.append(core)
            else:
                self.fresh[word] = self._ids(text)
        if plain:
            spelled = " ".join(cores).lower()
            if not spelled.isascii():
                spelled = spelled.encode().decode("latin-1").translate(self.letters)
            coded = self.merges.encode_batch_fast([spelled], add_special_tokens=False)[0]
            ids = np.array(coded.ids, "<u4")
            ends = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            octets, start = ids.tobytes(), 0
            for (word, mark), end in zip(plain, ends, strict=True):
                self.fresh[word] = octets[start:end] + mark
                start = end

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Texts are taken a few at a time: one call for all their plain new words."""
        for at in range(0, len(texts), 64):
            if len(self.fresh) > MEMORY_WORDS:
                self.fresh, self.stale = {}, self.fresh
            split = [t.encode("utf-8", "surrogatepass").split() for t in texts[at: at + 64]]
            known = self.fresh
            self._learn(set().union(*split).difference(known))
            for words in split:
                yield b"".join(map(known.__getitem__, words))


_WORKERS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One memory for each Python worker: it outlives the task."""
    if path not in _WORKERS:
        _WORKERS[path] = WordIds(path)
    return _WORKERS[path]


def grid_checksums(ids: bytes) -> bytes:
    """CRC-32 of the ids before every multiple of ``GRID`` within, 0 included, as unsigned 32-bit numbers."""
    crc, marks = 0, [0]
    for at in range(4 * GRID, len(ids), 4 * GRID):
        crc = zlib.crc32(ids[at - 4 * GRID: at], crc)
        marks.append(crc)
    return np.array(marks, "<u4").tobytes()


def checksum_between(before: int, through: int, length: int) -> int:
    """CRC-32 of ``length`` ids from that of all ids before them and that of all ids through their end.

    What a checksum's start adds to its result depends on the number of bytes alone, so zeros show it.
    """
    zeros = bytes(4 * length)
    return through ^ zlib.crc32(zeros, before) ^ zlib.crc32(zeros)


def _cut(path: str, capacity: int):
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = word_ids(path)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            out: dict[str, list] = {"doc_id": [], "start": [], "length": [], "ids_crc32": [],
                                    "doc_tokens": [], "marks": []}
            for doc_id, ids in zip(batch["doc_id"], words.encode(batch["text"].tolist())):
                ids += end
                total = len(ids) // 4
                for start in range(0, total, capacity):
                    piece = ids[4 * start: 4 * (start + capacity)]
                    for name, value in zip(out, (
                        doc_id, start, len(piece) // 4, zlib.crc32(piece), total,
                        grid_checksums(piece) if len(piece) < 4 * capacity else b"",
                    )):
                        out[name].append(value)
            yield pd.DataFrame(out).astype({"doc_id": object})

    return cut


def token_pieces(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY
) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens, marks)``: every document cut at the capacity.

    The id is text; ``marks`` are the ``grid_checksums`` of a rest, empty for a whole window.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").cast("string").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    return rows.mapInPandas(_cut(tokenizer_path, capacity), CUT)


def partition(lengths: np.ndarray, windows: int) -> np.ndarray:
    """Window of every piece by multiway differencing; sums come out near equal.

    A partial partition is its window sums less the smallest, fullest first, with the first and last
    piece of every window; ``after`` chains the pieces of a window.
    """
    n = len(lengths)
    after = np.full(n, -1, np.int64)
    heap: list[tuple] = []
    for item, length in enumerate(lengths.tolist()):
        heap.append((-length, item, None))
    heapq.heapify(heap)
    count = n

    def opened(entry: tuple) -> tuple:
        if entry[2] is not None:
            return entry[2]
        sums = np.zeros(windows, np.int64)
        head = np.full(windows, -1, np.int64)
        sums[0], head[0] = -entry[0], entry[1]
        return sums, head, head.copy()

    while len(heap) > 1:
        sums_a, head_a, tail_a = opened(heapq.heappop(heap))
        entry = heapq.heappop(heap)
        if entry[2] is None:
            # A single piece goes to the emptiest window.
            sums = sums_a.copy()
            sums[-1] -= entry[0]
            head, tail = head_a.copy(), tail_a.copy()
            if head[-1] >= 0:
                after[tail[-1]] = entry[1]
            else:
                head[-1] = entry[1]
            tail[-1] = entry[1]
        else:
            # The fullest windows of one onto the emptiest of the other.
            sums_b, head_b, tail_b = (x[::-1] for x in entry[2])
            sums = sums_a + sums_b
            both = (head_a >= 0) & (head_b >= 0)
            after[tail_a[both]] = head_b[both]
            head = np.where(head_a >= 0, head_a, head_b)
            tail = np.where(head_b >= 0, tail_b, tail_a)
        order = np.argsort(-sums, kind="stable")
        merged = (sums[order] - sums.min(), head[order], tail[order])
        heapq.heappush(heap, (-int(merged[0][0]), count, merged))
        count += 1
    window = np.empty(n, np.int64)
    for w, item in enumerate(opened(heap[0])[1].tolist()):
        while item >= 0:
            window[item] = w
            item = int(after[item])
    return window


def fill_windows(
    lengths: np.ndarray, capacity: int = CAPACITY, most: int | None = None
) -> np.ndarray | None:
    """Windows within the capacity; None if that takes more than ``most``.

    The count starts at what the sum and the pieces above half a window need, rises by doubled steps
    while a window is exceeded, and is halved back between the last that failed and the first that fits.
    """
    if not len(lengths):
        return np.empty(0, np.int64)
    low = max(1, -(-int(lengths.sum()) // capacity), int((lengths > capacity // 2).sum()))
    most = max(low, len(lengths)) if most is None else most
    if low > most:
        return None
    found: dict[int, np.ndarray] = {}

    def fits(windows: int) -> bool:
        window = partition(lengths, windows)
        if np.bincount(window, lengths, windows).max() <= capacity:
            found[windows] = window
        return windows in found

    high, step = low, 1
    while not fits(high):
        if high == most:
            return None
        low, high, step = high + 1, min(high + step, most), 2 * step
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if fits(middle) else (middle + 1, high)
    return found[high]


def cut_at_edges(
    lengths: np.ndarray, window: np.ndarray, capacity: int = CAPACITY
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(item, start, length, window)`` of parts that stay within the capacity.

    The longest piece of a window that is exceeded is cut so that the rest fits; what is cut off goes to
    the window with most room, cut again at its edge, and to a new one when no room is left. All cuts
    are at multiples of ``GRID`` from the piece's start.
    """
    windows = int(window.max()) + 1
    sums = np.bincount(window, lengths, windows).astype(np.int64)
    kept, moved = lengths.astype(np.int64), []
    # Pieces by window, the longest of each first.
    order = np.lexsort((-lengths, window))
    first = np.searchsorted(window[order], np.arange(windows))
    for w in np.flatnonzero(sums > capacity).tolist():
        at = first[w]
        while sums[w] > capacity:
            item = int(order[at])
            keep = max(0, int(lengths[item] - sums[w] + capacity) // GRID * GRID)
            moved.append((int(keep - lengths[item]), item, keep))
            sums[w] -= lengths[item] - keep
            kept[item] = keep
            at += 1
    room = [(int(s) - capacity, w) for w, s in enumerate(sums) if s < capacity]
    heapq.heapify(room)
    parts = [(i, 0, int(n), int(window[i])) for i, n in enumerate(kept) if n]
    for left, item, start in sorted(moved):
        left = -left
        while left:
            if not room or left > -room[0][0] < GRID:
                heapq.heappush(room, (-capacity, windows))
                windows += 1
            free, w = room[0]
            part = left if left <= -free else -free // GRID * GRID
            parts.append((item, start, part, w))
            heapq.heapreplace(room, (free + part, w))
            start, left = start + part, left - part
    item, start, length, place = np.array(parts, np.int64).T
    return item, start, length, place


def pack_rests(
    lengths: np.ndarray, capacity: int = CAPACITY
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(item, start, length, window)``: uncut where few spare windows allow it, else cut at window edges."""
    least = max(1, -(-int(lengths.sum()) // capacity))
    window = fill_windows(lengths, capacity, least + least // WINDOWS_PER_SPARE)
    if window is None:
        return cut_at_edges(lengths, partition(lengths, least), capacity)
    return np.arange(len(lengths)), np.zeros(len(lengths), np.int64), lengths, window


def _pack(capacity: int):
    def pack(key: tuple, pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values(
            ["length", "doc_id", "start", "ids_crc32", "doc_tokens"],
            ascending=[False, True, True, True, True], kind="stable", ignore_index=True,
        )
        length = pieces["length"].to_numpy()
        whole = int((length == capacity).sum())
        item, start, size, window = pack_rests(length[whole:], capacity)
        item = np.concatenate([np.arange(whole), whole + item]).astype(np.int64)
        start = np.concatenate([np.zeros(whole, np.int64), start])
        size = np.concatenate([length[:whole], size])
        window = np.concatenate([np.arange(whole), whole + window]).astype(np.int64)
        order = np.lexsort((start, item, window))
        item, start, size, window = item[order], start[order], size[order], window[order]
        before = np.cumsum(size) - size
        new = np.append(True, window[1:] != window[:-1])
        out = pieces.iloc[item].drop(columns="shard").reset_index(drop=True)
        crc = out["ids_crc32"].to_numpy(copy=True)
        for row in np.flatnonzero(size < out["length"].to_numpy()).tolist():
            marks, end = np.frombuffer(out.at[row, "marks"], "<u4"), int(start[row] + size[row])
            through = int(crc[row]) if end == out.at[row, "length"] else int(marks[end // GRID])
            crc[row] = checksum_between(int(marks[start[row] // GRID]), through, int(size[row]))
        return out.drop(columns="marks").assign(
            start=out["start"] + start, length=size, ids_crc32=crc,
            sequence_id=(int(key[0]) << 32) + window,
            offset=before - np.maximum.accumulate(np.where(new, before, 0)),
        )

    return pack


def pack_documents(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES
) -> DataFrame:
    """Every piece of every document with its sequence and the offset there.

    A null text is an empty one (its document is the end id alone), a null id stays null, repeated
    rows are documents of their own, and an empty table gives no pieces. Very long texts are whole
    windows and one rest. Ties are ordered by id, start and checksum, so sequences depend on the rows
    alone. Other columns are not read.
    """
    pieces = cut_lineage(token_pieces(docs, tokenizer_path, capacity))
    shards = max(1, -(-pieces.count() // shard_pieces))
    # Copies of one piece are counted and numbered, so that the deal is the same for every layout.
    same = pieces.groupBy(*pieces.columns).agg(F.count(F.lit(1)).alias("copies"))
    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")
    dealt = same.select(*pieces.columns, copy).withColumn(
        "shard", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "copy"), F.lit(shards))
    ).drop("copy")
    packed = dealt.groupBy("shard").applyInPandas(_pack(capacity), PACKED)
    return packed.withColumn("doc_id", F.col("doc_id").cast("long"))
