"""SentencePiece encoding and decoding by streaming Viterbi.

A walk over the characters keeps, for each of the last ``max piece length`` boundaries, the best score
and the piece that leads there. Whenever all surviving paths pass one boundary, the ids before it are
committed and their back pointers go. The vocabulary holds merge ranks, not probabilities: a piece
counts ``-log(2 + rank)``; characters without a piece become bytes. A space opens pieces and never
stands behind another character in one, so paths always converge in front of it: the stretches between
such places are committed by themselves and remembered. New stretches of up to ``LANE`` characters take
their steps side by side, as lanes of one array; longer ones walk alone and test for convergence.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
BYTE_SCORE = -20.0
MEMORY = 200_000
COMMIT_EVERY = 64
# Characters of a stretch that is coded in a lane, lanes of one array, characters coded together.
LANE = 64
LANES = 8192
TOGETHER = 1 << 20
CODED = "doc_id long, n_ids long, ids_crc32 long, ids array<int>, round_trip boolean"
_STRETCH = re.compile(f"{SPACE}*[^{SPACE}]*")


class PieceCodec:
    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces: dict[str, tuple[float, int]] = {}
        self.text: dict[int, str] = {}
        self.bytes: dict[int, int] = {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.text[i] = piece
                # A space behind another character would join stretches that are coded apart.
                if SPACE not in piece.lstrip(SPACE):
                    self.pieces[piece] = (-math.log(2 + i), i)
        self.longest = max(map(len, self.pieces))
        self.byte_ids = np.array([self.bytes[b] for b in range(256)])
        self.written = [b""] * model.get_piece_size()
        for i, piece in self.text.items():
            self.written[i] = piece.replace(SPACE, " ").encode()
        for b, i in self.bytes.items():
            self.written[i] = bytes([b])
        self._lay_trie()
        self._forget()

    def _forget(self) -> None:
        # Ids of a stretch as packed little-endian numbers; None stands for a space mark of the text.
        self.known: dict[str | None, bytes] = {"": b"", None: _packed(self.bytes[b] for b in SPACE.encode())}

    def _lay_trie(self) -> None:
        """``first[class]`` and ``step[node, class]`` lead to nodes, 0 is none; classes stand for characters.

        Characters of longer pieces have the low classes, so the table is as wide as they are many.
        """
        inner = sorted({c for p in self.pieces if len(p) > 1 for c in p})
        alone = sorted({p for p in self.pieces if len(p) == 1} - set(inner))
        classes = {c: k for k, c in enumerate([*inner, *alone], 1)}
        self.inner = len(inner)
        self.class_of = np.zeros(max(map(ord, classes)) + 2, np.int32)
        for c, k in classes.items():
            self.class_of[ord(c)] = k
        nodes: dict[str, int] = {}
        for piece in self.pieces:
            for n in range(1, len(piece) + 1):
                nodes.setdefault(piece[:n], len(nodes) + 1)
        self.first = np.zeros(len(classes) + 1, np.int32)
        self.step = np.zeros((len(nodes) + 1, self.inner + 1), np.int32)
        self.worth = np.full(len(nodes) + 1, -math.inf)
        self.piece_at = np.zeros(len(nodes) + 1, np.int64)
        for prefix, node in nodes.items():
            if len(prefix) == 1:
                self.first[classes[prefix]] = node
            else:
                self.step[nodes[prefix[:-1]], classes[prefix[-1]]] = node
            if prefix in self.pieces:
                self.worth[node], self.piece_at[node] = self.pieces[prefix]

    def viterbi(self, text: str) -> Iterator[list[int]]:
        """Ids of a stretch, in the parts in which they are committed."""
        score, back = {0: 0.0}, {}
        done = 0
        for end in range(1, len(text) + 1):
            best, via = -math.inf, None
            for start in range(max(done, end - self.longest), end):
                hit = self.pieces.get(text[start:end])
                if hit is not None and (s := score[start] + hit[0]) > best:
                    best, via = s, (start, [hit[1]])
            if via is None:
                octets = text[end - 1].encode("utf-8", "replace")
                best = score[end - 1] + BYTE_SCORE * len(octets)
                via = (end - 1, [self.bytes[b] for b in octets])
            score[end], back[end] = best, via
            score.pop(end - self.longest - 1, None)
            if end % COMMIT_EVERY == 0 or end == len(text):
                alive = set(range(max(done, end - self.longest + 1), end + 1)) if end < len(text) else {end}
                while len(alive) > 1:
                    last = max(alive)
                    alive.discard(last)
                    alive.add(back[last][0] if last > done else done)
                meet = at = alive.pop()
                path = []
                while at > done:
                    at, ids = back[at]
                    path.append(ids)
                if path:
                    yield [i for ids in reversed(path) for i in ids]
                for gone in range(done + 1, meet + 1):
                    del back[gone]
                done = meet

    def _learn_lanes(self, words: list[str]) -> None:
        """Code short stretches side by side and remember them.

        Starts go up as in ``viterbi``, so sums and ties are the same.
        """
        sizes = np.array([len(w) for w in words])
        n, long = len(words), int(sizes.max())
        points = np.zeros((n, long), np.int64)
        points[np.arange(long) < sizes[:, None]] = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        classes = self.class_of[np.minimum(points, len(self.class_of) - 1)]
        deeper = np.where(classes <= self.inner, classes, 0)
        score = np.full((n, long + 1), -math.inf)
        score[:, 0] = 0.0
        width, item = np.ones((n, long + 1), np.int64), np.zeros((n, long + 1), np.int64)
        for start in range(long + 1):
            if start:
                # No piece ends here: the character before becomes bytes, kept as a negative item.
                bare = np.flatnonzero((score[:, start] == -math.inf) & (sizes >= start))
                point = points[bare, start - 1]
                score[bare, start] = score[bare, start - 1] + BYTE_SCORE * _octets(point)
                item[bare, start] = -1 - point
            lane = np.flatnonzero(sizes > start)
            if not len(lane):
                continue
            node = self.first[classes[lane, start]]
            for end in range(start + 1, min(start + self.longest, long) + 1):
                alive = node > 0
                lane, node = lane[alive], node[alive]
                if not len(lane):
                    break
                total = score[lane, start] + self.worth[node]
                better = total > score[lane, end]
                won = lane[better]
                score[won, end] = total[better]
                width[won, end] = end - start
                item[won, end] = self.piece_at[node[better]]
                if end < long:
                    alive = sizes[lane] > end
                    lane, node = lane[alive], node[alive]
                    node = self.step[node, deeper[lane, end]]
        at, path, lanes = sizes.copy(), [], []
        lane = np.arange(n)
        while len(lane):
            path.append(item[lane, at[lane]])
            lanes.append(lane)
            at[lane] -= width[lane, at[lane]]
            lane = lane[at[lane] > 0]
        # The paths were read from their ends: reversed, then brought together by lane.
        items, owner = np.concatenate(path[::-1]), np.concatenate(lanes[::-1])
        order = np.argsort(owner, kind="stable")
        items, owner = items[order], owner[order]
        times = np.where(items < 0, _octets(-1 - items), 1)
        ids = np.repeat(items, times)
        octets = "".join(map(chr, -1 - items[items < 0])).encode()
        ids[ids < 0] = self.byte_ids[np.frombuffer(octets, np.uint8)]
        ends = (4 * np.cumsum(np.bincount(owner, weights=times, minlength=n))).astype(int).tolist()
        packed = ids.astype("<u4").tobytes()
        self.known.update(zip(words, (packed[a:b] for a, b in zip([0, *ends], ends))))

    def _learn(self, stretches: Iterable[str | None]) -> None:
        new = sorted(set(stretches) - self.known.keys(), key=len)
        short = next((k for k, w in enumerate(new) if len(w) > LANE), len(new))
        for k in range(0, short, LANES):
            self._learn_lanes(new[k:min(k + LANES, short)])
        for stretch in new[short:]:
            self.known[stretch] = _packed(i for part in self.viterbi(stretch) for i in part)

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text; what is remembered is dropped when it outgrows ``MEMORY`` stretches."""
        if len(self.known) > MEMORY:
            self._forget()
        cut = [_stretches(text) for text in texts]
        self._learn(stretch for stretches in cut for stretch in stretches)
        known = self.known
        coded = [np.frombuffer(b"".join(map(known.__getitem__, stretches)), "<u4") for stretches in cut]
        for stretch in [w for stretches in cut for w in stretches if w is not None and len(w) > LANE]:
            known.pop(stretch, None)
        return coded

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.written.__getitem__, ids)).decode("utf-8", "replace")[1:]


def _packed(ids: Iterable[int]) -> bytes:
    return np.fromiter(ids, "<u4").tobytes()


def _octets(points: np.ndarray) -> np.ndarray:
    """UTF-8 bytes of each character."""
    return 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)


def _stretches(text: str) -> list[str | None]:
    # Space marks of the text itself become bytes; the parts between them are coded as ever.
    if SPACE not in text:
        return _STRETCH.findall(SPACE + text.replace(" ", SPACE))
    first, *rest = text.split(SPACE)
    out: list[str | None] = _STRETCH.findall(SPACE + first.replace(" ", SPACE))
    for part in rest:
        out.append(None)
        out += _STRETCH.findall(part.replace(" ", SPACE))
    return out


_WORKERS: dict[str, PieceCodec] = {}


def _coded(path: str):
    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _WORKERS.get(path) or _WORKERS.setdefault(path, PieceCodec(path))
        for batch in batches:
            keys, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            start = 0
            while start < len(texts):
                end, size = start + 1, len(texts[start])
                while end < len(texts) and size + len(texts[end]) <= TOGETHER:
                    size += len(texts[end])
                    end += 1
                part = texts[start:end]
                ids = codec.encode_all(part)
                counts = np.array([len(i) for i in ids], np.int64)
                flat = np.concatenate(ids).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    keys.slice(start, end - start),
                    pa.array(counts),
                    pa.array([zlib.crc32(i) for i in ids], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), flat),
                    pa.array([codec.decode(i.tolist()) == text for i, text in zip(ids, part)]),
                ], names=["doc_id", "n_ids", "ids_crc32", "ids", "round_trip"])
                start = end

    return coded


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """Ids of every whole text, with their count and digest, and whether decoding gives the text again.

    A null text is an empty one (its only id is the opening space); null ids stay null, repeated rows
    get equal ids, an empty table gives no rows. Other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(_coded(model_path), CODED)
