from __future__ import annotations

import random

import numpy as np
import public_tokenizers
from helpers import odd_documents, prose

from regatta.llm import piece_codec, queries
from regatta.llm.piece_codec import BYTE_SCORE, LANE, SPACE, PieceCodec

PATH = public_tokenizers.path("piece_bpe_32k.model")


def worth(codec, ids):
    return sum(codec.pieces[codec.text[i]][0] if i in codec.text else BYTE_SCORE for i in ids)


def plain_best(codec, text):
    best = [0.0]
    for end in range(1, len(text) + 1):
        hits = [best[s] + codec.pieces[text[s:end]][0] for s in range(max(0, end - codec.longest), end)
                if text[s:end] in codec.pieces]
        best.append(max(hits) if hits else best[end - 1] + BYTE_SCORE * len(text[end - 1].encode()))
    return best[-1]


def test_the_best_path_and_an_exact_round_trip():
    codec = PieceCodec(PATH)
    for text in ("", "a  b ▁ c\n\té😀\0 漢字", "x" * 700 + " y", "abc" * 300, " lead", "%%% $$$$ &&", prose(1, 60)):
        ids = codec.encode(text)
        assert codec.decode(ids) == text
        if SPACE not in text:
            assert abs(worth(codec, ids) - plain_best(codec, SPACE + text.replace(" ", SPACE))) < 1e-6


def test_parts_are_committed_before_the_end():
    codec = PieceCodec(PATH)
    parts = list(codec.viterbi("abcdefghij" * 200))
    assert len(parts) > 10 and codec.decode(codec.encode("q")) == "q"


def test_lanes_take_the_steps_of_a_lone_walk():
    codec = PieceCodec(PATH)
    rng = random.Random(4)
    letters = ["a", "e", "n", "t", "s", "th", "ing", "é", "漢", "😀", "\n", "0", ".", "\0", SPACE]
    words = {SPACE * rng.randint(0, 3) + "".join(rng.choices(letters[:-1], k=rng.randint(1, 25))) for _ in range(3000)}
    words |= {SPACE, SPACE * 60, "q", "x" * 64}
    codec._learn([w for w in words if len(w) <= LANE])
    for word in words:
        if len(word) <= LANE:
            alone = [i for part in codec.viterbi(word) for i in part]
            assert np.frombuffer(codec.known[word], "<u4").tolist() == alone


def test_what_is_remembered_stays_bounded(monkeypatch):
    monkeypatch.setattr(piece_codec, "MEMORY", 50)
    codec = PieceCodec(PATH)
    texts = [" ".join(f"w{i}{j}" for j in range(60)) + " " + "y" * 200 for i in range(5)]
    whole = PieceCodec(PATH).encode_all(texts)
    for text, ids in zip(texts, whole):
        assert codec.encode(text) == ids.tolist()
        assert len(codec.known) < 120 and max(len(w or "") for w in codec.known) <= LANE


def test_documents(spark, sf_dir):
    rows = queries.op4_sentencepiece(spark, sf_dir).collect()
    assert rows and all(r["round_trip"] and r["n_ids"] > 0 for r in rows)
    docs = odd_documents(spark)
    coded = piece_codec.encode_documents(docs, PATH).collect()
    assert len(coded) == docs.count() and all(r["round_trip"] and r["n_ids"] > 0 for r in coded)
    assert piece_codec.encode_documents(docs.limit(0), PATH).count() == 0
