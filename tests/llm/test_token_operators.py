from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from helpers import odd_documents, prose
from tokenizers import Tokenizer

from regatta.llm import queries, token_alignment, token_counts
from regatta.llm.chunks import WHITE, Memory

A = public_tokenizers.path("byte_bpe_50k.json")
B = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    " ", " ", *WHITE, "\x1c", "\x1f", "​", "᠎", "a", "B", "é", "漢", "\U0001f600", "'s", "'ll", "'", "1", "²",
    "_", "!", "́", "<|endoftext|>", "<|", "<s>", "<unk>", "<0x41>", "न", "ि", "﻿", "\0", "the", " the",
]


def odd_texts(n=3000):
    rng = random.Random(3)
    texts = ["".join(rng.choices(ODD, k=rng.randint(0, 40))) for _ in range(n)]
    return texts + ["a" * 3000, "ab" * 2000 + "\n", " " * 700, "x" + " " * 300 + "y", "a\r\nb\r\n c", "▁a", prose(1, 900)]


# Token counts


def test_counts_are_those_of_the_library():
    library = Tokenizer.from_file(A)
    counter = token_counts.TokenCounter(A)
    texts = odd_texts()
    assert counter.count_all(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_the_heap_follows_the_ranks_where_merges_compete():
    counter = token_counts.TokenCounter(A)
    counter.ids = {c: i for i, c in enumerate("abc")}
    # ab, bc, then ab+c: in "abcabc" both ab merge first although bc stands lower than abc.
    counter.rank, counter.made = {(0, 1): 0, (1, 2): 1, (3, 2): 2}, [3, 4, 5]
    assert [counter.merged(t) for t in ("", "a", "abc", "bcab", "abcabc", "cba", "bbcc")] == [0, 1, 1, 2, 2, 3, 3]


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        token_counts.TokenCounter(public_tokenizers.path("word_bpe_49k.json"))


def test_memory_is_bounded_and_changes_no_count(monkeypatch):
    monkeypatch.setattr(token_counts, "MEMORY", 40)
    counter = token_counts.TokenCounter(A)
    texts = [prose(i, 50) for i in range(30)]
    whole = token_counts.TokenCounter(A)
    for text in texts:
        assert counter.count_all([text]) == whole.count_all([text])
        assert len(counter.known.now) < 120 and len(counter.known.older) < 120


def test_memory_takes_over_what_is_still_used():
    memory = Memory(1)
    memory.now = {"a": 1, "b": 2}
    memory.turn()
    assert memory.missing({"a", "c"}) == {"c"} and memory.now == {"a": 1} and memory.older == {"a": 1, "b": 2}


def test_counts_of_documents(spark, sf_dir):
    library = Tokenizer.from_file(A)
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op13_token_counts(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n = len(library.encode(docs[r["doc_id"]] or "", add_special_tokens=False).ids)
        assert (r["n_tokens"], r["over_limit"]) == (n, n > 1024)
        assert r["n_bytes"] == len((docs[r["doc_id"]] or "").encode())
    odd = odd_documents(spark)
    counted = token_counts.count_tokens(odd.withColumnRenamed("fp", "n_tokens"), A)
    assert Counter(r["n_bytes"] for r in counted.collect()) == Counter(
        len((r["text"] or "").encode()) for r in odd.collect()
    )
    assert counted.where("doc_id IS NULL").count() == 2
    assert token_counts.count_tokens(odd.limit(0), A).count() == 0


# Alignment


def coded(text):
    """Ids in both vocabularies, none where one does not spell the text."""
    library = coded.a
    octets = (" " + text).encode()
    a, b = library.a.encode(" " + text, add_special_tokens=False).ids, library.b.encode(text)
    spelled = all(
        b"".join(table[i] for i in ids) == octets for table, ids in ((library.a_bytes, a), (library.b_bytes, b))
    )
    return (a, b) if text and spelled else ([], [])


coded.a = token_alignment.Alphabet(A, B)


def plain_groups(text):
    """Groups and linked pairs by walking over the bytes."""
    a, b = coded(text)
    ends = [dict(zip(np.cumsum([len(t[i]) for i in ids]).tolist(), ids))
            for t, ids in ((coded.a.a_bytes, a), (coded.a.b_bytes, b))]
    groups, pairs, now = [], [], ([], [])
    for at in range(1, len((" " + text).encode()) + 1):
        for side in (0, 1):
            if at in ends[side]:
                now[side].append(ends[side][at])
        if at in ends[0] and at in ends[1]:
            groups.append(now)
            pairs.append((ends[0][at], ends[1][at]))
            now = ([], [])
    return a, b, groups, pairs


def plain_report(texts):
    aligned = [plain_groups(t or "") for t in texts]
    counts = Counter(p for _, _, _, pairs in aligned for p in pairs)
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(n, most.get(b, 0))
    out = []
    for a, b, groups, pairs in aligned:
        shown = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        out.append((
            len(a), len(b), len(groups), len(pairs), sum(counts[p] == most[p[1]] for p in pairs),
            sum(counts[p] for p in pairs), hashlib.sha256(shown.encode()).hexdigest() if a else "",
        ))
    return out


FIELDS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_ids_are_those_of_the_libraries():
    coder = token_alignment.PairCoder(A, B)
    texts = odd_texts()
    for text, (a, b) in zip(texts, coder.code_all(texts)):
        assert (np.frombuffer(a, "<u4").tolist(), np.frombuffer(b, "<u4").tolist()) == coded(text)


def test_every_link_is_one_of_the_numbered_pairs():
    texts = odd_texts(300)
    numbers = {(int(p) >> 32, int(p) & 0xFFFFFFFF) for p in coded.a.pairs}
    assert len(numbers) == len(coded.a.pairs) < 400_000
    assert {p for t in texts for p in plain_groups(t)[3]} <= numbers


def test_pieces_of_any_work_give_the_same_ends():
    rng = np.random.default_rng(4)
    for _ in range(300):
        a, b = (np.unique(rng.integers(0, 60, rng.integers(0, 40))) for _ in range(2))
        both = np.intersect1d(a, b).tolist()
        for work in (1, 2, 3, 7, 1000):
            cut_a, cut_b = token_alignment.diagonal_cuts(a, b, work)
            pieces = np.diff(cut_a) + np.diff(cut_b)
            assert (pieces[:-1] == work).all() and pieces.sum() == len(a) + len(b)
            at_a, at_b = token_alignment.common_ends(a, b, work)
            assert a[at_a].tolist() == b[at_b].tolist() == both


@pytest.mark.parametrize("work", [5, token_alignment.PIECE_WORK])
def test_alignment_against_a_walk_over_the_bytes(spark, work, monkeypatch):
    monkeypatch.setattr(token_alignment, "PIECE_WORK", work)
    texts = [None, *odd_texts(400), prose(2, 80), prose(2, 80)]
    rows = [(i if i % 50 else None, t, i, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, links long, a_ids string").repartition(3)
    digests = token_alignment.group_digests(token_alignment.align_documents(docs, A, B, work))
    got = token_alignment.rate_links(digests, A, B).collect()
    want = plain_report(texts)
    assert Counter((r["doc_id"], *(r[f] for f in FIELDS)) for r in got) == Counter(
        (row[0], *w) for row, w in zip(rows, want)
    )


def test_alignment_of_documents(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r["doc_id"]: tuple(r[f] for f in FIELDS) for r in queries.op12_token_alignment(spark, sf_dir).collect()}
    assert got == dict(zip(docs, plain_report(docs.values())))
    none = token_alignment.alignment_report(odd_documents(spark).limit(0), A, B)
    assert none.count() == 0


def test_sentencepiece_is_read_without_its_own_threads():
    model = sentencepiece.SentencePieceProcessor(model_file=B)
    assert model.encode("a b", num_threads=1) == model.encode("a b")
