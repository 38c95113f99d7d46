from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from regatta.llm import queries, vector_codes
from regatta.llm.vector_codes import SlicedBook


def plain_codes(rows, parts=16, entries=64, rounds=2):
    """The contract in plain integers, entry by entry."""
    kept = [
        (i, [math.floor(256 * x) for x in v], label) for i, v, label in rows
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    kept.sort(key=lambda r: (r[0], r[1]))
    if not kept:
        return [], ""
    width = -(-max(len(v) for _, v, _ in kept) // parts)
    cut = [[(v + [0] * (parts * width - len(v)))[p * width: (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(p, part):
        return min((sum((x - y) ** 2 for x, y in zip(part, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        found = [[nearest(p, c[p])[1] for p in range(parts)] for c in cut]
        for p in range(parts):
            new = list(books[p])
            for k in range(len(books[p])):
                mine = [c[p] for c, f in zip(cut, found) if f[p] == k]
                if mine:
                    new[k] = [sum(x) // len(mine) for x in zip(*mine)]
            books[p] = new
    last = [[nearest(p, c[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in r) for r in last]
    labels = {}
    for (_, _, label), e in zip(kept, errors):
        labels[label] = labels.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [
        (i, "".join(f"{k:02x}" for _, k in r), e, labels[label])
        for (i, _, label), r, e in zip(kept, last, errors)
    ], digest


def collected(frame):
    rows = frame.collect()
    assert len({r["codebooks_sha256"] for r in rows}) <= 1
    return (sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in rows), key=repr),
            rows[0]["codebooks_sha256"] if rows else "")


def test_masks_keep_the_nearest_entry_and_ties_go_low():
    rng = np.random.default_rng(1)
    for n, width, spread in ((1, 1, 3), (2, 3, 2), (64, 4, 40), (64, 4, 3), (63, 7, 1000), (5, 2, 1 << 26)):
        entries = rng.integers(-spread, spread + 1, (n, width))
        parts = rng.integers(-2 * spread, 2 * spread + 1, (500, width))
        book = SlicedBook(entries)
        distance = ((parts[:, None] - entries[None]) ** 2).sum(2)
        got, squared = book.nearest(parts)
        assert (got == distance.argmin(1)).all() and (squared == distance.min(1)).all()
        mask = book.candidates(parts)
        assert ((mask >> got.astype(np.uint64)) & np.uint64(1)).all()


def test_masks_leave_few_entries(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("embedding").limit(400).collect()
    parts = np.floor(256 * np.array([r["embedding"] for r in rows], float)).astype(np.int64).reshape(-1, 4)
    mask = SlicedBook(parts[:64]).candidates(parts[64:])
    assert np.bitwise_count(mask).mean() < 16


def test_given_vectors_against_plain_integers(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    want, digest = plain_codes([(r["vec_id"], list(map(float, r["embedding"])), r["label"]) for r in rows])
    assert collected(queries.op11_vector_codes(spark, sf_dir)) == (sorted(want, key=repr), digest)


def test_odd_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=32)], i % 3 if i % 4 else None) for i in range(80)]
    rows += [(80, None, 1), (81, [math.nan] * 32, 1), (82, [None] + [0.0] * 31, None), (83, [math.inf] * 32, 2)]
    rows += [(84, rows[5][1], 2), (84, rows[5][1], 2), (85, [0.0] * 32, 2), (86, [-0.001] * 32, None)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long").selectExpr(
        "*", "1 AS code", "'y' AS error", "2 AS _vector"
    ).repartition(5)
    want, digest = plain_codes(rows)
    assert collected(vector_codes.code_report(frame)) == (sorted(want, key=repr), digest)
    assert vector_codes.code_report(frame.limit(0)).count() == 0
    few = spark.createDataFrame(rows[:3] + rows[80:84], frame.schema[:3])
    assert collected(vector_codes.code_report(few)) == (sorted(plain_codes(rows[:3])[0], key=repr), plain_codes(rows[:3])[1])


def test_lengths_that_differ_or_do_not_divide(spark):
    rows = [(1, [0.5] * 5, 1), (2, [], 1), (3, [0.25] * 18, None), (4, [0.5] * 5, 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long")
    want, digest = plain_codes(rows)
    assert collected(vector_codes.code_report(frame)) == (sorted(want, key=repr), digest)


def test_a_component_beyond_exact_sums_is_an_error(spark):
    frame = spark.createDataFrame([(1, [1e9] * 16, 1)], "vec_id long, embedding array<double>, label long")
    with pytest.raises(Exception, match="does not fit"):
        vector_codes.code_report(frame).collect()
