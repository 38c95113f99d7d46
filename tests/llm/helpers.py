"""Small tables with everything that may go wrong in them, and plain versions of the operators."""

from __future__ import annotations

WORDS = "the of and that with from river stone house winter garden bridge silver morning letter".split()


def prose(seed: int, n: int) -> str:
    state, out = seed * 7919 + 17, []
    for _ in range(n):
        state = (state * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(state >> 8) % len(WORDS)] + "abcdefghij"[(state >> 16) % 10])
    return " ".join(out)


def odd_documents(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and a column named like the operators' own."""
    long_text = prose(5, 40_000)
    rows = [
        (1, None, "en", 0), (2, "", None, 1), (None, prose(1, 60), "en", 2), (None, None, None, 3),
        (4, long_text, "en", 4), (5, prose(2, 80), "en", 5), (5, prose(2, 80), "en", 5),
        (6, prose(2, 80), "en", 6), (7, "12 !! 34", "de", 7), (8, " \t\n ", "de", 8),
        (9, prose(3, 80) + "\n" + "x" * 5000, "de", 9), ((1 << 60) + 1, prose(4, 70), "en", 10),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, shard long")
    return frame.selectExpr("*", "'s' AS source", "length(text) AS n_chars", "1 AS fp", "'x' AS _llm")
