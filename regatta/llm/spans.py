"""Spans of patterns as Spark expressions: code point offsets, digests, replacement. No Python workers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,value:string>"
NO_SPANS = f"array<{SPAN}>"


def no_spans() -> Column:
    return F.array().cast(NO_SPANS)


def pattern_spans(text: Column, pattern: Column) -> Column:
    """Leftmost non-overlapping matches as ``(start, end, value)``, offsets in code points.

    What stands between matches and the matches themselves add up to the offsets.
    """
    between = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, pattern, 0)
    pieces = F.arrays_zip(between.alias("gap"), found.alias("hit"))
    empty = F.struct(F.lit(0).alias("at"), no_spans().alias("spans"))

    def step(state: Column, piece: Column) -> Column:
        start = state["at"] + F.char_length(piece["gap"])
        end = start + F.char_length(piece["hit"])
        span = F.struct(start.alias("start"), end.alias("end"), piece["hit"].alias("value"))
        return F.when(
            piece["hit"].isNotNull(),
            F.struct(end.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans")),
        ).otherwise(state)

    return F.when(F.size(found) == 0, no_spans()).otherwise(
        F.aggregate(pieces, empty, step, lambda s: s["spans"])
    )


def listed(kind: str, spans: Column) -> Column:
    """``kind:start:end`` of every span."""
    return F.transform(
        spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string"))
    )


def tagged(kind: str, spans: Column) -> Column:
    return F.transform(
        spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"),
                                  F.lit(kind).alias("kind"))
    )


def apart_from(spans: Column, others: Column) -> Column:
    """Those spans that share no character with any of the others."""
    return F.filter(spans, lambda s: ~F.exists(
        others, lambda o: (s["start"] < o["end"]) & (o["start"] < s["end"])
    ))


def masked(text: Column, tags: Column) -> Column:
    """The text with every tagged span as ``[KIND]``; of overlapping ones the first gives the name."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(state: Column, tag: Column) -> Column:
        fresh = F.struct(
            tag["end"].alias("at"),
            F.concat(state["parts"], F.array(
                F.substring(text, state["at"] + 1, tag["start"] - state["at"]),
                F.concat(F.lit("["), F.upper(tag["kind"]), F.lit("]")),
            )).alias("parts"),
        )
        inside = F.struct(F.greatest(state["at"], tag["end"]).alias("at"), state["parts"].alias("parts"))
        return F.when(tag["start"] >= state["at"], fresh).otherwise(inside)

    def end(state: Column) -> Column:
        rest = F.substring(text, state["at"] + 1, F.char_length(text))
        return F.concat(F.array_join(state["parts"], ""), rest)

    return F.when(F.size(tags) == 0, text).otherwise(F.aggregate(F.array_sort(tags), start, step, end))
