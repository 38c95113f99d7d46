"""Reproducible randomness as a pure function of a key, independent of partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def hash_uniform(key: Column, seed: int | str | Column) -> Column:
    """Uniform value in [0, 1) from the first 32 bits of ``md5(key ':' seed)``."""
    salt = seed if isinstance(seed, Column) else F.lit(str(seed))
    digest = F.md5(F.concat(key.cast("string"), F.lit(":"), salt.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(TWO_32)


def entity_weight(key: Column, seed: int | str) -> Column:
    """Random whole weight in [200, 599]."""
    return (F.floor(hash_uniform(key, seed) * 400) + 200).cast("double")


# Rounds of the keyed permutation, and the row counts tried for its grid.
PERMUTATION_ROUNDS = 6
GRID_TRIES = 64


def permutation_grid(size: Column) -> Column:
    """``struct(over, rows, cols)``: the near-square grid that holds ``size`` cells with the fewest over."""
    side = F.ceil(F.sqrt(size.cast("double")))
    # A side of one would leave rotations only, so sides stay above half the square's.
    least = F.greatest(side - (GRID_TRIES - 1), F.floor(side / 2) + 1)
    tried = F.sequence(least, F.greatest(side, least))

    def grid(rows: Column) -> Column:
        cols = F.ceil(size / rows)
        return F.struct((rows * cols - size).alias("over"), rows.alias("rows"), cols.alias("cols"))

    return F.array_min(F.transform(tried, grid))


def permuted_cell(cell: Column, grid: Column, key: Column, seed: int | str) -> Column:
    """Where a keyed permutation of the grid's cells sends ``cell``.

    A Feistel network whose halves are the row and the column: each round shifts one of them by a
    hash of the other, so every key gives a permutation without any table of it.
    """
    start = F.struct(
        F.floor(cell / grid["cols"]).alias("x"), (cell % grid["cols"]).alias("y"),
        grid["rows"].alias("m"), grid["cols"].alias("n"),
    )

    def step(state: Column, turn: Column) -> Column:
        shift = hash_uniform(F.concat_ws(":", key.cast("string"), turn.cast("string"), state["y"].cast("string")), seed)
        moved = (state["x"] + F.floor(shift * state["m"])) % state["m"]
        return F.struct(
            state["y"].alias("x"), moved.alias("y"), state["n"].alias("m"), state["m"].alias("n")
        )

    turns = F.sequence(F.lit(0), F.lit(PERMUTATION_ROUNDS - 1))
    end = F.aggregate(turns, start, step)
    return end["x"] * grid["cols"] + end["y"]


def distinct_draws(size: Column, need: Column, key: Column, seed: int | str) -> Column:
    """``need`` distinct whole numbers in ``[0, size)`` in the order of the key's own permutation.

    The permuted grid less the cells beyond ``size`` is a permutation of what is left; as many cells
    more are walked as lie beyond, so the number is always made up. Draws of different keys are
    independent. No more than ``size`` are given.
    """
    # The one-element array holds the grid, so that it is sought once a row and not once a cell.
    return F.flatten(F.transform(
        F.array(permutation_grid(size)), lambda grid: _draws_on(grid, size, need, key, seed)
    ))


def _draws_on(grid: Column, size: Column, need: Column, key: Column, seed: int | str) -> Column:
    walked = F.least(need.cast("long") + grid["over"], size + grid["over"])
    cells = F.transform(
        F.sequence(F.lit(0).cast("long"), walked - 1), lambda cell: permuted_cell(cell, grid, key, seed)
    )
    inside = F.slice(F.filter(cells, lambda place: place < size), 1, F.least(need.cast("int"), size.cast("int")))
    return F.when((size > 0) & (need > 0), inside).otherwise(F.array().cast("array<bigint>"))
