"""Stretches of text that byte-level and piece vocabularies code alike alone and in their text.

A stretch is a run of white space and the run of other characters behind it. The pretoken pattern of
byte-level vocabularies looks neither back over such a border nor, in the words before it, ahead of
it, so the ids of a text are those of its stretches in order.
"""

from __future__ import annotations

import re

# The characters of Unicode's White_Space property.
WHITE = (
    " \t\n\x0b\x0c\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def cutter(white: str = WHITE) -> re.Pattern[str]:
    """``findall`` of the pattern gives the stretches of a text whose white space is all in ``white``."""
    some = re.escape(white)
    return re.compile(f"[{some}]*[^{some}]+|[{some}]+")


class Memory:
    """What was worked out of late, in two generations of about ``size`` entries each.

    ``now`` answers; ``turn`` is called between batches, and ``missing`` takes over what is still used
    of the older generation, so that the rest falls away with it.
    """

    def __init__(self, size: int):
        self.size = size
        self.now: dict = {}
        self.older: dict = {}

    def turn(self) -> None:
        if len(self.now) > self.size:
            self.now, self.older = {}, self.now

    def missing(self, keys: set) -> set:
        """The keys that have to be worked out."""
        new = keys.difference(self.now)
        found = [key for key in new if key in self.older]
        for key in found:
            self.now[key] = self.older[key]
        return new.difference(found)
