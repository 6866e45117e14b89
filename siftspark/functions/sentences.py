"""Sentences of at most a number of characters, in Arrow batches of the chunker.

Where a sentence has to be taken apart depends on what fits before, a fold over its parts: each
part gets the number of the piece it goes to, and pieces are joined afterwards.
"""

from __future__ import annotations

import re
from itertools import accumulate, groupby

from siftspark.functions.text import CLOSERS

# What ends a sentence, and where a long one may be taken apart, with what stands between joined parts.
_END = re.compile(rf"((?:(?<!\d)\.|\.(?!\d)|[!?。！？])[{re.escape(CLOSERS)}]*)")
_BREAKS = ((r"[；;]", ";"), (r"[，,]", ","), (r"\s+", " "))


def split(text: str | None, most: int = 800) -> list[tuple[str, bool]]:
    """Sentences of at most ``most`` characters, each with a flag: it was cut hard."""
    lines = (x.strip() for x in _END.sub(lambda m: m[0] + "\n", text or "").split("\n"))
    return [piece for x in lines if x for piece in pieces(x, most)]


def pieces(sentence: str, most: int) -> list[tuple[str, bool]]:
    """The sentence if it fits; else its parts between semicolons, else commas, else spaces, as many to a piece as fit; what is still too long in slices."""
    mark, joint = next(((m, j) for m, j in _BREAKS if len(sentence) > most and re.search(m, sentence)), (None, ""))
    parts = [sentence] if mark is None else [x for x in map(str.strip, re.split(mark, sentence)) if x]
    numbers = piece_numbers([len(x) for x in parts], most, len(joint))
    whole = [joint.join(x for _, x in group) for _, group in groupby(zip(numbers, parts, strict=True), key=lambda t: t[0])]
    return [(x[k : k + most], len(x) > most) for x in whole for k in range(0, len(x), most)]


def piece_numbers(sizes: list[int], most: int, between: int, joint_counts: bool = True, members: int | None = None) -> list[int]:
    """The piece of each part: that of the part before if both fit with what stands between, else a new one.

    joint_counts: what would stand before the part counts against ``most``; members: parts of a piece at most.
    """

    def step(at: tuple[int, int, int], n: int) -> tuple[int, int, int]:
        number, used, count = at
        fits = used + n + between * joint_counts <= most and (members is None or count < members)
        return (number, used + between + n, count + 1) if count and fits else (number + 1, n, 1)

    return [number for number, *_ in accumulate(sizes, step, initial=(0, 0, 0))][1:]
