"""Structure of texts, and column expressions on them. Offsets are code points from 0.

How a text is laid out depends on regular expressions, on what counts as a line or as white
space, and on a running size that starts again at each cut. These are plain functions
of one text, applied in one Arrow stage per operator: each text is looked at once, and no
row of it is ever shuffled.
"""

from __future__ import annotations

import itertools
import re
from bisect import bisect_left, bisect_right

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The marks of each structure.
DOC = r"(?:-{3,}|={3,}|#{1,2} |<\|doc\||\x0c)"
HEADING = r"#{1,6} "
DEFINITION = r"(?:def |class |async def )"
BLANK = r"\n[ \t]*\n"
SAMPLE, ROW_LINES = 200_000, 200
_DOC, _HEADING, _DEFINITION = (re.compile("^" + p, re.M) for p in (DOC, HEADING + ".*$", DEFINITION))
_BLANK = re.compile(BLANK)


def structure(text: str) -> str:
    """code, sections, rows, paragraphs or lines, by the first SAMPLE characters."""
    sample = text[:SAMPLE]
    if _DEFINITION.search(sample):
        return "code"
    if _HEADING.search(sample):
        return "sections"
    lines = sample.splitlines()
    first = lines[:ROW_LINES]
    if len(lines) >= 8 and sum(max(x.count("|"), x.count("\t")) >= 2 for x in first) >= 0.6 * len(first):
        return "rows"
    return "paragraphs" if _BLANK.search(sample) else "lines"


def unit_ends(text: str, kind: str) -> list[int]:
    """The ends of the units, non-blank spans that tile the text from 0 on; none where the text is blank.

    Units begin at the marks of the structure, and at document marks in any. A blank
    stretch belongs to the unit before it, a leading one to the first.
    """
    marks = {0, *(m.start() for m in _DOC.finditer(text))}
    if kind in ("code", "sections"):
        marks.update(m.start() for m in (_DEFINITION if kind == "code" else _HEADING).finditer(text))
    if kind in ("rows", "lines"):
        marks.update(itertools.accumulate(map(len, text.splitlines(keepends=True))))
    else:
        marks.update(m.end() for m in _BLANK.finditer(text))
    edges = sorted({*marks, len(text)})
    solid = [a for a, b in itertools.pairwise(edges) if not text[a:b].isspace()]
    return [*solid[1:], len(text)] if solid else []


def segment_spans(ends: list[int], low: int, target: int, high: int) -> list[tuple[int, int, int]]:
    """(start, end, units): units packed in order, each segment closed by the first unit that brings it to `target`.

    A unit above `high` begins a segment and is cut every `high` characters; what is left
    of it is packed with what follows. A last segment below `low` joins the one before.
    """
    large = [(a, b) for a, b in itertools.pairwise([0, *ends]) if b - a > high]
    forced = {x for a, b in large for x in range(a, b, high)} - {0}
    pieces, cuts = sorted({*ends, *forced}), [0]
    for stop in [*sorted(forced), *ends[-1:]]:
        while cuts[-1] < stop:
            at = bisect_left(pieces, cuts[-1] + target)
            cuts.append(min(stop, pieces[at] if at < len(pieces) else stop))
    if len(cuts) > 2 and cuts[-1] - cuts[-2] < low:
        del cuts[-2]
    return [(a, b, bisect_right(pieces, b) - bisect_right(pieces, a)) for a, b in itertools.pairwise(cuts)]


def part_cuts(ends: list[int], chars: int, slots: int) -> list[int]:
    """The ends of at most `slots` parts: for each proportional bound the nearest segment end behind the cut before, the smaller of two."""
    cuts, inner = [0], [e for e in ends if e < chars]
    for k in range(1, slots):
        later = inner[bisect_right(inner, cuts[-1]) :]
        if later:
            cuts.append(min(later, key=lambda e: abs(e - chars * k / slots)))
    return [*cuts[1:], chars] if chars else []


def strip(x: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(x, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def digest(x: Column, n: int = 16) -> Column:
    return F.substring(F.sha2(F.coalesce(x, F.lit("")), 256), 1, n)


def bare(x: Column) -> Column:
    """Without the decoration that models put around a value: three rounds of white space, quotes, marks and one full stop."""
    for _ in range(3):
        x = F.regexp_replace(strip(strip_chars(strip(x))), r"\.$", "")
    return strip(x)


def strip_chars(x: Column) -> Column:
    return F.regexp_replace(x, "^[`*\"']+|[`*\"']+$", "")
