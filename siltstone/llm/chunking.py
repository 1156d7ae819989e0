"""Splitting oversized texts at natural boundaries by lexical cohesion.

A text is cut into units: blocks between blank lines, where a block is too long its lines, where a
line is too long its words, where a run without white space is too long equal stretches.  Between
neighbouring units, and inside a line that is too long between its sentences or blocks of words, the
similarity of the vocabulary before and after is taken over sliding windows; valleys of that curve
are topic boundaries.  Each piece ends at the deepest valley within reach, coarser boundaries
first, or at the last place where there is no valley, and the next piece begins with up to
``overlap`` characters of it, from a line's or word's start.  One record at a time: no shuffle, no state.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Boundaries from coarse to fine, in the order in which they are tried.
LEVELS = ("paragraph", "line", "word", "hard")
_WORD = re.compile(r"\w+")
_RUN = re.compile(r"\S+")
#: Where a sentence ends: a mark before white space, or a full-width one.
_SENTENCE = re.compile(r"[.!?\u2026\u0964\u061f][\"'\u2019\u201d)\]]*(?=\s)|[\u3002\uff01\uff1f][\u300d\u300f\u201d]*")
_WORD_START = re.compile(r"(?<=\s)\S")


def _blocks(text: str) -> list[tuple[int, int]]:
    """Start and end of every maximal run of lines that are not blank."""
    out, at, start, end = [], 0, -1, 0
    for line in text.split("\n"):
        if line.strip(" \t"):
            start = at if start < 0 else start
            end = at + len(line)
        elif start >= 0:
            out.append((start, end))
            start = -1
        at += len(line) + 1
    if start >= 0:
        out.append((start, end))
    return out


def _stretch(low: int, high: int, limit: int) -> list[int]:
    """Places inside a stretch without any boundary, close enough for pieces of ``limit``."""
    return list(range(low + max(1, limit // 2), high, max(1, limit // 2)))


def cuts_of(text: str, limit: int) -> list[tuple[int, int, bool]]:
    """Allowed cut positions with their level, and whether the cut lies inside a blank line over the limit.

    Before a unit, finer only inside units that are too long; after a unit only where the next one's start would be out of reach.
    """
    cuts: list[tuple[int, int, bool]] = []
    blocks = _blocks(text)
    for (start, end), (following, _) in zip(blocks, [*blocks[1:], (len(text), 0)], strict=False):
        cuts.append((start, 0, False))
        if end - start > limit:
            at = start
            for line in text[start:end].split("\n"):
                if at > start:
                    cuts.append((at, 1, False))
                if len(line) == limit:
                    cuts.append((at + len(line), 1, False))
                elif len(line) > limit:
                    cuts.extend((at + p, level, False) for p, level in _line_cuts(line, limit))
                at += len(line) + 1
        if following - start > limit:
            cuts.append((end, 0, False))
    for low, high in zip([0, *(e for _, e in blocks)], [*(s for s, _ in blocks), len(text)], strict=True):
        if high - low > limit:  # blank lines between two blocks, or at an end of the text
            at = low
            for line in text[low:high].split("\n"):
                cuts.append((at, 0, False))
                cuts.extend((p, 0, True) for p in _stretch(at, at + len(line), limit) if len(line) > limit)
                cuts.append((at + len(line), 0, False))
                at += len(line) + 1
    return sorted(set(cuts))


def _line_cuts(line: str, limit: int) -> list[tuple[int, int]]:
    """Cuts inside a line over the limit: at its words, and inside runs without white space that are over the limit."""
    cuts: list[tuple[int, int]] = []
    breaks = breaks_of(line, max(1, limit // 10))
    runs = [m.span() for m in _RUN.finditer(line)]
    for (start, end), (following, _) in zip(runs, [*runs[1:], (len(line) + 1, 0)], strict=False):
        if start:
            cuts.append((start, 2))
        if end - start > limit:
            inner = {*_stretch(start, end, limit), *(p for p in breaks if start < p < end)}
            cuts.extend((p, 3) for p in sorted(inner))
        if following - start > limit:
            cuts.append((end, 2))
    for low, high in zip([0, *(e for _, e in runs)], [*(s for s, _ in runs), len(line) + 1], strict=True):
        if high - low > limit:
            cuts.extend((p, 2) for p in _stretch(low, min(high, len(line)), limit))
    return cuts


def breaks_of(line: str, block: int) -> list[int]:
    """Places inside a long line where vocabulary is compared: before sentences, and in sentences over two blocks about every ``block`` characters."""
    starts = sorted({m.start() for end in _SENTENCE.finditer(line) if (m := _RUN.search(line, end.end()))})
    out: list[int] = []
    for low, high in zip([0, *starts], [*starts, len(line)], strict=True):
        at = low
        while high - at > 2 * block:
            word = _WORD_START.search(line, at + block, at + 2 * block)
            at = word.start() if word else at + block
            out.append(at)
        if high < len(line):
            out.append(high)
    return out


def candidates_of(text: str, cuts: list[tuple[int, int, bool]], limit: int) -> list[int]:
    """The cut positions whose valleys are computed: every block and line, and the breaks inside lines that are too long."""
    fine, at = set(), 0
    for line in text.split("\n"):
        if len(line) > limit:
            fine.update(at + p for p in breaks_of(line, max(1, limit // 10)))
        at += len(line) + 1
    return sorted({p for p, level, blank in cuts if (level < 2 or p in fine) and not blank})


def _bag(text: str) -> Counter:
    """Vocabulary of a stretch: words, and for words of scripts without spaces their trigrams."""
    bag: Counter = Counter()
    for word in _WORD.findall(text.lower()):
        if len(word) > 12 and not word.isascii():
            bag.update(word[i : i + 3] for i in range(len(word) - 2))
        elif len(word) > 2:
            bag[word] += 1
    return bag


def _cosine(a: Counter, b: Counter) -> float:
    dot = sum(n * b[w] for w, n in a.items() if w in b)
    return dot / (sum(n * n for n in a.values()) * sum(n * n for n in b.values())) ** 0.5 if dot else 0.0


def valley_depths(text: str, positions: list[int], window: int) -> np.ndarray:
    """Depth of the cohesion valley at each position: how far the similarity rises to either side."""
    edges = [0, *positions, len(text)]
    bags = [_bag(text[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
    sizes = [b - a for a, b in zip(edges, edges[1:], strict=False)]
    similar = []
    for i in range(1, len(bags)):
        left, right, n, m = Counter(), Counter(), 0, 0
        for j in range(i - 1, -1, -1):
            left.update(bags[j])
            if (n := n + sizes[j]) >= window:
                break
        for j in range(i, len(bags)):
            right.update(bags[j])
            if (m := m + sizes[j]) >= window:
                break
        similar.append(_cosine(left, right))
    s = np.asarray(similar)
    depth = np.zeros(len(s))
    for i in range(len(s)):
        peak_left, j = s[i], i - 1
        while j >= 0 and s[j] >= peak_left:
            peak_left, j = s[j], j - 1
        peak_right, j = s[i], i + 1
        while j < len(s) and s[j] >= peak_right:
            peak_right, j = s[j], j + 1
        depth[i] = peak_left + peak_right - 2 * s[i]
    return depth


def _pieces(text: str, limit: int, overlap: int, window: int) -> list[tuple[int, int, int, int, bool]]:
    """Pieces as (start, end, start of what is new, level of the cut that ends it or -1, whether that cut is inside a blank line)."""
    if len(text) <= limit:
        return [(0, len(text), 0, -1, False)]
    cuts = [c for c in cuts_of(text, limit) if 0 < c[0] < len(text)]
    compared = candidates_of(text, cuts, limit)
    depth = dict(zip(compared, valley_depths(text, compared, window), strict=True))
    places = np.array([c[0] for c in cuts] or [0])
    pieces, start = [], 0
    while True:
        # a piece repeats up to `overlap` characters of the one before, from a word's start if there is one
        begin = start
        if start:
            low = max(pieces[-1][0] + 1, start - overlap)
            found = re.search(r"(?<=\n)\S|(?<=\s)\S", text[low:start])
            begin = low + found.start() if found else (low if not re.search(r"\s", text[low:start]) else start)
        if len(text) - begin <= limit or len(text) - start <= limit:
            begin = max(begin, len(text) - limit)
            pieces.append((begin, len(text), start, -1, False))
            return pieces
        far = start + limit
        reach = cuts[np.searchsorted(places, start, "right") : np.searchsorted(places, far, "right")]
        level = min(own for _, own, _ in reach)  # cuts are close enough for one to be always in reach
        near = [(p, blank) for p, own, blank in reach if own == level]
        late = [c for c in near if c[0] >= start + limit // 2] or near
        end, blank = max(late, key=lambda c: (round(depth.get(c[0], 0.0), 9), c[0]))
        begin = max(begin, end - limit)
        pieces.append((begin, end, start, level, blank))
        start = end


def split_text(text: str, limit: int, overlap: int, window: int = 400) -> list[tuple[int, int, int, str]]:
    """Pieces as (start, end, start of what is new, level of the cut that ends it)."""
    return [(begin, end, new, LEVELS[level] if level >= 0 else "end") for begin, end, new, level, _ in _pieces(text, limit, overlap, window)]


def _coarsest(pieces: list[tuple[int, int, int, int, bool]]) -> str:
    """The coarsest level that was enough for every cut; a blank line over the limit is one only where no block had to be cut."""
    finest = max(0, *(level for *_, level, _ in pieces))
    return LEVELS[max(finest, 2) if finest and any(blank for *_, blank in pieces) else finest]


def boundary_of(text: str, limit: int, overlap: int = 0, window: int = 400) -> str:
    """The coarsest level at which every unit of the text is within the limit, read off the cuts of its pieces."""
    return _coarsest(_pieces(text, limit, overlap, window))


def chunks(records: DataFrame, id_cols: list[str], text: str, *, limit: int = 2000, overlap: int = 200, window: int = 400) -> DataFrame:
    """``(*id_cols, piece_no, start, new_from, end, cut, boundary, piece)`` of every text over ``limit``.

    A text is oversized if it has more than ``limit`` code points, CR counted; CRLF is then
    read as LF, and ``start``, ``new_from`` and ``end`` are places in that text: from
    ``new_from`` on a piece is new, before it overlap.  New parts joined in order give the text
    back.  ``cut`` is the kind of boundary that ends the piece, ``boundary`` the coarsest level that was
    enough for all the text's cuts.  Nulls, empty and short texts give no pieces;
    repeated rows (of ids and text) count once; other columns are ignored.
    """
    kept = records.select(*id_cols, F.col(text).alias("__text")).where(F.length("__text") > limit).dropDuplicates([*id_cols, "__text"])
    fields = ", ".join(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in id_cols)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 200):
                rows = []
                part = pdf.iloc[lo : lo + 200]
                for *ids, raw in part[[*id_cols, "__text"]].itertuples(index=False, name=None):
                    body = raw.replace("\r\n", "\n")
                    pieces = _pieces(body, limit, overlap, window)
                    boundary = _coarsest(pieces)
                    for n, (begin, end, new, level, _) in enumerate(pieces):
                        rows.append((*ids, n, begin, new, end, LEVELS[level] if level >= 0 else "end", boundary, body[begin:end]))
                yield pd.DataFrame(rows, columns=[*id_cols, "piece_no", "start", "new_from", "end", "cut", "boundary", "piece"])

    return kept.mapInPandas(cut, f"{fields}, piece_no int, start int, new_from int, end int, cut string, boundary string, piece string")
