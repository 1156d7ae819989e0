"""Evaluation texts leaking into a corpus: winnowed fingerprints, joined and extended.

Both sides are lower-cased and reduced to letters and digits.  Of every ``span - k + 1``
neighbouring k-gram hashes the smallest is a fingerprint, so any shared run of ``span``
characters has a fingerprint in common.  The fingerprints of both sides are joined; for every pair of texts that
have one in common the longest run they share is found exactly, and runs of ``span`` and more are reported.

At scale the corpus is read once, whatever the size of the evaluation side, and what moves of it is decided by a
Bloom filter of the evaluation side's fingerprints: its size is bounded by ``filter_bits``, it only thins
the join out and never decides a result.  Texts without a fingerprint in the filter go no further.  A fingerprint that very many documents
hold is a skewed key of a plain join, which adaptive execution splits; repeats inside a text count once.
"""

from __future__ import annotations

import sys
import unicodedata
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.textprep import code_points, slices, window_hashes
from siltstone.storage import spread, stored

_kept: list[np.ndarray] = []


def kept_points() -> np.ndarray:
    """For every code point, whether it is a letter or a digit (Unicode categories L and N)."""
    if not _kept:
        _kept.append(np.fromiter((unicodedata.category(chr(c))[0] in "LN" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _kept[0]


def reduced(texts: list[str], keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters and digits of the lower-cased texts end to end, and the length of each."""
    points, lengths = code_points([t.lower() for t in texts])
    mask = keep[points]
    ends = np.cumsum(lengths)
    held = np.concatenate([[0], np.cumsum(mask)])
    return points[mask], held[ends] - held[ends - lengths]


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    width, low = 1, x
    while width * 2 <= w:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    rest = w - width
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def winnow(hashes: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The smallest hashes of every ``w`` neighbours: value, and first and last place it may stand."""
    if len(hashes) < w:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = _sliding_min(hashes, w)
    change = np.concatenate([[0], np.flatnonzero(low[1:] != low[:-1]) + 1])
    return low[change], change, np.append(change[1:], len(low)) + w - 2


def _fingerprints(texts: list[str], keep: np.ndarray, k: int, w: int, words: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct fingerprints of each text as (text number, value), in order of texts, and the reduced texts end to end with their lengths.

    With ``words``, a Bloom filter, only those it holds.
    """
    points, lengths = reduced(texts, keep)
    values, firsts, lasts = winnow(window_hashes(points, k), w)
    if words is not None:
        held = np.flatnonzero(_in_filter(values, words))
        values, firsts, lasts = values[held], firsts[held], lasts[held]
    starts = np.cumsum(lengths) - lengths
    # texts lie end to end, so a window of hashes may reach over an end; every text that its minimum may belong to gets it
    low, high = np.searchsorted(starts, firsts, "right") - 1, np.searchsorted(starts, lasts, "right") - 1
    times = high - low + 1
    owner = np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    values = np.repeat(values, times)
    order = np.lexsort((values, owner))
    owner, values = owner[order], values[order]
    new = np.append(True, (owner[1:] != owner[:-1]) | (values[1:] != values[:-1])) if len(owner) else np.zeros(0, bool)
    return owner[new], values[new], points, lengths


class Windows:
    """A text's code points and the hashes of its windows of ``least``, sorted; made once for all texts it is compared with."""

    def __init__(self, text: np.ndarray, least: int):
        self.text, self.hashes, self.least = text, window_hashes(text, least), least
        self.order = np.argsort(self.hashes, kind="stable")
        self.values = self.hashes[self.order]
        self.repeats = bool((self.values[1:] == self.values[:-1]).any())

    def longest_run(self, other: Windows) -> int:
        """Length of the longest run shared with ``other``, 0 if it is under ``least``."""
        if not len(self.values) or not len(other.values):
            return 0
        place = np.minimum(np.searchsorted(self.values, other.hashes), len(self.values) - 1)
        j = np.flatnonzero(self.values[place] == other.hashes)
        if not len(j):
            return 0
        if self.repeats:  # a window of the other text may have several partners here
            return _longest_of_repeats(self.text, other.text, self.least)
        i = self.order[place[j]]
        begin = np.flatnonzero(np.append(True, (np.diff(i) != 1) | (np.diff(j) != 1)))
        length = np.diff(np.append(begin, len(i)))
        best = int(length.argmax())
        p, q, n = int(i[begin[best]]), int(j[begin[best]]), int(length[best]) + self.least - 1
        return n if (self.text[p : p + n] == other.text[q : q + n]).all() else _longest_of_repeats(self.text, other.text, self.least)


def longest_run(a: np.ndarray, b: np.ndarray, least: int) -> int:
    """Length of the longest run that two code point arrays share, 0 if it is under ``least``."""
    return Windows(a, least).longest_run(Windows(b, least))


def _longest_of_repeats(a: np.ndarray, b: np.ndarray, least: int) -> int:
    """As :func:`longest_run`, by searching for the largest window that both have."""

    def shared(n: int) -> bool:
        values, at, other = np.intersect1d(window_hashes(a, n), window_hashes(b, n), return_indices=True)
        return any((a[i : i + n] == b[j : j + n]).all() for i, j in zip(at.tolist(), other.tolist(), strict=True))

    low, high = least, min(len(a), len(b))
    if high < least or not shared(least):
        return 0
    step = least
    while low < high:  # doubling strides, then halving
        probe = min(high, low + step)
        if shared(probe):
            low, step = probe, step * 2
        else:
            high, step = probe - 1, max(1, (probe - low) // 2)
    return low


def _text_of(points: np.ndarray) -> str:
    return points.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def _slots(values: np.ndarray, bits: int) -> list[np.ndarray]:
    """The four places of each value in a Bloom filter of ``bits`` bits, a power of two."""
    step = (values >> np.uint64(32)) | np.uint64(1)
    with np.errstate(over="ignore"):
        return [(values + np.uint64(i) * step) & np.uint64(bits - 1) for i in range(4)]


def _in_filter(values: np.ndarray, words: np.ndarray) -> np.ndarray:
    found = np.ones(len(values), bool)
    for slot in _slots(values, 64 * len(words)):
        found &= (words[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)
    return found


def _prints(df: DataFrame, k: int, w: int, words: Broadcast | None = None) -> DataFrame:
    """``(n, key, values, body)``: texts with their fingerprints, those found in the filter if there is one; texts without any are left out.

    ``n`` numbers the rows; it is stable only once the result is stored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        keep, number = kept_points(), TaskContext.get().partitionId() << 33
        for pdf in batches:
            keys, texts = pdf["key"].to_numpy(), pdf["text"].tolist()
            for lo, hi in slices(texts, 500):
                owner, values, points, lengths = _fingerprints(texts[lo:hi], keep, k, w, None if words is None else words.value)
                if not len(owner):
                    continue
                turn = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
                who, ends = owner[turn], np.cumsum(lengths)
                yield pd.DataFrame(
                    {
                        "n": number + np.arange(len(who)), "key": keys[lo:hi][who], "values": np.split(values.view(np.int64), turn[1:]),
                        "body": [_text_of(points[ends[t] - lengths[t] : ends[t]]) for t in who],
                    }
                )
                number += len(who)

    return df.mapInPandas(run, f"n long, key {df.schema['key'].dataType.simpleString()}, values array<long>, body string")


def _filter(values: DataFrame, most_bits: int) -> np.ndarray:
    """Words of a Bloom filter over the column ``value``: 32 bits a value, at most ``most_bits`` in all; one row a word comes to the driver."""
    n = values.count()
    bits = 1 << min(most_bits.bit_length() - 1, max(10, (32 * n).bit_length()))
    value, step = F.col("value"), F.shiftrightunsigned("value", 32).bitwiseOR(F.lit(1).cast("long"))
    slots = F.array(*((value + step * i).bitwiseAND(bits - 1) for i in range(4)))  # as _slots; sums of longs wrap in both
    words = values.select(F.explode(slots).alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("slot").bitwiseAND(63).cast("int"))).alias("set"))
    held = words.toPandas()
    out = np.zeros(bits // 64, np.int64)
    out[held["word"].to_numpy(np.int64)] = held["set"].to_numpy(np.int64)
    return out.view(np.uint64)


def leaks(corpus: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, *, span: int = 50, k: int = 25, filter_bits: int = 1 << 28) -> DataFrame:
    """``(doc_id, item_id, run)``: documents and items sharing a run of at least ``span`` letters and digits.

    ``run`` is the length of the longest such run.  Null ids and null or short
    texts share nothing; repeated rows count once; an id with several texts shares what any of
    them shares; other columns are ignored; an empty side gives no rows.
    """
    spark = corpus.sparkSession
    w = span - k + 1
    named = lambda df, key, body: df.select(F.col(key).alias("key"), F.col(body).alias("text")).where(F.col("key").isNotNull() & (F.length("text") >= span))
    asked = stored(_prints(named(items, item_id, item_text).distinct(), k, w), "p8-items")
    prints = asked.select(F.col("n").alias("item"), F.explode("values").alias("value"))
    shipped = spark.sparkContext.broadcast(_filter(prints.select("value").distinct(), filter_bits))
    suspects = stored(_prints(spread(named(corpus, doc_id, text)), k, w, shipped), "p8-suspects")
    pairs = suspects.select(F.col("n").alias("doc"), F.explode("values").alias("value")).join(prints, "value").select("doc", "item").distinct()

    def longest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # a document's pairs mostly come one after the other, and the same items again and again
        doc, own, held = None, None, OrderedDict()
        for pdf in batches:
            if not len(pdf):
                continue
            runs = []
            for n, body, item, other in zip(pdf["doc"].tolist(), pdf["own"], pdf["item"].tolist(), pdf["other"], strict=True):
                if n != doc:
                    doc, own = n, Windows(code_points([body])[0], span)
                if item not in held:
                    held[item] = Windows(code_points([other])[0], span)
                    if len(held) > 256:
                        held.popitem(last=False)
                runs.append(own.longest_run(held[item]))
            yield pdf[["doc_id", "item_id"]].assign(run=runs)

    kinds = f"doc_id {corpus.schema[doc_id].dataType.simpleString()}, item_id {items.schema[item_id].dataType.simpleString()}"
    met = (
        pairs.join(asked.select(F.col("n").alias("item"), F.col("key").alias("item_id"), F.col("body").alias("other")), "item")
        .join(suspects.select(F.col("n").alias("doc"), F.col("key").alias("doc_id"), F.col("body").alias("own")), "doc")
        .select("doc", "doc_id", "item", "item_id", "own", "other")
    )
    return met.mapInPandas(longest, f"{kinds}, run int").where(F.col("run") >= span).groupBy("doc_id", "item_id").agg(F.max("run").alias("run"))
