"""Languages of documents and of their stretches, from a recurrent network trained on the labels at hand.

The network (:mod:`siltstone.llm.langnet`) is fitted on a bounded sample of labelled rows; as labels can be wrong, it is
first fitted on halves, and rows whose label the other half's network contradicts are set aside.  Then one pass over
all whole texts labels every position, and the letters of each sentence or line choose its language
together.  No shuffle: a document is scored where it is read.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.langnet import STEPS, Params, forward, states, train, trigram_rows
from siltstone.llm.textprep import slices
from siltstone.storage import spread

LANGUAGES = ("en", "th", "de", "fr", "es", "pt")
#: Names under which a label can stand for each language (code, three-letter codes, English name).
NAMES = {
    "en": ("en", "eng", "english"),
    "th": ("th", "tha", "thai"),
    "de": ("de", "deu", "ger", "german"),
    "fr": ("fr", "fra", "fre", "french"),
    "es": ("es", "spa", "spanish"),
    "pt": ("pt", "por", "portuguese"),
}
_FENCE = re.compile(r"^[ \t]*(`{3,}|~{3,})[^\n]*(?:\n|\Z)(?:.*?^[ \t]*\1[`~]*[ \t\r]*(?:\n|\Z)|.*\Z)", re.M | re.S)
_kept: list[np.ndarray] = []


def label_language(label: Column) -> Column:
    """The language a label names, null for none of them; case, spaces and a region suffix are ignored."""
    name = F.regexp_replace(F.lower(F.regexp_replace(label, r"(?U)^\s+|\s+$", "")), r"[-_][a-z0-9]+$", "")
    out = F.lit(None).cast("string")
    for code, names in NAMES.items():
        out = F.when(name.isin(*names), code).otherwise(out)
    return out


def letter_points() -> np.ndarray:
    """For every code point, whether it is a letter (Unicode category L)."""
    if not _kept:
        _kept.append(np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _kept[0]


def without_fences(text: str) -> str:
    """The text without fenced code; a fence left open runs to the end."""
    return _FENCE.sub("", text) if "```" in text or "~~~" in text else text


class Layout:
    """A batch of texts laid out in windows, each text from the start of a window on.

    ``rows`` are the windows' table rows, ``place`` the position of each code point's first byte in them, ``unit`` its sentence or line,
    numbered through the batch, ``letter`` whether it is a letter.
    """

    def __init__(self, texts: list[str], letters: np.ndarray):
        raw = [t.encode("utf-8", "replace") for t in texts]
        sizes = np.fromiter((len(r) for r in raw), np.int64, len(raw))
        windows = np.maximum(1, -(-sizes // STEPS))
        base = (np.cumsum(windows) - windows) * STEPS
        data = np.zeros(int(windows.sum()) * STEPS, np.uint8)
        joined = np.frombuffer(b"".join(raw), np.uint8)
        shift = np.repeat(base - (np.cumsum(sizes) - sizes), sizes)
        place = np.arange(len(joined)) + shift
        data[place] = joined
        self.rows = trigram_rows(data).reshape(-1, STEPS)
        self.place = place[(joined & 0xC0) != 0x80]
        points = np.frombuffer("".join(r.decode("utf-8") for r in raw).encode("utf-32-le"), np.uint32)
        self.letter = letters[points]
        self.lengths = np.fromiter((len(r.decode("utf-8")) for r in raw), np.int64, len(raw))
        self.text = np.repeat(np.arange(len(texts)), self.lengths)
        newline = points == 10
        stop = (points == 46) | (points == 33) | (points == 63)
        space = np.append((points[1:] == 32) | newline[1:] | (points[1:] == 13), True) if len(points) else newline
        ends = newline | (stop & space)
        starts = np.zeros(len(points), bool)
        starts[1:] = ends[:-1] | (self.text[1:] != self.text[:-1])
        # a sentence may end without a mark where the script changes (Thai beside Latin letters)
        at = np.flatnonzero(self.letter)
        other = points[at] >= 0x370
        starts[at[1:][(other[1:] != other[:-1]) & (at[1:] - at[:-1] > 1)]] = True
        self.unit = np.cumsum(starts)


def log_probs(params: Params, rows: np.ndarray, wanted: np.ndarray, windows: int = 1024) -> np.ndarray:
    """(languages, positions) of the ``wanted`` positions, which are in order; so many windows at a time that their states stay small."""
    out = np.empty((len(LANGUAGES), len(wanted)), np.float32)
    for lo in range(0, len(rows), windows):
        first, last = np.searchsorted(wanted, (lo * STEPS, (lo + windows) * STEPS))
        if first < last:
            held = states(params, rows[lo : lo + windows]).transpose(1, 0, 2)  # as it lies in memory: step by step
            step, window = (wanted[first:last] - lo * STEPS) % STEPS, (wanted[first:last] - lo * STEPS) // STEPS
            own = held.reshape(-1, held.shape[2]).take(step * held.shape[1] + window, axis=0)
            score = params["out"].T @ own.T + params["bias"][:, None]  # languages first: sums over them run along memory
            score -= score.max(axis=0)
            score -= np.log(np.exp(score).sum(axis=0))
            out[:, first:last] = score
    return out


def units_of(params: Params, layout: Layout) -> pd.DataFrame:
    """Text number, start, end, letters, language and summed probability of every sentence or line."""
    n = len(layout.unit)
    if not n:
        return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("text", "start", "end", "letters", "lang", "mass")})
    first = np.flatnonzero(np.append(True, layout.unit[1:] != layout.unit[:-1]))  # where units begin
    held = np.flatnonzero(layout.letter)
    owner = np.searchsorted(first, held, "right") - 1  # the unit of each letter
    logp = log_probs(params, layout.rows, layout.place[held])
    letters = np.bincount(owner, minlength=len(first))
    begin = np.cumsum(letters) - letters
    some = np.flatnonzero(letters)
    score = np.zeros((len(first), len(LANGUAGES)), np.float32)
    if len(some):
        score[some] = np.add.reduceat(logp, begin[some], axis=1).T
    lang = score.argmax(1)
    mass = np.bincount(owner, np.exp(logp[lang[owner], np.arange(len(held))]), len(first))
    text = layout.text[first]
    offset = np.cumsum(layout.lengths) - layout.lengths
    return pd.DataFrame({"text": text, "start": first - offset[text], "end": np.append(first[1:], n) - offset[text], "letters": letters, "lang": lang, "mass": mass})


def fit(texts: list[str], labels: list[str], *, steps: int = 330) -> Params:
    """The network fitted on texts with labels that can be wrong, or name one language of several.

    Each half of the texts is judged by a network fitted on the other half, which cannot have learned its mistakes by
    heart; the network that counts is fitted on texts of which four fifths are found to be in their label's language (or on the
    better half of a language's texts, if fewer than that are).
    """
    layout = Layout([without_fences(t) for t in texts], letter_points())
    windows = len(layout.rows)
    weights = np.bincount(layout.place, layout.letter, windows * STEPS).reshape(windows, STEPS)
    owner = np.zeros(windows, np.int64)
    owner[layout.place // STEPS] = layout.text
    y = np.array([LANGUAGES.index(x) for x in labels])
    label = np.repeat(y[owner][:, None], STEPS, axis=1)
    full = weights.sum(1) > 0
    agreed, total = np.zeros(len(texts)), np.zeros(len(texts))
    for half in (0, 1):
        learn, judge = full & (owner % 2 == half), full & (owner % 2 != half)
        if learn.any() and judge.any():
            params = train(layout.rows[learn], label[learn], weights[learn], len(LANGUAGES), steps=steps // 3, seed=half)
            for lo in range(0, windows, 1024):
                at = lo + np.flatnonzero(judge[lo : lo + 1024])
                said = forward(params, layout.rows[at]).argmax(2)
                np.add.at(agreed, owner[at], ((said == label[at]) * weights[at]).sum(1))
                np.add.at(total, owner[at], weights[at].sum(1))
    share = agreed / np.maximum(total, 1)
    least = np.array([min(0.8, np.median(share[y == k])) if (y == k).any() else 0.0 for k in range(len(LANGUAGES))])
    clean = full & (share >= least[y])[owner]
    return train(layout.rows[clean], label[clean], weights[clean], len(LANGUAGES), steps=steps, seed=6)


def fit_sample(docs: DataFrame, id_col: str, text: str, label: str, *, per_language: int = 300, most_chars: int = 20_000) -> Params | None:
    """Fits on about ``per_language`` rows of each named language, drawn by a hash of their ids.

    Without a label that names a language there is nothing to learn from: None, with which no text gets a language.
    At most twice that many texts come to the driver; training texts over ``most_chars`` are left out of the draw.
    """
    named = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), label_language(F.col(label)).alias("lang"))
    counts = {r["lang"]: r["n"] for r in docs.select(label_language(F.col(label)).alias("lang")).where("lang is not null").groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    draw = F.pmod(F.xxhash64(F.lit(23), "id"), F.lit(1_000_000))
    wanted = F.lit(False)
    for code, n in counts.items():
        wanted = wanted | ((F.col("lang") == code) & (draw < int(1_000_000 * min(1.0, per_language / n)) + 1))
    drawn = named.where(wanted & F.length("text").between(80, most_chars)).select("id", "text", "lang").limit(2 * per_language * len(LANGUAGES)).toPandas().sort_values(["id", "text", "lang"])
    if drawn.empty:
        return None
    return fit(drawn["text"].tolist(), drawn["lang"].tolist())


def stretches(docs: DataFrame, ids: list[str], text: str, params: Params | None) -> DataFrame:
    """``(*ids, start, end, letters, lang, confidence)``: neighbouring sentences or lines of one language.

    ``start`` and ``end`` are places in the text without its fenced code.  Null texts and texts without letters have no stretches; stretches
    without letters join the one before; other columns are ignored; repeated rows are labelled each.
    """
    return _labelled(docs, ids, text, params, "start int, end int, letters long, lang string, confidence double", _stretch_rows)


def document_languages(docs: DataFrame, ids: list[str], text: str, params: Params | None, *, share: float = 0.2, min_letters: int = 80) -> DataFrame:
    """``(*ids, letters, languages, lang, share, confidence)``: one row for each language with at least ``share`` of a text's letters.

    ``languages`` is the number of the text's rows.
Texts (without fenced code) of fewer than ``min_letters`` letters, nulls and empty texts give no rows;
    other columns are ignored; repeated rows are labelled each.
    """

    def rows(units: pd.DataFrame) -> pd.DataFrame:
        total = units.groupby("text")["letters"].transform("sum")
        by = units.assign(total=total).groupby(["text", "lang"], as_index=False).agg(part=("letters", "sum"), mass=("mass", "sum"), letters=("total", "first"))
        by = by[(by["letters"] >= min_letters) & (by["part"] >= share * by["letters"])]
        by = by.assign(share=by["part"] / by["letters"], confidence=np.minimum(1.0, by["mass"] / by["part"]), languages=by.groupby("text")["lang"].transform("size"))
        return by[["text", "letters", "languages", "lang", "share", "confidence"]]

    return _labelled(docs, ids, text, params, "letters long, languages int, lang string, share double, confidence double", rows)


def _stretch_rows(units: pd.DataFrame) -> pd.DataFrame:
    held = units[units["letters"] > 0]
    new = (held["text"] != held["text"].shift()) | (held["lang"] != held["lang"].shift())
    out = held.groupby(new.cumsum()).agg(text=("text", "first"), start=("start", "first"), end=("end", "last"), letters=("letters", "sum"), lang=("lang", "first"), mass=("mass", "sum"))
    return out.assign(confidence=np.minimum(1.0, out["mass"] / out["letters"]))[["text", "start", "end", "letters", "lang", "confidence"]]


def _labelled(docs: DataFrame, ids: list[str], text: str, params: Params | None, fields: str, rows) -> DataFrame:
    kept = spread(docs.select(*ids, F.col(text).alias("__text")).where("__text is not null and __text <> ''"))
    shipped = docs.sparkSession.sparkContext.broadcast(params)  # about half a megabyte

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters = letter_points()
        for pdf in batches:
            texts = pdf["__text"].tolist()
            for lo, hi in slices(texts, 256, 500_000):
                part = pdf.iloc[lo:hi]
                distinct: dict[str, int] = {}  # copies of a text are read once
                number = np.array([distinct.setdefault(t, len(distinct)) for t in texts[lo:hi]])
                found = rows(units_of(shipped.value, Layout([without_fences(t) for t in distinct], letters)))
                out = pd.DataFrame({"text": number, "__at": np.arange(hi - lo)}).merge(found, on="text", how="inner").sort_values("__at", kind="stable")
                out["lang"] = np.array(LANGUAGES, object)[out["lang"].to_numpy().astype(np.int64)]
                owner = out.pop("__at").to_numpy().astype(np.int64)
                own = pd.DataFrame({c: part[c].to_numpy()[owner] for c in ids})
                yield pd.concat([own, out.drop(columns="text").reset_index(drop=True)], axis=1)

    schema = ", ".join(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in ids)
    if params is None:
        return docs.sparkSession.createDataFrame([], f"{schema}, {fields}")
    return kept.mapInPandas(run, f"{schema}, {fields}")
