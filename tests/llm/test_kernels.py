"""Array kernels against plain Python."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm import chunking, components, knn, langnet, leakage, minhash, setjoin
from siltstone.llm.textprep import code_points, slices, window_hashes, windows_of

texts = st.lists(st.text(alphabet="abกé\n ", max_size=40), max_size=6)


@given(texts, st.integers(1, 20))
@settings(max_examples=80, deadline=None)
def test_window_hashes_agree_exactly_when_windows_do(ts, k):
    points, lengths = code_points(ts)
    at, owner = windows_of(lengths, k)
    hashes = window_hashes(points, k)[at]
    expected = [(n, t[i : i + k]) for n, t in enumerate(ts) for i in range(len(t) - k + 1)]
    assert owner.tolist() == [n for n, _ in expected]
    by_text = {}
    for (_, w), h in zip(expected, hashes.tolist(), strict=True):
        assert by_text.setdefault(w, h) == h
    assert len(set(by_text.values())) == len(by_text)


def test_sketch_estimates_jaccard():
    rng = random.Random(3)
    a = "".join(rng.choice("abcdefgh ") for _ in range(1500))
    for changes in (0, 2, 10, 40):
        b = list(a)
        for i in rng.sample(range(len(b)), changes):
            b[i] = "z"
        b = "".join(b)
        true = minhash.window_jaccard(a, b, 16)
        est = [minhash.estimate(*[s[None] for s in minhash.sketch([a, b], 16, bands)])[0] for bands in (50, 400)]
        assert est[0] == pytest.approx(true, abs=0.15) and est[1] == pytest.approx(true, abs=0.06)


def test_short_texts_fill_their_sketch():
    s = minhash.sketch(["x" * 16, "x" * 16, ""], 16, 50)
    assert (s[0] == s[1]).all() and s.shape == (3, 50)


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=60))
@settings(max_examples=80, deadline=None)
def test_local_forest(edges):
    parent = list(range(31))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    u, v = components.local_forest(np.array([a for a, _ in edges], int), np.array([b for _, b in edges], int))
    assert dict(zip(u.tolist(), v.tolist(), strict=True)) == {x: find(x) for x in range(31) if find(x) != x}


@given(st.text(alphabet="ab", min_size=0, max_size=120), st.text(alphabet="ab", max_size=30), st.text(alphabet="ab", max_size=30), st.integers(0, 119))
@settings(max_examples=100, deadline=None)
def test_winnowing_never_misses_a_shared_span(body, left, right, cut):
    span, k = 20, 8
    shared = body[cut : cut + span]
    if len(shared) < span:
        return
    def prints(text):
        return set(leakage.winnow(window_hashes(code_points([text])[0], k), span - k + 1)[0].tolist())

    assert prints(left + shared + right) & prints(body)


units = st.lists(st.one_of(st.text(alphabet="ab c", max_size=30), st.just("\n"), st.just("\n\n"), st.just(" \t\n"), st.just("x" * 55), st.text(alphabet="ก ข", max_size=50)), max_size=25)


@given(units)
@settings(max_examples=150, deadline=None)
def test_pieces_cover_the_text_within_limits(parts):
    body, limit, overlap = "".join(parts), 40, 10
    pieces = chunking.split_text(body, limit, overlap)
    assert all(e - b <= limit and b <= new <= e and new - b <= max(overlap, 0) for b, e, new, _ in pieces)
    assert "".join(body[new:e] for _, e, new, _ in pieces) == body
    assert all(e > new for _, e, new, _ in pieces) or not body


def stated_boundary(text, limit):
    """The definition, without looking at any cut."""
    blocks, run = [], []
    for line in [*text.split("\n"), ""]:
        if line.strip(" \t"):
            run.append(line)
        elif run:
            blocks.append("\n".join(run))
            run = []
    if all(len(b) <= limit for b in blocks):
        return "paragraph"
    if all(len(line) <= limit for line in text.split("\n")):
        return "line"
    return "word" if all(len(w) <= limit for w in text.split()) else "hard"


@given(st.text(alphabet="ab", max_size=60), st.text(alphabet="ab", max_size=60), st.integers(1, 6))
@settings(max_examples=200, deadline=None)
def test_longest_run(a, b, least):
    x, y = code_points([a])[0], code_points([b])[0]
    true = max([j - i for i in range(len(a)) for j in range(i + 1, len(a) + 1) if a[i:j] in b], default=0)
    assert leakage.longest_run(x, y, least) == (true if true >= least else 0)


@given(st.lists(st.text(alphabet="abcd", max_size=90), max_size=5))
@settings(max_examples=100, deadline=None)
def test_fingerprints_of_texts_laid_end_to_end_hold_those_of_each(parts):
    keep = np.ones(200, bool)
    owner, values, points, lengths = leakage._fingerprints(parts, keep, 8, 13)
    for n, text in enumerate(parts):
        alone = set(leakage.winnow(window_hashes(code_points([text])[0], 8), 13)[0].tolist())
        assert alone <= set(values[owner == n].tolist())


long_units = st.lists(
    st.one_of(units, st.sampled_from([["a" * 40], ["a" * 39 + " "], [" " * 90], ["\t" * 41], ["\n" * 50], ["b" * 41], ["a " * 20], ["\n" + "c" * 40 + "\n"], ["d" * 40 + " " * 41]])), max_size=8
).map(lambda parts: [p for part in parts for p in part])


@given(long_units)
@settings(max_examples=600, deadline=None)
def test_the_pieces_cuts_give_the_boundary(parts):
    body, limit = "".join(parts), 40
    pieces = chunking.split_text(body, limit, 10)
    assert all(e - b <= limit for b, e, *_ in pieces) and "".join(body[new:e] for _, e, new, _ in pieces) == body
    if len(body) > limit:
        assert chunking.boundary_of(body, limit, 10) == stated_boundary(body, limit)


def test_cuts_keep_to_natural_boundaries():
    paragraph = ("the cat sat on the mat and the cat slept " * 8).strip()
    other = ("stocks fell while bonds rose in early trade " * 8).strip()
    body = "\n\n".join([paragraph, paragraph, paragraph, other, other, other])
    pieces = chunking.split_text(body, 1200, 100)
    assert chunking.boundary_of(body, 1200) == "paragraph" and {c for *_, c in pieces} == {"paragraph", "end"}
    assert body[pieces[0][1] :].startswith("stocks")  # the topic changes there
    assert chunking.boundary_of("a b\n" * 30, 40) == "line"
    assert chunking.boundary_of("a b " * 30, 40) == "word"
    assert chunking.boundary_of("x" * 41, 40) == "hard"


@pytest.mark.parametrize("end", [". ", " "])
def test_pieces_of_a_long_line_end_at_its_valleys(end):
    cat, stock = "the cat sat on the mat and the cat slept" + end, "stocks fell while bonds rose in early trade" + end
    body = (cat * 35 + stock * 60).strip()  # one line; the topic changes in the second half of the first reach
    pieces = chunking.split_text(body, 2000, 100)
    assert chunking.boundary_of(body, 2000) == "word" and pieces[0][3] == "word"
    assert abs(pieces[0][1] - len(cat * 35)) <= (0 if end == ". " else 200)
    plain = "word " * 900
    assert chunking.split_text(plain, 2000, 100)[0][1] == 2000  # no valley: the last word in reach


def test_long_runs_without_white_space_end_at_their_sentences():
    a, b = "猫がマットの上に座って眠っていた。", "株価が下がり債券が早くに上がった。"
    body = a * 70 + b * 70
    pieces = chunking.split_text(body, 2000, 100)
    assert chunking.boundary_of(body, 2000) == "hard" and pieces[0][1:] == (len(a * 70), 0, "hard")


@pytest.mark.parametrize("d", [24, 64, 100, 1024, 4096])
def test_one_bit_estimates_keep_their_bounds(d):
    rng = np.random.default_rng(1)
    x, q = knn.unit(rng.standard_normal((300, d))), knn.unit(rng.standard_normal((40, d)))
    q[:20] = knn.unit(x[:20] + rng.standard_normal((20, d)) * 0.5 / d**0.5)
    centre = knn.unit(x[:50].mean(0, keepdims=True)).astype(np.float32)
    assert np.allclose(np.linalg.norm(knn.rotated(x), axis=1), 1, atol=1e-5) and np.allclose(knn.rotated(q) @ knn.rotated(x).T, q @ x.T, atol=1e-5)
    codes = knn.codes_of(x, np.repeat(centre, len(x), axis=0))
    middle, error = knn.bounds(codes, knn.planes_of(q).assign(near=(q.astype(np.float32) @ centre.T)[:, 0]))
    true = q @ x.T
    assert np.mean(np.abs(middle - true) <= error) > 0.98 and np.corrcoef(middle.ravel(), true.ravel())[0, 1] > 0.5  # residuals of length 1.4: unclustered vectors
    assert all(len(c) == knn.padded(d) // 8 for c in codes["code"])


def test_candidates_hold_the_best():
    rng = np.random.default_rng(2)
    x = knn.unit(rng.standard_normal((300, 32)))
    centre = knn.unit(x.mean(0, keepdims=True)).astype(np.float32)
    codes = knn.codes_of(x, np.repeat(centre, len(x), axis=0)).assign(class_id=np.arange(300))
    asking = knn.planes_of(x[:20]).assign(near=(x[:20].astype(np.float32) @ centre.T)[:, 0], class_id=np.arange(20))
    found = knn.candidates(codes, asking, 5, -1.0)
    true = x[:20] @ x.T
    np.fill_diagonal(true, -2)
    best = np.argsort(-true, axis=1)[:, :5]
    assert sum(len(set(best[i]) & set(found["near"][found["class_id"] == i])) for i in range(20)) >= 98
    assert not (found["class_id"] == found["near"]).any()


def test_band_keys_depend_on_the_set_only():
    a = np.array([5, 9, 77], np.uint64)
    one = setjoin.band_keys(np.concatenate([a, a[::-1]]), np.array([3, 3]), 6, 3)
    assert (one[0] == one[1]).all() and len(set(one[0].tolist())) == 6


def test_both_ways_of_reading_give_the_same_states():
    rng = np.random.default_rng(5)
    p = langnet.new_params(3)
    p["bi"] += rng.standard_normal(p["bi"].shape).astype(np.float32)
    rows = rng.integers(0, langnet.ROWS, (7, langnet.STEPS)).astype(np.int32)
    assert np.allclose(langnet.states(p, rows), langnet._traced(p, rows)[0], atol=1e-5)
    assert langnet.states(p, rows[:0]).shape == (0, langnet.STEPS, 2 * langnet.HIDDEN)


def test_gradients_match_finite_differences():
    rng = np.random.default_rng(4)
    p = {k: v.astype(np.float64) for k, v in langnet.new_params(3).items()}
    rows = rng.integers(0, langnet.ROWS, (2, langnet.STEPS))
    labels, weights = rng.integers(0, 3, (2, langnet.STEPS)), rng.random((2, langnet.STEPS))
    _, g = langnet.gradients(p, rows, labels, weights)
    for name in ("out", "bias", "re", "bi", "table"):
        at = np.unravel_index(int(np.abs(g[name]).argmax()), g[name].shape)
        step, old = 1e-3, p[name][at]
        p[name][at] = old + step
        up = langnet.gradients(p, rows, labels, weights)[0]
        p[name][at] = old - step
        down = langnet.gradients(p, rows, labels, weights)[0]
        p[name][at] = old
        assert g[name][at] == pytest.approx((up - down) / (2 * step), rel=0.03, abs=1e-5)


@given(st.lists(st.integers(0, 30), max_size=30), st.integers(1, 6), st.integers(1, 40))
@settings(max_examples=60, deadline=None)
def test_slices_cover_a_batch_within_bounds(sizes, most, chars):
    got = slices(["x" * n for n in sizes], most, chars)
    assert [i for lo, hi in got for i in range(lo, hi)] == list(range(len(sizes)))
    assert all(hi - lo <= most and (hi - lo == 1 or sum(sizes[lo:hi]) <= chars) for lo, hi in got)
