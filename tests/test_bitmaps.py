from __future__ import annotations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.operators.bitmaps import Bitmap

sets = st.sets(st.one_of(st.integers(0, 300_000), st.integers(0, 70)), max_size=200)


@given(sets, sets)
@settings(max_examples=60, deadline=None)
def test_set_operations(a, b):
    x, y = Bitmap.of(np.array(list(a), int)), Bitmap.of(np.array(list(b), int))
    assert x.and_not(y).numbers().tolist() == sorted(a - b)
    assert x.and_(y).numbers().tolist() == sorted(a & b)
    assert x.or_(y).numbers().tolist() == sorted(a | b)


def test_dense_containers_are_small():
    full = Bitmap.of(np.arange(65_536))
    assert full.nbytes() == 8192
    odd = Bitmap.of(np.arange(1, 65_536, 2))
    assert full.and_not(odd).numbers().tolist() == list(range(0, 65_536, 2))
    assert Bitmap.of(np.arange(10)).and_not(odd).numbers().tolist() == [0, 2, 4, 6, 8]
