"""Rounds of working sets: what they write, slices of the kernel, labels beyond the bound."""

import numpy as np
import pytest

from quarry.operators import svm

from .test_svm import table, two_moons


@pytest.mark.parametrize("fit", [svm.fit, svm.fit_shrinking, svm.fit_approximate])
def test_rounds_write_vectors_once(spark, monkeypatch, fit):
    x, y = two_moons(160, 1)
    written, cut = [], svm.cut
    monkeypatch.setattr(svm, "cut", lambda df: written.append(df.columns) or cut(df))
    fit(table(spark, x, y), 1.0, 1.0, bound=50, working=40)
    assert len(written) > 3 and sum("tv" in c or "vector" in c for c in written) == 1


def test_kernel_in_slices(monkeypatch):
    x, _ = two_moons(50, 4)
    want, most, kernel = svm.kernel(x, x[:7], 1.0) @ np.arange(7.0), [], svm.kernel
    monkeypatch.setattr(svm, "SLICE", 8)
    monkeypatch.setattr(svm, "kernel", lambda a, *rest: most.append(len(a)) or kernel(a, *rest))
    assert np.allclose(svm.weighted(x, x[:7], np.arange(7.0), 1.0), want, atol=1e-14) and max(most) == 8
    assert len(svm.weighted(x[:0], x, np.ones(50), 1.0)) == 0


def test_labels_beyond_the_bound(spark):
    x, y = two_moons(60, 5)
    y[-1] = 2
    with pytest.raises(ValueError, match="label"):
        svm.fit(table(spark, x, y).orderBy("id"), 1.0, 1.0, bound=20, working=10)
