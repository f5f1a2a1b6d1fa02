"""Probing scores a bounded number of cells at a time, whatever the number of buckets."""

import tracemalloc

import numpy as np

from hyrank.llm import ann


def test_probes_do_not_depend_on_the_steps(monkeypatch):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 24))
    sign = ann.signs(24, 1)[0]
    for axes2 in (16, 64):
        whole = ann.probes(v, sign, axes2, 9)
        monkeypatch.setattr(ann, "PROBE_CELLS", 1000)
        assert (ann.probes(v, sign, axes2, 9) == whole).all()
        monkeypatch.undo()


def test_many_queries_and_16384_buckets_stay_small():
    v = np.random.default_rng(2).normal(size=(5000, 64))
    sign = ann.signs(64, 1)[0]
    tracemalloc.start()
    got = ann.probes(v, sign, 128, 17)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.shape == (5000, 17) and int(got.max()) >= 128 and peak < 300e6
