import random

import numpy as np

from codexlake.llm.fm_index import FMIndex, WaveletMatrix


def test_wavelet_ranks():
    r = np.random.default_rng(1)
    for n_symbols in (1, 2, 7, 300):
        s = r.integers(0, n_symbols, 500)
        m = WaveletMatrix(s, n_symbols)
        c, at = r.integers(0, n_symbols, 200), r.integers(0, 501, 200)
        assert m.rank(c, at).tolist() == [int((s[:i] == x).sum()) for x, i in zip(c, at, strict=True)]


def test_matching_statistics_against_brute_force():
    r = random.Random(2)
    for trial in range(40):
        top, threshold = r.choice([2, 3, 9]), r.choice([1, 2, 3, 5, 8])
        say = lambda n: np.array([r.randrange(1, top + 1) for _ in range(n)], np.int64)
        held = [say(r.randrange(1, 30)) for _ in range(r.randrange(1, 8))]
        owners = np.array([r.randrange(-5, 50) for _ in held])
        asked = held[:2] + [say(r.randrange(1, 40)) for _ in range(4)] + [np.array([1, -1, 2, top + 5, 1])]
        length, least = FMIndex(held, owners, threshold).statistics(asked)
        has = {}
        for p, o in zip(held, owners.tolist(), strict=True):
            for i in range(len(p)):
                for j in range(i + 1, min(len(p), i + threshold) + 1):
                    key = tuple(p[i:j].tolist())
                    has[key] = min(has.get(key, o), o)
        for k, p in enumerate(asked):
            for i in range(len(p)):
                want = max((n for n in range(1, threshold + 1) if tuple(p[i : i + n].tolist()) in has and i + n <= len(p)), default=0)
                assert length[k, i] == want, (trial, k, i)
                if want == threshold:
                    assert least[k, i] == has[tuple(p[i : i + threshold].tolist())]
