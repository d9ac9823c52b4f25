"""The steps of language mixtures: likelihoods lie by language, and blocks of rows change nothing."""

import numpy as np

from cardloom.llm import langid


def test_rows_of_a_language_lie_together_and_blocks_change_nothing(monkeypatch):
    rng = np.random.default_rng(5)
    logs = np.log(rng.dirichlet(np.ones(50), 3).T).astype(np.float32)
    bucket, doc = rng.integers(0, 50, 40), np.sort(rng.integers(0, 4, 40))
    first, n = np.searchsorted(doc, np.arange(4)), rng.integers(1, 5, 40).astype(float)
    total, open_ = np.add.reduceat(n, first), np.array([[1, 1, 1], [1, 0, 1], [0, 1, 1], [0, 0, 1]], bool)
    like = langid._Likelihoods(logs, bucket)
    assert like.whole.shape == (3, 40) and like.whole.flags.c_contiguous
    share, fit = langid._em(like, n, doc, first, total, open_)
    for d in range(4):  # the plain steps of one document
        p, w, k = np.exp(logs[bucket[doc == d]]).astype(float), open_[d] / open_[d].sum(), n[doc == d]
        for _ in range(langid.EM_STEPS):
            r = p * w
            w = (r / r.sum(1, keepdims=True) * k[:, None]).sum(0) / k.sum()
        assert np.allclose(share[d], w) and np.isclose(fit[d], (k * np.log((p * w).sum(1))).sum())
    monkeypatch.setattr(langid, "BLOCK_CELLS", 21)
    parts = langid._Likelihoods(logs, bucket)
    assert parts.whole is None and all(np.allclose(x, y) for x, y in zip(langid._em(parts, n, doc, first, total, open_), (share, fit)))
