"""The fast parts of decontamination against plain ones."""

import sys

import numpy as np

from lexiloom.llm import decontaminate as dc


def test_word_bytes_are_the_words():
    everything = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    texts = ["", "_", "a_b", "x\x00\x1cy z", "Ünï—códe　กำ \U0001f600ok", "".join(everything), "a".join(everything), " ".join(everything).lower()]
    texts += ["".join(np.random.default_rng(k).choice(everything[: 1 << 8 + k], 2_000)) for k in range(8)]
    for text in texts:
        assert [w.decode() for w in dc.word_bytes(text)] == dc._words(text)


def test_segment_sums_are_sums():
    random = np.random.default_rng(1)
    for n, cuts in ((0, 0), (1, 1), (500, 1), (500, 500), (5_000, 700)):
        table = random.standard_normal((40, 6)).astype(np.float32)
        index, scale = random.integers(0, 40, n), random.standard_normal(n).astype(np.float32)
        starts = np.sort(random.choice(n, cuts, replace=False)) if n else np.zeros(0, np.int64)
        starts[:1] = 0
        for factor, rows in ((None, table[index]), (scale, scale[:, None] * table[index])):
            found = dc.segment_sums(table, index, starts, factor)
            expected = [x.sum(axis=0) for x in np.split(rows.astype(float), starts[1:])] if n else np.zeros((0, 6))
            assert found.shape == (cuts, 6) and found.dtype == np.float32 and np.allclose(found, expected, atol=1e-3)
