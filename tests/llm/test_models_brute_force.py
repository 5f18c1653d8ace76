"""The classifiers' passes against plain loops."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest

from tidewheel.llm import quality, toxicity
from tidewheel.llm.bytetext import column_bytes

TEXTS = ["You FILTHY scumbag, go", "a", "", "  \n", "word word word 'll 12 é日本 word!!", "Über|||x ?? NO 7a. THE end\n\nline", "aaaaaaaa bbbbb cc " * 40]


def buffers(texts):
    import pyarrow as pa

    return column_bytes(pa.array(texts, pa.string()))


def test_scores_of_the_convolution():
    codes, bounds = toxicity.word_codes(*buffers(TEXTS))
    model = toxicity.train([(codes[s:e], i % 2) for i, (s, e) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))] * 20)
    got = model.score(*buffers(TEXTS))
    for i, (s, e) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        assert e - s == len(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", TEXTS[i])) + toxicity.PAD
        words = [[x for k in range(toxicity.TABLES) for x in model.tables[k][codes[w, k]].tolist()] for w in range(s, e)]
        logit = model.base
        for k, width in enumerate(toxicity.WIDTHS):
            for f in range(toxicity.FILTERS):
                best = -math.inf
                for start in range(len(words) - width + 1):
                    some = words[start : start + width]
                    best = max(best, sum(x * model.kernels[k][j][d][f] for j, w in enumerate(some) for d, x in enumerate(w)))
                logit += max(best + model.bias[k][f], 0) * model.out[k * toxicity.FILTERS + f]
        assert got[i] == pytest.approx(1 / (1 + math.exp(-logit)), abs=2e-4), TEXTS[i]


def test_a_score_does_not_depend_on_the_texts_beside_it():
    codes, bounds = toxicity.word_codes(*buffers(TEXTS))
    model = toxicity.train([(codes[s:e], i % 2) for i, (s, e) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))] * 20)
    together, back = model.score(*buffers(TEXTS)), model.score(*buffers(TEXTS[::-1]))[::-1]
    alone = np.concatenate([model.score(*buffers([t])) for t in TEXTS])
    assert np.allclose(together, alone, atol=1e-5) and np.allclose(back, alone, atol=1e-5)


def test_equal_words_have_equal_codes():
    codes, _ = toxicity.word_codes(*buffers(["Filthy filthy FILTHY filthier"]))
    assert codes[0].tolist() == codes[1].tolist() == codes[2].tolist()
    assert codes[0, 0] != codes[3, 0] and codes[0, 2] == codes[3, 2]  # the same beginning


def plain_features(text):
    raw = text.encode()
    kind = lambda c: 7 if c == 10 else 0 if c in (32, 9, 11, 12, 13) else 1 if 97 <= c <= 122 else 2 if 65 <= c <= 90 else 3 if 48 <= c <= 57 else 4 if c >= 128 else 6 if chr(c) in ".,;:'\"-()?" else 5
    out = [math.log1p(len(raw))]
    counts = Counter(map(kind, raw))
    out += [counts[k] / max(len(raw), 1) for k in range(8)]
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", raw) if w]
    n = max(len(words), 1)
    fold = [w.lower() for w in words]
    mean = sum(map(len, words)) / n
    out += [mean / 10, math.sqrt(max(sum(len(w) ** 2 for w in words) / n - mean**2, 0)) / 10]
    out.append(sum(a == b for a, b in zip(fold, fold[1:], strict=False)) / n)
    out.append(sum(any(kind(c) in (5, 3) for c in w) for w in words) / n)
    out.append(sum(sum(kind(c) == 2 for c in w) > 1 for w in words) / n)
    out.append(sum(len(w) <= 3 for w in words) / n)
    out += [len(set(fold)) / len(words) ** 0.8, max(Counter(fold).values()) / len(words)] if words else [0, 0]
    return [*out, math.log1p(len(words))]


def test_features_of_quality():
    got = quality.features(*buffers(TEXTS))
    for row, text in zip(got, TEXTS, strict=True):
        assert row.tolist() == pytest.approx(plain_features(text), abs=1e-9), text


def test_strengths_follow_preferences():
    r = np.random.default_rng(1)
    x = r.normal(size=(400, 5))
    y = (x @ np.array([2.0, -1.0, 0, 0, 0.5]) + r.normal(scale=0.3, size=400) > 0).astype(int)
    ranker = quality.fit(x, y)

    def loss(weights):
        s = ranker.expand(x) @ weights
        return np.mean([math.log1p(math.exp(-(a - b))) for a in s[y == 1][:60] for b in s[y == 0][:60]])

    assert loss(ranker.weights) < 0.15 < math.log(2) == pytest.approx(loss(np.zeros(15)))
    s = ranker.strength(x)
    assert np.mean([a > b for a in s[y == 1] for b in s[y == 0]]) > 0.98
