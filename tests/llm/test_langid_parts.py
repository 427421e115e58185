import tracemalloc

import numpy as np

from qacorpus.llm import langid


def _texts():
    rnd = np.random.default_rng(3)
    words = {x: ["".join(rnd.choice(list(letters), 7)) for _ in range(4000)] for x, letters in (("aa", "abcdefgh"), ("bb", "defghijk"))}
    return [(" ".join(rnd.choice(words[x], 100)), x) for x in words for _ in range(150)]


def test_parts_give_the_same_field():
    texts, langs = zip(*_texts())
    whole, parts = (langid.train(list(texts), list(langs), {"aa": 0.5, "bb": 0.5}, rounds=3, part=a, some=b) for a, b in ((10**6, 10**6), (700, 90)))
    assert whole.lexicon == parts.lexicon and np.abs(whole.weights).max() > 0
    for name in ("weights", "listed", "moves"):
        np.testing.assert_allclose(getattr(whole, name), getattr(parts, name), atol=1e-9)


def test_training_holds_little():
    texts, langs = zip(*_texts())
    texts, langs = list(texts) * 8, list(langs) * 8
    tracemalloc.start()
    langid.train(texts, langs, {"aa": 0.5, "bb": 0.5}, rounds=1)
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert peak < 45, peak
