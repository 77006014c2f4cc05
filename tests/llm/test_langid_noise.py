"""Wrong labels in the corpus do not make language identification drop clean documents."""

import numpy as np
import pytest

from adflow.llm import langid

WORDS = {"en": "the thing and of with that from this".split(), "de": "der und nicht mit auf eine ist zu".split(),
         "es": "los para una que como pero todo muy".split()}


@pytest.mark.parametrize("percent", [1, 3, 10])
def test_flipped_labels_keep_clean_documents(percent):
    rng = np.random.default_rng(percent)
    langs, rows, texts = list(WORDS), [], []
    for i in range(900):
        true = langs[i % 3]
        text = " ".join(rng.choice(WORDS[true], 30))
        texts.append(text)
        label = langs[(i + 1) % 3] if rng.random() < percent / 100 else true
        rows.append((i, label, *langid.bucket_counts(text)))
    model = langid.fit(rows)
    summed, grams = langid._score_batch(texts, model.scores)
    p = langid._softmax(summed / grams[:, None] / model.temperature)
    assert np.mean(p.argmax(axis=1) == [model.languages.index(langs[i % 3]) for i in range(900)]) > 0.98
    assert np.mean(p.max(axis=1) < model.threshold) <= 0.03
