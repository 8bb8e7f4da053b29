"""The sizes of terms are chosen inside the training rows."""

import numpy as np

from plumbline.llm.toxicity import FULL, LEAST, cross_validated


def test_cross_validation_prefers_the_setting_that_predicts():
    r = np.random.RandomState(1)
    rows = [np.unique(np.concatenate([r.randint(10, 500, 40), [3] if i % 4 == 0 else [5]])) for i in range(240)]
    y = np.array([float(i % 4 == 0) for i in range(240)])
    loss = cross_validated(np.concatenate(rows), np.concatenate([[0], np.cumsum([len(x) for x in rows])]), y, 512, [(LEAST, FULL), (1.0, FULL)])
    assert loss[LEAST, FULL] < loss[1.0, FULL] and loss[LEAST, FULL] < 0.5
