"""Toxicity scores rank label 1 above label 0, also where few documents are labelled."""

from __future__ import annotations

import numpy as np

from pixelloom.llm import toxicity
from pixelloom.llm.common import table


def test_few_labels_still_rank_held_out_documents(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").where("toxic is not null").select("doc_id", "toxic")
    rows = toxicity.op3_toxicity(spark, sf_dir).where("held_out").join(labels, "doc_id").collect()
    high, low = (np.array([r.score for r in rows if r.toxic == y]) for y in (1, 0))
    assert len(high) and len(low)
    assert ((high[:, None] > low).mean() + (high[:, None] == low).mean() / 2) > 0.6


def test_the_curve_rises_whatever_its_documents():
    for x, y in (([0.1, 0.2], [0, 0]), ([], []), ([0.3, 0.1, 0.2], [0, 1, 1])):
        assert toxicity.fit_curve(np.array(x), np.array(y))[0] > 0
