"""What the registered training queries ask of the training job."""

from __future__ import annotations

import inspect

from tabscope.plans.training import train_candidates
from tabscope.queries import training


def test_queries_train_all_trees(spark, monkeypatch):
    asked = []

    def kept(*args, **named):
        bound = inspect.signature(train_candidates).bind(*args, **named)
        bound.apply_defaults()
        asked.append(bound.arguments["n_trees"])

    monkeypatch.setattr(training, "processed", lambda spark, sf: ("processed", "models"))
    monkeypatch.setattr(training, "train_candidates", kept)
    training.trained(spark, "tables")
    assert asked == [200]
