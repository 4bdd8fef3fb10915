"""Near vectors: no vector is copied to other cells or blocks."""

import numpy as np

from tilth.llm import metric


def test_what_is_written_does_not_grow_with_the_pairs(spark, monkeypatch):
    """Random vectors lie near all pivots: with copies in all cells they would be written once for each."""
    monkeypatch.setattr(metric, "CELL", 60)
    monkeypatch.setattr(metric, "BLOCK", 50)
    draw = np.random.default_rng(4)
    found = draw.normal(size=(1200, 16))
    found[600:606] = found[0] + 0.001 * draw.normal(size=(6, 16))
    rows = [(i, v.tolist(), 1) for i, v in enumerate(found)]
    made = {}

    def kept(df, label, real=metric.staged):
        made[label] = real(df, label)
        return made[label]

    monkeypatch.setattr(metric, "staged", kept)
    got = {r.id: r for r in metric.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), 0.99).collect()}
    assert "cells" not in made and made["blocks"].count() > 20
    assert sum(len(r.ids) for r in made["blocks"].select("ids").collect()) == 8 * 1200
    unit = found / np.linalg.norm(found, axis=1, keepdims=True)
    linked = (unit @ unit.T >= 0.99) & ~np.eye(1200, dtype=bool)
    assert linked.sum() >= 42 and [got[i].n_links for i in range(1200)] == linked.sum(axis=1).tolist()
    assert {got[i].component_id for i in (0, *range(600, 606))} == {0}
