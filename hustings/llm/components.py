"""Components of links within a task; those of link tables are in operators.graph."""

from __future__ import annotations

import numpy as np

from hustings.operators.graph import components  # noqa: F401


def spanning(a: np.ndarray, b: np.ndarray, nodes: int) -> np.ndarray:
    """The smallest node of each node's component among 0..nodes-1 under edges a-b: enough for links to be handed on."""
    label = np.arange(nodes)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        np.minimum.at(new, label, new)
        while True:
            jump = new[new]
            if np.array_equal(jump, new):
                break
            new = jump
        if np.array_equal(new, label):
            return label
        label = new
