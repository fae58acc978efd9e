"""Cut detection on the activity graph of one sublog (bounded by its alphabet, not by its traces).

The published inductive-mining cuts in order: exclusive choice, sequence,
parallel, loop. Activities are sorted, so results do not depend on row order.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Graph:
    acts: list[str]
    follows: np.ndarray  # follows[i, j]: j comes right after i somewhere
    starts: np.ndarray
    ends: np.ndarray


def components(linked: np.ndarray) -> np.ndarray:
    """Component number per node of an undirected relation."""
    label = np.full(len(linked), -1)
    linked = linked | linked.T
    for seed in range(len(linked)):
        if label[seed] >= 0:
            continue
        front = [seed]
        label[seed] = seed
        while front:
            fresh = np.flatnonzero(linked[front].any(axis=0) & (label < 0))
            label[fresh] = seed
            front = fresh.tolist()
    return np.unique(label, return_inverse=True)[1]


def _parts(label: np.ndarray) -> list[list[int]]:
    return [np.flatnonzero(label == k).tolist() for k in range(label.max() + 1)]


def choice_cut(g: Graph) -> list[list[int]] | None:
    parts = _parts(components(g.follows))
    return parts if len(parts) > 1 else None


def sequence_cut(g: Graph) -> list[list[int]] | None:
    reach = g.follows.astype(bool)
    while True:
        wider = reach | (reach.astype(np.float32) @ reach.astype(np.float32) > 0)
        if (wider == reach).all():
            break
        reach = wider
    parts = _parts(components(reach == reach.T))  # each reaches the other, or neither does
    if len(parts) == 1:
        return None
    return sorted(parts, key=lambda part: -int(reach[part].any(axis=0).sum() - reach[np.ix_(part, part)].any(axis=0).sum()))


def parallel_cut(g: Graph) -> list[list[int]] | None:
    parts = _parts(components(~(g.follows & g.follows.T)))
    whole = [p for p in parts if g.starts[p].any() and g.ends[p].any()]
    if not whole:
        return None
    only_start = [p for p in parts if g.starts[p].any() and not g.ends[p].any()]
    only_end = [p for p in parts if g.ends[p].any() and not g.starts[p].any()]
    whole += [s + e for s, e in zip(only_start, only_end)]
    paired = min(len(only_start), len(only_end))
    rest = only_start[paired:] + only_end[paired:]
    rest += [p for p in parts if not g.starts[p].any() and not g.ends[p].any()]
    for part in rest:
        whole[0] = whole[0] + part
    return sorted(map(sorted, whole)) if len(whole) > 1 else None


def loop_cut(g: Graph) -> list[list[int]] | None:
    """Do part first, then the redo parts."""
    border = g.starts | g.ends
    inner = np.flatnonzero(~border)
    if not len(inner):
        return None
    redo, do = [], np.flatnonzero(border).tolist()
    for part in _parts(components(g.follows[np.ix_(inner, inner)])):
        part = inner[part].tolist()
        from_ends, to_starts = g.follows[np.ix_(g.ends, part)], g.follows[np.ix_(part, g.starts)]
        outside = (
            g.follows[np.ix_(g.starts & ~g.ends, part)].any()
            or g.follows[np.ix_(part, g.ends & ~g.starts)].any()
            or (from_ends.any(axis=0) != from_ends.all(axis=0)).any()
            or (to_starts.any(axis=1) != to_starts.all(axis=1)).any()
        )
        if outside:
            do += part
        else:
            redo.append(part)
    return [sorted(do), *redo] if redo else None


def find_cut(g: Graph) -> tuple[str, list[list[str]]] | None:
    if len(g.acts) < 2:
        return None
    for rule, cut in (("Xor", choice_cut), ("Seq", sequence_cut), ("And", parallel_cut), ("XorLoop", loop_cut)):
        parts = cut(g)
        if parts:
            return rule, [[g.acts[i] for i in part] for part in parts]
    return None
