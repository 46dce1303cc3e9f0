"""Scores of every one-position edit of a sequence from one forward and one backward table.

A position holds a set of accepted symbols: parallel arcs between two blanks, so a sum over all pronunciations is one pass. An edit changes the arcs
of one position only; what stands before and after it is in the tables already, so an edit costs one column of states, not a
pass of its own. Work is linear in frames x positions x symbols. One event is one row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strophe.functions.vectors import NEG

#: The candidate that stands for a deletion, and the one for the sequence as it is.
DELETION, WHOLE = -1, -2


def _lse(x: np.ndarray, axis: int = -1) -> np.ndarray:
    """Log-sum-exp; a sum over nothing or of impossible values only is -inf."""
    if x.shape[axis] == 0:
        return np.full(np.delete(x.shape, axis), -np.inf)
    top = x.max(axis=axis)
    safe = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return safe + np.log(np.exp(x - np.expand_dims(safe, axis)).sum(axis=axis))


def _other(values: np.ndarray, held: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """(..., P, N): log sum over the arcs of each position (..., P, W) whose symbol (P, W) differs from the wanted one (P, N)."""
    return _lse(np.where(held[:, None, :] != wanted[:, :, None], values[..., :, None, :], -np.inf))


def edit_table(matrix: np.ndarray, accepted: Sequence[Sequence[int]], symbols: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log sum over the accepted sequences, and (positions, symbols) and (positions,) of the same sum with one position replaced by
    a single symbol, or deleted. -inf where nothing fits into the frames."""
    lp = np.where(matrix <= NEG / 10, -np.inf, matrix)
    t_all, u, n = len(lp), len(accepted), len(symbols)
    if t_all == 0 or u == 0:
        return (float(lp[:, 0].sum()) if u == 0 and t_all else -np.inf), np.full((u, n), -np.inf), np.full(u, -np.inf)
    width = max(map(len, accepted))
    arcs = np.array([[*a, *[-1] * (width - len(a))] for a in accepted])  # -1: no arc
    emit = np.where(arcs >= 0, lp[:, np.maximum(arcs, 0)], -np.inf)  # frames, positions, arcs
    blank = lp[:, 0]
    none = np.full((1, width), -np.inf)

    fb, fl = np.full((t_all, u + 1), -np.inf), np.full((t_all, u, width), -np.inf)
    fb[0, 0], fl[0, 0] = blank[0], emit[0, 0]
    for t in range(1, t_all):
        crossed = np.concatenate([none, _other(fl[t - 1, :-1], arcs[:-1], arcs[1:])])
        fl[t] = emit[t] + np.logaddexp(np.logaddexp(fl[t - 1], fb[t - 1, :-1, None]), crossed)
        fb[t, 0] = blank[t] + fb[t - 1, 0]
        fb[t, 1:] = blank[t] + np.logaddexp(fb[t - 1, 1:], _lse(fl[t - 1]))

    bb, bl = np.full((t_all, u + 1), -np.inf), np.full((t_all, u, width), -np.inf)  # own frame included
    bb[-1, u], bl[-1, u - 1] = blank[-1], emit[-1, u - 1]
    for t in range(t_all - 2, -1, -1):
        crossed = np.concatenate([_other(bl[t + 1, 1:], arcs[1:], arcs[:-1]), none])
        bl[t] = emit[t] + np.logaddexp(np.logaddexp(bl[t + 1], bb[t + 1, 1:, None]), crossed)
        bb[t, u] = blank[t] + bb[t + 1, u]
        bb[t, :-1] = blank[t] + np.logaddexp(bb[t + 1, :-1], _lse(bl[t + 1]))

    whole = float(np.logaddexp(fb[-1, u], _lse(fl[-1, u - 1])))
    wanted = np.tile(symbols, (u, 1))
    new, total = np.full((u, n), -np.inf), np.full((u, n), -np.inf)  # in the replaced position now; left it or ended in it
    new[0] = lp[0, symbols]
    for t in range(t_all):
        if t:
            entered = np.concatenate([np.full((1, n), -np.inf), _other(fl[t - 1, :-1], arcs[:-1], wanted[1:])])
            new = lp[t, symbols] + np.logaddexp(new, np.logaddexp(fb[t - 1, :-1, None], entered))
        if t < t_all - 1:
            left = np.concatenate([_other(bl[t + 1, 1:], arcs[1:], wanted[:-1]), np.full((1, n), -np.inf)])
            total = np.logaddexp(total, new + np.logaddexp(bb[t + 1, 1:, None], left))
    total[-1] = np.logaddexp(total[-1], new[-1])

    gone = np.full(u, -np.inf)
    gone[-1] = fb[-1, u - 1] if u == 1 else np.logaddexp(fb[-1, u - 1], _lse(fl[-1, u - 2]))
    for p in range(u - 1):
        before = np.broadcast_to(fb[:-1, p, None], (t_all - 1, width))
        if p:
            before = np.logaddexp(before, _other(fl[:-1, p - 1, None], arcs[p - 1, None], arcs[p + 1, None])[:, 0])
        paths = np.where(arcs[p + 1] >= 0, before + bl[1:, p + 1], -np.inf)
        gone[p] = _lse(np.append(paths.ravel(), bl[0, 1] if p == 0 else []))
    return whole, total, gone


def edit_scores(matrices: DataFrame, targets: DataFrame, event: str, accepted: str, symbols: Sequence[int], partitions: int | None = None) -> DataFrame:
    """(event, position, candidate, log_score): mean likelihood over the accepted pronunciations, as a log.

    ``accepted`` is an array of arrays of symbols, one per position; repeated symbols count once. ``position`` is null (candidate -2) for the
    sequence as it is; other rows replace one position by a symbol it does not accept, or delete it (-1).
    Scores of what does not fit into the frames are null. Events without matrix or without positions give no edits.
    """
    wanted = np.array(sorted(symbols))
    kind = dict(targets.dtypes)[event]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own = [list(dict.fromkeys(a)) for a in batch.column(1)[i].as_py()]
                rows = batch.column(2)[i].values
                matrix = rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1) if rows is not None and len(rows) else np.zeros((0, 1))
                whole, total, gone = edit_table(matrix, own, wanted)
                count = np.log([float(len(a)) for a in own]) if own else np.zeros(0)
                scores = np.column_stack([total, gone]) - (count.sum() - count)[:, None] if own else np.zeros((0, len(wanted) + 1))
                cands = np.append(wanted, DELETION)
                keep = np.array([[c not in a for c in cands] for a in own], dtype=bool).reshape(scores.shape)
                at, which = np.nonzero(keep)
                value = np.append(whole - count.sum(), scores[at, which])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(np.full(len(value), i))), pa.array([None, *at.tolist()], pa.int32()), pa.array(np.append(WHOLE, cands[which]), pa.int32()),
                     pa.array(value, mask=~np.isfinite(value))], [event, "position", "candidate", "log_score"])

    todo = targets.select(event, accepted)
    if partitions:
        todo = todo.repartition(partitions, event)
    joined = todo.join(matrices.select(event, "matrix"), event).select(event, accepted, "matrix")
    return joined.mapInArrow(run, f"{event} {kind}, position int, candidate int, log_score double")
