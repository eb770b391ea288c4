"""Linear classifiers on TF-IDF rows, many at a time.

Rows are stored count vectors. A variant is a training set of them: all rows but those of one fold, or all, with its own
vocabulary and weights. One pass over the rows gives losses and gradients of every model of every variant; a task adds up its
rows, a shuffle adds up the tasks. The driver holds the weights (variants x terms x classes) and moves each model by its own
limited-memory BFGS step, so all models advance together and a pass serves them all.

* softmax: logistic regression over all classes, sum of weighted losses plus half the squared weights, free intercepts;
* hinge: one class against the rest, squared hinge loss plus half the squared weights and intercepts; a row of the class
  weighs its class's weight, any other row one (with two classes every row weighs its class's weight);
* bayes: sums of the weights by class, from which multinomial naive Bayes follows in closed form.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedback_engine.session import materialize

SMOOTHING = 0.35
TOLERANCE = 1e-5  # largest entry of the gradient for each training row
MOST_STEPS = 300
MEMORY = 40
PACKED = 1 << 10  # entries to a packed row
ENTRIES = 1 << 16  # entries a task works on at a time
PIECE = 1 << 17  # entries of a training pass at a time
DENSE_SHARE = 0.02  # terms of so many of a piece's rows are multiplied as a dense matrix
DENSE_VALUES = 1 << 22  # of so many numbers at most
SUM_PARTS = 64  # parts in which the tasks' sums are added up


@dataclass(frozen=True)
class Variant:
    """A training set: the fold left out (none: -1), place of each stored term in its vocabulary (-1: not in it)."""

    left_out: int
    places: np.ndarray
    idf: np.ndarray
    class_weights: np.ndarray
    class_sizes: np.ndarray

    @property
    def n_rows(self) -> int:
        return int(self.class_sizes.sum())


def row_weigher(sublinear: bool) -> Callable:
    """Function of (row of each entry, rows, terms, counts, places, idf) -> (row, place, weight) of the kept entries.

    Weights are damped counts times idf, each row scaled to length one.
    """

    def weights(of, n_rows, terms, counts, places, idf):
        import numpy as np

        place = places[terms]
        kept = place >= 0
        of, place, x = of[kept], place[kept], counts[kept]
        x = (1 + np.log(x) if sublinear else x) * idf[place]
        length = np.sqrt(np.bincount(of, x * x, n_rows))
        return of, place, x / np.where(length > 0, length, 1)[of]

    return weights


def row_adder() -> Callable:
    """Function that adds the products of the entries (``of``: their rows, ascending) up by row."""

    def added(of, n_rows, products):
        import numpy as np

        out = np.zeros((n_rows, products.shape[1]))
        starts = np.flatnonzero(np.diff(of, prepend=-1))
        if len(starts):
            out[of[starts]] = np.add.reduceat(products, starts, axis=0)
        return out

    return added


def row_cutter(entries: int = ENTRIES) -> Callable:
    """Function of the rows' lengths -> slices of whole rows with about ``entries`` entries, so that a task's memory is bounded."""

    def slices(lengths):
        import numpy as np

        ends, row = np.cumsum(lengths, dtype=np.int64), 0
        while row < len(ends):
            stop = int(np.searchsorted(ends, ends[row] - lengths[row] + entries, "right"))
            stop = min(max(row + 1, stop), row + entries)
            yield slice(row, stop)
            row = stop

    return slices


def batch_cutter(column: int) -> Callable:
    """Function that cuts an Arrow batch by the lengths of its list ``column``."""
    slices = row_cutter()

    def cut(batch):
        import numpy as np

        for own in slices(np.diff(batch.column(column).offsets.to_numpy())):
            yield batch.slice(own.start, own.stop - own.start)

    return cut


def packed(rows: DataFrame, variants: Sequence[Variant] = (), sublinear: bool = False) -> DataFrame:
    """Stored rows (y, fold, terms, counts) as byte strings, many short rows to one, as each pass reads them all; written once.

    With ``variants`` each row's lengths in them go along as ``norms``, so that no pass need work them out again.
    """
    entries, with_norms = PACKED, bool(variants)
    columns = ["y", "fold", "lengths", "terms", "counts", *(["norms"] if with_norms else [])]
    shared = rows.sparkSession.sparkContext.broadcast([_by_term(s, s.idf) ** 2 for s in variants])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        squared = shared.value  # by variant and term
        for batch in batches:
            offsets = batch.column(2).offsets.to_numpy().astype(np.int64) - batch.column(2).offsets[0].as_py()
            lengths = np.diff(offsets).astype(np.int32)
            if not len(lengths):
                continue
            terms = batch.column(2).flatten().to_numpy().astype(np.int32)
            counts = batch.column(3).flatten().to_numpy().astype(np.int32)
            damped = 1 + np.log(counts) if sublinear else counts.astype(float)
            of, norms = np.repeat(np.arange(len(lengths)), lengths), np.empty((len(lengths), len(squared)))
            for which, by_term in enumerate(squared):
                norms[:, which] = np.sqrt(np.bincount(of, damped * damped * by_term[terms], len(lengths)))
            norms[norms == 0] = 1
            firsts = np.flatnonzero(np.diff(offsets[:-1] // entries, prepend=-1))  # whole rows of some hundred entries
            row_edges = np.append(firsts, len(lengths))
            parts = [
                (batch.column(0).to_numpy().astype(np.int32), row_edges), (batch.column(1).to_numpy().astype(np.int32), row_edges),
                (lengths, row_edges), (terms, offsets[row_edges]), (counts, offsets[row_edges]), *([(norms, row_edges)] if with_norms else []),
            ]
            yield pa.record_batch(
                [pa.Array.from_buffers(pa.binary(), len(firsts), [
                    None, pa.py_buffer((x.strides[0] * edges).astype(np.int32).tobytes()), pa.py_buffer(x.tobytes())])
                 for x, edges in parts], columns,
            )

    schema = ", ".join(f"{c} binary" for c in columns)
    return materialize(rows.select("y", "fold", "terms", "counts").mapInArrow(run, schema), "training-packed")


def _by_term(variant: Variant, values: np.ndarray) -> np.ndarray:
    """Values by place in the variant's vocabulary -> by stored term, zero for terms outside it."""
    kept = variant.places >= 0
    out = np.zeros((*values.shape[1:], len(kept)))
    out[..., kept] = values[variant.places[kept]].T
    return out


def unpacker() -> Callable:
    """Function of a batch of packed rows -> pieces of whole rows: (y, fold, row of each entry, terms, counts, norms if there)."""
    slices = row_cutter(PIECE)

    def flat(column, kind):
        import numpy as np
        import pyarrow as pa

        wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
        edges = np.frombuffer(column.buffers()[1], wide)[column.offset : column.offset + len(column) + 1]
        values = column.buffers()[2]
        return np.frombuffer(values[edges[0] : edges[-1]], kind) if values and edges[-1] > edges[0] else np.zeros(0, kind)

    def pieces(batch):
        import numpy as np

        if not batch.num_rows:
            return
        y, fold, lengths, terms, counts = (flat(column, np.int32) for column in batch.columns[:5])
        norms = [flat(column, np.float64).reshape(len(y), -1) for column in batch.columns[5:]]
        ends = np.cumsum(lengths, dtype=np.int64)
        for rows in slices(lengths):
            own, n = slice(ends[rows.start] - lengths[rows.start], ends[rows.stop - 1]), rows.stop - rows.start
            yield y[rows], fold[rows], np.repeat(np.arange(n), lengths[rows]), terms[own], counts[own], *[x[rows] for x in norms]

    return pieces


def row_products() -> Callable:
    """Function of a piece (row of each entry, rows, terms, values) and the number of terms -> (ahead, back): products of the
    rows with weights (columns x terms), and of pulls (rows x columns) with the rows.

    Terms that many rows hold are multiplied as a dense matrix, the others entry by entry.
    """
    share, most = DENSE_SHARE, DENSE_VALUES

    def products(of, n, terms, values, size_of):
        import numpy as np

        often = np.bincount(terms, minlength=size_of)
        dense = np.flatnonzero(often >= max(4, share * n))
        if len(dense) * n > most:
            dense = np.sort(dense[np.argsort(-often[dense], kind="stable")[: most // n]])
        column = np.full(size_of, -1)
        column[dense] = np.arange(len(dense))
        at = column[terms]
        thick, rare = np.zeros((n, len(dense))), at < 0
        thick[of[~rare], at[~rare]] = values[~rare]
        of, terms, values = of[rare], terms[rare], values[rare]

        def ahead(weights):
            out = thick @ weights[:, dense].T
            for c, w in enumerate(weights):
                out[:, c] += np.bincount(of, w[terms] * values, n)
            return out

        def back(pulls, totals):
            totals[:, dense] += pulls.T @ thick
            for total, pull in zip(totals, np.ascontiguousarray(pulls.T)):
                total += np.bincount(terms, pull[of] * values, size_of)

        return ahead, back

    return products


def _sums(
    stored: DataFrame, variants: Sequence[Variant], kinds: Sequence[str], thick: list[np.ndarray], sublinear: bool,
    live: Sequence[Sequence[int]] | None = None, own: Sequence[int] | None = None,
) -> list[np.ndarray]:
    """Per variant: an array (terms + 2) x columns: gradient by term, by intercept, and losses in the last row.

    ``stored``: packed rows; ``thick``: weights (terms + 1) x columns, classes of each kind side by side; ``live``: columns of
    each variant that are still wanted, the others stay zero; ``own``: places of the variants among those the rows were packed for.
    """
    columns, power = thick[0].shape[1], 2 if kinds[0] == "squares" else 1
    wanted = [list(range(columns)) if live is None else list(c) for c in live or [None] * len(variants)]
    edges = np.cumsum([0, *map(len, wanted)]).tolist()
    scales = [_by_term(s, s.idf) for s in variants]
    weights = np.concatenate([_by_term(s, w[:-1][:, c]) * scale for s, w, c, scale in zip(variants, thick, wanted, scales)])
    plain = [
        (s.left_out, which if own is None else own[which], w[-1], s.class_weights, c, slice(low, high))
        for which, (s, w, c, low, high) in enumerate(zip(variants, thick, wanted, edges, edges[1:]))
    ]
    moving, names = kinds[0] not in ("bayes", "squares"), list(kinds)
    size_of = weights.shape[1]
    shared = stored.sparkSession.sparkContext.broadcast((plain, weights if moving else None))
    pieces, products, parts = unpacker(), row_products(), SUM_PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        sets, by_term = shared.value
        totals, ends = np.zeros((edges[-1], size_of)), np.zeros((edges[-1], 2))
        for batch in batches:
            for y, fold, of, terms, counts, norms in pieces(batch):
                damped = 1 + np.log(counts) if sublinear else counts.astype(float)
                ahead, back = products(of, len(y), terms, damped**power if power > 1 else damped, size_of)
                raw = ahead(by_term) if moving else None
                pulls = np.empty((len(y), edges[-1]))
                for left_out, which, free, class_weights, live_columns, at in sets:
                    used, n_classes = (fold != left_out).astype(float), len(class_weights)
                    norm = norms[:, which, None] ** power
                    z = np.zeros((len(y), columns)) + free
                    if moving:
                        z[:, live_columns] += raw[:, at] / norm
                    truth = np.eye(n_classes)[y]
                    pull, losses = np.zeros_like(z), np.zeros(columns)
                    for k, name in enumerate(names):
                        part = slice(k * n_classes, (k + 1) * n_classes)
                        if not any(part.start <= c < part.stop for c in live_columns):
                            continue
                        if name == "softmax":
                            shifted = z[:, part] - z[:, part].max(axis=1, keepdims=True)
                            odds = np.exp(shifted)
                            size = class_weights[y] * used
                            pull[:, part] = size[:, None] * (odds / odds.sum(axis=1, keepdims=True) - truth)
                            losses[part.start] = (size * (np.log(odds.sum(axis=1)) - (shifted * truth).sum(axis=1))).sum()
                        elif name == "hinge":
                            side = 2 * truth - 1
                            size = np.where(truth > 0, class_weights, 1.0) if n_classes > 2 else class_weights[y][:, None]
                            size = size * used[:, None]
                            short = np.maximum(0, 1 - side * z[:, part])
                            pull[:, part] = -2 * size * side * short
                            losses[part] = (size * short * short).sum(axis=0)
                        else:
                            pull[:, part] = truth * used[:, None]
                    pulls[:, at] = pull[:, live_columns] / norm
                    ends[at, 0] += pull[:, live_columns].sum(axis=0)
                    ends[at, 1] += losses[live_columns]
                back(pulls, totals)
        flat = np.concatenate([totals, ends], axis=1).ravel()
        cuts = [flat[len(flat) * i // parts : len(flat) * (i + 1) // parts].tobytes() for i in range(parts)]
        task = np.full(parts, TaskContext.get().partitionId(), np.int32)
        yield pa.record_batch([pa.array(range(parts), pa.int32()), pa.array(task), pa.array(cuts, pa.binary())], ["part", "task", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        found: dict = {}
        for batch in batches:
            for part, sums in zip(batch.column(0).to_pylist(), batch.column(2)):
                values = np.frombuffer(sums.as_buffer())
                if part in found:
                    found[part] += values
                else:
                    found[part] = values.copy()
        yield pa.record_batch([pa.array(list(found), pa.int32()), pa.array([x.tobytes() for x in found.values()], pa.binary())], ["part", "sums"])

    dealt = stored.mapInArrow(run, "part int, task int, sums binary").repartition(
        min(parts, stored.sparkSession.sparkContext.defaultParallelism), "part"
    ).sortWithinPartitions("part", "task")  # sums of doubles depend on the order of addition
    rows = sorted(dealt.mapInArrow(add, "part int, sums binary").collect())  # as many numbers as the weights
    shared.unpersist()
    flat = np.concatenate([np.frombuffer(r["sums"]) for r in rows]) if rows else np.zeros(edges[-1] * (size_of + 2))
    out = []
    for s, w, c, scale, low, high in zip(variants, thick, wanted, scales, edges, edges[1:]):
        found = flat.reshape(edges[-1], size_of + 2)[low:high]
        kept = s.places >= 0  # terms outside the vocabulary weigh nothing
        sums = np.zeros((len(w) + 1, columns))
        sums[np.ix_(s.places[kept], c)] = (found[:, :-2] * scale**power)[:, kept].T
        sums[-2:, c] = found[:, -2:].T
        out.append(sums)
    return out


def descent(
    start: np.ndarray, tolerance: float, curvature: np.ndarray | None = None
) -> Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]:
    """Limited-memory BFGS: yields points, is sent (value, gradient) there, returns the minimum.

    ``curvature``: second derivative of each coordinate, about; steps are taken in coordinates scaled by its root, so that
    frequent and rare terms move alike. The tolerance holds for the gradient as sent.
    """
    scale = np.sqrt(curvature) if curvature is not None else np.ones_like(start)
    x = start * scale
    value, gradient = yield start
    gradient = gradient / scale
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(MOST_STEPS):
        if np.abs(gradient * scale).max(initial=0.0) <= tolerance:
            break
        way, used = -gradient, []
        for s, y in reversed(steps):
            used.append((s @ way) / (s @ y))
            way = way - used[-1] * y
        if steps:
            s, y = steps[-1]
            way = way * (s @ y) / (y @ y)
        for (s, y), a in zip(steps, reversed(used), strict=True):
            way = way + (a - (y @ way) / (s @ y)) * s
        slope = gradient @ way
        if slope >= 0:
            steps, way, slope = [], -gradient, -gradient @ gradient
        length = 1.0 if steps else min(1.0, 1.0 / np.abs(gradient * scale if curvature is None else gradient).max())
        while True:
            new = x + length * way
            new_value, new_gradient = yield new / scale
            new_gradient = new_gradient / scale
            if new_value <= value + 1e-4 * length * slope or length < 1e-12:
                break
            length /= 2
        if new_value > value:
            break
        s, y = new - x, new_gradient - gradient
        if s @ y > 1e-12 * (y @ y):
            steps = [*steps[1 - MEMORY :], (s.astype(np.float32), y.astype(np.float32))]  # they only steer
        x, value, gradient = new, new_value, new_gradient
    return x / scale


def _curvature(squares: np.ndarray, variant: Variant, kind: str) -> np.ndarray:
    """Second derivatives of a kind's objective at zero, (terms + 1) x classes, from the sums of squared weights by class."""
    n_classes = len(variant.class_weights)
    if kind == "softmax" or n_classes == 2:
        summed = (squares * variant.class_weights).sum(axis=1, keepdims=True) * np.ones(n_classes)
    else:
        summed = squares.sum(axis=1, keepdims=True) + squares * (variant.class_weights - 1)
    if kind == "hinge":
        return 1 + 2 * summed
    out = summed * (n_classes - 1) / n_classes**2
    out[:-1] += 1  # free intercepts
    return out


def fit(rows: DataFrame, variants: Sequence[Variant], kinds: Sequence[str], sublinear: bool) -> list[dict[str, np.ndarray]]:
    """Weights (terms + 1) x classes of each kind in each variant; the last row holds the intercepts."""
    n_classes = len(variants[0].class_weights)
    fitted: list[dict[str, np.ndarray]] = [{} for _ in variants]
    rows, zero = packed(rows, variants, sublinear), [np.zeros((len(s.idf) + 1, n_classes)) for s in variants]
    if "bayes" in kinds:
        for which, sums in enumerate(_sums(rows, variants, ["bayes"], zero, sublinear)):
            smooth = sums[:-2] + SMOOTHING
            prior = np.log(variants[which].class_sizes / variants[which].n_rows)
            fitted[which]["bayes"] = np.vstack([np.log(smooth) - np.log(smooth.sum(axis=0)), prior])
    moved = [k for k in kinds if k != "bayes"]
    # classes of one softmax move together, the rest of a kind's columns are problems of their own
    columns = {
        (k, part): slice(at * n_classes + part, at * n_classes + (n_classes if k == "softmax" else part + 1))
        for at, k in enumerate(moved) for part in ([0] if k == "softmax" else range(n_classes))
    }
    weights = [np.zeros((len(s.idf) + 1, len(moved) * n_classes)) for s in variants]
    points = {}  # (variant, problem) -> generator of its points; the current one stands in ``weights``
    squares = _sums(rows, variants, ["squares"], zero, sublinear) if moved else []
    for which, (s, squared) in enumerate(zip(variants, squares)):
        curvature = np.hstack([_curvature(squared[:-1], s, kind) for kind in moved])
        for problem, own in columns.items():
            points[which, problem] = descent(weights[which][:, own].ravel(), TOLERANCE * s.n_rows, curvature[:, own].ravel())
            next(points[which, problem])
    while points:
        still = sorted({which for which, _ in points})
        live = [[c for problem, own in columns.items() if (w, problem) in points for c in range(own.start, own.stop)] for w in still]
        sums = _sums(rows, [variants[w] for w in still], moved, [weights[w] for w in still], sublinear, live, still)
        for which, found in zip(still, sums, strict=True):
            for problem, own in columns.items():
                if (which, problem) not in points:
                    continue
                held = weights[which][:, own].copy()
                if problem[0] == "softmax":
                    held[-1] = 0  # free intercepts
                value, gradient = found[-1, own].sum() + (held * held).sum() / 2, found[:-1, own] + held
                try:
                    point = points[which, problem].send((float(value), gradient.ravel()))
                except StopIteration as done:
                    point = done.value
                    del points[which, problem]
                weights[which][:, own] = point.reshape(held.shape)
    for which in range(len(variants)):
        for at, kind in enumerate(moved):
            fitted[which][kind] = weights[which][:, at * n_classes : (at + 1) * n_classes]
    return fitted


def scored(rows: DataFrame, keep: Sequence[str], variants: Sequence[Variant], fitted: list[dict[str, np.ndarray]], kinds: Sequence[str], sublinear: bool) -> DataFrame:
    """(keep, kind, raw): scores of each row by every kind of the variant that leaves its fold out, in one pass."""
    by_fold = {s.left_out: (s.places, s.idf, np.hstack([fitted[i][k] for k in kinds])) for i, s in enumerate(variants)}
    shared = rows.sparkSession.sparkContext.broadcast((by_fold, list(kinds)))
    weigh, by_row, cut = row_weigher(sublinear), row_adder(), batch_cutter(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        models, names = shared.value
        for batch in (piece for whole in batches for piece in cut(whole)):
            fold = batch.column(0).to_numpy()
            lengths = np.diff(batch.column(1).offsets.to_numpy())
            of_all = np.repeat(np.arange(len(fold)), lengths)
            terms, counts = batch.column(1).flatten().to_numpy(), batch.column(2).flatten().to_numpy()
            raw = None
            for f, (places, idf, w) in models.items():
                if raw is None:
                    raw = np.zeros((len(fold), w.shape[1]))
                own = (fold == f)[of_all]
                of, place, x = weigh(of_all[own], len(fold), terms[own], counts[own], places, idf)
                raw += by_row(of, len(fold), w[place] * x[:, None])
                raw[fold == f] += w[-1]
            n_classes = raw.shape[1] // len(names)
            for k, name in enumerate(names):
                values = raw[:, k * n_classes : (k + 1) * n_classes]
                yield pa.record_batch(
                    [*batch.columns[3:], pa.array([name] * len(fold)), pa.array(list(values), pa.list_(pa.float64()))],
                    [*keep, "kind", "raw"],
                )

    kept = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.select("fold", "terms", "counts", *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)]).mapInArrow(
        run, f"{kept}, kind string, raw array<double>"
    )
