"""Partial-likelihood sums over risk sets (numpy, run inside tasks).

Rows are frequency-weighted patterns (stratum, time, event, covariates). For given
coefficients the functions return log likelihood, score and information with Efron's
treatment of ties. Strata are independent, so the sums of different tasks add up.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa

# Rows whose sums are made together, about (whole strata); rows of a stored block, about.
ROWS_AT_ONCE = 20_000
ROWS_PER_BLOCK = 50_000
DIRECT_TIES = 20_000
TAIL_TIES = 2_000


def tie_sums(s0: float, d0: float, d: int) -> np.ndarray:
    """Sums over l < d of [ln a, 1/a, f/a, 1/a², f/a², f²/a²], a = s0 - f·d0, f = l/d.

    Many ties are summed directly only near the end, where the terms change fast; the
    smooth start uses the Euler-Maclaurin formula, exact to double precision there.
    """

    def terms(f):
        a = s0 - f * d0
        inv = 1.0 / a
        return np.array([np.log(a), inv, f * inv, inv * inv, f * inv * inv, f * f * inv * inv])

    if d <= DIRECT_TIES:
        return terms(np.arange(d) / d).sum(axis=1)
    cut = d - TAIL_TIES
    tail = terms(np.arange(cut, d) / d).sum(axis=1)
    # head: l = 0 .. cut - 1 as 64 panels of Gauss-Legendre for the integral plus end corrections
    nodes, weights = np.polynomial.legendre.leggauss(16)
    edges = d - np.geomspace(float(d), float(TAIL_TIES), 65)
    lo, hi = edges[:-1, None], edges[1:, None]
    l = (lo + hi) / 2 + (hi - lo) / 2 * nodes
    wts = ((hi - lo) / 2 * weights).ravel()
    integral = (terms(l.ravel() / d) * wts).sum(axis=1)
    h = 1e-3

    def slope(x):
        return (terms(np.array([(x + h) / d]))[:, 0] - terms(np.array([(x - h) / d]))[:, 0]) / (2 * h)

    ends = terms(np.array([0.0, cut / d]))
    return tail + integral + (ends[:, 0] - ends[:, 1]) / 2 + (slope(float(cut)) - slope(0.0)) / 12


def _tie_sums_per_cell(s0, d0, d) -> np.ndarray:
    """Row per cell of :func:`tie_sums`; cells with few ties are handled together."""
    out = np.zeros((len(d), 6))
    small = d <= DIRECT_TIES
    if small.any():
        idx = np.flatnonzero(small)
        sizes = d[idx].astype(np.int64)
        # blocks keep the expanded arrays small
        block = np.cumsum(sizes) // 2_000_000
        for b in np.unique(block):
            sel = idx[block == b]
            n = d[sel].astype(np.int64)
            cell = np.repeat(np.arange(len(sel)), n)
            l = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            f = l / n[cell]
            a = s0[sel][cell] - f * d0[sel][cell]
            inv = 1.0 / a
            for k, v in enumerate((np.log(a), inv, f * inv, inv * inv, f * inv * inv, f * f * inv * inv)):
                out[sel, k] = np.bincount(cell, weights=v, minlength=len(sel))
    for i in np.flatnonzero(~small):
        out[i] = tie_sums(float(s0[i]), float(d0[i]), int(d[i]))
    return out


def tie_scores(fits: list[str]):
    """Arrow batches of cells (counts at zero effect) to score and information of each cell."""

    def run(batches):
        for b in batches:
            s0, s1, s2, d, d1, d2 = (b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("s0", "s1", "s2", "d", "d1", "d2"))
            _, h0, h1, g0, g1, g2 = _tie_sums_per_cell(s0, d, d).T
            score = d1 - (s1 * h0 - d1 * h1)
            info = s2 * h0 - d2 * h1 - (s1 * s1 * g0 - 2 * s1 * d1 * g1 + d1 * d1 * g2)
            kept = [b.column(c) for c in fits]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(score), pa.array(info)], names=[*fits, "score", "information"])

    return run


def _running_within(values: np.ndarray, position: np.ndarray) -> np.ndarray:
    """Cumulative sum of cell rows inside each stratum; ``position`` counts from 0."""
    out = values.copy()
    for k in range(1, int(position.max()) + 1 if len(position) else 0):
        at = np.flatnonzero(position == k)
        out[at] += out[at - 1]
    return out


def dense(x, p: int) -> np.ndarray:
    """Rows with all their columns: a matrix as it is, entries (column numbers, values) added up."""
    if not isinstance(x, tuple):
        return x
    at, v = x
    cells = np.arange(len(at))[:, None] * p + at
    return np.bincount(cells.ravel(), v.ravel(), len(at) * p).reshape(len(at), p)


def totals(stratum, time, event, weight, x, beta) -> tuple[float, np.ndarray, np.ndarray]:
    """Log likelihood, score and information of whole strata, some of them at a time.

    ``x`` is a matrix, or the entries (column numbers, values) of its rows; the rows at hand get all
    their columns.
    """
    order = np.lexsort((-time, stratum))
    x = (x[0][order], x[1][order]) if isinstance(x, tuple) else x[order]
    return _ordered_totals(*(c[order] for c in (stratum, time, event, weight)), x, beta)


def _cuts(stratum: np.ndarray, rows: int) -> list[int]:
    """Where runs of whole strata of about so many rows begin, and the end; strata are in order."""
    starts = np.flatnonzero(np.r_[True, stratum[1:] != stratum[:-1]])
    return [*starts[np.flatnonzero(np.diff(np.r_[-1, starts // rows]))].tolist(), len(stratum)]


def _ordered_totals(stratum, time, event, weight, x, beta) -> tuple[float, np.ndarray, np.ndarray]:
    """:func:`totals` of rows that are in order of stratum and falling time."""
    p, cuts = len(beta), _cuts(stratum, ROWS_AT_ONCE)
    loglik, score, info = 0.0, np.zeros(p), np.zeros((p, p))
    for lo, hi in zip(cuts, cuts[1:]):
        some = dense((x[0][lo:hi], x[1][lo:hi]), p) if isinstance(x, tuple) else x[lo:hi]
        own = _sorted_totals(stratum[lo:hi], time[lo:hi], event[lo:hi], weight[lo:hi], some, beta)
        loglik, score, info = loglik + own[0], score + own[1], info + own[2]
    return loglik, score, info


def _sorted_totals(stratum, time, event, weight, x, beta) -> tuple[float, np.ndarray, np.ndarray]:
    """:func:`totals` of a matrix whose rows are in order of stratum and falling time."""
    new_stratum = np.r_[True, stratum[1:] != stratum[:-1]]
    new_cell = new_stratum | np.r_[True, time[1:] != time[:-1]]
    cell_start = np.flatnonzero(new_cell)
    cell_of = np.cumsum(new_cell) - 1
    stratum_of = np.cumsum(new_stratum) - 1
    eta = x @ beta
    # a constant per stratum cancels; removing the largest avoids overflow
    eta = eta - np.maximum.reduceat(eta, np.flatnonzero(new_stratum))[stratum_of]
    risk = weight * np.exp(eta)
    dead = weight * event

    first_cell = np.flatnonzero(new_stratum[cell_start])
    cells_in = np.diff(np.r_[first_cell, len(cell_start)])
    position = np.arange(len(cell_start)) - np.repeat(first_cell, cells_in)

    s0 = _running_within(np.add.reduceat(risk, cell_start), position)
    s1 = _running_within(np.add.reduceat(risk[:, None] * x, cell_start, axis=0), position)
    d0 = np.add.reduceat(risk * event, cell_start)
    d1 = np.add.reduceat((risk * event)[:, None] * x, cell_start, axis=0)
    d = np.rint(np.add.reduceat(dead, cell_start))

    sums = np.zeros((len(cell_start), 6))
    has = d > 0
    sums[has] = _tie_sums_per_cell(s0[has], d0[has], d[has])
    log_a, h0, h1, g0, g1, g2 = sums.T

    # each row stays at risk in its own and all earlier event cells of its stratum
    back = np.repeat(cells_in, cells_in) - 1 - position
    reversed_h0 = _running_within(h0[::-1].copy(), back[::-1])[::-1]
    multiplier = risk * (reversed_h0[cell_of] - event * h1[cell_of])

    loglik = float((dead * eta).sum() - log_a.sum())
    score = dead @ x - multiplier @ x
    cross = s1.T @ (g1[:, None] * d1)
    outer = s1.T @ (g0[:, None] * s1) - cross - cross.T + d1.T @ (g2[:, None] * d1)
    info = x.T @ (multiplier[:, None] * x) - outer
    return loglik, score, info


def own_cells(stratum, time, event, weight, x, beta, top) -> list[tuple[int, float, np.ndarray]]:
    """(stratum, time, sums) of the rows at hand: what each (stratum, time) adds to its risk set.

    ``top`` is taken off the linear predictors; it is the same for all parts of a stratum, so
    the sums of the parts add up.
    """
    x = dense(x, len(beta))
    order = np.lexsort((-time, stratum))
    stratum, time, event, weight, x = (v[order] for v in (stratum, time, event, weight, x))
    start = np.flatnonzero(np.r_[True, (stratum[1:] != stratum[:-1]) | (time[1:] != time[:-1])])
    eta = x @ beta - top[order]
    risk = weight * np.exp(eta)
    out = []
    for a, b in zip(start, np.r_[start[1:], len(time)]):
        xi, ri, di = x[a:b], risk[a:b], risk[a:b] * event[a:b]
        dead = weight[a:b] * event[a:b]
        squares = [xi.T @ (v[:, None] * xi) for v in (ri, di)]
        own = [[dead.sum(), (dead * eta[a:b]).sum(), ri.sum(), di.sum()], dead @ xi, ri @ xi, di @ xi, *[m[np.triu_indices(len(beta))] for m in squares]]
        out.append((stratum[a], time[a], np.concatenate(own)))
    return out


def _at_risk(cells: np.ndarray, p: int) -> np.ndarray:
    """The part of cell sums that stays at risk at earlier times: S0, S1 and the triangle of S2."""
    pairs = p * (p + 1) // 2
    return np.concatenate([cells[:, 2:3], cells[:, 4 + p : 4 + 2 * p], cells[:, 4 + 3 * p : 4 + 3 * p + pairs]], axis=1)


def combine_cells(cells: np.ndarray, later: np.ndarray, p: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Log likelihood, score and information of successive times, latest first.

    ``cells`` are sums of :func:`own_cells`, ``later`` is what is at risk after them.
    """
    pairs, upper = p * (p + 1) // 2, np.triu_indices(p)
    risk = later + np.cumsum(_at_risk(cells, p), axis=0)
    at = np.rint(cells[:, 0]) > 0
    cells, risk = cells[at], risk[at]
    s0, s1, s2 = risk[:, 0], risk[:, 1 : 1 + p], risk[:, 1 + p :]
    d1, d2 = cells[:, 4 + 2 * p : 4 + 3 * p], cells[:, 4 + 3 * p + pairs :]
    log_a, h0, h1, g0, g1, g2 = _tie_sums_per_cell(s0, cells[:, 3], np.rint(cells[:, 0])).T
    loglik = float(cells[:, 1].sum() - log_a.sum())
    score = cells[:, 4 : 4 + p].sum(axis=0) - h0 @ s1 + h1 @ d1
    triangle = h0 @ s2 - h1 @ d2
    cross = s1.T @ (g1[:, None] * d1)
    info = np.zeros((p, p))
    info[upper] = triangle
    info += np.triu(info, 1).T
    return loglik, score, info - (s1.T @ (g0[:, None] * s1) - cross - cross.T + d1.T @ (g2[:, None] * d1))


def pack(loglik: float, score: np.ndarray, info: np.ndarray) -> np.ndarray:
    """One vector of log likelihood, score and the upper triangle of the information."""
    return np.concatenate([[loglik], score, info[np.triu_indices(len(score))]])


def _codes(column) -> tuple[np.ndarray, list]:
    encoded = pa.chunked_array(column).combine_chunks().dictionary_encode()
    if isinstance(encoded, pa.ChunkedArray):
        encoded = encoded.combine_chunks()
    return encoded.indices.to_numpy(zero_copy_only=False), encoded.dictionary.to_pylist()


def entries_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Column numbers and values of the rows of a table, as many for each row."""
    flat = [table.column(c).combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1) for c in ("at", "v")]
    return flat[0].astype(np.int64), flat[1]


def _by_fit(batches, betas: dict[str, np.ndarray] | None, large: bool):
    """(fit, stratum numbers, stratum, time, event, weight, x) of each fit (or each in ``betas``) of a partition."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    table = pa.Table.from_batches(batches)
    fit_code, fit_names = _codes(table.column("fit").chunks)
    stratum, stratum_names = _codes(table.column("stratum").chunks)
    time, event, weight, spread = (table.column(c).to_numpy() for c in ("time", "event", "weight", "large"))
    at, v = entries_of(table)
    order = np.argsort(fit_code, kind="stable")
    order = order[spread[order] == large]
    starts = np.flatnonzero(np.diff(fit_code[order])) + 1
    for sel in np.split(order, starts):
        if len(sel) and (betas is None or fit_names[fit_code[sel[0]]] in betas):
            yield fit_names[fit_code[sel[0]]], stratum_names, stratum[sel], time[sel], event[sel].astype(float), weight[sel], (at[sel], v[sel])


def _vector_batch(names: list[str], columns: list, vectors: list[np.ndarray]) -> pa.RecordBatch:
    flat = np.concatenate(vectors) if vectors else np.zeros(0)
    cuts = np.cumsum([0, *[len(v) for v in vectors]]).astype(np.int32)
    return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat))], names=[*names, "v"])


def partition_sums(betas: dict[str, np.ndarray]):
    """Arrow batches of one partition to packed sums per fit; strata marked large are left out."""

    def run(batches):
        for fit, _, *rows in _by_fit(batches, betas, False):
            yield _vector_batch(["fit"], [pa.array([fit])], [pack(*totals(*rows, betas[fit]))])

    return run


def laid_out(batches):
    """Patterns of a partition as compressed blocks of whole strata in order: (fit, data, fixed).

    Strata whose patterns are alike in all columns add the same to the log likelihood at any
    coefficients and nothing to its derivatives: only that sum is kept (``fixed``, in one row of the fit).
    Strata marked large are left out.
    """
    names = ["fit", "data", "fixed"]
    for fit, _, stratum, time, event, weight, (at, v) in _by_fit(batches, None, False):
        order = np.lexsort((-time, stratum))
        stratum, time, event, weight, at, v = (c[order] for c in (stratum, time, event, weight, at, v))
        starts = np.flatnonzero(np.r_[True, stratum[1:] != stratum[:-1]])
        sizes = np.diff(np.r_[starts, len(stratum)])
        first = np.repeat(starts, sizes)
        differs = ((at != at[first]) | (v != v[first])).any(axis=1)
        varied = np.repeat(np.logical_or.reduceat(differs, starts), sizes)
        alike = ~varied
        fixed = 0.0
        if alike.any():
            fixed = _sorted_totals(*(c[alike] for c in (stratum, time, event, weight)), np.zeros((int(alike.sum()), 1)), np.zeros(1))[0]
        stratum, time, event, weight, at, v = (c[varied] for c in (stratum, time, event, weight, at, v))
        cuts = _cuts(stratum, ROWS_PER_BLOCK) if len(stratum) else [0]
        if len(cuts) == 1:
            yield pa.RecordBatch.from_arrays([pa.array([fit]), pa.array([None], pa.binary()), pa.array([fixed])], names=names)
        for lo, hi in zip(cuts, cuts[1:]):
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(c[lo:hi].ravel()), c.shape[1]) for c in (at.astype(np.int32), v)]
            own = [stratum[lo:hi].astype(np.int32), time[lo:hi], event[lo:hi].astype(np.int8), weight[lo:hi]]
            table = pa.RecordBatch.from_arrays([*map(pa.array, own), *lists], names=["stratum", "time", "event", "weight", "at", "v"])
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                stream.write_batch(table)
            block = pa.array([out.getvalue().to_pybytes()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([fit]), block, pa.array([fixed if lo == 0 else 0.0])], names=names)


def block_sums(betas: dict[str, np.ndarray]):
    """Arrow batches of blocks to packed sums of each fit."""

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for fit, data in zip(batch.column("fit").to_pylist(), batch.column("data")):
                if fit in betas:
                    table = pa.ipc.open_stream(data.as_buffer()).read_all()
                    stratum, time, event, weight = (table.column(c).to_numpy() for c in ("stratum", "time", "event", "weight"))
                    own = pack(*_ordered_totals(stratum, time, event.astype(float), weight, entries_of(table), betas[fit]))
                    sums[fit] = sums[fit] + own if fit in sums else own
        for fit, own in sums.items():
            yield _vector_batch(["fit"], [pa.array([fit])], [own])

    return run


def largest_predictors(betas: dict[str, np.ndarray]):
    """Largest linear predictor of each large stratum in a partition."""

    def run(batches):
        for fit, names, stratum, _, _, _, x in _by_fit(batches, betas, True):
            eta = (x[1] * betas[fit][x[0]]).sum(axis=1)
            for s in np.unique(stratum):
                columns = [pa.array([fit]), pa.array([names[s]], pa.int64()), pa.array([float(eta[stratum == s].max())])]
                yield pa.RecordBatch.from_arrays(columns, names=["fit", "stratum", "top"])

    return run


def cell_sums(betas: dict[str, np.ndarray], tops: dict[tuple[str, str], float]):
    """Own sums of the times of large strata, as far as they lie in a partition."""

    def run(batches):
        for fit, names, stratum, *rows in _by_fit(batches, betas, True):
            top = np.array([tops.get((fit, n), 0.0) for n in names])[stratum]
            cells = own_cells(stratum, *rows, betas[fit], top)
            for i in range(0, len(cells), 500):
                s, t, v = zip(*cells[i : i + 500])
                columns = [pa.array([fit] * len(s)), pa.array([names[k] for k in s], pa.int64()), pa.array(t, pa.float64())]
                yield _vector_batch(["fit", "stratum", "time"], columns, list(v))

    return run


def sums_before(p: int):
    """For each block of a stratum's times, what is at risk after it."""

    def run(pdf):
        pdf = pdf.sort_values("block")
        own = _at_risk(np.vstack(pdf["v"].to_numpy()), p)
        later = np.cumsum(own, axis=0) - own
        return pd.DataFrame({"fit": pdf["fit"], "stratum": pdf["stratum"], "block": pdf["block"], "later": list(later)})

    return run


def finish_block(p: int):
    """Packed sums of one block of times."""

    def run(pdf):
        pdf = pdf.sort_values("time", ascending=False)
        total = pack(*combine_cells(np.vstack(pdf["v"].to_numpy()), np.asarray(pdf["later"].iloc[0]), p))
        return pd.DataFrame([(pdf["fit"].iloc[0], total.tolist())], columns=["fit", "v"])

    return run
