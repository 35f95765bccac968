"""Cross-validation of spatial models: k-means blocks from many starts, neighbours rebuilt in every training set, trend predictions.

Nothing of a held-out row enters a fit: links of a fold join training rows only, and a prediction is the trend of the
held-out row's own regressors. All folds are fitted in one go, as jobs of ``spreg``.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import spreg
from .lineage import settled
from .near import nearest

#: Each row is a training row of all folds but its own, so their number is bounded.
MOST_FOLDS = 100


#: Cells along a side of the points' box, at most, points of a cell, about, points of a row, at most, and of a task, about.
ALONG, FILL, PACK, DEAL = 256, 64, 4096, 100_000
_CELL = "n long, x0 double, x1 double, y0 double, y1 double, sx double, sy double, sq double, x binary, y binary"


def _cells(points: DataFrame) -> DataFrame:
    """The points by square cells: a row for some of a cell's points, with their box, sums and coordinates; kept, as every pass reads it.

    A cell of many points makes several rows, so none grows with the table.
    """
    low_x, high_x, low_y, high_y, n = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count("*")).first()
    side = max(float(high_x - low_x), float(high_y - low_y), 1e-9) / min(max(int((n / FILL) ** 0.5), 1), ALONG)
    tasks = n // DEAL + 1  # many short passes: tasks without much to do would only cost their start
    bins = {f"b{c}": F.floor((F.col(c) - F.lit(float(low))) / side) for c, low in (("x", low_x), ("y", low_y))}
    dealt = points.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).withColumns(bins).repartition(tasks, "bx", "by").sortWithinPartitions("bx", "by")

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for _, own in f.groupby(["bx", "by"], sort=False):
                for at in range(0, len(own), PACK):
                    x, y = own["x"].to_numpy()[at : at + PACK], own["y"].to_numpy()[at : at + PACK]
                    rows.append((len(x), x.min(), x.max(), y.min(), y.max(), x.sum(), y.sum(), float((x * x + y * y).sum()), x.tobytes(), y.tobytes()))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _CELL.split(", ")])

    return dealt.mapInPandas(pack, _CELL).persist()


def _sums(cells: DataFrame, centres: np.ndarray) -> np.ndarray:
    """n, sum of x, sum of y and sum of squared distances for each start and centre of ``centres`` (starts, k, 2).

    Where one centre is the nearest to all of a cell's box, the cell's sums go to it as they are; the points of the other
    cells, those on the border of two centres, are looked at one by one. A task gives one row a start and centre.
    """
    starts, k, _ = centres.shape

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros((starts, k, 4))
        for f in frames:
            if not len(f):
                continue
            box = [f[c].to_numpy(float) for c in ("x0", "x1", "y0", "y1")]
            mid, half = np.stack([(box[0] + box[1]) / 2, (box[2] + box[3]) / 2], 1), np.stack([(box[1] - box[0]) / 2, (box[3] - box[2]) / 2], 1)
            n, sx, sy, sq = (f[c].to_numpy(float) for c in ("n", "sx", "sy", "sq"))
            for s in range(starts):
                c = centres[s]
                away = ((mid[:, None] - c[None]) ** 2).sum(-1)
                best = away.argmin(1)
                # how much nearer the best is, at the corner of the box where that is least
                gain = away - away[np.arange(len(f)), best][:, None] - 2 * (np.abs(c[None] - c[best][:, None]) * half[:, None]).sum(-1)
                gain[np.arange(len(f)), best] = np.inf
                whole = (gain > 1e-9 * (1 + away)).all(1)
                b = best[whole]
                add = lambda w: np.bincount(b, w, k)  # noqa: E731, B023
                cx, cy = c[b].T
                off = sq[whole] - 2 * (cx * sx[whole] + cy * sy[whole]) + n[whole] * (cx * cx + cy * cy)
                out[s] += np.stack([add(n[whole]), add(sx[whole]), add(sy[whole]), add(off)], 1)
                rest = np.flatnonzero(~whole)
                if len(rest):
                    xy = np.stack([np.frombuffer(b"".join(f[v].iloc[i] for i in rest)) for v in ("x", "y")], 1)
                    d = ((xy[:, None] - c[None]) ** 2).sum(-1)
                    own = d.argmin(1)
                    out[s] += np.stack([np.bincount(own, w, k) for w in (None, xy[:, 0], xy[:, 1], d.min(1))], 1)
        yield pd.DataFrame({"s": np.repeat(np.arange(starts), k), "c": np.tile(np.arange(k), starts), **{v: out[..., i].ravel() for i, v in enumerate(("n", "sx", "sy", "sd"))}})

    out = np.zeros((starts, k, 4))
    parts = cells.mapInPandas(run, "s int, c int, n double, sx double, sy double, sd double")
    for r in parts.groupBy("s", "c").agg(*(F.sum(v).alias(v) for v in ("n", "sx", "sy", "sd"))).collect():
        out[r["s"], r["c"]] = r["n"], r["sx"], r["sy"], r["sd"]
    return out


def kmeans_centres(points: DataFrame, k: int, starts: int = 25, most: int = 100, seed: int = 42) -> np.ndarray:
    """k centres, in order of x and then y, of the best of ``starts`` runs of Lloyd's rounds.

    The starts take their centres from one draw of points by hash. All runs advance in the same pass, which brings back
    four sums for each start and centre; a run leaves when its centres stand still. A centre without points stays.
    """
    p = points.where("x IS NOT NULL AND y IS NOT NULL")
    drawn = p.orderBy(F.xxhash64(F.col("id"), F.lit(seed)), "id").limit(k * starts).select("x", "y").collect()
    if len(drawn) < k:
        raise ValueError(f"{k} blocks need as many points")
    drawn = np.array(drawn, float)
    now = np.stack([drawn[np.arange(s * k, s * k + k) % len(drawn)] for s in range(starts)])
    cells = _cells(p)
    cost, live = np.full(starts, np.inf), np.arange(starts)
    for _ in range(most):
        sums = _sums(cells, now[live])
        cost[live] = sums[..., 3].sum(1)
        filled = sums[..., :1] > 0
        new = np.where(filled, sums[..., 1:3] / np.maximum(sums[..., :1], 1.0), now[live])
        moved = (np.abs(new - now[live]) > 1e-9 * (1 + np.abs(now[live]))).any((1, 2))
        now[live] = new
        live = live[moved]
        if not len(live):
            break
    if len(live):
        cost[live] = _sums(cells, now[live])[..., 3].sum(1)
    cells.unpersist()
    best = now[int(np.argmin(cost))]
    return best[np.lexsort((best[:, 1], best[:, 0]))]


def block_of(centres: np.ndarray) -> Column:
    """The index of the nearest centre to (x, y), of equally near ones the least; null without coordinates."""
    away = [F.pow(F.col("x") - F.lit(float(cx)), 2) + F.pow(F.col("y") - F.lit(float(cy)), 2) for cx, cy in centres]
    return F.least(*(F.struct(d.alias("d"), F.lit(c).alias("c")) for c, d in enumerate(away)))["c"] if len(away) > 1 else F.lit(0)


def spatial_blocks(points: DataFrame, k: int = 10, starts: int = 25, seed: int = 42) -> DataFrame:
    """The rows with ``fold``, the block of each as a string."""
    centres = kmeans_centres(points, k, starts, seed=seed)
    return points.withColumn("fold", F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), block_of(centres)).cast("string"))


def fold_names(rows: DataFrame) -> list[str]:
    found = [r[0] for r in rows.where("fold IS NOT NULL").select(F.col("fold").cast("string")).distinct().limit(MOST_FOLDS + 1).collect()]
    if len(found) > MOST_FOLDS:
        raise ValueError(f"more than {MOST_FOLDS} folds")
    return sorted(found)


def _other_folds(names: Sequence[str], own: str = "fold") -> Column:
    return F.array_except(F.array(*map(F.lit, names)).cast("array<string>"), F.array(own))


def training_links(points: DataFrame, k: int) -> DataFrame:
    """fold, i, j, w: for each fold the k nearest neighbours (ties by id) of each training point among the training points.

    One list of the 2k nearest of each point serves all folds: what of it lies outside a fold, in order, are the nearest
    training points, and k of them prove the answer. As k + 1 of 2k have to lie in the fold for that to fail, it fails for
    one fold a point at most; these points ask the fold's training set itself. With k training points or fewer all are
    neighbours, and a lone one has none. Points without a fold or coordinates take no part.
    """
    p = settled(points.where("x IS NOT NULL AND y IS NOT NULL AND fold IS NOT NULL").select("id", "x", "y", F.col("fold").cast("string").alias("fold")))
    names = fold_names(p)
    of = p.select(F.col("id").alias("r_id"), F.col("fold").alias("rf"))
    lists = nearest(p, p, 2 * k, self_join=True).join(of, "r_id").groupBy("q_id").agg(F.sort_array(F.collect_list(F.struct("nth", "rf", "r_id"))).alias("c"))
    asked = p.select(F.col("id").alias("q_id"), F.explode(_other_folds(names)).alias("f")).join(lists, "q_id")
    kept = settled(asked.select("q_id", "f", F.slice(F.filter("c", lambda s: s["rf"] != F.col("f")), 1, k).alias("c")))
    out = kept.where(F.size("c") == k).select(F.col("f").alias("fold"), F.col("q_id").alias("i"), F.explode("c.r_id").alias("j"), F.lit(1.0 / k).alias("w"))
    unsure = kept.where(F.size("c") < k).select(F.col("q_id").alias("id"), "f")
    for name in sorted(r[0] for r in unsure.select("f").distinct().collect()):
        again = nearest(p.join(unsure.where(F.col("f") == name), "id", "left_semi"), p.where(F.col("fold") != name), k, self_join=True)
        n = F.count("*").over(Window.partitionBy("q_id"))
        out = out.unionByName(again.select(F.lit(name).alias("fold"), F.col("q_id").alias("i"), F.col("r_id").alias("j"), (F.lit(1.0) / n).alias("w")))
    return out


def _complete(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    ok = F.col("fold").isNotNull()
    for c in columns:
        v = F.col(c).cast("double")
        ok = ok & v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return rows.where(ok)


def _plain_moments(whole: DataFrame, target: str, xs: Sequence[str], folds: Sequence[str]) -> tuple[dict[str, spreg.Moments], dict[str, float]]:
    """The products of each training set without lags, which least squares has none of: each fold's rows are added up once, and a training set is the sum of the other folds."""
    k = len(xs) + 1
    rows = whole.select(F.col("fold").alias("job"), F.lit(1.0).alias("c0"), *(F.col(x).cast("double").alias(f"c{i + 1}") for i, x in enumerate(xs)), F.col(target).cast("double").alias(f"c{3 * k}"))
    own = {job: (n, m["gram"]) for job, (n, m) in spreg.products(rows, [*(f"c{i}" for i in range(k)), f"c{3 * k}"], {"gram": F.lit(1.0)}).items()}
    out, at = {}, np.array([*range(k), 3 * k])
    for name in folds:
        others = [own[f] for f in folds if f != name]
        if others:
            gram = np.zeros((3 * k + 4,) * 2)
            gram[np.ix_(at, at)] = sum(g for _, g in others)
            out[name] = spreg.Moments(k, sum(n for n, _ in others), gram, np.zeros_like(gram))
    return out, {}


def _lagged_moments(whole: DataFrame, target: str, xs: Sequence[str], folds: Sequence[str], k: int, traced: bool) -> tuple[dict[str, spreg.Moments], dict[str, float]]:
    """The products of each training set with its own links, for all regressors at once; with ``traced`` also the traces that LM tests need."""
    links = settled(training_links(whole, k).select(F.col("fold").alias("job"), "i", "j", "w"))
    train = whole.select("id", target, *xs, F.explode(_other_folds(folds)).alias("job"))
    known = spreg.moments(spreg.lagged(train, links, target, xs), len(xs) + 1)
    return known, spreg._trace_terms(links, list(known)) if traced else {}


def cross_validate(rows: DataFrame, target: str, specs: Mapping[str, Sequence[str]], k: int, model: str = "sarar") -> DataFrame:
    """spec, fold, id, target and predictions of the held-out rows from models fitted without their fold.

    ``rows`` has id, x, y, fold, the target and the regressors that ``specs`` names, as many in each. pred_trend is the
    trend of ``model`` (no lag of the target, which would need neighbours in training), pred_recal the same moved by the
    mean residual of the trend in training, pred_ols least squares, pred_mean the training mean; lambda_lag is the fit's
    (null without a lag). Coefficients need no covariances, so none are worked out, and least squares needs no links. Rows that lack any of these values, or hold one that isn't finite, take no part; a fold that
    leaves no training rows gives none.
    """
    widths = {len(xs) for xs in specs.values()}
    if len(widths) != 1:
        raise ValueError("specifications need equally many regressors")
    names = [f"r{i}" for i in range(widths.pop())]
    used = sorted({target, *(x for xs in specs.values() for x in xs)})
    whole = settled(_complete(rows, ["x", "y", *used]).withColumn("fold", F.col("fold").cast("string")))
    folds = fold_names(whole)
    xs_all = list(dict.fromkeys(x for xs in specs.values() for x in xs))
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("spec"), *(F.col(x).cast("double").alias(n) for n, x in zip(names, xs))) for s, xs in specs.items())))
    held = whole.select("id", "fold", F.col(target).cast("double").alias("target"), each.alias("s")).select("s.spec", "fold", "id", "target", *(f"s.{n}" for n in names))
    known, trace = _plain_moments(whole, target, xs_all, folds) if model == "ols" else _lagged_moments(whole, target, xs_all, folds, k, model == "selected")
    parts = {f"{s}|{name}": known[name].part([xs_all.index(x) for x in xs]) for s, xs in specs.items() for name in folds if name in known}
    models = dict.fromkeys(parts, model)
    if model == "selected" and parts:
        models = {r["job"]: r["model"] for r in spreg.select_models(rows.sparkSession, parts, {job: trace[job.split("|", 1)[1]] for job in parts}).collect()}
    table = []
    for s in specs:
        for name in folds:
            if (m := parts.get(f"{s}|{name}")) is None:
                continue
            f, y = spreg.start(m, models[f"{s}|{name}"]), m.y()[:, 0]
            trend, ols = f.coef[: m.k], spreg.two_stage(m, y, m.x(), m.x())
            mean = float(m.gram[0] @ y) / m.n
            shift = mean - float(m.gram[0, : m.k] @ trend) / m.n
            table.append((s, name, list(map(float, trend)), shift, list(map(float, ols)), mean, float(f.coef[m.k]) if f.is_lag else None))
    fitted = rows.sparkSession.createDataFrame(table, "spec string, fold string, trend array<double>, shift double, ols array<double>, pred_mean double, lambda_lag double")
    line = lambda c: sum((F.col(c)[i + 1] * F.col(n) for i, n in enumerate(names)), F.col(c)[0])
    met = held.join(F.broadcast(fitted), ["spec", "fold"])  # a row for each specification and fold
    return met.select("spec", "fold", "id", "target", line("trend").alias("pred_trend"), (line("trend") + F.col("shift")).alias("pred_recal"), line("ols").alias("pred_ols"), "pred_mean", "lambda_lag")


def scores(predictions: DataFrame) -> DataFrame:
    """spec, n_folds, n_pred, the root mean squared errors of the four predictions, and the mean of the folds' lambda."""
    off = lambda c: F.col("target") - F.col(c)
    per = predictions.groupBy("spec", "fold").agg(F.count("*").alias("n"), F.first("lambda_lag").alias("lam"), *(F.sum(off(f"pred_{c}") * off(f"pred_{c}")).alias(c) for c in ("trend", "recal", "ols", "mean")))
    errors = [F.sqrt(F.sum(c) / F.sum("n")).alias(f"rmse_{c}") for c in ("trend", "recal", "ols", "mean")]
    return per.groupBy("spec").agg(F.count("*").alias("n_folds"), F.sum("n").alias("n_pred"), *errors, F.avg("lam").alias("mean_lambda"))
