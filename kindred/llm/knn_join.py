"""Exact top-k by inner product as a Voronoi kNN join.

Pivots (a bounded sample of the vectors; any choice gives the same result) cut queries and data into cells.  A
cell's summary holds its size, its radius and the distances of the k + 1 vectors nearest to the pivot.  With
q.x = q.p + q.(x - p), a summary bounds every score in the cell: at most q.p + |q| radius, and one of at least
q.p - |q| d for each listed distance d.  The (k + 1)-th best of those is a floor under each query's k-th score
(one of the vectors may be the query itself; with c rows of its id it is the (k + c)-th best); a cell goes only to query groups for which its upper bound reaches
a floor.  Each pair of a query group and a block of a cell is solved locally; the few best per query are merged.
Blocks and groups have at most BLOCK_ROWS and GROUP_ROWS rows, however many vectors share a cell.

Defined cases: vectors that are null or hold a null or non-finite component, and rows with a null id, take no part;
scaled components beyond the range of long and scores beyond TOP become the last value of it; vectors of different
lengths are compared over their common prefix (the rest counts as zero); ties go to the smaller vec_id; repeated
ids are candidates each, except the query's own id; of query rows that share an id only the one with the smallest
vector asks; fewer than k candidates give fewer rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

BLOCK_ROWS, GROUP_ROWS = 8192, 4096
MAX_PIVOTS = 1024
ROWS_PER_PIVOT = 2048
LOW_VALUES = 1 << 21
TOP = (1 << 62) - 1  # the highest score; smaller than what marks a query's own rows


def integer_vectors(df: DataFrame, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id and v, the floor of scale times each component, without unusable vectors."""
    v = F.col(vec_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where(F.col(id_col).cast("long").isNotNull() & v.isNotNull() & ~F.coalesce(bad, F.lit(True))).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def _matrix(col, dim: int) -> np.ndarray:
    """Rows of a list column, padded or cut to dim components."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    flat = col.flatten().to_numpy(zero_copy_only=False)
    sizes = col.value_lengths().to_numpy(zero_copy_only=False)
    if (sizes == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(sizes), dim), np.int64)
    ends = np.cumsum(sizes)
    for i, (n, e) in enumerate(zip(sizes, ends, strict=True)):
        out[i, : min(n, dim)] = flat[e - n : e - n + min(n, dim)]
    return out


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles while every sum fits 53 bits, else in whole numbers of any size, of
    which those beyond TOP become TOP."""
    top = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * max(1, a.shape[1])
    if top < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T if top < TOP else np.clip(a.astype(object) @ b.astype(object).T, -TOP, TOP).astype(np.int64)


def top_k(df: DataFrame, k: int = 20, query_mod: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score; df: vec_id, v (array<long>); queries: ids divisible by query_mod."""
    count, dim = df.agg(F.count("*"), F.max(F.size("v"))).first()
    n_pivots = int(min(MAX_PIVOTS, max(1, count // ROWS_PER_PIVOT)))
    dim = max(1, dim or 1)
    pivots = np.array([(list(r["v"]) + [0] * dim)[:dim] for r in df.orderBy(F.xxhash64("vec_id"), "vec_id").limit(n_pivots).collect()], np.float64).reshape(-1, dim)

    def assign(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(1), dim).astype(np.float64)
            d2 = (x * x).sum(1)[:, None] - 2 * (x @ pivots.T) + (pivots * pivots).sum(1)[None, :]
            cell = d2.argmin(1)
            far = np.sqrt(((x - pivots[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell.astype(np.int32)), pa.array(far)], ["vec_id", "v", "cell", "far"])

    placed = materialize(df.select("vec_id", "v").mapInArrow(assign, "vec_id long, v array<long>, cell int, far double"), "placed")

    def nearest(batches):
        held: dict[int, np.ndarray] = {}
        info: dict[int, list] = {}
        for b in batches:
            cell, far, is_query = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for c in np.unique(cell):
                f = far[cell == c]
                held[c] = np.sort(np.concatenate((held.get(c, f[:0]), f)))[: k + 1]
                t = info.setdefault(c, [0, 0, 0.0])
                t[0] += len(f)
                t[1] += int(is_query[cell == c].sum())
                t[2] = max(t[2], float(f.max()))
        if held:
            keys = sorted(held)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), *(pa.array([info[c][i] for c in keys], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))), pa.array([held[c].tolist() for c in keys], pa.list_(pa.float64()))], ["cell", "n", "q", "radius", "near"])

    part = placed.select("cell", "far", (F.pmod("vec_id", F.lit(query_mod)) == 0).cast("int").alias("is_query")).mapInArrow(nearest, "cell int, n long, q long, radius double, near array<double>")
    cells = part.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("q").alias("q"), F.max("radius").alias("radius"), F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k + 1).alias("near")).collect()
    size, queries, radius = np.zeros(len(pivots), np.int64), np.zeros(len(pivots), np.int64), np.full(len(pivots), -np.inf)
    near = np.full((len(pivots), k + 1), np.inf)
    for r in cells:
        size[r["cell"]], queries[r["cell"]], radius[r["cell"]] = r["n"], r["q"], r["radius"]
        near[r["cell"], : len(r["near"])] = r["near"]
    subs = np.maximum(1, -(-size // BLOCK_ROWS))

    # Query groups: neighbouring cells together up to GROUP_ROWS queries; a cell with more is split by a hash.
    group, split, n_groups, room, left, at = {}, {}, 0, 0, {c for c in range(len(pivots)) if queries[c]}, 0
    while left:
        at = min(left, key=lambda c, at=at: (float(((pivots[c] - pivots[at]) ** 2).sum()), c))
        left.remove(at)
        split[at] = int(-(-queries[at] // GROUP_ROWS))
        if split[at] > 1 or queries[at] > room:
            group[at], n_groups = n_groups, n_groups + split[at]
            room = 0 if split[at] > 1 else GROUP_ROWS - int(queries[at])
        else:
            group[at], room = n_groups - 1, room - int(queries[at])
    slack = 1e-6

    def reach(batches):
        """Queries with their group, floor, and the cells that may hold one of their best."""
        for b in batches:
            if not b.num_rows:
                continue
            q = _matrix(b.column(1), dim).astype(np.float64)
            cell, ids, copies = b.column(2).to_numpy(), b.column(0).to_numpy(), b.column(3).to_numpy()
            dot, norm = q @ pivots.T, np.sqrt((q * q).sum(1))
            floor = np.full(len(q), -np.inf)
            step = max(1, LOW_VALUES // near.size)
            for x in range(0, len(q), step):
                low = (dot[x : x + step, :, None] - norm[x : x + step, None, None] * near[None]).reshape(-1, near.size)
                mine = copies[x : x + step]
                for c in np.unique(mine):
                    at = near.size - k - int(c)
                    if at >= 0:
                        floor[x : x + step][mine == c] = np.partition(low[mine == c], at, axis=1)[:, at]
            floor = np.floor(floor - slack * (1 + np.abs(floor)))
            high = np.where(size > 0, dot + norm[:, None] * np.maximum(radius, 0), -np.inf)
            need = high + slack * (1 + np.abs(high)) >= floor[:, None]
            g = [group[c] + (int(i) // query_mod) % split[c] for c, i in zip(cell.tolist(), ids.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(g, pa.int32()), pa.array(floor), pa.array([np.flatnonzero(x).tolist() for x in need], pa.list_(pa.int32()))], ["vec_id", "v", "grp", "floor", "need"])

    once = placed.where(F.pmod("vec_id", F.lit(query_mod)) == 0).groupBy("vec_id").agg(F.min(F.struct("v", "cell")).alias("q"), F.count("*").alias("copies"))
    asked = once.select("vec_id", "q.v", "q.cell", "copies").mapInArrow(reach, "vec_id long, v array<long>, grp int, floor double, need array<int>")
    n_subs = F.element_at(F.array(*[F.lit(int(s)) for s in subs]) if len(subs) else F.array(F.lit(1)), F.col("cell") + 1)
    wanted = asked.select(F.explode("need").alias("cell"), "grp").distinct()
    data = placed.join(wanted, "cell").select("grp", "cell", F.pmod(F.xxhash64("vec_id"), n_subs).cast("int").alias("sub"), "vec_id", "v")
    sent = asked.select("grp", F.explode("need").alias("cell"), "vec_id", "v", "floor").select("grp", "cell", F.explode(F.sequence(F.lit(0), n_subs - 1)).alias("sub"), "vec_id", "v", "floor")

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        q, x = _matrix(left.column("v"), dim), _matrix(right.column("v"), dim)
        q_ids, x_ids, floor = left.column("vec_id").to_numpy(), right.column("vec_id").to_numpy(), left.column("floor").to_numpy()
        by = np.argsort(x_ids, kind="stable")
        x, x_ids = x[by], x_ids[by]
        out = [[], [], []]
        for i in range(0, len(q) if len(x) else 0, 256):
            s = _dots(q[i : i + 256], x)
            own = q_ids[i : i + 256, None] == x_ids[None, :]
            s = np.where(own, -TOP - 1, s)
            best = _best(s, k)
            rows = np.repeat(np.arange(len(s)), best.shape[1])
            cols = best.ravel()
            good = (s[rows, cols] >= floor[i : i + 256][rows]) & ~own[rows, cols]
            for o, v in zip(out, (q_ids[i : i + 256][rows[good]], x_ids[cols[good]], s[rows[good], cols[good]]), strict=True):
                o.append(v)
        return pa.table([pa.array(np.concatenate(o) if o else np.zeros(0, np.int64), pa.int64()) for o in out], names=["query_id", "vec_id", "score"])

    from pyspark.sql import Window

    keys = ["grp", "cell", "sub"]
    sent, data = sent.toDF(*sent.columns), data.toDF(*data.columns)
    found = sent.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInArrow(solve, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _best(s: np.ndarray, k: int) -> np.ndarray:
    """Columns of each row's k largest values, ties to the smaller column."""
    cut = -np.partition(-s, min(k, s.shape[1]) - 1, axis=1)[:, min(k, s.shape[1]) - 1]
    out = np.empty((len(s), min(k, s.shape[1])), np.int64)
    for i, c in enumerate(cut):
        at = np.flatnonzero(s[i] >= c)
        out[i] = at[np.argsort(-s[i, at], kind="stable")][:k]
    return out
