"""Embedding near-deduplication: an exact metric range join.

Vectors are scaled to length one, where cosine ``c`` is Euclidean distance
``sqrt(2 - 2c)``: the threshold is a radius ``r``.  Within a label, pivots
(vectors of the label drawn by hash) partition the vectors: each one's home is the
cell of its nearest pivot.  A vector is also a guest of every cell whose
pivot is at most ``2r`` farther than its own; by the triangle inequality every
vector within ``r`` of a cell's home vector is a member of that cell.  So the
cells join independently: each counts the links of its home vectors, and no
pair leaves a cell.  Distances are then verified by the cosine itself, in
double precision.

Equal vectors of a label are one row with a multiplicity, so a group of copies
costs nothing.  A large cell is cut: its home vectors and its members go to
blocks of at most about ``BLOCK`` rows, every (home block, member block) pair
is a task's work of its own, and the counts add up.  Links leave as a spanning forest.
In high dimension without clusters the triangle inequality excludes little;
the join then degrades to comparing the blocks of a label, still exact.

``MAX_PIVOTS`` bounds all pivots together (the broadcast data); labels get
them in proportion to their size, and labels too small for a second one are a
single cell.

Vectors that are null, zero, of another length than their label's others, or
hold null or non-finite components, and vectors without a label, link with
nothing.  A null id takes part; repeated ids are separate vectors.  An empty
table gives an empty result; only the named columns are used.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import connected_components, materialize, ship
from pagewright.llm.simhash import spanning_forest
from pagewright.operators.ranking import join_per_group

COSINE = 0.93
CELL = 2048  # vectors of a label per pivot
BLOCK = 2048  # rows of a block of a large cell
MAX_PIVOTS = 4096
SLACK = 1e-6  # widens the candidate radius against rounding; links are verified exactly


def _usable(vec):
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    nonzero = F.exists(vec, lambda x: x != 0)
    return F.coalesce(vec.isNotNull() & (F.size(vec) > 0) & finite & nonzero, F.lit(False))


def _distinct_vectors(vectors: DataFrame) -> DataFrame:
    """One row per label and vector: ``_label, _vec, _node, _n``."""
    one = vectors.filter(F.col("_ok")).groupBy("_label", "_vec").agg(F.count(F.lit(1)).alias("_n"))
    return materialize(one.withColumn("_node", F.monotonically_increasing_id()), "metric-vectors")


def _pivots(vectors: DataFrame) -> dict:
    """``{(label, length): pivots}`` for labels large enough for two cells, ``MAX_PIVOTS`` in all at most."""
    sizes = vectors.groupBy("_label", F.size("_vec").alias("_dim")).agg(F.count(F.lit(1)).alias("_size"))
    total = sizes.agg(F.sum("_size")).first()[0] or 0
    per_pivot = max(CELL, -(-total // MAX_PIVOTS))
    large = sizes.withColumn("_k", F.floor(F.col("_size") / per_pivot)).filter("_k >= 2")
    # Draw by hash: a superset of about four times the number, then the smallest hashes.
    draw = vectors.withColumn("_dim", F.size("_vec")).join(F.broadcast(large), ["_label", "_dim"])
    draw = draw.withColumn("_h", F.xxhash64("_vec"))
    share = F.lit(4.0) * F.col("_k") / F.col("_size")
    drawn = draw.filter(F.pmod("_h", F.lit(1 << 30)) / F.lit(float(1 << 30)) < share)
    out: dict = {}
    for r in drawn.orderBy("_h").select("_label", "_dim", "_vec", "_k").collect():
        cell = out.setdefault((r["_label"], r["_dim"]), [])
        if len(cell) < r["_k"]:
            cell.append(list(r["_vec"]))
    return {k: v for k, v in out.items() if len(v) > 1}


def _cells(vectors: DataFrame, pivots: dict, radius: float) -> DataFrame:
    """Membership rows ``_label, _dim, _cell, _home, _node, _n, _vec``."""
    ship()

    def assign(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        units = {}
        for k, v in pivots.items():
            p = np.array(v, np.float64)
            units[k] = p / np.linalg.norm(p, axis=1, keepdims=True)
        names = ["_label", "_dim", "_cell", "_home", "_node", "_n", "_vec"]
        for batch in batches:
            labels = batch.column(0).to_pylist()
            vecs = batch.column(1)
            dims = np.diff(vecs.offsets.to_numpy())
            flat = vecs.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            starts = np.concatenate([[0], np.cumsum(dims)])
            where: dict = {}
            for i, key in enumerate(zip(labels, dims.tolist())):
                where.setdefault(key, []).append(i)
            rows, cells, homes = [], [], []
            for key, at in where.items():
                at = np.array(at)
                if key not in units:
                    rows.append(at)
                    cells.append(np.zeros(len(at), np.int64))
                    homes.append(np.ones(len(at), bool))
                    continue
                x = np.stack([flat[starts[i]:starts[i + 1]] for i in at])
                x /= np.abs(x).max(axis=1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                d = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ units[key].T)))
                home = d.argmin(axis=1)
                inside = d <= d.min(axis=1, keepdims=True) + 2 * radius + SLACK
                r, c = np.nonzero(inside)
                rows.append(at[r])
                cells.append(c)
                homes.append(home[r] == c)
            if not rows:
                continue
            r = np.concatenate(rows)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(r)), pa.array(dims[r].astype(np.int32)), pa.array(np.concatenate(cells).astype(np.int32)),
                pa.array(np.concatenate(homes)), batch.column(2).take(pa.array(r)), batch.column(3).take(pa.array(r)),
                vecs.take(pa.array(r)),
            ], names=names)

    label = vectors.schema["_label"].dataType.simpleString()
    vec = vectors.schema["_vec"].dataType.simpleString()
    schema = f"_label {label}, _dim int, _cell int, _home boolean, _node long, _n long, _vec {vec}"
    return vectors.select("_label", "_vec", "_node", "_n").mapInArrow(assign, schema)


def _blocks(members: DataFrame) -> DataFrame:
    """Each home row to every member block of its cell, and each member row to every home block."""
    cell = ["_label", "_dim", "_cell"]
    sizes = members.groupBy(*cell).agg(F.count(F.lit(1)).alias("_all"), F.count(F.when(F.col("_home"), 1)).alias("_homes"))
    blocks = sizes.select(*cell, F.ceil(F.col("_homes") / BLOCK).alias("_hb"), F.ceil(F.col("_all") / BLOCK).alias("_mb"))
    m = join_per_group(members, blocks, cell).filter("_hb > 0")
    part = F.pmod(F.xxhash64("_node"), F.lit(1 << 40))
    homes = m.filter("_home").select(
        "*", F.lit(True).alias("_asks"), (part % F.col("_hb")).alias("_h"), F.explode(F.sequence(F.lit(0), F.col("_mb") - 1)).alias("_m")
    )
    others = m.select(
        "*", F.lit(False).alias("_asks"), F.explode(F.sequence(F.lit(0), F.col("_hb") - 1)).alias("_h"), (part % F.col("_mb")).alias("_m")
    )
    return homes.unionByName(others).select(*cell, "_h", "_m", "_asks", "_node", "_n", "_vec")


def _link(threshold: float, radius: float):
    """Counts and spanning links of one (home block, member block) pair."""

    def run(table):
        import numpy as np
        import pyarrow as pa

        asks = table.column("_asks").to_numpy()
        node = table.column("_node").to_numpy()
        n = table.column("_n").to_numpy()
        vec = table.column("_vec").combine_chunks()
        dim = int(table.column("_dim")[0].as_py())
        x = vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
        unit = x / np.abs(x).max(axis=1, keepdims=True)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        q, m = np.nonzero(asks)[0], np.nonzero(~asks)[0]
        links = np.zeros(len(q), np.int64)
        a, b = [], []
        for start in range(0, len(q), 512):
            some = q[start:start + 512]
            i, j = np.nonzero(unit[some] @ unit[m].T >= threshold - SLACK)
            left, right = some[i], m[j]
            other = node[left] != node[right]
            i, left, right = i[other], left[other], right[other]
            cosine = np.einsum("ij,ij->i", x[left], x[right]) / (
                np.sqrt(np.einsum("ij,ij->i", x[left], x[left])) * np.sqrt(np.einsum("ij,ij->i", x[right], x[right]))
            )
            # Squares of very large or small components leave the double range; the scaled vectors don't.
            odd = ~np.isfinite(cosine)
            cosine[odd] = np.einsum("ij,ij->i", unit[left[odd]], unit[right[odd]])
            good = cosine >= threshold
            links[start:start + len(some)] += np.bincount(i[good], weights=n[right[good]], minlength=len(some)).astype(np.int64)
            a.append(node[left[good]])
            b.append(node[right[good]])
        fa, fb = spanning_forest(np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64),) * 2
        found = links > 0
        return pa.table({
            "a": np.concatenate([node[q[found]], fa]), "b": pa.array(np.concatenate([np.full(found.sum(), -1), fb])),
            "links": np.concatenate([links[found], np.zeros(len(fa), np.int64)]),
        })

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                 threshold: float = COSINE) -> DataFrame:
    """Per row: ``id_col, n_links, component_id, kept``."""
    ship()
    radius = (2.0 - 2.0 * threshold) ** 0.5
    vec = F.col(f"`{vec_col}`")
    rows = vectors.select(F.col(f"`{id_col}`").alias("_id"), vec.alias("_vec"), F.col(f"`{label_col}`").alias("_label"))
    # -0.0 and 0.0 are one value to a group key, so equal vectors are equal here.
    rows = rows.withColumn("_ok", _usable(F.col("_vec")) & F.col("_label").isNotNull())
    rows = materialize(rows.withColumn("_row", F.monotonically_increasing_id()), "metric-rows")
    one = _distinct_vectors(rows)
    members = materialize(_cells(one, _pivots(one), radius), "metric-cells")
    out = _blocks(members).groupBy("_label", "_dim", "_cell", "_h", "_m").applyInArrow(
        _link(threshold, radius), "a long, b long, links long"
    )
    out = materialize(out, "metric-links")
    links = out.filter("b = -1").groupBy(F.col("a").alias("_node")).agg(F.sum("links").alias("_links"))
    found = connected_components(out.filter("b <> -1").select("a", "b"))
    nodes = one.select("_label", "_vec", "_node", "_n").join(links, "_node", "left").join(
        found.withColumnRenamed("node", "_node"), "_node", "left"
    )
    nodes = nodes.select("_label", "_vec", F.coalesce("root", "_node").alias("_root"),
                         (F.coalesce("_links", F.lit(0)) + F.col("_n") - 1).alias("_links"))
    good = join_per_group(rows.filter("_ok"), nodes, ["_label", "_vec"])
    good = materialize(good.select("_id", "_row", "_root", "_links"), "metric-good")
    best = F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_row").alias("row")))
    roots = good.groupBy("_root").agg(best.alias("_best"))
    linked = join_per_group(good, roots, ["_root"]).select(
        F.col("_id").alias(id_col), F.col("_links").cast("long").alias("n_links"), F.col("_best.id").cast("long").alias("component_id"),
        F.col("_id").eqNullSafe(F.col("_best.id")).alias("kept"),
    )
    alone = rows.filter("not _ok").select(
        F.col("_id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("_id").cast("long").alias("component_id"),
        F.lit(True).alias("kept"),
    )
    return linked.unionByName(alone)

