"""Point patterns: nearest neighbours, Clark-Evans, DBSCAN and cluster summaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from landloom.functions import geometry as g, helpers
from landloom.operators import spatial as sp, stats as st
from landloom.operators.components import connected_components
from landloom.session import cut, dealt

#: Points of a cell's part that a task compares at once, and parts of a cell along each side.
BLOCK, PARTS = 2048, 16


def to_metres(points: DataFrame, srid: int | None = None) -> tuple[DataFrame, int]:
    """Points (fid, x, y in degrees) in metres of one UTM zone, that of their mean unless given; and the zone."""
    if srid is None:
        mean = points.agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
        srid = mean.select(g.utm_epsg(F.col("x"), F.col("y"))).first()[0] or 32631
    u = g.to_utm(F.col("x"), F.col("y"), srid)
    return points.select("fid", u.alias("u")).select("fid", F.col("u.x").alias("x"), F.col("u.y").alias("y")), srid


def nn_summary(nearest: DataFrame) -> DataFrame:
    """One row: mean, median and population std of nearest distances. The median is found by ranks (``stats.values_at``), so that no task holds all distances; without distances all are null."""
    known = nearest.where("dist is not null")
    values = cut(known.groupBy(F.lit("dist").alias("column"), F.col("dist").alias("value")).agg(F.count("*").alias("c")))
    one = values.agg(F.sum("c").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")).first()
    middle = None
    if one.n:
        at = st.values_at(values, {"dist": (one.lo, one.hi, {"m1": (one.n - 1) // 2, "m2": one.n // 2})})
        middle = (at["dist", "m1"] + at["dist", "m2"]) / 2
    return known.agg(F.avg("dist").alias("mean"), F.lit(middle).cast("double").alias("median"), F.stddev_pop("dist").alias("std"))


def clark_evans(points: DataFrame, nearest: DataFrame) -> DataFrame:
    """One row (n, r, interpretation): mean nearest distance over that expected of as many random points in the bounding box; area 0 gives 0."""
    box = points.agg(F.count("*").alias("n"), ((F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))).alias("area"))
    both = box.join(nearest.agg(F.avg("dist").alias("mean")))  # one row each
    r = F.when((F.col("n") >= 2) & (F.col("area") > 0), F.col("mean") / (0.5 / F.sqrt(F.col("n") / F.col("area")))).otherwise(0.0)
    bands = F.when(r < 0.7, "strongly clustered").when(r < 0.95, "moderately clustered").when(r < 1.05, "random").when(r < 1.3, "moderately dispersed").otherwise("strongly dispersed")
    return both.select("n", r.alias("r"), bands.alias("interpretation"))


def dbscan(points: DataFrame, eps: float, min_samples: int) -> DataFrame:
    """(fid, cluster_id) of points (fid, x, y): cores have min_samples neighbours within eps, themselves among them; clusters are components of cores.

    A border point joins the lowest-numbered cluster it touches; clusters are numbered by their smallest core; noise is -1. Points are laid on
    cells of side eps / sqrt(2), whose points are all within eps of each other: a cell with min_samples points has cores only, needs no counting, and counts as one
    node of the graph. So crowded cells give no pairs: between cells of cores one link is looked for, by the boxes of their parts first.
    """
    side = eps / np.sqrt(2)
    row = ["fid", "gx", "gy"]  # names a row, also where a fid repeats
    laid = cut(points.select("fid", "x", "y", sp.cell(F.col("x"), side).alias("gx"), sp.cell(F.col("y"), side).alias("gy")))
    cells = cut(laid.groupBy("gx", "gy").agg(F.count("*").alias("n")))
    reach = F.array(*[F.lit(k) for k in (-2, -1, 0, 1, 2)])
    # Points of sparse cells, fewer than min_samples in each, count their neighbours in the cells around.
    sparse = laid.join(dealt(cells.where(F.col("n") < min_samples).select("gx", "gy")), ["gx", "gy"])
    around = sparse.withColumn("dx", F.explode(reach)).withColumn("dy", F.explode(reach)).select(F.struct("fid", "gx", "gy").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), (F.col("gx") + F.col("dx")).alias("gx"), (F.col("gy") + F.col("dy")).alias("gy"))
    near = (F.col("ax") - F.col("x")) * (F.col("ax") - F.col("x")) + (F.col("ay") - F.col("y")) * (F.col("ay") - F.col("y")) <= eps * eps
    counted = around.join(dealt(laid), ["gx", "gy"]).where(near).groupBy("a").agg(F.count("*").alias("k"))
    dense = laid.join(dealt(cells.where(F.col("n") >= min_samples).select("gx", "gy")), ["gx", "gy"], "left_semi")
    cores = cut(dense.select("fid", "x", "y", "gx", "gy").unionByName(sparse.join(dealt(counted.where(F.col("k") >= min_samples).select("a.*")), ["fid", "gx", "gy"], "left_semi").select("fid", "x", "y", "gx", "gy")))
    # A node for each cell that has cores: its cores are within eps of each other.
    per_cell = cut(cores.groupBy("gx", "gy").agg(F.min("fid").alias("node"), F.count("*").alias("n")))
    other = per_cell.select(F.col("gx").alias("hx"), F.col("gy").alias("hy"), F.col("node").alias("to"))
    pairs = per_cell.withColumn("dx", F.explode(reach)).withColumn("dy", F.explode(reach)).select("gx", "gy", "node", (F.col("gx") + F.col("dx")).alias("hx"), (F.col("gy") + F.col("dy")).alias("hy")).join(dealt(other), ["hx", "hy"]).where("node < to")
    edges = _linked_cells(cores, pairs, side, eps)
    comp = connected_components(edges)
    rooted = per_cell.join(dealt(comp.select(F.col("node"), "component")), "node", "left").select("gx", "gy", F.coalesce("component", "node").alias("root"))
    roots = rooted.select("root").distinct()
    numbers = cut(_numbered(roots))
    core_labels = cut(cores.join(dealt(rooted.join(dealt(numbers), "root")), ["gx", "gy"]).select("fid", "gx", "gy", "x", "y", "cluster_id"))
    loose = sparse.join(dealt(core_labels.select(*row)), row, "left_anti")
    asked = loose.withColumn("dx", F.explode(reach)).withColumn("dy", F.explode(reach)).select(F.struct("fid", "gx", "gy").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), (F.col("gx") + F.col("dx")).alias("gx"), (F.col("gy") + F.col("dy")).alias("gy"))
    border = asked.join(dealt(core_labels.select("gx", "gy", "x", "y", "cluster_id")), ["gx", "gy"]).where(near).groupBy("a").agg(F.min("cluster_id").alias("cluster_id")).select("a.*", "cluster_id")
    known = core_labels.select(*row, "cluster_id").unionByName(border).groupBy(*row).agg(F.min("cluster_id").alias("cluster_id"))
    return laid.select(*row).join(dealt(known), row, "left").select("fid", "cluster_id").withColumn("cluster_id", F.coalesce("cluster_id", F.lit(-1)).cast("long"))


def _linked_cells(cores: DataFrame, pairs: DataFrame, side: float, eps: float) -> DataFrame:
    """Edges (a, b) of pairs of cells (gx, gy, node, hx, hy, to) of which two cores are within eps of each other.

    Cores of a cell are summed up by the boxes of its PARTS by PARTS parts, so a crowded cell moves as few rows. Where the far corners of two
    boxes are within eps the cells are linked, where no near corners are they aren't; only for pairs of parts in between, in cells that aren't linked by others, are cores compared.
    """
    part = lambda v, lo: F.least(F.lit(PARTS - 1), F.greatest(F.lit(0), F.floor((F.col(v) / side - F.col(lo)) * PARTS))).cast("int")
    parted = cores.withColumns({"sx": part("x", "gx"), "sy": part("y", "gy")})
    boxes = parted.groupBy("gx", "gy", "sx", "sy").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.count("*").alias("n"))
    lists = cut(boxes.groupBy("gx", "gy").agg(F.collect_list(F.struct("sx", "sy", "x0", "x1", "y0", "y1")).alias("l")))
    lined = pairs.join(dealt(lists.select("gx", "gy", F.col("l").alias("p"))), ["gx", "gy"]).join(dealt(lists.select(F.col("gx").alias("hx"), F.col("gy").alias("hy"), F.col("l").alias("q"))), ["hx", "hy"])
    far = "power(greatest(s.x1 - t.x0, t.x1 - s.x0), 2) + power(greatest(s.y1 - t.y0, t.y1 - s.y0), 2)"
    near = "power(greatest(0D, s.x0 - t.x1, t.x0 - s.x1), 2) + power(greatest(0D, s.y0 - t.y1, t.y0 - s.y1), 2)"
    within = f"{eps * eps!r}D"
    told = lined.select(F.col("node").alias("a"), F.col("to").alias("b"), "gx", "gy", "hx", "hy", "p", "q", F.expr(f"exists(p, s -> exists(q, t -> {far} <= {within}))").alias("sure"))
    open_ = f"flatten(transform(p, s -> transform(filter(q, t -> {near} <= {within}), t -> named_struct('sx', s.sx, 'sy', s.sy, 'tx', t.sx, 'ty', t.sy))))"
    found = cut(told.select("a", "b", "sure", "gx", "gy", "hx", "hy", F.expr(f"if(sure, null, {open_})").alias("m")))
    at, other = ["gx", "gy", "sx", "sy"], ["hx", "hy", "tx", "ty"]
    sized = parted.join(dealt(boxes.select(*at, "n")), at)
    blocks = sized.withColumn("block", F.pmod(F.xxhash64("fid"), F.ceil(F.col("n") / BLOCK)).cast("int")).groupBy(*at, "block").agg(F.collect_list(F.struct("x", "y")).alias("p"))
    doubtful = found.where("not sure").select("a", "b", "gx", "gy", "hx", "hy", F.inline("m"))
    met = doubtful.join(dealt(blocks.drop("block")), at).join(dealt(blocks.select(*[F.col(c).alias(d) for c, d in zip(at, other)], F.col("p").alias("q"))), other)

    def linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            seen: set[tuple[int, int]] = set()
            for node, to, p, q in zip(rows["a"], rows["b"], rows["p"], rows["q"]):
                if (node, to) in seen:
                    continue
                p, q = (np.array([tuple(v.values()) if isinstance(v, dict) else tuple(v) for v in s]) for s in (p, q))
                if (((p[:, None, :] - q[None, :, :]) ** 2).sum(axis=2) <= eps * eps).any():
                    seen.add((node, to))
            yield pd.DataFrame(list(seen), columns=["a", "b"], dtype="int64")

    compared = met.select("a", "b", "p", "q").mapInPandas(linked, "a long, b long")
    return found.where("sure").select("a", "b").union(compared).distinct()


def _numbered(roots: DataFrame) -> DataFrame:
    """Roots numbered from 0 in order: ranges of roots are numbered by themselves, then moved by the counts of the ranges before."""
    parts = int(roots.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(roots.repartitionByRange(parts, "root").withColumn("p", F.spark_partition_id()))
    sizes = ranged.groupBy("p").agg(F.count("*").alias("n"), F.min("root").alias("low"))
    before = sizes.select("p", F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("low").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row for each partition
    own = F.row_number().over(Window.partitionBy("p").orderBy("root"))
    return ranged.withColumn("own", own).join(F.broadcast(before), "p").select("root", (F.col("before") + F.col("own") - 1).alias("cluster_id"))


#: Points of a cluster that a task holds before it draws their hull, and hulls that are merged at once.
HELD, FAN = 8192, 64


def hulls(points: DataFrame) -> DataFrame:
    """(cluster_id, x, y): the corners of each cluster's convex hull.

    Each task draws hulls of what it reads before anything moves, so a cluster moves as a few corners a task; these are merged in groups of FAN tasks, then the groups'. So no task holds a cluster.
    """

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        size: dict[int, int] = {}
        for b in batches:
            ids, xy = b.column(0).to_numpy(), np.stack([b.column(1).to_numpy(), b.column(2).to_numpy()], axis=1)
            order = np.argsort(ids, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(ids[order])) + 1) if len(ids) else []:
                k = int(ids[part[0]])
                held.setdefault(k, []).append(xy[part])
                size[k] = size.get(k, 0) + len(part)
                if size[k] > HELD:
                    held[k] = [np.array(helpers.hull(list(map(tuple, np.concatenate(held[k])))))]
                    size[k] = len(held[k][0])
        node = TaskContext.get().partitionId()
        for k, parts in held.items():
            h = np.array(helpers.hull(list(map(tuple, np.concatenate(parts)))))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), k)), pa.array(np.full(len(h), node)), pa.array(h[:, 0]), pa.array(h[:, 1])], ["cluster_id", "node", "x", "y"])

    def merged(t: pa.Table) -> pa.Table:
        h = helpers.hull(list(zip(t.column("x").to_pylist(), t.column("y").to_pylist())))
        return pa.table({"cluster_id": [t.column("cluster_id")[0].as_py()] * len(h), "node": [t.column("node")[0].as_py()] * len(h), "x": [p[0] for p in h], "y": [p[1] for p in h]})

    schema = "cluster_id long, node long, x double, y double"
    level = points.select("cluster_id", "x", "y").mapInArrow(drawn, schema)
    level = level.withColumn("node", F.expr(f"node div {FAN}")).groupBy("cluster_id", "node").applyInArrow(merged, schema)
    return level.withColumn("node", F.lit(0).cast("long")).groupBy("cluster_id", "node").applyInArrow(merged, schema).drop("node")


def cluster_summary(points: DataFrame, labels: DataFrame, srid: int) -> DataFrame:
    """(cluster_id, n, lng, lat, hull_sqkm) of points in metres; noise is left out; hulls of fewer than three points have area 0."""
    joined = points.join(labels.where("cluster_id >= 0"), "fid")
    mean = joined.groupBy("cluster_id").agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"))

    def area(rows: pa.Table) -> pa.Table:
        h = helpers.hull(list(zip(rows.column("x").to_pylist(), rows.column("y").to_pylist())))
        return pa.table({"cluster_id": rows.column("cluster_id")[:1], "hull_sqkm": [abs(helpers.signed_area(h)) / 1e6]})

    areas = hulls(joined).groupBy("cluster_id").applyInArrow(area, "cluster_id long, hull_sqkm double")  # corners of one hull
    back = g.from_utm(F.col("mx"), F.col("my"), srid)
    return mean.join(areas, "cluster_id").select("cluster_id", "n", back["x"].alias("lng"), back["y"].alias("lat"), "hull_sqkm")
