"""Filters and joins by place: equi-joins on cells of the boxes' own sizes, then an exact test."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from landloom.functions import geometry as g


def bbox_filter(df: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Rows whose bounding box (columns xmin to ymax) meets the box; with stored columns the test reaches the Parquet scan. Rows without a box go."""
    return df.where((F.col("xmax") >= x0) & (F.col("xmin") <= x1) & (F.col("ymax") >= y0) & (F.col("ymin") <= y1))


def layer_filter(df: DataFrame, layer: str, where: str | None = None) -> DataFrame:
    """Rows of exactly that layer, and of those that meet the condition."""
    out = df.where(F.col("layer") == layer)
    return out.where(F.expr(where)) if where else out


def cell(v: Column, size: float | Column) -> Column:
    return F.floor(v / size).cast("long")


#: Cells of one level of the index are so many times as wide as those of the level below.
STEP = 8


def _level(x0: str, y0: str, x1: str, y1: str) -> Column:
    """The narrowest cells that a box fills to 7/8 at most; no cell is so narrow that its number would lose digits."""
    extent = f"greatest({x1} - {x0}, {y1} - {y0}, greatest(abs({x0}), abs({x1}), abs({y0}), abs({y1})) * 1e-12D, 1e-300D)"
    return F.expr(f"cast(ceil(ln({extent} * {STEP / (STEP - 1)!r}D) / {math.log(STEP)!r}D + 1e-9D) as int)")


def _width(level: str) -> str:
    return f"power({STEP}.0D, {level})"  # a power of two, so exact


def _at(v: str, width: str) -> str:
    return f"cast(floor(({v}) / {width}) as bigint)"


def indexed(df: DataFrame, levels: DataFrame, first: bool) -> DataFrame:
    """``df`` (boxes _x0 to _y1 and their _level) with a row for each index cell (role, level, cx, cy) in which it can meet the boxes of another layer, whose ``levels`` (_levels, one row) are given.

    Boxes of a level meet in the cells that they cover, four at most (role 0). Of boxes of different levels the wider one lies in the cells that it covers when widened by an eighth of a cell to the left and below, four at most,
    and the narrower one in that cell alone which holds its lower left corner (role 1 where the first layer's box is the wider one, 2 where the second's is). So a box has no more cells than these, and one for each wider
    level of the other layer, however large it is.
    """
    wide, narrow = (1, 2) if first else (2, 1)
    width = _width("_level")

    def covered(x0: str, y0: str, role: int) -> str:
        cell_ = f"named_struct('role', {role}, 'level', _level, 'cx', cx, 'cy', cy)"
        return f"flatten(transform(sequence({_at(x0, width)}, {_at('_x1', width)}), cx -> transform(sequence({_at(y0, width)}, {_at('_y1', width)}), cy -> {cell_})))"

    none = "cast(array() as array<struct<role:int,level:int,cx:bigint,cy:bigint>>)"
    same = f"if(array_contains(_levels, _level), {covered('_x0', '_y0', 0)}, {none})"
    wider = f"if(exists(_levels, n -> n < _level), {covered(f'_x0 - {width} / {STEP}', f'_y0 - {width} / {STEP}', wide)}, {none})"
    above = f"transform(filter(_levels, n -> n > _level), n -> named_struct('role', {narrow}, 'level', n, 'cx', {_at('_x0', _width('n'))}, 'cy', {_at('_y0', _width('n'))}))"
    return df.join(F.broadcast(levels)).select(*df.columns, F.expr(f"inline(concat({same}, {wider}, {above}))"))  # one row of levels


def bbox_pairs(a: DataFrame, b: DataFrame, pad: float | Column = 0.0, on: list[str] | None = None) -> DataFrame:
    """Pairs of rows whose bounding boxes (the first widened by ``pad``, a number or an expression over its columns) meet, and whose columns ``on`` are equal, once each.

    Both sides come with columns xmin to ymax and others of different names; b's box columns come out with prefix b_. Rows without a box meet none. Each box is laid on cells of its own size (``indexed``), so layers of
    any extent, in degrees or metres, and boxes of mixed sizes meet by an equi-join, and no distinct is needed.
    """
    on = on or []
    box = ("xmin", "ymin", "xmax", "ymax")

    def boxed(df: DataFrame, by: str, names: dict[str, str]) -> DataFrame:
        ends = [F.expr(f"{c} {'-' if c.endswith('min') else '+'} {by}").alias(n) for c, n in zip(box, ("_x0", "_y0", "_x1", "_y1"))]
        out = df.where("xmin is not null").select(*[F.col(c).alias(names.get(c, c)) for c in df.columns if c != "_pad"], *ends)
        return out.withColumn("_level", _level("_x0", "_y0", "_x1", "_y1"))

    left = boxed(a.withColumn("_pad", pad if isinstance(pad, Column) else F.lit(float(pad))), "_pad", {})
    right = boxed(b, "0D", {c: f"b_{c}" for c in box})
    known = [df.agg(F.expr("sort_array(collect_set(_level))").alias("_levels")) for df in (left, right)]  # a few levels each
    theirs = indexed(right, known[0], False)
    moved = {c: f"_b{c}" for c in ("_x0", "_y0", "_x1", "_y1")}
    theirs = theirs.select(*[F.col(c).alias(moved.get(c, c)) for c in theirs.columns if c != "_level"])
    pairs = indexed(left, known[1], True).join(theirs, ["role", "level", "cx", "cy", *on])
    # Boxes of one level may share up to four cells: the pair counts where the lower left corner of what they have in common lies.
    own = f"(role <> 0 or cx = {_at('greatest(_x0, _b_x0)', _width('level'))} and cy = {_at('greatest(_y0, _b_y0)', _width('level'))})"
    met = pairs.where(f"_x0 <= _b_x1 and _x1 >= _b_x0 and _y0 <= _b_y1 and _y1 >= _b_y0 and {own}")
    return met.drop("role", "level", "cx", "cy", "_level", *moved, *moved.values())


def _with_place(df: DataFrame, geom: str) -> DataFrame:
    """With its bounding box, and whether it fills that (upright boxes), so that the box says all."""
    out = g.with_bbox(df, geom)
    space = (F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin"))
    return out.withColumn(f"{geom}_full", F.coalesce((F.size(g.vertices(F.col(geom))) == 5) & (space > 0) & (F.abs(g.area(F.col(geom)) - space) <= 1e-12 * space), F.lit(False)))


def spatial_join(a: DataFrame, b: DataFrame, predicate: str = "intersects") -> DataFrame:
    """Pairs (a_id, b_id) of rows (a_id, geom) and (b_id, geom) that meet the predicate: intersects, contains (a holds b) or within (b holds a).

    Touching counts. Null and empty geometries are in no pair; ids that repeat give their rows' pairs. Of upright boxes the bounding boxes tell; sides are looked at for the rest.
    """
    left, right = (_with_place(df.select(i, F.col("geom").alias(n)), n) for df, i, n in ((a, "a_id", "a_geom"), (b, "b_id", "b_geom")))
    c = F.col
    holds = lambda p, q: (c(f"{p}xmin") <= c(f"{q}xmin")) & (c(f"{p}xmax") >= c(f"{q}xmax")) & (c(f"{p}ymin") <= c(f"{q}ymin")) & (c(f"{p}ymax") >= c(f"{q}ymax"))
    tests = {
        "intersects": lambda: F.when(c("a_geom_full") & c("b_geom_full"), True).otherwise(g.intersects(c("a_geom"), c("b_geom"))),
        "contains": lambda: F.when(~holds("", "b_"), False).when(c("a_geom_full"), True).otherwise(g.contains(c("a_geom"), c("b_geom"))),
        "within": lambda: F.when(~holds("b_", ""), False).when(c("b_geom_full"), True).otherwise(g.contains(c("b_geom"), c("a_geom"))),
    }
    return bbox_pairs(left, right).where(tests[predicate]()).select("a_id", "b_id")


def overlaps(a: DataFrame, b: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Pairs (on..., a_id, b_id, a_area, b_area, overlap) of rows that meet and whose columns ``on`` are equal; touching ones have overlap 0. A point's area and overlap are 0.

    Of two upright boxes the overlap is a product, and no geometry leaves the JVM; all others are measured in batches.
    """
    on = on or []
    left, right = (_with_place(df.select(*on, i, F.col("geom").alias(n)), n).withColumn(f"{n[0]}_area", g.area(F.col(n))) for df, i, n in ((a, "a_id", "a_geom"), (b, "b_id", "b_geom")))
    boxes = F.col("a_geom_full") & F.col("b_geom_full")
    met = bbox_pairs(left, right, on=on).where(F.when(boxes, True).otherwise(g.intersects(F.col("a_geom"), F.col("b_geom"))))
    side = lambda f: F.least(f"{f}max", f"b_{f}max") - F.greatest(f"{f}min", f"b_{f}min")
    other = ~boxes & (F.col("a_area") > 0) & (F.col("b_area") > 0)
    area = g.overlap_area(F.when(other, F.col("a_geom")), F.when(other, F.col("b_geom")))
    return met.select(*on, "a_id", "b_id", "a_area", "b_area", F.when(boxes, side("x") * side("y")).otherwise(area).alias("overlap"))


def point_in_polygon(points: DataFrame, polygons: DataFrame) -> DataFrame:
    """Pairs (fid, poly_id) of points (fid, x, y) and polygons (poly_id, geom) that hold them; a boundary holds. Points in no polygon give no row."""
    left = points.select("fid", "x", "y", F.col("x").alias("xmin"), F.col("y").alias("ymin"), F.col("x").alias("xmax"), F.col("y").alias("ymax"))
    met = bbox_pairs(left, _with_place(polygons.select("poly_id", "geom"), "geom"))
    return met.where(F.when(F.col("geom_full"), True).otherwise(g.in_polygon(F.col("x"), F.col("y"), F.col("geom")))).select("fid", "poly_id")


def _neighbour_cells(df: DataFrame, size: float) -> DataFrame:
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    out = df.withColumn("dx", F.explode(around)).withColumn("dy", F.explode(around))
    return out.withColumns({"cx": cell(F.col("x"), size) + F.col("dx"), "cy": cell(F.col("y"), size) + F.col("dy")}).drop("dx", "dy")


#: Points of a block that meet the points around it in one task, and pairs that a task compares, some.
BLOCK, COMPARED = 1024, 1 << 27


def neighbors_within(points: DataFrame, eps: float) -> DataFrame:
    """All pairs (a, b, dist) of points (fid, x, y) at most ``eps`` apart, each with itself too.

    Its rows are the answer, so dense places give many; operators that only need counts or links group before (see patterns). The points of a cell of side ``eps`` are dealt to blocks of some BLOCK points, and each
    point moves once to every block of the cells around its own: however crowded a place is, its pairs are compared by as many tasks as their number asks for.
    """
    from landloom.session import cut, dealt, spread

    home = points.select("fid", "x", "y", cell(F.col("x"), eps).alias("hx"), cell(F.col("y"), eps).alias("hy")).where("hx is not null and hy is not null")
    home = cut(spread(home))
    sizes = cut(home.groupBy("hx", "hy").agg(F.count("*").alias("n")).withColumn("deals", F.ceil(F.col("n") / BLOCK)))
    blocks = sizes.select("hx", "hy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("deals") - 1)).alias("deal"))
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    there = blocks.withColumn("dx", F.explode(around)).withColumn("dy", F.explode(around)).select("hx", "hy", "deal", (F.col("hx") + F.col("dx")).alias("cx"), (F.col("hy") + F.col("dy")).alias("cy"))
    moved = there.join(dealt(sizes.select(F.col("hx").alias("cx"), F.col("hy").alias("cy"), "n")), ["cx", "cy"]).agg(F.sum("n")).first()[0] or 0
    tasks = max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(moved * BLOCK / COMPARED))
    key = ["hx", "hy", "deal"]
    left = home.select(F.col("fid").alias("a"), "x", "y", F.col("hx").alias("cx"), F.col("hy").alias("cy")).join(dealt(there), ["cx", "cy"]).select(*key, "a", "x", "y")
    held = home.join(dealt(sizes), ["hx", "hy"]).withColumn("deal", F.pmod(F.xxhash64("fid", "x", "y"), F.col("deals")))
    held = held.select(*key, F.col("fid").alias("b"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    dist = F.sqrt((F.col("x") - F.col("x2")) * (F.col("x") - F.col("x2")) + (F.col("y") - F.col("y2")) * (F.col("y") - F.col("y2")))
    return left.repartition(tasks, *key).join(dealt(held.repartition(tasks, *key)), key).withColumn("dist", dist).where(F.col("dist") <= eps).select("a", "b", "dist")


#: Places of the most crowded cell with which a search for neighbours starts.
CROWD = 64


def nearest_neighbor(points: DataFrame, size: float) -> DataFrame:
    """(fid, dist) to the nearest other row; coincident rows give 0, a single row gives null.

    Rows that share a place need no search. Cells of side ``size`` are made narrower until the most crowded one holds CROWD places at most, so no crowd is compared with itself. Then each
    row looks through the cells around its own; those that find none within a side look again in cells four times as wide, which only rows far from
    others do. Each round has fewer rows.
    """
    from landloom.session import cut, dealt

    places = points.groupBy("x", "y").agg(F.count("*").alias("n"), F.min("fid").alias("fid"))
    places = cut(places)
    many = points.join(dealt(places.where("n > 1").select("x", "y")), ["x", "y"], "left_semi").select("fid", F.lit(0.0).alias("dist"))
    rest, done, total = cut(places.where("n = 1").select("fid", "x", "y")), [many], places.count()
    if total < 2:
        return many.unionByName(rest.select("fid", F.lit(None).cast("double").alias("dist")))
    ends = places.agg(F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.max(F.greatest(F.abs("x"), F.abs("y")))).first()
    span = max(ends[0], ends[1])
    while places.groupBy(cell(F.col("x"), size), cell(F.col("y"), size)).count().agg(F.max("count")).first()[0] > CROWD and size > ends[2] * 1e-12:
        size /= 4
    while rest.take(1):
        right = places.select(F.col("x").alias("x2"), F.col("y").alias("y2"), cell(F.col("x"), size).alias("cx"), cell(F.col("y"), size).alias("cy"))
        dist = F.sqrt((F.col("x") - F.col("x2")) * (F.col("x") - F.col("x2")) + (F.col("y") - F.col("y2")) * (F.col("y") - F.col("y2")))
        near = _neighbour_cells(rest, size).join(dealt(right), ["cx", "cy"]).where("x <> x2 or y <> y2").groupBy("fid").agg(F.min(dist).alias("dist"))
        sure = F.lit(True) if size > span else F.col("dist") <= size
        found = cut(near.where(sure))
        done.append(found)
        rest = cut(rest.join(dealt(found.select("fid")), "fid", "left_anti"))
        size *= 4
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def dwithin(df: DataFrame, x: float, y: float, metres: float, k: int) -> DataFrame:
    """The k rows nearest to a point within so many metres (great circle), nearest first, ties by fid: (fid, metres).

    The search cap is a range of latitudes and one or two of longitudes, so that it reaches over the 180th meridian; a cap that holds a pole takes all longitudes. Both reach the scan.
    """
    reach = metres / g.SPHERE * (1 + 1e-9) + 1e-12
    low, high = y - math.degrees(reach), y + math.degrees(reach)
    near = df.where(F.col("y").between(low - 1e-9, high + 1e-9))
    if low > -90 and high < 90:
        spread = math.degrees(math.asin(min(1.0, math.sin(reach) / math.cos(math.radians(y))))) + 1e-9
        middle = (x + 180) % 360 - 180
        west, east = middle - spread, middle + spread
        there = F.col("x").between(west, east)
        if west < -180:
            there |= F.col("x") >= west + 360
        if east > 180:
            there |= F.col("x") <= east - 360
        near = near.where(there)
    dist = g.distance_sphere("x", "y", F.lit(x), F.lit(y))
    return near.select("fid", dist.alias("metres")).where(F.col("metres") <= metres).orderBy("metres", "fid").limit(k)


def density_grid(points: DataFrame, size: float) -> DataFrame:
    """(cell_x, cell_y, n): points in each cell that has some; sums are made before the shuffle, so a crowded cell moves as one row a task."""
    return points.groupBy(cell(F.col("x"), size).alias("cell_x"), cell(F.col("y"), size).alias("cell_y")).agg(F.count("*").alias("n"))


#: Bits of each coordinate along the curve, and of a place's number that its stretch of the curve has.
CURVE, STRETCH = 16, 20


def along_curve(x: str, y: str, x0: float, y0: float, span: float) -> Column:
    """A place's number along a curve that fills a square (bits of x and y in turn), so that near numbers are near places."""
    spread = lambda v: f"(((({v} | shiftleft({v}, 8)) & 16711935) | shiftleft(({v} | shiftleft({v}, 8)) & 16711935, 4)) & 252645135)"
    cell_ = lambda v, low: f"cast(greatest(0, least({(1 << CURVE) - 1}, floor(({v} - {low!r}D) / {span!r}D * {1 << CURVE}))) as bigint)"
    wide = lambda v: f"transform(array({v}), v -> transform(array({spread('v')}), u -> transform(array((u | shiftleft(u, 2)) & 858993459), w -> (w | shiftleft(w, 1)) & 1431655765)[0])[0])[0]"
    return F.expr(f"{wide(cell_(x, x0))} | shiftleft({wide(cell_(y, y0))}, 1)")


def collect_geometry(df: DataFrame, by: str, most: int = 100_000) -> DataFrame:
    """(by, part, n, geom): the geometries of each group in multi-geometries of some ``most`` vertices each, not dissolved; null geometries are left out.

    A group's features are numbered along a space-filling curve, so that a part is a neighbourhood, by running counts of their vertices: a part has ``most`` at most, a feature that has more by itself being a part of its own
    with what shares its number. Counts run over stretches of the curve first, then inside each stretch, so no task sees a group.
    """
    rows = g.with_bbox(df.where(F.col("geom").isNotNull()).select(by, "fid", "geom")).withColumn("v", F.expr("greatest(1, size(flatten(flatten(geom.parts))))"))
    ends = rows.agg(F.min("xmin"), F.max("xmax"), F.min("ymin"), F.max("ymax")).first()
    x0, y0, span = (ends[0], ends[2], max(ends[1] - ends[0], ends[3] - ends[2], 1e-9) * (1 + 1e-9)) if ends[0] is not None else (0.0, 0.0, 1.0)
    placed = rows.withColumn("z", F.coalesce(along_curve("(xmin + xmax) / 2", "(ymin + ymax) / 2", x0, y0, span), F.lit(0))).withColumn("s", F.shiftright("z", 2 * CURVE - STRETCH))
    stretches = placed.groupBy(by, "s").agg(F.sum("v").alias("sum"))
    before = stretches.select(by, "s", F.coalesce(F.sum("sum").over(Window.partitionBy(by).orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # 2 ** STRETCH rows of a group at most
    own = F.sum("v").over(Window.partitionBy(by, "s").orderBy("z", "fid").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    numbered = placed.withColumn("own", own).join(before, [by, "s"]).withColumn("part", F.floor((F.col("before") + F.col("own") - 1) / most))
    parts = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("z", "fid", F.col("geom.parts").alias("parts")))), lambda s: s["parts"]))
    kind = F.concat(F.lit("Multi"), F.regexp_replace(F.min("geom.type"), "^Multi", ""))
    return numbered.groupBy(by, "part").agg(F.count("*").alias("n"), g.make(kind, parts).alias("geom"))


#: Candidates of a cell that a task compares with the sums around it, some.
DEAL = 4096


def _deals(candidates: DataFrame, size: float) -> tuple[DataFrame, DataFrame]:
    """Candidates with their cell and deal (hx, hy, deal), a cell having as many deals as its count asks for; and the deals."""
    home = candidates.withColumns({"hx": cell(F.col("x"), size), "hy": cell(F.col("y"), size)}).where("hx is not null and hy is not null")
    sizes = home.groupBy("hx", "hy").agg(F.ceil(F.count("*") / DEAL).alias("deals"))
    dealt = home.join(sizes, ["hx", "hy"]).withColumn("deal", F.pmod(F.xxhash64("candidate_id"), F.col("deals"))).drop("deals")
    return dealt, sizes.select("hx", "hy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("deals") - 1)).alias("deal"))


def density_count(candidates: DataFrame, layer: DataFrame, radius_deg: float) -> DataFrame:
    """(candidate_id, n): layer points (x, y) at most the radius in degrees from a candidate (candidate_id, x, y); candidates without any have 0.

    The layer is counted on a grid of an eighth of the radius first. Cells that lie wholly inside a candidate's circle count by their sum,
    so only the points of cells on its edge are compared one by one. Candidates of a crowded cell are dealt, and each deal gets the sums around the cell.
    """
    fine = radius_deg / 8
    pts = layer.select(F.col("x").alias("x2"), F.col("y").alias("y2"), cell(F.col("x"), fine).alias("fx"), cell(F.col("y"), fine).alias("fy"))
    pts = pts.groupBy("x2", "y2", "fx", "fy").agg(F.count("*").alias("m"))
    grid = pts.groupBy("fx", "fy").agg(F.sum("m").alias("m"))
    coarse = lambda v: F.floor(v / 8).cast("long")
    wide = grid.withColumns({"cx": coarse(F.col("fx")), "cy": coarse(F.col("fy"))})
    asked, deals = _deals(candidates.select("candidate_id", "x", "y"), radius_deg)
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    there = deals.withColumn("dx", F.explode(around)).withColumn("dy", F.explode(around)).select("hx", "hy", "deal", (F.col("hx") + F.col("dx")).alias("cx"), (F.col("hy") + F.col("dy")).alias("cy"))
    far = lambda v, f: F.greatest(F.abs(F.col(v) - F.col(f) * fine), F.abs(F.col(v) - (F.col(f) + 1) * fine))
    low = lambda v, f: F.greatest(F.lit(0.0), F.col(f) * fine - F.col(v), F.col(v) - (F.col(f) + 1) * fine)
    sq = lambda a, b: F.sqrt(a * a + b * b)
    slack = radius_deg * 1e-9
    met = asked.join(there.join(wide, ["cx", "cy"]), ["hx", "hy", "deal"]).withColumns({"most": sq(far("x", "fx"), far("y", "fy")), "least": sq(low("x", "fx"), low("y", "fy"))})
    inside = met.where(F.col("most") < radius_deg - slack).select("candidate_id", "m")
    edge = met.where((F.col("most") >= radius_deg - slack) & (F.col("least") <= radius_deg + slack)).select("candidate_id", "x", "y", "fx", "fy")
    tested = edge.join(pts, ["fx", "fy"]).where(sq(F.col("x") - F.col("x2"), F.col("y") - F.col("y2")) <= radius_deg).select("candidate_id", "m")
    counted = inside.unionByName(tested).groupBy("candidate_id").agg(F.sum("m").alias("n"))
    return candidates.select("candidate_id").join(counted, "candidate_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
