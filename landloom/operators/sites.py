"""Site suitability: measured values of each candidate and criterion, then curves, score and advice."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from landloom.functions import geometry as g, scoring as sc
from landloom.operators import spatial as sp
from landloom.session import cut, dealt, spread


def merge_layers(sources: list[DataFrame]) -> DataFrame:
    """Rows (layer_key, fid, geom) of several sources; a later source replaces a layer of the same key."""
    tagged = reduce(DataFrame.unionByName, [s.select("layer_key", "fid", "geom").withColumn("source", F.lit(i)) for i, s in enumerate(sources)])
    last = F.broadcast(tagged.groupBy("layer_key").agg(F.max("source").alias("source")))  # a row for each layer
    return tagged.join(last, ["layer_key", "source"]).drop("source")


def segments(layer: DataFrame) -> DataFrame:
    """(layer_key, fid, ax, ay, bx, by): the sides of all geometries; a point is a side of length 0."""
    side = lambda p, q: f"named_struct('ax', {p}.x, 'ay', {p}.y, 'bx', {q}.x, 'by', {q}.y)"
    of_ring = f"if(size(r) > 1, zip_with(slice(r, 1, size(r) - 1), slice(r, 2, size(r) - 1), (p, q) -> {side('p', 'q')}), transform(r, p -> {side('p', 'p')}))"
    return layer.where(F.col("geom").isNotNull()).select("layer_key", "fid", F.expr(f"inline(flatten(transform(flatten(geom.parts), r -> {of_ring})))"))


def sides_of(candidates: DataFrame) -> DataFrame:
    """(candidate_id, cax, cay, cbx, cby): the sides of candidates (candidate_id, geom) or of points (candidate_id, x, y)."""
    geom = F.col("geom") if "geom" in candidates.columns else g.point(F.col("x"), F.col("y"))
    rows = segments(candidates.select(F.lit("").alias("layer_key"), F.col("candidate_id").alias("fid"), geom.alias("geom")))
    return rows.select(F.col("fid").alias("candidate_id"), *[F.col(c).alias(f"c{c}") for c in ("ax", "ay", "bx", "by")])


def _gap_text() -> str:
    ends = [("cax", "cay"), ("cbx", "cby"), ("ax", "ay"), ("bx", "by")]
    options = []
    for k, (x, y) in enumerate(ends):
        (ax, ay), (bx, by) = (ends[2], ends[3]) if k < 2 else (ends[0], ends[1])
        dx, dy = f"({bx} - {ax})", f"({by} - {ay})"
        along = f"if({dx} = 0 and {dy} = 0, 0D, least(1D, greatest(0D, (({x} - {ax}) * {dx} + ({y} - {ay}) * {dy}) / nullif({dx} * {dx} + {dy} * {dy}, 0D))))"
        # The place of the other side that is closest to this end.
        place = f"transform(array({along}), t -> named_struct('px', {ax} + t * {dx}, 'py', {ay} + t * {dy}))"
        options.append(f"transform({place}, p -> named_struct('flat', sqrt(({x} - p.px) * ({x} - p.px) + ({y} - p.py) * ({y} - p.py)), 'x', {x}, 'y', {y}, 'px', p.px, 'py', p.py))[0]")
    turn = lambda p, q, r: f"(({q[0]} - {p[0]}) * ({r[1]} - {p[1]}) - ({q[1]} - {p[1]}) * ({r[0]} - {p[0]}))"
    a, b, c, d = ends
    crossing = f"signum({turn(a, b, c)}) * signum({turn(a, b, d)}) < 0 and signum({turn(c, d, a)}) * signum({turn(c, d, b)}) < 0"
    return f"if({crossing}, named_struct('flat', 0D, 'x', cax, 'y', cay, 'px', cax, 'py', cay), least({', '.join(options)}))"


def side_gap() -> Column:
    """struct<flat, x, y, px, py>: the least distance of two sides, ca to cb and a to b, in the plane, and the places that are so far apart; 0 where the sides cross.

    If they don't cross, an end of one of them is closest.
    """
    return F.expr(_gap_text())


def inside_pairs(candidates: DataFrame, layer: DataFrame) -> DataFrame:
    """Pairs (candidate_id, layer_key, fid) of which one geometry lies in the other or over its edge: a first vertex of a part of one is in a polygon of the other."""
    geom = F.col("geom") if "geom" in candidates.columns else g.point(F.col("x"), F.col("y"))
    own = candidates.select("candidate_id", geom.alias("geom")).where(F.col("geom").isNotNull())
    feats = layer.select("layer_key", "fid", "geom").where(F.col("geom").isNotNull())

    def firsts(df: DataFrame, *ids: str) -> DataFrame:
        v = df.select(*ids, F.explode(F.transform("geom.parts", lambda part: part[0][0])).alias("v")).where("v is not null")
        return v.select(*ids, F.col("v.x").alias("x"), F.col("v.y").alias("y"), *[F.col(f"v.{c[0]}").alias(c) for c in ("xmin", "xmax", "ymin", "ymax")])

    areas = lambda df, *ids: g.with_bbox(df.where(g.is_area(F.col("geom"))).select(*ids, "geom")).where("xmin is not null")
    one = sp.bbox_pairs(firsts(own, "candidate_id"), areas(feats, "layer_key", "fid")).where(g.in_polygon(F.col("x"), F.col("y"), F.col("geom")))
    other = sp.bbox_pairs(firsts(feats, "layer_key", "fid"), areas(own, "candidate_id")).where(g.in_polygon(F.col("x"), F.col("y"), F.col("geom")))
    return one.select("candidate_id", "layer_key", "fid").unionByName(other.select("candidate_id", "layer_key", "fid"))


#: Sides that a leaf of the search tree holds at most, cells of a node along each axis, and the depth at which places can't be told apart any more.
LEAF, SPLIT, DEEPEST = 64, 8, 14
# Metres that a degree has at least, along a meridian, and at most, in any direction.
DEGREE = (110500.0, 111700.0)
#: Lengths on the ellipsoid as shares of those on the sphere of its mean radius, at least and at most; and leaves of a candidate and layer whose number is no matter.
SPHEROID, CLOSE = (0.9943, 1.0057), 32


def side_tree(seg: DataFrame, x0: float, y0: float, span: float, most: int | None = None, depth: int = 0) -> tuple[list[DataFrame], DataFrame, int]:
    """A count quadtree of sides (layer_key, fid, ax to by, lone: the feature's only one): the nodes of each depth (layer_key, cx, cy, lone, leaf, box of their sides nx0 to ny1, an end of one of them sx, sy), and the
    sides with their leaf (depth, cx, cy); and the depth.

    Cells are SPLIT times narrower at each depth, the first one being that after ``depth``; those with more than ``most`` sides (LEAF) have children. So crowds have deep leaves and lonely sides shallow ones, and each side lies in one leaf.
    """
    middle = lambda a, b, low: ((F.col(a) + F.col(b)) / 2 - low) / span
    rest = seg.withColumns({"tx": middle("ax", "bx", x0), "ty": middle("ay", "by", y0)})
    nodes, held, key, most = [], [], ["layer_key", "cx", "cy"], LEAF if most is None else most
    while True:
        depth += 1
        at = rest.withColumns({"cx": F.floor(F.col("tx") * float(SPLIT**depth)).cast("long"), "cy": F.floor(F.col("ty") * float(SPLIT**depth)).cast("long")})
        ends = lambda f, of, axis: f(of(f"a{axis}", f"b{axis}"))
        box = {"nx0": ends(F.min, F.least, "x"), "ny0": ends(F.min, F.least, "y"), "nx1": ends(F.max, F.greatest, "x"), "ny1": ends(F.max, F.greatest, "y")}
        cells = at.groupBy(*key).agg(F.count("*").alias("n"), F.min(F.struct("ax", "ay")).alias("s"), F.min("lone").alias("lone"), *[v.alias(k) for k, v in box.items()])
        cells = cut(cells.select(*key, "lone", ((F.col("n") <= most) | F.lit(depth == DEEPEST)).alias("leaf"), *box, F.col("s.ax").alias("sx"), F.col("s.ay").alias("sy")))
        nodes.append(cells)
        crowded = cells.where("not leaf").select(*key)
        if not crowded.take(1):
            held.append(at.withColumn("depth", F.lit(depth)))
            break
        held.append(at.join(crowded, key, "left_anti").withColumn("depth", F.lit(depth)))
        rest = cut(at.join(crowded, key, "left_semi").drop("cx", "cy"))
    return nodes, reduce(DataFrame.unionByName, [h.drop("tx", "ty") for h in held]), depth


def _metres(sphere: bool) -> tuple[float, float, float]:
    """Lengths as shares of those on the sphere of the mean radius, at least and at most; and metres that a degree has at most."""
    return (1.0, 1.0, math.radians(1) * g.SPHERE * (1 + 1e-9)) if sphere else (*SPHEROID, DEGREE[1])


def _arc(dy: str, cosines: str, dx: str) -> str:
    return f"{2 * g.SPHERE!r}D * asin(sqrt(least(1D, greatest(0D, power(sin(radians({dy}) / 2), 2) + {cosines} * power(sin(radians({dx}) / 2), 2)))))"


def _box_bounds(n: str, sphere: bool) -> dict[str, str]:
    """Of a candidate's box (kx0 to ky1) and one of sides (n..x0 to n..y1): their gap in degrees, the least length between places of them, and the metres that a degree of the gap has at least.

    Latitudes over 90 degrees, which lead down the other side, are places too: there cosines are under 0 and lengths get shorter again from 180 degrees on.
    """
    apart = lambda v: f"greatest(0D, {n}{v}0 - k{v}1, k{v}0 - {n}{v}1)"
    across = lambda v: f"(greatest({n}{v}1, k{v}1) - least({n}{v}0, k{v}0))"
    top = lambda p: f"greatest(abs({p}y0), abs({p}y1))"
    farthest = lambda p: f"cos(radians(least(90D, {top(p)})))"
    half = f"greatest(1e-9D, least({math.pi!r}D, radians(greatest({across('x')}, {across('y')})) / 2))"
    turn = f"greatest(0D, least({apart('x')}, 360D - {across('x')}))"  # the longitudes between them, whichever way is shorter
    rest = f"if({across('y')} > 180, {across('y')}, 0D)"
    dy = f"if({rest} > 0 and abs(sin(radians({rest}) / 2)) < abs(sin(radians({apart('y')}) / 2)), {rest}, {apart('y')})"
    over = f"greatest({top(n)}, {top('k')}) > 90"
    return {
        "gap": f"sqrt({apart('x')} * {apart('x')} + {apart('y')} * {apart('y')})",
        "least": f"{_metres(sphere)[0]!r}D * {_arc(dy, f'if({over}, -1D, {farthest(n)} * {farthest("k")})', f'if({over}, least(180D, {across("x")}), {turn})')}",
        "slope": f"{DEGREE[0]!r}D * least({farthest(n)}, {farthest('k')}) * sin({half}) / {half}",  # a chord is shorter than its arc
    }


def _most(x: str, y: str, sphere: bool, spots: bool) -> str:
    """The most that the length from a candidate in the box to a feature with an end (x, y) can be. A point's length is at most that from the box's vertex and the box's diagonal; a shape's nearest
    place in the plane is nowhere farther than its end, in degrees."""
    _, high, degree = _metres(sphere)
    wide = f"{degree!r}D * sqrt((kx1 - kx0) * (kx1 - kx0) + (ky1 - ky0) * (ky1 - ky0))"
    far = f"{high!r}D * {_arc(f'vy - {y}', f'cos(radians(vy)) * cos(radians({y}))', f'vx - {x}')}" if spots else f"{degree!r}D * sqrt((vx - {x}) * (vx - {x}) + (vy - {y}) * (vy - {y}))"
    return f"{far} + {wide}"


def _toward(x: str, y: str) -> str:
    """The cosine, on the sphere, of the angle from the middle of a candidate's box to a place."""
    return f"(sin(radians((ky0 + ky1) / 2)) * sin(radians({y})) + cos(radians((ky0 + ky1) / 2)) * cos(radians({y})) * cos(radians({x} - (kx0 + kx1) / 2)))"


def _behind(x: str, y: str, radius: str) -> str:
    """Whether from everywhere in a candidate's box a known feature ``w`` is nearer, on the sphere, than all within ``radius`` (radians) of a place; ``diag`` is what places of one candidate may be apart.

    Lengths grow as the products c * f of unit vectors fall, and c * (w - f) is c's middle's by as much at most as half the box's diagonal times |w - f|; so far from features that lie together next to nothing is left of the box.
    """
    half = "radians(sqrt((kx1 - kx0) * (kx1 - kx0) + (ky1 - ky0) * (ky1 - ky0))) / 2"
    return f"w.d - {_toward(x, y)} > {half} * radians(sqrt((w.x - {x}) * (w.x - {x}) + (w.y - {y}) * (w.y - {y}))) + {radius} + diag + 1e-14D"


def near_leaves(places: DataFrame, layers: DataFrame, nodes: list[DataFrame], sphere: bool = False, spots: bool = True) -> DataFrame:
    """(candidate_id, layer_key, depth, cx, cy, kx0 to ky1, best): the leaves whose sides can be a candidate's nearest, or, where the box is that of many candidates, the nearest of one of them, and the most that the least
    length can be; ``spots`` says that all features are points.

    A node's box bounds the length from a candidate (box kx0 to ky1, a vertex vx, vy) to all its sides from below, the end that it knows of that to its nearest from above. Down the tree, nodes go whose least
    possible length is over the least upper bound so far. Features of several sides count by their nearest place in the plane: of them no node goes that is as near, in the plane, as one that may count. ``layers`` are
    the pairs (candidate_id, layer_key) that are looked for. Where many leaves are left, as for a candidate far from a crowd, whose bounds on the ellipsoid are as wide as the crowd, its own length to the
    leaf's middle tells. On the sphere, among points, the nearest known feature w (cosine d, place x, y) tells too what can't be nearer (``_behind``).
    """
    known = sphere and spots
    if "diag" not in places.columns:
        places = places.withColumn("diag", F.lit(0.0))

    def measured(n: str = "") -> dict[str, str]:
        bounds = _box_bounds(f"{n}n", sphere)
        return {
            "gap": bounds["gap"],
            "least": bounds["least"],
            "most": _most(f"{n}sx", f"{n}sy", sphere, spots),
            "slope": bounds["slope"],
            "sx": f"{n}sx",
            "sy": f"{n}sy",
            "mx": f"({n}nx0 + {n}nx1) / 2",
            "my": f"({n}ny0 + {n}ny1) / 2",
            "radius": f"{DEGREE[1]!r}D * sqrt(({n}nx1 - {n}nx0) * ({n}nx1 - {n}nx0) + ({n}ny1 - {n}ny0) * ({n}ny1 - {n}ny0)) / 2",
        }

    each = Window.partitionBy("candidate_id", "layer_key")
    own = ["candidate_id", "layer_key", "kx0", "ky0", "kx1", "ky1", "vx", "vy", "diag"]
    behind = lambda p="": f"not {_behind(f'{p}mx', f'{p}my', f'radians({p}radius / {DEGREE[1]!r}D)')}" if known else "true"
    nearest = f"max(struct({_toward('sx', 'sy')} as d, sx as x, sy as y))" if known else "cast(null as struct<d:double,x:double,y:double>)"
    told = ["depth", "cx", "cy", "leaf", "lone", *measured()]
    slack = "* (1 + 1e-9D) + 1e-6D"

    def pruned(rows: DataFrame) -> DataFrame:
        some = rows.withColumn("best", F.expr("min(most)").over(each) * (1 + 1e-9) + 1e-6)
        some = some.withColumn("flat", F.expr("min(case when least <= best then slope end)").over(each))
        some = some.withColumn("w", F.expr(nearest).over(each) if known else F.expr(nearest))
        return some.where(f"(least <= best or not lone and gap * flat <= best) and {behind()}").select(*own, *told, "best", "w")

    # The uppermost nodes, SPLIT * SPLIT of a layer at most, come as one array a layer, so that nothing moves for them.
    top = nodes[0].groupBy("layer_key").agg(F.expr("collect_list(struct(1 as depth, cx, cy, leaf, lone, nx0, ny0, nx1, ny1, sx, sy))").alias("ns"))
    held = layers.join(places, "candidate_id").join(F.broadcast(top), "layer_key")
    fields = ", ".join([f"'{k}', n.{k}" for k in told[:5]] + [f"'{k}', {v}" for k, v in measured("n.").items()])
    held = held.withColumn("m", F.expr(f"transform(ns, n -> named_struct({fields}))")).drop("ns")
    held = held.withColumn("w", F.expr(f"array_max(transform(m, x -> named_struct('d', {_toward('x.sx', 'x.sy')}, 'x', x.sx, 'y', x.sy)))" if known else nearest))
    held = held.withColumn("best", F.expr(f"array_min(transform(m, x -> x.most)) {slack}"))
    held = held.withColumn("flat", F.expr("array_min(transform(filter(m, x -> x.least <= best), x -> x.slope))"))
    found = held.select(*own, "best", "w", F.expr(f"inline(filter(m, x -> (x.least <= best or not x.lone and x.gap * flat <= best) and {behind('x.')}))"))
    for depth, below in enumerate(nodes[1:], 2):
        found = cut(found)
        parents = found.where("not leaf").select(*own, "best", "w", F.col("cx").alias("px"), F.col("cy").alias("py"))
        under = below.withColumns({"px": F.floor(F.col("cx") / SPLIT), "py": F.floor(F.col("cy") / SPLIT)})
        children = parents.join(under, ["layer_key", "px", "py"]).select(*own, "best", "w", F.lit(depth).alias("depth"), *told[1:5], *[F.expr(v).alias(k) for k, v in measured().items()])
        # What the bound so far excludes doesn't move.
        found = pruned(found.where("leaf").unionByName(children.where(f"(not lone or least <= best) and {behind()}")).drop("best", "w"))
    found = cut(found)
    out = ["candidate_id", "layer_key", *told[:3], *own[2:6]]
    best = F.expr("min(most)").over(each) * (1 + 1e-9) + 1e-6
    if sphere:
        return found.drop("best").select(*out, "diag", best.alias("best"), (F.expr(nearest).over(each) if known else F.expr(nearest)).alias("w"))
    wide = f"{DEGREE[1]!r}D * sqrt(power(greatest(vx - kx0, kx1 - vx), 2) + power(greatest(vy - ky0, ky1 - vy), 2))"
    many = found.withColumn("n", F.count("*").over(each))
    exact = many.where(F.col("n") > CLOSE).withColumn("m", g.distance_geodesic(F.col("vx"), F.col("vy"), F.col("mx"), F.col("my"))).withColumn("wide", F.expr(wide))
    exact = exact.withColumns({"least": F.expr("greatest(least, coalesce(m - radius - wide, 0D))"), "most": F.expr("least(most, coalesce(m + radius + wide, most))") if spots else F.col("most")})
    return pruned(exact).drop("best", "w").unionByName(many.where(F.col("n") <= CLOSE).select(*own, *told)).select(*out, best.alias("best"))


def _in_reach(candidates: DataFrame, ends: tuple[float, ...], metres: float, sphere: bool) -> DataFrame:
    """Candidates whose box may be so near to that of all sides (x0, x1, y0, y1), dealt to all tasks, behind a checkpoint."""
    box = g.bbox(F.col("geom")) if "geom" in candidates.columns else F.struct(F.col("x").alias("xmin"), F.col("y").alias("ymin"), F.col("x").alias("xmax"), F.col("y").alias("ymax"))
    known = {**{f"k{v}{k}": F.col(f"_at.{v}{end}") for v in "xy" for k, end in ((0, "min"), (1, "max"))}, **{n: F.lit(e) for n, e in zip(("nx0", "nx1", "ny0", "ny1"), ends)}}
    rows = spread(candidates).withColumn("_at", box).withColumns(known)
    return cut(rows.where(F.expr(f"{_box_bounds('n', sphere)['least']} <= {metres!r}D * (1 + 1e-9D) + 1e-6D")).select(*candidates.columns))


def nearest_distance(candidates: DataFrame, layer: DataFrame, keys: list[str] | None = None, sphere: bool = False, within: dict[str, float] | None = None) -> DataFrame:
    """(candidate_id, layer_key, metres): of each layer the least distance of a candidate, a geometry of any type (candidate_id, geom) or a point (candidate_id, x, y), to a feature.

    For each feature the nearest places in the plane count, and the length between them on the ellipsoid (or the sphere); 0 where they meet or one lies in the other. The features' sides lie in a tree by their counts;
    candidates, in groups of neighbours, go down it with bounds and meet the sides of the few leaves that can hold the nearest of one of them; there each candidate's own bound is told first, and only
    the sides within it are measured. So neither crowds nor empty stretches make many pairs, and a group moves once. Layers without a geometry give no
    row, and candidates without one neither. Distances over a layer's metres in ``within`` may be left out: bounds tell them, and nothing is searched for candidates that are farther than that from all there is.
    """
    feats = layer.where(F.col("layer_key").isin(keys)) if keys is not None else layer
    spots, shapes = feats.where("geom.type = 'Point'"), feats.where("geom.type <> 'Point'")
    points = segments(spots).groupBy("layer_key", "ax", "ay", "bx", "by").agg(F.min("fid").alias("fid"))  # points in one place are one
    lone = F.expr("size(geom.parts) = 1 and size(geom.parts[0]) = 1 and size(geom.parts[0][0]) <= 2")
    several = segments(shapes.where(~lone)).withColumn("lone", F.lit(False)).unionByName(segments(shapes.where(lone)).withColumn("lone", F.lit(True)))
    seg = cut(points.withColumn("lone", F.lit(True)).unionByName(several))
    ends = seg.agg(F.min(F.least("ax", "bx")), F.max(F.greatest("ax", "bx")), F.min(F.least("ay", "by")), F.max(F.greatest("ay", "by"))).first()
    if within is not None and ends[0] is not None:
        reach = max(within.get(r.layer_key, math.inf) for r in seg.select("layer_key").distinct().collect())  # names of layers
        candidates = candidates if reach == math.inf else _in_reach(candidates, tuple(ends), reach, sphere)
    boxes = _upright(candidates) if sphere and not shapes.take(1) else None
    own = cut(sides_of(candidates)) if boxes is None else boxes
    nothing = candidates.select("candidate_id", F.lit("").alias("layer_key"), F.lit(0.0).alias("metres")).where("false")
    if ends[0] is None or not own.take(1):
        return nothing
    span = max(ends[1] - ends[0], ends[3] - ends[2], 1e-9) * (1 + 1e-9)
    nodes, sides, _ = side_tree(seg, ends[0], ends[2], span)
    if boxes is not None:
        return _nearest_of_boxes(own, seg, nodes, sides, tuple(ends))
    spots = not shapes.take(1)
    box = {"kx0": F.min(F.least("cax", "cbx")), "ky0": F.min(F.least("cay", "cby")), "kx1": F.max(F.greatest("cax", "cbx")), "ky1": F.max(F.greatest("cay", "cby"))}
    v, cs = F.min(F.struct("cax", "cay")), F.collect_list(F.struct("cax", "cay", "cbx", "cby"))  # a candidate's own sides
    points_only = "geom" not in candidates.columns or not candidates.where("geom.type <> 'Point'").take(1)  # their box is their only side
    places = own.groupBy("candidate_id").agg(v.alias("v"), *([] if points_only else [cs.alias("cs")]), *[e.alias(k) for k, e in box.items()])
    places = places.select("candidate_id", *box, F.col("v.cax").alias("vx"), F.col("v.cay").alias("vy"), *([] if points_only else ["cs"]))
    done: list[DataFrame] = []
    if feats.where(g.is_area(F.col("geom"))).take(1) or "geom" in candidates.columns and candidates.where(g.is_area(F.col("geom"))).take(1):
        done.append(cut(inside_pairs(candidates, feats).select("candidate_id", "layer_key", F.lit(0.0).alias("metres")).distinct()))
    dealt = cut(_in_groups(places))
    groups = dealt.groupBy("group").agg(*[f(c).alias(c) for f, c in ((F.min, "kx0"), (F.min, "ky0"), (F.max, "kx1"), (F.max, "ky1"))], F.min(F.struct("vx", "vy")).alias("v"))
    groups = cut(groups.select(F.col("group").alias("candidate_id"), "kx0", "ky0", "kx1", "ky1", F.col("v.vx").alias("vx"), F.col("v.vy").alias("vy")))
    names = seg.select("layer_key").distinct()  # a row for each layer there is
    leaves = near_leaves(groups, groups.select("candidate_id").join(F.broadcast(names)), nodes, sphere, spots)
    # A group meets the sides of its leaves by one key, of group and layer; all that follows stays where it is.
    # Of a leaf's sides those that are too far for the whole group don't move.
    ends_of = {f"n{v}{k}": f"{f}(a{v}, b{v})" for v in "xy" for k, f in ((0, "least"), (1, "greatest"))}
    bounds = _box_bounds("n", sphere)
    held = leaves.join(sides, ["layer_key", "depth", "cx", "cy"]).select("*", *[F.expr(e).alias(k) for k, e in ends_of.items()]).where(F.expr(f"not lone or {bounds['least']} <= best"))
    held = held.select(F.struct(F.col("candidate_id").alias("group"), "layer_key").alias("key"), "fid", "lone", "ax", "ay", "bx", "by")
    asked = dealt.join(F.broadcast(names))
    if done:
        asked = asked.join(done[0].select("candidate_id", "layer_key"), ["candidate_id", "layer_key"], "left_anti")
    asked = asked.select(F.struct("group", "layer_key").alias("key"), "candidate_id", *box, "vx", "vy", *([] if points_only else ["cs"]))
    boxed = held.select("*", *[F.expr(e).alias(k) for k, e in ends_of.items()])
    slack = "* (1 + 1e-9D) + 1e-6D"
    mine = ["key", "candidate_id", *box, "vx", "vy"]
    best = asked.select(*mine).join(boxed, "key").groupBy(*mine).agg(F.expr(f"min({_most('ax', 'ay', sphere, spots)}) {slack}").alias("best"), F.expr(f"min({bounds['slope']})").alias("flat"))
    kept = best.join(boxed, "key").where(F.expr(f"{bounds['least']} <= best or not lone and {bounds['gap']} * flat <= best"))
    theirs = ["key", "candidate_id", "fid", "ax", "ay", "bx", "by"]
    if points_only:
        near = kept.select(*theirs, *[F.col(f"v{c[2]}").alias(c) for c in ("cax", "cay", "cbx", "cby")])
    else:
        near = kept.select(*theirs).join(asked.select("key", "candidate_id", "cs"), ["key", "candidate_id"]).select(*theirs, F.inline("cs"))
    each = near.groupBy("key", "candidate_id", "fid").agg(F.min(side_gap()).alias("p"))
    length = (g.distance_sphere if sphere else g.distance_geodesic)(F.col("p.x"), F.col("p.y"), F.col("p.px"), F.col("p.py"))
    done.append(each.withColumn("m", length).groupBy("key", "candidate_id").agg(F.min("m").alias("metres")).select("candidate_id", F.col("key.layer_key").alias("layer_key"), "metres"))
    return reduce(DataFrame.unionByName, done)


#: Candidates of a group that go down the tree together, at most; and of points and upright boxes, whose group is measured as a matrix.
TOGETHER, MATRIX = 256, 2048
#: Pairs of a matrix that are measured at once.
PAIRS = 2_000_000


def _in_groups(places: DataFrame, most: int | None = None) -> DataFrame:
    """``places`` (vx, vy) with their group: a cell of a quadtree by their counts, with ``most`` places (TOGETHER) unless they are one place."""
    ends = places.agg(F.min("vx"), F.max("vx"), F.min("vy"), F.max("vy")).first()
    span = max(ends[1] - ends[0], ends[3] - ends[2], 1e-9) * (1 + 1e-9)
    done, rest, most = [], places, TOGETHER if most is None else most
    for depth in range(2, DEEPEST + 1):
        at = rest.withColumns({c: F.floor((F.col(v) - low) / span * float(SPLIT**depth)).cast("long") for c, v, low in (("cx", "vx", ends[0]), ("cy", "vy", ends[2]))})
        crowded = cut(at.groupBy("cx", "cy").agg(F.count("*").alias("n")).where(F.lit(depth < DEEPEST) & (F.col("n") > most)).select("cx", "cy"))
        last = not crowded.take(1)
        held = at if last else at.join(crowded, ["cx", "cy"], "left_anti")
        done.append(held.select(F.struct(F.lit(depth).alias("depth"), "cx", "cy").alias("group"), *places.columns))
        if last:
            break
        rest = cut(at.join(crowded, ["cx", "cy"], "left_semi").select(*places.columns))
    return reduce(DataFrame.unionByName, done)


def _upright(candidates: DataFrame) -> DataFrame | None:
    """(candidate_id, kx0 to ky1) of candidates that are all points or upright boxes, behind a checkpoint and dealt to all tasks; None if one isn't. Those without a place give no row."""
    if "geom" not in candidates.columns:
        at = candidates.where("x is not null and y is not null")
        return cut(spread(at.select("candidate_id", F.col("x").alias("kx0"), F.col("y").alias("ky0"), F.col("x").alias("kx1"), F.col("y").alias("ky1"))))
    placed = sp._with_place(candidates.select("candidate_id", "geom"), "geom").where("xmin is not null")
    slim = placed.select("candidate_id", *[F.col(c).alias(k) for c, k in (("xmin", "kx0"), ("ymin", "ky0"), ("xmax", "kx1"), ("ymax", "ky1"))], ((F.col("geom.type") == "Point") | F.col("geom_full")).alias("plain"))
    slim = cut(spread(slim))
    return None if slim.where("not plain").take(1) else slim.drop("plain")


def _nearest_of_boxes(places: DataFrame, seg: DataFrame, nodes: list[DataFrame], sides: DataFrame, ends: tuple[float, ...]) -> DataFrame:
    """(candidate_id, layer_key, metres) on the sphere of points and upright boxes (candidate_id, kx0 to ky1) to features that are points.

    A group of candidates meets the features that can be the nearest of one of them in one task, as a matrix: the nearest place of a box in the plane is the feature's own, held within the box. So what moves is each
    candidate once, and for each group the features that ``near_leaves`` and then ``_behind`` leave.
    """
    # What the places of one box that are nearest to two features may add to c * w: the box's diagonal, but only its width, times the way in longitude, where all features (``ends``) are south or north of the group.
    x0, x1, y0, y1 = (f"{e!r}D" for e in ends)
    diag = "radians(sqrt(max((kx1 - kx0) * (kx1 - kx0) + (ky1 - ky0) * (ky1 - ky0))))"
    along = f"radians(max(kx1 - kx0)) * least(1D, radians(greatest(0D, max(kx1) - {x0}, {x1} - min(kx0))))"
    apart = F.expr(f"if(min(ky0) > {y1} or max(ky1) < {y0}, least({along}, {diag}), {diag})")
    box = ["kx0", "ky0", "kx1", "ky1"]
    grouped = _in_groups(places.withColumns({"vx": F.col("kx0"), "vy": F.col("ky0")}), MATRIX)
    grouped = cut(grouped.select(F.xxhash64("group").alias("group"), "candidate_id", *box))  # groups of one number would be one
    groups = grouped.groupBy(F.col("group").alias("candidate_id")).agg(*[f(c).alias(c) for f, c in zip((F.min, F.min, F.max, F.max), box)], apart.alias("diag"), F.min(F.struct("kx0", "ky0")).alias("v"))
    groups = cut(groups.select("candidate_id", *box, "diag", F.col("v.kx0").alias("vx"), F.col("v.ky0").alias("vy")))
    names = seg.select("layer_key").distinct()  # a row for each layer there is
    leaves = near_leaves(groups, groups.select("candidate_id").join(F.broadcast(names)), nodes, True)
    ends = {f"n{v}{k}": f"a{v}" for v in "xy" for k in (0, 1)}
    met = leaves.join(sides, ["layer_key", "depth", "cx", "cy"]).select("*", *[F.expr(e).alias(k) for k, e in ends.items()])
    met = met.where(f"{_box_bounds('n', True)['least']} <= best and not {_behind('ax', 'ay', '0D')}")
    met = met.select(F.col("candidate_id").alias("group"), "layer_key", "ax", "ay")

    def measured(left: pa.Table, right: pa.Table) -> pa.Table:
        x0, y0, x1, y1 = (left.column(c).to_numpy()[:, None] for c in box)
        layers, out = right.column("layer_key").combine_chunks(), []
        fx, fy = (right.column(c).to_numpy() for c in ("ax", "ay"))
        for name in layers.unique().to_pylist() if left.num_rows else []:
            mine = pc.equal(layers, name).to_numpy(zero_copy_only=False)
            u, v = fx[mine][None], fy[mine][None]
            metres, step = np.empty(left.num_rows), max(1, PAIRS // u.size)
            for at in range(0, left.num_rows, step):
                part = slice(at, at + step)
                px, py = np.clip(u, x0[part], x1[part]), np.clip(v, y0[part], y1[part])
                h = np.sin(np.radians(v - py) / 2) ** 2 + np.cos(np.radians(py)) * np.cos(np.radians(v)) * np.sin(np.radians(u - px) / 2) ** 2
                metres[part] = 2 * g.SPHERE * np.arcsin(np.sqrt(np.clip(h.min(axis=1), 0, 1)))
            out.append(pa.table({"candidate_id": left.column("candidate_id"), "layer_key": pa.array([name] * left.num_rows, pa.string()), "metres": metres}))
        return pa.concat_tables(out) if out else pa.table({"candidate_id": left.column("candidate_id").slice(0, 0), "layer_key": pa.array([], pa.string()), "metres": pa.array([], pa.float64())})

    schema = T.StructType([T.StructField("candidate_id", places.schema["candidate_id"].dataType), T.StructField("layer_key", T.StringType()), T.StructField("metres", T.DoubleType())])
    out = grouped.groupBy("group").cogroup(met.groupBy("group")).applyInArrow(measured, schema)
    if places.groupBy("candidate_id").agg(F.count("*").alias("n")).where("n > 1").take(1):
        out = out.groupBy("candidate_id", "layer_key").agg(F.min("metres").alias("metres"))
    return out


def densities(candidates: DataFrame, layers: DataFrame, wanted: list[tuple[str, float]]) -> DataFrame:
    """(candidate_id, layer_key, radius, n): for each wanted layer and radius, in degrees, the features of any type that are at most that far from a candidate of any type; without any there is no row.

    Points around points are counted over a grid; where there are lines or polygons on either side, sides whose boxes are that near are compared, for all layers and radii at once.
    """
    spark = candidates.sparkSession
    at = F.expr("geom.parts[0][0][0]")
    asked = candidates if "geom" in candidates.columns else candidates.withColumn("geom", g.point(F.col("x"), F.col("y")))
    feats = layers.where(F.col("layer_key").isin([k for k, _ in wanted]))
    if not feats.take(1):
        return candidates.select("candidate_id", F.lit("").alias("layer_key"), F.lit(0.0).alias("radius"), F.lit(0).cast("long").alias("n")).where("false")
    spots = feats.where("geom.type = 'Point'").select("layer_key", at["x"].alias("x"), at["y"].alias("y"))
    points = asked.where("geom.type = 'Point'").select("candidate_id", at["x"].alias("x"), at["y"].alias("y")).where("x is not null")
    counts = [sp.density_count(points, spots.where(F.col("layer_key") == k), r).where("n > 0").select("candidate_id", F.lit(k).alias("layer_key"), F.lit(r).alias("radius"), "n") for k, r in wanted]
    shapes = feats.where("geom.type <> 'Point'")
    areas = asked.where("geom.type <> 'Point'")
    radii = F.broadcast(spark.createDataFrame(wanted, "layer_key string, radius double"))  # of the rulesets
    box = lambda p: [F.expr(f"{f}({p}a{v}, {p}b{v})").alias(f"{v}{end}") for f, end in (("least", "min"), ("greatest", "max")) for v in ("x", "y")]
    for some, others, there in ((asked, shapes, shapes.take(1)), (areas, feats.where("geom.type = 'Point'"), areas.take(1))):
        if not there:
            continue
        own = sides_of(some).select("*", *box("c")).join(radii)
        theirs = segments(others).select("*", *box(""))
        met = sp.bbox_pairs(own, theirs, F.col("radius"), ["layer_key"]).where(side_gap()["flat"] <= F.col("radius")).select("candidate_id", "layer_key", "radius", "fid")
        held = inside_pairs(some, others).join(radii, "layer_key").select("candidate_id", "layer_key", "radius", "fid")
        counts.append(met.unionByName(held).distinct().groupBy("candidate_id", "layer_key", "radius").agg(F.count("*").alias("n")))
    return reduce(DataFrame.unionByName, counts).groupBy("candidate_id", "layer_key", "radius").agg(F.sum("n").alias("n"))


def features_within(candidates: DataFrame, layer: DataFrame, radius_deg: float) -> DataFrame:
    """(candidate_id, n): features of any type at most the radius, in degrees, from a candidate of any type; candidates without any have 0."""
    found = densities(candidates, layer.withColumn("layer_key", F.lit("")), [("", radius_deg)])
    return candidates.select("candidate_id").join(found.select("candidate_id", "n"), "candidate_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def overlap_share(candidates: DataFrame, layer: DataFrame) -> DataFrame:
    """(candidate_id, layer_key, share): the greatest share of a candidate's area (candidate_id, geom) that a feature covers.

    A candidate without area counts 1 where it meets a feature; touching is a share of 0; candidates that meet none give no row.
    """
    right = layer.select(F.struct("layer_key", "fid").alias("b_id"), "geom")
    met = sp.overlaps(candidates.select(F.col("candidate_id").alias("a_id"), "geom"), right)
    share = F.when(F.col("a_area") > 0, F.col("overlap") / F.col("a_area")).otherwise(1.0)
    return met.groupBy(F.col("a_id").alias("candidate_id"), F.col("b_id.layer_key").alias("layer_key")).agg(F.max(share).alias("share"))


def terrain_elevation(candidates: DataFrame, dem: DataFrame, size: float = 0.01, x0: float = 36.0, y0: float = 33.0) -> DataFrame:
    """(candidate_id, elevation) of the grid cell (cell_x, cell_y) that holds a candidate's place; outside the grid null."""
    at = candidates.select("candidate_id", sp.cell(F.col("x") - x0, size).alias("cell_x"), sp.cell(F.col("y") - y0, size).alias("cell_y"))
    return at.join(dem, ["cell_x", "cell_y"], "left").select("candidate_id", "elevation")


def _farthest(rows: list) -> dict[str, float]:
    """For each layer the metres from which on its distance criteria (type, layer, curve, units, bounds) score the same; layers whose curves aren't known, or lack a bound, are left out."""
    needed = {"linear_decreasing": ("ideal", "acceptable", "unacceptable"), "linear_increasing": ("unacceptable", "acceptable", "ideal"), "bell": ("min", "ideal", "max")}
    out: dict[str, float] = {}
    for r in rows:
        if r.type == "distance_to_layer" and r.layer:
            ends = [r.bounds[k] for k in needed[r.curve]] if r.curve in needed and r.bounds else [None]
            metres = math.inf if None in ends else max(ends) * (1000.0 if r.units == "km" else 1.0)
            out[r.layer] = max(metres, out.get(r.layer, 0.0))
    return {k: v for k, v in out.items() if v < math.inf}


def score_criteria(candidates: DataFrame, layers: DataFrame, criteria: DataFrame, dem: DataFrame | None = None, sphere: bool = False, scores_only: bool = False) -> DataFrame:
    """(candidate_id, ruleset, criterion_no, name, weight, score, value, why, description): each candidate (candidate_id, x, y, geom) under each criterion.

    A layer that isn't there, terrain that isn't measured and places outside the grid score a neutral 50; an unknown criterion type scores 0. Distance, density
    and terrain scores are rounded to 1 decimal. Criteria are few and are broadcast. With ``scores_only``, values and reasons aren't asked for: distances beyond the last bound of all of a layer's curves, which score
    the same however great they are, may come as infinite.
    """
    rows = criteria.select("type", "layer", "radius_km", "curve", "units", "bounds").distinct().collect()  # metadata of rulesets
    by = lambda kind: sorted({r.layer for r in rows if r.type == kind and r.layer})
    names = ["candidate_id", "type", "layer", "radius_km", "value"]
    found = []
    dist = nearest_distance(candidates, layers, by("distance_to_layer"), sphere=sphere, within=_farthest(rows) if scores_only else None)
    found.append(dist.select("candidate_id", F.lit("distance_to_layer").alias("type"), F.col("layer_key").alias("layer"), F.lit(None).cast("double").alias("radius_km"), F.col("metres").alias("value")))
    share = overlap_share(candidates, layers.where(F.col("layer_key").isin(by("overlap_with_layer"))))
    found.append(share.select("candidate_id", F.lit("overlap_with_layer").alias("type"), F.col("layer_key").alias("layer"), F.lit(None).cast("double").alias("radius_km"), F.col("share").alias("value")))
    radii = {(r.layer, r.radius_km / 111): r.radius_km for r in rows if r.type == "density_count" and r.layer}
    if radii:
        km = F.create_map(*[F.lit(x) for (_, deg), r in radii.items() for x in (deg, r)])
        n = densities(candidates, layers, sorted(radii))
        found.append(n.select("candidate_id", F.lit("density_count").alias("type"), F.col("layer_key").alias("layer"), km[F.col("radius")].alias("radius_km"), F.col("n").cast("double").alias("value")))
    if dem is not None:
        e = terrain_elevation(candidates, dem)
        found.append(e.select("candidate_id", F.lit("terrain_stat").alias("type"), F.lit(None).cast("string").alias("layer"), F.lit(None).cast("double").alias("radius_km"), F.col("elevation").alias("value")))
    # One row of measures for each candidate, so that candidates meet criteria without a further join on them.
    slot = F.concat_ws("|", "type", F.coalesce("layer", F.lit("")), F.when(F.col("radius_km").isNotNull(), F.format_string("%.3f", F.col("radius_km"))).otherwise(""))
    measured = reduce(DataFrame.unionByName, [f.select(*names) for f in found]).where("value is not null")
    maps = measured.groupBy("candidate_id").agg(F.map_from_entries(F.collect_list(F.struct(slot.alias("k"), "value"))).alias("m"))
    there = layers.agg(F.collect_set("layer_key").alias("there"))  # names of layers
    crit = F.broadcast(criteria.join(there))
    every = candidates.select("candidate_id").join(dealt(maps), "candidate_id", "left").join(crit)  # dealt by candidate, so that sums by it move nothing
    kind = F.col("type")
    key = F.concat_ws("|", kind, F.when(kind == "terrain_stat", "").otherwise(F.col("layer")), F.when(kind == "density_count", F.format_string("%.3f", F.col("radius_km"))).otherwise(""))
    raw = F.try_element_at("m", key)
    known_layer = F.coalesce(F.array_contains("there", F.col("layer")), F.lit(False))
    elevation = (kind == "terrain_stat") & (F.col("stat") == "elevation_meters")
    value = (
        F.when(kind == "distance_to_layer", F.coalesce(raw, F.lit(float("inf"))) / F.when(F.col("units") == "km", 1000.0).otherwise(1.0))
        .when(kind == "density_count", F.coalesce(raw, F.lit(0.0)))
        .when(elevation | (kind == "overlap_with_layer"), raw)
    )
    available = F.when(kind == "terrain_stat", elevation & raw.isNotNull()).otherwise(known_layer)
    held = every.withColumns({"value": F.when(available, value), "available": available})
    s, v = F.col("scores"), F.col("value")
    curve = sc.half_up(sc.curve_score(v, kind, F.col("curve"), F.col("bounds")))
    score = (
        F.when(~kind.isin("distance_to_layer", "overlap_with_layer", "density_count", "terrain_stat"), 0.0)
        .when(~F.col("available"), 50.0)
        .when(kind == "overlap_with_layer", F.when(v.isNull(), s["no_overlap"]).when(v >= 0.95, s["full_overlap"]).otherwise(s["partial_overlap"]))
        .otherwise(curve)
    )
    why = sc.explain(kind, F.col("available"), v, F.col("layer"), F.col("units"), F.col("radius_km"), F.col("stat"))
    return held.select("candidate_id", "ruleset", "criterion_no", "name", "weight", "recommended", "conditional", score.alias("score"), "value", why.alias("why"), "description")


def site_score(scored: DataFrame) -> DataFrame:
    """(candidate_id, ruleset, score, verdict): the weighted mean, unrounded, and what it means."""
    out = scored.groupBy("candidate_id", "ruleset").agg((F.sum(F.col("score") * F.col("weight")) / F.greatest(F.sum("weight"), F.lit(1e-9))).alias("score"), F.first("recommended").alias("r"), F.first("conditional").alias("c"))
    return out.select("candidate_id", "ruleset", "score", sc.verdict(F.col("score"), F.col("r"), F.col("c")).alias("verdict"))


def weakest_criteria(scored: DataFrame, n: int = 3) -> DataFrame:
    w = Window.partitionBy("candidate_id", "ruleset").orderBy("score", "criterion_no")
    return scored.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n)


def _advice(score: Column, name: Column, description: Column) -> Column:
    return F.concat(F.lit("Improve "), name, F.lit(" (now "), F.format_string("%.0f", F.floor(score + 0.5).cast("double")), F.lit("/100): "), F.when(description != "", description).otherwise("see its details"))


def site_recommendations(scored: DataFrame) -> DataFrame:
    """(candidate_id, ruleset, recommendations): what to improve, out of the three weakest criteria those below 60."""
    text: Column = F.when(F.col("score") < 60, F.struct("nth", _advice(F.col("score"), F.col("name"), F.col("description")).alias("text")))
    return weakest_criteria(scored).groupBy("candidate_id", "ruleset").agg(F.transform(F.array_sort(F.collect_list(text)), lambda s: s["text"]).alias("recommendations"))


def score_sites(candidates: DataFrame, layers: DataFrame, criteria: DataFrame, dem: DataFrame | None = None, sphere: bool = False) -> DataFrame:
    """(candidate_id, ruleset, score, verdict, recommendations) of every candidate under every ruleset.

    A candidate's scores are columns by the criterion's number, so that rows of candidates and criteria, many times the candidates, are neither kept nor moved.
    """
    scored = score_criteria(candidates, layers, criteria, dem, sphere)
    numbers = sorted(r.criterion_no for r in criteria.select("criterion_no").distinct().collect())  # metadata of rulesets
    total = F.sum(F.col("score") * F.col("weight")) / F.greatest(F.sum("weight"), F.lit(1e-9))
    by = scored.groupBy("candidate_id", "ruleset").agg(total.alias("score"), F.first("recommended").alias("r"), F.first("conditional").alias("c"), *[F.max(F.when(F.col("criterion_no") == k, F.col("score"))).alias(f"s{k}") for k in numbers])
    said = F.broadcast(criteria.groupBy("ruleset").agg(F.map_from_entries(F.collect_list(F.struct("criterion_no", F.struct("name", "description")))).alias("said")))
    low = F.slice(F.array_sort(F.filter(F.array(*[F.struct(F.col(f"s{k}").alias("score"), F.lit(k).alias("no")) for k in numbers]), lambda s: F.map_contains_key("said", s["no"]))), 1, 3)
    advice = F.transform(F.filter(low, lambda s: s["score"] < 60), lambda s: _advice(s["score"], F.col("said")[s["no"]]["name"], F.col("said")[s["no"]]["description"]))
    return by.join(said, "ruleset").select("candidate_id", "ruleset", "score", sc.verdict(F.col("score"), F.col("r"), F.col("c")).alias("verdict"), advice.alias("recommendations"))
