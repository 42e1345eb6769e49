"""Skeletons, meshes, crop cameras and packet poses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.camera import project, project_bend, project_flat, project_pixel
from ..functions.rotation import matrix_to_quat, quat_mul, quat_to_matrix, unscaled_quat
from ..functions.vectors import add, let, mat_mul, mat_vec, norm, scaled, sub, total, transpose, vec
from ..rules import JOINT_PARENTS
from .blocks import FRAME_BLOCK, Scan, block_scan


def _chains(parents: Sequence[int]) -> list[list[int]]:
    """Joints from the root down to each joint; parents precede children."""
    chains: list[list[int]] = []
    for j, p in enumerate(parents):
        chains.append([j] if p < 0 else [*chains[p], j])
    return chains


def forward_kinematics(df: DataFrame, local: str, offsets: str | None = None,
                       parents: Sequence[int] = JOINT_PARENTS) -> DataFrame:
    """One row per joint: ``joint``, its ``world`` quaternion and, given offsets, its ``position``.

    ``local`` holds a quaternion per joint relative to its parent, ``offsets`` its place in the parent's frame; both
    columns go, the others stay. Each row walks from the root down to its joint, so a tree of any width costs one
    small piece of generated code per level, and no row meets another. A joint without four finite numbers leaves itself
    and all below it null.
    """
    chains = _chains(parents)
    depth = max(map(len, chains))
    links = F.array(*[F.struct(F.lit(j).alias("joint"), *[F.lit(c[k] if k < len(c) else -1).alias(f"__c{k}") for k in range(depth)])
                      for j, c in enumerate(chains)])
    kept = [c for c in df.columns if c not in (local, offsets)]
    rows = df.select(*kept, F.col(local).alias("__local"), F.col(offsets or local).alias("__offsets"), F.inline(links))

    def taken(prefix: str, source: str, n: int, level: int) -> dict[str, Column]:
        item = F.get(source, F.col(f"__c{level}"))
        return {f"{prefix}{i}_{level}": F.coalesce(F.get(item, F.lit(i)), F.lit(float("nan"))) for i in range(n)}

    def value(prefix: str, n: int, level: int) -> Column:
        return F.array(*[f"{prefix}{i}_{level}" for i in range(n)])

    # NaN stands for a missing number on the way: without null checks a level's code stays short enough to be compiled.
    rows = rows.withColumns(taken("__w", "__local", 4, 0) | (taken("__p", "__offsets", 3, 0) if offsets else {}))
    for level in range(1, depth):
        rows = rows.withColumns(taken("__q", "__local", 4, level) | (taken("__o", "__offsets", 3, level) if offsets else {}))
        above = value("__w", 4, level - 1)
        results = [("__w", 4, quat_mul(above, value("__q", 4, level)))]
        if offsets:
            results.append(("__p", 3, add(value("__p", 3, level - 1), mat_vec(quat_to_matrix(above), value("__o", 3, level)))))
        rows = rows.withColumns({
            f"{prefix}{i}_{level}": F.when(F.col(f"__c{level}") < 0, F.col(f"{prefix}{i}_{level - 1}")).otherwise(v.getItem(i))
            for prefix, n, v in results for i in range(n)})

    def known(prefix: str, n: int) -> Column:
        v = [F.col(f"{prefix}{i}_{depth - 1}") for i in range(n)]
        return F.when(F.abs(total(v)) < float("inf"), F.array(*v))  # NaN is above infinity

    found = [known("__w", 4).alias("world")] + ([known("__p", 3).alias("position")] if offsets else [])
    return rows.select(*kept, "joint", *found)


def bone_lengths(joints: DataFrame, keys: Sequence[str], tree: DataFrame) -> DataFrame:
    """Length of each bone per frame; ``joints(keys, frame, joint, p)``, ``tree(joint, parent)``.

    The tree has a fixed 16 rows, so it is broadcast.
    """
    child = joints.join(F.broadcast(tree.filter(F.col("parent") >= 0)), "joint")
    parent = joints.select(*keys, "frame", F.col("joint").alias("parent"), F.col("p").alias("__pp"))
    return child.join(parent, [*keys, "frame", "parent"]).select(
        *keys, "frame", "joint", norm(sub(F.col("p"), F.col("__pp"))).alias("length"))


def bone_length_deviation(lengths: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Largest absolute difference to the first frame, per bone.

    The largest deviation is reached at the shortest or longest sample.
    """
    g = lengths.groupBy(*keys, "joint").agg(
        F.min_by("length", "frame").alias("__first"), F.min("length").alias("__lo"), F.max("length").alias("__hi"))
    return g.select(*keys, "joint", F.greatest(F.col("__hi") - F.col("__first"), F.col("__first") - F.col("__lo"))
                    .alias("max_deviation"))


def top_weights(weights: DataFrame, keys: Sequence[str], k: int = 4, extra: Sequence[str] = ()) -> DataFrame:
    """The k largest weights per vertex (ties by joint), renormalised; the kept mass stays.

    The pick is an aggregate of at most k candidates per map task and vertex when the
    engine plans the rank limit, so a huge group never sorts as a whole.
    """
    w = Window.partitionBy(*keys).orderBy(F.col("weight").desc(), "joint", *extra)
    ranked = weights.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    kept = F.sum("weight").over(Window.partitionBy(*keys))
    return ranked.withColumn("kept_mass", kept).withColumn("renormalised", F.try_divide("weight", "kept_mass"))


def retained_mass(top: DataFrame, totals: DataFrame, vertex_keys: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Kept and dropped weight mass per side."""
    per = top.groupBy(*keys, *vertex_keys).agg(F.sum("weight").alias("__kept")).join(
        totals.select(*keys, *vertex_keys, "total"), [*keys, *vertex_keys])
    share = F.try_divide("__kept", "total")
    return per.groupBy(*keys).agg(F.min(share).alias("kept_min"), F.avg(share).alias("kept_mean"),
                                  F.max(1 - share).alias("dropped_max"))


def bounds(points: DataFrame, keys: Sequence[str], p: str = "p") -> DataFrame:
    axes = [(a, F.col(p).getItem(i)) for i, a in enumerate("xyz")]
    return points.groupBy(*keys).agg(*[F.min(c).alias(f"{a}_min") for a, c in axes],
                                     *[F.max(c).alias(f"{a}_max") for a, c in axes])


def vertex_normals(faces: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Unit normal per vertex from face rows (keys, a, b, c, pa, pb, pc)."""
    e1, e2 = sub(F.col("pb"), F.col("pa")), sub(F.col("pc"), F.col("pa"))
    n = let(F.array(e1, e2), lambda e: F.array(*[
        e.getItem(0).getItem((i + 1) % 3) * e.getItem(1).getItem((i + 2) % 3)
        - e.getItem(0).getItem((i + 2) % 3) * e.getItem(1).getItem((i + 1) % 3) for i in range(3)]))
    corners = faces.select(*keys, n.alias("n"), F.explode(F.array("a", "b", "c")).alias("vertex"))
    s = corners.groupBy(*keys, "vertex").agg(*[F.sum(F.col("n").getItem(i)).alias(f"n{i}") for i in range(3)])
    length = F.sqrt(F.col("n0") ** 2 + F.col("n1") ** 2 + F.col("n2") ** 2)
    return s.select(*keys, "vertex", *[F.try_divide(F.col(f"n{i}"), length).alias(f"n{'xyz'[i]}") for i in range(3)])


def mesh_edges(faces: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Undirected edges with their use count; one is a boundary, above two is nonmanifold."""
    pairs = F.array(*[F.struct(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))
                      for a, b in (("a", "b"), ("b", "c"), ("c", "a"))])
    return faces.select(*keys, F.inline(pairs)).groupBy(*keys, "u", "v").agg(F.count(F.lit(1)).alias("uses"))


def mesh_audit(faces: DataFrame, keys: Sequence[str]) -> DataFrame:
    edges = mesh_edges(faces, keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("edges"), F.count_if(F.col("uses") == 1).alias("boundary_edges"),
        F.count_if(F.col("uses") > 2).alias("nonmanifold_edges"))
    a, b, c = (F.col(n) for n in ("pa", "pb", "pc"))
    volume = (a.getItem(0) * (b.getItem(1) * c.getItem(2) - b.getItem(2) * c.getItem(1))
              + a.getItem(1) * (b.getItem(2) * c.getItem(0) - b.getItem(0) * c.getItem(2))
              + a.getItem(2) * (b.getItem(0) * c.getItem(1) - b.getItem(1) * c.getItem(0))) / 6
    vol = faces.groupBy(*keys).agg(F.count(F.lit(1)).alias("faces"), F.sum(volume).alias("signed_volume"))
    return edges.join(vol, list(keys))


def least_squares_translation(rays: DataFrame, keys: Sequence[str], min_determinant: float = 1e-9) -> DataFrame:
    """Translation that best puts points on their viewing rays.

    ``rays(keys, px, py, pz, rx, ry)``; the 3x3 normal equations are sums, solved in closed
    form. Decimal columns are summed exactly, so that the order of the rows does not show.
    Reasons: ``degenerate`` without full rank, ``behind_camera`` for a nonpositive depth.
    """
    rx, ry, px, py, pz = (F.col(n) for n in ("rx", "ry", "px", "py", "pz"))
    tx, ty = rx * pz - px, ry * pz - py
    sums = {"sx": rx, "sy": ry, "sr": rx * rx + ry * ry, "bx": tx, "by": ty, "bz": -(rx * tx + ry * ty)}
    s = rays.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(v).cast("double").alias(c) for c, v in sums.items()],
        F.min(pz).cast("double").alias("nearest"))
    n, sx, sy, sr, bx, by, bz = (F.col(c) for c in ("n", "sx", "sy", "sr", "bx", "by", "bz"))
    det = n * sr - sx * sx - sy * sy
    tz = F.when((n >= 2) & (det > min_determinant), (n * bz + sx * bx + sy * by) / det)
    solved = s.withColumn("tz", tz).withColumn("tx", (bx + sx * F.col("tz")) / n).withColumn("ty", (by + sy * F.col("tz")) / n)
    reason = F.when(F.col("tz").isNull(), "degenerate").when(F.col("nearest") + F.col("tz") <= 0, "behind_camera")
    return solved.select(*keys, "tx", "ty", "tz", reason.alias("reason"))


# Fixed value: camera axes to engine axes, row-major, a reflection.
CAMERA_TO_ENGINE = (0.0, 0.0, 1.0, 1.0, 0.0, 0.0, 0.0, -1.0, 0.0)
FLIP_NORMAL = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, -1.0)


def packet_pose(rotation: Column, translation: Column) -> Column:
    """``struct<position_cm, rotation_quat>`` of a camera pose, proper rotation kept."""
    turned = mat_mul(let(mat_mul(vec(*CAMERA_TO_ENGINE), rotation), lambda m: m), vec(*FLIP_NORMAL))
    return F.struct(scaled(mat_vec(vec(*CAMERA_TO_ENGINE), translation), 100.0).alias("position_cm"),
                    let(turned, matrix_to_quat).alias("rotation_quat"))


def packet_corners(pose: Column, width: Column, height: Column) -> Column:
    """Camera-space corners (metres) of a stored packet pose."""
    local = F.array(*[F.array(width * sx, height * sy, F.lit(0.0)) for sx, sy in CORNERS])
    back = transpose(vec(*CAMERA_TO_ENGINE))
    return let(quat_to_matrix(pose.getField("rotation_quat")), lambda r: F.transform(local, lambda c: mat_vec(
        back, add(mat_vec(r, c), scaled(pose.getField("position_cm"), 0.01)))))


def corner_round_trip(rotation: Column, translation: Column, width: Column, height: Column, intrinsics: Column,
                      distortion: Column) -> Column:
    """Largest pixel difference between direct and stored corners; must stay below 1e-6."""
    direct = F.transform(F.array(*[F.array(width * sx, height * sy, F.lit(0.0)) for sx, sy in CORNERS]),
                         lambda c: add(mat_vec(rotation, c), translation))
    stored = let(packet_pose(rotation, translation), lambda p: packet_corners(p, width, height))

    def gap(a, b):
        return let(F.array(project(a, intrinsics, distortion), project(b, intrinsics, distortion)),
                   lambda q: norm(sub(q.getItem(0), q.getItem(1), 2), 2))

    return F.array_max(F.zip_with(direct, stored, gap))


CORNERS = ((-0.5, -0.5), (0.5, -0.5), (0.5, 0.5), (-0.5, 0.5))


def packet_round_trip(df: DataFrame, rotation: Column, translation: Column, width: Column, height: Column, intrinsics: Column,
                      distortion: Column) -> DataFrame:
    """``df`` with the stored pose of :func:`packet_pose`, ``position_cm`` and ``rotation_quat``, and ``corner_gap``, the
    value of :func:`corner_round_trip`.

    It walks in steps of scalar columns, each short enough to be compiled; as one expression the
    steps are nested lambdas, which are interpreted.
    """
    rows, kept = df, df.columns

    def value(name: str, n: int) -> Column:
        return F.array(*[F.col(f"__{name}{i}") for i in range(n)])

    def step(**found: list[Column]) -> None:
        nonlocal rows
        rows = rows.withColumns({f"__{name}{i}": v for name, columns in found.items() for i, v in enumerate(columns)})

    def items(v: Column, n: int) -> list[Column]:
        return [v.getItem(i) for i in range(n)]

    to_engine = vec(*CAMERA_TO_ENGINE)
    step(r=items(rotation, 9), t=items(translation, 3))
    step(a=items(mat_mul(to_engine, value("r", 9)), 9), p=items(scaled(mat_vec(to_engine, value("t", 3)), 100.0), 3))
    step(m=items(mat_mul(value("a", 9), vec(*FLIP_NORMAL)), 9))
    step(raw=unscaled_quat(value("m", 9)))
    step(inverse=[F.lit(1.0) / norm(value("raw", 4), 4)])
    step(unit=items(scaled(value("raw", 4), F.col("__inverse0"), 4), 4))
    step(q=items(scaled(value("unit", 4), F.when(F.col("__unit3") < 0, -1.0).otherwise(1.0), 4), 4))
    step(s=items(quat_to_matrix(value("q", 4)), 9), w=items(scaled(value("p", 3), 0.01), 3))

    corners = [F.array(width * sx, height * sy, F.lit(0.0)) for sx, sy in CORNERS]
    step(**{f"direct{c}_": items(add(mat_vec(value("r", 9), at), value("t", 3)), 3) for c, at in enumerate(corners)},
         **{f"turned{c}_": items(add(mat_vec(value("s", 9), at), value("w", 3)), 3) for c, at in enumerate(corners)})
    step(**{f"stored{c}_": items(mat_vec(transpose(to_engine), value(f"turned{c}_", 3)), 3) for c in range(4)})

    ends = [f"{kind}{c}_" for c in range(4) for kind in ("direct", "stored")]
    step(**{f"flat{e}": project_flat(value(e, 3), distortion) for e in ends})
    step(**{f"bend{e}": project_bend(value(f"flat{e}", 2), distortion) for e in ends})
    step(**{f"pixel{e}": project_pixel(value(f"flat{e}", 2), value(f"bend{e}", 2), intrinsics, distortion) for e in ends})
    gaps = [norm(sub(value(f"pixeldirect{c}_", 2), value(f"pixelstored{c}_", 2), 2), 2) for c in range(4)]
    return rows.select(*kept, value("p", 3).alias("position_cm"), value("q", 4).alias("rotation_quat"),
                       F.greatest(*gaps).alias("corner_gap"))


def sign_continuous_joints(df: DataFrame, keys: Sequence[str], quats: str, frame: str = "frame",
                           width: int = FRAME_BLOCK) -> DataFrame:
    """Long form (keys, frame, joint, quat, prev) of joint quaternions for sign continuity."""
    long = df.select(*keys, frame, F.posexplode(quats).alias("joint", "quat"))
    return block_scan(long, [*keys, "joint"], [frame], [Scan("prev", F.col("quat"), "prev")], width)
