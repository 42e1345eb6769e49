"""Timeline arithmetic and camera geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import all_numbers, dot, is_number, let, norm, parts, sub, vec


# ---- timeline -----------------------------------------------------------

def frame_time(frame: Column, fps) -> Column:
    return frame / fps


def timestamp_ms(frame: Column, fps) -> Column:
    """Integer milliseconds, ties to even."""
    return F.bround(frame / fps * 1000).cast("long")


def source_frame(time_seconds: Column, fps, offset_seconds) -> Column:
    """Nearest frame of another view; halves go up, also below zero."""
    return F.floor((time_seconds + offset_seconds) * fps + 0.5).cast("long")


# ---- projection ---------------------------------------------------------

UNSUPPORTED_DISTORTION = "unsupported_distortion"
DISTORTION_LENGTHS = (4, 5, 8, 12, 14)
EVALUATED_LENGTHS = (4, 5, 8)


def project(point: Column, intrinsics: Column, distortion: Column) -> Column:
    """Pinhole projection with radial/tangential terms for 4, 5 or 8 coefficients.

    ``intrinsics`` is (fx, fy, cx, cy). Missing distortion means an ideal pinhole.
    Longer models give a null pixel; see :func:`projection_reason`.
    """
    x, y, z = parts(point)
    fx, fy, cx, cy = parts(intrinsics, 4)
    k = _coefficients(distortion)

    def bend(n):
        u, v, r2 = parts(n)
        radial = ((1 + r2 * (k[0] + r2 * (k[1] + r2 * k[4])))
                  / (1 + r2 * (k[5] + r2 * (k[6] + r2 * k[7]))))
        return let(radial, lambda m: F.array(
            fx * (u * m + 2 * k[2] * u * v + k[3] * (r2 + 2 * u * u)) + cx,
            fy * (v * m + k[2] * (r2 + 2 * v * v) + 2 * k[3] * u * v) + cy))

    normal = let(F.array(x / z, y / z), lambda p: F.array(
        p.getItem(0), p.getItem(1), p.getItem(0) * p.getItem(0) + p.getItem(1) * p.getItem(1)))
    return F.when(projection_reason(point, distortion).isNull(), let(normal, bend))


# The projection in three steps, for callers that keep each in columns of its own.

def project_flat(point: Column, distortion: Column) -> list[Column]:
    """Normalised image place of a point that can be projected."""
    x, y, z = parts(point)
    depth = F.when(projection_reason(point, distortion).isNull(), z)
    return [x / depth, y / depth]


def project_bend(flat: Column, distortion: Column) -> list[Column]:
    """(squared radius, radial factor) of a normalised place."""
    u, v = parts(flat, 2)
    r2 = u * u + v * v
    k = _coefficients(distortion)
    return [r2, (1 + r2 * (k[0] + r2 * (k[1] + r2 * k[4]))) / (1 + r2 * (k[5] + r2 * (k[6] + r2 * k[7])))]


def project_pixel(flat: Column, bend: Column, intrinsics: Column, distortion: Column) -> list[Column]:
    (u, v), (r2, m), (fx, fy, cx, cy) = parts(flat, 2), parts(bend, 2), parts(intrinsics, 4)
    k = _coefficients(distortion)
    return [fx * (u * m + 2 * k[2] * u * v + k[3] * (r2 + 2 * u * u)) + cx,
            fy * (v * m + k[2] * (r2 + 2 * v * v) + 2 * k[3] * u * v) + cy]


def _coefficients(distortion: Column) -> list[Column]:
    return [F.coalesce(F.get(distortion, F.lit(i)), F.lit(0.0)) for i in range(8)]


def projection_reason(point: Column, distortion: Column) -> Column:
    return (F.when(~F.coalesce(point.getItem(2) > 0, F.lit(False)), "behind_camera")
            .when(distortion.isNotNull() & ~F.size(distortion).isin(*EVALUATED_LENGTHS),
                  UNSUPPORTED_DISTORTION))


def camera_valid(fx: Column, fy: Column, cx: Column, cy: Column, distortion: Column) -> Column:
    return (is_number(fx) & is_number(fy) & is_number(cx) & is_number(cy)
            & F.coalesce((fx > 0) & (fy > 0), F.lit(False))
            & all_numbers(distortion) & F.size(distortion).isin(*DISTORTION_LENGTHS))


def rigid_transform_valid(m: Column, tolerance: float = 1e-5) -> Column:
    """Row-major 4x4 with a proper rotation block and last row (0, 0, 0, 1)."""
    g = m.getItem
    rows = [[g(4 * r + c) for c in range(3)] for r in range(3)]

    def row_dot(a, b):
        return sum((rows[a][c] * rows[b][c] for c in range(1, 3)), rows[a][0] * rows[b][0])

    orthogonal = F.lit(True)
    for a in range(3):
        for b in range(a, 3):
            orthogonal &= F.abs(row_dot(a, b) - (1.0 if a == b else 0.0)) <= tolerance
    det = (rows[0][0] * (rows[1][1] * rows[2][2] - rows[1][2] * rows[2][1])
           - rows[0][1] * (rows[1][0] * rows[2][2] - rows[1][2] * rows[2][0])
           + rows[0][2] * (rows[1][0] * rows[2][1] - rows[1][1] * rows[2][0]))
    last = (g(12) == 0) & (g(13) == 0) & (g(14) == 0) & (g(15) == 1)
    return F.coalesce(all_numbers(m) & (F.size(m) == 16) & orthogonal
                      & (F.abs(det - 1) <= tolerance) & last, F.lit(False))


def rectified_focal(fx: Column, fy: Column) -> Column:
    """One focal for unequal calibrated axes; callers keep the source pair."""
    return F.when(fx == fy, fx).otherwise(F.sqrt(fx * fy))


# Image spaces an observation may declare.
IMAGE_SPACES = ("original_distorted", "undistorted_same_intrinsics", "undistorted_rectified_intrinsics")


def camera_status(calibrated: Column, intrinsics_ok: Column, distortion: Column,
                  image_space: Column) -> Column:
    """``unobservable`` camera, a usable one, or the reason it is rejected."""
    return (F.when(~F.coalesce(calibrated, F.lit(False)), "unobservable")
            .when(~F.coalesce(intrinsics_ok, F.lit(False)), "invalid_intrinsics")
            .when(distortion.isNull(), "missing_distortion")
            .when(~(F.size(distortion).isin(*DISTORTION_LENGTHS) & all_numbers(distortion)),
                  UNSUPPORTED_DISTORTION)
            .when(~F.coalesce(image_space.isin(*IMAGE_SPACES), F.lit(False)), "missing_image_space")
            .otherwise("calibrated"))


def effective_distortion(distortion: Column, image_space: Column) -> Column:
    """Pixels that are already undistorted are projected without lens terms."""
    return F.when(image_space.startswith("undistorted_"), F.transform(distortion, lambda _: F.lit(0.0))) \
        .otherwise(distortion)


# ---- crop cameras -------------------------------------------------------

def weak_scale(weak: Column, crop_translation: Column, crop_focal: Column, crop_size: Column) -> Column:
    """(scale, tx, ty), from the weak camera or from an older crop translation."""
    tz = crop_translation.getItem(2)
    legacy = F.when((tz > 0) & (crop_focal > 0) & (crop_size > 0),
                    F.array(2 * crop_focal / (crop_size * tz),
                            crop_translation.getItem(0), crop_translation.getItem(1)))
    return F.coalesce(weak, legacy)


def crop_translation(weak: Column, side: Column, box: Column, box_size: Column,
                     intrinsics: Column) -> Column:
    """Full-frame translation of a crop prediction under a known camera."""
    fx, _, cx, cy = parts(intrinsics, 4)
    s, tx, ty = parts(weak)
    span = box_size * s + 1e-9
    centre_x, centre_y = (box.getItem(0) + box.getItem(2)) / 2, (box.getItem(1) + box.getItem(3)) / 2
    signed = F.when(side == "left", -tx).otherwise(tx)
    return F.array(2 * (centre_x - cx) / span + signed, 2 * (centre_y - cy) / span + ty, 2 * fx / span)


def crop_affine(weak: Column, side: Column, box: Column, box_size: Column, wrist: Column,
                width: Column, height: Column, model_scale=1.0) -> Column:
    """``struct<constant, slope_z>`` with wrist(f) = constant + f * (0, 0, slope_z)."""
    s, tx, ty = parts(weak)
    span = box_size * s
    centre_x, centre_y = (box.getItem(0) + box.getItem(2)) / 2, (box.getItem(1) + box.getItem(3)) / 2
    signed = F.when(side == "left", -tx).otherwise(tx)
    constant = F.array(
        wrist.getItem(0) + model_scale * (2 * (centre_x - width / 2) / span + signed),
        wrist.getItem(1) + model_scale * (2 * (centre_y - height / 2) / span + ty),
        wrist.getItem(2))
    ok = (s > 0) & (box_size > 0) & (box.getItem(2) > box.getItem(0)) & (box.getItem(3) > box.getItem(1)) \
        & (width > 0) & (height > 0)
    return F.when(ok, F.struct(constant.alias("constant"), (model_scale * 2.0 / span).alias("slope_z")))


# ---- planar and ray geometry -------------------------------------------

def homography_error(h: Column, source: Column, target: Column) -> Column:
    """Pixel distance after a 3x3 homography; null when the point is at infinity."""
    x, y = source.getItem(0), source.getItem(1)
    g = h.getItem
    w = g(6) * x + g(7) * y + g(8)
    u = (g(0) * x + g(1) * y + g(2)) / w - target.getItem(0)
    v = (g(3) * x + g(4) * y + g(5)) / w - target.getItem(1)
    return F.when(F.abs(w) >= 1e-9, F.sqrt(u * u + v * v))


def ray_plane_length(ray_a: Column, ray_b: Column, normal: Column, point: Column) -> Column:
    """Length between two ray-plane intersections, null if parallel or behind."""
    offset = dot(normal, point)
    da, db = dot(ray_a, normal), dot(ray_b, normal)
    ta, tb = offset / da, offset / db
    ends = F.array(*[ray_a.getItem(i) * ta - ray_b.getItem(i) * tb for i in range(3)])
    ok = (F.least(F.abs(da), F.abs(db)) >= 1e-8) & (F.least(ta, tb) > 0)
    return F.when(ok, norm(ends))


def relative_error(measured: Column, expected: Column) -> Column:
    return F.abs(measured - expected) / expected


def scale_of_point(source: Column, metric: Column) -> Column:
    """Scalar projection ``sum(s*m)/sum(s*s)``; null for a degenerate point."""
    denominator = dot(source, source)
    return F.when(denominator > 1e-18, dot(source, metric) / denominator)


def scale_residual(source: Column, metric: Column) -> Column:
    ratio = scale_of_point(source, metric)
    fitted = F.array(*[ratio * source.getItem(i) for i in range(3)])
    return norm(sub(fitted, metric)) / F.greatest(norm(metric), F.lit(1e-12))


def quad_homography(corners: Column) -> Column:
    """Homography of the unit square onto four image points (8 numbers, last entry 1).

    ``corners`` is array<array<double>> in cyclic order; closed form of the 8x8 system.
    """
    (x0, y0), (x1, y1), (x2, y2), (x3, y3) = [parts(corners.getItem(i), 2) for i in range(4)]
    dx1, dx2, dx3 = x1 - x2, x3 - x2, x0 - x1 + x2 - x3
    dy1, dy2, dy3 = y1 - y2, y3 - y2, y0 - y1 + y2 - y3
    den = dx1 * dy2 - dx2 * dy1
    tilt = F.array(F.try_divide(dx3 * dy2 - dx2 * dy3, den), F.try_divide(dx1 * dy3 - dx3 * dy1, den))

    def fill(t):
        g, h = parts(t, 2)
        return F.array(x1 - x0 + g * x1, x3 - x0 + h * x3, x0,
                       y1 - y0 + g * y1, y3 - y0 + h * y3, y0, g, h)

    return let(tilt, fill)


# Limits of the single-rectangle focal estimate.
MIN_PERSPECTIVE = 1e-10
MAX_ORTHOGONALITY = 0.05
MAX_AXIS_DIFFERENCE = 0.05


def quad_focal(corners: Column, width: Column, height: Column, resolution: Column,
               principal: Column | None = None, min_information: float = MIN_PERSPECTIVE,
               max_orthogonality: float = MAX_ORTHOGONALITY,
               max_axis_difference: float = MAX_AXIS_DIFFERENCE) -> Column:
    """``struct<focal_px, accepted, reasons>`` from one imaged rectangle.

    Two conditions (orthogonal axes, known axis ratio) are linear in 1/f^2 and are
    solved in the least-squares sense, in coordinates scaled by the longer image side.
    """
    px, py = parts(principal, 2) if principal is not None else (
        resolution.getItem(0) / 2, resolution.getItem(1) / 2)
    image_scale = F.greatest(resolution.getItem(0), resolution.getItem(1)).cast("double")
    object_scale = F.greatest(width, height)
    scaled_corners = F.transform(corners, lambda c: F.array((c.getItem(0) - px) / image_scale,
                                                            (c.getItem(1) - py) / image_scale))

    def axes(h):
        """Images of the two object axes; centring rescales all columns by one factor."""
        g = h.getItem
        common = 1 + g(6) / 2 + g(7) / 2
        ws, hs = width / object_scale * common, height / object_scale * common
        return F.array(F.array(*[F.try_divide(g(i), ws) for i in (0, 3, 6)]),
                       F.array(*[F.try_divide(g(i), hs) for i in (1, 4, 7)]))

    def equations(pair):
        a, b = pair.getItem(0), pair.getItem(1)
        (a0, a1, a2), (b0, b1, b2) = parts(a), parts(b)
        return F.array(a0 * b0 + a1 * b1, (a0 * a0 + a1 * a1) - (b0 * b0 + b1 * b1),
                       a2 * b2, a2 * a2 - b2 * b2, dot(a, a) + dot(b, b))

    def solve(e):
        c1, c2, d1, d2, size = parts(e, 5)
        denominator = c1 * c1 + c2 * c2
        information = F.sqrt(d1 * d1 + d2 * d2) / F.greatest(size, F.lit(1e-30))
        q = -F.try_divide(c1 * d1 + c2 * d2, denominator)
        vague = F.coalesce((information < min_information) | (denominator <= 1e-24), F.lit(True))
        return F.struct(vague.alias("vague"), F.when(~vague & (q > 0), 1 / F.sqrt(q)).alias("f"))

    def checks(pair):
        def errors(found):
            f = found.getField("f")
            first, second = [vec(p.getItem(0) / f, p.getItem(1) / f, p.getItem(2))
                             for p in (pair.getItem(0), pair.getItem(1))]
            measured = let(F.array(first, second), lambda v: F.array(
                dot(v.getItem(0), v.getItem(1)), norm(v.getItem(0)), norm(v.getItem(1))))
            return let(measured, lambda m: verdict(found, m))

        return let(let(equations(pair), solve), errors)

    def verdict(found, m):
        vague, f = found.getField("vague"), found.getField("f")
        cosine, n1, n2 = parts(m)
        why = F.array_compact(F.array(
            F.when(vague, "focal_unidentifiable_projection"),
            F.when(~vague & f.isNull(), "no_positive_focal"),
            F.when(F.abs(cosine) / (n1 * n2) > max_orthogonality, "axis_orthogonality_inconsistent"),
            F.when(F.abs(n1 - n2) / F.greatest(n1, n2) > max_axis_difference, "axis_length_inconsistent")))
        return F.struct((f * image_scale).alias("focal_px"), (F.size(why) == 0).alias("accepted"),
                        why.alias("reasons"))

    return let(let(quad_homography_of(scaled_corners), axes), checks)


def quad_homography_of(corners: Column) -> Column:
    return let(corners, quad_homography)
