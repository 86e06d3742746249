"""Geometry as column expressions. Everything here stays inside whole-stage codegen.

Vectors are ARRAY<DOUBLE>(3), rotations ARRAY<DOUBLE>(9) row-major, poses
ARRAY<DOUBLE>(16) row-major camera-to-world, boxes a struct of center, extent and R
where R is a 3x3 nested array whose columns are the box axes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Detector boxes are normalised to this range.
BOX_SCALE = 1000.0


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def norm3(x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(x * x + y * y + z * z)


def distance3(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return norm3(*[p - q for p, q in zip(a, b)])


def vec(c: Column | str) -> list[Column]:
    c = as_col(c)
    return [c[i] for i in range(3)]


def camera_center(pose: Column | str) -> list[Column]:
    """Translation column of a row-major camera-to-world matrix."""
    pose = as_col(pose)
    return [pose[3], pose[7], pose[11]]


# --- image boxes ------------------------------------------------------------


def descale_box(box: Column | str, height: Column, width: Column) -> dict[str, Column]:
    """Normalised `[ymin, xmin, ymax, xmax]` to pixel columns `x0, y0, x1, y1`.

    Inverted sides are swapped, the result is clipped to the image and never empty.
    """
    box = as_col(box)
    problem = F.raise_error(F.concat(F.lit("box_2d must have 4 elements, got "), F.size(box).cast("string")))
    checked = F.when(F.size(box) == 4, box).otherwise(problem)
    height, width = as_col(height).cast("int"), as_col(width).cast("int")

    def span(i: int, j: int, size: Column) -> tuple[Column, Column]:
        a, b = checked[i].cast("double"), checked[j].cast("double")
        low = F.floor(F.least(a, b) / BOX_SCALE * size).cast("int")
        high = F.ceil(F.greatest(a, b) / BOX_SCALE * size).cast("int")
        first = F.least(F.greatest(low, F.lit(0)), size - 1)
        return first, F.least(F.greatest(high, first + 1), size)

    (y0, y1), (x0, x1) = span(0, 2, height), span(1, 3, width)
    return {"x0": x0, "y0": y0, "x1": x1, "y1": y1}


def erode_box(px: int, height: Column, width: Column, names: Sequence[str] = ("x0", "y0", "x1", "y1")) -> dict[str, Column]:
    """Shrink a pixel box by `px` on every side that is not the image border.

    The original comes back when nothing would be left. Reads the box from the named
    columns and returns columns `sx0, sy0, sx1, sy1`.
    """
    box = [F.col(n) for n in names]
    limit = [F.lit(0), F.lit(0), as_col(width).cast("int"), as_col(height).cast("int")]
    step = max(px, 0)
    moved = [
        F.when(box[i] > limit[i], box[i] + step).otherwise(box[i]) for i in range(2)
    ] + [F.when(box[i] < limit[i], box[i] - step).otherwise(box[i]) for i in range(2, 4)]
    left = (moved[2] > moved[0]) & (moved[3] > moved[1])
    return {f"s{n}": F.when(left, m).otherwise(b) for n, m, b in zip(("x0", "y0", "x1", "y1"), moved, box)}


def box_area(x0: Column | str, y0: Column | str, x1: Column | str, y1: Column | str) -> Column:
    x0, y0, x1, y1 = (as_col(c).cast("bigint") for c in (x0, y0, x1, y1))
    return (x1 - x0) * (y1 - y0)


def in_box(u: Column | str, v: Column | str, names: Sequence[str] = ("x0", "y0", "x1", "y1")) -> Column:
    """Half-open membership of pixel `(u, v)` in the box of the named columns."""
    x0, y0, x1, y1 = (F.col(n) for n in names)
    u, v = as_col(u), as_col(v)
    return (u >= x0) & (u < x1) & (v >= y0) & (v < y1)


# --- oriented boxes ----------------------------------------------------------


def diagonal(extent: Column | str) -> Column:
    return norm3(*vec(extent))


def envelope(obb: Column | str) -> Column:
    """World-axis-aligned struct `(lo, hi)` around an oriented box.

    The half size on axis i is the sum over box axes of |R_ij| * extent_j / 2, which is
    what the extreme corner reaches.
    """
    obb = as_col(obb)
    center, extent, rot = obb["center"], obb["extent"], obb["R"]
    half = [
        sum((F.abs(rot[i][j]) * extent[j] * 0.5 for j in range(1, 3)), F.abs(rot[i][0]) * extent[0] * 0.5)
        for i in range(3)
    ]
    return F.struct(
        F.array(*[center[i] - half[i] for i in range(3)]).alias("lo"),
        F.array(*[center[i] + half[i] for i in range(3)]).alias("hi"),
    )


def envelope_iou(a: Column | str, b: Column | str) -> Column:
    """Intersection over union of two `(lo, hi)` envelopes; 0 without a solid overlap."""
    a, b = as_col(a), as_col(b)

    def product(parts: Sequence[Column]) -> Column:
        return parts[0] * parts[1] * parts[2]

    overlap = product(
        [F.greatest(F.least(a["hi"][i], b["hi"][i]) - F.greatest(a["lo"][i], b["lo"][i]), F.lit(0.0)) for i in range(3)]
    )
    volume = lambda e: product([F.greatest(e["hi"][i] - e["lo"][i], F.lit(1e-9)) for i in range(3)])
    union = volume(a) + volume(b) - overlap
    return F.when((overlap > 0) & (union > 0), overlap / union).otherwise(F.lit(0.0))


def corner_signs() -> Column:
    """The eight sign combinations of a box as an array of `(sx, sy, sz)` structs."""
    half = (-0.5, 0.5)
    return F.array(*[
        F.struct(F.lit(x).alias("sx"), F.lit(y).alias("sy"), F.lit(z).alias("sz"))
        for x in half for y in half for z in half
    ])


def corner(obb: Column | str, signs: Column) -> list[Column]:
    """World position of the corner of a box picked by one sign combination."""
    obb = as_col(obb)
    local = [signs[s] * obb["extent"][j] for j, s in enumerate(("sx", "sy", "sz"))]
    rot = obb["R"]
    return [
        obb["center"][i] + (rot[i][0] * local[0] + rot[i][1] * local[1] + rot[i][2] * local[2]) for i in range(3)
    ]


# --- rotations and rigid transforms ---------------------------------------------


def quat_to_rotation(q: Column | str) -> Column:
    """`[qx, qy, qz, qw]` to a row-major rotation; the identity for a zero quaternion."""
    q = as_col(q)
    n = F.sqrt(q[0] * q[0] + q[1] * q[1] + q[2] * q[2] + q[3] * q[3])
    x, y, z, w = [q[i] / F.when(n < 1e-12, F.lit(1.0)).otherwise(n) for i in range(4)]
    one, two = F.lit(1.0), F.lit(2.0)
    turned = F.array(
        one - two * (y * y + z * z), two * (x * y - z * w), two * (x * z + y * w),
        two * (x * y + z * w), one - two * (x * x + z * z), two * (y * z - x * w),
        two * (x * z - y * w), two * (y * z + x * w), one - two * (x * x + y * y),
    )
    identity = F.array(*[F.lit(1.0 if i % 4 == 0 else 0.0) for i in range(9)])
    return F.when(n < 1e-12, identity).otherwise(turned)


def rotation_to_quat(r: Column | str) -> Column:
    """Row-major rotation to `[qx, qy, qz, qw]`, pivoting on the largest term."""
    r = as_col(r)
    m = [[r[3 * i + j] for j in range(3)] for i in range(3)]
    quarter = F.lit(0.25)

    def scaled(total: Column) -> Column:
        # Guarded: every branch of a CASE may be evaluated ahead of its condition.
        return F.sqrt(F.greatest(total, F.lit(1e-300))) * 2.0

    sw = scaled(m[0][0] + m[1][1] + m[2][2] + 1.0)
    sx = scaled(F.lit(1.0) + m[0][0] - m[1][1] - m[2][2])
    sy = scaled(F.lit(1.0) + m[1][1] - m[0][0] - m[2][2])
    sz = scaled(F.lit(1.0) + m[2][2] - m[0][0] - m[1][1])
    dx, dy, dz = m[2][1] - m[1][2], m[0][2] - m[2][0], m[1][0] - m[0][1]
    xy, xz, yz = m[0][1] + m[1][0], m[0][2] + m[2][0], m[1][2] + m[2][1]
    by_w = F.array(dx / sw, dy / sw, dz / sw, quarter * sw)
    by_x = F.array(quarter * sx, xy / sx, xz / sx, dx / sx)
    by_y = F.array(xy / sy, quarter * sy, yz / sy, dy / sy)
    by_z = F.array(xz / sz, yz / sz, quarter * sz, dz / sz)
    return (
        F.when(m[0][0] + m[1][1] + m[2][2] > 0, by_w)
        .when((m[0][0] > m[1][1]) & (m[0][0] > m[2][2]), by_x)
        .when(m[1][1] > m[2][2], by_y)
        .otherwise(by_z)
    )


def pose_from(rotation: Column | str, position: Column | str) -> Column:
    """Row-major 4x4 from a rotation and a translation."""
    rotation, position = as_col(rotation), as_col(position)
    rows = []
    for i in range(3):
        rows += [rotation[3 * i], rotation[3 * i + 1], rotation[3 * i + 2], position[i]]
    return F.array(*rows, F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))


def move_point(t: Column | Sequence[float], p: Sequence[Column]) -> list[Column]:
    """Apply a row-major 4x4 (literal or column) to a point."""
    m = [F.lit(float(v)) for v in t] if not isinstance(t, Column) else [t[i] for i in range(16)]
    return [m[4 * i] * p[0] + m[4 * i + 1] * p[1] + m[4 * i + 2] * p[2] + m[4 * i + 3] for i in range(3)]


def matmul4(a: Column, b: Column) -> Column:
    """Product of two row-major 4x4 arrays."""
    cells = []
    for i in range(4):
        for j in range(4):
            cells.append(
                a[4 * i] * b[j] + a[4 * i + 1] * b[4 + j] + a[4 * i + 2] * b[8 + j] + a[4 * i + 3] * b[12 + j]
            )
    return F.array(*cells)


def move_obb(t: Column, obb: Column | str) -> Column:
    """Rigidly move a box: centre transformed, axes rotated, extent unchanged."""
    obb = as_col(obb)
    center = F.array(*move_point(t, vec(obb["center"])))
    rot = obb["R"]
    turned = F.array(*[
        F.array(*[t[4 * i] * rot[0][j] + t[4 * i + 1] * rot[1][j] + t[4 * i + 2] * rot[2][j] for j in range(3)])
        for i in range(3)
    ])
    return F.struct(center.alias("center"), obb["extent"].alias("extent"), turned.alias("R"))


def rotation_angle(t: Column) -> Column:
    """Rotation angle of a row-major 4x4 in degrees."""
    c = (t[0] + t[5] + t[10] - 1.0) / 2.0
    return F.degrees(F.acos(F.least(F.greatest(c, F.lit(-1.0)), F.lit(1.0))))


def intrinsics(focals: Column | str, principal: Column | str) -> Column:
    """Row-major pinhole K; a single focal serves both axes."""
    focals, principal = as_col(focals), as_col(principal)
    zero = F.lit(0.0)
    return F.array(
        focals[0].cast("double"), zero, principal[0].cast("double"),
        zero, F.element_at(focals, -1).cast("double"), principal[1].cast("double"),
        zero, zero, F.lit(1.0),
    )


# --- plan view ---------------------------------------------------------------------


def plane_axes(up_axis: int) -> tuple[int, int]:
    """The two axes a plan against `up_axis` keeps."""
    a, b = (axis for axis in range(3) if axis != up_axis)
    return a, b


def world_to_pixel(transform: Column, a: Column, b: Column) -> tuple[Column, Column]:
    """Plane coordinates to plan pixels; rows grow downwards."""
    u = (a - transform["origin_a"]) * transform["scale"]
    v = transform["height"] - 1 - (b - transform["origin_b"]) * transform["scale"]
    return u, v


def pixel_to_world(transform: Column, u: Column, v: Column) -> tuple[Column, Column]:
    a = u / transform["scale"] + transform["origin_a"]
    b = (transform["height"] - 1 - v) / transform["scale"] + transform["origin_b"]
    return a, b
