"""Column expressions. Polygons are array<array<double>>, boxes array<double> (left, top, right, bottom)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:  # noqa: ANN001
    """``body`` of ``value``, evaluated once."""
    return F.transform(F.array(value), body)[0]


def hex_prefix(text: Column, digits: int) -> Column:
    """The first hex digits of SHA-256 as a long (15 digits at most)."""
    return F.conv(F.substr(F.sha2(text, 256), F.lit(1), F.lit(digits)), 16, 10).cast("bigint")


def seed_of(root: int, key: Column) -> Column:
    """O-116: a 60-bit seed from root and key."""
    return hex_prefix(F.concat(F.lit(f"{root}:"), key.cast("string")), 15)


def cv_fold(root: int, key: Column, folds: int = 3) -> Column:
    """O-117: cross-validation fold from the first 8 hex digits."""
    return (hex_prefix(F.concat(F.lit(f"{root}:"), key.cast("string")), 8) % folds).cast("int")


def stable_index(*parts: Column) -> Column:
    """O-118: 64-bit index of a composite key, beyond a signed long, so a decimal."""
    return F.conv(F.substr(F.sha2(F.concat_ws("|", *parts), 256), F.lit(1), F.lit(16)), 16, 10).cast("decimal(20,0)")


def uniform(seed: int | str, *keys: Column) -> Column:
    """A hashed draw in [0, 1) from seed and keys; the same in DuckDB."""
    return hex_prefix(F.concat_ws(":", F.lit(str(seed)), *(k.cast("string") for k in keys)), 12).cast("double") / float(1 << 48)


def column_letters(n: Column) -> Column:
    """O-37: bijective base 26, as spreadsheet columns are named (1 is A), of any length."""
    step = F.struct(F.lit("").alias("s"), n.cast("bigint").alias("n"))
    done = F.aggregate(
        F.sequence(F.lit(1), F.lit(14)),
        step,
        lambda acc, _: F.when(acc["n"] > 0, F.struct(F.concat(F.chr(((acc["n"] - 1) % 26) + 65), acc["s"]).alias("s"), F.floor((acc["n"] - 1) / 26).cast("bigint").alias("n"))).otherwise(acc),
    )
    return done["s"]


def polynomial_hash(text: Column, modulus: int) -> Column:
    """O-120: unsigned 32-bit hash, each character's code added to 31 times the last, modulo ``modulus``."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("bigint"))
    return F.aggregate(codes, F.lit(0).cast("bigint"), lambda acc, c: (acc * 31 + c) % (1 << 32)) % modulus


def half_even(x: Column) -> Column:
    return F.bround(x, 0).cast("bigint")


def nearest_rank(values: Column, share: float) -> Column:
    """O-69: element at round-half-even((n - 1) * share) of the sorted array; 0.0 if empty."""
    ordered = F.array_sort(values)
    at = F.bround((F.size(values) - 1) * F.lit(share), 0).cast("int")
    return F.when(F.size(values) > 0, F.get(ordered, at)).otherwise(0.0)


def people_bucket(n: Column) -> Column:
    """O-124."""
    return F.when(n.isNull(), "unknown").when(n <= 20, "small").when(n <= 27, "medium").otherwise("large")


def _edge(p: Column, i: int, j: int) -> Column:
    return F.hypot(p[i][0] - p[j][0], p[i][1] - p[j][1])


def quad_width(quad: Column) -> Column:
    """O-125: text width at height 48, from the longer of opposing edges, half-even, within 8 and 640; 640 if malformed."""
    width, height = F.greatest(_edge(quad, 0, 1), _edge(quad, 2, 3)), F.greatest(_edge(quad, 1, 2), _edge(quad, 3, 0))
    scaled = F.greatest(F.least(half_even(48 * width / height), F.lit(640)), F.lit(8))
    return F.when((F.size(quad) == 4) & (height > 0), scaled).otherwise(640)


def width_bucket(width: Column) -> Column:
    """O-125."""
    return F.when(width <= 160, 160).when(width <= 320, 320).otherwise(640)


def polygon_area(p: Column) -> Column:
    """O-128: shoelace."""
    n = F.size(p)
    turned = F.concat(F.slice(p, 2, F.greatest(n - 1, F.lit(0))), F.slice(p, 1, 1))
    cross = F.zip_with(p, turned, lambda a, b: a[0] * b[1] - b[0] * a[1])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda acc, x: acc + x)) / 2


def bounding_box(p: Column) -> Column:
    """O-129."""
    xs, ys = F.transform(p, lambda q: q[0]), F.transform(p, lambda q: q[1])
    return F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def is_convex_quad(p: Column) -> Column:
    """O-130: four points, some area, and turns of one sign."""

    def turn(i: int) -> Column:
        a, b, c = p[i], p[(i + 1) % 4], p[(i + 2) % 4]
        return (b[0] - a[0]) * (c[1] - b[1]) - (b[1] - a[1]) * (c[0] - b[0])

    turns = F.array(*(turn(i) for i in range(4)))
    one_way = F.forall(turns, lambda t: t > 0) | F.forall(turns, lambda t: t < 0)
    return F.when(F.size(p) == 4, (polygon_area(p) > 1e-6) & one_way).otherwise(False)


def inside_image(p: Column, width: Column, height: Column, tolerance: float = 0.0) -> Column:
    """O-133, and with a tolerance O-132's bounds."""
    return (F.size(p) == 4) & F.forall(p, lambda q: q[0].between(-tolerance, width + tolerance) & q[1].between(-tolerance, height + tolerance))


def quad_reason(p: Column, width: Column, height: Column) -> Column:
    """O-132: why a quad is refused, or null."""
    return (
        F.when(p.isNull() | (F.size(p) != 4), "point_count")
        .when(~inside_image(p, width, height, 1.0), "outside_image")
        .when(~is_convex_quad(p), "not_convex")
    )


def apply_homography(p: Column, h: Sequence[float]) -> Column:
    """O-134: a 3x3 matrix in row order; the denominator is at least 1e-12."""

    def point(q: Column) -> Column:
        w = F.greatest(h[6] * q[0] + h[7] * q[1] + h[8], F.lit(1e-12))
        return F.array((h[0] * q[0] + h[1] * q[1] + h[2]) / w, (h[3] * q[0] + h[4] * q[1] + h[5]) / w)

    return F.transform(p, point)


def visible_share(box: Column, width: Column, height: Column) -> Column:
    """O-135 on boxes: share of the box's area within the image."""
    w = F.greatest(F.least(box[2], width) - F.greatest(box[0], F.lit(0.0)), F.lit(0.0))
    h = F.greatest(F.least(box[3], height) - F.greatest(box[1], F.lit(0.0)), F.lit(0.0))
    area = (box[2] - box[0]) * (box[3] - box[1])
    return F.when(area > 0, w * h / area).otherwise(0.0)


def box_iou(a: Column, b: Column) -> Column:
    """O-136 on boxes."""
    w = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0))
    h = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def expand_quad(p: Column, factor: float) -> Column:
    """O-139: scale about the mean point."""
    mean = lambda k: F.aggregate(p, F.lit(0.0), lambda acc, q: acc + q[k]) / F.size(p)
    return F.transform(p, lambda q: F.array(mean(0) + (q[0] - mean(0)) * factor, mean(1) + (q[1] - mean(1)) * factor))


def corner_distance(a: Column, b: Column) -> Column:
    """O-140: least, over the eight rotations and reversals, of the greatest corner distance."""
    orders = [[(s + d * i) % 4 for i in range(4)] for s in range(4) for d in (1, -1)]
    far = [F.greatest(*(F.hypot(a[i][0] - b[k][0], a[i][1] - b[k][1]) for i, k in enumerate(order))) for order in orders]
    return F.least(*far)


def positive_overlap(a: Column, b: Column, least: float = 0.5) -> Column:
    """O-82: boxes that overlap by more than ``least`` on both axes."""
    return (F.least(a[2], b[2]) - F.greatest(a[0], b[0]) > least) & (F.least(a[3], b[3]) - F.greatest(a[1], b[1]) > least)


def flexible_boolean(text: Column) -> Column:
    """O-147: true/1/yes and false/0/no in any case, blank as null, anything else an error."""
    t = F.lower(F.trim(text))
    return F.when(t.isNull() | (t == ""), None).when(t.isin("true", "1", "yes"), True).when(t.isin("false", "0", "no"), False).otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), text)).cast("boolean"))


def nullable_number(text: Column, kind: str) -> Column:
    """O-147: blank as null, NaN and infinities and anything else unreadable an error."""
    value = F.nullif(F.trim(text), F.lit(""))
    number = value.try_cast(kind)
    bad = value.isNotNull() & (number.isNull() | (F.isnan(number.cast("double")) | (F.abs(number.cast("double")) == float("inf"))))
    return F.when(bad, F.raise_error(F.concat(F.lit("not a number: "), text)).cast(kind)).otherwise(number)


def ctc_decode(steps: Column, blank: int = 0) -> Column:
    """O-89: collapse repeats, drop blanks, of an array of class numbers."""
    return F.filter(F.transform(steps, lambda x, i: F.when((x == blank) | ((i > 0) & (F.get(steps, i - 1) == x)), F.lit(None)).otherwise(x)), lambda x: x.isNotNull())


def group_label(i: Column, n: Column) -> Column:
    """O-39: number of a row's group of three, from 0-based position and count."""
    return F.least(F.floor(i / F.greatest(F.lit(5), half_even(n / 3))) + 1, F.lit(3)).cast("int")


def mutate_case(text: Column, seed: int, key: Column, share: float) -> Column:
    """O-107: hashed coin per ASCII letter flips its case."""
    flip = lambda c, i: F.when(c.rlike("[A-Z]"), F.lower(c)).when(c.rlike("[a-z]"), F.upper(c)).otherwise(c)
    return F.array_join(F.transform(F.split(text, ""), lambda c, i: F.when(uniform(seed, key, i) < share, flip(c, i)).otherwise(c)), "")


def date_token(text: Column) -> Column:
    """O-109: a day of the month, without leading zero."""
    return text.rlike(r"^(?:[1-9]|[12][0-9]|3[01])$")


def grouped_number(text: Column) -> Column:
    """O-110: an integer with thousands separators, null if it is none."""
    return F.regexp_replace(text, ",", "").try_cast("bigint")


def hangul_count(text: Column) -> Column:
    """O-113: Hangul syllables; the other characters are the rest of the length."""
    return F.regexp_count(text, F.lit("[\uac00-\ud7a3]"))


def canonical_hash(*columns: str) -> Column:
    """O-114: SHA-256 of the columns as one JSON object, keys sorted, nulls kept."""
    return F.sha2(F.to_json(F.struct(*(F.col(c) for c in sorted(columns))), {"ignoreNullFields": "false"}), 256)


def box_polygon(box: Column) -> Column:
    """The four corners of (left, top, right, bottom), clockwise."""
    return F.array(F.array(box[0], box[1]), F.array(box[2], box[1]), F.array(box[2], box[3]), F.array(box[0], box[3]))


def first_polygon(*options: Column, box: Column) -> Column:
    """O-137: the first polygon of at least three points, else that of the bounding box."""
    usable = [F.when(F.size(p) >= 3, p) for p in options]
    return F.coalesce(*usable, F.when(F.size(box) == 4, box_polygon(box)))


#: Fixed values of a plausible quadrilateral: least share of the image, greatest ratio of sides, least side, least and greatest angle.
LEAST_AREA, MOST_ASPECT, LEAST_SIDE, LEAST_ANGLE, MOST_ANGLE = 1e-5, 30.0, 1e-3, 5.0, 175.0


def plausible_quad(p: Column, width: Column, height: Column) -> Column:
    """O-131: convex, not too small for the image, sides and angles in bounds."""
    corner = lambda i: p[i % 4]
    along = lambda i, j: (corner(j)[0] - corner(i)[0], corner(j)[1] - corner(i)[1])
    sides = [F.hypot(*along(i, i + 1)) for i in range(4)]

    def angle(i: int) -> Column:
        (ax, ay), (bx, by) = along(i, i + 3), along(i, i + 1)
        cosine = (ax * bx + ay * by) / F.greatest(F.lit(1e-9), F.hypot(ax, ay) * F.hypot(bx, by))
        return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))

    angles = [angle(i) for i in range(4)]
    area = polygon_area(p) / F.greatest(F.lit(1.0), (width * height).cast("double")) >= LEAST_AREA
    side = (F.least(*sides) > LEAST_SIDE) & (F.greatest(*sides) <= MOST_ASPECT * F.least(*sides))
    return F.coalesce(is_convex_quad(p) & area & side & (F.least(*angles) >= LEAST_ANGLE) & (F.greatest(*angles) <= MOST_ANGLE), F.lit(False))
