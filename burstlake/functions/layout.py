"""Layout geometry and colour shares as expressions (survey X12, X13, X17, A17, P15, P16)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Shares of the layout without its photo that are in balance, and the order in which colours claim a pixel.
BALANCE = {"cream": (0.45, 0.75), "graphite": (0.20, 0.40), "accent": (0.04, 0.20)}
ORDER = ("cream", "graphite", "crimson", "sand")
TOLERANCE = 12


def pixels_of(rect: list[Column], w: Column, h: Column) -> Column:
    """x0, y0, x1, y1 of a rectangle in shares: edges are rounded, so neighbours leave no gap."""
    x, y, rw, rh = rect
    edge = lambda v, most: F.greatest(F.lit(0), F.least(most, F.bround(v * most, 0).cast("int")))
    x0, y0 = edge(x, w), edge(y, h)
    return F.struct(x0.alias("x0"), y0.alias("y0"), F.greatest(edge(x + rw, w), x0 + 1).alias("x1"), F.greatest(edge(y + rh, h), y0 + 1).alias("y1"))


def luminance_of(lightness: Column) -> Column:
    """Y of a CIE L*."""
    f = (lightness + 16.0) / 116.0
    return F.when(lightness > 8.0, f * f * f).otherwise(lightness * 27.0 / 24389.0)


def coverage(lightness: Column, paper: Column, ink: Column) -> Column:
    """The ink share whose mean with the paper, in linear light, has a lightness (X13); out of reach is clamped."""
    y = luminance_of(F.least(F.greatest(lightness, F.lit(0.0)), F.lit(100.0)))
    return F.least(F.greatest((paper - y) / F.greatest(paper - ink, F.lit(1e-6)), F.lit(0.0)), F.lit(1.0))


def colour_shares(pixels: DataFrame, palette: dict[str, tuple], image: str = "image", tolerance: int = TOLERANCE) -> DataFrame:
    """Shares of an image's pixels (r, g, b, photo) by the first colour that is near enough (A17); photos come first."""
    apart = lambda ref: F.abs(F.col("r") - ref[0]) + F.abs(F.col("g") - ref[1]) + F.abs(F.col("b") - ref[2])
    claim = F.when(F.col("photo"), "photo")
    for name in ORDER:
        claim = claim.when(apart(palette[name]) <= tolerance, name)
    claim = claim.otherwise("other")
    ink, paper = apart(palette["crimson"]), apart(palette["cream"])
    toned = F.when(F.col("photo"), paper / F.greatest(ink + paper, F.lit(1)))
    share = lambda n: F.avg((F.col("_c") == n).cast("double")).alias(n)
    return pixels.withColumns({"_c": claim, "_ink": toned}).groupBy(image).agg(*[share(n) for n in (*ORDER, "photo", "other")], F.coalesce(F.avg("_ink"), F.lit(0.0)).alias("photo_ink"))


def balance_warnings() -> Column:
    """What is out of balance in a row of ``colour_shares`` (P16): the name and ``low`` or ``high``."""
    layout = F.greatest(F.lit(1e-6), 1.0 - F.col("photo"))
    shares = {"cream": F.col("cream") / layout, "graphite": F.col("graphite") / layout, "accent": (F.col("crimson") + F.col("sand")) / layout}
    found = [F.when(F.col("photo") > 0.75, "photo high")]
    found += [F.when(shares[n] < low, f"{n} low").when(shares[n] > high, f"{n} high") for n, (low, high) in BALANCE.items()]
    return F.array_compact(F.array(*found))


def stale_part(name: Column, age_s: Column, least: float = 3600.0) -> Column:
    """A writer's leftover that is old enough to be nobody's."""
    return name.rlike(r"(?i)^.+\.jpg\.[0-9a-f]+\.tmp$") & (age_s >= least)


def cover_crop(w: Column, h: Column, out_w: Column, out_h: Column, face: Column | None = None, fill: float = 0.0, most: float = 1.0, head: float = 0.40, focus: tuple = (0.5, 0.42)) -> Column:
    """left, top, right, bottom of the part that fills a block.

    Around ``face`` (left, top, right, bottom) if it has two pixels a side: whole if it fits, its centre at ``head`` of the
    height, nearer by at most ``most`` so that it takes ``fill`` of the width. Otherwise around ``focus``. Null for sizes that
    aren't positive.
    """
    within = lambda v, low, high: F.least(F.greatest(v, low), high)
    zero, ratio = F.lit(0.0), out_w.cast("double") / F.when(out_h > 0, out_h)
    sides = (F.least(w.cast("double"), h * ratio), F.least(h.cast("double"), w / ratio))
    spots = [focus[0] * w - sides[0] / 2, focus[1] * h - sides[1] / 2]
    if face is not None:
        given = [face[n].isNotNull() for n in ("left", "top", "right", "bottom")]
        x, y = [[within(face[n].cast("double"), zero, side.cast("double")) for n in ends] for ends, side in ((("left", "right"), w), (("top", "bottom"), h))]
        x, y = [(F.least(*e), F.greatest(*e)) for e in (x, y)]
        usable = F.coalesce((x[1] - x[0] >= 2) & (y[1] - y[0] >= 2) & given[0] & given[1] & given[2] & given[3], F.lit(False))
        zoom = F.lit(1.0)
        if fill > 0 and most > 1:
            wide = x[1] - x[0]
            zoom = F.least(within(sides[0] / F.greatest(wide / fill, F.lit(1.0)), F.lit(1.0), F.lit(float(most))), F.greatest(F.lit(1.0), 0.6 * sides[0] / F.greatest(wide, F.lit(1.0))))
        near = [s / zoom for s in sides]
        placed = [(x[0] + x[1]) / 2 - near[0] / 2, (y[0] + y[1]) / 2 - head * near[1]]
        placed = [F.when(e[1] - e[0] <= n, F.least(F.greatest(p, e[1] - n), e[0])).otherwise(p) for p, e, n in zip(placed, (x, y), near)]
        spots = [F.when(usable, p).otherwise(s) for p, s in zip(placed, spots)]
        sides = [F.when(usable, n).otherwise(s) for n, s in zip(near, sides)]
    left, top = within(spots[0], zero, w - sides[0]), within(spots[1], zero, h - sides[1])
    whole = lambda v: F.bround(v, 0).cast("int")
    box = F.struct(whole(left).alias("left"), whole(top).alias("top"), whole(F.least(left + sides[0], w)).alias("right"), whole(F.least(top + sides[1], h)).alias("bottom"))
    return F.when((w > 0) & (h > 0) & (out_w > 0) & (out_h > 0), box)
