"""Scalar functions as column expressions (survey §2.9, F4-F8, F13, P9, P13). None of them reads the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit hashes."""
    return F.bit_count(a.bitwiseXOR(b))


def dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays, in double (F8)."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def histogram_intersection(a: Column, b: Column) -> Column:
    """Sum of the smaller bins."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x.cast("double"), y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def sign_hash(v: Column) -> Column:
    """A 64-bit hash from the signs of up to 64 numbers, lowest bit first, as F3 makes one from pixels."""
    bits = F.transform(v, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))


def file_number(stem: Column) -> Column:
    """The last run of digits in a stem, -1 without one."""
    return F.coalesce(F.element_at(F.filter(F.array(F.regexp_extract(stem, r"([0-9]+)[^0-9]*$", 1)), lambda s: s != ""), 1).cast("decimal(38,0)"), F.lit(-1).cast("decimal(38,0)"))


def naive_seconds(ts: Column) -> Column:
    """Seconds since 1970 of a time without a zone, to the microsecond, whatever the session's zone is."""
    micros = (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")
    day = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return (((day * 24 + F.hour(ts)) * 60 + F.minute(ts)) * 60_000_000 + micros) / 1e6


def exif_seconds(stamp: Column, subsec: Column) -> Column:
    """Seconds of an EXIF time with its fraction, null on garbage (X1); times are naive."""
    digits = F.regexp_replace(F.coalesce(subsec, F.lit("")), "[^0-9]", "")
    text = F.substring(F.replace(stamp, F.lit("\0"), F.lit("")), 1, 19)
    parts = [F.regexp_extract(text, r"^(\d{4}):(\d\d):(\d\d) (\d\d):(\d\d):([0-5]\d)$", k).try_cast("int") for k in range(1, 7)]
    return naive_seconds(F.try_make_timestamp_ntz(*parts)) + F.concat(F.lit("0."), F.when(digits == "", "0").otherwise(digits)).cast("double")


def clock(seconds: Column) -> Column:
    """``m:ss``, from an hour on ``h:mm:ss``; rounded half to even."""
    s = F.bround(F.greatest(seconds.cast("double"), F.lit(0.0)), 0).cast("long")
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.when(h > 0, F.concat_ws(":", h.cast("string"), two(m), two(r))).otherwise(F.concat_ws(":", m.cast("string"), two(r)))


def byte_size(n: Column) -> Column:
    """Sizes for people (X4): MB with one decimal, KB, or bytes."""
    mb, kb = 1 << 20, 1 << 10
    return F.when(n >= mb, F.format_string("%.1f МБ", n / mb)).when(n >= kb, F.concat(F.bround(n / kb, 0).cast("long").cast("string"), F.lit(" КБ"))).otherwise(F.concat(n.cast("string"), F.lit(" Б")))


def suffix_problem(s: Column) -> Column:
    """Why a text can't be put behind a file's stem; null if it can."""
    s = F.coalesce(s, F.lit(""))
    edge = s.rlike(r"^[ .]|[ .]$") & s.rlike(r"[^ .]")
    return F.when(s.rlike(r'[\\/:*?"<>|]'), "reserved").when(s.rlike(r"[\x00-\x1F]"), "control").when(edge, "edge")


def clean_suffix(s: Column, longest: int = 40) -> Column:
    """What of a text can be put behind a stem."""
    kept = F.regexp_replace(F.coalesce(s, F.lit("")), r'[\\/:*?"<>|\x00-\x1F]', "")
    return F.left(F.regexp_replace(F.trim(kept), r"^[. ]+|[. ]+$", ""), F.lit(longest))


def plural(n: Column, one: str, few: str, many: str) -> Column:
    """Russian plural forms."""
    tens, ones = n % 100, n % 10
    return F.when((tens >= 11) & (tens <= 14), many).when(ones == 1, one).when((ones >= 2) & (ones <= 4), few).otherwise(many)


def duration(seconds: Column) -> Column:
    """A time taken, in words' short forms."""
    s = F.greatest(seconds.cast("double"), F.lit(0.0))
    whole = F.bround(s, 0).cast("long")
    return F.when(s < 60, F.format_string("%.1f с", s)).when(s < 3600, F.format_string("%d мин %d с", F.floor(whole / 60), whole % 60)).otherwise(F.format_string("%d ч %d мин", F.floor(whole / 3600), F.floor(whole % 3600 / 60)))


def camera(make: Column, model: Column) -> Column:
    """The model alone if it starts with the make."""
    make, model = F.trim(F.coalesce(make, F.lit(""))), F.trim(F.coalesce(model, F.lit("")))
    return F.when(F.lower(model).startswith(F.lower(make)), model).otherwise(F.trim(F.concat_ws(" ", make, model)))


def slug(s: Column, longest: int = 40) -> Column:
    """Letters and digits joined by single underscores, cut to a length."""
    return F.regexp_replace(F.left(F.regexp_replace(F.regexp_replace(s, r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", ""), F.lit(longest)), "_+$", "")


def linear(c: Column) -> Column:
    """An 8-bit sRGB channel as linear light (X11)."""
    v = c.cast("double") / 255.0
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def luminance(r: Column, g: Column, b: Column) -> Column:
    return 0.2126 * linear(r) + 0.7152 * linear(g) + 0.0722 * linear(b)


def contrast(y1: Column, y2: Column) -> Column:
    """WCAG contrast of two luminances."""
    return (F.greatest(y1, y2) + 0.05) / (F.least(y1, y2) + 0.05)


def lightness(y: Column) -> Column:
    """CIE L* of a luminance."""
    return F.when(y > 216.0 / 24389.0, 116.0 * F.cbrt(y) - 16.0).otherwise(y * 24389.0 / 27.0)


def hex_channels(code: Column) -> list[Column]:
    """Red, green, blue of ``#rrggbb``."""
    return [F.conv(F.substring(code, k, 2), 16, 10).cast("int") for k in (2, 4, 6)]


def penalty(flags: Column, weights: dict[str, int]) -> Column:
    """Sum of the flags' penalties, unknown ones 0."""
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    return F.aggregate(F.transform(flags, lambda f: F.coalesce(F.try_element_at(table, f), F.lit(0))), F.lit(0), lambda s, x: s + x)


def orientation_to_apply(orientation: Column, w: Column, h: Column, raw_w: Column, raw_h: Column) -> Column:
    """1 if a preview was turned already, which shows as a side ratio the other way round."""
    turned = orientation.between(5, 8) & ((w < h) != (raw_w < raw_h)) & (w != h) & (raw_w != raw_h)
    return F.when(turned, F.lit(1)).otherwise(orientation)


def subject(faces: Column, w: Column, h: Column, least: int = 32, edge: int = 2) -> Column:
    """The face to judge a frame by (F13): large and central, away from the border if any is; the first wins ties."""
    area = lambda f: f["w"] * f["h"]

    def score(f):
        dx, dy = (f["x"] + f["w"] / 2.0) / w - 0.5, (f["y"] + f["h"] / 2.0) / h - 0.5
        return area(f) * (1 - 0.6 * F.least(F.sqrt(dx * dx + dy * dy), F.lit(1.0)))

    wide = F.filter(faces, lambda f: f["w"] >= least)
    inner = F.filter(wide, lambda f: (f["x"] > edge) & (f["y"] > edge) & (f["x"] + f["w"] < w - edge) & (f["y"] + f["h"] < h - edge))
    pool = F.when(F.size(inner) > 0, inner).otherwise(wide)
    ranked = F.array_sort(F.transform(pool, lambda f, i: F.struct((-score(f)).alias("s"), i.alias("i"), f.alias("f"))))
    return F.get(ranked, F.lit(0))["f"]


def faces_in_order(faces: Column, w: Column, h: Column) -> Column:
    """Faces as shares of the frame, the subject first and then the larger ones."""
    first = subject(faces, w, h)
    keyed = F.transform(faces, lambda f, i: F.struct((~f.eqNullSafe(first)).alias("later"), (-f["w"] * f["h"]).alias("size"), i.alias("i"), F.struct((f["x"] / w).alias("x"), (f["y"] / h).alias("y"), (f["w"] / w).alias("w"), (f["h"] / h).alias("h")).alias("f")))
    return F.transform(F.array_sort(keyed), lambda k: k["f"])


def elided(s: Column, width: int, mark: str = "…") -> Column:
    """A string of over ``width`` characters ends in ``mark`` instead; one character stays at least."""
    return F.when(F.char_length(s) <= width, s).otherwise(F.concat(F.left(s, F.lit(max(1, width - 1))), F.lit(mark)))


def display_pitch(canvas: Column, display: Column, dot: float = 4.0, least: float = 2.5) -> Column:
    """The screen's pitch in canvas pixels for a dot of ``dot`` pixels on display; null for sizes that aren't positive."""
    scale = F.greatest(canvas.cast("double") / F.when(display > 0, display), F.lit(1.0))
    return F.when((canvas > 0) & (display > 0), F.greatest(F.lit(least), dot * scale))


def preview_share(w: Column, h: Column, raw_w: Column, raw_h: Column, subsampled: Column) -> Column:
    """The share of the frame that the best preview has; 0 where a size is unknown or the raw data is subsampled."""
    area = (F.coalesce(raw_w, F.lit(0)) * F.coalesce(raw_h, F.lit(0))).cast("double")
    share = (w * h).cast("double") / F.when(area > 0, area)
    return F.when(F.coalesce(subsampled, F.lit(False)), 0.0).otherwise(F.coalesce(share, F.lit(0.0)))


# Latin letters for Cyrillic ones, and plain signs for typographic ones.
LETTERS = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "zh", "з": "z", "и": "i", "й": "y",
    "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f",
    "х": "h", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "sch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya",
}
SIGNS = {"«": '"', "»": '"', "„": '"', "“": '"', "”": '"', "‘": "'", "’": "'", "—": "-", "–": "-", "‑": "-", "−": "-", "…": "...", "×": "x", "→": "->", "№": "N", "•": "*", "\u00a0": " ", "─": "-"}
STYLES = ("bold", "regular", "medium", "semibold", "light", "black", "italic")


def folding() -> tuple[str, str, dict[str, str]]:
    """(from, to) for single characters, and a table for those that become several; both cases of letters."""
    table = LETTERS | {k.upper(): v.capitalize() for k, v in LETTERS.items() if v} | SIGNS
    single = {k: v for k, v in table.items() if len(v) == 1}
    gone = "".join(k for k, v in table.items() if not v)
    return "".join(single) + gone, "".join(single.values()), {k: v for k, v in table.items() if len(v) > 1}


def folded(s: Column) -> Column:
    """Cyrillic and typography in ASCII; other characters stay."""
    source, target, several = folding()
    s = F.translate(s, source, target)
    for k, v in several.items():
        s = F.replace(s, F.lit(k), F.lit(v))
    return s


def status_tag(error: Column, skipped: Column, recipe: Column, share: Column, by_raw: Column, least: float = 0.4) -> Column:
    """Skipped, error, warn or ok; an unknown share warns of nothing."""
    small = (share > 0) & (share < least)
    return F.when(skipped, "skipped").when(error.isNotNull(), "error").when(recipe | small | by_raw, "warn").otherwise("ok")


def short_family(family: Column) -> Column:
    """A font's family without the names of styles behind it; its first word stays."""
    words = F.trim(F.regexp_replace(F.coalesce(family, F.lit("")), r"\s+", " "))
    return F.regexp_replace(words, rf"(?i)(?<=\S)( ({'|'.join(STYLES)}))+$", "")


def plain_key(s: Column) -> Column:
    """Letters and digits alone, in lower case."""
    return F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}]+", "")


def path_key(path: Column, folds: bool = True) -> Column:
    """What two spellings of a path share: doubled and trailing slashes, ``.``, and case where the volume folds it.

    Destinations fold (a needless rename costs a name), inputs don't (a needless merge loses a file).
    """
    p = F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"/(\./)+", "/"), r"//+", "/"), r"(?<=.)/\.?$", "")
    return F.lower(p) if folds else p


def share_setting(json: Column, key: str, default: float) -> Column:
    """A percentage in a JSON text as 0..1, clamped; the default where it is missing or no number."""
    v = F.get_json_object(json, f"$.{key}").try_cast("double")
    known = v.isNotNull() & ~F.isnan(v)
    return F.when(known, F.least(F.greatest(v, F.lit(0.0)), F.lit(100.0)) / 100).otherwise(F.lit(default))


def smoothstep(x: Column, low: float, high: float) -> Column:
    """0 to 1 without corners; null for null."""
    t = F.least(F.greatest((x - low) / (high - low), F.lit(0.0)), F.lit(1.0))
    return F.when(x.isNotNull(), t * t * (3 - 2 * t))


def exposure(median: Column, strength: Column, mid: tuple = (0.46, 0.58), lift: float = 2.0, darken: float = -0.15) -> Column:
    """The curve parameter that moves a median to the middle band; null for null."""
    goal = median + (F.least(F.greatest(median, F.lit(mid[0])), F.lit(mid[1])) - median) * strength
    return F.when(median < 1e-3, strength * lift).when(median.isNotNull(), F.least(F.greatest((goal - median) / (median * (1 - goal)), F.lit(darken)), F.lit(lift)))
