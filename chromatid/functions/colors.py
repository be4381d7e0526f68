"""Colors: normal forms, distances, contrast, confidence. Colors are strings; their channels are doubles of 0 to 255."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of colors that are understood.
NAMED_COLORS = {
    "red": "#ff0000", "green": "#008000", "blue": "#0000ff", "white": "#ffffff", "black": "#000000", "gray": "#808080", "grey": "#808080", "orange": "#ffa500",
    "yellow": "#ffff00", "purple": "#800080", "pink": "#ffc0cb", "cyan": "#00ffff", "magenta": "#ff00ff", "rebeccapurple": "#663399", "dodgerblue": "#1e90ff",
    "tomato": "#ff6347", "coral": "#ff7f50", "gold": "#ffd700", "silver": "#c0c0c0", "navy": "#000080", "teal": "#008080", "maroon": "#800000", "olive": "#808000",
    "transparent": "#00000000",
}
# The largest distances that scores divide by, and the contrast that text needs.
MAX_DISTANCE, FIX_DISTANCE, MIN_CONTRAST = 441.67, 441.0, 4.5
MODES = ("suggestion", "fix", "css", "tokenize", "scanner", "import")


def _hex2(n: Column) -> Column:
    return F.lpad(F.lower(F.hex(n.cast("long"))), 2, "0")


def _doubled(c: Column) -> Column:
    return F.concat(F.lit("#"), *[F.repeat(F.substring(c, i, 1), F.lit(2)) for i in (2, 3, 4)])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _rgb(c: Column) -> tuple[Column, Column]:
    pattern = r"rgba?\s*\(\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)"
    return c.rlike(pattern), F.concat(F.lit("#"), *[_hex2(F.regexp_extract(c, pattern, i)) for i in (1, 2, 3)])


def hsl_hex(h: Column, s: Column, lightness: Column) -> Column:
    """Hex color of hue (degrees), saturation and lightness (per cent)."""
    s, light = s / 100, lightness / 100
    c = (1 - F.abs(2 * light - 1)) * s
    x = c * (1 - F.abs(h / 60 % 2 - 1))
    m = light - c / 2
    zero = F.lit(0.0)
    sector = F.least(F.floor(h / 60), F.lit(5))

    def channel(*by_sector: Column) -> Column:
        value = F.element_at(F.array(*by_sector), (sector + 1).cast("int"))
        return _hex2(F.floor((value + m) * 255 + 0.5))

    return F.concat(F.lit("#"), channel(c, x, zero, zero, x, c), channel(x, c, c, x, zero, zero), channel(zero, zero, x, c, c, x))


def normal_color(color: Column, mode: str = "suggestion") -> Column:
    """A color in the form that one use compares: lower-case #rrggbb where the mode understands it.

    suggestion: hex of 3, 6 or 8 digits (alpha dropped), rgb(a), hsl(a), names, else null. fix: hex, rgb(a), else unchanged.
    css: hex, rgb, names, else unchanged. tokenize: names, hex of 3 digits widened, else unchanged. scanner: lower case. import: hex of 3 digits
    widened, lower case.
    """
    if mode not in MODES:
        raise ValueError(f"mode {mode!r} isn't one of {MODES}")
    c = F.lower(F.trim(color))
    if mode == "scanner":
        return F.lower(color)
    out = F.when(c.rlike("^#[0-9a-f]{3}$"), _doubled(c))
    if mode == "import":
        return out.otherwise(c)
    names = F.create_map(*[F.lit(x) for pair in NAMED_COLORS.items() for x in pair])
    if mode in ("suggestion", "fix", "css"):
        is_rgb, rgb = _rgb(c)
        out = out.when(c.rlike("^#[0-9a-f]{6}$"), c).when(c.rlike("^#[0-9a-f]{8}$"), F.substring(c, 1, 7)).when(is_rgb, rgb)
    if mode == "suggestion":
        hsl = r"hsla?\s*\(\s*(\d+)\s*,\s*(\d+)%\s*,\s*(\d+)%(?:\s*,\s*[\d.]+)?\s*\)"
        parts = F.struct(*[F.regexp_extract(c, hsl, i).cast("double").alias(k) for k, i in (("h", 1), ("s", 2), ("l", 3))])
        out = out.when(c.rlike(hsl), let(parts, lambda x: hsl_hex(x["h"], x["s"], x["l"])))
    if mode in ("suggestion", "css", "tokenize"):
        out = out.when(names[c].isNotNull(), names[c])
    return out if mode == "suggestion" else out.otherwise(c)


def channels(color: Column) -> Column:
    """struct(r, g, b) of #rrggbb, in doubles; null for anything else."""
    part = lambda i: F.conv(F.substring(color, i, 2), 16, 10).cast("double")
    return F.when(color.rlike("(?i)^#[0-9a-f]{6}$"), F.struct(part(2).alias("r"), part(4).alias("g"), part(6).alias("b")))


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two channel structs; null if either is null."""
    return F.sqrt(sum(((a[k] - b[k]) * (a[k] - b[k]) for k in ("g", "b")), (a["r"] - b["r"]) * (a["r"] - b["r"])))


def similarity(a: Column, b: Column) -> Column:
    """1 - distance / the largest; 0 where a color isn't #rrggbb."""
    return F.coalesce(1 - distance(channels(a), channels(b)) / MAX_DISTANCE, F.lit(0.0))


def fix_distance(a: Column, b: Column) -> Column:
    """Distance in per cent of the largest; 100 where a color isn't #rrggbb."""
    return F.coalesce(distance(channels(a), channels(b)) / FIX_DISTANCE * 100, F.lit(100.0))


def differing_digits(a: Column, b: Column) -> Column:
    """Number of hex digits in which two colors of six differ; null where one hasn't six."""
    x, y = (F.replace(F.lower(c), F.lit("#"), F.lit("")) for c in (a, b))
    count = sum((F.when(F.substring(x, i, 1) != F.substring(y, i, 1), 1).otherwise(0) for i in range(2, 7)), F.when(F.substring(x, 1, 1) != F.substring(y, 1, 1), 1).otherwise(0))
    return F.when((F.char_length(x) == 6) & (F.char_length(y) == 6), count)


def luminance(color: Column) -> Column:
    """Relative luminance of #rrggbb."""
    c = channels(color)

    def linear(v: Column) -> Column:
        v = v / 255
        return F.when(v <= 0.03928, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, 2.4))

    return 0.2126 * linear(c["r"]) + 0.7152 * linear(c["g"]) + 0.0722 * linear(c["b"])


def contrast(a: Column, b: Column) -> Column:
    x, y = luminance(a), luminance(b)
    return (F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05)


def saturation(color: Column) -> Column:
    c = channels(color)
    high = F.greatest(c["r"], c["g"], c["b"])
    return F.when(high == 0, F.lit(0.0)).otherwise((high - F.least(c["r"], c["g"], c["b"])) / high)


def lightness(color: Column) -> Column:
    c = channels(color)
    return (c["r"] + c["g"] + c["b"]) / 3 / 255


def distance_confidence(d: Column) -> Column:
    """Score of replacing a color that lies d (per cent) off: 100 at 0; 98 - d to 5; 90 - 2 d, 70 at least, to 15; 70 - d, 40 at least, to 30; else 20."""
    return (
        F.when(d == 0, F.lit(100.0))
        .when(d <= 5, 98 - d)
        .when(d <= 15, F.greatest(F.lit(70.0), 90 - 2 * d))
        .when(d <= 30, F.greatest(F.lit(40.0), 70 - d))
        .otherwise(F.lit(20.0))
    )


def color_confidence(original: Column, token: Column) -> Column:
    """Score of replacing a color by a token's; equal texts that are no colors score 100 as well."""
    pair = F.struct(normal_color(original, "fix").alias("a"), F.lower(token).alias("b"))
    off = let(pair, lambda x: F.when(x["a"] == x["b"], F.lit(0.0)).otherwise(fix_distance(x["a"], x["b"])))
    return let(off, distance_confidence)


def confidence_level(score: Column) -> Column:
    return F.when(score >= 100, "exact").when(score >= 95, "high").when(score >= 70, "medium").otherwise("low")
