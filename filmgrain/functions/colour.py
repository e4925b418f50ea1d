"""sRGB, CIE L*a*b* (D65), hexadecimal and marker-colour expressions for 8-bit channels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from filmgrain.functions.numeric import clip, dbl

# sRGB primaries with the D65 white point (published standard).
RGB_TO_XYZ = (
    (0.412453, 0.357580, 0.180423),
    (0.212671, 0.715160, 0.072169),
    (0.019334, 0.119193, 0.950227),
)
XYZ_TO_RGB = (
    (3.240479, -1.537150, -0.498535),
    (-0.969256, 1.875991, 0.041556),
    (0.055648, -0.204043, 1.057311),
)
WHITE_X, WHITE_Z = 0.950456, 1.088754
LINEAR_BELOW = 0.008856


def _linear(channel: Column) -> Column:
    """Linear light of an 8-bit channel, read from a constant built by the sRGB rule."""
    levels = [i / 255.0 for i in range(256)]
    table = [c / 12.92 if c <= 0.04045 else ((c + 0.055) / 1.055) ** 2.4 for c in levels]
    return F.element_at(F.array(*[F.lit(t) for t in table]), (channel + 1).cast("int"))


def _weigh(row, x, y, z) -> Column:
    return dbl(row[0]) * x + dbl(row[1]) * y + dbl(row[2]) * z


def _bend(t: Column) -> Column:
    return F.when(t > LINEAR_BELOW, F.cbrt(t)).otherwise(dbl(7.787) * t + dbl(16) / dbl(116))


def luminance(r: Column, g: Column, b: Column) -> Column:
    return _weigh(RGB_TO_XYZ[1], _linear(r), _linear(g), _linear(b))


def near_black(r: Column, g: Column, b: Column, lstar_max: float) -> Column:
    """L* at or below a limit, tested on luminance so no root is taken per pixel."""
    limit = lstar_max / 903.3 if lstar_max <= 903.3 * LINEAR_BELOW else ((lstar_max + 16.0) / 116.0) ** 3
    return luminance(r, g, b) <= dbl(limit)


def lab(r: Column, g: Column, b: Column) -> dict[str, Column]:
    """L* in 0..100 with a* and b* unscaled."""
    lr, lg, lb = _linear(r), _linear(g), _linear(b)
    x = _weigh(RGB_TO_XYZ[0], lr, lg, lb) / dbl(WHITE_X)
    y = _weigh(RGB_TO_XYZ[1], lr, lg, lb)
    z = _weigh(RGB_TO_XYZ[2], lr, lg, lb) / dbl(WHITE_Z)
    light = F.when(y > LINEAR_BELOW, dbl(116) * F.cbrt(y) - dbl(16)).otherwise(dbl(903.3) * y)
    return {
        "lstar": light,
        "a_star": dbl(500) * (_bend(x) - _bend(y)),
        "b_star": dbl(200) * (_bend(y) - _bend(z)),
    }


def _unbend(f: Column) -> Column:
    low = (f - dbl(16) / dbl(116)) / dbl(7.787)
    return F.when(f > F.cbrt(dbl(LINEAR_BELOW)), f * f * f).otherwise(low)


def _encode(channel: Column) -> Column:
    c = clip(channel)
    bent = F.when(c <= 0.0031308, c * dbl(12.92)).otherwise(
        dbl(1.055) * F.pow(c, dbl(1) / dbl(2.4)) - dbl(0.055)
    )
    return clip(F.rint(bent * dbl(255)), 0, 255).cast("int")


def lab_to_rgb(lstar: Column, a: Column, b: Column) -> dict[str, Column]:
    fy = (lstar + dbl(16)) / dbl(116)
    y = F.when(lstar > 903.3 * LINEAR_BELOW, fy * fy * fy).otherwise(lstar / dbl(903.3))
    fy = F.when(lstar > 903.3 * LINEAR_BELOW, fy).otherwise(dbl(7.787) * y + dbl(16) / dbl(116))
    x = _unbend(fy + a / dbl(500)) * dbl(WHITE_X)
    z = _unbend(fy - b / dbl(200)) * dbl(WHITE_Z)
    return {k: _encode(_weigh(row, x, y, z)) for k, row in zip("rgb", XYZ_TO_RGB)}


def hex_code(r: Column, g: Column, b: Column) -> Column:
    return F.format_string("#%02X%02X%02X", r.cast("int"), g.cast("int"), b.cast("int"))


def is_marker_colour(r: Column, g: Column, b: Column) -> Column:
    """Magenta used by the colour-blob subject finder: hue 130..170 on the half-degree
    scale, saturation and value from 80 of 255, each rounded half to even.

    The rounded bounds are hue 259..341 degrees and saturation from 79.5, so the test is
    whole-number arithmetic on the channels: blue on top with enough red, or red on top
    with enough blue.
    """
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span = top - low
    hue = F.when(r == top, (b - g) * 60 >= span * 19).when(g == top, F.lit(False)).otherwise((r - g) * 60 >= span * 19)
    return (span > 0) & hue & (span * 510 >= top * 159) & (top >= 80)
