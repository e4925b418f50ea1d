"""Per-shot colour: letterbox crop, pixel sampling, lightness, key label and palette."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from filmgrain.config import Chromatic, LightingKey
from filmgrain.functions.colour import hex_code, lab, lab_to_rgb, near_black
from filmgrain.functions.numeric import clip, dbl
from filmgrain.operators.ordered import parts_for, spread, with_row_number
from filmgrain.session import stored


def with_lab(pixels: DataFrame) -> DataFrame:
    return pixels.withColumns(lab(F.col("r"), F.col("g"), F.col("b")))


def _kept_rows(bounds: DataFrame, frame: list[str], *columns: str) -> DataFrame:
    """One row per kept pixel row, so pixels join on frame and row: the row test becomes
    part of the key and a frame with very many pixels is spread over its rows."""
    open_frames = bounds.where(F.col("top").isNotNull())
    return open_frames.select(*frame, *columns, F.explode(F.sequence("top", "bottom")).alias("row_i"))


_LINES = ("top", "bottom", "total_pixels")


def _open(line: str, cfg: Chromatic) -> Column:
    """The line's number unless it is a bar."""
    return F.when(F.col("_dark") / F.col("_n") < cfg.letterbox_coverage, F.col(line))


def _column_lines(pixels: DataFrame, frame: list[str], cfg: Chromatic, *held: Column) -> DataFrame:
    """One row per frame and column inside the kept rows: pixels, near-black pixels, ``held`` aggregates, and
    the frame's top, bottom and pixel count. A frame that is all bar keeps its rows, so it isn't lost."""
    near = near_black(F.col("r"), F.col("g"), F.col("b"), cfg.letterbox_lstar_max).cast("int")
    rows = pixels.groupBy(*frame, "row_i").agg(F.count(F.lit(1)).alias("_n"), F.sum(near).alias("_dark"))
    rows = rows.groupBy(*frame).agg(
        F.min(_open("row_i", cfg)).alias("top"), F.max(_open("row_i", cfg)).alias("bottom"), F.sum("_n").alias("total_pixels"), F.min("row_i").alias("_first"), F.max("row_i").alias("_last"))
    kept = F.sequence(F.coalesce("top", "_first"), F.coalesce("bottom", "_last"))
    tall = spread(pixels, parts_for(pixels), *frame, "row_i")
    inside = tall.join(rows.select(*frame, *_LINES, F.explode(kept).alias("row_i")), [*frame, "row_i"])
    return inside.groupBy(*frame, *_LINES, "col_i").agg(F.count(F.lit(1)).alias("_n"), F.sum(near).alias("_dark"), *held)


def _seen(edge: Column) -> Column:
    return F.when(F.col("top").isNotNull(), edge)


def picture_bounds(pixels: DataFrame, frame: list[str], cfg: Chromatic = Chromatic()) -> DataFrame:
    """Rows and columns left after peeling near-black bars off each frame's border, with
    the frame's pixel count and the pixels inside the picture.

    Peeling stops at the first line that is not a bar, so an edge is the least (or
    greatest) such line. Columns are judged inside the kept rows. Frames that are all bar
    keep null bounds. Only sums per line are shuffled, and the pixel counts come from the
    same sums: pixels are read once for rows and once for columns.
    """
    columns = _column_lines(pixels, frame, cfg)
    # Columns are few, so their edges and the sum between them come from one small list.
    packed = F.collect_list(F.struct("col_i", "_n"))
    edges = columns.groupBy(*frame, *_LINES).agg(
        _seen(F.min(_open("col_i", cfg))).alias("left"), _seen(F.max(_open("col_i", cfg))).alias("right"), packed.alias("_cols"))
    held = F.aggregate("_cols", F.lit(0).cast("bigint"), lambda t, c: t + F.when(c["col_i"].between(F.col("left"), F.col("right")), c["_n"]).otherwise(F.lit(0)))
    return edges.select(*frame, *_LINES, "left", "right", held.alias("kept_pixels"))


def framed_columns(pixels: DataFrame, frame: list[str], cfg: Chromatic = Chromatic()) -> DataFrame:
    """One row per frame and column inside the kept rows, with the frame's bounds as in ``picture_bounds`` and the
    colours of the column's pixels as a list, which the picture's height bounds.

    Bounds, pixel counts (``frame_bounds``) and counted colours (``framed_colours``) all come from
    this one table: pixels are read for rows and for columns, and not again. Edges are told to a frame's columns by a
    window over the few columns of a frame.
    """
    whole = Window.partitionBy(*frame)
    columns = spread(_column_lines(pixels, frame, cfg, F.collect_list(F.struct("r", "g", "b")).alias("colours")), parts_for(pixels), *frame)
    columns = columns.withColumns({"left": _seen(F.min(_open("col_i", cfg)).over(whole)), "right": _seen(F.max(_open("col_i", cfg)).over(whole))})
    inside = F.coalesce(F.col("col_i").between(F.col("left"), F.col("right")), F.lit(False))
    columns = columns.withColumn("inside", inside)
    return columns.withColumn("kept_pixels", F.sum(F.when(F.col("inside"), F.col("_n")).otherwise(0)).over(whole)).drop("_dark", "_n")


def frame_bounds(columns: DataFrame, frame: list[str]) -> DataFrame:
    """``picture_bounds`` from ``framed_columns``."""
    return columns.select(*frame, *_LINES, "left", "right", "kept_pixels").distinct()


def framed_colours(columns: DataFrame, key: str = "shot_id", parts: int | None = None) -> DataFrame:
    """Counted colours (``colour_counts``) of all pixels inside the picture, from ``framed_columns``."""
    return colour_counts(columns.where("inside").select(key, F.explode("colours").alias("_c")).select(key, "_c.*"), key, parts)


def crop(pixels: DataFrame, bounds: DataFrame, frame: list[str]) -> DataFrame:
    """Pixels inside the picture of their frame."""
    rows = _kept_rows(bounds, frame, "left", "right")
    return pixels.join(rows, [*frame, "row_i"]).where(F.col("col_i").between(F.col("left"), F.col("right"))).select(pixels.columns)


def usable_pixels(bounds: DataFrame, by: str = "shot_id") -> DataFrame:
    """Kept and total pixels and frame count of each shot."""
    return bounds.groupBy(by).agg(
        F.sum("kept_pixels").alias("kept_pixels"), F.sum("total_pixels").alias("total_pixels"), F.count(F.lit(1)).alias("decoded_frames"))


def spread_pixels(pixels: DataFrame, key: str, order: list[str], chunk: Column, max_rows: int) -> DataFrame:
    """Systematic sample: positions floor(i * n / max) of each shot's pixel order.

    Positions come from chunk counts, so a shot with any number of pixels is ranked by
    many tasks. What is left is at most ``max_rows`` per shot.
    """
    df = with_row_number(pixels, [key], order, chunk, "_pos", "_n")
    step = F.col("_n") / dbl(max_rows)
    near = F.ceil(F.col("_pos") / step)

    def lands(d: int) -> Column:
        k = near + d
        return (k >= 0) & (k < max_rows) & (F.floor(k * step) == F.col("_pos"))

    keep = F.when(F.col("_n") <= max_rows, F.lit(True)).otherwise(lands(-1) | lands(0) | lands(1))
    return df.where(keep).drop("_pos", "_n")


def colour_counts(pixels: DataFrame, key: str = "shot_id", parts: int | None = None) -> DataFrame:
    """Different colours of each shot with their pixels ``n`` and Lab values: every pixel counts, and
    what follows sees at most the 2^24 colours that 8-bit pixels can have. ``parts`` brings a shot's colours
    together once for lightness and palette (``ordered.spread``)."""
    return with_lab(spread(pixels.groupBy(key, "r", "g", "b").agg(F.count(F.lit(1)).alias("n")), parts, key))


def lightness(colours: DataFrame, key: str = "shot_id", cfg: Chromatic = Chromatic()) -> DataFrame:
    """Lightness distribution over all pixels behind the counted ``colours`` of each shot.

    The tones of a shot are run through in order with the pixels before each, so ranks and sums come from one
    shuffle. A shot has at most the 2^24 colours of 8-bit pixels, and the sort may spill.
    """
    shot = Window.partitionBy(key)
    tone, n, total, after = F.col("_tone"), F.col("n"), F.col("_total"), F.col("_after")
    tones = colours.select(key, "n", clip(F.col("lstar"), 0, 100).alias("_tone")).withColumns({
        "_after": F.sum("n").over(shot.orderBy("_tone").rowsBetween(Window.unboundedPreceding, 0)), "_total": F.sum("n").over(shot)})
    marks = {}
    for name, q in (("p10_lstar", 0.1), ("p50_lstar", 0.5), ("p90_lstar", 0.9)):
        at = dbl(q) * (total - 1)
        for side, rank in (("_low", F.floor(at)), ("_high", F.ceil(at))):
            marks[name + side] = F.max(F.when((after - n <= rank) & (rank < after), tone)).alias(name + side)
        marks[name + "_part"] = F.max(at - F.floor(at)).alias(name + "_part")
    sums = tones.groupBy(key).agg(
        F.sum("n").alias("_n"), F.sum(tone * n).alias("_s"), F.sum(tone * tone * n).alias("_q"),
        F.sum(F.when(tone < cfg.shadow_lstar, n).otherwise(0)).alias("_dark"), F.sum(F.when(tone > cfg.highlight_lstar, n).otherwise(0)).alias("_bright"), *marks.values())
    mean = F.col("_s") / F.col("_n")
    spread = F.col("_q") / F.col("_n") - mean * mean
    # Equal tones leave a rest of rounding; one odd pixel in a billion would leave more.
    spread = F.when(spread > dbl(1e-10), F.sqrt(spread)).otherwise(dbl(0))

    def mark(name: str) -> Column:
        low, high = F.col(name + "_low"), F.col(name + "_high")
        return (low + F.col(name + "_part") * (high - low)).alias(name)

    return sums.select(
        key, mean.alias("mean_lstar"), spread.alias("stddev_lstar"), mark("p10_lstar"), mark("p50_lstar"), mark("p90_lstar"),
        (F.col("_dark") / F.col("_n")).alias("shadow_ratio"), (F.col("_bright") / F.col("_n")).alias("highlight_ratio"))


def lighting_key(rules: LightingKey = LightingKey()) -> Column:
    mid, spread, dark = F.col("p50_lstar"), F.col("p90_lstar") - F.col("p10_lstar"), F.col("shadow_ratio")
    low = (mid < rules.low_median_lstar) & ((spread > rules.low_spread_lstar) | (dark > rules.low_shadow_ratio))
    high = (mid > rules.high_median_lstar) & (dark < rules.high_shadow_ratio) & (spread < rules.high_spread_lstar)
    return F.when(low, "LOW_KEY_ESTIMATE").when(high, "HIGH_KEY_ESTIMATE").otherwise("BALANCED_ESTIMATE")


def lighting_confidence(label: Column, rules: LightingKey = LightingKey()) -> Column:
    mid, spread, dark = F.col("p50_lstar"), F.col("p90_lstar") - F.col("p10_lstar"), F.col("shadow_ratio")

    def bonus(cond: Column) -> Column:
        return F.when(cond, dbl(0.15)).otherwise(dbl(0))

    low = dbl(0.45) + dbl(0.4) * (dbl(rules.low_median_lstar) - mid) / dbl(max(rules.low_median_lstar, 1.0))
    low = low + bonus(spread > rules.low_spread_lstar) + bonus(dark > rules.low_shadow_ratio)
    high = dbl(0.5) + dbl(0.4) * (mid - dbl(rules.high_median_lstar)) / dbl(max(100.0 - rules.high_median_lstar, 1.0))
    gap = F.least(F.abs(mid - dbl(rules.low_median_lstar)), F.abs(mid - dbl(rules.high_median_lstar)))
    return clip(
        F.when(label == "LOW_KEY_ESTIMATE", low).when(label == "HIGH_KEY_ESTIMATE", high)
        .otherwise(dbl(0.35) + gap / dbl(80))
    )


def colour_status(cfg: Chromatic = Chromatic()) -> dict[str, Column]:
    """Status and reason from requested/decoded frames, pixel counts and swatch count."""
    share = F.when(F.col("total_pixels") > 0, F.col("kept_pixels") / F.when(F.col("total_pixels") > 0, F.col("total_pixels"))).otherwise(dbl(0))
    none_asked = F.col("requested_frames") <= 0
    undecoded = F.col("decoded_frames") <= 0
    barred, empty = share < cfg.min_usable_pixel_ratio, F.col("kept_pixels") <= 0
    no_swatch = F.col("swatches") <= 0
    return {
        "usable_pixel_ratio": share,
        "status": F.when(none_asked, "INSUFFICIENT_DATA").when(undecoded, "FAILED")
        .when(barred | empty, "INSUFFICIENT_DATA").when(no_swatch, "FAILED").otherwise("OK"),
        "reason_code": F.when(none_asked, "chromatic_no_decoded_samples").when(undecoded, "chromatic_decode_failed")
        .when(barred, "chromatic_letterbox_insufficient").when(empty, "chromatic_no_usable_pixels")
        .when(no_swatch, "chromatic_cluster_failed"),
    }


# --- palette -----------------------------------------------------------------

def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each point, in blocks so memory stays small."""
    return np.concatenate([((points[i:i + 65_536, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1) for i in range(0, len(points), 65_536)])


def _cluster(points: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Weighted k-means with a farthest-point start: heaviest colour first, then the colour
    farthest from those chosen. Runs until the assignment stands still; the spread falls with every
    round, so that comes about."""
    chosen = [int(np.argmax(weight))]
    gap = ((points - points[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < k:
        chosen.append(int(np.argmax(gap)))
        gap = np.minimum(gap, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    centres, label = points[chosen].astype(float), None
    while True:
        nearest = _nearest(points, centres)
        if label is not None and (nearest == label).all():
            return centres, np.bincount(label, weight, k)
        label = nearest
        mass = np.bincount(label, weight, k)
        for d in range(3):
            total = np.bincount(label, weight * points[:, d], k)
            centres[:, d] = np.where(mass > 0, total / np.maximum(mass, 1), centres[:, d])


def palette_centres(colours: DataFrame, key: str = "shot_id", clusters: int = 5) -> DataFrame:
    """At most ``clusters`` colour centres of each shot with the pixels behind each, from its
    counted colours (``colour_counts``), whose number 8-bit pixels bound."""
    key_type = colours.schema[key].dataType.simpleString()
    lab3 = ("lstar", "a_star", "b_star")
    colours = colours.groupBy(key, *[F.round(c, 3).alias(c) for c in lab3]).agg(F.sum("n").alias("n"))

    def fit(group: pa.Table) -> pa.Table:
        points = np.column_stack([group[c].to_numpy() for c in lab3])
        order = np.lexsort(points.T[::-1])
        centres, n = _cluster(points[order], group["n"].to_numpy()[order].astype(float), min(clusters, len(points)))
        held = np.rint(n).astype("int64")
        some = held > 0
        keys = group[key].take(np.zeros(some.sum(), dtype="int64"))
        return pa.table({key: keys, **{c: centres[some, i] for i, c in enumerate(lab3)}, "n": held[some]})

    # Shots are many and small: a table of Arrow arrays a shot costs a fraction of a frame.
    return colours.groupBy(key).applyInArrow(fit, f"{key} {key_type}, lstar double, a_star double, b_star double, n bigint")


def merge_centres(centres: DataFrame, key: str = "shot_id", delta_e: float = 3.0) -> DataFrame:
    """Fold each shot's few centres, heaviest first, into the first one closer than
    ``delta_e``, as a count-weighted mean. ``ord`` keeps their order."""
    item = F.struct((-F.col("n")).alias("neg"), "lstar", "a_star", "b_star", "n")
    kind = "array<struct<lstar:double,a_star:double,b_star:double,n:bigint>>"

    def pack(c: Column) -> Column:
        return F.struct(c["lstar"].alias("lstar"), c["a_star"].alias("a_star"), c["b_star"].alias("b_star"), c["n"].alias("n"))

    def step(kept: Column, c: Column) -> Column:
        def far(m: Column) -> Column:
            parts = [m[x] - c[x] for x in ("lstar", "a_star", "b_star")]
            return F.sqrt(parts[0] * parts[0] + parts[1] * parts[1] + parts[2] * parts[2])

        at = F.array_position(F.transform(kept, lambda m: far(m) < delta_e), True)

        def blend(m: Column) -> Column:
            total = m["n"] + c["n"]
            mixed = [((m[x] * m["n"] + c[x] * c["n"]) / total).alias(x) for x in ("lstar", "a_star", "b_star")]
            return F.struct(*mixed, total.alias("n"))

        merged = F.transform(kept, lambda m, i: F.when(i + 1 == at, blend(m)).otherwise(m))
        return F.when(at > 0, merged).otherwise(F.concat(kept, F.array(pack(c))))

    listed = centres.where("n > 0").groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("_c"))
    folded = F.aggregate("_c", F.array().cast(kind), lambda kept, c: step(kept, c).cast(kind))
    return listed.select(key, F.posexplode(folded).alias("ord", "_m")).select(key, "ord", "_m.*")


def with_swatch_colour(centres: DataFrame) -> DataFrame:
    rgb = lab_to_rgb(F.col("lstar"), F.col("a_star"), F.col("b_star"))
    return centres.withColumns(rgb).withColumns({
        "lstar": clip(F.col("lstar"), 0, 100), "a_star": clip(F.col("a_star"), -128, 127), "b_star": clip(F.col("b_star"), -128, 127),
        "hex": hex_code(F.col("r"), F.col("g"), F.col("b")),
    })


def merge_equal_hex(swatches: DataFrame, key: str = "shot_id", order: str = "ord") -> DataFrame:
    """One swatch per shot and hex, counts added. Of swatches in ``order``, a later one gives its
    centre when it is heavier than all before it together. A shot has few swatches, so a list holds them."""
    item = F.struct(order, "n", "lstar", "a_star", "b_star")
    listed = swatches.groupBy(key, "hex").agg(F.array_sort(F.collect_list(item)).alias("_c"))
    kind = "struct<n:bigint,lstar:double,a_star:double,b_star:double>"

    def fold(held: Column, c: Column) -> Column:
        stays = held["n"] >= c["n"]
        centre = [F.when(stays, held[x]).otherwise(c[x]).alias(x) for x in ("lstar", "a_star", "b_star")]
        return F.struct((F.greatest(held["n"], F.lit(0).cast("bigint")) + c["n"]).alias("n"), *centre).cast(kind)

    none = F.lit(None).cast("double")
    start = F.struct(F.lit(-1).cast("bigint").alias("n"), none.alias("lstar"), none.alias("a_star"), none.alias("b_star")).cast(kind)
    return listed.select(key, "hex", F.aggregate("_c", start, fold).alias("_m")).select(key, "hex", "_m.lstar", "_m.a_star", "_m.b_star", "_m.n")


def rank_swatches(swatches: DataFrame, key: str = "shot_id", min_share: float = 0.02) -> DataFrame:
    """Drop tiny swatches (the first always stays), rank by count then hex; proportions
    add up to one because the last takes what remains. At most five rows a shot here."""
    whole = Window.partitionBy(key)
    order = whole.orderBy(F.col("n").desc(), "hex")
    floor_n = F.greatest(F.lit(1), F.floor(dbl(min_share) * F.sum("n").over(whole)))
    kept = swatches.withColumns({"rank": F.row_number().over(order), "_min": floor_n}).where("n >= _min or rank = 1")
    share = F.col("n") / F.sum("n").over(whole)
    before = F.coalesce(F.sum("_share").over(order.rowsBetween(Window.unboundedPreceding, -1)), dbl(0))
    kept = kept.withColumns({"rank": F.row_number().over(order), "_of": F.count(F.lit(1)).over(whole), "_share": share})
    last = clip(dbl(1) - before)
    return kept.withColumn("proportion", F.when(F.col("rank") == F.col("_of"), last).otherwise(F.col("_share"))).drop("_min", "_of", "_share")


def palette(colours: DataFrame, key: str = "shot_id", cfg: Chromatic = Chromatic()) -> DataFrame:
    """Ranked palette rows of every shot from its counted colours."""
    centres = merge_centres(palette_centres(colours, key, cfg.clusters), key, cfg.delta_e_merge)
    return rank_swatches(merge_equal_hex(with_swatch_colour(centres), key), key, cfg.min_swatch_proportion)


def shot_colour(pixels: DataFrame, frame: list[str], shots: DataFrame, cfg: Chromatic = Chromatic(), key: str = "shot_id") -> tuple[DataFrame, DataFrame]:
    """Colour values of every shot and the palette rows of the shots that have values.

    ``pixels``: key, frame columns, row_i, col_i, r, g, b. ``shots``: key and requested_frames, one row a
    shot. A shot without pixels keeps its row with a status; values and swatches are given only under
    status OK. All pixels inside the picture count. What bounds, lightness and palette share, the columns of each
    frame with their colours, is stored once in the session's work folder.
    """
    columns = stored(framed_columns(pixels, frame, cfg))
    counts = shots.select(key, "requested_frames").join(usable_pixels(frame_bounds(columns, frame), key), key, "left").fillna(
        {"kept_pixels": 0, "total_pixels": 0, "decoded_frames": 0})
    colours = framed_colours(columns, key, parts_for(pixels))
    swatches = palette(colours, key, cfg)
    light = lightness(colours, key, cfg)
    held = swatches.groupBy(key).agg(F.count(F.lit(1)).alias("swatches"))
    values = counts.join(light, key, "left").join(held, key, "left").fillna({"swatches": 0}).withColumns(colour_status(cfg))
    fine = F.col("status") == "OK"
    values = values.withColumn("lighting_key", F.when(fine, lighting_key(cfg.lighting_key_rules)))
    values = values.withColumn("confidence", F.when(fine, lighting_confidence(F.col("lighting_key"), cfg.lighting_key_rules)))
    values = values.withColumns({c: F.when(fine, F.col(c)) for c in light.columns if c != key})
    # A shot with swatches needs only its counts to be judged, so the palette isn't worked out twice.
    judged = counts.withColumn("swatches", F.lit(1)).withColumns(colour_status(cfg)).where(fine)
    return values, swatches.join(judged.select(key), key, "left_semi")
