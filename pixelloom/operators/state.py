"""What each pixel showed, and for how long: colour times in bins, images, references.

Everything starts from state intervals: a pixel of a composition keeps a colour from one change to the next. Only intervals that touch a bin make rows, so
the tables grow with changes and bins, not with their product for every colour.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pixelloom.operators.changes import TIME, with_neighbours

PIXEL = ["comp_id", "x", "y"]


def last_image(log: DataFrame, at: float, white: int, pixels: DataFrame) -> DataFrame:
    """`(x, y, color)` of the given pixels just before `at`; white where nothing was set."""
    last = log.where(F.col("seconds") < at).groupBy("x", "y").agg(F.max_by("color", F.struct(*TIME)).alias("color"))
    return pixels.select("x", "y").distinct().join(last, ["x", "y"], "left").select("x", "y", F.coalesce("color", F.lit(white)).alias("color"))


def intervals(log: DataFrame, pixels: DataFrame, white: int, opened: Column) -> DataFrame:
    """`(comp_id, x, y, color, beg, end, t0, t1)`: each stay of a colour within the composition's life.

    All changes count, active or not. The first colour is that of the last change strictly before t0. `opened` is the time at which the pixel's canvas section opens; the clock
    starts there. Changes exactly at t0 belong to no bin and are left out.
    """
    placed = with_neighbours(log.select("x", "y", "color", *TIME))
    return stays_of(placed, first_stays(placed, pixels, white), pixels, opened)


def _lives(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy(*PIXEL).agg(F.min("t0").alias("t0"), F.max("t1").alias("t1"))


def first_stays(log: DataFrame, pixels: DataFrame, white: int) -> DataFrame:
    """`(comp_id, x, y, t0, t1, color, seconds, next)`: a row for each pixel of a composition, its colour at t0 and the time of its first change after that. log: of `with_neighbours`.

    Of a pixel's changes, only the last before t0, those at t0 and a first one after t0 tell; these are few.
    """
    life = _lives(pixels)
    s, after = F.col("seconds"), F.col("next")
    around = ((s <= F.col("t0")) & F.coalesce(after >= F.col("t0"), F.lit(True))) | ((s > F.col("t0")) & F.col("since").isNull())
    known = life.join(log.select("x", "y", "color", "seconds", "since", "next"), ["x", "y"]).where(around).groupBy(*PIXEL).agg(
        F.max(F.when(s < F.col("t0"), F.col("color"))).alias("color"), F.min(F.when(s > F.col("t0"), s).when(after > F.col("t0"), after)).alias("next")
    )
    return life.join(known, PIXEL, "left").select(*PIXEL, "t0", "t1", F.coalesce("color", F.lit(white)).alias("color"), F.col("t0").alias("seconds"), "next")


def stays_of(log: DataFrame, first: DataFrame, pixels: DataFrame, opened: Column) -> DataFrame:
    """`intervals` from a log of `with_neighbours` and its `first_stays`. Every row is made of one change, so nothing is dealt out or sorted for each composition."""
    inside = _lives(pixels).join(log.select("x", "y", "color", "seconds", "next"), ["x", "y"]).where("seconds > t0 and seconds < t1")
    stays = first.unionByName(inside).withColumn("end", F.least("next", "t1"))
    return stays.select(*PIXEL, "color", F.greatest("seconds", opened).alias("beg"), "end", "t0", "t1").where("end > beg")


def color_time(stays: DataFrame, width: float) -> DataFrame:
    """`(comp_id, x, y, bin, color, secs)`: seconds of each colour in each bin (t0 + (bin - 1) width, t0 + bin width]."""
    first = F.floor((F.col("beg") - F.col("t0")) / width).cast("int") + 1
    last = F.ceil((F.col("end") - F.col("t0")) / width).cast("int")
    split = stays.withColumn("bin", F.explode(F.sequence(first, last)))
    bin_beg = F.col("t0") + (F.col("bin") - 1) * width
    part = F.least("end", bin_beg + width, "t1") - F.greatest("beg", bin_beg)
    return split.withColumn("secs", part).where("secs > 0").groupBy(*PIXEL, "bin", "color").agg(F.sum("secs").alias("secs"))


def ranked_colors(times: DataFrame) -> DataFrame:
    """Colours of a pixel and bin from the longest time down (ties: highest colour first), with their share of the pixel's time."""
    here = Window.partitionBy(*PIXEL, "bin")
    return times.withColumns(
        {"rank": F.row_number().over(here.orderBy(F.desc("secs"), F.desc("color"))), "share": F.col("secs") / F.sum("secs").over(here)}
    )


def pixel_stability(times: DataFrame) -> DataFrame:
    """Share of the longest colour, second over first, and number of colours, for each pixel and bin."""
    at = lambda k: F.max(F.when(F.col("rank") == k, F.col("share")))
    return ranked_colors(times).groupBy(*PIXEL, "bin").agg(
        at(1).alias("stability"), F.coalesce(at(2) / at(1), F.lit(0.0)).alias("runnerup_ratio"), F.count("*").alias("n_colors")
    )


def integrated_stats(values: DataFrame, value: str, low: bool = False) -> DataFrame:
    """Mean, upper median, the 90th (or 10th) percentile and that decile's mean over the pixels of each composition and bin, by exact ranks.

    With n values in order, the median is number n // 2 (from 0), the percentile number n - n // 10, or n // 10. Fewer than ten values
    give the least and the mean of all (low: null as decile mean). Equal values are counted before they are ranked, so a composition as large as the canvas is
    one row for each distinct value of a bin.
    """
    counted = values.groupBy("comp_id", "bin", F.col(value).alias("v")).agg(F.count("*").alias("k"))
    here = Window.partitionBy("comp_id", "bin")
    upto = F.sum("k").over(here.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counted.withColumns({"n": F.sum("k").over(here), "upto": upto}).withColumn("from", F.col("upto") - F.col("k"))
    tenth = F.floor(F.col("n") / 10)
    edge = tenth if low else F.when(tenth > 0, F.col("n") - tenth).otherwise(0)
    inside = F.greatest(F.least("upto", edge) - F.col("from"), F.lit(0)) if low else F.greatest(F.col("upto") - F.greatest("from", edge), F.lit(0))
    pick = lambda at: F.max(F.when((F.col("from") <= at) & (at < F.col("upto")), F.col("v")))
    share = F.sum(inside)
    return ranked.groupBy("comp_id", "bin").agg(
        (F.sum(F.col("v") * F.col("k")) / F.sum("k")).alias("mean"),
        pick(F.floor(F.col("n") / 2)).alias("median"),
        pick(edge).alias("percentile"),
        F.when(share > 0, F.sum(F.col("v") * inside) / share).alias("decile_mean"),
    )


def stable_images(times: DataFrame) -> DataFrame:
    """First, second and third colour of each pixel and bin; the rank before where one is missing."""
    at = lambda k: F.max(F.when(F.col("rank") == k, F.col("color")))
    found = ranked_colors(times).groupBy(*PIXEL, "bin").agg(at(1).alias("stable1"), at(2).alias("c2"), at(3).alias("c3"))
    return found.select(*PIXEL, "bin", "stable1", F.coalesce("c2", "stable1").alias("stable2"), F.coalesce("c3", "c2", "stable1").alias("stable3"))


def instant_images(stays: DataFrame, width: float) -> DataFrame:
    """Colour of each pixel at each bin's end."""
    n_bins = F.ceil((F.col("t1") - F.col("t0")) / width).cast("int")
    first = F.greatest(F.ceil((F.col("beg") - F.col("t0")) / width).cast("int"), F.lit(1))
    ends = F.ceil((F.col("end") - F.col("t0")) / width).cast("int")
    last = F.when(F.col("end") >= F.col("t1"), n_bins).otherwise(ends - 1)
    return stays.where(last >= first).select(*PIXEL, F.explode(F.sequence(first, last)).alias("bin"), F.col("color").alias("inst"))


def window_totals(times: DataFrame, window: int) -> DataFrame:
    """`(comp_id, x, y, color, bin, next, total)`: a colour's seconds over the last `window` bins, from `bin` up to `next` exclusive.

    Totals change only where a bin enters or leaves the window, so there are two rows at most for each row of `times`, whatever the window. All is
    dealt by pixel once.
    """
    both = F.array(F.struct("bin", "secs"), F.struct((F.col("bin") + window).alias("bin"), F.lit(0.0).alias("secs")))  # not a union, for which times would be made twice
    marks = times.select(*PIXEL, "color", F.inline(both)).repartition(*PIXEL).groupBy(*PIXEL, "color", "bin").agg(F.sum("secs").alias("secs"))
    line = Window.partitionBy(*PIXEL, "color").orderBy("bin")
    return marks.select(*PIXEL, "color", "bin", F.lead("bin").over(line).alias("next"), F.sum("secs").over(line.rangeBetween(-(window - 1), 0)).alias("total")).where("total > 0")


def best_colors(times: DataFrame, window: int) -> DataFrame:
    """`(comp_id, x, y, bin, best)`: colour with most time over the `window` bins that end with each, up to the last that still reaches a bin of life; ties: highest colour.

    The windows behind a bin and ahead of it are the same windows, seen from their two ends, so one table serves both references.
    """
    each = window_totals(times, window).select(*PIXEL, "color", "total", F.explode(F.sequence("bin", F.col("next") - 1)).alias("bin"))
    return each.groupBy(*PIXEL, "bin").agg(F.max_by("color", F.struct(F.round("total", 6), "color")).alias("best"))


def life_bins(pixels: DataFrame, width: float) -> DataFrame:
    """`(comp_id, n_bins)`; one row for each composition, so it is small next to any table of pixels."""
    return pixels.groupBy("comp_id").agg(F.ceil((F.max("t1") - F.min("t0")) / width).cast("int").alias("n_bins"))


def reference_images(times: DataFrame, pixels: DataFrame, width: float, window: int, best: DataFrame | None = None) -> DataFrame:
    """Colour with most time over the last `window` bins, this one included. best: of `best_colors`, if it is there already."""
    best = best_colors(times, window) if best is None else best
    return best.join(life_bins(pixels, width), "comp_id").where("bin <= n_bins").select(*PIXEL, "bin", F.col("best").alias("ref"))


def forward_references(times: DataFrame, pixels: DataFrame, width: float, window: int, best: DataFrame | None = None) -> DataFrame:
    """Colour with most time over the next `window` bins. best: of `best_colors`, if it is there already."""
    best = best_colors(times, window) if best is None else best
    ahead = best.withColumn("bin", F.col("bin") - window).join(life_bins(pixels, width), "comp_id")
    return ahead.where("bin >= 1 and bin <= n_bins").select(*PIXEL, "bin", F.col("best").alias("ref_fwd"))


def constant_reference(times: DataFrame) -> DataFrame:
    """Colour with most time over the whole life."""
    sums = times.groupBy(*PIXEL, "color").agg(F.sum("secs").alias("secs"))
    return sums.groupBy(*PIXEL).agg(F.max_by("color", F.struct(F.round("secs", 6), "color")).alias("ref_const"))


def differing_pixels(stable: DataFrame, instant: DataFrame, ref: DataFrame, forward: DataFrame) -> DataFrame:
    """Pixels of each composition and bin in which two images differ; where one is missing the pixel doesn't count."""
    key = [*PIXEL, "bin"]
    images = stable.select(*key, "stable1").join(instant, key, "left").join(ref, key, "left").join(forward, key, "left")
    before = images.select(*PIXEL, (F.col("bin") + 1).alias("bin"), F.col("inst").alias("old_inst"), F.col("stable1").alias("old_stable"))
    pairs = {"stable_ref": ("stable1", "ref"), "inst_ref": ("inst", "ref"), "inst_fwd": ("inst", "ref_fwd"), "inst_old": ("inst", "old_inst"), "inst_stable": ("inst", "old_stable")}
    return images.join(before, key, "left").groupBy("comp_id", "bin").agg(
        *(F.sum(F.coalesce((F.col(a) != F.col(b)).cast("long"), F.lit(0))).alias(f"n_diff_{n}") for n, (a, b) in pairs.items())
    )


def edge_pixels(ref: DataFrame) -> DataFrame:
    """Pixels at which the reference's colour number has a gradient: a central difference inside, one-sided at the border."""
    key = [*PIXEL, "bin"]
    out = ref
    for name, dx, dy in (("right", -1, 0), ("left", 1, 0), ("down", 0, -1), ("up", 0, 1)):
        other = ref.select("comp_id", (F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), "bin", F.col("ref").alias(name))
        out = out.join(other, key, "left")
    fill = lambda n: F.coalesce(n, "ref")
    return out.select(*key, ((fill("right") != fill("left")) | (fill("up") != fill("down"))).alias("edge"))


def attack_time_share(times: DataFrame, ref: DataFrame, width: float) -> DataFrame:
    """1 - time in the reference colour over nominal bin time and area, at least 0."""
    joined = times.join(ref, [*PIXEL, "bin"])
    area = F.countDistinct("x", "y")
    kept = F.sum(F.when(F.col("color") == F.col("ref"), F.col("secs")).otherwise(0.0))
    return joined.groupBy("comp_id", "bin").agg(F.greatest(1 - kept / (area * width), F.lit(0.0)).alias("attack_time"))


def return_rate(times: DataFrame, instant: DataFrame, ref: DataFrame) -> DataFrame:
    """Of the pixels off the reference at the end of the bin before, the share that came back to it in the bin, also if it was lost again; 1 if there were none."""
    before = instant.select(*PIXEL, (F.col("bin") + 1).alias("bin"), F.col("inst").alias("old"))
    shown = times.select(*PIXEL, "bin", F.col("color").alias("ref"), F.lit(True).alias("shown"))
    joined = ref.join(instant, [*PIXEL, "bin"]).join(before, [*PIXEL, "bin"]).join(shown, [*PIXEL, "bin", "ref"], "left")
    off = F.sum((F.col("old") != F.col("ref")).cast("long"))
    back = F.sum(((F.col("old") != F.col("ref")) & ((F.col("inst") == F.col("ref")) | F.col("shown").isNotNull())).cast("long"))
    return joined.groupBy("comp_id", "bin").agg(F.when(off > 0, back / off).otherwise(1.0).alias("return_rate"))


def color_variances(times: DataFrame) -> DataFrame:
    """Per composition and bin, p being the colours' shares of a pixel's time: 1 / mean of sum p^2 (of the whole state), mean of sum p (1 - p), mean of sum p^2 - max p^2.

    Means are over the pixels that show a colour in the bin.
    """
    shares = ranked_colors(times)
    square = F.col("share") * F.col("share")
    pixel = shares.groupBy(*PIXEL, "bin").agg(F.sum(square).alias("sq"), F.max(square).alias("top"), F.sum("share").alias("whole"))
    return pixel.groupBy("comp_id", "bin").agg(
        (1 / F.avg("sq")).alias("var_inverse"), F.avg(F.col("whole") - F.col("sq")).alias("var_multinomial"), F.avg(F.col("sq") - F.col("top")).alias("var_subdominant")
    )


def color_autocorrelation(times: DataFrame) -> DataFrame:
    """Per composition and bin from the second on, p and q being the colours' shares of a pixel's time in this bin and the one before: means of sum q (1 - p), of
    sum (q - p)^2 / 2, and of sum p q - max p q. Means are over the pixels that show a colour in this bin; q is 0 where they showed none before."""
    here = ranked_colors(times).select(*PIXEL, "bin", "color", "share")
    before = here.select(*PIXEL, (F.col("bin") + 1).alias("bin"), "color", F.col("share").alias("old"))
    both = here.join(before, [*PIXEL, "bin", "color"], "full").na.fill(0.0, ["share", "old"])
    p, q = F.col("share"), F.col("old")
    pixel = both.groupBy(*PIXEL, "bin").agg(
        F.sum(q * (1 - p)).alias("multinomial"), (F.sum((q - p) * (q - p)) / 2).alias("apart"), (F.sum(p * q) - F.max(p * q)).alias("sub"), F.max(p).alias("now")
    )
    return pixel.where("now > 0 and bin > 1").groupBy("comp_id", "bin").agg(
        F.avg("multinomial").alias("autocorr_multinomial"), F.avg("apart").alias("dissimilarity"), F.avg("sub").alias("autocorr_subdominant")
    )


def color_share_of_images(instant: DataFrame, ref: DataFrame, color: int) -> DataFrame:
    """Share of the pixels of one colour in the image and in the reference."""
    joined = instant.join(ref, [*PIXEL, "bin"])
    share = lambda c: F.avg((F.col(c) == color).cast("double"))
    return joined.groupBy("comp_id", "bin").agg(share("inst").alias("in_image"), share("ref").alias("in_ref"))


def lifetime_stability(stays: DataFrame) -> DataFrame:
    """Mean over a composition's pixels of the longest colour's share of the life."""
    times = stays.groupBy(*PIXEL, "color").agg(F.sum(F.col("end") - F.col("beg")).alias("secs"))
    pixel = times.groupBy(*PIXEL).agg((F.max("secs") / F.sum("secs")).alias("stability"))
    return pixel.groupBy("comp_id").agg(F.avg("stability").alias("stability"), F.count("*").alias("area"))


def last_installed(stays: DataFrame) -> DataFrame:
    """`(comp_id, x, y, color, last_got, last_lost)`: when each pixel last got and lost each colour in the composition's life; null where it never did."""
    order = Window.partitionBy(*PIXEL).orderBy("beg")
    fresh = F.coalesce(F.lag("color").over(order) != F.col("color"), F.lit(False))
    leaves = F.coalesce(F.lead("color").over(order) != F.col("color"), F.lit(False))
    marked = stays.withColumns({"got": F.when(fresh, F.col("beg")), "lost": F.when(leaves, F.col("end"))})
    return marked.groupBy(*PIXEL, "color").agg(F.max("got").alias("last_got"), F.max("lost").alias("last_lost"))


def attack_durations(stays: DataFrame, constant: DataFrame) -> DataFrame:
    """Stretches in which a pixel is off its constant reference: when they begin, how long they last, whether the life ends first."""
    joined = stays.join(constant, PIXEL).withColumn("off", F.col("color") != F.col("ref_const"))
    order = Window.partitionBy(*PIXEL).orderBy("beg")
    turn = F.coalesce(F.lag("off").over(order) != F.col("off"), F.lit(True)).cast("int")
    runs = joined.withColumn("turn", turn).withColumn("run", F.sum("turn").over(order)).where("off")
    return runs.groupBy(*PIXEL, "run").agg(F.min("beg").alias("beg"), F.max("end").alias("end"), F.max("t1").alias("t1"), F.min("t0").alias("t0")).select(
        *PIXEL, "beg", (F.col("end") - F.col("beg")).alias("duration"), (F.col("end") >= F.col("t1")).alias("open"), "t0"
    )


def attack_flips(stays: DataFrame, constant: DataFrame, total: float) -> DataFrame:
    """`(comp_id, x, y, beg, duration, t0)` of each run of changes away from the constant reference: from its first change to the first change back, or `total` if there is none.

    Only changes begin a run: a pixel that is off its reference when its life begins is attacked by its first change to another colour than the reference.
    """
    order = Window.partitionBy(*PIXEL).orderBy("beg")
    changed = stays.join(constant, PIXEL).withColumn("place", F.row_number().over(order)).where("place > 1")
    off = F.col("color") != F.col("ref_const")
    turns = changed.withColumn("off", off).withColumn("old", F.lag("off").over(order)).where("old is null or old <> off")
    return turns.withColumn("back", F.lead("beg").over(order)).where("off").select(
        *PIXEL, "beg", F.coalesce(F.col("back") - F.col("beg"), F.lit(total)).alias("duration"), "t0"
    )


def return_times(flips: DataFrame, width: float) -> DataFrame:
    """Number, mean duration and median duration / ln 2 of the attacks that begin in each bin; those never turned back count with the duration that `attack_flips` gives them."""
    bins = F.ceil((F.col("beg") - F.col("t0")) / width).cast("int")
    return flips.groupBy("comp_id", bins.alias("bin")).agg(
        F.count("*").alias("n"), F.avg("duration").alias("mean"), (F.expr("percentile(duration, 0.5)") / F.log(F.lit(2.0))).alias("median_ln2")
    )


def windowed_return_times(stays: DataFrame, instant: DataFrame, ref: DataFrame, width: float, window: int) -> DataFrame:
    """`(comp_id, x, y, bin, return_time)`: how long each pixel has been, or was when last attacked in the window, off the reference colour of that bin.

    Off the reference at the bin's end: the time since it last lost that colour. On it, if it lost that colour within the last `window` bins: from the
    last loss to the last return. Null otherwise. A colour that was never lost or got counts as lost and got when the pixel's life began. The reference changes from bin to bin,
    so the last loss and return are those of the colour asked for: changes and questions go into one order by pixel, colour and time, and each question reads what
    was carried forward to it.
    """
    order = Window.partitionBy(*PIXEL).orderBy("beg")
    moved = stays.withColumn("old", F.lag("color").over(order)).where("old <> color")
    nothing = F.lit(None).cast("double")
    got = moved.select(*PIXEL, "color", F.col("beg").alias("at"), F.col("beg").alias("got"), nothing.alias("lost"))
    lost = moved.select(*PIXEL, F.col("old").alias("color"), F.col("beg").alias("at"), nothing.alias("got"), F.col("beg").alias("lost"))
    life = stays.groupBy(*PIXEL).agg(F.min("beg").alias("start"), F.min("t0").alias("t0"), F.max("t1").alias("t1"))
    at = F.least(F.col("t0") + F.col("bin") * width, "t1")
    asked = ref.join(instant, [*PIXEL, "bin"]).join(life, PIXEL).select(*PIXEL, F.col("ref").alias("color"), at.alias("at"), "bin", "inst", "start")
    line = got.unionByName(lost).unionByName(asked, allowMissingColumns=True)
    carried = Window.partitionBy(*PIXEL, "color").orderBy("at", F.col("bin").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    seen = line.withColumns({c: F.last(c, ignorenulls=True).over(carried) for c in ("got", "lost")}).where("bin is not null")
    back, gone = F.coalesce("got", "start"), F.coalesce("lost", "start")
    value = F.when(F.col("inst") != F.col("color"), F.col("at") - gone).when(gone > F.col("at") - window * width, back - gone)
    return seen.select(*PIXEL, "bin", value.alias("return_time"))


def return_time_stats(returns: DataFrame) -> DataFrame:
    """`integrated_stats` of the pixels that have a return time; zeros for bins in which none has."""
    bins = returns.select("comp_id", "bin").distinct()
    names = ["mean", "median", "percentile", "decile_mean"]
    found = integrated_stats(returns.where("return_time is not null"), "return_time")
    return bins.join(found, ["comp_id", "bin"], "left").na.fill(0.0, names)


def autocorrelation_by_case(stable: DataFrame, instant: DataFrame) -> DataFrame:
    """Per composition and bin, from the colours at this bin's end and the last one's, and the bin's longest colour: 1 for a pixel that stays off the longest colour,
    -1 for one that goes from one other colour to another, 0 for all else. `by_case` is the mean, `by_case_norm` the sum over that of weights: 1 for either of
    these, a half for a change from or to the longest colour; 0 where nothing has weight."""
    before = instant.select(*PIXEL, (F.col("bin") + 1).alias("bin"), F.col("inst").alias("old"))
    joined = stable.select(*PIXEL, "bin", F.col("stable1").alias("top")).join(instant, [*PIXEL, "bin"]).join(before, [*PIXEL, "bin"])
    same, now, then = F.col("inst") == F.col("old"), F.col("inst") == F.col("top"), F.col("old") == F.col("top")
    value = F.when(same & ~now, 1.0).when(~same & ~now & ~then, -1.0).otherwise(0.0)
    weight = F.when(same & now, 0.0).when(same | (~now & ~then), 1.0).otherwise(0.5)
    sums = joined.groupBy("comp_id", "bin").agg(F.avg(value).alias("by_case"), F.sum(value).alias("s"), F.sum(weight).alias("w"))
    return sums.select("comp_id", "bin", "by_case", F.when(F.col("w") > 0, F.col("s") / F.col("w")).otherwise(0.0).alias("by_case_norm"))
