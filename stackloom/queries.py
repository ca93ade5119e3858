"""The engine's queries on the driver's tables and equivalent SQL.

Stacks: ``embeddings`` (stack = label, frame = vec_id, 8 x 8), ``events`` (stack = event_type,
frame = day, 24 x 6 of hours and tens of minutes, sums of value), ``lineitem`` (stack =
l_returnflag, frame = month, 51 x 11 of quantity and discount, sums of l_extendedprice).
Floats are rounded on both sides, and 0.0 is added so that there is one zero.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stackloom import model
from stackloom.functions import display, timestamps, units
from stackloom.model import FRAME_KEY
from stackloom.operators import filters
from stackloom.plans.forms import FRAME, PIXEL, Faults, State, counted, run_steps
from stackloom.plans.frameplan import run_frames
from stackloom.plans.pixelplan import PixelState, apply_step, run_pixels, spread
from stackloom.plans.registry import Step, register_filter, register_mask
from stackloom.plans.steps import DEFAULT_STEPS, parse_steps
from stackloom.sources.datasource import FORMAT, local_scratch, register

Query = Callable[[SparkSession, str], DataFrame]
H = W = 8
EV_H, EV_W = 24, 6
LI_H, LI_W = 51, 11


def emb_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.col("label").cast("string").alias("stack_id"), F.col("vec_id").cast("int").alias("frame_idx"), F.lit(H).alias("height"), F.lit(W).alias("width"), F.col("embedding").cast("array<double>").alias("pixels"))


def emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixel form of the embeddings stack; frames are dealt out once and exploded after it."""
    return model.explode_frames(emb_frames(spark, sf_dir).repartition(*FRAME_KEY))


def events_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    return model.rasterize(e, F.col("event_type"), day, F.hour("ts"), F.expr("minute(ts) div 10"), F.col("value"), EV_H, EV_W)


def lineitem_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    month = (F.year("l_shipdate") - 1990) * 12 + F.month("l_shipdate") - 1
    return model.rasterize(r, F.col("l_returnflag"), month, F.col("l_quantity").cast("int"), F.round(F.col("l_discount") * 100).cast("int"), F.col("l_extendedprice"), LI_H, LI_W)


def rounded(df: DataFrame, digits: int = 6, column: str = "z") -> DataFrame:
    return df.withColumn(column, F.round(column, digits) + 0.0)


def _out(state: PixelState, digits: int = 6) -> DataFrame:
    more = ["mask"] if state.has_mask else []
    return rounded(state.pixels.select(*FRAME_KEY, "y", "x", "z", *more), digits)


def _steps(text: str, digits: int = 6, source: Query = emb, size: tuple[int, int] = (H, W), combine: str = "or") -> Query:
    return lambda spark, sf_dir: _out(run_pixels(source(spark, sf_dir), *size, parse_steps(text), combine), digits)


def explode_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(model.explode_frames(emb_frames(spark, sf_dir)))


def whole(pixels: str) -> Column:
    """All pixels of a frame in millionths, as one text."""
    return F.array_join(F.transform(pixels, lambda x: F.floor(x * 1e6 + 0.5).cast("bigint").cast("string")), ",")


def assemble_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = model.assemble_frames(emb(spark, sf_dir))
    return rows.select(*FRAME_KEY, "height", "width", whole("pixels").alias("pixels"), F.size("pixels").alias("n"))


def rasterize_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(events_raster(spark, sf_dir), 4)


def rasterize_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(lineitem_raster(spark, sf_dir), 2)


def flip_vertical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(model.flip_vertical(emb(spark, sf_dir), H))


def slice_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.slice_frames(emb_frames(spark, sf_dir).select(*FRAME_KEY, whole("pixels").alias("pixels")), 3, -2, 4)


def frame_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(emb(spark, sf_dir).where(F.col("frame_idx") == 7))


def reread_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings stack written as instrument files, a stack a folder, and some frames of it read again by the data source."""
    register(spark)
    folder = local_scratch(spark)
    frames = emb_frames(spark, sf_dir)
    frames.write.format(FORMAT).mode("append").option("channel", "height_trace").option("pixelSizeNm", 2.0).option("lineRate", 4.0).save(folder)
    back = spark.read.format(FORMAT).option("framesPerTask", 256).option("channel", "height_trace").option("frames", "7:").load(folder)
    p = model.explode_frames(back.select(*FRAME_KEY, "width", "pixels")).join(back.select("frame_idx", "line_rate"), "frame_idx")
    return p.select("frame_idx", "y", "x", (F.round("z", 6) + 0.0).alias("z"), "line_rate")


def frame_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = emb_frames(spark, sf_dir).select(*FRAME_KEY)
    meta = frames.where(F.col("frame_idx") % 3 == 0).select(*FRAME_KEY, (F.col("frame_idx") * 0.5).alias("timestamp_s"), F.concat(F.lit("ch"), F.col("frame_idx") % 2).alias("own"))
    rows = model.attach_metadata(frames, meta)
    return rows.select(*FRAME_KEY, "timestamp_s", F.coalesce("own", F.lit("height_trace")).alias("channel"), F.to_json(F.struct("timestamp_s", "own")).alias("json"))


def generate_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = emb_frames(spark, sf_dir).select(*FRAME_KEY, "height", (F.col("frame_idx") % 4).cast("double").alias("line_rate"))
    rows = model.generate_timestamps(rows)
    return rows.select(*FRAME_KEY, "timestamp_s", display.frames_per_second(F.when(F.col("line_rate") > 0, F.col("line_rate")), F.col("height")).alias("fps"))


def normalize_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    kinds = {f.name: f.dataType for f in o.schema}
    as_text = F.when(F.col("o_orderkey") % 5 == 0, F.lit("not-a-date")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    of = lambda c, name: timestamps.seconds(c, kinds[name] if name in kinds else o.select(as_text.alias("t")).schema["t"].dataType)
    return o.select("o_orderkey", of(F.col("o_orderdate"), "o_orderdate").alias("of_time"), of(as_text, "t").alias("of_text"), of(F.col("o_totalprice"), "o_totalprice").alias("of_number"))


def guess_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = emb(spark, sf_dir)
    scaled = z.withColumn("z", F.col("z") * F.pow(F.lit(10.0), -(F.col("stack_id").cast("int") % 6)) * F.when(F.col("stack_id") == "0", 1e6).otherwise(1.0))
    return units.guess_units(scaled)


def standardize_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(units.guess_to_nm(events_raster(spark, sf_dir)), 4)


def convert_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(units.to_nm(emb(spark, sf_dir), "um"), 3)


def unit_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = emb(spark, sf_dir)
    parts = {"declared_pm": units.by_declared_unit(z, "pm"), "volts": units.by_declared_unit(z, "V"), "unknown": units.by_declared_unit(z, None), "TP": units.by_channel(z, "TP"), "PH": units.by_channel(z, "PH")}
    out = None
    for name, rows in parts.items():
        one = rows.groupBy("stack_id").agg(F.round(F.max("z"), 5).alias("top")).select(F.lit(name).alias("policy"), "stack_id", "top")
        out = one if out is None else out.unionAll(one)
    return out


def frame_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = events_raster(spark, sf_dir).groupBy(*FRAME_KEY)
    r = lambda c: F.round(c, 6) + 0.0
    return g.agg(r(F.avg("z")).alias("mean"), r(F.stddev_pop("z")).alias("std"), r(F.median("z")).alias("median"), r(F.min("z")).alias("low"), r(F.max("z")).alias("high"), F.count_if(F.col("z") != 0).alias("nonzero"))


def normalize_uint8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return display.grey(emb(spark, sf_dir)).select(*FRAME_KEY, "y", "x", "g")


def pad_square(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(display.pad_square(events_raster(spark, sf_dir), EV_H, EV_W, -1.0), 4)


def colormap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return display.grey(emb(spark, sf_dir)).withColumn("c", display.heat(F.col("g"))).select(*FRAME_KEY, "y", "x", "c.r", "c.g", "c.b")


def scale_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    square = display.pad_square(events_raster(spark, sf_dir), EV_H, EV_W)
    rows = display.grey(square).withColumn("rgb", display.heat(F.col("g")))
    return display.with_scale_bar(rows, EV_H, 20.0, 2.5).select(*FRAME_KEY, "y", "x", "rgb.r", "rgb.g", "rgb.b")


def scale_bar_and_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    square = display.pad_square(events_raster(spark, sf_dir), EV_H, EV_W)
    rows = display.with_scale_bar(display.grey(square).withColumn("rgb", display.heat(F.col("g"))), EV_H, 20.0, 2.5)
    return display.with_text(rows, display.time_text(F.col("frame_idx") * 0.25), 1, 2).select(*FRAME_KEY, "y", "x", "rgb.r", "rgb.g", "rgb.b")


def letterbox_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event frames of 24 x 6 as 16 x 4 in a window of 16 x 9."""
    return display.in_window(display.grey(events_raster(spark, sf_dir)), EV_H, EV_W, 16, 9, ["g"])


def letterbox_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coloured frames of 8 x 8 as 19 x 19 in a window of 19 x 30."""
    rows = display.grey(emb(spark, sf_dir)).withColumn("c", display.heat(F.col("g"))).select(*FRAME_KEY, "y", "x", "c.r", "c.g", "c.b")
    return display.in_window(rows, H, W, 19, 30, ["r", "g", "b"], 7)


def _chosen(spark: SparkSession, sf_dir: str, steps: list[Step], rows: DataFrame | None = None, combine: str = "or") -> State:
    """Steps over the embeddings stack, each in the form that the chain's costs choose."""
    start = State(emb_frames(spark, sf_dir) if rows is None else rows, FRAME, H, W)
    return run_steps(start, steps, combine)[-1].to(PIXEL)


def pipeline_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default preset; its costs choose the frame form."""
    state = _chosen(spark, sf_dir, DEFAULT_STEPS)
    return _out(PixelState(state.rows, H, W, state.has_mask), 5)


def pipeline_default_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in pixel form, as frames that don't fit into a row need it."""
    return _out(run_pixels(emb(spark, sf_dir), H, W, DEFAULT_STEPS), 5)


def _own_steps() -> list[Step]:
    """A chain of built-in steps and users' steps, one of which fails on some frames."""

    def flipped(a: np.ndarray) -> np.ndarray:
        if a[0, 0] > 0:
            raise ValueError("positive corner")
        return -a

    def left_half(a: np.ndarray) -> np.ndarray:
        return np.arange(a.shape[1])[None, :] * 2 < a.shape[1] * np.ones((len(a), 1))

    register_filter("flipped", flipped)
    register_mask("left_half", left_half)
    return [Step("remove_plane"), Step("left_half"), Step("row_median_align"), Step("flipped"), Step("polynomial_flatten", {"order": 2.0}), Step("mask_threshold", {"threshold": 0.05}), Step("zero_mean")]


def pipeline_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Built-in steps and users' steps in one chain of pixels, frames and pixels."""
    start = State(emb(spark, sf_dir), PIXEL, H, W)
    state = run_steps(start, _own_steps())[-1].to(PIXEL)
    return _out(PixelState(state.rows, H, W, state.has_mask), 5)


def step_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames that each step of that chain left as they were, as observed while the chain ran."""
    steps = _own_steps()
    end = run_steps(State(counted(emb_frames(spark, sf_dir)), FRAME, H, W), steps)[-1]
    faults = Faults([f"step_{k}_{s.name}" for k, s in enumerate(steps, 1)])
    faults.observed(end).write.format("noop").mode("overwrite").save()
    return spark.createDataFrame(sorted(faults.get().items()), "step string, frames bigint")


def pipeline_default_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in frame form: one narrow pass, no shuffle."""
    rows = run_frames(emb_frames(spark, sf_dir), DEFAULT_STEPS, with_mask=True)
    p = rows.select(*FRAME_KEY, F.posexplode(F.arrays_zip("pixels", "mask")).alias("p", "c"))
    return rounded(p.select(*FRAME_KEY, F.expr(f"p div {W}").cast("int").alias("y"), (F.col("p") % W).cast("int").alias("x"), F.col("c.pixels").alias("z"), F.col("c.mask").alias("mask")), 5)


def pipeline_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rasterise, then a plane and row medians: the bench's volume query."""
    return _out(run_pixels(spread(lineitem_raster(spark, sf_dir)), LI_H, LI_W, parse_steps("remove_plane;row_median_align")), 2)


def user_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's function of one array, in frame form; it fails on some frames, which stay as they are."""

    def twice_or_fail(a: np.ndarray, factor: float = 2.0) -> np.ndarray:
        if a[0, 0] < 0:
            raise ValueError("negative corner")
        return a * factor

    register_filter("twice_or_fail", twice_or_fail)
    rows = run_frames(emb_frames(spark, sf_dir), [Step("twice_or_fail", {"factor": 3.0})])
    return rows.select(*FRAME_KEY, "errors", whole("pixels").alias("pixels"))


def wrong_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An unknown parameter drops all: the threshold is then the default 0."""
    return _out(apply_step(PixelState(emb(spark, sf_dir), H, W), Step("mask_threshold", {"threshold": 0.1, "foo": 1})))


MASK0 = "mask_threshold:threshold=0.0"
_NAMED: dict[str, Query] = {
    "mask_threshold": _steps("mask_threshold:threshold=0.05"),
    "mask_below_threshold": _steps("mask_below_threshold:threshold=0.05"),
    "mask_mean_offset": _steps("mask_mean_offset:factor=0.5"),
    "mask_adaptive": _steps("mask_adaptive:block_size=3,offset=0.01"),
    "mask_morphological": _steps("mask_morphological:threshold=0.1,structure_size=3"),
    "mask_morphological_even": _steps("mask_morphological:threshold=0.1,structure_size=2"),
    "mask_morphological_s7": _steps("mask_morphological:threshold=0.1,structure_size=7"),
    "mask_morphological_lineitem": _steps("mask_morphological:threshold=150000.0,structure_size=8", 2, lineitem_raster, (LI_H, LI_W)),
    "mask_combine_or": _steps("mask_threshold:threshold=0.1;mask_below_threshold:threshold=-0.1"),
    "mask_replace": _steps("mask_threshold:threshold=0.1;mask_below_threshold:threshold=-0.1", combine="replace"),
    "mask_clear": _steps("mask_threshold:threshold=0.1;clear;zero_mean"),
    "row_median_align": _steps("row_median_align"),
    "row_median_align_masked": _steps(f"{MASK0};row_median_align"),
    "zero_mean": _steps("zero_mean"),
    "zero_mean_masked": _steps(f"{MASK0};zero_mean"),
    "remove_plane": _steps("remove_plane"),
    "remove_plane_masked": _steps(f"{MASK0};remove_plane"),
    "polynomial_flatten_o1": _steps("polynomial_flatten:order=1"),
    "polynomial_flatten_o2": _steps("polynomial_flatten:order=2"),
    "polynomial_flatten_o3": _steps("polynomial_flatten:order=3"),
    "polynomial_flatten_masked": _steps(f"{MASK0};polynomial_flatten:order=2"),
    "polynomial_flatten_invalid": _steps("polynomial_flatten:order=2.0"),
    "gaussian_filter_s1": _steps("gaussian_filter:sigma=1.0"),
    "gaussian_filter_s2": _steps("gaussian_filter:sigma=2.0"),
    "pipeline_quickstart": _steps("remove_plane;mask_mean_offset:factor=1;row_median_align", 5),
    "pipeline_events": _steps("remove_plane;mask_mean_offset:factor=1;row_median_align", 6, events_raster, (EV_H, EV_W)),
}
_PLAIN: list[Query] = [explode_frames, assemble_frames, rasterize_events, rasterize_lineitem, flip_vertical, slice_frames, frame_at, reread_stack, frame_meta, generate_timestamps, normalize_timestamps, guess_units, standardize_units, convert_units, unit_policies, frame_stats, normalize_uint8, pad_square, colormap, scale_bar, scale_bar_and_time, letterbox_down, letterbox_up, pipeline_default, pipeline_default_pixels, pipeline_default_frames, pipeline_mixed, step_faults, pipeline_lineitem, user_filter, wrong_parameters]


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in _PLAIN} | _NAMED


# SQL, written from the definitions and not from the plans above

_EMB = "px AS (SELECT CAST(label AS VARCHAR) AS stack_id, CAST(vec_id AS INTEGER) AS frame_idx, CAST((p - 1) // 8 AS INTEGER) AS y, CAST((p - 1) % 8 AS INTEGER) AS x, CAST(embedding[p] AS DOUBLE) AS z FROM embeddings, generate_series(1, 64) t(p))"
_RAW_EV = "raw AS (SELECT event_type AS stack_id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS frame_idx, hour(ts) AS y, minute(ts) // 10 AS x, sum(value) AS z FROM events GROUP BY ALL)"
_RAW_LI = "raw AS (SELECT l_returnflag AS stack_id, CAST((year(l_shipdate) - 1990) * 12 + month(l_shipdate) - 1 AS INTEGER) AS frame_idx, CAST(floor(l_quantity) AS INTEGER) AS y, CAST(round(l_discount * 100) AS INTEGER) AS x, sum(l_extendedprice) AS z FROM lineitem GROUP BY ALL)"


def _grid(raw: str, height: int, width: int) -> str:
    return f"{raw}, px AS (SELECT f.stack_id, f.frame_idx, CAST(g // {width} AS INTEGER) AS y, CAST(g % {width} AS INTEGER) AS x, coalesce(z, 0.0) AS z FROM (SELECT DISTINCT stack_id, frame_idx FROM raw) f CROSS JOIN generate_series(0, {height * width - 1}) t(g) LEFT JOIN raw r ON r.stack_id = f.stack_id AND r.frame_idx = f.frame_idx AND r.y = g // {width} AND r.x = g % {width})"


_EV, _LI = _grid(_RAW_EV, EV_H, EV_W), _grid(_RAW_LI, LI_H, LI_W)
_F = "PARTITION BY stack_id, frame_idx"
_R = "PARTITION BY stack_id, frame_idx, y"


def _r(expr: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0"


class Chain:
    """CTEs over (stack_id, frame_idx, y, x, z, m); m is null while there is no mask."""

    def __init__(self, base: str, height: int = H, width: int = W, source: str = "px"):
        self.ctes = [base, f"c0 AS (SELECT stack_id, frame_idx, y, x, z, CAST(NULL AS BOOLEAN) AS m FROM {source})"]
        self.n, self.size, self.masked = 0, (height, width), False

    @property
    def last(self) -> str:
        return f"c{self.n}"

    def then(self, select: str) -> Chain:
        before, self.n = self.last, self.n + 1
        self.ctes.append(f"{self.last} AS ({select.format(prev=before)})")
        return self

    def z(self, expr: str) -> Chain:
        return self.then(f"SELECT stack_id, frame_idx, y, x, {expr} AS z, m FROM {{prev}}")

    def m(self, expr: str) -> Chain:
        self.masked = True
        return self.then(f"SELECT stack_id, frame_idx, y, x, z, {expr} AS m FROM {{prev}}")

    @property
    def keep(self) -> str:
        return "coalesce(NOT m, true)"

    def fit(self, order: int) -> Chain:
        """Modified Gram-Schmidt on centred monomials over what isn't masked."""
        h, w = self.size
        terms = [f"(x - {(w - 1) / 2}) ** {i} * (y - {(h - 1) / 2}) ** {d - i}" for d in range(order + 1) for i in range(d + 1)]
        names = [f"v{k}" for k in range(len(terms))]
        self.then(f"SELECT *, z AS r, {', '.join(f'CAST({t} AS DOUBLE) AS {v}' for t, v in zip(terms, names))} FROM {{prev}}")
        for k, q in enumerate(names):
            later = [*names[k + 1 :], "r"]
            self.then(f"SELECT *, sum({q} * {q}) FILTER ({self.keep}) OVER ({_F}) AS qq, {', '.join(f'sum({u} * {q}) FILTER ({self.keep}) OVER ({_F}) AS d_{u}' for u in later)} FROM {{prev}}")
            self.then(f"SELECT stack_id, frame_idx, y, x, z, m, {', '.join(f'{u} - CASE WHEN qq > 1e-6 THEN d_{u} / qq ELSE 0 END * {q} AS {u}' for u in later)} FROM {{prev}}")
        need = f"count(*) FILTER ({self.keep}) OVER ({_F}) >= {len(terms)}"
        return self.z(f"CASE WHEN {need} THEN r ELSE z END" if self.masked else "r")

    def medians(self) -> Chain:
        return self.z(f"z - coalesce(median(z) FILTER ({self.keep}) OVER ({_R}), 0.0)")

    def centred(self) -> Chain:
        return self.z(f"z - coalesce(avg(z) FILTER ({self.keep}) OVER ({_F}), 0.0)")

    def high(self, factor: float) -> Chain:
        return self.m(f"z - avg(z) OVER ({_F}) > {factor} * stddev_pop(z) OVER ({_F})")

    def sql(self, digits: int = 6) -> str:
        return f"WITH {', '.join(self.ctes)} SELECT stack_id, frame_idx, y, x, {_r('z', digits)} AS z{', m AS mask' if self.masked else ''} FROM {self.last}"


def _gauss_sql(sigma: float) -> str:
    w = filters.gaussian_weights(sigma)
    r = len(w) // 2
    rows = ", ".join(f"({k - r}, {v!r}::DOUBLE)" for k, v in enumerate(w.tolist()))
    fold = lambda n: f"CASE WHEN i % {2 * n} < {n} THEN i % {2 * n} ELSE {2 * n - 1} - i % {2 * n} END"
    big = 1000 * 2 * H
    return f"""WITH {_EMB}, k(o, w) AS (VALUES {rows}),
a AS (SELECT stack_id, frame_idx, y, x, o, w, {fold(W).replace('i', f'(x + o + {big})').replace(f'(x + o + {big})n', 'in')} AS s FROM px, k),
b AS (SELECT a.stack_id, a.frame_idx, a.y, a.x, sum(a.w * px.z) AS z FROM a JOIN px ON px.stack_id = a.stack_id AND px.frame_idx = a.frame_idx AND px.y = a.y AND px.x = a.s GROUP BY ALL),
c AS (SELECT stack_id, frame_idx, y, x, o, w, {fold(H).replace('i', f'(y + o + {big})').replace(f'(y + o + {big})n', 'in')} AS s FROM b, k)
SELECT c.stack_id, c.frame_idx, c.y, c.x, {_r('sum(c.w * b.z)')} AS z FROM c JOIN b ON b.stack_id = c.stack_id AND b.frame_idx = c.frame_idx AND b.x = c.x AND b.y = c.s GROUP BY ALL"""


def _closing_sql(t: float, s: int, base: str = _EMB, digits: int = 6) -> str:
    back, ahead = s // 2, (s - 1) // 2
    cover = lambda a, b, lo, hi: f"{b}.stack_id = {a}.stack_id AND {b}.frame_idx = {a}.frame_idx AND {b}.y BETWEEN {a}.y - {lo} AND {a}.y + {hi} AND {b}.x BETWEEN {a}.x - {lo} AND {a}.x + {hi}"
    return f"""WITH {base}, d AS (SELECT a.stack_id, a.frame_idx, a.y, a.x, a.z, bool_or(abs(b.z) > {t}) AS m FROM px a JOIN px b ON {cover('a', 'b', ahead, back)} GROUP BY ALL)
SELECT a.stack_id, a.frame_idx, a.y, a.x, {_r('a.z', digits)} AS z, bool_and(b.m) AND count(*) = {s * s} AS mask FROM d a JOIN d b ON {cover('a', 'b', back, ahead)} GROUP BY ALL"""


def _simple(select: str, base: str = _EMB) -> str:
    return f"WITH {base} SELECT {select} FROM px"


_PX = "stack_id, frame_idx, y, x"
_GREY = f"CASE WHEN max(z) OVER ({_F}) = min(z) OVER ({_F}) THEN 0 ELSE least(255, CAST(floor((z - min(z) OVER ({_F})) * (255.0 / (max(z) OVER ({_F}) - min(z) OVER ({_F}))) + 1e-9) AS INTEGER)) END"
_HEAT = "CAST(least(255, 2 * g) AS INTEGER) AS r, CAST(greatest(0, least(255, 2 * g - 128)) AS INTEGER) AS g, CAST(greatest(0, 2 * g - 255) AS INTEGER) AS b"
_UNIT = "CASE WHEN s > 1e4 THEN 'pm' WHEN s > 1e-2 THEN 'nm' WHEN s > 1e-4 THEN 'um' WHEN s > 1e-5 THEN 'mm' ELSE 'm' END"
_SQUARE = f"sq AS (SELECT f.stack_id, f.frame_idx, CAST(g // 24 AS INTEGER) AS y, CAST(g % 24 AS INTEGER) AS x, coalesce(z, {{border}}) AS z FROM (SELECT DISTINCT stack_id, frame_idx FROM px) f CROSS JOIN generate_series(0, 575) t(g) LEFT JOIN px ON px.stack_id = f.stack_id AND px.frame_idx = f.frame_idx AND px.y = g // 24 AND px.x = g % 24 - 9)"


def _window_sql(ctes: str, size: tuple[int, int], fit: tuple[int, int], window: tuple[int, int], values: str, border: int) -> str:
    """Means by overlap from px, in the middle of a window."""
    (h, w), (a, b), (p, q) = size, fit, window
    over = lambda t, s, n, to: f"(least(({t} + 1) * {n}, ({s} + 1) * {to}) - greatest({t} * {n}, {s} * {to}))"
    oy, ox = over("ty", "y", h, a), over("tx", "x", w, b)
    means = ", ".join(f"CAST(floor(sum({v} * {oy} * {ox}) / {h * w}::DOUBLE + 0.5) AS INTEGER) AS {v}" for v in values)
    return f"""WITH {ctes}, small AS (SELECT stack_id, frame_idx, ty, tx, {means} FROM px8, generate_series(0, {a - 1}) s(ty), generate_series(0, {b - 1}) t(tx) WHERE {oy} > 0 AND {ox} > 0 GROUP BY ALL)
SELECT f.stack_id, f.frame_idx, CAST(g.k // {q} AS INTEGER) AS y, CAST(g.k % {q} AS INTEGER) AS x, {", ".join(f"coalesce(small.{v}, {border}) AS {v}" for v in values)}
FROM (SELECT DISTINCT stack_id, frame_idx FROM px8) f CROSS JOIN generate_series(0, {p * q - 1}) g(k) LEFT JOIN small ON small.stack_id = f.stack_id AND small.frame_idx = f.frame_idx AND ty = g.k // {q} - {(p - a) // 2} AND tx = g.k % {q} - {(q - b) // 2}"""


def _to_nm(base: str) -> str:
    return f"{base}, u AS (SELECT stack_id, {_UNIT} AS unit FROM (SELECT stack_id, max(z) - min(z) AS s FROM px GROUP BY 1)), nm AS (SELECT px.* REPLACE (z * CASE unit WHEN 'pm' THEN 1e-3 WHEN 'nm' THEN 1 WHEN 'um' THEN 1e3 WHEN 'mm' THEN 1e6 ELSE 1e9 END AS z) FROM px JOIN u USING (stack_id))"


def oracle_sql() -> dict[str, str]:
    c = lambda base=_EMB, h=H, w=W: Chain(base, h, w)
    above = lambda t: f"z > {t}"
    quick = lambda ch: ch.fit(1).high(1).medians()
    # the user's filter sees frames whose first pixel isn't above 0
    corner = c().fit(1).m("x < 4").medians()
    first = f"max(CASE WHEN y = 0 AND x = 0 THEN z END) OVER ({_F})"
    own = c().fit(1).m("x < 4").medians().z(f"CASE WHEN {first} > 0 THEN z ELSE -z END").m("m OR z > 0.05")
    default = c().fit(1).fit(2).high(0.5).medians().fit(2).centred().sql(5)
    return {
        "explode_frames": c().sql(),
        "assemble_frames": "SELECT CAST(label AS VARCHAR) AS stack_id, CAST(vec_id AS INTEGER) AS frame_idx, 8 AS height, 8 AS width, array_to_string(list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1e6::DOUBLE + 0.5::DOUBLE) AS BIGINT)), ',') AS pixels, CAST(len(embedding) AS INTEGER) AS n FROM embeddings",
        "rasterize_events": c(_EV).sql(4),
        "rasterize_lineitem": c(_LI).sql(2),
        "flip_vertical": _simple(f"stack_id, frame_idx, CAST(7 - y AS INTEGER) AS y, x, {_r('z')} AS z"),
        "slice_frames": "SELECT stack_id, CAST((k - 3) // 4 AS INTEGER) AS frame_idx, pixels FROM (SELECT CAST(label AS VARCHAR) AS stack_id, array_to_string(list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1e6::DOUBLE + 0.5::DOUBLE) AS BIGINT)), ',') AS pixels, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS k, count(*) OVER (PARTITION BY label) AS n FROM embeddings) WHERE k >= 3 AND k < n - 2 AND (k - 3) % 4 = 0",
        "frame_at": c().sql() + " WHERE frame_idx = 7",
        "reread_stack": f"WITH {_EMB}, f AS (SELECT *, row_number() OVER (PARTITION BY y, x ORDER BY frame_idx) - 1 AS k FROM px) SELECT CAST(k AS INTEGER) AS frame_idx, y, x, {_r('z')} AS z, 4.0::DOUBLE AS line_rate FROM f WHERE k >= 7",
        "frame_meta": "SELECT CAST(label AS VARCHAR) AS stack_id, CAST(vec_id AS INTEGER) AS frame_idx, CASE WHEN vec_id % 3 = 0 THEN vec_id * 0.5::DOUBLE END AS timestamp_s, CASE WHEN vec_id % 3 = 0 THEN 'ch' || (vec_id % 2) ELSE 'height_trace' END AS channel, CASE WHEN vec_id % 3 = 0 THEN '{\"timestamp_s\":' || (vec_id * 0.5::DOUBLE) || ',\"own\":\"ch' || (vec_id % 2) || '\"}' ELSE '{}' END AS json FROM embeddings",
        "generate_timestamps": "SELECT CAST(label AS VARCHAR) AS stack_id, CAST(vec_id AS INTEGER) AS frame_idx, CASE WHEN vec_id % 4 > 0 THEN vec_id * (8.0::DOUBLE / (vec_id % 4)) END AS timestamp_s, CASE WHEN vec_id % 4 > 0 THEN (vec_id % 4) / 8.0::DOUBLE ELSE 1.0 END AS fps FROM embeddings",
        "normalize_timestamps": "SELECT o_orderkey, epoch_us(o_orderdate) / 1e6::DOUBLE AS of_time, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(epoch_us(date_trunc('second', o_orderdate)) / 1e6 AS DOUBLE) END AS of_text, o_totalprice AS of_number FROM orders",
        "guess_units": f"WITH {_EMB} SELECT stack_id, {_UNIT} AS unit FROM (SELECT stack_id, max(v) - min(v) AS s FROM (SELECT stack_id, z * pow(10.0, -(CAST(stack_id AS INTEGER) % 6)) * CASE WHEN stack_id = '0' THEN 1e6 ELSE 1 END AS v FROM px) GROUP BY 1)",
        "standardize_units": f"WITH {_to_nm(_EV)} SELECT {_PX}, {_r('z', 4)} AS z FROM nm",
        "convert_units": c().z("z * 1000").sql(3),
        "unit_policies": f"WITH {_to_nm(_EMB)} SELECT k AS policy, stack_id, round(max(CASE k WHEN 'declared_pm' THEN px.z * 1e-3 WHEN 'volts' THEN px.z WHEN 'PH' THEN px.z ELSE nm.z END), 5) AS top FROM px JOIN nm USING (stack_id, frame_idx, y, x), (VALUES ('declared_pm'), ('volts'), ('unknown'), ('TP'), ('PH')) t(k) GROUP BY ALL",
        "frame_stats": f"WITH {_EV} SELECT stack_id, frame_idx, {_r('avg(z)', 6)} AS mean, {_r('stddev_pop(z)', 6)} AS std, {_r('median(z)', 6)} AS median, {_r('min(z)', 6)} AS low, {_r('max(z)', 6)} AS high, count(*) FILTER (z <> 0) AS nonzero FROM px GROUP BY ALL",
        "normalize_uint8": _simple(f"{_PX}, CAST({_GREY} AS INTEGER) AS g"),
        "pad_square": f"WITH {_EV}, {_SQUARE.format(border='-1.0')} SELECT {_PX}, {_r('z', 4)} AS z FROM sq",
        "colormap": f"WITH {_EMB} SELECT {_PX}, {_HEAT} FROM (SELECT *, {_GREY} AS g FROM px)",
        "scale_bar": f"WITH {_EV}, {_SQUARE.format(border='0.0')}, k AS (SELECT *, {_GREY} AS g FROM sq), h AS (SELECT {_PX}, {_HEAT} FROM k) SELECT {_PX}, CAST(CASE WHEN y BETWEEN 4 AND 9 AND x BETWEEN 10 AND 18 THEN 255 ELSE r END AS INTEGER) AS r, CAST(CASE WHEN y BETWEEN 4 AND 9 AND x BETWEEN 10 AND 18 THEN 255 ELSE g END AS INTEGER) AS g, CAST(CASE WHEN y BETWEEN 4 AND 9 AND x BETWEEN 10 AND 18 THEN 255 ELSE b END AS INTEGER) AS b FROM h",
        "scale_bar_and_time": f"WITH {_EV}, {_SQUARE.format(border='0.0')}, k AS (SELECT *, {_GREY} AS g FROM sq), h AS (SELECT {_PX}, {_HEAT} FROM k), glyphs(ch, gy, gx) AS (VALUES {', '.join(f"('{c}', {y}, {x})" for c, rows in display.FONT.items() for y, bits in enumerate(rows) for x in range(3) if int(bits) >> (2 - x) & 1)}), "
        "t AS (SELECT h.*, substr(printf('Time: %.2f s', frame_idx * 0.25), CAST((x - 2) // 4 AS BIGINT) + 1, 1) AS ch FROM h), "
        "l AS (SELECT t.*, glyphs.ch IS NOT NULL OR (t.y BETWEEN 4 AND 9 AND t.x BETWEEN 10 AND 18) AS lit FROM t LEFT JOIN glyphs ON glyphs.ch = t.ch AND glyphs.gy = t.y - 1 AND t.x >= 2 AND glyphs.gx = (t.x - 2) % 4) "
        f"SELECT {_PX}, CAST(CASE WHEN lit THEN 255 ELSE r END AS INTEGER) AS r, CAST(CASE WHEN lit THEN 255 ELSE g END AS INTEGER) AS g, CAST(CASE WHEN lit THEN 255 ELSE b END AS INTEGER) AS b FROM l",
        "letterbox_down": _window_sql(f"{_EV}, px8 AS (SELECT {_PX}, {_GREY} AS g FROM px)", (EV_H, EV_W), (16, 4), (16, 9), "g", 0),
        "letterbox_up": _window_sql(f"{_EMB}, px8 AS (SELECT {_PX}, {_HEAT} FROM (SELECT *, {_GREY} AS g FROM px))", (H, W), (19, 19), (19, 30), "rgb", 7),
        "pipeline_default": default,
        "pipeline_default_pixels": default,
        "pipeline_default_frames": default,
        "pipeline_mixed": own.centred().sql(5),
        "step_faults": f"WITH {', '.join(corner.ctes)} SELECT k AS step, CASE k WHEN 'step_5_polynomial_flatten' THEN frames WHEN 'step_4_flipped' THEN failed ELSE 0 END AS frames FROM (SELECT count(*) AS frames, count(*) FILTER (z > 0) AS failed FROM {corner.last} WHERE y = 0 AND x = 0), (VALUES ('step_1_remove_plane'), ('step_2_left_half'), ('step_3_row_median_align'), ('step_4_flipped'), ('step_5_polynomial_flatten'), ('step_6_mask_threshold'), ('step_7_zero_mean')) t(k)",
        "pipeline_lineitem": c(_LI, LI_H, LI_W).fit(1).medians().sql(2),
        "user_filter": "SELECT CAST(label AS VARCHAR) AS stack_id, CAST(vec_id AS INTEGER) AS frame_idx, CAST(embedding[1] < 0 AS INTEGER) AS errors, array_to_string(list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * (CASE WHEN embedding[1] < 0 THEN 1.0::DOUBLE ELSE 3.0::DOUBLE END) * 1e6::DOUBLE + 0.5::DOUBLE) AS BIGINT)), ',') AS pixels FROM embeddings",
        "wrong_parameters": c().m(above(0)).sql(),
        "mask_threshold": c().m(above(0.05)).sql(),
        "mask_below_threshold": c().m("z < 0.05").sql(),
        "mask_mean_offset": c().high(0.5).sql(),
        "mask_adaptive": c().m("z > avg(z) OVER (PARTITION BY stack_id, frame_idx, y // 3, x // 3) + 0.01").sql(),
        "mask_morphological": _closing_sql(0.1, 3),
        "mask_morphological_even": _closing_sql(0.1, 2),
        "mask_morphological_s7": _closing_sql(0.1, 7),
        "mask_morphological_lineitem": _closing_sql(150000.0, 8, _LI, 2),
        "mask_combine_or": c().m("z > 0.1 OR z < -0.1").sql(),
        "mask_replace": c().m("z < -0.1").sql(),
        "mask_clear": c().centred().sql(),
        "row_median_align": c().medians().sql(),
        "row_median_align_masked": c().m(above(0)).medians().sql(),
        "zero_mean": c().centred().sql(),
        "zero_mean_masked": c().m(above(0)).centred().sql(),
        "remove_plane": _simple(f"{_PX}, {_r(f'z - avg(z) OVER ({_F}) - covar_pop(z, x) OVER ({_F}) / var_pop(x) OVER ({_F}) * (x - 3.5) - covar_pop(z, y) OVER ({_F}) / var_pop(y) OVER ({_F}) * (y - 3.5)')} AS z"),
        "remove_plane_masked": c().m(above(0)).fit(1).sql(),
        "polynomial_flatten_o1": c().fit(1).sql(),
        "polynomial_flatten_o2": c().fit(2).sql(),
        "polynomial_flatten_o3": c().fit(3).sql(),
        "polynomial_flatten_masked": c().m(above(0)).fit(2).sql(),
        "polynomial_flatten_invalid": c().sql(),
        "gaussian_filter_s1": _gauss_sql(1.0),
        "gaussian_filter_s2": _gauss_sql(2.0),
        "pipeline_quickstart": quick(c()).sql(5),
        "pipeline_events": quick(c(_EV, EV_H, EV_W)).sql(6),
    }
