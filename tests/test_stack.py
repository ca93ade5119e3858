"""Stacks, pipelines, steps as text, functions, sources and sinks."""

import json
import struct
from datetime import datetime, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from stackloom import cli
from stackloom.functions import display, names, timestamps, units
from stackloom.plans import registry
from stackloom.plans.pipeline import LoadError, Pipeline, process_stack
from stackloom.plans.registry import Step
from stackloom.plans.steps import dump_steps, load_steps, parse_steps
from stackloom.sources import asd, gif, h5jpk, jpk, npz, tiff
from stackloom.sources.export import export, export_gif, write_exports
from stackloom.sources.load import file_suffix, folder_suffix, load_stack
from stackloom.stack import FrameStack


@pytest.fixture
def stack(spark):
    return FrameStack.from_numpy(spark, np.arange(48.0).reshape(3, 4, 4), 2.0, "height_trace", "x.npz", [{"timestamp": 0.0}])


def test_constructor(spark):
    with pytest.raises(TypeError):
        FrameStack.from_numpy(spark, [[1]], 1.0, "c")
    with pytest.raises(ValueError):
        FrameStack.from_numpy(spark, np.zeros((2, 2)), 1.0, "c")
    for bad in (0, -1.0, "2", True):
        with pytest.raises(ValueError):
            FrameStack.from_numpy(spark, np.zeros((1, 2, 2)), bad, "c")
    with pytest.raises(ValueError):
        FrameStack.from_numpy(spark, np.zeros((1, 2, 2)), 1.0, "c", "", [{}, {}])


def test_access(stack):
    assert (len(stack), stack.image_shape) == (3, (4, 4))
    assert stack.frame_metadata == [{"timestamp": 0.0}, {}, {}]
    np.testing.assert_array_equal(stack[-1], np.arange(32.0, 48.0).reshape(4, 4))
    part = stack[2:0:-1]
    np.testing.assert_array_equal(part.numpy(), np.arange(48.0).reshape(3, 4, 4)[2:0:-1])
    assert len(stack[5:]) == 0
    with pytest.raises(TypeError):
        stack["a"]
    with pytest.raises(IndexError):
        stack.metadata(-1)
    with pytest.raises(IndexError):
        stack.frame(3)
    assert stack.time_of(0) == 0.0 and stack.channel_of(1) == "height_trace"
    assert [i for i, _, _ in stack.frames_with_metadata()] == [0, 1, 2]
    with pytest.raises(KeyError):
        stack.restore_raw()


def test_pipeline_equals_apply(spark, stack):
    Pipeline(stack).add_filter("remove_plane").run()
    assert list(stack.snapshots) == ["raw", "step_1_remove_plane"]
    other = FrameStack.from_numpy(spark, np.arange(48.0).reshape(3, 4, 4), 2.0, "c")
    other.apply(["remove_plane"])
    assert list(other.snapshots) == ["raw", "remove_plane"]
    np.testing.assert_allclose(stack.numpy(), other.numpy(), atol=1e-9)
    stack.restore_raw()
    np.testing.assert_array_equal(stack.numpy(), np.arange(48.0).reshape(3, 4, 4))


def test_mask_history(stack):
    p = Pipeline(stack).add_mask("mask_threshold", threshold=40).add_mask("mask_below_threshold", threshold=2).clear_mask().add_mask("mask_threshold", threshold=1).add_filter("zero_mean")
    p.run()
    assert list(stack.masks) == ["step_1_mask_threshold", "step_2_mask_threshold_mask_below_threshold", "step_4_mask_threshold"]
    assert stack.masks["step_2_mask_threshold_mask_below_threshold"].where("mask").count() == 9
    assert "step_5_zero_mean" in stack.snapshots


def test_running_twice_goes_on_and_keeps_raw(stack):
    p = Pipeline(stack).add_filter("zero_mean")
    p.run()
    p.run()
    assert stack.snapshots["raw"].agg(F.max("z")).first()[0] == 47


def test_unknown_step_raises(stack):
    with pytest.raises(ValueError):
        Pipeline(stack).add_filter("nothing").run()


def test_user_filters(stack):
    registry.register_filter("halve", lambda a: a / 2)
    try:
        Pipeline(stack).add_filter("halve").run_frame_form()
        assert stack.numpy().max() == 23.5
        Pipeline(stack).add_filter("halve").run()
        assert stack.numpy().max() == 11.75
        stack.apply(["halve"])
        assert stack.numpy().max() == 5.875 and stack.snapshots["halve"].agg(F.max("z")).first()[0] == 5.875
        registry.register_filter("gaussian_filter", lambda a: a * 0)
        assert registry.resolve("gaussian_filter").user
    finally:
        registry.PLUGINS.clear()
    with pytest.raises(ValueError):
        registry.load_plugin("median_filter")


def test_steps_as_text(tmp_path):
    assert parse_steps(" remove_plane; gaussian_filter:sigma=2.0 ;; mask_threshold:threshold=2") == [Step("remove_plane"), Step("gaussian_filter", {"sigma": 2.0}), Step("mask_threshold", {"threshold": 2})]
    for bad in ("nothing", "gaussian_filter:sigma"):
        with pytest.raises(ValueError):
            parse_steps(bad)
    steps = [Step("clear"), Step("mask_adaptive", {"block_size": 5})]
    f = tmp_path / "s.yaml"
    f.write_text(dump_steps(steps))
    assert load_steps(f) == steps
    f.write_text(json.dumps({"filters": [{"name": "zero_mean"}]}))
    assert load_steps(f) == [Step("zero_mean")]
    for text in ("{}", "filters: 3", "filters: [{}]", "filters: [{name: nothing}]", "a: [", ""):
        f.write_text(text)
        with pytest.raises(ValueError):
            load_steps(f)
    with pytest.raises(FileNotFoundError):
        load_steps(tmp_path / "none.yaml")


def test_units(spark):
    for span, unit in ((2e5, "pm"), (5e-2, "nm"), (5e-3, "um"), (5e-5, "mm"), (5e-6, "m"), (0.0, "m")):
        px = spark.createDataFrame([("a", 0.0), ("a", span), ("a", float("nan")), ("a", float("inf"))], "stack_id string, z double")
        assert units.guess_units(px).first()["unit"] == unit
    px = spark.createDataFrame([("a", float("nan"))], "stack_id string, z double")
    assert units.guess_units(px).first()["unit"] is None
    assert units.to_nm(spark.createDataFrame([(1e-3,)], "z double"), "m").first()[0] == pytest.approx(1e6)
    with pytest.raises(ValueError):
        units.to_nm(px, "cm")


def test_timestamps(spark):
    when = datetime(2025, 5, 20, 12, tzinfo=timezone.utc)
    values = ["2025-05-20T12:00:00Z", when, 2.5, None, "not-a-date"]
    assert [timestamps.one(v) for v in values] == [when.timestamp(), when.timestamp(), 2.5, None, None]
    df = spark.createDataFrame([("2025-05-20T12:00:00Z",), ("not-a-date",), (None,)], "t string")
    assert [r[0] for r in df.select(timestamps.seconds(F.col("t"), df.schema["t"].dataType)).collect()] == [when.timestamp(), None, None]


def test_display(spark):
    px = FrameStack.from_numpy(spark, np.array([[[0, 1], [2, 3.0]], [[42, 42], [42, 42.0]], [[np.nan, np.inf], [0, 0]]]), 1.0, "c").pixels
    g = display.grey(px).groupBy("frame_idx").agg(F.min("g"), F.max("g")).orderBy("frame_idx").collect()
    assert [tuple(r)[1:] for r in g] == [(0, 255), (0, 0), (0, 0)]
    px = FrameStack.from_numpy(spark, np.arange(1.0, 9).reshape(1, 2, 4), 1.0, "c").pixels
    sq = {(r.y, r.x): r.z for r in display.pad_square(px, 2, 4).collect()}
    assert len(sq) == 16 and all(sq[y, x] == 0 for y in (0, 3) for x in range(4)) and sq[1, 0] == 1
    rgb = spark.createDataFrame([(k,) for k in (0, 100, 255)], "g int").select(display.heat(F.col("g")).alias("c")).collect()
    assert [tuple(r.c) for r in rgb] == [(0, 0, 0), (200, 72, 0), (255, 255, 255)]


def test_names(tmp_path):
    assert names.output_name("  result.gif  ", "d") == "result"
    assert names.output_name("", "d") == "d"
    with pytest.raises(ValueError):
        names.output_name("inva|id", "d")
    assert names.output_folder(tmp_path / "a" / "b").is_dir()
    with pytest.raises(ValueError):
        names.output_folder(tmp_path / "a*")


def test_npz_and_tiff_and_export(spark, stack, tmp_path):
    out = export(stack, tmp_path, "r", ["tif", "npz", "parquet"])
    assert [p.name for p in out] == ["r.ome.tif", "r.npz", "r.parquet"]
    raw = out[0].read_bytes()
    pages = tiff.pages(raw)
    assert len(pages) == 3 and 'SizeT="3"' in pages[0][tiff.DESCRIPTION][0] and "PhysicalSizeX=\"0.002\"" in pages[0][tiff.DESCRIPTION][0]
    np.testing.assert_array_equal(np.stack([tiff.image(raw, p) for p in pages]), np.arange(48.0).reshape(3, 4, 4))
    again = load_stack(spark, out[1])
    np.testing.assert_array_equal(again.numpy(), np.arange(48.0).reshape(3, 4, 4))
    assert again.frame_metadata[0]["timestamp"] == 0.0 and again.frame_metadata[1]["timestamp"] is None
    assert spark.read.parquet(str(out[2])).count() == 3
    Pipeline(stack).add_filter("zero_mean").run()
    assert write_exports(stack, tmp_path, "r", ["tiff"])[0].name == "r_filtered.ome.tif"
    assert export(stack, tmp_path, "q", ["npz"], raw=True)[0].name == "q.npz"
    with pytest.raises(SystemExit):
        export(stack, tmp_path, "r", ["bmp"])


def test_single_frame_tiff(tmp_path):
    tiff.write_ome(tmp_path / "a.tif", [np.ones((2, 3))], 1, 1.0, [None], "a<b")
    assert len(tiff.pages((tmp_path / "a.tif").read_bytes())) == 1
    with pytest.raises(ValueError):
        tiff.pages(b"nothing of the kind")


def unlzw(data):
    bits = int.from_bytes(data, "little")
    at, width, out = 0, 9, bytearray()
    table, prev = {}, None
    while True:
        code = bits >> at & ((1 << width) - 1)
        at += width
        if code == 257:
            return bytes(out)
        if code == 256:
            table, prev, width = {i: bytes([i]) for i in range(256)}, None, 9
            continue
        word = table[code] if code in table else prev + prev[:1]
        out += word
        if prev is not None and len(table) + 2 < 4096:
            table[len(table) + 2] = prev + word[:1]
            if len(table) + 2 == 1 << width and width < 12:
                width += 1
        prev = word


def test_lzw_round_trip():
    g = np.random.default_rng(1)
    for data in (b"\0", bytes(5000), g.integers(0, 256, 20000, np.uint8).tobytes(), g.integers(0, 3, 30000, np.uint8).tobytes()):
        assert unlzw(gif.lzw(data)) == data


def test_gif(stack, tmp_path):
    with pytest.raises(ValueError):
        gif.animate(tmp_path / "a.gif", [np.ones((4, 4))], 1.0, None)
    with pytest.raises(KeyError):
        export_gif(stack, True, tmp_path, "a")
    stack.frame_metadata = [{"timestamp": t} for t in (0.0, "x", None)]
    raw = export_gif(stack, True, tmp_path, "a").read_bytes()
    assert raw.startswith(b"GIF89a") and raw.count(b"\x21\xf9\x04\x04" + struct.pack("<H", 25)) == 3
    assert export_gif(stack, False, tmp_path, "b") is None


def jpk_file(path, z, channel=b"Height", extra=0.0):
    """A TIFF of an empty first page and one channel page of int16."""
    h, w = z.shape

    def page(at, tags, data=b"", last=True):
        body, tail = b"", b""
        where = at + 2 + 12 * len(tags) + 4
        for tag, kind, values in sorted(tags):
            raw = values if kind == 2 else struct.pack("<" + tiff.TYPES[kind][1] * len(values), *values)
            n = len(raw) // tiff.TYPES[kind][0]
            if len(raw) > 4:
                body += struct.pack("<HHII", tag, kind, n, where + len(tail))
                tail += raw
            else:
                body += struct.pack("<HHI", tag, kind, n) + raw.ljust(4, b"\0")
        end = where + len(tail) + len(data)
        return struct.pack("<H", len(tags)) + body + struct.pack("<I", 0 if last else end) + tail + data

    first = page(8, [(jpk.GRID_ULENGTH, 12, [w * (2e-9 + extra)]), (jpk.GRID_ILENGTH, 4, [w]), (tiff.SCAN_RATE, 12, [8.0])], last=False)
    at = 8 + len(first)
    data = z.astype("<i2").tobytes()
    tags = [(tiff.WIDTH, 4, [w]), (tiff.LENGTH, 4, [h]), (tiff.BITS, 3, [16]), (tiff.FORMAT, 3, [2]), (tiff.COUNTS, 4, [len(data)]), (jpk.CHANNEL_NAME, 2, channel + b"\0"), (jpk.RETRACE, 4, [0]), (jpk.N_SLOTS, 4, [1]), (jpk.DEFAULT_SLOT, 2, b"nominal\0"), (jpk.FIRST_SLOT, 2, b"nominal\0"), (jpk.SCALING_TYPE, 2, b"LinearScaling\0"), (jpk.SCALING, 12, [1e-9]), (jpk.OFFSET, 12, [1e-9])]
    size = len(page(at, [*tags, (tiff.OFFSETS, 4, [0])]))
    path.write_bytes(struct.pack("<2sHI", b"II", 42, 8) + first + page(at, [*tags, (tiff.OFFSETS, 4, [at + size])], data))


def test_jpk_folder(spark, tmp_path):
    z = np.arange(6).reshape(2, 3)
    jpk_file(tmp_path / "b.jpk", z + 10)
    jpk_file(tmp_path / "a.JPK", z)
    (tmp_path / "c.txt").write_text("")
    s = load_stack(spark, tmp_path)
    np.testing.assert_allclose(s.numpy(), np.stack([np.flipud(z), np.flipud(z + 10)]) + 1)
    assert s.pixel_size_nm == pytest.approx(2.0) and s.frame_metadata[1]["timestamp"] == 2 / 8
    with pytest.raises(Exception, match="no channel"):
        load_stack(spark, tmp_path, "error_trace").numpy()
    jpk_file(tmp_path / "d.jpk", z, extra=1e-9)
    with pytest.raises(ValueError, match="pixel size"):
        load_stack(spark, tmp_path)
    jpk_file(tmp_path / "d.jpk", np.zeros((3, 3)))
    with pytest.raises(ValueError, match="shape"):
        load_stack(spark, tmp_path)
    with pytest.raises(LoadError):
        process_stack(spark, tmp_path, "height_trace", [])


def test_dispatch(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        load_stack(spark, tmp_path / "none")
    with pytest.raises(FileNotFoundError):
        folder_suffix(tmp_path)
    (tmp_path / "a.SPM").write_text("")
    (tmp_path / "b.spm").write_text("")
    assert folder_suffix(tmp_path) == ".spm"
    with pytest.raises(ValueError, match="not yet"):
        load_stack(spark, tmp_path)
    (tmp_path / "c.jpk").write_text("")
    assert folder_suffix(tmp_path) == ".jpk"
    with pytest.raises(ValueError, match="folder"):
        file_suffix(tmp_path / "c.jpk")
    with pytest.raises(ValueError, match="not supported"):
        file_suffix(tmp_path / "c.xyz")


class Group(dict):
    def __init__(self, attrs=None, **parts):
        super().__init__(**parts)
        self.attrs = attrs or {}


def test_h5_facts():
    ch = lambda name, retrace, **more: Group({h5jpk.NAME: name, h5jpk.RETRACE: retrace, **more})
    grid = {h5jpk.ILENGTH: 128, h5jpk.JLENGTH: 64, h5jpk.ULENGTH: 1.5e-7, h5jpk.RATE: 50.0}
    f = Group(Measurement_000=Group(grid, Channel_000=ch(b" Height ", b"false", **{h5jpk.MULTIPLIER: 2.0, h5jpk.OFFSET: 1.0, h5jpk.UNIT: b"m"}), Channel_001=ch("Height", "TRUE"), Channel_002=ch("height", "false")), Other=Group())
    assert h5jpk.channels(f) == {"height_trace": ("Measurement_000", "Channel_000"), "height_retrace": ("Measurement_000", "Channel_001")}
    assert h5jpk.find(f, "height_retrace")[2] == "Height"
    with pytest.raises(ValueError, match="height_trace"):
        h5jpk.find(f, "x_trace")
    m = f["Measurement_000"]
    assert h5jpk.scaling(m["Channel_000"]) == (2.0, 1.0) and h5jpk.scaling(m["Channel_001"]) == (1.0, 0.0)
    assert h5jpk.unit_of(m["Channel_000"]) == "m" and h5jpk.unit_of(m["Channel_001"]) == "1.0" and h5jpk.unit_of(None) is None
    assert h5jpk.shape(m) == (64, 128) and h5jpk.pixel_size(m) == pytest.approx(1.171875) and h5jpk.line_rate(m) == 50
    with pytest.raises(KeyError):
        h5jpk.line_rate(Group())
    with pytest.raises(ValueError):
        h5jpk.pixel_size(Group({h5jpk.ILENGTH: 0, h5jpk.ULENGTH: 1.0}))


def test_asd_facts(spark):
    s = asd.from_decoded(spark, np.array([[[0.0, 0.05]], [[0.0, 0.01]]]), 0.5, {"frame_time": 500}, "TP")
    assert s.numpy().max() == pytest.approx(0.05) and s.frame_metadata[1] == {"timestamp": 0.5, "line_rate": 2.0}


def test_cli(spark, stack, tmp_path, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    src = npz.save(tmp_path / "in", stack.numpy(), 2.0, [0.0, 1.0, 2.0], "c")
    cli.main(["run", str(src), "--processing", "zero_mean", "--export", "'npz'", "--output-folder", str(tmp_path / "o"), "--make-gif"])
    assert {p.name for p in (tmp_path / "o").iterdir()} == {"in_filtered.npz", "in_filtered.gif"}
    cli.main(["play", str(src), "--keys", "ntf g", "--output-folder", str(tmp_path / "p")])
    assert {p.name for p in (tmp_path / "p").iterdir()} == {"in.npz", "in.ome.tif", "in.gif", "view.gif"}
    for bad in (["run", str(tmp_path / "none.npz")], ["run", str(src), "--processing", "nothing"]):
        with pytest.raises(SystemExit) as e:
            cli.main(bad)
        assert e.value.code == 1
    with pytest.raises(SystemExit) as e:
        cli.main([])
    assert e.value.code == 0


def test_wizard(spark, stack, tmp_path, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    src = npz.save(tmp_path / "in", stack.numpy(), 2.0, [0.0, 1.0, 2.0], "c")
    args = cli.parser().parse_args(["wizard", str(src), "--output-folder", str(tmp_path / "o")])
    said: list[str] = []
    answers = iter(["help", "add nothing", "add zero_mean", "add mask_threshold", "", "move 2 1", "add remove_plane", "remove 3", "remove 9", "list", f"save {tmp_path / 's.yaml'}", "what", "run", "npz", "n"])
    cli.wizard(args, lambda _: next(answers), said.append)
    assert load_steps(tmp_path / "s.yaml") == [Step("mask_threshold", {"threshold": 1.0}), Step("zero_mean")]
    assert (tmp_path / "o" / "in_filtered.npz").exists() and any("no step 9" in s for s in said)

    def ended(_):
        raise EOFError

    with pytest.raises(SystemExit) as e:
        cli.wizard(args, ended, said.append)
    assert e.value.code == 0


def test_exit_codes(monkeypatch, tmp_path):
    def fails(error):
        def action(*_):
            raise error

        return action

    where = {"action": lambda e: monkeypatch.setattr(cli, "run", fails(e)), "around": lambda e: monkeypatch.setattr(cli, "setup_logging", fails(e))}
    for place, error, code in (("action", LoadError("x"), 1), ("action", RuntimeError("x"), 1), ("around", LoadError("x"), 1), ("around", RuntimeError("x"), 2)):
        where[place](error)
        with pytest.raises(SystemExit) as e:
            cli.main(["run", str(tmp_path)])
        assert e.value.code == code


def test_declared_plugin(monkeypatch, stack):
    import tomllib
    from importlib.metadata import EntryPoint
    from pathlib import Path

    declared = tomllib.loads((Path(cli.__file__).resolve().parents[1] / "pyproject.toml").read_text())["project"]["entry-points"][registry.ENTRY_POINTS]
    points = [EntryPoint(n, v, registry.ENTRY_POINTS) for n, v in declared.items()]
    monkeypatch.setattr(registry, "entry_points", lambda group: points if group == registry.ENTRY_POINTS else [])
    Pipeline(stack).add(parse_steps("median_filter:size=3;zero_mean")).run()
    z = np.arange(16.0).reshape(4, 4)
    one = np.array([[np.median(np.pad(z, 1, mode="symmetric")[y : y + 3, x : x + 3]) for x in range(4)] for y in range(4)])
    np.testing.assert_allclose(stack[0], one - one.mean(), atol=1e-9)


def test_entry_module_leaves_out_what_cannot_be_imported(monkeypatch):
    import importlib
    import sys

    import __spark_entry__ as entry

    monkeypatch.setitem(sys.modules, "stackloom.llm.queries", None)
    with pytest.warns(UserWarning, match="left out"):
        importlib.reload(entry)
    assert "remove_plane" in entry.queries() and not any(q.startswith("op") for q in entry.queries())
    monkeypatch.undo()
    importlib.reload(entry)


def test_stream(spark, stack, tmp_path):
    from stackloom.streaming import frames as S

    stack.frames().write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    rows = S.process(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), parse_steps("zero_mean"), "um")
    S.to_parquet(rows, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 3 and max(got.first()["pixels"]) == pytest.approx(7500)
    with pytest.raises(ValueError):
        S.process(rows, [], "cm")
