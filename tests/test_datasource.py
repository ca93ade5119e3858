"""Stacks as a data source: what reaches the reader, and frames written and read again."""

import contextlib

import numpy as np
import pytest

from stackloom.sources import files, h5jpk, jpk
from stackloom.sources.datasource import FORMAT, StackReader, register
from stackloom.sources.load import load_stack
from stackloom.stack import FrameStack


@pytest.fixture
def folder(spark, tmp_path):
    d = np.random.default_rng(1).normal(size=(10, 4, 6))
    stack = FrameStack.from_numpy(register(spark), d, 2.5, "height_trace")
    url = f"file://{tmp_path}/frames"
    stack.frames().repartition(3).write.format(FORMAT).mode("append").option("pixelSizeNm", 2.5).option("lineRate", 8.0).save(url)
    return url, d


def test_round_trip(spark, folder):
    url, d = folder
    assert files.kind(url) == "folder" and len(files.names(url)) == 10
    stack = load_stack(spark, url)
    np.testing.assert_allclose(stack.numpy(), d, atol=1e-12)
    assert stack.pixel_size_nm == pytest.approx(2.5) and stack.frame_metadata[3] == {"timestamp": 3 * 4 / 8, "line_rate": 8.0}
    # as arrays, without any shuffle
    plan = stack.frames()._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan" in plan and "Exchange" not in plan
    stored = spark.read.format(FORMAT).option("flip", False).load(url).where("frame_idx = 2").first()
    np.testing.assert_allclose(np.array(stored.pixels).reshape(4, 6), d[2, ::-1], atol=1e-12)


def test_ranges_reach_the_reader(spark, folder):
    url, d = folder
    source = lambda **options: spark.read.format(FORMAT).options(framesPerTask=2, **options).load(url)
    rows, some = source(), source(frames="3:8", channel="height_trace")
    assert (rows.rdd.getNumPartitions(), some.rdd.getNumPartitions(), source(frames="9:").rdd.getNumPartitions()) == (5, 3, 1)
    assert sorted(r.frame_idx for r in some.select("frame_idx").collect()) == [3, 4, 5, 6, 7]
    assert source(frames="99:").count() == 0 and source(frames=":0").count() == 0
    facts = source(pixels=False)
    assert facts.where("pixels IS NULL").count() == 10
    # a table used twice, with different filters, has all of its rows each time
    both = rows.where("frame_idx < 2").unionAll(rows.where("frame_idx >= 8"))
    assert sorted(r[0] for r in both.select("frame_idx").collect()) == [0, 1, 8, 9] and rows.count() == 10


def test_one_frame_opens_one_file(monkeypatch, spark, folder):
    url, d = folder
    opened = []
    real = files.read
    monkeypatch.setattr(files, "read", lambda u: opened.append(u) or real(u))
    r = StackReader({"path": url, "frames": "4:7", "channel": "height_trace"})
    batches = [b for p in r.partitions() for b in r.read(p)]
    assert [u[-8:-4] for u in opened] == ["0004", "0005", "0006"]
    assert batches[0].column(1).to_pylist() == [4, 5, 6]
    stack = load_stack(spark, url)
    asked = []
    read = stack.source
    stack.source = lambda low, high: asked.append((low, high)) or read(low, high)
    np.testing.assert_allclose(stack[-1], d[9], atol=1e-12)
    np.testing.assert_allclose(stack[2:8:3].numpy(), d[2:8:3], atol=1e-12)
    assert asked == [(9, 10), (2, 6)]
    # what steps have made isn't read from the files
    stack.apply(["zero_mean"])
    assert abs(stack[0].mean()) < 1e-9 and len(asked) == 2


def test_errors(spark, folder, tmp_path):
    url, _ = folder
    with pytest.raises(Exception, match="no channel"):
        load_stack(spark, url, "error_trace")
    with pytest.raises(Exception, match="append"):
        spark.range(1).selectExpr("id AS frame_idx", "1 AS height", "1 AS width", "array(1D) AS pixels").write.format(FORMAT).mode("overwrite").save(url)
    files.write(f"{url}/broken.jpk", b"no image")
    with pytest.raises(Exception, match="no TIFF"):
        spark.read.format(FORMAT).load(url).count()


def test_channels_and_lengths():
    z = np.arange(6.0).reshape(2, 3)
    for channel in ("height_trace", "phase_retrace", "a_trace"):
        (name, shape, size, rate, image), = jpk.channels(jpk.encode(z, channel, 3.0, 7.0))
        assert (name, shape, rate) == (channel, (2, 3), 7.0) and size == pytest.approx(3.0)
        np.testing.assert_allclose(image(True), z)
    assert next(jpk.channels(jpk.encode(z, "height_trace", 3.0)))[3] is None


class Group(dict):
    def __init__(self, attrs=None, **parts):
        super().__init__(**parts)
        self.attrs = attrs or {}


def test_one_file_of_many_frames(monkeypatch):
    grid = {h5jpk.ILENGTH: 3, h5jpk.JLENGTH: 2, h5jpk.ULENGTH: 6e-9, h5jpk.RATE: 4.0}
    data = np.arange(30).reshape(6, 5)
    ch = lambda name, unit: Group({h5jpk.NAME: name, h5jpk.MULTIPLIER: 2.0, h5jpk.OFFSET: 1.0, h5jpk.UNIT: unit}, **{name: data})
    file = Group(Measurement_000=Group(grid, Channel_000=ch("Height", b"m"), Channel_001=ch("Phase", b"deg")))
    monkeypatch.setattr(h5jpk, "opened", contextlib.contextmanager(lambda url: (yield file)))
    r = StackReader({"path": "s3://somewhere/x.H5-JPK", "framesPerTask": 2, "frames": "1:"})
    parts = r.partitions()
    assert [[k for k, _ in p.items] for p in parts] == [[1, 2], [3, 4]]
    rows = [row for p in parts for b in r.read(p) for row in b.to_pylist()]
    assert [(x["frame_idx"], x["channel"]) for x in rows] == [(1, "height_trace"), (2, "height_trace"), (1, "phase_trace"), (2, "phase_trace"), (3, "height_trace"), (4, "height_trace"), (3, "phase_trace"), (4, "phase_trace")]
    raw = (data[:, 3] * 2.0 + 1.0).reshape(2, 3)[::-1].ravel()
    np.testing.assert_allclose(rows[4]["pixels"], raw * 1e9)
    np.testing.assert_allclose(rows[6]["pixels"], raw)
    assert rows[0]["pixel_size_nm"] == pytest.approx(2.0) and rows[0]["line_rate"] == 4.0
    with pytest.raises(ValueError, match="no channel"):
        [*StackReader({"path": "x.h5-jpk", "channel": "x_trace"}).read(parts[0])]
