"""Frames from a stream of pixels: late, repeated and missing ones, and the batch's result."""

import json
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest

from stackloom import model, queries
from stackloom.streaming.assemble import assemble, with_state_store

SCHEMA = "stack_id string, frame_idx int, y int, x int, z double, at timestamp"
START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def run(spark, tmp_path, batches, height, width):
    """Results after each micro-batch of rows (frame, y, x, z, seconds): one file a batch."""
    folder = tmp_path / "in"
    folder.mkdir()
    spark = with_state_store(spark)
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(folder))
    seen: list[list] = []
    query = assemble(source, height, width, "at", "10 seconds", timedelta(seconds=20)).writeStream.foreachBatch(lambda df, _: seen.append(df.collect())).option("checkpointLocation", str(tmp_path / "cp")).start()
    out = []
    try:
        for k, rows in enumerate(batches):
            lines = [json.dumps({"stack_id": s, "frame_idx": f, "y": y, "x": x, "z": z, "at": (START + timedelta(seconds=t)).isoformat()}) for s, f, y, x, z, t in rows]
            (tmp_path / "new").write_text("\n".join(lines) + "\n")
            (tmp_path / "new").rename(folder / f"{k:03d}.json")
            query.processAllAvailable()
            out.append([r for batch in seen for r in batch])
            seen.clear()
    finally:
        query.stop()
    return out


def test_late_repeated_and_missing_pixels(spark, tmp_path):
    a = lambda f, cells, t: [("a", f, y, x, 10.0 * f + y * 2 + x, t) for y, x in cells]
    every = [(0, 0), (0, 1), (1, 0), (1, 1)]
    out = run(
        spark,
        tmp_path,
        [
            a(0, every[:3], 0) + a(1, every, 1) + a(2, every[:2], 2),  # frame 1 is whole
            # a repeated pixel of another value, one outside, the last of frame 0, and more of the whole frame 1
            [("a", 0, 0, 0, 99.0, 3), ("a", 0, 7, 7, 1.0, 3)] + a(0, every[3:], 3) + a(1, every[:1], 3),
            a(3, every[:1], 100),  # the watermark passes frame 2, which lacks two
            a(4, every[:1], 101),
            a(2, every[2:], 2) + a(5, every, 102),  # too late for frame 2
            a(6, every[:1], 300),
            a(6, every[1:], 301),
        ],
        2,
        2,
    )
    rows = [[(r.frame_idx, r.missing, r.complete) for r in sorted(batch, key=lambda r: r.frame_idx)] for batch in out]
    flat = [r for batch in rows for r in batch]
    assert rows[0] == [(1, 0, True)] and rows[1] == [(0, 0, True)]
    assert sorted(flat) == [(0, 0, True), (1, 0, True), (2, 2, False), (3, 3, False), (4, 3, False), (5, 0, True), (6, 0, True)]
    pixels = {r.frame_idx: r.pixels for batch in out for r in batch}
    assert pixels[0] == [0.0, 1.0, 2.0, 3.0] and pixels[1] == [10.0, 11.0, 12.0, 13.0]
    assert pixels[2] == [20.0, 21.0, None, None]


def test_equal_to_the_batch(spark, tmp_path):
    pixels = queries.emb(spark, "/root/testdata/sf0.001").where("frame_idx < 40")
    want = {(r.stack_id, r.frame_idx): r.pixels for r in model.assemble_frames(pixels).collect()}
    rows = [(r.stack_id, r.frame_idx, r.y, r.x, r.z, r.frame_idx * 0.1) for r in pixels.collect()]
    order = np.random.default_rng(1).permutation(len(rows))
    batches = [[rows[i] for i in part] for part in np.array_split(order, 4)]
    out = run(spark, tmp_path, batches, 8, 8)
    got = {(r.stack_id, r.frame_idx): r.pixels for batch in out for r in batch}
    assert len(want) == 40 and got.keys() == want.keys() and all(got[k] == pytest.approx(v) for k, v in want.items())
    assert all(r.complete for batch in out for r in batch)
