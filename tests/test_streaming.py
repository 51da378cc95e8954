"""The stream of a take's blocks gives the frames of the whole take."""

import os

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from strophe.config import Analysis
from strophe.operators import analysis
from strophe.sources import generator
from strophe.sources.generator import Tone
from strophe.streaming.live import live_frames


def test_stream_equals_batch(spark, tmp_path):
    takes = {t: generator.melody([Tone(m, 0.2), Tone(m + 5, 0.2)], 48000)[0].astype("float32") for t, m in (("a", 76), ("b", 80))}
    schema = pa.schema([("take_id", pa.string()), ("sample_rate", pa.int32()), ("block_no", pa.int64()), ("start_sample", pa.int64()), ("samples", pa.list_(pa.float32()))])
    (tmp_path / "in").mkdir()
    for k in range(0, 20000, 7000):
        parts = [r for t, x in takes.items() for r in generator.as_blocks(t, x, 48000, 1000).to_dict("records") if k <= r["start_sample"] < k + 7000]
        path = tmp_path / "in" / f"{k}.parquet"
        pq.write_table(pa.Table.from_pylist(parts[::-1], schema=schema), path)
        os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))
    stream = spark.readStream.schema(generator.AUDIO).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = live_frames(stream).writeStream.format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert query.awaitTermination(90) and len(query.recentProgress) >= 3
    got = spark.table("live").toPandas().sort_values(["take_id", "frame_idx"])
    for take, x in takes.items():
        want, own = analysis.frames_of(x, 48000, Analysis()), got[got.take_id == take]
        assert own.frame_idx.tolist() == want.frame_idx.tolist()
        assert np.allclose(own.hz.to_numpy(float), want.hz, equal_nan=True) and np.allclose(own.t_sec, want.t_sec)


def test_gaps_and_bad_rows_read_alike(spark, tmp_path):
    x = generator.melody([Tone(76, 0.2), Tone(81, 0.2)], 48000)[0].astype("float32")
    rows = generator.as_blocks("a", x, 48000, 1000).to_dict("records")
    rows[3]["samples"] = None
    del rows[7]
    far = {**rows[0], "start_sample": 10**12}
    schema = pa.schema([("take_id", pa.string()), ("sample_rate", pa.int32()), ("block_no", pa.int64()), ("start_sample", pa.int64()), ("samples", pa.list_(pa.float32()))])
    (tmp_path / "in").mkdir()
    for k, part in enumerate((rows[:10], rows[10:] + [far])):
        pq.write_table(pa.Table.from_pylist(part, schema=schema), tmp_path / "in" / f"{k}.parquet")
        os.utime(tmp_path / "in" / f"{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    stream = spark.readStream.schema(generator.AUDIO).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = live_frames(stream).writeStream.format("memory").queryName("gaps").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert query.awaitTermination(90)
    got = spark.table("gaps").toPandas().sort_values("frame_idx")
    want = analysis.analyse(spark.read.schema(generator.AUDIO).parquet(str(tmp_path / "in"))).toPandas().sort_values("frame_idx")
    assert len(got) == len(want) > 0 and np.allclose(got.hz.to_numpy(float), want.hz.to_numpy(float), equal_nan=True) and np.allclose(got.band_rms_db, want.band_rms_db)
