import json
import math

import pytest
from pyspark.sql import functions as F

from blocklens.functions import scalar as S
from blocklens.operators import metrics as M
from blocklens.operators import render as R
from blocklens.schemas import SAMPLES
from blocklens.streaming import progress as G

BOTH = [(4.2, 1048576, 320000, "compressed"), (7.95, 1048576, 1048580, "stored")] * 16


def value(spark, column, **names):
    row = spark.createDataFrame([tuple(names.values())], ", ".join(f"{n} {'double' if isinstance(v, float) else 'long' if isinstance(v, int) else 'string'}" for n, v in names.items()))
    return row.select(column).first()[0]


def test_heatmap_summary(spark):
    found = M.heatmap_summary(spark.createDataFrame(BOTH, SAMPLES)).first()
    assert (found["compressed_blocks"], found["stored_blocks"]) == (16, 16)
    assert found["mean_entropy"] == pytest.approx(6.075, abs=0.01) and found["overall_ratio"] < 1
    empty = M.heatmap_summary(spark.createDataFrame([], SAMPLES)).first()
    assert empty["overall_ratio"] == 1.0 and empty["mean_entropy"] == 0.0


def test_maps(spark):
    samples = spark.createDataFrame([(i, *r) for i, r in enumerate(BOTH)], f"i int, {SAMPLES}")
    summary = M.heatmap_summary(samples).first().asDict()
    text = R.ansi_map(samples, summary, ["i"], elapsed=1.0)
    for word in ("Compressibility Map", "Entropy ramp", "Compressed:", "Stored:", "Mean entropy: 6.0", "\x1b[38;2;"):
        assert word in text
    image = R.ppm_map(samples, ["i"], cell=4, columns=8)
    assert image.startswith(b"P6\n32 16\n255\n") and len(image) == len(b"P6\n32 16\n255\n") + 1536
    assert R.ansi_map(samples.limit(0), summary, ["i"]) == "  (no compressible blocks recorded)\n"


def test_samples_of_entries(spark):
    rows = spark.createDataFrame([(0, 4.0, 100, "deflate", 6, 150, 75), (0, 7.9, 50, "deflate", 6, 150, 75), (1, 4.0, 10, "stored", 0, 10, 10)], "e int, entropy double, byte_count long, method string, level int, entry_bytes long, stored_bytes long")
    assert [(r["stored_bytes"], r["disposition"]) for r in M.heatmap_samples(rows, ["e"]).orderBy("original_bytes").collect()] == [(25, "stored"), (50, "compressed")]
    whole = rows.select("entry_bytes", "stored_bytes", "method").limit(1)
    assert M.coarse_samples(whole).first().asDict() == {"entropy": 0.0, "original_bytes": 150, "stored_bytes": 75, "disposition": "compressed"}


def test_stage_table(spark):
    rows = spark.createDataFrame([("entropy.probe", 1.0), ("archive.write", 2.0), ("compute.crc", 6.0), ("compute.crc", 2.0), ("compute.compress", 8.0)], "stage string, seconds double")
    found = {r["stage"]: r for r in M.stage_table(rows, 4.0, batches=10, wall_stages=M.WALL_STAGES).collect()}
    assert found["(unaccounted)"]["seconds"] == 1.0 and found["(unaccounted)"]["ms_per_batch"] is None
    assert found["archive.write"]["percent"] == 50.0 and found["archive.write"]["ms_per_batch"] == 200.0
    assert found["compute.crc"]["percent"] == 50.0 and found["compute.crc"]["kind"] == "cpu"
    assert "(unaccounted)" in R.stage_text(M.stage_table(rows, 4.0))
    assert M.stage_table(rows, 1.0).filter("stage = '(unaccounted)'").first()["seconds"] == 0.0
    assert "bytes in" in R.analyze_text("pack", {"elapsed": 2.0, "entries": 1, "bytes_in": 10, "bytes_out": 5}, M.stage_table(rows, 4.0), batches=1, batch_bytes=1 << 20)


def test_progress(spark):
    ticks = spark.createDataFrame([(100,), (250,)], "bytes long")
    assert M.progress_snapshot(ticks, 1000, 1.0).first()["fraction"] == 0.35
    assert M.progress_snapshot(ticks, 0, 1.0).first()["fraction"] is None
    assert M.progress_snapshot(ticks, 100, 1.0).first()["fraction"] == 1.0
    assert math.isinf(M.progress_snapshot(ticks.limit(0), 1000, 1.0).first()["eta_seconds"])
    assert M.progress_snapshot(ticks, 7000, 1.0).first()["eta_seconds"] == pytest.approx(19.0)


def test_progress_lines(spark):
    rows = spark.createDataFrame([("pack", 350, 1000, 35.4, 12.3456, False), ("zip", 0, 1000, 0.0, float("inf"), True)], "phase string, processed long, total long, bytes_per_second double, eta_seconds double, done boolean")
    lines = rows.select(G.encode_progress(rows).alias("value"))
    decoded = [json.loads(r[0]) for r in lines.collect()]
    assert decoded[0] == {"phase": "pack", "processed": 350, "total": 1000, "bytesPerSecond": 35, "etaSeconds": 12.346, "done": False}
    assert decoded[1]["etaSeconds"] is None and decoded[1]["done"] is True
    noise = spark.createDataFrame([("plain text",), ("{broken",), ('{"other": 1}',)], "value string")
    parsed = G.parse_progress(lines.union(noise))
    assert [r["is_progress"] for r in parsed.collect()] == [True, True, False, False, False]
    kept = G.last_lines(parsed.withColumn("n", F.monotonically_increasing_id()), "n", keep=2).collect()
    assert {r["value"] for r in kept} == {"{broken", '{"other": 1}'}


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.log").write_text('{"phase":"pack","processed":5,"total":10,"bytesPerSecond":1,"etaSeconds":null,"done":false}\nnoise\n')
    (tmp_path / "in/b.log").write_text('{"phase":"pack","processed":10,"total":10,"bytesPerSecond":1,"etaSeconds":0.0,"done":true}\n')
    found = G.run_once(G.latest_by_phase(G.progress_stream(spark, str(tmp_path / "in"))), str(tmp_path / "latest")).collect()
    assert [(r["phase"], r["processed"], r["done"], r["fraction"]) for r in found] == [("pack", 10, True, 1.0)]
    counts = {r["byte"]: r["n"] for r in G.run_once(G.histogram_stream(spark, str(tmp_path / "in")), str(tmp_path / "bytes")).collect()}
    assert counts[ord("\n")] == 3 and sum(counts.values()) == sum(p.stat().st_size for p in (tmp_path / "in").iterdir())


def test_event_time_stream(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parquet*")
    found = G.run_once(G.stage_stream(stream), str(tmp_path / "windows"), mode="append").collect()
    assert 0 < sum(r["n"] for r in found) <= events.count()


@pytest.mark.parametrize("n, human, report, preflight", [(0, "     0 B ", "0 B", "0.0 MB"), (999, "   999 B ", "999 B", "0.0 MB"), (1500, "  1.50 KB", "1.50 KB", "0.0 MB"), (2_500_000_000, "  2.50 GB", "2.50 GB", "2.50 GB"), (3 * 10**12, "  3.00 TB", "3000.00 GB", "3000.0 GB")])
def test_sizes(spark, n, human, report, preflight):
    assert value(spark, S.human_bytes(F.col("n")), n=n) == human
    assert value(spark, S.report_bytes(F.col("n")), n=n) == report
    assert value(spark, S.preflight_bytes(F.col("n")), n=n) == preflight


@pytest.mark.parametrize("seconds, text", [(5.0, " 5s"), (59.4, "59s"), (61.0, "1:01"), (3661.0, "1:01:01"), (float("inf"), "  ?  ")])
def test_eta(spark, seconds, text):
    assert value(spark, S.eta_text(F.col("s")), s=seconds) == text


@pytest.mark.parametrize("entropy, rgb", [(0.0, (24, 35, 110)), (3.0, (35, 130, 165)), (8.0, (210, 60, 70)), (9.0, (210, 60, 70)), (1.5, (29, 82, 137))])
def test_ramp(spark, entropy, rgb):
    c = value(spark, S.colour(F.col("e"), F.lit(1.0)), e=entropy)
    assert (c["r"], c["g"], c["b"]) == rgb


@pytest.mark.parametrize("ratio, bar", [(0.0, "▁"), (1.0, "█"), (1.7, "█"), (0.5, "▅")])
def test_bars(spark, ratio, bar):
    assert value(spark, S.bar_glyph(F.col("r")), r=ratio) == bar


def test_dos_words(spark):
    stamp = F.to_timestamp(F.lit("2024-02-29 23:59:59"))
    row = spark.range(1).select(S.dos_date(stamp).alias("d"), S.dos_time(stamp).alias("t")).first()
    assert (row["d"], row["t"]) == (44 << 9 | 2 << 5 | 29, 23 << 11 | 59 << 5 | 29)
    back = spark.range(1).select(F.date_format(S.from_dos(F.lit(row["d"]), F.lit(row["t"])), "yyyy-MM-dd HH:mm:ss"), F.date_format(S.from_dos(F.lit(44 << 9 | 13 << 5 | 1), F.lit(0)), "yyyy")).first()
    assert tuple(back) == ("2024-02-29 23:59:58", "1970")


def test_progress_bar_fits():
    for width in (200, 80, 60, 40, 20):
        assert len(R.progress_bar("pack", 350, 1000, 10.0, 65.0, width)) <= width
    assert "·" in R.progress_bar("pack", 0, 0, 0.0, None) and "ETA" in R.progress_bar("pack", 1, 2, 1.0, 5.0, 120)


def test_skips_text(spark):
    rows = [(f".h{i}", "hidden", i * 1000, 1 + i % 2) for i in range(12)] + [(f"l{i}", "symlink", 1, 1) for i in range(7)]
    text = R.skips_text(spark.createDataFrame(rows, "rel string, reason string, bytes long, items long"))
    assert "12 top-level entries" in text and "and 4 more hidden" in text and "and 2 more symlinks" in text
    assert "nothing skipped" in R.skips_text(spark.createDataFrame([], "rel string, reason string, bytes long, items long"))
