"""File scans with gaps, order, alignment; synthetic streams; sinks."""

import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom.grid import Grid, GridMeta
from gridloom.operators import from_json
from gridloom.sinks.packets import Packetizer, packets
from gridloom.sinks.tiles import manifest, tile_images, write_tiles
from gridloom.operators.analyzers import PlotterTransform
from gridloom.sources.files import FileStream, FileWriter, PacketFileStream, acquisition_files, braces, discard_for_alignment, scan, search_file_cells
from gridloom.sources.synthetic import GaussianNoiseStream, NoiseDataSource, PythonStream

from .arrays import arrays_of, grid_of, random_grid

RNG = np.random.default_rng(5)


def intensity(f, t):
    return np.sin(1.83 * f + 0.329 * t)


def weight(f, t):
    return 1 + np.cos(0.71 * f - 0.87 * t)


def files(spark, spans, nfreq=3, dt=1e-3, t0=7.0, flip=(), **changes):
    """Cells of files that hold the given (first, end) samples, from analytic values."""
    rows = []
    for k, (a, b) in enumerate(spans):
        for t in range(a, b):
            for f in range(nfreq):
                up = k in flip
                rows.append((f"{k:08d}", t0 + t * dt, nfreq - 1 - f if up else f, float(intensity(f, t)), float(weight(f, t)), nfreq, 400.0, 800.0 + changes.get("hi", {}).get(k, 0), dt, up))
    return spark.createDataFrame(rows, "file string, time double, freq int, intensity double, weight double, nfreq int, freq_lo_MHz double, freq_hi_MHz double, dt_sample double, increasing boolean")


def check_analytic(grid, spans, drop=0):
    got = {(r.t, r.freq): (r.intensity, r.weight) for r in grid.cells.collect()}
    want = {(t - drop, f): (intensity(f, t), weight(f, t)) for a, b in spans for t in range(a, b) for f in range(grid.meta.nfreq) if t >= drop}
    assert got.keys() == want.keys()
    assert all(np.allclose(got[k], want[k]) for k in want)


def test_scan_with_gaps_and_flips(spark):
    spans = [(0, 5), (5, 9), (15, 16), (20, 30)]
    g = scan(files(spark, spans, flip=(1, 3)))
    check_analytic(g, spans)
    assert g.meta == GridMeta(3, 1, 400.0, 800.0, 1e-3, 7.0)


@pytest.mark.parametrize(("spans", "changes", "says"), [
    ([(0, 5), (3, 8)], {}, "before the previous"),
    ([(0, 5), (10_100, 10_101)], {}, "too long"),
    ([(0, 5), (5, 8)], {"hi": {1: 5.0}}, "band"),
])
def test_scan_rejects(spark, spans, changes, says):
    with pytest.raises(ValueError, match=says):
        scan(files(spark, spans, **changes))


def test_scan_rejects_fractional_gaps_and_small_differences_if_exact(spark):
    cells = files(spark, [(0, 5), (8, 9)])
    with pytest.raises(ValueError, match="whole"):
        scan(cells.withColumn("time", F.when(F.col("file") == "00000001", F.col("time") + 0.0003).otherwise(F.col("time"))))
    near = files(spark, [(0, 5), (5, 6)], hi={1: 0.01})
    scan(near)
    with pytest.raises(ValueError, match="band"):
        scan(near, exact=True)
    with pytest.raises(ValueError, match="no files"):
        scan(cells.limit(0))


def test_alignment(spark):
    dt = 2.56e-6 * 512
    spans = [(0, 70), (75, 140)]
    g = scan(files(spark, spans, dt=dt, t0=1000 * dt), align=64)
    check_analytic(g, spans, drop=24)
    assert g.meta.t_initial == pytest.approx(1024 * dt)
    for bad in (48, 1 << 20):
        with pytest.raises(ValueError):
            discard_for_alignment(0.0, dt, bad)
    with pytest.raises(ValueError):
        discard_for_alignment(0.0, 1e-5, 64)
    assert discard_for_alignment(5.0, 1e-5, 0) == 0


def test_written_files_read_back(spark, tmp_path):
    i, w = random_grid(RNG, 4, 40)
    g = grid_of(spark, i, w, t_initial=3.0)
    for k, a in enumerate((0, 16, 32)):
        part = g.with_df(g.df.where((F.col("t") >= a) & (F.col("t") < a + 16)))
        FileWriter(str(tmp_path / f"{k:08d}.parquet"))(part)
    (tmp_path / "notes.txt").write_text("no file of the scan")
    with pytest.raises(Exception, match="(?i)exist"):
        FileWriter(str(tmp_path / "00000000.parquet"))(g)
    assert len(acquisition_files(str(tmp_path))) == 3 and len(acquisition_files(str(tmp_path), 2)) == 2
    # a written path is a folder of parts by ranges of time, which the scan takes as files
    names = [str(tmp_path / f"{k:08d}.parquet") for k in range(3)]
    back = FileStream.from_acqdir(str(tmp_path))
    assert back.filename_list == names
    gi, gw = arrays_of(back.load(spark), 40)
    np.testing.assert_allclose(gi, i)
    np.testing.assert_allclose(gw, w)
    with pytest.raises(ValueError):
        FileStream([]).load(spark)
    assert FileStream.from_glob(str(tmp_path / "0000000{0,2}.parquet")).filename_list == [names[0], names[2]]
    assert isinstance(from_json(PacketFileStream(names).jsonize()), PacketFileStream)


def test_a_grid_in_parts_by_channel_reads_back(spark, tmp_path):
    i, w = random_grid(RNG, 6, 50)
    g = grid_of(spark, i, w, t_initial=3.0)
    with_aqe = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        FileWriter(str(tmp_path / "00000000.parquet"))(g.with_df(g.df.repartition(4, "freq")))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", with_aqe)
    assert len(list((tmp_path / "00000000.parquet").glob("part-*"))) > 1
    gi, gw = arrays_of(FileStream.from_acqdir(str(tmp_path)).load(spark), 50)
    np.testing.assert_allclose(gi, i)
    np.testing.assert_allclose(gw, w)


def test_time_range_prunes_files(spark, tmp_path):
    i, w = random_grid(RNG, 2, 30)
    g = grid_of(spark, i, w, t_initial=1.0)
    for k in range(3):
        FileWriter(str(tmp_path / f"{k:08d}.parquet"))(g.with_df(g.df.where(f"t div 10 = {k}").coalesce(1)))
    got = FileStream.from_times(spark, str(tmp_path), 1.012, 1.018)
    gi, _ = arrays_of(got.load(spark), 10)
    np.testing.assert_allclose(gi, i[:, 10:20])


def test_brace_patterns():
    assert braces("a{b,c}d{e,f}") == ["abde", "abdf", "acde", "acdf"]


def test_noise_is_the_same_in_any_partitioning(spark):
    s = GaussianNoiseStream(8, 500, 400.0, 800.0, 1e-3, 3.0, randomize_weights=True, seed=1)
    a = s.load(spark)
    again = a.df.repartition(7)
    assert a.df.exceptAll(again).isEmpty()
    r = a.df.agg(F.avg("intensity"), F.stddev("intensity"), F.min("weight"), F.max("weight")).first()
    assert abs(r[0]) < 0.3 and abs(r[1] - 3) < 0.2 and 0 < r[2] < r[3] < 1
    with pytest.raises(ValueError):
        GaussianNoiseStream(8, 500, 800.0, 400.0, 1e-3)


def test_python_stream_ends_at_none(spark):
    f = lambda c: None if c >= 3 else (np.full((2, 4), float(c)), np.ones((2, 4)))
    gi, gw = arrays_of(PythonStream(GridMeta(2), 4, 5, f).load(spark))
    assert gi.shape == (2, 12) and gi[:, 8:].min() == 2 and gw.min() == 1


def test_data_source(spark):
    spark.dataSource.register(NoiseDataSource)
    df = spark.read.format("grid_noise").options(nfreq=4, nt=100, nt_chunk=32, seed=9).load()
    assert df.count() == 400 and df.exceptAll(spark.read.format("grid_noise").options(nfreq=4, nt=100, nt_chunk=32, seed=9).load()).isEmpty()


def test_packed_search_rows(spark):
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, size=(2, 5, 3), dtype=np.uint8)
    rows = [(k, 5, bytearray(data[k].tobytes()), [1.0, 0.0, 0.5]) for k in range(2)]
    df = search_file_cells(spark.createDataFrame(rows, "row long, nt int, data binary, weights array<double>"), 3)
    gi, gw = arrays_of(Grid(df, GridMeta(3)), 10)
    np.testing.assert_allclose(gi, data.reshape(10, 3).T)
    np.testing.assert_allclose(gw[:, 0], [1.0, 0.0, 0.5])


def test_packets(spark):
    i, w = random_grid(RNG, 8, 16)
    g = grid_of(spark, i, w, dt_sample=2.56e-6 * 384)
    got = packets(g, 1, 8, 0.7, coarse=4).collect()
    assert len(got) == 8 and all(r.n == 16 for r in got)
    assert sum(r.unmasked for r in got) == (w >= 0.7).sum()
    op = Packetizer("host:1", 1, 16, 8, 0.7, coarse=4)
    assert op(g).outputs["packets"].count() == 8
    with pytest.raises(ValueError):
        Packetizer("host:1", 1, 16, 8, 0.7, coarse=4).bind(GridMeta(8, dt_sample=1e-3))
    with pytest.raises(TypeError):
        op.jsonize()


def test_tiles_become_images(spark, tmp_path):
    g = grid_of(spark, *random_grid(RNG, 8, 64))
    tiles = PlotterTransform("p", 4, 16, 2, 2)(g).outputs["tiles_p"]
    got = write_tiles(tile_images(tiles, 16, 4), str(tmp_path), "p")
    assert [x["filename"] for x in got] == ["p_0_0.png", "p_0_1.png", "p_1_0.png"]
    raw = (tmp_path / "p_0_0.png").read_bytes()
    assert raw[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">II", raw[16:24]) == (16, 4)
    assert isinstance(manifest(tiles, "p", 16).toPandas(), pd.DataFrame)
