"""Streams give what the batch gives."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.grid import SCHEMA
from gridloom.operators.analyzers import variance_v1
from gridloom.operators.clippers import IntensityClipper
from gridloom.operators.containers import Pipeline
from gridloom.operators.detrenders import PolynomialDetrender
from gridloom.operators.fillers import OnlineMaskFiller
from gridloom.sources.synthetic import NoiseDataSource
from gridloom.streaming.chunks import run_chunks, running_mask_counts
from gridloom.streaming.state import running_variance

from .arrays import grid_of, random_grid

RNG = np.random.default_rng(8)


def written(df, tmp_path, pieces):
    """The cells as files, one per time range, in order."""
    for k, (a, b) in enumerate(pieces):
        df.where((F.col("t") >= a) & (F.col("t") < b)).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{k:03d}"))
    return str(tmp_path / "in/*")


def stream(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def test_chunks_leave_complete_and_late_cells_are_dropped(spark, tmp_path):
    i, w = random_grid(RNG, 3, 64)
    g = grid_of(spark, i, w)
    path = written(g.df, tmp_path, [(0, 20), (20, 40), (40, 64)])
    chain = Pipeline([PolynomialDetrender(16, "time", 1), IntensityClipper(16, "time", 1.5)])
    out = str(tmp_path / "out")

    def sink(grid, batch_id):
        grid.cells.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    q = run_chunks(stream(spark, path), g.meta, 16, 0.0, chain, sink).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    got = {(r.t, r.freq): (r.intensity, r.weight) for r in spark.read.parquet(f"{out}/*").collect()}
    want = {(r.t, r.freq): (r.intensity, r.weight) for r in chain(g).cells.collect()}
    # the last chunk waits for a later sample
    assert max(t for t, _ in got) == 47
    assert all(np.allclose(v, want[k]) for k, v in got.items()) and len(got) == 3 * 48


def test_running_counts(spark, tmp_path):
    i, w = random_grid(RNG, 3, 64)
    g = grid_of(spark, i, w)
    path = written(g.df, tmp_path, [(0, 30), (30, 64)])
    q = running_mask_counts(stream(spark, path), 16).writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    got = {r.pos: r.unmasked for r in spark.table("counts").collect()}
    assert got == {a: (w[:, a : a + 16] > 0).sum() for a in range(0, 64, 16)}


def test_running_variance_equals_batch(spark, tmp_path):
    i, w = random_grid(RNG, 3, 96)
    w[1, 32:48] = 0
    g = grid_of(spark, i, w)
    p = OnlineMaskFiller(8, 0.2, 0.05, 0.1, 0.3, 0.6, 16)
    v1 = variance_v1(g, 8)
    for k in range(3):
        v1.where(f"v1_idx div 4 = {k}").coalesce(1).write.parquet(str(tmp_path / f"v1/{k}"))
    source = spark.readStream.schema("v1_idx long, freq int, v1 double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "v1/*"))
    q = running_variance(source, p).writeStream.outputMode("append").format("memory").queryName("rv").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    got = {(r.v1_idx, r.freq): (r["var"], r.w) for r in spark.table("rv").collect()}
    want = {(r.v1_idx, r.freq): (r["var"], r.w) for r in p.states(v1).collect()}
    assert got.keys() == want.keys() and all(v == pytest.approx(want[k]) for k, v in got.items())


def test_data_source_streams(spark, tmp_path):
    spark.dataSource.register(NoiseDataSource)
    s = spark.readStream.format("grid_noise").options(nfreq=2, nt=96, nt_chunk=32, seed=4).load()
    q = s.writeStream.format("memory").queryName("noise").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    assert 0 < spark.table("noise").count() <= 192


def test_packets_over_the_network(spark, tmp_path):
    """Packetizer to UDP to landed files to a stream; masks survive, intensities to a quantum."""
    import socket
    from threading import Thread

    from gridloom.sinks.packets import Packetizer
    from gridloom.streaming.network import decode, encode, network_meta, network_stream, receive, udp_sender

    i, w = random_grid(RNG, 4, 16)
    g = grid_of(spark, i, w, dt_sample=2.56e-6 * 384)
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        s.bind(("127.0.0.1", 0))
        kept = []
        t = Thread(target=lambda: kept.append(receive(s, str(tmp_path / "land"), 3, 0.5, 25)))
        t.start()
        Packetizer("127.0.0.1", 1, 16, 8, 0.6, coarse=2, send=udp_sender("127.0.0.1", s.getsockname()[1], 3))(g)
        t.join()
    assert kept == [4]
    q = network_stream(spark, str(tmp_path / "land"), 2.0).writeStream.format("memory").queryName("net").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    got = {(r.freq, r.t): (r.intensity, r.weight) for r in spark.table("net").collect()}
    assert len(got) == 64
    for (f, k), (x, y) in got.items():
        assert y == (w[f, k] >= 0.6)
        assert y == 0 or abs(x - 2 * i[f, k]) < 0.1
    assert network_meta(16, 384).dt_sample == pytest.approx(0.98304e-3)
    with pytest.raises(ValueError):
        decode(encode(1, [(0, 0, 1.0, True)])[:-1])
