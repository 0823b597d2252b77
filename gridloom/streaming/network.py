"""Live packets: a receiver that lands them as files, and a stream that reads the landing folder.

UDP can't be read twice, and a failed task must be able to. So packets are written to
Parquet by a receiver process, one atomically renamed file per interval, and Spark reads
those files: any number of receivers (a port each) may share a folder, and a restarted
query replays what it needs.
"""

from __future__ import annotations

import os
import socket
import struct
import time
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..grid import SCHEMA, GridMeta
from ..sources.synthetic import SECONDS_PER_COUNT

#: magic, beam, first sample, first channel, channels, samples, samples' step, scale, offset; then a byte per cell, 0 for masked.
HEADER = struct.Struct("<4siqiiiiff")
MAGIC = b"GLP1"


def encode(beam: int, cells: Iterable[tuple[int, int, float, bool]], nds: int = 1) -> bytes:
    """A packet of (freq, t, intensity, keep) cells: intensities in 255 steps between the packet's extremes."""
    rows = list(cells)
    f = np.array([r[0] for r in rows])
    t = np.array([r[1] for r in rows])
    x = np.array([r[2] for r in rows], dtype=float)
    keep = np.array([r[3] for r in rows], dtype=bool)
    nf, nt = int(f.max() - f.min()) + 1, int(t.max() - t.min()) // nds + 1
    low, high = (x[keep].min(), x[keep].max()) if keep.any() else (0.0, 0.0)
    scale = (high - low) / 254 or 1.0
    data = np.zeros((nf, nt), dtype=np.uint8)
    data[f - f.min(), (t - t.min()) // nds] = np.where(keep, np.clip(np.round((x - low) / scale), 0, 254) + 1, 0)
    return HEADER.pack(MAGIC, beam, int(t.min()), int(f.min()), nf, nt, nds, scale, low) + data.tobytes()


def decode(packet: bytes) -> tuple[int, pa.Table]:
    """(beam, cells) of a packet; masked cells have weight 0."""
    magic, beam, t0, f0, nf, nt, nds, scale, low = HEADER.unpack_from(packet)
    data = np.frombuffer(packet, np.uint8, offset=HEADER.size)
    if magic != MAGIC or len(data) != nf * nt:
        raise ValueError("no packet")
    on = data > 0
    t = np.tile(np.arange(nt, dtype=np.int64) * nds + t0, nf)
    f = np.repeat(np.arange(f0, f0 + nf, dtype=np.int32), nt)
    i = np.where(on, (data.astype(float) - 1) * scale + low, 0.0)
    return beam, pa.table({"t": t, "freq": f, "intensity": i, "weight": on.astype(float)})


def udp_sender(host: str, port: int, beam: int = 0, gbps: float = 0.0, nds: int = 1) -> Callable[[Iterator], None]:
    """For ``Packetizer.send``: each partition's packets go out by UDP, at gbps per task at most (0: no limit)."""

    def send(rows: Iterator) -> None:
        with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
            for r in rows:
                packet = encode(beam, [(c.freq, c.t, c.intensity, c.keep) for c in r.data], nds)
                s.sendto(packet, (host, port))
                if gbps:
                    time.sleep(8 * len(packet) / (gbps * 1e9))

    return send


def land(tables: list[pa.Table], folder: str) -> str:
    """Write cells as one file, which appears whole or not at all."""
    os.makedirs(folder, exist_ok=True)
    name = f"{uuid.uuid4().hex}.parquet"
    hidden = os.path.join(folder, f"_{name}")
    pq.write_table(pa.concat_tables(tables), hidden)
    os.replace(hidden, os.path.join(folder, name))
    return name


def receive(sock: socket.socket, folder: str, beam: int = 0, interval_s: float = 1.0, seconds: float | None = None) -> int:
    """Land one beam's packets from a bound socket; other beams and broken packets are counted out. Returns packets kept."""
    kept, tables = 0, []
    end = None if seconds is None else time.time() + seconds
    due = time.time() + interval_s
    sock.settimeout(min(0.1, interval_s))
    while end is None or time.time() < end:
        try:
            packet = sock.recv(1 << 16)
        except TimeoutError:
            packet = b""
        if len(packet) >= HEADER.size and packet[:4] == MAGIC:
            b, cells = decode(packet)
            if b == beam:
                tables.append(cells)
                kept += 1
        if tables and time.time() >= due:
            land(tables, folder)
            tables, due = [], time.time() + interval_s
    if tables:
        land(tables, folder)
    return kept


def network_meta(nfreq: int, fpga_counts_per_sample: int, initial_fpga_count: int = 0, frame0_nano: int = 0) -> GridMeta:
    """The meta data of the instrument's stream."""
    dt = fpga_counts_per_sample * SECONDS_PER_COUNT
    m = GridMeta(nfreq, 1, 400.0, 800.0, dt, initial_fpga_count * SECONDS_PER_COUNT)
    return m.with_attrs(initial_fpga_count=initial_fpga_count, frame0_nano=frame0_nano, fpga_counts_per_sample=fpga_counts_per_sample)


def network_stream(spark: SparkSession, folder: str, prescale: float = 1.0, max_files: int | None = None) -> DataFrame:
    """The landed cells as a stream, intensities times prescale."""
    reader = spark.readStream.schema(SCHEMA)
    reader = reader.option("maxFilesPerTrigger", max_files) if max_files else reader
    return reader.parquet(folder).withColumn("intensity", F.col("intensity") * prescale)
