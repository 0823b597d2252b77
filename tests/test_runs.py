"""JSON forms, runs, reports, the command line, helpers, the driver's entry."""

import json
import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import gridloom.sources  # noqa: F401
from gridloom.functions import jsons, numbers
from gridloom.functions.keys import parse_axis
from gridloom.grid import GridMeta
from gridloom.operators import REGISTRY, from_json, register
from gridloom.operators.base import describe, visit
from gridloom.operators.clippers import IntensityClipper, StdDevClipper
from gridloom.operators.containers import Pipeline, PipelineFork, SubPipeline
from gridloom.operators.detrenders import PolynomialDetrender, SplineDetrender
from gridloom.operators.masks import MaskCounter, MaskExpander
from gridloom.plans.cli import expand, main
from gridloom.plans.run import RunParams, latencies, run
from gridloom.sources.synthetic import GaussianNoiseStream

ROOT = Path(__file__).resolve().parents[1]


def chain():
    return Pipeline([
        GaussianNoiseStream(16, 128, 400.0, 800.0, 1e-3),
        SubPipeline(Pipeline([IntensityClipper(64, 0, 3.0, 2), StdDevClipper(64, "AXIS_TIME", 3.0)]), 0.1, Df=2, Dt=2),
        PipelineFork([("WEIGHTS", "w0")]),
        PolynomialDetrender(64, "time", 2),
        MaskCounter(64, "end"),
    ], "demo")


def test_json_round_trip():
    j = chain().jsonize()
    assert json.loads(json.dumps(j)) == json.loads(json.dumps(from_json(json.loads(json.dumps(j))).jsonize()))
    assert j["elements"][1]["sub_pipeline"]["elements"][0]["axis"] == "AXIS_FREQ"


def test_every_class_round_trips_with_its_own_defaults():
    given = {
        "intensity_clipper": {"nt_chunk": 64, "axis": "AXIS_NONE", "sigma": 2.0}, "std_dev_clipper": {"nt_chunk": 64, "axis": "AXIS_TIME", "sigma": 2.0}, "polynomial_detrender": {"nt_chunk": 64, "axis": "AXIS_TIME", "polydeg": 1},
        "spline_detrender": {"nt_chunk": 64, "axis": "AXIS_FREQ", "nbins": 2}, "mask_counter": {"nt_chunk": 64, "where": "a"}, "mask_expander": {"prev_wname": "w", "width": 0.1, "threshold": 0.3}, "pipeline_fork": {"bufnames": [["WEIGHTS", "w"]]},
        "plotter_transform": {"img_prefix": "a", "img_nfreq": 4, "img_nt": 4}, "mask_filler": {"var_file": "v", "w_cutoff": 0.5}, "frb_injector_transform": {"snr": 1.0, "undispersed_arrival_time": 0.0, "dm": 1.0}, "pulse_adder": {"pulses": []},
        "gaussian_noise_stream": {"nfreq": 4, "nt_tot": 4, "freq_lo_MHz": 4.0, "freq_hi_MHz": 8.0, "dt_sample": 1.0}, "chime_file_stream": {"filename_list": ["a"]}, "chime_frb_file_stream": {"filename_list": ["a"]}, "chime_file_writer": {"filename": "a"},
        "chime_dummy_network_stream": {"nt_tot": 4}, "pipeline": {"elements": []}, "fused_chain": {"elements": [], "nt_chunk": 64}, "packed_file_stream": {"filename": "a"}, "wi_sub_pipeline": {"sub_pipeline": {"class_name": "pipeline", "elements": []}, "Df": 2, "Dt": 2},
    }
    for name in REGISTRY:
        j = from_json({"class_name": name} | given.get(name, {})).jsonize()
        assert from_json(json.loads(json.dumps(j))).jsonize() == j


def test_bad_json():
    for bad in ({"class_name": "no_such"}, {"nfreq": 1}, 5, {"class_name": "mask_counter", "nt_chunk": 1, "where": "x", "extra": 1}):
        with pytest.raises(ValueError):
            from_json(bad)
    with pytest.raises(ValueError):
        register("pipeline", Pipeline.from_json)


def test_axis_spellings():
    assert [parse_axis(a) for a in (0, 1, None, "AXIS_FREQ", "time", "None", "axis_none")] == ["freq", "time", "none", "freq", "time", "none", "none"]
    with pytest.raises(ValueError):
        parse_axis("depth")


@pytest.mark.parametrize("make", [
    lambda: IntensityClipper(64, "time", 0.5), lambda: StdDevClipper(64, "none", 2.0), lambda: PolynomialDetrender(64, "none", 1), lambda: PolynomialDetrender(64, "time", -1),
    lambda: SplineDetrender(64, "time", 2), lambda: MaskExpander("w", 200.0, 0.5), lambda: PipelineFork([("a", "w"), ("b", "w")]).bind(GridMeta(4)), lambda: IntensityClipper(60, "time", 2.0, Dt=8).bind(GridMeta(4)),
    lambda: IntensityClipper(64, "time", 2.0, Df=3).bind(GridMeta(4)), lambda: GridMeta(0), lambda: RunParams(img_nx=3), lambda: PipelineFork([("WEIGHTS", "weight")]).bind(GridMeta(4)),
])
def test_bad_parameters(make):
    with pytest.raises(ValueError):
        make()


def test_run_writes_a_report(spark, tmp_path):
    grid, report = run(spark, chain(), RunParams(outdir=str(tmp_path), extra_attrs={"beam": 3}))
    got = jsons.json_read(str(tmp_path / "pipeline_0.json"))
    assert got["success"] and got["nsamples_in"] == 128 and got["ncells"] == 2048 and got["attrs"]["beam"] == 3 and got["attrs"]["nfreq"] == 16
    assert got["outputs"] == ["mask_counter_end"] and grid.outputs["mask_counter_end"].count() == 2
    with pytest.raises(FileExistsError):
        run(spark, chain(), RunParams(outdir=str(tmp_path), clobber=False))


def test_a_failed_run_still_reports(spark, tmp_path):
    bad = Pipeline([*chain().elements, PipelineFork([("NOTHING", "x")])])
    with pytest.raises(ValueError):
        run(spark, bad, RunParams(outdir=str(tmp_path)))
    got = jsons.json_read(str(tmp_path / "pipeline_0.json"))
    assert not got["success"] and "NOTHING" in got["error_message"]


def test_visit_and_latencies():
    names = [(o.class_name, d) for o, d in visit(chain())]
    assert names[0] == ("pipeline", 0) and ("intensity_clipper", 3) in names
    assert "std_dev_clipper" in describe(chain())
    rows = latencies(Pipeline([MaskCounter(100, "a"), MaskCounter(64, "b")]), 64)
    assert [r["lag"] for r in rows[1:]] == [96, 156]


def test_command_line(spark, tmp_path, capsys):
    els = chain().jsonize()["elements"]
    jsons.json_write(str(tmp_path / "s.json"), els[0])
    for k, s in enumerate((2.0, 3.0)):
        jsons.json_write(str(tmp_path / f"c{k}.json"), IntensityClipper(64, "time", s).jsonize())
    jsons.json_write(str(tmp_path / "list.json"), [["two", "c0.json"], ["three", "c1.json"]])
    files = [str(tmp_path / "s.json"), str(tmp_path / "list.json")]
    assert [s for s, _ in expand(files)] == ["two", "three"]
    assert main(["run", "-o", str(tmp_path / "out"), "-t", "2", *files]) == 0
    assert sorted(os.listdir(tmp_path / "out")) == ["three", "two"]
    assert main(["show", files[0]]) == 0 and "nt_tot: 128" in capsys.readouterr().out
    assert main(["analyze", files[0], str(tmp_path / "c0.json")]) == 0 and "lag" in capsys.readouterr().out
    assert main(["time", files[0], str(tmp_path / "c0.json")]) == 0 and "intensity_clipper" in capsys.readouterr().out
    assert main(["run", "-n", str(tmp_path / "c0.json")]) == 1
    jsons.json_write(str(tmp_path / "bad.json"), [["a", "c0.json"], ["b"]])
    with pytest.raises(ValueError):
        expand([str(tmp_path / "bad.json")])


def test_json_helpers():
    a = {"x": [1, {"y": 2.0}], "z": {}}
    assert jsons.json_show(a) == "x[0]: 1\nx[1].y: 2.0\nz: {}"
    assert jsons.json_differences(a, {"x": [1, {"y": 2.1}], "z": {}}) == ["x[1].y"]
    jsons.json_assert_equal(a, {"x": [1, {"y": 2.001}], "z": {}}, 0.01)
    with pytest.raises(AssertionError):
        jsons.json_assert_equal(a, {})


def test_numbers():
    assert (numbers.xdiv(12, 4), numbers.gcd(12, 18), numbers.lcm(4, 6), numbers.round_up(5, 4), numbers.integer_log2(64), numbers.prod([2, 3])) == (3, 6, 12, 8, 6, 6)
    assert numbers.median([3, 1]) == 2 and numbers.median([5, 1, 3]) == 3 and numbers.reldist(1, 1) == 0
    for bad in (lambda: numbers.xdiv(7, 2), lambda: numbers.integer_log2(6), lambda: numbers.median([])):
        with pytest.raises(ValueError):
            bad()


@pytest.mark.parametrize(("text", "kind", "value"), [("12", "int", 12), (" 1e3 ", "double", 1000.0), ("true", "bool", True), ("0", "bool", False), ("65535", "uint16", 65535), ("x y", "string", "x y"), ("-5", "long", -5)])
def test_casts(text, kind, value):
    assert numbers.cast(text, kind) == value


@pytest.mark.parametrize(("text", "kind"), [("12x", "int"), ("", "int"), ("1.5", "long"), ("2147483648", "int"), ("-1", "uint16"), ("65536", "uint16"), ("maybe", "bool"), ("1 2", "double"), ("1", "nothing")])
def test_casts_that_fail(text, kind):
    with pytest.raises(ValueError):
        numbers.cast(text, kind)


def test_the_rest_works_without_the_removable_parts(tmp_path):
    for name in ("__spark_entry__.py", "gridloom"):
        src = ROOT / name
        if src.is_dir():
            shutil.copytree(src, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(src, tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'clip_time' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_dedisperser_configuration(tmp_path):
    from gridloom.operators.dedispersion import read_config

    (tmp_path / "c.txt").write_text("# a config\nnfreq = 16\nmax_dm = 50.0  # top\nbeta = [0 1 2.5]\nname = x\n")
    assert read_config(str(tmp_path / "c.txt")) == {"nfreq": 16, "max_dm": 50.0, "beta": [0, 1, 2.5], "name": "x"}
    op = from_json({"class_name": "bonsai_dedisperser_cpp", "config_filename": str(tmp_path / "c.txt"), "initializer": {"fill_rfi_mask": True, "allocate": False, "verbosity": 2, "file_type": "float"}})
    assert op.fill_rfi_mask and op.settings()["max_dm"] == 50.0
    with pytest.raises(ValueError):
        op.bind(GridMeta(32, 1, 400.0, 800.0, 1e-3))
    plots = from_json({"class_name": "bonsai_dedisperser_python", "config_filename": "", "fill_rfi_mask": False, "img_prefix": "t", "img_ndm": 4, "img_nt": 8, "track_global_max": True, "global_max_tracker_dm_min": 1.0, "global_max_tracker_dm_max": 9.0, "L1b_config": None})
    assert (plots.dm_min, plots.dm_max) == (1.0, 9.0) and plots.jsonize()["global_max_tracker_dm_max"] == 9.0
