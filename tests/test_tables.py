"""Scans, guards, text handling, traces and audits on small fixtures."""
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from obsloom.functions import scalar as X
from obsloom.operators import aggs, assoc, audit, geometry, joins, qc
from obsloom.sources import files


def test_csv_with_bom_and_nan(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_bytes("﻿id,x,y\n1,2.5,NaN\n2,,3\n".encode())
    rows = files.scan_csv(spark, str(p), "id int, x double, y double", ["id", "y"]).collect()
    assert [tuple(r) for r in rows] == [(1, None), (2, 3.0)]


def test_tsv_keeps_tokens(spark, tmp_path):
    p = tmp_path / "a.tsv"
    p.write_text('k\tv\nNR\tnan\n""\t\nNA\t"q"\n')
    assert [tuple(r) for r in files.scan_tsv_verbatim(spark, str(p), ["k", "v"]).collect()] == [("NR", "nan"), ('""', ""), ("NA", '"q"')]


def test_envelope_records_and_lists(spark, tmp_path):
    (tmp_path / "e.json").write_text('{"analysis_headers": ["b", "a"],\n "analysis_rows": [["x", "1"], [null, "oops"]]}')
    assert [tuple(r) for r in files.scan_json_envelope(spark, str(tmp_path / "e.json"), {"a": "double", "b": "string"}).collect()] == [(1.0, "x"), (None, None)]
    (tmp_path / "r.json").write_text('[{"id": 1, "v": 2}, {"v": 3}]')
    with pytest.raises(Exception, match="required field missing: id"):
        files.scan_json_records(spark, str(tmp_path / "r.json"), "id int, v int", required=["id"]).collect()
    (tmp_path / "empty.txt").write_text("# only a comment\n\n")
    with pytest.raises(ValueError, match="empty"):
        files.id_list_scan(spark, str(tmp_path / "empty.txt"))


def test_zip_and_inventory(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("in/t.csv", "id,v\n1,2\n2,x\n")
    got = files.scan_zip_members(spark, str(tmp_path / "z.zip"), "id int, v double").select("id", "v").collect()
    assert [tuple(r) for r in got] == [(1, 2.0), (2, None)]
    with pytest.raises(Exception, match="hash mismatch"):
        files.scan_zip_members(spark, str(tmp_path / "z.zip"), "id int, v double", sha256=["0"]).collect()
    inv = files.file_inventory(spark, str(tmp_path), r"/([a-z]+)\.zip", "*.zip")
    assert inv.first()["key"] == "z" and len(inv.first()["sha256"]) == 64
    ok = audit.manifest_verify(inv, inv.select("path", "bytes", F.upper("sha256").alias("sha256"))).first()
    assert ok["status"] == "ok"


def test_duplicate_keys_raise(spark):
    one, two = spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string"), spark.createDataFrame([(1, "c"), (1, "d")], "k int, y string")
    with pytest.raises(Exception, match="not unique"):
        joins.join_validated(one, two, "k").collect()
    with pytest.raises(Exception, match="duplicate key"):
        qc.exclusion_filter(one, two.select("k"), "k")[0].collect()
    with pytest.raises(ValueError):
        qc.require_empty(qc.assert_not_excluded(one, two, "k"), "excluded ids present")


def test_null_fails_a_threshold_and_limits_are_kept(spark):
    df = spark.createDataFrame([(1, 0.2), (2, None), (3, 0.1)], "id int, x double")
    assert [r["id"] for r in df.where(X.within("x", 0.2)).collect()] == [1]
    wide = spark.createDataFrame([(1.0 if i else None, 1.0 if i > 1 else None) for i in range(5)], "a double, b double")
    r = {x["feature"]: (x["rate"], x["excluded"]) for x in aggs.wide_missingness(wide, ["a", "b"]).collect()}
    assert r == {"a": (0.2, False), "b": (0.4, True)}


def test_missing_tokens(spark):
    df = spark.createDataFrame([("1", None), ("", " "), ("2", "3")], "a string, b string")
    assert [tuple(r) for r in qc.missing_tokens(df, ["a", "b"]).collect()] == [("1", "NaN"), ("NR", "NR"), ("2", "3")]


def test_undefined_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, 6.0, 5.0)], "a double, b double, c double")
    r = {(x["a"], x["b"]): x["r"] for x in assoc.pair_moments(df, ["a", "b", "c"]).collect()}
    assert r[("a", "b")] == pytest.approx(1.0) and r[("a", "c")] is None


def test_previous_point_across_days(spark):
    rows = [(1, f"2024-01-0{d} 0{h}:00:00", float(d * 10 + h)) for d in (1, 2, 5) for h in (1, 2)]
    df = spark.createDataFrame(rows, "k int, ts string, x double").withColumn("ts", F.to_timestamp("ts"))
    got = [r["prev_x"] for r in geometry.previous(df, ["k"], ["ts"], ["x"]).orderBy("ts").collect()]
    assert got == [None, 11.0, 12.0, 21.0, 22.0, 51.0]


def test_branch_order_of_a_chain_and_cycle(spark):
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(200)], "n int, p int")
    got = {r["n"]: r["depth"] for r in geometry.branch_order(chain, "n", "p").collect()}
    assert got == {i: i for i in range(200)}
    with pytest.raises(ValueError, match="cycle"):
        geometry.branch_order(spark.createDataFrame([(1, 2), (2, 1)], "n int, p int"), "n", "p", rounds=6)


def test_trace_review(spark):
    nan = float("nan")
    pts = spark.createDataFrame([("ok", 1, 0., 0., 0., 1.), ("ok", 2, 1., 0., 0., 1.), ("ok", 3, 2., 0., 0., 1.), ("jump", 1, 0., 0., 0., 1.), ("jump", 2, 1., 0., 0., 0.),
                                 ("jump", 3, 50., 0., 0., 1.), ("jump", 4, 51., 0., 0., 1.), ("bad", 1, nan, 0., 0., 1.), ("bad", 2, 1., 0., 0., 1.)],
                                "t string, seq int, x double, y double, z double, r double")
    seg = geometry.segments(pts, ["t"], ["seq"])
    roots = spark.createDataFrame([("ok", 2.0, 1.0), ("jump", 30.0, 1.0), ("bad", 0.0, 1.0)], "t string, root_gap double, soma_radius double")
    got = {r["t"]: (r["status"], r["flags"]) for r in geometry.trace_status(geometry.trace_flags(pts, seg, "t", roots)).collect()}
    assert got["ok"] == ("Pass", "") and got["bad"][0] == "Unavailable_or_hard_fail"
    assert got["jump"] == ("Review", "nonpositive_point_radius;long_coordinate_jump;neurite_root_far_from_soma")


def test_text_scan_reads_every_line(spark):
    key = "sk-" + "a" * 24
    text = "x\n" * 5000 + "password = 'longsecret1'\r\n" + key
    got = audit.text_scan(spark.createDataFrame([(1, text)], "id int, t string"), "id", "t").collect()
    assert {(r["line"], r["pattern"]) for r in got} == {(5001, "declared_secret"), (5002, "openai_key")}


def test_greedy_selection_on_the_limit(spark):
    pairs = spark.createDataFrame([("a", "b", 0.8), ("a", "c", 0.79), ("b", "c", 0.95)], "a string, b string, r double")
    prio = spark.createDataFrame([("a", 0.0), ("b", 1.0), ("c", 2.0)], "feature string, priority double")
    got = {r["feature"]: (r["kept"], r["representative"]) for r in assoc.greedy_nonredundant(pairs, prio, 0.8).collect()}
    assert got == {"a": (True, "a"), "b": (False, "a"), "c": (True, "c")}


def test_near_zero_variance(spark):
    df = spark.createDataFrame([("f", float(v)) for v in [0] * 95 + [1] * 5] + [("g", float(i)) for i in range(100)] + [("h", 1.0)] * 3, "feature string, value double")
    got = {r["feature"]: r["near_zero"] for r in aggs.near_zero_variance(df).collect()}
    assert got == {"f": True, "g": False, "h": True}
    assert np.isclose({r["feature"]: r["unique_percent"] for r in aggs.near_zero_variance(df).collect()}["f"], 2.0)


def test_previous_point_in_pieces(spark):
    rows = [("hot" if i % 3 else "cold", i // 2, i, float(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, seq int, tie int, x double")
    plain = geometry.previous(df, ["k"], ["seq", "tie"], ["x"]).collect()
    cut = geometry.previous(df, ["k"], ["seq", "tie"], ["x"], rows_per_piece=20).collect()
    assert {r["tie"]: r["prev_x"] for r in plain} == {r["tie"]: r["prev_x"] for r in cut}
