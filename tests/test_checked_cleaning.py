"""Checked cleaning and the hash tree of its input files."""

import hashlib
import json
import os

import pytest

from tallyspark.operators import checked as K
from tallyspark.operators import cleaning as C
from tallyspark.sources import hash_tree as H


def _row(tid, item="I1", price="2.5", qty="2", total="5.0", date="2024-01-31", disc="True", pay="Cash"):
    return (tid, "CUST_1", "C", item, price, qty, total, pay, "Online", date, disc)


def test_commit_replaces_and_log_counts(spark, raw_df, tmp_path):
    out, log_file = str(tmp_path / "clean"), str(tmp_path / "clean.json")
    rows = [_row("a"), _row("b", price="", total="7.5", qty="3", disc="YES"), _row("c", disc="maybe"), _row("d", disc="", pay=" Cash\t card "),
            _row(" e ", qty="", total="x", disc="tRuE"), _row("f", qty="0", total="0", price="")]
    log = K.clean_checked(raw_df(rows), out, log_file)
    assert json.load(open(log_file)) == json.loads(json.dumps(log)) and all(log["checks"].values())
    n = log["counters"]
    assert (n["rows_before"], n["rows_after"], n["repeated_ids"]) == (6, 6, 0)
    assert (n["discount_true_title_to_Yes"], n["discount_yes_upper_to_Yes"], n["discount_true_mixed_to_Yes"]) == (2, 1, 1)
    assert (n["discount_missing"], n["discount_unexpected"], n["discount_unknown"]) == (1, 1, 2)
    assert (n["whitespace_payment_method"], n["whitespace_transaction_id"], n["whitespace_item"]) == (1, 1, 0)
    assert (n["invalid_total_spent"], n["price_derived"], n["missing_before_quantity"], n["missing_after_total_spent"]) == (1, 1, 1, 1)
    assert spark.read.parquet(out).columns == C.CLEAN_COLUMNS
    K.clean_checked(raw_df(rows[:2]), out, log_file)
    assert spark.read.parquet(out).count() == 2
    assert sorted(os.listdir(tmp_path)) == [".clean.json.crc", "clean", "clean.json"] or {"clean", "clean.json"} == {f for f in os.listdir(tmp_path) if not f.startswith(".")}


@pytest.mark.parametrize("rows,check", [
    ([_row("a"), _row("a")], "transaction_ids_unique"),
    ([_row("a"), _row(" null ")], "transaction_ids_complete"),
    ([_row("a", total="6.0")], "no_arithmetic_issues"),
    ([_row("a", date="2024-02-30")], "all_dates_parseable"),
])
def test_failing_run_leaves_log_and_no_table(spark, raw_df, tmp_path, rows, check):
    out, log_file = str(tmp_path / "clean"), str(tmp_path / "log.json")
    with pytest.raises(K.CleaningRejected) as refused:
        K.clean_checked(raw_df(rows), out, log_file)
    assert [k for k, ok in refused.value.log["checks"].items() if not ok] == [check]
    assert json.load(open(log_file))["checks"][check] is False
    assert [f for f in os.listdir(tmp_path) if not f.startswith(".")] == ["log.json"]  # no table, nothing staged


def test_failing_run_keeps_the_committed_table(spark, raw_df, tmp_path):
    out, log_file = str(tmp_path / "clean"), str(tmp_path / "log.json")
    K.clean_checked(raw_df([_row("a")]), out, log_file)
    with pytest.raises(AssertionError):
        K.clean_checked(raw_df([_row("b"), _row("b")]), out, log_file)
    assert [r["transaction_id"] for r in spark.read.parquet(out).collect()] == ["a"]


def test_empty_input(spark, raw_df, tmp_path):
    log = K.clean_checked(raw_df([]), str(tmp_path / "clean"), str(tmp_path / "log.json"))
    assert log["counters"]["rows_after"] == 0 and all(log["checks"].values())


def test_changed_input_is_refused(spark, raw_df, tmp_path, monkeypatch):
    source = tmp_path / "in.csv"
    source.write_text("a,b\n" * 1000)
    whole = K.C.quantity_is_whole

    def meddle(df):
        source.write_text("a,b\n" * 500 + "a,c\n" + "a,b\n" * 499)
        return whole(df)
    monkeypatch.setattr(K.C, "quantity_is_whole", meddle)
    with pytest.raises(K.CleaningRejected) as refused:
        K.clean_checked(raw_df([_row("a")]), str(tmp_path / "clean"), str(tmp_path / "log.json"), [str(source)], range_bytes=1024)
    (where,) = refused.value.log["changed_ranges"]
    assert where["file"].endswith("in.csv") and where["start"] <= 2000 < where["start"] + where["length"] and where["length"] == 1024


def blobs(tmp_path):
    data = {"x.bin": bytes(range(256)) * 200 + b"end", "y.txt": b"one\r\n\n two\n" * 900, "z.txt": b"no line end", "one.txt": b"\n" * 10}
    for name, content in data.items():
        (tmp_path / name).write_bytes(content)
    return data


def test_leaves_equal_hashlib(spark, tmp_path):
    data = blobs(tmp_path)
    size = 4096
    got = {(os.path.basename(r["file"]), r["start"]): r for r in H.leaves(spark, [str(tmp_path)], size).collect()}
    want = {}
    for name, content in data.items():
        at = 0
        lines = content.split(b"\n")
        if lines[-1] == b"":
            lines.pop()
        for line in lines:
            # A line at the very border belongs to the range before it, as line readers cut files.
            key = (name, max(0, at - 1) // size * size)
            want.setdefault(key, []).append(line)
            at += len(line) + 1
    assert set(got) == set(want)
    for key, lines in want.items():
        assert got[key]["lines"] == len(lines)
        assert got[key]["hash"] == hashlib.sha256(b"".join(x + b"\n" for x in lines)).hexdigest()


def test_differences_name_file_and_range(spark, tmp_path):
    data = blobs(tmp_path)
    size = 4096
    before = H.hash_tree(spark, [str(tmp_path)], size)
    assert before.roots.count() == len(data)
    assert H.differences(before, H.hash_tree(spark, [str(tmp_path)], size)).count() == 0
    content = bytearray(data["x.bin"])
    content[30_000] ^= 1
    (tmp_path / "x.bin").write_bytes(content)
    (tmp_path / "z.txt").write_bytes(b"no line end\n")  # only the last line end is new
    os.remove(tmp_path / "one.txt")
    (tmp_path / "new.txt").write_bytes(b"hello")
    got = sorted((os.path.basename(r["file"]), r["start"], r["change"]) for r in H.differences(before, H.hash_tree(spark, [str(tmp_path)], size)).collect())
    assert got == [("new.txt", 0, "added"), ("one.txt", 0, "removed"), ("x.bin", 30_000 // size * size, "changed"), ("z.txt", 0, "changed")]


def test_tree_of_many_ranges_has_one_root_per_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(H, "FAN_OUT", 3)
    (tmp_path / "f").write_bytes(b"0123456\n" * 500)
    (tmp_path / "g").write_bytes(b"0123456\n" * 40 + b"long line " * 60 + b"\n" + b"0123456\n" * 10)  # ranges without a line start
    first = {r["file"][-1]: r for r in H.hash_tree(spark, [str(tmp_path)], 100).roots.collect()}
    assert first["f"]["ranges"] == 40 and first["f"]["lines"] == 500 and set(first) == {"f", "g"}
    (tmp_path / "f").write_bytes(b"0123456\n" * 499 + b"012345x\n")
    again = {r["file"][-1]: r for r in H.hash_tree(spark, [str(tmp_path)], 100).roots.collect()}
    assert again["f"]["root"] != first["f"]["root"] and again["g"]["root"] == first["g"]["root"]
