"""Readers that cut files by bytes: quoted line breaks, bad rows, one large JSON array."""

import csv
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from tablelens.sources import delimited, json_array
from tablelens.sources import load as ld


@pytest.fixture
def tiny_splits(spark):
    """Splits of about 700 bytes, so that most records are cut by one."""
    keys = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def awkward_rows(n, seed):
    r = random.Random(seed)
    words = ["a", "", 'say "hi"', "x,y", "two\nlines", "\n\n", '"', "end\n", ",", "plain", "ü\nß", 'a""b', "long " * 30, "q\n" * 40]
    return [(i, r.choice(words), r.choice(words)) for i in range(n)]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_quoted_line_breaks_survive_any_split(spark, tmp_path, tiny_splits, end):
    rows = awkward_rows(120, 1)
    (tmp_path / "t.csv").mkdir()
    for k in range(2):
        with open(tmp_path / "t.csv" / f"part{k}.csv", "w", newline="", encoding="utf-8") as f:
            w = csv.writer(f, lineterminator=end)
            w.writerow(["id", "first\nname", "_extra"])
            w.writerows(rows[k::2])
    df = ld.load_dataset(spark, str(tmp_path / "t.csv")).df
    assert df.columns == ["id", "first\nname", "_extra"] and dict(df.dtypes)["id"] == "int"
    got = sorted((r[0], r[1], r[2]) for r in df.collect())
    assert got == sorted((i, a or None, b or None) for i, a, b in rows)


def test_splits_are_many(spark, tmp_path, tiny_splits):
    (tmp_path / "t.csv").write_text("id,v\n" + "".join(f'{i},"x\ny"\n' for i in range(200)))
    from tablelens.sources import splits
    assert splits.pieces(spark, str(tmp_path / "t.csv"), "\n").rdd.getNumPartitions() > 2
    assert ld.read_csv(spark, str(tmp_path / "t.csv"), ",").where("v = 'x\\ny'").count() == 200


def test_bad_rows_and_types(spark, tmp_path):
    text = ("﻿id,when,at,flag,price,name,name\n1,2024-01-02,2024-01-02 03:04:05,true,1.5,a,b\n\n   \n"
            "2,2024-02-03,2024-02-03 00:00:00,FALSE,2,\"c\nd\",\n3,1,2,3,4,5,6,7\n4\n5000000000,2024-01-01,2024-01-01T00:00:00,true,1e3,5\" pipe,x\"y")
    (tmp_path / "t.csv").write_text(text, encoding="utf-8")
    df = ld.load_dataset(spark, str(tmp_path / "t.csv")).df
    assert df.dtypes == [("id", "bigint"), ("when", "date"), ("at", "timestamp"), ("flag", "boolean"), ("price", "double"), ("name", "string"), ("name.1", "string")]
    got = {r[0]: r for r in df.collect()}
    assert sorted(got) == [1, 2, 4, 5000000000]                                     # the row with eight fields is gone
    assert got[2][5] == "c\nd" and got[2][6] is None and got[4][1] is None and got[5000000000][5:] == ('5" pipe', 'x"y')


def test_states_agree_with_the_csv_module():
    r = random.Random(3)
    for _ in range(3000):
        text = "".join(r.choice('",\n a') for _ in range(r.randrange(1, 25)))
        inside, upto = False, []
        for line in text.split("\n"):
            inside = delimited.inside_after(line, ",", inside)
            upto.append(inside)
        records = list(csv.reader(io.StringIO(text + "\n", newline="")))
        assert sum(not s for s in upto) + (1 if upto[-1] else 0) == len(records), text


def test_unclosed_quote_and_header_only(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,v\n1,x\n2,"open\nto the end\n')
    assert sorted(map(tuple, ld.read_csv(spark, str(tmp_path / "a.csv"), ",").collect())) == [(1, "x"), (2, "open\nto the end\n")]
    (tmp_path / "b.csv").write_text("id,v\n")
    with pytest.raises(ld.LoadError):
        ld.load_dataset(spark, str(tmp_path / "b.csv"))


def test_array_on_one_line_and_pretty(spark, tmp_path, tiny_splits):
    r = random.Random(5)
    recs = [{"id": i, "t": r.choice(["}", "{[", 'q"}', "back\\", "a\nb", "", "x" * 200]), "deep": {"k": [i, {"z": "}]"}]}, "n": None if i % 3 else i / 2} for i in range(90)]
    for name, text in (("one", json.dumps(recs)), ("pretty", json.dumps(recs, indent=2) + "\n"), ("spaced", "\n [" + " ,\n".join(map(json.dumps, recs)) + " ]  ")):
        (tmp_path / f"{name}.json").write_text(text)
        info = ld.load_dataset(spark, str(tmp_path / f"{name}.json"))
        assert info.total_rows == 90
        got = {x.id: x for x in info.df.collect()}
        assert all(got[x["id"]].t == x["t"] and got[x["id"]].n == x["n"] and got[x["id"]].deep.asDict(True) in (
            x["deep"], {"k": got[x["id"]].deep.k}) for x in recs)


def test_elements_of_text():
    assert json_array.elements('{"a":[1]},\n{"b":"}"} , {"c":{}}\n]') == ['{"a":[1]}', '{"b":"}"}', '{"c":{}}']
    assert json_array.elements("]\n}") == [] and json_array.elements("{\n}") == ["{ }"]


def test_broken_and_empty_arrays(spark, tmp_path):
    (tmp_path / "a.json").write_text("[]")
    (tmp_path / "b.json").write_text('[{"a": 1}, nonsense]')
    for name in ("a", "b"):
        with pytest.raises(ld.LoadError):
            ld.load_dataset(spark, str(tmp_path / f"{name}.json"))


def test_no_cell_holds_an_array(spark, tmp_path):
    (tmp_path / "big.json").write_text(json.dumps([{"id": i, "v": "x" * 50} for i in range(20_000)]))
    from tablelens.sources import splits
    longest = splits.pieces(spark, str(tmp_path / "big.json"), "}").agg(F.max(F.length("value"))).first()[0]
    assert longest < 200 and ld.load_dataset(spark, str(tmp_path / "big.json")).total_rows == 20_000


def test_plain_and_quoted_stretches_of_one_file(spark, tmp_path):
    """Long stretches without quotes (taken whole) around quoted line breaks, blank, short and long lines and empty fields."""
    want, lines = [], ["a,b,c"]
    for i in range(60_000):
        if i % 25_000 == 24_999:
            lines += [f'{i},"x ""{i}""\ny",1', "", f"{i},short", f"{i},too,many,fields"]
            want += [(i, f'x "{i}"\ny', 1), (i, "short", None)]
        else:
            lines.append(f"{i},,{i % 7}" if i % 3 == 0 else f"{i},t {i},{i % 7}")
            want.append((i, None if i % 3 == 0 else f"t {i}", i % 7))
    (tmp_path / "t.csv").write_text("\n".join(lines) + "\n")
    from tablelens.sources import delimited
    got = delimited.read_delimited(spark, str(tmp_path / "t.csv"), ",")
    assert [t for _, t in got.dtypes] == ["int", "string", "int"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)


def test_types_by_the_widest_value(spark):
    from tablelens.sources import delimited
    rows = [("1", "1", "1", "1", "2020-01-02", "2020-01-02T03:04:05", "true", "1", None, "2020-01-02", "1"),
            (None, "3000000000", "0.5", "99999999999999999999", "2021-01-02", "2020-01-02 03:04", "False", "x", None, "2020-01-02T03:04", "true")]
    df = spark.createDataFrame(rows, ", ".join(f"c{i} string" for i in range(11)))
    assert [t for _, t in delimited._typed(df).dtypes] == [
        "int", "bigint", "double", "double", "date", "timestamp", "boolean", "string", "string", "string", "string"]
