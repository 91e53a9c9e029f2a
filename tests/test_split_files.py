"""Records of files cut into small blocks against Python's csv and json."""

import csv
import io
import json
import random

import pytest

from demandgrid.sources import readers as RD
from demandgrid.sources import split_files as SF


@pytest.fixture
def small_blocks(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("ends", ["\n", "\r\n"])
def test_csv_records_of_many_blocks(small_blocks, tmp_path, ends):
    draw = random.Random(len(ends))
    cell = lambda: "".join(draw.choice(["a", "b", ",", '"', "\n", "x y", "é", ""]) for _ in range(draw.randint(0, 12)))
    path = tmp_path / "a.csv"
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f, lineterminator=ends)
        out.writerow(["id", "u", "v", "w"])
        out.writerows([str(i), cell(), cell(), "z" * (1000 if i == 70 else 1)] for i in range(150))
        f.write(ends + f'500,5" pipe,"a"b,c{ends}{ends}501,"",k,m{ends}')
    expected = [r for r in csv.reader(open(path, newline="", encoding="utf-8")) if r]
    records = SF.csv_records(small_blocks, str(path))
    got = [next(csv.reader(io.StringIO(r.text, newline=""))) for r in records.orderBy("_record").collect()]
    assert got == expected
    assert records.select("_pos.start").distinct().count() > 5
    rows = RD.quoted_csv(small_blocks, str(path), position="at").orderBy("at").collect()
    plain = [[c if c else None for c in r] for r in expected[1:151]]
    assert [[c if c else None for c in (r.id, r.u, r.v, r.w)] for r in rows[:150]] == plain


def test_csv_odd_files(spark, tmp_path):
    def records(text):
        path = tmp_path / f"f{abs(hash(text))}.csv"
        path.write_text(text, encoding="utf-8", newline="")
        return [r.text for r in SF.csv_records(spark, str(path)).orderBy("_record").collect()]

    assert records("") == []
    assert records("a,b") == ["a,b"]
    assert records('a,b\n1,"open\n2,c\n') == ["a,b", '1,"open\n2,c']
    assert records('a\n""\n"""\n"""\n') == ["a", '""', '"""\n"""']
    assert records('\n  \na\n"x\n\ny"\n') == ["a", '"x\n\ny"']


def elements():
    draw = random.Random(3)
    for i in range(200):
        e = {"type": "node", "id": i, "lat": i * 0.5, "tags": {"name": draw.choice(['a "q" {x', "}{][", "\\", '\\"}', "é"])}}
        if i % 3 == 0:
            e.pop("tags")
        if i % 5 == 0:
            e["nodes"] = [1, 2, {"k": [{}]}]
        yield e


@pytest.mark.parametrize("indent", [None, 1])
def test_json_array_under_a_key(small_blocks, tmp_path, indent):
    rows = list(elements())
    whole = {"version": 0.6, "osm3s": {"elements": [{"a": 1}], "x": {"y": [{}]}}, "bbox": [1, 2], "note": '"elements":[{', "other": [{"type": "no"}, {"type": "no", "t": {}}],
             "empty": [], "elements": rows, "after": [{"type": "no"}], "z": {"q": {}}}
    path = tmp_path / "m.json"
    path.write_text(json.dumps(whole, indent=indent), encoding="utf-8")
    got = SF.json_elements(small_blocks, str(path), "type string, id int, lat double, tags struct<name:string>").orderBy("_element").collect()
    assert [(r.e.type, r.e.id, r.e.lat, r.e.tags and r.e.tags.name) for r in got] == [("node", e["id"], e["lat"], e.get("tags", {}).get("name")) for e in rows]


@pytest.mark.parametrize("indent", [None, 1])
def test_json_array_of_rows(small_blocks, tmp_path, indent):
    draw = random.Random(5)
    table = [["ZCTA", "n"]] + [[str(i), draw.choice(["]", "[a", 'x"y', None, "\\"])] for i in range(150)]
    path = tmp_path / "r.json"
    path.write_text(json.dumps(table, indent=indent), encoding="utf-8")
    got = SF.json_elements(small_blocks, str(path), "array<string>", None, "[").orderBy("_element").collect()
    assert [r.e for r in got] == table


def test_json_odd_files(spark, tmp_path):
    def ids(text, key="elements"):
        path = tmp_path / f"f{abs(hash(text))}.json"
        path.write_text(text, encoding="utf-8")
        return [r.e.id for r in SF.json_elements(spark, str(path), "id int", key).orderBy("_element").collect()]

    assert ids("") == [] and ids("{}") == [] and ids("[]", None) == []
    assert ids('{"elements":[]}') == [] and ids('{"elements":[],"after":[{"id":1}]}') == []
    assert ids('{"other":[{"id":1}]}') == []
    assert ids('{"elements":[null,{"id":1},2,{"id":2}]}\n') == [1, 2]
    assert ids(' [ {"id":1} , {"id":2,"x":[{"id":3}]} ] ', None) == [1, 2]


def test_array_readers(small_blocks, tmp_path):
    m = tmp_path / "m.json"
    m.write_text(json.dumps({"elements": [{"type": "node", "lat": 1.0, "lon": 2.0, "tags": {"amenity": "school"}}, {"type": "way", "center": {"lat": 3.0, "lon": 4.0}, "tags": {"shop": "books"}}, {"type": "node", "lat": 1.0, "lon": 2.0}]}))
    assert sorted((r.lat, r.kind) for r in RD.map_elements(small_blocks, str(m)).collect()) == [(1.0, "school"), (3.0, "commercial")]
    names = ["NAME", "B01003_001E", "B19013_001E", "B23025_001E", "B23025_004E", "B15003_001E", "B15003_022E", "B15003_023E", "B15003_024E", "B15003_025E", "C24050_046E", "zip code tabulation area"]
    a = tmp_path / "a.json"
    a.write_text(json.dumps([names, ["x [1]", "100", "-666666666", "50", "40", "80", "8", "-666666666", None, "4", "4", "2139"]]))
    row = RD.acs_table(small_blocks, str(a)).collect()
    assert [tuple(r) for r in row] == [("02139", 100.0, None, 0.5, 0.8, 0.15, 0.1)]
