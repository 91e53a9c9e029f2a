"""Files in, files out."""

import json

import pytest
from pyspark.sql import functions as F

from demandgrid.operators import records as RC
from demandgrid.sources import readers as RD
from demandgrid.sources import sinks as SK

C = F.col


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text, encoding="utf-8")
    return str(p)


def test_class_history_with_locations(spark, tmp_path):
    c = put(tmp_path, "c.csv", "Class,Start Date / Time,Students,Seats,Location\nAHA BLS Provider,2/1/25 8:00,7,10,San Jose (t)\n,,,,\nRed Cross CPR,3/1/25 9:00,n/a,0,Group Training\nACLS,bad,3,5,Mystery\n")
    l = put(tmp_path, "l.csv", 'Abbreviation,Name\nSan Jose,"San Jose(1 First Street, San Jose, CA 95112)"\nGroup Training,"A(1 B, Reno, NV 89501)"\nGroup Training,"B(2 C, Elko, NV 89801)"\n')
    rows = {r.class_name: r for r in RD.class_history(spark, c, l).collect()}
    assert set(rows) == {"AHA BLS Provider", "Red Cross CPR", "ACLS"}
    assert rows["AHA BLS Provider"].zip == "95112" and rows["AHA BLS Provider"].match == "matched"
    assert rows["Red Cross CPR"].match == "ambiguous" and rows["Red Cross CPR"].city is None and rows["Red Cross CPR"].enrolled is None
    assert rows["ACLS"].match == "unmatched" and rows["ACLS"].class_date is None


def test_centroids_last_duplicate_wins(spark, tmp_path):
    p = put(tmp_path, "z.csv", "zip,lat,lng\n00001,1,2\n00001,3,4\nbad,1,1\n00002,x,1\n")
    assert [tuple(r) for r in RD.zip_centroids(spark, p).collect()] == [("00001", 3.0, 4.0)]


def test_facilities_and_institutions(spark, tmp_path):
    a = put(tmp_path, "h.csv", "NAME,LATITUDE,LONGITUDE,ZIP\nA,37.1,-122.1,\nB,,,2139\nC,,,\n")
    got = {(r.category, r.zip, r.lat) for r in RD.facilities(spark, {"hospital": a}).collect()}
    assert got == {("hospital", None, 37.1), ("hospital", "02139", None)}
    i = put(tmp_path, "i.csv", "INSTNM,ZIP,EFTOTLT\nSchool of Nursing,95112-1234,120\nNo Zip,,5\n")
    assert [tuple(r) for r in RD.institutions(spark, i).collect()] == [("School of Nursing", "95112", 120)]


def test_required_columns(spark, tmp_path):
    p = put(tmp_path, "j.csv", "city,state\nA,B\n")
    for reader in (RD.job_postings, RD.rent_overrides, RD.backtest_rows):
        with pytest.raises(ValueError):
            reader(spark, p)
    ok = put(tmp_path, "r.csv", ",".join(RD.RENT_COLUMNS) + "\nA,CA,37,-122,3,48.5,http://x,n\n")
    assert RD.rent_overrides(spark, ok).first().rent_per_sqft_annual == 48.5
    b = put(tmp_path, "b.csv", "address,state,outcome,label\nx,CA,5,a\ny,CA,unknown,b\n")
    assert RD.backtest_rows(spark, b).count() == 1


def test_line_breaks_in_cells(spark, tmp_path):
    j = put(tmp_path, "j.csv", ",".join(RD.POSTING_COLUMNS) + '\nReno,NV,39.5,-119.8,5,A,EMT,"first\nsecond, third",http://x,2025-01-01,"n\n""m"""\nElko,NV,40,-115,9,B,CNA,one,http://y,2025-01-02,\n')
    rows = {r.city: r for r in RD.job_postings(spark, j).collect()}
    assert set(rows) == {"Reno", "Elko"} and rows["Elko"].radius_miles == 9.0
    assert (rows["Reno"].description, rows["Reno"].source_url, rows["Reno"].notes) == ("first\nsecond, third", "http://x", 'n\n"m"')
    b = put(tmp_path, "b.csv", 'address,state,label,outcome\n"1 A\nReno",NV,"a\nb",5\n2 B,NV,c,6\n')
    assert sorted((r.address, r.outcome) for r in RD.backtest_rows(spark, b).collect()) == [("1 A\nReno", 5.0), ("2 B", 6.0)]
    assert RD.backtest_rows(spark, put(tmp_path, "s.csv", "address,state,outcome\nx,CA,5\n")).count() == 1


def test_overrides_and_validation(spark, tmp_path):
    o = put(tmp_path, "o.csv", "candidate_id,address_match,asking_rent,square_feet,parking_notes,broker_notes\n,,1,2,,\nc1,,30,900,lot,\n")
    assert [r.candidate_id for r in RD.commercial_overrides(spark, o).collect()] == ["c1"]
    v = put(tmp_path, "v.csv", 'zip,monthly_rent,available\n95112,"$3,200",yes\n,100,no\n')
    assert [(r.zip, r.monthly_rent) for r in RD.commercial_validation(spark, v).collect()] == [("95112", 3200.0)]
    s = put(tmp_path, "s.csv", "state,median_price,sample_size,overall_median\nca,80,3,75\n,1,1,1\n")
    assert [tuple(r) for r in RD.state_prices(spark, s).collect()] == [("CA", 80.0, 3.0, 75.0)]


def test_roster_locations_settings(spark, tmp_path):
    r = put(tmp_path, "r.csv", "name,zip,courses,certifications,travel_radius_miles,verified\nPat,2139,AHA_BLS; ARC_BLS,a|b,15,Yes\n,1,,,,\n")
    row = RD.roster(spark, r).collect()
    assert len(row) == 1 and row[0].zip == "02139" and row[0].courses == ["AHA_BLS", "ARC_BLS"] and row[0].verified is True and row[0].long_term_interest == "UNKNOWN"
    l = put(tmp_path, "l.csv", "location_name,address,zip,active_status,capacity\nHall,1 A,95112,Active,12\n")
    assert RD.locations(spark, l).first().active_status == "active"
    e = put(tmp_path, "e.csv", "fixed_monthly_cost\n700\n")
    assert RD.settings(spark, e, {"fixed_monthly_cost": 650.0, "saas": 25.0}).first().asDict() == {"fixed_monthly_cost": 700.0, "saas": 25.0}
    k = put(tmp_path, "k.csv", "course_type,student_price\naha_bls,95\n")
    assert RD.keyed_numbers(spark, k, "course_type", ["student_price", "card_cost"]).first().asDict() == {"course_type": "AHA_BLS", "student_price": 95.0, "card_cost": None}
    h = put(tmp_path, "h.csv", "site_name,monthly_avg_revenue\nA,\"$1,200\"\n ,5\n")
    assert [x.monthly_avg_revenue for x in RD.site_health(spark, h).collect()] == [1200.0]


def test_json_twin_zip_list_and_preferred(spark, tmp_path):
    j = put(tmp_path, "d.json", json.dumps([{"zip": "1", "student_count": 3}]))
    assert RD.table_or_json(spark, j.removesuffix(".json"), "zip string, student_count bigint").first().student_count == 3
    z = put(tmp_path, "z.json", json.dumps({"zips": [{"zip": "95112"}, {"zip": "2139"}, {"zip": "95112"}]}))
    assert [r.zip for r in RD.zip_list(spark, z).orderBy("pos").collect()] == ["95112", "02139"]
    assert RD.preferred(spark, [str(tmp_path / "none"), z]) == z
    p = tmp_path / "profiles"
    p.mkdir()
    (p / "a.json").write_text(json.dumps({"candidate_id": "c", "sub": {"x": 1.5}}))
    assert RD.profiles(spark, str(p), "candidate_id string, sub struct<x:double>").first().sub.x == 1.5


def test_last_duplicate_follows_the_files(spark, tmp_path):
    """Spark packs files by size, so task row numbers alone would let a.csv win."""
    folder = tmp_path / "centroids"
    folder.mkdir()
    put(folder, "a.csv", "zip,lat,lng\n00001,1,1\n")
    put(folder, "b.csv", "zip,lat,lng\n00001,2,2\n" + "".join(f"{k:05d},5,5\n" for k in range(2, 500)))
    assert RD.zip_centroids(spark, str(folder)).where("zip = '00001'").first().lat == 2.0


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("00042", 1.0, "s"), ("99999", None, "t")], "zip string, v double, door_code string")
    SK.write_zip_files(df, str(tmp_path / "z"))
    back = spark.read.json(str(tmp_path / "z"))
    assert "door_code" not in back.columns and back.count() == 2
    SK.write_candidates(df, str(tmp_path / "c"))
    assert {r.v for r in RD.big_csv(spark, str(tmp_path / "c")).collect()} == {"1.0", "unknown"}
    SK.write_centroids(spark.createDataFrame([("2", 1.0, 2.0), ("1", 3.0, 4.0)], "zip string, lat double, lng double"), str(tmp_path / "k"))
    assert RD.big_csv(spark, str(tmp_path / "k")).count() == 2
    SK.write_table(df, str(tmp_path / "t"))
    lite = RC.lite(spark.createDataFrame([("1", 1.0, 2.0, 50.0, 40.0, 60.0, "b", "ok", 3.0, "w")], "zip string, lat double, lng double, overall double, bls_demand double, cpr_demand double, tier string, data_confidence string, validation_score double, validation_tier string"))
    assert lite.columns[3] == "overall_score" and lite.first().arc_cpr == 60.0
