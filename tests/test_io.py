"""File sources and sinks: round trips in a scratch folder."""

import os

from pyspark.sql import functions as F

from carelake.sources import files as FS


def test_csv_round_trip(spark, tmp_dir):
    df = spark.createDataFrame([(1, "a", 1.5), (2, None, None)], "id int, s string, x double")
    FS.write_csv(df, f"{tmp_dir}/t")
    back = FS.read_csv_typed(spark, f"{tmp_dir}/t", {"id": "int", "x": "double"})
    assert sorted(tuple(r) for r in back.collect()) == [(1, "a", 1.5), (2, None, None)]


def test_csv_rows_missing_and_fields(spark, tmp_dir):
    assert FS.read_csv_rows(spark, f"{tmp_dir}/nope", ["a", "b"]).count() == 0
    df = spark.createDataFrame([(1, None)], "a int, b string")
    FS.write_csv_rows(df, f"{tmp_dir}/r", ["b", "a", "c"])
    r = FS.read_csv_rows(spark, f"{tmp_dir}/r", ["b", "a", "c"]).first()
    assert (r.a, r.b or "", r.c or "") == ("1", "", "")


def test_json_array(spark, tmp_dir):
    p = f"{tmp_dir}/a.json"
    with open(p, "w") as fh:
        fh.write('[{"id": 1, "patient_email": "x@y.z"}, {"id": 2, "patient_email": ""}]')
    got = FS.read_json_array(spark, p, "id long, patient_email string").collect()
    assert [r.id for r in got] == [1, 2]
    bad = f"{tmp_dir}/b.json"
    with open(bad, "w") as fh:
        fh.write('{"id": 1}')
    try:
        FS.read_json_array(spark, bad, "id long").collect()
        raise AssertionError("expected an error")
    except ValueError:
        pass
    blank = f"{tmp_dir}/c.json"
    open(blank, "w").close()
    assert FS.read_json_array(spark, blank, "id long").count() == 0
    assert FS.read_json_array(spark, f"{tmp_dir}/missing.json", "id long").count() == 0


def test_json_array_round_trip_and_malformed(spark, tmp_dir):
    df = spark.createDataFrame([(i, None if i % 3 else f"é \"{i}\"\n") for i in range(25)], "id long, s string")
    FS.write_json_array(df.repartition(3), f"{tmp_dir}/arr")
    back = FS.read_json_array(spark, f"{tmp_dir}/arr", "id long, s string")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    with open(f"{tmp_dir}/broken.json", "w") as fh:
        fh.write('[{"id": 1}, {"id": ')
    try:
        FS.read_json_array(spark, f"{tmp_dir}/broken.json", "id long").collect()
        raise AssertionError("expected an error")
    except ValueError:
        pass


def test_users_csv(spark, tmp_dir):
    p = f"{tmp_dir}/users.csv"
    with open(p, "w") as fh:
        fh.write("id,full_name,email,phone,role,salt,password_hash,health_details\n")
        fh.write('x, Ann ,ANN@X.COM,555,,s,h,"{""age"": 30}"\n')
        fh.write('2,Bob,bob@x.com,5551112222,DOCTOR,s,h,not json\n')
    u = {r.email: r for r in FS.read_users_csv(spark, p, "age INT").collect()}
    assert u["ann@x.com"].id is None and u["ann@x.com"].role == "patient" and u["ann@x.com"].health_details.age == 30
    assert u["bob@x.com"].role == "doctor" and u["bob@x.com"].health_details is None
    FS.write_users_csv(FS.read_users_csv(spark, p, "age INT"), f"{tmp_dir}/out")
    assert FS.row_count(spark, f"{tmp_dir}/out") == 2
    assert FS.row_count(spark, f"{tmp_dir}/missing") == 0


def test_export_tables(spark, tmp_dir):
    df = spark.range(5).withColumn("x", F.col("id") * 2)
    out = FS.export_tables({"t1": df}, tmp_dir)
    assert os.path.isdir(out["t1"]) and spark.read.parquet(out["t1"]).count() == 5


def test_appends(spark, tmp_dir):
    """Submissions append (blank email dropped); J14: audit rows appended as JSON text."""
    from carelake.operators import portal as P
    from carelake.operators import records as RC

    feed = spark.createDataFrame(
        [(1, "a@x.com", "2024-01-01 00:00:00", '{"age": 30, "symptoms": "fever"}'),
         (2, " ", "2024-01-02 00:00:00", '{"age": 31}'),
         (3, "a@x.com", "2024-01-03 00:00:00", '{"age": 31, "symptoms": "fever"}')],
        "id long, email string, submitted_at string, payload_json string").withColumn(
        "submitted_at", F.col("submitted_at").cast("timestamp"))
    P.append_submissions(feed, f"{tmp_dir}/subs")
    P.append_submissions(feed.filter("id = 3"), f"{tmp_dir}/subs")
    assert spark.read.parquet(f"{tmp_dir}/subs").count() == 3
    events = RC.record_changes(feed)
    P.append_history(events, f"{tmp_dir}/hist")
    rows = {r.event_id: r for r in spark.read.parquet(f"{tmp_dir}/hist").collect()}
    assert set(rows) == {1, 3}  # first submission diffs against {}, the third changes age
    assert '"field":"age"' in rows[3].changes_json and '"age":"31"' in rows[3].after_json
