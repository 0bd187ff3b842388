import hashlib
import json
import os
import struct
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer import fixed_values as fv
from assayer.operators import catalog as ct, images as im, intake
from assayer.operators.fastscore import assess
from assayer.sources import files, legacy, sinks
from assayer.sources.versions import VersionedTables
from assayer.operators.audit import read_audit
from assayer.streaming.audit import start_audit
from assayer.streaming.intake import start_intake
from assayer.streaming.ratelimit import limit_stream

NOW = "2026-06-08 12:00:00"


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(path)


def test_csv_types_and_nulls(spark, tmp_path):
    path = put(tmp_path / "t.csv", 'i,d,b,s,day,gap,big\n1,1.5,True,NA,2026-01-01,,12345678901234567890\n-2,nan,false,"x, ""y""",n/a,NULL,1\n+3,1e3,TRUE,None,2026-01-02,NaN,2\n')
    df = files.read_csv(spark, path)
    assert dict(df.dtypes) == {"i": "bigint", "d": "double", "b": "boolean", "s": "string", "day": "string", "gap": "double", "big": "double"}
    rows = df.orderBy("i").collect()
    assert [r["s"] for r in rows] == ['x, "y"', None, None] and [r["d"] for r in rows] == [None, 1.5, 1000.0]
    assert [r["day"] for r in rows] == [None, "2026-01-01", "2026-01-02"]


def test_read_table_by_suffix(spark, tmp_path):
    put(tmp_path / "a.json", json.dumps([{"x": 1}, {"x": 2}]))
    put(tmp_path / "l.json", '{"x": 1}\n{"x": 2}\n')
    spark.range(3).write.parquet(str(tmp_path / "p.parquet"))
    assert files.read_table(spark, str(tmp_path / "a.json")).count() == 2
    assert files.read_json(spark, str(tmp_path / "l.json"), lines=True).count() == 2
    assert files.read_table(spark, str(tmp_path / "p.parquet")).count() == 3
    with pytest.raises(ValueError):
        files.read_table(spark, "x.xlsx")


def test_text_corpus_and_modality(spark, tmp_path):
    put(tmp_path / "a.txt", "one")
    put(tmp_path / "sub/b.MD", "two")
    put(tmp_path / "c.log", b"bad \xff\xfe bytes")
    put(tmp_path / "d.csv", "x\n1")
    put(tmp_path / "e.png", b"")
    put(tmp_path / "sub/e +%20.txt", b"")
    got = sorted(r["text"] for r in files.read_text_corpus(spark, str(tmp_path)).collect())
    assert got == ["", "bad  bytes", "one", "two"]
    r = files.detect_modality(spark, str(tmp_path)).first()
    assert (r["images"], r["tables"], r["texts"], r["modality"]) == (1, 1, 2, "text")

    def chosen(i, t, x):
        listing = spark.createDataFrame([(".png",)] * i + [(".csv",)] * t + [(".txt",)] * x + [(".zip",)], "suffix string")
        return files.modality_counts(listing).first()["modality"]

    assert [chosen(1, 1, 1), chosen(0, 2, 2), chosen(0, 0, 1), chosen(0, 0, 0), chosen(1, 2, 0)] == ["image", "tabular", "text", "tabular", "tabular"]


def test_fingerprints(spark, tmp_path, data):
    put(tmp_path / "r/a.bin", b"1")
    put(tmp_path / "r/s/b.bin", b"2")
    got = files.file_fingerprints(spark, str(tmp_path / "r"))
    hashes = sorted(r["file_hash"] for r in got.collect())
    assert hashes == sorted(hashlib.sha256(b).hexdigest() for b in (b"1", b"2"))
    folded = hashlib.sha256()
    for name, body in (("a.bin", b"1"), ("s/b.bin", b"2")):
        folded.update(name.encode())
        folded.update(hashlib.sha256(body).hexdigest().encode())
    assert files.folder_fingerprint(got, str(tmp_path / "r")).first()[0] == folded.hexdigest()
    lines = spark.read.parquet(f"{data}/lineitem.parquet")
    same = files.table_fingerprint(lines).first()[0]
    assert same == files.table_fingerprint(lines.repartition(5).orderBy(F.desc("l_partkey"))).first()[0]
    changed = lines.withColumn("l_tax", F.when(F.col("l_orderkey") == lines.first()["l_orderkey"], 9.0).otherwise(F.col("l_tax")))
    assert same != files.table_fingerprint(changed).first()[0]
    assert same != files.table_fingerprint(lines.union(lines)).first()[0]
    listed = spark.createDataFrame([(2, "b"), (1, "a")], "n int, h string")
    assert files.combine_fingerprints(listed, "n", "h").first()[0] == hashlib.sha256(b"ab").hexdigest()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a,"b"')], "i int, s string")
    sinks.write_table(df, str(tmp_path / "csv"))
    assert files.read_csv(spark, str(tmp_path / "csv")).first()["s"] == 'a,"b"'
    sinks.write_table(df, str(tmp_path / "pq"), "parquet")
    sinks.write_report(assess(df, "x.csv", ["i"]), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).first()["filename"] == "x.csv"
    assert json.loads(sinks.report_json(df).first()[0])["i"] == 1
    with pytest.raises(Exception):
        sinks.write_table(df, str(tmp_path / "csv"))


def test_versions_switch_together(spark, tmp_path):
    tables = VersionedTables(spark, str(tmp_path / "store"))
    with pytest.raises(KeyError):
        tables.read("a")
    tables.commit(a=spark.range(3), b=spark.range(5))
    before = tables.read("a")
    with pytest.raises(Exception):
        tables.commit(a=spark.range(9), b=spark.range(1).select(F.raise_error(F.lit("lost")).alias("x")))
    assert tables.read("a").count() == 3 and tables.read("b").count() == 5
    tables.commit(a=before.filter("id > 0"))  # reads the old version while writing the new one
    assert tables.read("a").count() == 2 and tables.read("b").count() == 5


def test_legacy_loads(spark, tmp_path):
    put(tmp_path / "s/1.json", json.dumps({"file_hash": "h1", "filename": "a.csv", "category": "text"}))
    put(tmp_path / "s/2.json", json.dumps({"file_hash": "h2", "owner": "u", "filename": "b.csv", "category": "text"}))
    put(tmp_path / "s/3.json", "{broken")
    records = legacy.read_records(spark, str(tmp_path / "s"), "file_hash STRING, filename STRING, category STRING, owner STRING")
    catalog, count = legacy.load_records(spark.createDataFrame([], ct.CATALOG_SCHEMA), records)
    assert sorted((r["file_hash"], r["owner"]) for r in catalog.collect()) == [("h1", "legacy"), ("h2", "u")] and count.first()[0] == 2
    body = json.dumps({"a": {"id": "a", "username": "x", "email": "x@x"}, "b": {"id": "b", "username": "y", "email": "y@x", "plan": "basic"}, "c": {"username": "z"}})
    lines = spark.createDataFrame([(body,)], "value string")
    fresh, counts = legacy.load_users(legacy.legacy_users(lines, F.col("value")), spark.createDataFrame([("b",)], "id string"))
    assert [(r["id"], r["plan"]) for r in fresh.collect()] == [("a", "free")] and tuple(counts.first()) == (1, 2)


# ---------------------------------------------------------------------- images


def png(pixels):
    """Minimal RGB encoder for fixtures."""
    h, w, _ = pixels.shape

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rows = b"".join(b"\x00" + pixels[y].tobytes() for y in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def luma(p):
    p = p.astype(np.uint32)
    return ((p[..., 0] * 19595 + p[..., 1] * 38470 + p[..., 2] * 7471 + 0x8000) >> 16).astype(float)


def test_image_corpus(spark, tmp_path):
    rng = np.random.default_rng(0)
    pictures = {f"i{k}.png": rng.integers(0, 256, (16, 16 + (40 if k == 5 else k), 3), dtype=np.uint8) for k in range(6)}
    pictures["copy.PNG"] = pictures["i0.png"]
    for name, p in pictures.items():
        put(tmp_path / "c" / name, png(p))
    put(tmp_path / "c/broken.png", b"nope")
    put(tmp_path / "c/empty.png", b"")
    put(tmp_path / "c/note.txt", b"not an image")
    images = files.read_image_corpus(spark, str(tmp_path / "c"))
    stats = {os.path.basename(r["path"]): r for r in im.image_stats(images).collect()}
    assert len(stats) == 9 and not stats["broken.png"]["valid"] and not stats["empty.png"]["valid"]
    for name, p in pictures.items():
        gray, r = luma(p), stats[name]
        assert (r["height"], r["width"]) == p.shape[:2]
        assert abs(r["brightness"] - gray.mean()) < 1e-3 and abs(r["contrast"] - gray.std()) < 1e-3
        gy, gx = np.gradient(gray)
        v = np.var(np.hypot(gx, gy))
        assert abs(r["sharpness"] - 100 * v / (v + 80)) < 1e-2
    assert stats["i0.png"]["hash"] == stats["copy.PNG"]["hash"] and isinstance(stats["i0.png"]["hash"], int)
    facts = im.corpus_facts(im.image_stats(images)).first()
    assert (facts["n_images"], facts["n_valid"], facts["n_hashes"]) == (9, 7, 6)
    ratios = np.array([r["aspect_ratio"] for r in stats.values() if r["valid"]])
    q1, q3 = np.percentile(ratios, [25, 75])
    out = ((ratios < q1 - 1.5 * (q3 - q1)) | (ratios > q3 + 1.5 * (q3 - q1))).mean()
    assert abs(facts["aspect_outliers"] - out) < 1e-9 and out > 0
    listing = files.list_files(spark, str(tmp_path / "c"), glob="*.png")
    labels = images.select("path", F.when(F.col("path").endswith("i0.png"), "a").otherwise("b").alias("label"))
    report = im.assess_images(images, labels, listing, F.lit("2100-01-01").cast("timestamp")).first()
    assert report["dimension_scores"]["Completeness"] == round(700 / 9, 2) and report["dimension_scores"]["Timeliness"] == 0.0
    assert report["dimension_scores"]["Balance"] < 70 and len(report["sample_image_stats"]) == 7
    assert sorted(os.path.basename(r["path"]) for r in im.corrupted(im.image_stats(images)).collect()) == ["broken.png", "empty.png"]
    assert any("sharpness" in a for a in report["fix_actions"])


def test_average_hash_of_a_gradient():
    gray = np.tile(np.arange(64, dtype=float), (64, 1))
    assert im.average_hash(gray) == int("00001111" * 8, 2)


# ---------------------------------------------------------------------- intake


def upload_frame(spark, rows):
    return spark.createDataFrame(
        rows, "file string, file_hash string, filename string, category string, user_id string, description string, ask_price_usd string, content_type string, bytes bigint"
    )


USERS = "id string, username string, email string, plan string, kyb_status string, restricted boolean"


def test_files_assessed_as_one_by_one(spark, tmp_path):
    bodies = {
        "finance_leads.csv": "timestamp,value,email\n2026-01-01,1,test@example.com\n",
        "mixed.csv": 'id,v,s\n1,1.0,"a, b"\n1,1,"a, b"\n2,NA,\n3,2.5,x@y.org\n\n4,nan,"q ""z"""\n',
        "two.csv": "patient,hospital\nTrue,NULL\nfalse,n/a\n",
        "wide.csv": "a,b,c,d\r\n1,2,3,4\r\n5,,,\r\n",
    }
    paths = {n: put(tmp_path / n, b) for n, b in bodies.items()}
    lines = intake.read_lines(spark, list(paths.values()))
    names = lines.select("file").distinct().withColumn("filename", F.regexp_extract("file", r"([^/]*)\z", 1))
    many = {r["filename"]: r for r in intake.assess_files(lines, names).collect()}
    for name, path in paths.items():
        df = files.read_csv(spark, path)
        alone = assess(df.withColumn("__n", F.monotonically_increasing_id()).select("*").drop("__n"), name, df.columns).first()
        r = many[name]
        assert (r["quality_score"], r["redacted_cells"], r["predicted_category"]) == (alone["quality_score"], alone["redacted_cells"], alone["predicted_category"]), name
        assert json.loads(r["stats"]) == alone["stats"].asDict(), name
    out = [r["line"] for r in intake.scrubbed_lines(lines).filter("file LIKE '%mixed.csv'").orderBy("at").collect()]
    assert out == ["id,v,s", '1,1.0,"a, b"', '1,1.0,"a, b"', "2,,", "3,2.5,[EMAIL_REDACTED]", '4,,"q ""z"""']


def test_ingest_batch(spark, tmp_path):
    users = spark.createDataFrame([("s1", "a", "a@x", "free", "verified", False), ("s2", "b", "b@x", "free", "pending", False)], USERS)
    path = put(tmp_path / "finance_leads.csv", "timestamp,value,email\n2026-01-01,1,test@example.com\n")
    blank = put(tmp_path / "blank.csv", "\n")
    lines = intake.read_lines(spark, [path, blank])
    uri = [r["file"] for r in lines.select("file").distinct().collect()][0]
    rows = [
        (uri, "h1", "up/finance_leads.csv", "finance", "s1", None, "9.999", None, 50), ("x", "h2", "photo.png", "images", "s1", "nice", None, None, 10),
        (uri.replace("finance_leads", "blank"), "h3", "blank.csv", "text", "s1", None, None, None, 1), ("x", "h4", "a.txt", "odd", "s1", None, None, None, 1), ("x", "h5", "a.txt", "text", None, None, None, None, 1),
        ("x", "h6", "a.txt", "text", "s2", None, None, None, 1), ("x", "h7", "a.txt", "text", "s1", None, "cheap", None, 1), ("x", "h8", "a.txt", "text", "s1", None, None, None, 0),
    ]
    empty = spark.createDataFrame([], ct.CATALOG_SCHEMA)
    catalog, audit = intake.ingest(upload_frame(spark, rows), lines, users, empty, F.lit(NOW).cast("timestamp"))
    got = {r["file_hash"]: r for r in catalog.collect()}
    assert set(got) == {"h1", "h2", "h3"}
    first = got["h1"]
    assert (first["access_policy"]["sensitivity"], first["filename"], str(first["ask_price_usd"]), first["object_key"]) == ("sensitive", "finance_leads.csv", "10.00", "datasets/h1/finance_leads.csv")
    assert first["category_verification"]["match"] is False and first["compliance_evidence"]["listing_decision"] == "needs_review"
    assert got["h2"]["quality_score"] == 75.0 and got["h2"]["description"] == "nice" and got["h2"]["mime"] == "image/png"
    assert got["h3"]["quality_score"] == 75.0 and "fallback" in got["h3"]["compliance_evidence"]["pii_report"]
    log = {r["metadata"].get("reason", r["resource"]): r["result"] for r in audit.collect()}
    assert log == {"h1": "SUCCESS", "h2": "SUCCESS", "h3": "SUCCESS", **dict.fromkeys(["invalid_category", "missing_user_id", "seller_kyb_required", "invalid_ask_price", "empty_file"], "DENIED")}
    again, _ = intake.ingest(upload_frame(spark, rows), lines, users, catalog, F.lit(NOW).cast("timestamp"))
    assert again.count() == 3


# ------------------------------------------------------------------- streaming


def test_intake_stream(spark, tmp_path):
    tables = VersionedTables(spark, str(tmp_path / "store"))
    users = spark.createDataFrame([("s1", "a", "a@x", "free", "verified", False)], USERS)
    tables.commit(users=users, catalog=spark.createDataFrame([], ct.CATALOG_SCHEMA))
    path = "file://" + put(tmp_path / "finance_leads.csv", "timestamp,value,email\n2026-01-01,1,test@example.com\n")
    first = upload_frame(spark, [(path, "h1", "finance_leads.csv", "finance", "s1", None, None, None, 50)])
    source = str(tmp_path / "uploads")

    def run():
        stream = spark.readStream.schema(first.schema).parquet(source)
        start_intake(stream, tables, str(tmp_path / "chk"), lambda: F.lit(NOW).cast("timestamp"), str(tmp_path / "audit")).awaitTermination()

    first.write.mode("append").parquet(source)
    run()
    upload_frame(spark, [("x", "h2", "b.txt", "text", "s1", None, None, None, 5)]).write.mode("append").parquet(source)
    run()
    run()  # nothing new
    assert sorted(r["file_hash"] for r in tables.read("catalog").collect()) == ["h1", "h2"]
    assert spark.read.parquet(str(tmp_path / "audit")).count() == 2


def test_rate_limit_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    schema = "event_id string, user_id string, at timestamp"

    def send(rows):
        spark.createDataFrame(rows, "event_id string, user_id string, s long").select("event_id", "user_id", F.timestamp_seconds("s").alias("at")).coalesce(1).write.mode("append").parquet(source)

    def run():
        out = limit_stream(spark.readStream.schema(schema).parquet(source))
        out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "chk")).outputMode("append").trigger(availableNow=True).start().awaitTermination()

    send([("1", "u", 0), ("3", "u", 61), ("2", "u", 60), ("4", "v", 5)])
    run()
    send([("5", "u", 121), ("6", "u", 122), ("7", "v", 66)])
    run()
    got = {r["event_id"]: r["accepted"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"1": True, "2": False, "3": True, "4": True, "5": False, "6": True, "7": True}


def test_rate_limit_stream_over_many_batches_forgets_idle_users(spark, tmp_path):
    rng = np.random.default_rng(4)
    source, schema = str(tmp_path / "in"), "event_id string, user_id string, at timestamp"
    batches, at = [], 0
    for n in range(6):  # batches follow each other in time, rows inside one do not
        times = at + rng.permutation(400)
        batches.append([(f"{n}-{k:03d}", "hot" if k % 3 else f"u{n}", int(t)) for k, t in enumerate(times)])
        at += 400
    last, want = {}, {}
    for rows in batches:
        spark.createDataFrame(rows, "event_id string, user_id string, s long").select("event_id", "user_id", F.timestamp_seconds("s").alias("at")).coalesce(1).write.mode("append").parquet(source)
        out = limit_stream(spark.readStream.schema(schema).parquet(source), 60, "10 seconds")
        out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "chk")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
        for name, user, t in sorted(rows, key=lambda r: (r[2], r[0])):
            want[name] = user not in last or t - last[user] > 60
            last[user] = t if want[name] else last[user]
    assert {r["event_id"]: r["accepted"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want
    kept = spark.read.format("statestore").option("stateVarName", "last").load(str(tmp_path / "chk")).selectExpr("key.user_id").collect()
    assert {r[0] for r in kept} <= {"hot", "u5"} and kept


def test_audit_stream_keeps_late_events(spark, tmp_path):
    source = tmp_path / "in"
    schema = "id string, action string, metadata string, created_at timestamp"
    for n, hour in enumerate((12, 13, 14, 4, 15, 16)):
        rows = spark.sql(f"SELECT 'e{n}' AS id, 'ACT' AS action, '{{}}' AS metadata, TIMESTAMP '2026-01-01 {hour:02d}:00:00' AS created_at")
        rows.write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    start_audit(stream, str(tmp_path / "out"), str(tmp_path / "chk")).awaitTermination()
    assert sorted(r["id"] for r in read_audit(spark, str(tmp_path / "out")).collect()) == [f"e{n}" for n in range(6)]


def test_audit_read_drops_repeats(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [("a", "ACT", '{"token":"x"}', NOW), ("a", "ACT", '{"token":"x"}', NOW), ("b", "ACT", "{}", NOW)]
    spark.createDataFrame(rows, "id string, action string, metadata string, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp")).write.parquet(source)
    stream = spark.readStream.schema("id string, action string, metadata string, created_at timestamp").parquet(source)
    start_audit(stream, str(tmp_path / "out"), str(tmp_path / "chk")).awaitTermination()
    got = read_audit(spark, str(tmp_path / "out")).collect()
    assert sorted(r["id"] for r in got) == ["a", "b"]
    assert {r["metadata"].get("token") for r in got} == {"[REDACTED]", None}


def test_text_freshness(spark, tmp_path):
    from assayer.operators.textcorpus import assess_text, freshness

    path = put(tmp_path / "a.txt", "the cat")
    listing = files.list_files(spark, str(tmp_path))
    os.utime(path, (time.time(), time.mktime(time.strptime("2026-01-01", "%Y-%m-%d"))))
    fresh = freshness(listing, F.lit("2026-01-01").cast("timestamp")).first()[0]
    assert fresh > 99.0
    report = assess_text(files.read_text_corpus(spark, str(tmp_path)), "text", "path", listing, F.lit("2100-01-01").cast("timestamp")).first()
    assert report["dimension_scores"]["Timeliness"] == 0.0 and fv.NEUTRAL_SCORE == report["dimension_scores"]["Balance"]


def test_assessment_by_path(spark, tmp_path, data):
    from assayer.operators.assessment import run_assessment

    put(tmp_path / "t/a.txt", "the cat and the dog")
    put(tmp_path / "t/b.md", "the bird")
    put(tmp_path / "i/a.png", png(np.random.default_rng(1).integers(0, 256, (20, 20, 3), dtype=np.uint8)))
    now = F.lit("2100-01-01").cast("timestamp")
    assert run_assessment(spark, str(tmp_path / "t"), as_of=now).first()["modality"] == "text"
    assert run_assessment(spark, str(tmp_path / "i"), as_of=now).first()["modality"] == "image"
    r = run_assessment(spark, f"{data}/customer.parquet", id_col="c_custkey").first()
    assert r["modality"] == "tabular" and len(r["input_hash"]) == 64
    with pytest.raises(ValueError):
        run_assessment(spark, str(tmp_path), modality="graph")


def test_one_file_of_one_block_is_scrubbed_in_many_tasks(spark):
    rows = [("a", (0, 0), "id,mail")] + [("a", (1, i), f"{i},m{i}@b.com") for i in range(1, 400)] + [("b", (7, 0), "x"), ("b", (7, 3), "1")]
    lines = spark.createDataFrame(rows, "file string, at struct<block: bigint, row: bigint>, line string")
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        for key, value in zip(held, ("false", "-1", "8"), strict=True):
            spark.conf.set(key, value)
        got = intake.scrub_files(lines, intake.parse_files(lines)).select("file", "clean", F.spark_partition_id().alias("task")).collect()
    finally:
        for key, value in held.items():
            spark.conf.set(key, value)
    assert sorted(tuple(r.clean) for r in got if r.file == "a") == sorted((str(i), "[EMAIL_REDACTED]") for i in range(1, 400))
    assert [r.clean for r in got if r.file == "b"] == [["1"]]
    assert len({r.task for r in got if r.file == "a"}) == 8


def test_moved_rows_of_the_fingerprints_go_to_any_number_of_tasks(spark, tmp_path):
    from assayer.plans.sources import QUERIES

    spark.range(50).selectExpr("id l_orderkey", "id % 7 l_partkey", "if(id % 9 = 0, null, id / 4) l_tax").write.parquet(f"{tmp_path}/lineitem.parquet")
    df = QUERIES["table_fingerprints"].build(spark, str(tmp_path))
    assert sorted(r.versions for r in df.collect()) == ["doubled", "moved,plain"]
    plan = df._jdf.queryExecution().toString()
    assert "REPARTITION_BY_COL" in plan and "REPARTITION_BY_NUM" not in plan
