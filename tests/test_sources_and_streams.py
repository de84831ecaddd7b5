import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources import audit, documents, master, store
from ledgerloom.streaming import streams


def test_pdfs_by_suffix_in_any_case(spark, tmp_path):
    for name in ("a.pdf", "B.PDF", "c.txt"):
        (tmp_path / name).write_bytes(b"%PDF " + name.encode())
    got = documents.read_pdfs(spark, str(tmp_path))
    assert sorted(r.original_filename for r in got.collect()) == ["B.PDF", "a.pdf"] and len({r.invoice_id for r in got.collect()}) == 2


def test_ocr_runs_only_where_digital_text_is_unclear(spark, tmp_path):
    (tmp_path / "good.pdf").write_bytes(b"good")
    (tmp_path / "bad.pdf").write_bytes(b"bad")
    clean = "Rechnung Rechnungsnummer Datum Betrag EUR netto brutto IBAN GmbH Steuer Leistung"

    def digital(data):
        return clean if data == b"good" else "~~"

    def broken(data):
        raise RuntimeError

    def ocr(data):
        return clean + " Kunden Kunden"

    pdfs = documents.read_pdfs(spark, str(tmp_path))
    names = {r.invoice_id: r.original_filename for r in pdfs.collect()}
    got = {names[r.invoice_id]: r.engine for r in documents.extract_texts(pdfs, {"pdfplumber": digital, "pymupdf": digital}, {"ocr": ocr}).collect()}
    assert got == {"good.pdf": "pdfplumber", "bad.pdf": "ocr"}
    got = {names[r.invoice_id]: r.engine for r in documents.extract_texts(pdfs, {"pdfplumber": digital, "pymupdf": broken}, {"ocr": ocr}).collect()}
    assert got == {"good.pdf": "ocr", "bad.pdf": "ocr"}


def test_missing_engines_give_no_text(spark, tmp_path):
    (tmp_path / "x.pdf").write_bytes(b"x")
    row = documents.extract_texts(documents.read_pdfs(spark, str(tmp_path))).first()
    assert row.score == -1.0 and len(row.errors) == 3 and row.errors[0].startswith("ocr: ")  # a broken install says so


def test_the_pdf_of_a_record(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-a")
    pdfs = documents.read_pdfs(spark, str(tmp_path))
    own = pdfs.select("invoice_id", F.lit("uploaded as.pdf").alias("original_filename"))
    row = documents.stored_pdf(pdfs, own, pdfs.first().invoice_id).first()
    assert (row.original_filename, bytes(row.content)) == ("uploaded as.pdf", b"%PDF-a")


def test_upload_and_correction_leave_records_and_events(spark, tmp_path):
    from ledgerloom.plans import invoices
    from ledgerloom.plans.fixtures import LAYOUTS

    records, log, bad = (str(tmp_path / x) for x in ("records", "log", "bad"))
    texts = spark.createDataFrame(LAYOUTS[2:4], "invoice_id string, text string").withColumn("original_filename", F.concat("invoice_id", F.lit(".pdf")))
    invoices.upload(texts, records, log)
    patches = spark.createDataFrame([("3", 1, {"gross_amount": "238,00"}), ("4", 1, {"net_amount": "x"})], "invoice_id string, seq long, patch map<string,string>")
    invoices.correct(spark.read.parquet(records), patches, str(tmp_path / "after"), log, bad)
    events = {(r.invoice_id, r.action): r.details for r in spark.read.parquet(log).collect()}
    assert events["3", "upload"] == {"filename": "3.pdf"} and set(events) == {("3", "upload"), ("4", "upload"), ("3", "revalidate")}
    told = events["3", "revalidate"]
    assert told["traffic_light"] == "GREEN" and json.loads(told["extracted"])["gross_amount"] == 238.0 and len(json.loads(told["booking_proposal"])) == 3
    assert [r.invoice_id for r in spark.read.parquet(bad).collect()] == ["4"]
    before, after = spark.read.parquet(records).filter("invoice_id = '3'").first(), spark.read.parquet(str(tmp_path / "after")).first()
    assert before.traffic_light == "RED" and after.audit == before.audit


def test_master_data_and_tolerance_of_the_session(spark, tmp_path):
    from ledgerloom.plans import invoices
    from ledgerloom.plans.fixtures import LAYOUTS

    path = str(tmp_path / "m")
    master.seed(spark, path)
    other = spark.read.parquet(f"{path}/clients").withColumn("company_name", F.lit("Ganz Andere GmbH"))
    other.coalesce(1).write.parquet(f"{path}/new")
    spark.read.parquet(f"{path}/new").write.mode("overwrite").parquet(f"{path}/clients")
    texts = spark.createDataFrame(LAYOUTS[:3:2], "invoice_id string, text string")
    for setting, value, lights in (("master", path, {"1": "RED", "3": "RED"}), ("tolerance", "12", {"1": "GREEN", "3": "GREEN"})):
        spark.conf.set(f"spark.ledgerloom.{setting}", value)
        try:
            assert {r.invoice_id: r.traffic_light for r in invoices.process(texts).collect()} == lights
        finally:
            spark.conf.unset(f"spark.ledgerloom.{setting}")


def test_master_data_seed_and_load(spark, tmp_path):
    path = str(tmp_path / "m")
    assert master.seed(spark, path) == master.seed(spark, path) == {"accounts": 8, "clients": 1, "creditors": 4, "keyword_rules": 31}
    assert master.load(spark, path) == master.Master() == master.load(spark, str(tmp_path / "none"))
    with pytest.raises(Exception):  # noqa: B017
        master.load(spark, str(tmp_path / "none"), fallback=False)
    made = master.frames(spark)["accounts"]
    changed = master.upsert(made, made.filter("account = '1600'").withColumn("name", F.lit("neu")), "account")
    assert changed.count() == 8 and changed.filter("name = 'neu'").count() == 1


def test_records_store_and_export(spark, tmp_path):
    df = spark.createDataFrame([("1", ("N-1",)), ("2", (None,))], "invoice_id string, extracted struct<invoice_number:string>")
    documents.append(df, str(tmp_path / "r"))
    documents.append(df.withColumn("invoice_id", F.concat("invoice_id", F.lit("x"))), str(tmp_path / "r"))
    stored = spark.read.parquet(str(tmp_path / "r"))
    assert documents.listed(stored).count() == 4 and documents.find(stored, "2x").count() == 1
    assert sorted(r[0] for r in df.select(documents.export_name()).collect()) == ["2.json", "N-1.json"]
    raw = df.filter("invoice_id = '2'").select(documents.as_json(F.struct("*"))).first()[0]
    assert "\n" in raw and json.loads(raw) == {"invoice_id": "2", "extracted": {"invoice_number": None}}
    log = audit.events(df, "upload", filename="invoice_id")
    audit.log(log, str(tmp_path / "a"))
    assert spark.read.parquet(str(tmp_path / "a")).filter("details['filename'] = '1'").count() == 1


def run(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()


def test_invoice_stream(spark, tmp_path):
    from ledgerloom.plans.fixtures import LAYOUTS

    spark.createDataFrame(LAYOUTS[:3], "invoice_id string, text string").coalesce(1).write.parquet(str(tmp_path / "in"))
    run(streams.invoice_stream(spark, str(tmp_path / "in")), "inv", "append")
    assert {r.invoice_id: r.traffic_light for r in spark.table("inv").collect()} == {"1": "GREEN", "2": "GREEN", "3": "RED"}


def test_patch_stream_keeps_the_newest(spark, tmp_path):
    rows = [("a", 2, {"x": "two"}), ("a", 1, {"x": "one", "y": "why"}), ("a", 3, {"y": None})]
    spark.createDataFrame(rows, "invoice_id string, seq long, patch map<string,string>").coalesce(1).write.parquet(str(tmp_path / "p"))
    run(streams.latest_values(streams.patch_stream(spark, str(tmp_path / "p"))), "pat", "update")
    assert {(r.field, r.value) for r in spark.table("pat").collect()} == {("x", "two"), ("y", None)}


def test_upserts_by_batch(spark, tmp_path):
    src, schema = str(tmp_path / "src"), "k string, v int, at int"
    spark.createDataFrame([("a", 1, 1), ("a", 2, 3), ("a", 3, 2), ("b", 9, 9), ("b", 1, 10)], schema).coalesce(1).write.parquet(src)
    df = spark.readStream.schema(schema).parquet(src)
    for expected in ({"a": 2, "b": 1}, {"a": 2, "b": 5}):
        q = streams.upsert_batches(df, str(tmp_path / "t"), "k", str(tmp_path / "ck"), order="at").start()
        q.processAllAvailable()
        q.stop()
        assert {r.k: r.v for r in store.read(spark, str(tmp_path / "t"), schema).collect()} == expected
        spark.createDataFrame([("a", 7, 2), ("b", 4, 11), ("b", 5, 12)], schema).coalesce(1).write.mode("append").parquet(src)


def test_upserts_write_only_the_buckets_they_touch(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k long, v string"
    files = lambda n: {p.parent.name for p in (tmp_path / "t" / "data" / f"batch={n}").glob("bucket=*/*.parquet")}
    store.upsert(spark.range(1000).select(F.col("id").alias("k"), F.lit("old").alias("v")), path, "k", 0, buckets=16)
    assert len(files(0)) == 16
    few = spark.createDataFrame([(3, "new"), (3, "newer"), (2000, "new"), (None, "x")], schema)
    store.upsert(few, path, "k", 1)
    assert 1 <= len(files(1)) <= 3  # the number of buckets stays what it was
    want = {k: "old" for k in range(1000)} | {3: "newer", 2000: "new", None: "x"}
    assert {r.k: r.v for r in store.read(spark, path, schema).collect()} == want
    store.upsert(few.withColumn("v", F.lit("again")), path, "k", 1)  # committed, so it changes nothing
    assert {r.k: r.v for r in store.read(spark, path, schema).collect()} == want
    store.upsert(few.limit(0), path, "k", 2)
    assert {r.k: r.v for r in store.read(spark, path, schema).collect()} == want and store.read(spark, str(tmp_path / "none"), schema).count() == 0


def test_a_failed_upsert_is_run_again_and_old_versions_go(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k long, v int"
    rows = lambda v: spark.range(40).select(F.col("id").alias("k"), F.lit(v).cast("int").alias("v"))
    for n in range(3):
        store.upsert(rows(n), path, "k", n, buckets=4)
    fails = F.udf(lambda k: 1 // 0 if k == 39 else 7, "int")
    with pytest.raises(Exception, match="ZeroDivision"):
        store.upsert(rows(0).withColumn("v", fails("k")), path, "k", 3)
    assert {r.v for r in store.read(spark, path, schema).collect()} == {2}
    store.upsert(rows(3), path, "k", 3)
    assert {r.v for r in store.read(spark, path, schema).collect()} == {3}
    held = {p.name for p in (tmp_path / "t" / "data").iterdir() if list(p.glob("bucket=*"))}
    assert held == {"batch=2", "batch=3"} and sorted(p.name for p in (tmp_path / "t" / "manifest").glob("*.json")) == ["2.json", "3.json"]


def test_uploads_and_events_come_once(spark, tmp_path):
    from ledgerloom.plans import invoices
    from ledgerloom.plans.fixtures import LAYOUTS

    records, log, bad = (str(tmp_path / x) for x in ("records", "log", "bad"))
    texts = spark.createDataFrame(LAYOUTS[:3], "invoice_id string, text string")
    invoices.upload(texts, records, log)
    (tmp_path / "log").rename(tmp_path / "lost")  # as if the run had failed between records and events
    at = spark.read.parquet(records).first().audit.processed_at
    for _ in range(2):
        invoices.upload(texts.orderBy(F.desc("invoice_id")), records, log)
    assert spark.read.parquet(records).count() == spark.read.parquet(log).count() == 3
    assert {r.audit.processed_at for r in spark.read.parquet(records).collect()} == {at}
    patches = spark.createDataFrame([("3", 1, {"gross_amount": "238,00"}), ("1", 1, {"net_amount": "x"})], "invoice_id string, seq long, patch map<string,string>")
    for _ in range(2):
        invoices.correct(spark.read.parquet(records), patches, str(tmp_path / "after"), log, bad)
    assert spark.read.parquet(log).groupBy("action").count().collect() and {r["action"]: r["count"] for r in spark.read.parquet(log).groupBy("action").count().collect()} == {"upload": 3, "revalidate": 1}
    assert spark.read.parquet(bad).count() == 1
    invoices.upload(texts, records, log, batch="second")  # another name, another batch
    assert spark.read.parquet(log).count() == 7


def test_uploads_as_a_stream(spark, tmp_path):
    from ledgerloom.plans.fixtures import LAYOUTS

    spark.createDataFrame(LAYOUTS[:2], "invoice_id string, text string").coalesce(1).write.parquet(str(tmp_path / "in"))
    texts = spark.readStream.schema("invoice_id string, text string").parquet(str(tmp_path / "in"))
    for checkpoint in ("one", "two"):  # a lost checkpoint brings the same batch again
        q = streams.upload_batches(texts, str(tmp_path / "r"), str(tmp_path / "l"), str(tmp_path / checkpoint)).start()
        q.processAllAvailable()
        q.stop()
    assert spark.read.parquet(str(tmp_path / "r")).count() == spark.read.parquet(str(tmp_path / "l")).count() == 2


def test_matched_streams_evict_and_tell_what_found_nothing(spark, tmp_path):
    def feed(name, *times):
        df = spark.createDataFrame([(k, t, f"{name}{i}") for i, (k, t) in enumerate(times)], "k string, t string, id string").select("k", F.to_timestamp("t").alias("t"), "id")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        return df

    a = [("x", "2026-01-01 10:00:00"), ("y", "2026-01-01 10:00:00")]
    b = [("x", "2026-01-01 10:30:00"), ("x", "2026-01-01 11:30:00")]
    both = feed("a", *a), feed("b", *b)
    cols = lambda df, n: df.select("k", F.col("t").alias(f"t{n}"), F.col("id").alias(f"id{n}"))
    batch = streams.matched(cols(both[0], 1), cols(both[1], 2), "k", "t1", "t2", "1 HOUR")
    assert {(r.id1, r.id2) for r in batch.collect()} == {("a0", "b0"), ("a1", None)}
    one, two = (cols(spark.readStream.schema("k string, t timestamp, id string").parquet(str(tmp_path / n)), i) for i, n in ((1, "a"), (2, "b")))
    q = streams.matched(one, two, "k", "t1", "t2", "1 HOUR", late="10 minutes").writeStream.format("memory").queryName("met").outputMode("append").start()
    try:
        q.processAllAvailable()
        assert {(r.id1, r.id2) for r in spark.table("met").collect()} == {("a0", "b0")}
        for _ in range(2):
            feed("a", ("z", "2026-01-02 10:00:00"))
            feed("b", ("w", "2026-01-02 10:00:00"))
            q.processAllAvailable()
        held = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    finally:
        q.stop()
    assert {(r.id1, r.id2) for r in spark.table("met").collect()} == {("a0", "b0"), ("a1", None)}
    assert held == 4  # the four of the second day


def test_stateful_revalidation_equals_the_batch(spark, tmp_path):
    from ledgerloom.plans import invoices
    from ledgerloom.plans.fixtures import LAYOUTS
    from ledgerloom.streaming import stateful

    records = invoices.process(spark.createDataFrame(LAYOUTS[:4], "invoice_id string, text string")).select("invoice_id", F.timestamp_seconds(F.lit(1000)).alias("ts"), "extracted")
    rows = [("3", 2, {"gross_amount": "238,00"}), ("3", 1, {"gross_amount": "1,0"}), ("1", 2, {"service_date": None}), ("4", 1, {"service_date": "2026-03-01"}), ("1", 1, {"service_date": "2026-01-01", "description": "x"}), ("2", 1, {"net_amount": "1,234.5"})]
    patches = spark.createDataFrame(rows, "invoice_id string, seq long, patch map<string,string>").withColumn("ts", F.timestamp_seconds(F.lit(1001)))
    for df, name in ((records, "r"), (patches, "p")):
        df.repartition(3).write.parquet(str(tmp_path / name))
    told = {r.invoice_id: (r.traffic_light, r.extracted) for r in invoices.revalidate(records, patches.select("invoice_id", "seq", "patch"))[0].collect()}
    streams_of = [spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / n)) for df, n in ((records, "r"), (patches, "p"))]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = stateful.revalidated(*streams_of, late="1 minute", keep="1 hour").writeStream.format("memory").queryName("overlay").outputMode("append").start()
        try:
            q.processAllAvailable()
            late = patches.limit(1).select(F.lit("9").alias("invoice_id"), "seq", "patch", F.timestamp_seconds(F.lit(100_000)).alias("ts"))
            for _ in range(2):  # a day later the others are forgotten
                late.coalesce(1).write.mode("append").parquet(str(tmp_path / "p"))
                q.processAllAvailable()
            held = q.lastProgress["stateOperators"][0]["numRowsTotal"]
            got = spark.table("overlay").collect()
        finally:
            q.stop()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    last = {r.invoice_id: (r.traffic_light, r.extracted) for r in got if r.outcome == "decided"}
    assert {k: last[k] for k in told} == told and last["2"][0] == "GREEN"
    assert [r.invoice_id for r in got if r.outcome == "quarantined"] == ["2"]
    assert held <= 4 and "9" not in last  # a patch whose record never came: its field, its timer and the timer's index


def test_windows_on_a_stream_drop_late_events(spark, tmp_path):
    src = str(tmp_path / "ev")
    schema = "ts timestamp, kind string"
    make = lambda *times: spark.createDataFrame([(t, "k") for t in times], "t string, kind string").select(F.to_timestamp("t").alias("ts"), "kind")
    make("2026-01-01 00:05:00", "2026-01-01 00:10:00").coalesce(1).write.parquet(src)
    df = streams.windowed(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src), "ts", "kind", "1 hour", late="10 minutes")
    q = df.writeStream.format("memory").queryName("win").outputMode("append").start()
    try:
        q.processAllAvailable()
        make("2026-01-01 03:00:00").coalesce(1).write.mode("append").parquet(src)
        q.processAllAvailable()
        make("2026-01-01 00:20:00").coalesce(1).write.mode("append").parquet(src)
        q.processAllAvailable()
    finally:
        q.stop()
    assert [(r.window_start.hour, r.n) for r in spark.table("win").collect()] == [(0, 2)]
    batch = make("2026-01-01 00:05:00", "2026-01-01 00:20:00", "2026-01-01 01:20:00")
    assert sorted(r.n for r in streams.sessions(batch, "ts", "kind", "30 minutes").collect()) == [1, 2]
    assert streams.windowed(batch, "ts", "kind", "1 hour", slide="30 minutes").count() == 4
