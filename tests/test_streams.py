import datetime
import json

from pyspark.sql import functions as F

from qacorpus.operators import limits
from qacorpus.plans import corpus_queries
from qacorpus.streaming import streams as W

SF = "/root/testdata/sf0.001"


def test_live_admission_equals_batch(spark):
    live = corpus_queries.QUERIES["w04_admit"](spark, SF)
    from qacorpus.plans import views

    batch = limits.admit_requests(views.log(spark, SF), "user_id", 2, 40)
    assert sorted((r.key, r.seq, r.admitted) for r in live.collect()) == sorted((str(r.user_id), r.seq, r.admitted) for r in batch.collect())


def test_ratings_join_over_files(spark, tmp_path):
    at = lambda h: (datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)).isoformat() + "+00:00"
    (tmp_path / "in").mkdir()
    rows = [[{"id": "1", "czas": at(0), "wynik": "odmowa"}], [{"typ": "ocena", "id_zapytania": "1", "ocena": "dol", "czas": at(1)}, {"typ": "ocena", "id_zapytania": "9", "ocena": "dol", "czas": at(1)}], [{"id": "3", "czas": at(900)}, {"typ": "ocena", "id_zapytania": "3", "ocena": "gora", "czas": at(901)}]]
    for k, part in enumerate(rows):
        (tmp_path / "in" / f"{k}.jsonl").write_text("\n".join(json.dumps(r) for r in part))
    out = W.stream_rating_cases(W.stream_log(spark, str(tmp_path / "in"), 1)).select("id_zapytania", "ocena", "found", "wynik")
    out.writeStream.format("memory").queryName("rated").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination()
    got = {r.id_zapytania: r.found for r in spark.sql("select * from rated").collect()}
    assert got["1"] is True and got.get("9") is False


def test_live_tickets_equal_batch(spark):
    from qacorpus.plans import log_queries, views

    live = corpus_queries.QUERIES["w05_tickets"](spark, SF)
    batch = limits.correction_tickets(log_queries.mails(views.log(spark, SF)))
    assert sorted((r.seq, r.allowed) for r in live.collect()) == sorted((r.seq, r.allowed) for r in batch.select("seq", "allowed").collect())


def test_tickets_over_batches_and_late_mails(spark, tmp_path):
    """A ticket's state lasts from one micro-batch to the next; a mail behind the watermark is dropped; two days later the
    state is gone."""
    at = lambda h: (datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)).isoformat()
    mail = lambda seq, h, outcome="ok", correction=False, email="A@x", ticket="T1": {"seq": seq, "ts": at(h), "email": email, "outcome": outcome, "correction": correction, "ticket": ticket}
    files = [
        [mail(1, 1), mail(2, 2, "failed", True), mail(3, 2, "partial", True, "a@X")],
        [mail(4, 3, "ok", True, "b@x"), mail(5, 4, "ok", True), mail(6, 5, "ok", True)],
        [mail(7, 30, ticket="T2")],
        [mail(9, 31, "ok", True, ticket="T2")],
        [mail(8, 6, "ok", True), mail(10, 200, ticket="T3")],
        [mail(11, 201, "ok", True, ticket="T2")],
    ]
    (tmp_path / "in").mkdir()
    for k, rows in enumerate(files):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps(r) for r in rows))
        import os

        os.utime(tmp_path / "in" / f"{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))
    stream = spark.readStream.schema("seq long, ts timestamp, email string, outcome string, correction boolean, ticket string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    W.stream_tickets(stream).writeStream.format("memory").queryName("tickets").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination()
    got = {r.seq: r.allowed for r in spark.sql("select * from tickets").collect()}
    assert got == {1: None, 2: True, 3: True, 4: False, 5: True, 6: False, 7: None, 9: True, 10: None, 11: False}


def test_dedup(spark):
    assert corpus_queries.QUERIES["w08_dedup"](spark, SF).first().n == spark.read.parquet(f"{SF}/events.parquet").select((F.col("user_id") * 1000 + F.unix_micros(F.col("ts").cast("timestamp")) % 1000).alias("h")).distinct().count()
