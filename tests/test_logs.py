import datetime

import pytest
from pyspark.sql import functions as F

from qacorpus.operators import feedback, limits, logs
from qacorpus.plans import log_queries, views
from qacorpus.sources import io

NOW = datetime.datetime(2024, 5, 10, 12, tzinfo=datetime.timezone.utc)


def _log(spark, *rows):
    base = {"czas": "2024-05-10T10:00:00+00:00", "lang": "pl", "sekcja": "konto", "wynik": "odpowiedz", "latencja_s": 5.0, "cache_hit": False, "pytanie": "jak zmienic haslo"}
    import json

    lines = [(json.dumps({k: v for k, v in (base | r).items() if v is not ...}) if isinstance(r, dict) else r, i) for i, r in enumerate(rows)]
    return io.parse_log(spark.createDataFrame(lines, "value string, seq long"))


def test_reader_keeps_mistyped_rows(spark, tmp_path):
    df = _log(spark, {}, "", "not json", "[1]", {"czas": 123}, {"latencja_s": True}, {"cechy": {"rerank_top1": 1, "etap": "x"}})
    rows = df.orderBy("seq").collect()
    assert len(rows) == 4 and rows[1].czas is None and rows[2].latencja_s is None and rows[3].cechy.rerank_top1 == 1.0 and rows[3].cechy.etap is None
    assert io.read_query_log(spark, f"{tmp_path}/none.jsonl").count() == 0
    (tmp_path / "log_analytics.jsonl").write_text('{"id":"b"}\n')
    (tmp_path / "log_analytics.jsonl.przed-resetem-1").write_text('{"id":"a"}\n\n')
    assert sorted(r.id for r in io.read_query_log_with_archives(spark, str(tmp_path)).collect()) == ["a", "b"]


def test_overview_and_latency(spark):
    answered, refused, chat = {}, {"wynik": "odmowa", "sekcja": None}, {"wynik": "rozmowa", "sekcja": None}
    row = logs.overview(_log(spark, *[answered] * 8, *[refused] * 2, *[chat] * 5)).first()
    assert (row.questions, row.accuracy, row.distinct_questions) == (15, 0.8, 1)
    assert logs.overview(_log(spark, chat)).first().accuracy is None
    df = _log(spark, *[{"latencja_s": x} for x in (1, 3, 7, 15, 30)], {"latencja_s": True})
    assert [r.n for r in logs.latency_histogram(df).orderBy("bin").collect()] == [1, 1, 1, 1, 1]
    assert logs.latency_stats(df).first().median == 7
    assert logs.latency_stats(_log(spark, {"latencja_s": None})).first().median == 0


def test_days(spark):
    at = lambda d: {"czas": f"2024-05-{d:02}T10:00:00+00:00"}
    rows = logs.daily_series(_log(spark, at(8), at(10), {"czas": "2024-13-45T00:00:00"}, {"czas": "broken-xx"}, {"czas": 123})).orderBy("day").collect()
    assert [(r.day.day, r.questions, r.truncated) for r in rows] == [(8, 1, False), (9, 0, False), (10, 1, False)]
    long = logs.daily_series(_log(spark, {"czas": "2021-08-15T00:00:00+00:00"}, at(10)))
    assert long.count() == 400 and long.first().truncated
    assert logs.daily_series(_log(spark, {"typ": "ocena"})).count() == 0
    assert logs.filter_log(_log(spark, at(7), at(10)), 1, now=NOW).count() == 1
    sided = _log(spark, {"strona": "kupujacy"}, {}, {"typ": "wysylka"})
    assert logs.filter_log(sided, side="kupujacy").count() == 2 and logs.filter_log(sided, side="nieznana").count() == 2


def test_questions_costs_reasons(spark):
    top = logs.top_questions(_log(spark, {"pytanie": " Ala "}, {"pytanie": "ala"}, {"pytanie": "  "}, {"pytanie": "kot"})).collect()
    assert [(r.question, r.n) for r in top] == [("Ala", 2), ("kot", 1)]
    cost = logs.cost_stats(_log(spark, {"tokeny_we": 10, "tokeny_wy": 5, "koszt_usd": 0.5}, {"cache_hit": True, "tokeny_we": 9, "tokeny_wy": 9, "koszt_usd": 9.0}, {})).first()
    assert (cost.tokens_in, cost.cost_usd, cost.coverage) == (10, 0.5, 0.5)
    assert logs.distribution(_log(spark, {"wynik": "odmowa", "powod": None}), "reasons").first().key == "brak_danych"


def test_rating_cases(spark):
    df = _log(spark, {"id": "1", "wynik": "odmowa", "powod": "prog_rerank"}, {"id": "1", "wynik": "odmowa", "powod": "guard_x"}, {"typ": "ocena", "ocena": "dol", "id_zapytania": "1"}, {"typ": "ocena", "ocena": "dol", "id_zapytania": ...}, {"typ": "ocena", "ocena": "gora", "id_zapytania": "1"}, {"typ": "ocena", "ocena": "dol", "id_zapytania": "9"})
    assert [r.diagnosis for r in feedback.rating_cases(df).orderBy("seq").collect()] == ["guard", "brak_sladu", "ok", "brak_sladu"]


def test_export(spark):
    df = _log(spark, {"pytanie": "=HYPERLINK()", "strona": "x"}, {"pytanie": "+1", "czas": "unread"}, {"typ": "ocena"})
    rows = io.csv_cells(io.export_rows(df, ["pytanie", "czas", "strona", "nope"])).collect()
    assert sorted(map(tuple, rows)) == [("2024-05-10 10:00:00", "nieznana", "'=HYPERLINK()"), ("unread", "nieznana", "'+1")]
    assert io.export_rows(df, []).columns == ["czas", "lang", "strona", "sekcja", "wynik", "powod", "latencja_s", "cache_hit"]


def _limit(times, per_min, per_day):
    kept, out = [], []
    for t in times:
        kept = [x for x in kept if x >= t - 86400]
        ok = len(kept) < per_day and sum(x > t - 60 for x in kept) < per_min
        out.append(ok)
        kept += [t] * ok
    return out


@pytest.mark.parametrize("per_min,per_day", [(2, 5), (10, 3)])
def test_limits(spark, per_min, per_day):
    import random

    rnd = random.Random(1)
    times = sorted(rnd.randrange(0, 200_000) if rnd.random() < 0.3 else 1000 + rnd.randrange(200) for _ in range(80))
    df = spark.createDataFrame([(i, datetime.datetime.fromtimestamp(t, datetime.timezone.utc), k) for k in ("a", None) for i, t in enumerate(times)], "seq long, ts timestamp, ip string")
    got = limits.admit_requests(df, "ip", per_min, per_day).collect()
    for k in ("a", None):
        assert [r.admitted for r in sorted((r for r in got if r.ip == k), key=lambda r: r.seq)] == _limit(times, per_min, per_day)


def test_cooldown_and_tickets(spark):
    at = lambda s: datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc) + datetime.timedelta(seconds=s)
    rows = [(0, at(0), "A@x", "ok", False, "T1"), (1, at(5), "a@X", "ok", False, None), (2, at(700), "a@x", "failed", False, None), (3, at(701), "a@x", "ok", False, None), (4, at(10), "a@x", "partial", True, "T1"), (5, at(11), "a@x", "ok", True, "T1"), (6, at(12), "a@x", "ok", True, "T1"), (7, at(13), "b@x", "ok", True, "T1")]
    df = spark.createDataFrame(rows, "seq long, ts timestamp, email string, outcome string, correction boolean, ticket string")
    cool = {r.seq: r.accepted for r in limits.address_cooldown(df).collect()}
    assert [cool[k] for k in (0, 1, 2, 3)] == [True, False, True, True]
    tickets = {r.seq: r.allowed for r in limits.correction_tickets(df).collect()}
    assert [tickets[k] for k in (4, 5, 6, 7)] == [True, True, False, False]


def test_queries_against_sql(spark, tmp_path):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{sf}/events.parquet'")
    for name in ("a04_overview", "a08_daily", "a09_top_questions", "a15_rating_cases", "a20_gate_signal", "a22_rate_counts"):
        df = log_queries.QUERIES[name](spark, sf)
        found = con.execute(log_queries.SQL[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == sorted(df.columns)
        norm = lambda v: round(v, 6) if isinstance(v, float) else v
        assert sorted(str([norm(r[c]) for c in names]) for r in df.collect()) == sorted(str([norm(x) for x in r]) for r in found.fetchall())
    assert views.log(spark, sf).filter(F.col("typ") == "ocena").count() > 0


def test_all_kinds_of_events(spark):
    out = spark.createDataFrame([(1, "2024-01-01", "i", "pl", "kupujacy", None, "", False, None, 1.23456, None, None, None, "pisz do a@b.pl", None, "sedzia")], "seq long, czas string, id string, lang string, strona string, mode string, section string, has_data boolean, refusal_reason string, latencja_s double, tokeny_we long, tokeny_wy long, koszt_usd double, pytanie string, cache_hit boolean, powod_etap2 string")
    rated = spark.createDataFrame([("2024-01-02", "gora", "i", "pl", "kupujacy", None, "pisz do a@b.pl", "ok a@b.pl")], "czas string, ocena string, id_zapytania string, lang string, strona string, sekcja string, pytanie string, odpowiedz string")
    sent = spark.createDataFrame([("2024-01-03", "pl", "zwrot", "AB12CD34", True, "", "x@y.pl")], "czas string, lang string, kategoria string, ticket string, sukces boolean, blad string, email string")
    rows = {r.typ: r for r in logs.build_log_events(out, rated, sent).collect()}
    q, r, m = rows[None], rows["ocena"], rows["wysylka"]
    assert (q.wynik, q.powod, q.powod_etap2, q.sekcja, q.latencja_s, q.tokeny_we, q.bramki_pominiete, q.tokeny_szacowane, q.cache_hit) == ("odmowa", "brak_wyniku", "sedzia", None, 1.235, 0, [], False, False)
    assert all("a@b.pl" not in x for x in (q.pytanie, r.pytanie, r.odpowiedz)) and r.ocena == "gora" and r.wynik is None
    assert (m.kategoria, m.ticket, m.sukces, m.blad) == ("zwrot", "AB12CD34", True, None) and "email" not in m.asDict()


def test_full_report(spark):
    log = views.log(spark, "/root/testdata/sf0.001")
    report = logs.full_report(log)
    assert set(report) == {"overview", "latency", "histogram", "daily", "top", "ratings", "costs", "range", "sections", "sides", "reasons", "languages"}
    assert report["overview"].collect() == logs.overview(logs.filter_log(log, None, None, None, None)).collect()
    assert sum(r.n for r in report["sides"].collect()) == logs.questions(log).count()


def test_report_in_one_pass_equals_its_parts(spark):
    log = views.log(spark, "/root/testdata/sf0.001")
    seen = []

    def store(df, name):
        seen.append(df._jdf.queryExecution().optimizedPlan().toString().count("Relation"))
        from qacorpus.sources.scratch import stored

        return stored(df, name)

    for rows in (log, log.filter("false"), log.filter("typ is null and wynik = 'rozmowa'")):
        report = logs.full_report(rows, store=store)
        parts = {
            "overview": logs.overview(rows), "latency": logs.latency_stats(rows), "histogram": logs.latency_histogram(rows), "daily": logs.daily_series(rows), "top": logs.top_questions(rows), "ratings": logs.rating_stats(rows),
            "costs": logs.cost_stats(rows), "range": logs.log_range(rows), **{by: logs.distribution(rows, by) for by in ("sections", "sides", "reasons", "languages")},
        }
        for name, want in parts.items():
            assert report[name].columns == want.columns, name
            listed = [[tuple(r) for r in x.collect()] for x in (report[name], want)]
            assert sorted(listed[0], key=repr) == sorted(listed[1], key=repr), name
    assert set(seen) <= {0, 1}  # the log is read once
