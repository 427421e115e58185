"""The analytics report over request-log events: one table of questions, ratings and mails, told apart by `typ`.

`now` is always a parameter. A numeric field holds numbers only: the reader has made other kinds null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lists
from ..functions.text import strip
from ..sources.io import normalize_side
from ..sources.scratch import stored


def questions(df: DataFrame) -> DataFrame:
    return df.filter("typ is null")


def event_time(time: Column) -> Column:
    """ISO text to a time; without an offset it is UTC; null where it can't be read."""
    return F.try_to_timestamp(F.when(time.rlike(r"^\d{4}-\d{2}-\d{2}"), time))


def event_day(time: Column) -> Column:
    return F.try_to_date(F.when(time.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(time, 1, 10)), "yyyy-MM-dd")


def filter_log(df: DataFrame, days: int | None = None, lang: str | None = None, side: str | None = None, now=None) -> DataFrame:
    """Events of a language and a side, no older than so many days before `now`; mails pass the side, and days of 0
    or None keep all."""
    if lang:
        df = df.filter(F.col("lang") == lang)
    if side:
        df = df.filter((F.coalesce("typ", F.lit("")) == "wysylka") | (normalize_side(F.col("strona")) == side))
    if days:
        df = df.filter(event_time(F.col("czas")) >= F.lit(now) - F.make_interval(days=F.lit(days)))
    return df


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(part / whole, 4))


def question_key(text: Column) -> Column:
    return F.lower(strip(text))


def overview(df: DataFrame) -> DataFrame:
    """Counts, accuracy among answered and refused questions, share of cached ones, distinct questions, mails."""
    q = F.col("typ").isNull()
    is_ = lambda v: F.count_if(q & (F.col("wynik") == v))
    mail = F.col("typ") == "wysylka"
    key = question_key(F.col("pytanie"))
    row = df.agg(
        F.count_if(q).alias("questions"), is_("odpowiedz").alias("answers"), is_("odmowa").alias("refusals"), is_("rozmowa").alias("chats"),
        F.count_if(q & F.coalesce("cache_hit", F.lit(False))).alias("cached"), F.count_distinct(F.when(q & (key != ""), key)).alias("distinct_questions"),
        F.count_if(mail).alias("mails"), F.count_if(mail & F.col("sukces")).alias("mails_sent"),
    )
    return row.withColumns({"accuracy": _share(F.col("answers"), F.col("answers") + F.col("refusals")), "cache_share": F.coalesce(_share(F.col("cached"), F.col("questions")), F.lit(0.0))}).drop("cached")


def latency_stats(df: DataFrame) -> DataFrame:
    """Interpolated quantiles and mean of the latency of questions, and medians of cached and other ones; 0 if none."""
    x, hit = F.col("latencja_s"), F.coalesce("cache_hit", F.lit(False))
    q = lambda c, p: F.round(F.coalesce(F.percentile(c, p), F.lit(0.0)), 3)
    return questions(df).agg(
        q(x, 0.5).alias("median"), q(x, 0.9).alias("p90"), q(x, 0.95).alias("p95"), F.round(F.coalesce(F.avg(x), F.lit(0.0)), 3).alias("mean"),
        q(F.when(hit, x), 0.5).alias("median_cached"), q(F.when(~hit, x), 0.5).alias("median_uncached"),
    )


def latency_histogram(df: DataFrame) -> DataFrame:
    """How many questions fall below each edge; every label is there, in order."""
    x = F.col("latencja_s")
    place = reduce(lambda c, k: c.when(x < lists.LATENCY_EDGES[k], k), range(1, 4), F.when(x < lists.LATENCY_EDGES[0], 0)).when(x.isNotNull(), 4)
    counts = questions(df).select(place.alias("bin")).filter("bin is not null").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    labels = df.sparkSession.createDataFrame(list(enumerate(lists.LATENCY_LABELS)), "bin int, label string")
    return labels.join(counts, "bin", "left").select("bin", "label", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def distribution(df: DataFrame, by: str) -> DataFrame:
    """key, n and share, most frequent first, ties by key. by: sections (of answers), sides, reasons (of refusals) or languages."""
    q = questions(df)
    rows = {
        "sections": lambda: q.filter("wynik = 'odpowiedz'").select(F.col("sekcja").alias("key")),
        "sides": lambda: q.select(normalize_side(F.col("strona")).alias("key")),
        "reasons": lambda: q.filter("wynik = 'odmowa'").select(F.coalesce("powod", F.lit("brak_danych")).alias("key")),
        "languages": lambda: q.select(F.coalesce("lang", F.lit("nieznany")).alias("key")),
    }[by]()
    counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.filter("key is not null").select("key", "n", F.round(F.col("n") / total, 4).alias("share"))


def daily_series(df: DataFrame, max_days: int = 400) -> DataFrame:
    """Questions, refusals, median latency and cost of each day from the first to the last, at most the last max_days;
    truncated says whether days were cut off."""
    per_day = (
        questions(df)
        .select(event_day(F.col("czas")).alias("day"), "wynik", "latencja_s", "koszt_usd")
        .filter("day is not null")
        .groupBy("day")
        .agg(F.count(F.lit(1)).alias("questions"), F.count_if(F.col("wynik") == "odmowa").alias("refusals"), F.round(F.percentile("latencja_s", 0.5), 3).alias("median_latency"), F.round(F.sum("koszt_usd"), 6).alias("cost_usd"))
    )
    return _calendar(per_day, max_days)


def _calendar(per_day: DataFrame, max_days: int) -> DataFrame:
    span = per_day.agg(F.min("day").alias("low"), F.max("day").alias("high")).filter("low is not null")
    begin = F.greatest("low", F.date_sub("high", max_days - 1))
    calendar = span.select(F.explode(F.sequence(begin, "high")).alias("day"), (F.date_diff("high", "low") >= max_days).alias("truncated"))
    zero = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    days = calendar.join(per_day, "day", "left")
    return days.select("day", zero("questions", 0), zero("refusals", 0), zero("median_latency", 0.0), zero("cost_usd", 0.0), "truncated")


def top_questions(df: DataFrame, n: int = 15, order: str = "seq") -> DataFrame:
    """The most frequent questions by key, shown as first asked; ties by first appearance."""
    shown = strip(F.col("pytanie"))
    rows = questions(df).select(question_key(F.col("pytanie")).alias("key"), shown.alias("text"), order).filter("key <> ''")
    counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min_by("text", order).alias("question"), F.min(order).alias("first"))
    return counts.orderBy(F.desc("n"), "first").limit(n).select("question", "n")


def rating_stats(df: DataFrame) -> DataFrame:
    rated = F.col("typ") == "ocena"
    answers = F.count_if(F.col("typ").isNull() & (F.col("wynik") == "odpowiedz")).alias("answers")
    row = df.agg(F.count_if(rated & (F.col("ocena") == "gora")).alias("up"), F.count_if(rated & (F.col("ocena") == "dol")).alias("down"), answers)
    total = F.col("up") + F.col("down")
    return row.select("up", "down", total.alias("total"), _share(F.col("up"), total).alias("up_share"), _share(total, F.col("answers")).alias("coverage"))


def cost_stats(df: DataFrame) -> DataFrame:
    """Tokens and cost of questions that weren't cached and have token counts; coverage is their share."""
    rows = questions(df).filter(~F.coalesce("cache_hit", F.lit(False)))
    counted = F.col("tokeny_we").isNotNull() & F.col("tokeny_wy").isNotNull()
    of = lambda c: F.coalesce(F.sum(F.when(counted, F.col(c))), F.lit(0))
    row = rows.agg(F.count(F.lit(1)).alias("requests"), F.count_if(counted).alias("counted"), of("tokeny_we").alias("tokens_in"), of("tokeny_wy").alias("tokens_out"), of("koszt_usd").alias("cost"), F.count_if(counted & F.coalesce("tokeny_szacowane", F.lit(False))).alias("estimated"))
    return _costs(row)


def _costs(row: DataFrame) -> DataFrame:
    return row.select(
        "tokens_in", "tokens_out", F.round("cost", 6).alias("cost_usd"), F.when(F.col("counted") > 0, F.round(F.col("cost") / F.col("counted"), 6)).alias("cost_per_request"),
        _share(F.col("counted"), F.col("requests")).alias("coverage"), "estimated", _share(F.col("estimated"), F.col("counted")).alias("estimated_share"),
    )


def log_range(df: DataFrame, max_days: int = 400) -> DataFrame:
    """First and last time as written, over all events, and how many days a series has."""
    day = F.when(F.col("typ").isNull(), event_day(F.col("czas")))
    row = df.agg(F.min("czas").alias("first"), F.max("czas").alias("last"), F.min(day).alias("a"), F.max(day).alias("b"))
    return _range(row, max_days)


def _range(row: DataFrame, max_days: int) -> DataFrame:
    n = F.coalesce(F.date_diff("b", "a") + 1, F.lit(0))
    return row.select("first", "last", F.least(n, F.lit(max_days)).alias("days"), (n > max_days).alias("truncated"))


def report_cells(df: DataFrame, order: str = "seq") -> DataFrame:
    """(part, key, ...): what every part of the report needs of the events, in one pass. Each event goes to the cells it
    counts in, and one aggregate, summed before its shuffle, makes a row of a cell."""
    q, hit, x = F.col("typ").isNull(), F.coalesce("cache_hit", F.lit(False)), F.col("latencja_s")
    day = event_day(F.col("czas"))
    known = F.coalesce(q & day.isNotNull(), F.lit(False))
    counted = F.col("tokeny_we").isNotNull() & F.col("tokeny_wy").isNotNull()
    spent = q & ~hit
    edges = reduce(lambda c, k: c.when(x < lists.LATENCY_EDGES[k], k), range(1, 4), F.when(x < lists.LATENCY_EDGES[0], 0)).when(x.isNotNull(), 4)
    is_ = lambda v: q & (F.col("wynik") == v)
    mail, rated = F.col("typ") == "wysylka", F.col("typ") == "ocena"
    question = question_key(F.col("pytanie"))
    cell = lambda part, when, key: F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(part).alias("part"), (F.lit(key) if isinstance(key, str) else key.cast("string")).alias("key")))
    cells = F.array_compact(F.array(
        cell("overview", q, "questions"), cell("overview", is_("odpowiedz"), "answers"), cell("overview", is_("odmowa"), "refusals"), cell("overview", is_("rozmowa"), "chats"), cell("overview", q & hit, "cached"),
        cell("overview", mail, "mails"), cell("overview", mail & F.col("sukces"), "mails_sent"),
        cell("latency", q, "all"), cell("latency", q & hit, "cached"), cell("latency", q & ~hit, "uncached"), cell("histogram", q & x.isNotNull(), edges),
        cell("sections", is_("odpowiedz"), F.col("sekcja")), cell("sides", q, normalize_side(F.col("strona"))), cell("reasons", is_("odmowa"), F.coalesce("powod", F.lit("brak_danych"))), cell("languages", q, F.coalesce("lang", F.lit("nieznany"))),
        cell("daily", known, day), cell("top", q & (question != ""), question), cell("ratings", rated & (F.col("ocena") == "gora"), "up"), cell("ratings", rated & (F.col("ocena") == "dol"), "down"),
        cell("costs", spent, "requests"), cell("costs", spent & counted, "counted"), cell("costs", spent & counted & F.coalesce("tokeny_szacowane", F.lit(False)), "estimated"),
        cell("range", F.lit(True), "events"), cell("range", known, "days"),
    ))
    rows = df.withColumn("day", day).select(order, "czas", "day", "wynik", "latencja_s", "koszt_usd", "tokeny_we", "tokeny_wy", strip(F.col("pytanie")).alias("text"), F.explode(cells).alias("cell"))
    timed = F.when(F.col("cell.part").isin("latency", "daily"), x)
    return rows.groupBy(F.col("cell.part").alias("part"), F.col("cell.key").alias("key")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("wynik") == "odmowa").alias("refusals"), F.percentile(timed, F.array(F.lit(0.5), F.lit(0.9), F.lit(0.95))).alias("p"), F.avg(timed).alias("mean"),
        F.sum("koszt_usd").alias("cost"), F.sum("tokeny_we").alias("tokens_in"), F.sum("tokeny_wy").alias("tokens_out"), F.min("czas").alias("first"), F.max("czas").alias("last"),
        F.min("day").alias("low"), F.max("day").alias("high"), F.min_by(F.when(F.col("cell.part") == "top", F.col("text")), order).alias("text"), F.min(order).alias("at"),
    )


def full_report(df: DataFrame, days: int | None = None, lang: str | None = None, side: str | None = None, now=None, top: int = 15, max_days: int = 400, store=stored) -> dict[str, DataFrame]:
    """All parts of the report over the filtered events, as overview() to log_range() and distribution() give them; df is
    read once, and the parts come from the stored cells of report_cells()."""
    cells = store(report_cells(filter_log(df, days, lang, side, now)), "report")
    of = lambda part: cells.filter(F.col("part") == part)
    n = lambda key: F.coalesce(F.sum(F.when(F.col("key") == key, F.col("n"))), F.lit(0))
    at = lambda key, c: F.max(F.when(F.col("key") == key, c))
    sums = of("overview").agg(*[n(k).alias(k) for k in ("questions", "answers", "refusals", "chats", "cached", "mails", "mails_sent")])
    distinct = of("top").agg(F.count(F.lit(1))).scalar()
    share = F.coalesce(_share(F.col("cached"), F.col("questions")), F.lit(0.0))
    parts = {"overview": sums.select("questions", "answers", "refusals", "chats", distinct.alias("distinct_questions"), "mails", "mails_sent", _share(F.col("answers"), F.col("answers") + F.col("refusals")).alias("accuracy"), share.alias("cache_share"))}
    timed = lambda key, k, name: F.round(F.coalesce(at(key, F.col("p")[k]), F.lit(0.0)), 3).alias(name)
    parts["latency"] = of("latency").agg(timed("all", 0, "median"), timed("all", 1, "p90"), timed("all", 2, "p95"), F.round(F.coalesce(at("all", F.col("mean")), F.lit(0.0)), 3).alias("mean"), timed("cached", 0, "median_cached"), timed("uncached", 0, "median_uncached"))
    labels = df.sparkSession.createDataFrame(list(enumerate(lists.LATENCY_LABELS)), "bin int, label string")
    parts["histogram"] = labels.join(of("histogram").select(F.col("key").cast("int").alias("bin"), "n"), "bin", "left").select("bin", "label", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    per_day = of("daily").select(F.col("key").cast("date").alias("day"), F.col("n").alias("questions"), "refusals", F.round(F.col("p")[0], 3).alias("median_latency"), F.round("cost", 6).alias("cost_usd"))
    parts["daily"] = _calendar(per_day, max_days)
    parts["top"] = of("top").orderBy(F.desc("n"), "at").limit(top).select(F.col("text").alias("question"), "n")
    rated = of("ratings").agg(n("up").alias("up"), n("down").alias("down")).withColumn("total", F.col("up") + F.col("down"))
    parts["ratings"] = rated.select("up", "down", "total", _share(F.col("up"), F.col("total")).alias("up_share"), _share(F.col("total"), of("overview").agg(n("answers")).scalar()).alias("coverage"))
    spent = of("costs").agg(n("requests").alias("requests"), n("counted").alias("counted"), n("estimated").alias("estimated"), *[F.coalesce(at("counted", F.col(c)), F.lit(0)).alias(c) for c in ("tokens_in", "tokens_out", "cost")])
    parts["costs"] = _costs(spent)
    span = of("range").agg(at("events", F.col("first")).alias("first"), at("events", F.col("last")).alias("last"), at("days", F.col("low")).alias("a"), at("days", F.col("high")).alias("b"))
    parts["range"] = _range(span, max_days)
    for by in ("sections", "sides", "reasons", "languages"):
        parts[by] = of(by).filter("key is not null").select("key", "n", F.round(F.col("n") / of(by).agg(F.sum("n")).scalar(), 4).alias("share"))
    return parts


def outcome(df: DataFrame) -> DataFrame:
    """wynik and powod from mode, section and refusal_reason; has_data false: nothing came back."""
    wynik = F.when(F.col("mode") == "rozmowa", "rozmowa").when(F.coalesce("section", F.lit("")) != "", "odpowiedz").otherwise("odmowa")
    reason = F.when(~F.coalesce("has_data", F.lit(False)), "brak_wyniku").when(wynik == "odmowa", F.coalesce(F.nullif("refusal_reason", F.lit("")), F.lit("odmowa"))).otherwise(wynik)
    return df.withColumns({"wynik": wynik, "powod": reason})


def request_cost(calls: DataFrame, prices: DataFrame, default: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """Tokens, cost and calls of each request; calls (request_id, model, tokens_in, tokens_out, messages, text).

    A call without both counts is estimated from its messages and text; models without a price (model, usd_in,
    usd_out) have the default one. Prices are a small dimension table: Spark broadcasts it as long as it is small.
    """
    from ..functions.text import estimate_tokens

    told = F.col("tokens_in").isNotNull() & F.col("tokens_out").isNotNull()
    sent = F.aggregate(F.coalesce("messages", F.array().cast("array<string>")), F.lit(0).cast("long"), lambda a, m: a + estimate_tokens(m))
    rows = calls.join(prices, "model", "left").select(
        "request_id",
        F.when(told, F.col("tokens_in")).otherwise(sent).alias("i"),
        F.when(told, F.col("tokens_out")).otherwise(estimate_tokens(F.col("text"))).alias("o"),
        F.coalesce("usd_in", F.lit(default[0])).alias("pi"),
        F.coalesce("usd_out", F.lit(default[1])).alias("po"),
        (~told).alias("guessed"),
    )
    cost = F.sum(F.col("i") / 1e6 * F.col("pi") + F.col("o") / 1e6 * F.col("po"))
    return rows.groupBy("request_id").agg(F.sum("i").alias("tokens_in"), F.sum("o").alias("tokens_out"), F.round(cost, 6).alias("cost_usd"), F.count(F.lit(1)).alias("calls"), F.bool_or("guessed").alias("estimated"))


def repeat_requests(df: DataFrame) -> DataFrame:
    """Adds hit: whether a reusable request's key was stored by an earlier one.

    Columns: ts, key parts lang, question_key, stamp, side; standalone; wynik, powod. Stored are standalone requests that
    were answered or refused for their rerank score.
    """
    storable = F.col("standalone") & ((F.col("wynik") == "odpowiedz") | ((F.col("wynik") == "odmowa") & (F.col("powod") == "prog_rerank")))
    earlier = Window.partitionBy("lang", "question_key", "stamp", "side").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.max(storable.cast("int")).over(earlier), F.lit(0)) == 1
    return df.withColumn("hit", F.col("standalone") & seen)


def skipped_gate_signal(df: DataFrame, key: list[str], window: int = 50, threshold: float = 0.2) -> DataFrame:
    """Adds share, active and alert to requests that weren't cached: the share of the last `window` of a key, in order
    of seq, that skipped a gate; judged once there are so many. alert marks where it becomes active."""
    rows = questions(df).filter(~F.coalesce("cache_hit", F.lit(False)))
    order = Window.partitionBy(*key).orderBy("seq")
    last = order.rowsBetween(-(window - 1), 0)
    skipped = (F.coalesce(F.size("bramki_pominiete"), F.lit(0)) > 0).cast("double")
    rows = rows.withColumns({"n": F.count(F.lit(1)).over(last), "share": F.avg(skipped).over(last)})
    rows = rows.withColumn("active", (F.col("n") == window) & (F.col("share") > threshold))
    return rows.withColumn("alert", F.col("active") & ~F.coalesce(F.lag("active").over(order), F.lit(False))).drop("n")


def build_log_events(outcomes: DataFrame, ratings: DataFrame | None = None, mails: DataFrame | None = None) -> DataFrame:
    """Rows of the log: one for each outcome, then those of ratings and mails where they are given.

    Questions and answers are without personal data, latency has 3 places, missing counts are 0 and missing skipped
    gates none. Columns that outcomes may lack: powod_etap2, bramki_pominiete, tokeny_szacowane and cechy. ratings have
    czas, ocena, id_zapytania, lang, strona, sekcja, pytanie and odpowiedz; mails have czas, lang, kategoria, ticket,
    sukces and blad, of which an empty one is null; their address and body aren't read.
    """
    from ..functions.text import redact_pii

    rows = outcome(outcomes)
    given = lambda c, kind: F.col(c) if c in rows.columns else F.lit(None).cast(kind)
    events = rows.select(
        "seq", F.lit(None).cast("string").alias("typ"), "czas", "id", "lang", "strona", F.nullif("section", F.lit("")).alias("sekcja"), "wynik", "powod", F.round("latencja_s", 3).alias("latencja_s"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tokeny_we", "tokeny_wy", "koszt_usd")], redact_pii(F.col("pytanie")).alias("pytanie"), F.coalesce("cache_hit", F.lit(False)).alias("cache_hit"),
        given("powod_etap2", "string").alias("powod_etap2"), F.coalesce(given("bramki_pominiete", "array<string>"), F.array().cast("array<string>")).alias("bramki_pominiete"),
        F.coalesce(given("tokeny_szacowane", "boolean"), F.lit(False)).alias("tokeny_szacowane"), *([F.col("cechy")] if "cechy" in rows.columns else []),
    )
    if ratings is not None:
        clean = [redact_pii(F.col(c)).alias(c) for c in ("pytanie", "odpowiedz")]
        events = events.unionByName(ratings.select(F.lit("ocena").alias("typ"), "czas", "ocena", "id_zapytania", "lang", "strona", "sekcja", *clean), allowMissingColumns=True)
    if mails is not None:
        events = events.unionByName(mails.select(F.lit("wysylka").alias("typ"), "czas", "lang", "kategoria", "ticket", "sukces", F.nullif("blad", F.lit("")).alias("blad")), allowMissingColumns=True)
    return events


def validate_events(df: DataFrame) -> DataFrame:
    """Adds rejected: the first field of an event that breaks its rule, or null."""
    email = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
    rules = [
        ("ocena", ~F.col("ocena").isin("gora", "dol")),
        ("pytanie", ~F.length("pytanie").between(1, 1000)),
        ("id_zapytania", ~F.col("id_zapytania").rlike("^[0-9a-f]{16}$")),
        ("ticket", ~F.col("ticket").rlike("^[0-9A-F]{8}$")),
        ("email", ~F.col("email").rlike(email)),
        ("lang", ~F.col("lang").isin(*lists.GUARD_MESSAGES)),
        ("strona", ~F.col("strona").isin(*lists.SIDES)),
        ("role", ~F.col("role").isin("user", "assistant")),
        ("history", F.size("history") > 100),
    ]
    there = [(n, broken) for n, broken in rules if n in df.columns]
    return df.withColumn("rejected", F.coalesce(*[F.when(broken, n) for n, broken in there]))


def client_ip(forwarded: Column, host: Column) -> Column:
    """The last address of the header, or the host where the header is missing or empty."""
    return F.when(F.coalesce(forwarded, F.lit("")) == "", host).otherwise(F.trim(F.element_at(F.split(forwarded, ","), -1)))
