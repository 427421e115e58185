from collections import Counter, defaultdict

from pyspark.sql import functions as F

from qacorpus.llm import line_dedup as L


def _brute(rows, ratio, least):
    by_site = defaultdict(list)
    for site, text in rows:
        by_site[site or ""].append(text)
    often = {}
    for site, texts in by_site.items():
        count = Counter(x for t in texts if t is not None for x in {y.strip() for y in t.split("\n")} if x)
        often[site] = {x for x, c in count.items() if c >= least and c > ratio * len(texts)}
    return ["\n".join(x for x in t.split("\n") if x.strip() not in often[s or ""]) if t is not None else None for s, t in rows]


def test_against_brute_force(spark):
    rows = []
    for i in range(60):
        site = ["a", "b", None][i % 3 if i < 45 else 0]
        lines = ["menu", f"  text {i} ", "", f"shared {i % 4}", "menu "] + (["foot"] if i % 7 == 0 else [])
        rows.append((site, "\n".join(lines)))
    rows += [("a", None), ("c", ""), ("c", "menu"), ("c", "menu"), ("d", "menu\nmenu"), ("e", "x\n" * 3000 + "menu")]
    df = spark.createDataFrame([(i, s, t, "clash") for i, (s, t) in enumerate(rows)], "doc_id long, source string, text string, often string").repartition(3)
    got = L.drop_lines(df, "source", ratio=0.2, least=3)
    assert got.columns == ["doc_id", "source", "text", "often", "n_lines", "n_dropped"]
    want = _brute(rows, 0.2, 3)
    by_id = {r.doc_id: r for r in got.collect()}
    assert [by_id[i].text for i in range(len(rows))] == want
    assert by_id[0].n_lines - by_id[0].n_dropped == len(want[0].split("\n")) and by_id[60].n_lines == 0
    assert L.drop_lines(df.filter("false"), "source").count() == 0


def test_copies_count_once(spark):
    rows = [("a", f"menu\nown {i}\n") for i in range(4)] + [("a", "long copy\nof two lines")] * 4 + [("b", "long copy\nof two lines")] + [("a", None)] * 2 + [("b", "x"), ("b", " x"), ("b", "x ")]
    df = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(rows)], "doc_id long, source string, text string").repartition(3)
    got = {r.doc_id: r.text for r in L.drop_lines(df, "source", ratio=0.5, least=3, copies_once=True).collect()}
    assert [got[i] for i in range(len(rows))] == [f"own {i}\n" for i in range(4)] + ["long copy\nof two lines"] * 5 + [None] * 2 + [""] * 3


def test_pages(spark):
    html = "<html><head><title>t</title></head><body><nav><ul><li>Home</li></ul></nav><!-- x --><p>One <b>two</b>\n three<script>var a='<p>';</script></p><br>end</body></html>"
    df = spark.createDataFrame([("HTTP://u@WWW.x.Org:80/a", html), ("/no", None)], "url string, html string")
    got = df.select(L.host(F.col("url")).alias("h"), L.page_lines(F.col("html")).alias("t")).collect()
    assert [r.h for r in got] == ["www.x.org", ""]
    assert [x for x in got[0].t.split("\n") if x] == ["Home", "One two", "three", "end"] and got[1].t is None


def test_hot_sites_are_spread(spark):
    """A site with half of all rows and no line in common, copies of one text, and null texts: no task gets them all."""
    rows = []
    for i in range(8000):
        site = "hot" if i % 2 else ("copies" if i % 4 == 0 else f"site {i % 97}")
        rows.append((i, site, {"hot": f"own {i}", "copies": None if i % 8 else "menu\nsame"}.get(site, f"menu\nown {i}")))
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(16)
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        for k, v in zip(before, ("false", "-1", "16")):
            spark.conf.set(k, v)
        for once in (False, True):
            got = L.drop_lines(df, "source", copies_once=once)
            sizes = sorted(len(p) for p in got.select("doc_id").rdd.glom().collect())
            assert sum(sizes) == 8000 and sizes[-1] < 3 * sizes[len(sizes) // 2]
            texts = {r.doc_id: r.text for r in got.collect()}
            assert [texts[i] for i, _, _ in rows] == [t for t in _brute([(s, t) for _, s, t in rows], 0.05, 3)] if not once else texts[1] == "own 1"
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
