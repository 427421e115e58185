"""A log-odds classifier of forum questions: classes, folds, weights, calibration, baselines, audit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_question, sha1_mod
from ..sources.scratch import stored
from .bm25 import Store
from .lexstats import lemma_sets
from .ranks import nearest_rank_quantiles, running
from .retrieval import knn_out_of_fold


def same_frame(df: DataFrame, name: str) -> DataFrame:
    """What stores nothing."""
    return df


GRID = [p / 100 for p in range(10, 95, 5)]


def assign_class(questions: DataFrame, boards: DataFrame, urls: DataFrame | None = None) -> DataFrame:
    """Adds class and side by board, and the class's url; both tables are small."""
    rows = questions.join(boards.select("board", "class", "side"), "board", "left")
    return rows if urls is None else rows.join(urls, "class", "left")


def assign_fold(question: Column, learn: int = 70, calibrate: int = 85) -> Column:
    place = sha1_mod(normalize_question(question), 100)
    return F.when(place < learn, "uczenie").when(place < calibrate, "kalibracja").otherwise("test")


def nearest_rank_quantile(df: DataFrame, column: str, q: float, by: list[str] | None = None, store: Store = stored) -> DataFrame:
    """The value at place round(q (n - 1)), halves to even, of the sorted ones of each group."""
    return nearest_rank_quantiles(df, column, [q], by, store).drop("q")


def inventory(questions: DataFrame, lang: str | None = None, table: DataFrame | None = None, store: Store = stored) -> dict[str, DataFrame]:
    """Counts by source, board, side, year and fold with their shares, how complete the forum's rows are, and lengths:
    (measure, p05, median, p95) of the questions in characters and in distinct lemmas, by nearest rank; 0 without rows."""
    rows = questions.withColumns({"year": F.substring("data", 1, 4), "fold": assign_fold(F.col("pytanie"))})
    total = rows.agg(F.count(F.lit(1))).scalar()
    count = lambda c: rows.groupBy(F.col(c).alias("key")).agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.round(F.col("n") / total, 4))
    filled = lambda c: F.avg((F.coalesce(c, F.lit("")) != "").cast("double"))
    forum = rows.filter("zrodlo = 'forum'").agg(filled("board").alias("board"), filled("url").alias("url"))
    numbered = store(questions.select(F.monotonically_increasing_id().alias("_row"), F.coalesce("pytanie", F.lit("")).alias("pytanie"), *([] if lang is None else [lang])), "questions")
    lemmas = numbered.select("_row").join(lemma_sets(numbered, ["_row"], "pytanie", lang, table).groupBy("_row").agg(F.count(F.lit(1)).alias("n")), "_row", "left")
    sizes = numbered.select(F.lit("chars").alias("measure"), F.length("pytanie").cast("long").alias("value")).unionByName(lemmas.select(F.lit("lemmas").alias("measure"), F.coalesce("n", F.lit(0)).alias("value")))
    found = nearest_rank_quantiles(sizes, "value", [0.05, 0.5, 0.95], ["measure"], store)
    pick = lambda q, name: F.coalesce(F.max(F.when(F.col("q") == q, F.col("value"))), F.lit(0)).alias(name)
    measures = questions.sparkSession.createDataFrame([("chars",), ("lemmas",)], "measure string")
    lengths = measures.join(found, "measure", "left").groupBy("measure").agg(pick(0.05, "p05"), pick(0.5, "median"), pick(0.95, "p95"))
    return {c: count(c) for c in ("zrodlo", "board", "strona", "year", "fold")} | {"complete": forum.withColumn("ok", (F.col("board") >= 0.99) & (F.col("url") >= 0.99)), "lengths": lengths}


def train_weights(df: DataFrame, alpha0: float = 500.0, df_min: int = 20, per_class: int | None = 200, text: str = "text", label: str = "class", lang: str | None = None, table: DataFrame | None = None, store: Store = same_frame) -> DataFrame:
    """(class, lemma, z): for each class the per_class lemmas (None: all, without a ranking) with the largest log-odds
    scores against all other classes, the first by name of equal ones.

    Counts are of questions (query_id, ...) that have the lemma; store(df, name) writes them once, so that texts are split
    once. The prior of a lemma is alpha0 times its share of all questions that have it; classes are few, so the grid of
    lemmas and classes is an array of each lemma. table (lang, form, lemma) gives lemmas by a column of languages.
    """
    rows = df.filter(F.col(label).isNotNull()).withColumns({"_class": F.col(label), "_row": F.monotonically_increasing_id()})
    found = lemma_sets(rows, ["_row", "_class"], text, lang, table)
    counts = store(found.groupBy("lemma", F.col("_class").alias("class")).agg(F.count(F.lit(1)).alias("y")), "counts")
    often = counts.groupBy("lemma").agg(F.sum("y").alias("df"), F.map_from_entries(F.collect_list(F.struct("class", "y"))).alias("by_class")).filter(F.col("df") >= df_min)
    sizes = often.select(F.explode("by_class").alias("class", "y")).groupBy("class").agg(F.sum("y").alias("n"))
    listed = sizes.agg(F.collect_list(F.struct("class", "n")).alias("classes"), F.sum("n").alias("whole"))
    grid = often.crossJoin(F.broadcast(listed)).select("lemma", "df", "by_class", "whole", F.explode("classes").alias("c"))  # listed is one row
    a = F.lit(alpha0) * F.col("df") / F.col("whole")
    y = F.coalesce(F.element_at("by_class", F.col("c.class")), F.lit(0))
    rest, n, m = F.col("df") - y, F.col("c.n"), F.col("whole") - F.col("c.n")
    odds = lambda y, n: F.log((y + a) / F.greatest(n + alpha0 - y - a, F.lit(1e-9)))
    z = (odds(y, n) - odds(rest, m)) / F.sqrt(1 / (y + a) + 1 / (rest + a))
    scored = grid.select(F.col("c.class").alias("class"), "lemma", z.alias("raw"))
    if per_class is None:
        return scored.select("class", "lemma", F.round("raw", 4).alias("z"))
    best = Window.partitionBy("class").orderBy(F.desc(F.round(F.abs("raw"), 9)), "lemma")
    return scored.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= per_class).select("class", "lemma", F.round("raw", 4).alias("z"))


def classify(df: DataFrame, weights: DataFrame, key: str = "query_id", text: str = "text", lang: str | None = None, table: DataFrame | None = None, store: Store = same_frame) -> DataFrame:
    """key, class, score and margin: the class whose weights of the question's lemmas sum highest, the greater name of
    equals, and how far it is above the next. Weights that are stored (store) are made once; where they are small they
    meet the lemmas without a shuffle, else by one."""
    weights = store(weights, "weights")
    classes = weights.agg(F.array_sort(F.collect_set("class"))).first()[0]
    words = lemma_sets(df, [key], text, lang, table)
    sums = words.join(weights, "lemma").groupBy(key, "class").agg(F.sum("z").alias("score"))
    by_class = sums.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("class", "score"))).alias("m"))
    named = F.array(*[F.lit(c) for c in classes]) if classes else F.array().cast("array<string>")
    rows = df.select(key).join(by_class, key, "left").withColumn("classes", named)
    scored = F.transform("classes", lambda c: F.struct(F.round(F.coalesce(F.element_at("m", c), F.lit(0.0)), 9).alias("score"), c.alias("class")))
    order = F.sort_array(scored, asc=False)
    return rows.withColumn("o", order).select(key, F.get("o", F.lit(0))["class"].alias("class"), F.get("o", F.lit(0))["score"].alias("score"), F.round(F.get("o", F.lit(0))["score"] - F.coalesce(F.get("o", F.lit(1))["score"], F.lit(0.0)), 9).alias("margin"))


def percentile_rank_in(df: DataFrame, reference: DataFrame, column: str, name: str, store: Store = stored) -> DataFrame:
    """Adds name: the share of reference values that are at most the row's; null for a null value or without reference.

    Distinct values of both are ranked together, in ranges that are counted and offset.
    """
    counts = reference.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    points = df.filter(F.col(column).isNotNull()).select(F.col(column).alias("v")).distinct().withColumn("n", F.lit(0).cast("long"))
    steps = running(counts.union(points).groupBy("v").agg(F.sum("n").alias("n")), "v", store=store)
    ranks = steps.select("v", F.when(F.col("total") > 0, F.col("upto") / F.col("total")).alias(name))
    return df.join(ranks, df[column] == ranks.v, "left").drop("v")


def confidence(points: DataFrame, calibration: DataFrame) -> DataFrame:
    """Adds confidence: the lower of the ranks of score and margin among calibration points."""
    rows = percentile_rank_in(percentile_rank_in(points, calibration, "score", "score_rank"), calibration, "margin", "margin_rank")
    return rows.withColumn("confidence", F.least("score_rank", "margin_rank"))


def precision_at_coverage(points: DataFrame, coverage: float = 0.30, key: str = "query_id") -> DataFrame:
    """One row: of the most confident share of points (confidence, right) how many there are and how many are right."""
    n = points.count()
    top = points.orderBy(F.desc("confidence"), key).limit(max(1, round(coverage * n)))
    return top.agg(F.count(F.lit(1)).alias("covered"), F.count_if("right").alias("right")).select(F.round(F.col("covered") / n, 4).alias("coverage"), F.round(F.col("right") / F.col("covered"), 4).alias("precision"), "covered", "right")


def thresholds(calibration: DataFrame, store: Store = stored) -> DataFrame:
    """(score_p, margin_p, tau_score, tau_margin): the grid of 17 x 17 nearest-rank percentiles of calibration points."""
    steps = calibration.sparkSession.createDataFrame([(p, round(100 * p)) for p in GRID], "q double, p int")
    def of(column: str) -> DataFrame:
        found = steps.join(nearest_rank_quantiles(calibration, column, GRID, store=store), "q", "left")
        return found.select(F.col("p").alias(f"{column}_p"), F.coalesce("value", F.lit(0.0)).alias(f"tau_{column}"))

    both = store(of("score"), "taus").withColumn("one", F.lit(1)).join(store(of("margin"), "taus").withColumn("one", F.lit(1)), "one")  # 17 rows each
    return both.select("score_p", "margin_p", "tau_score", "tau_margin")


def threshold_grid(points: DataFrame, grid: DataFrame) -> DataFrame:
    """The grid with coverage, precision and covered of points (score, margin, right).

    A point falls to one cell: how many thresholds its score and its margin reach. Of these at most 18 x 18 counts, sums
    from the greatest cell down, along both sides, give every pair of thresholds. A null value reaches none.
    """
    steps = {c: sorted({(r[0], r[1]) for r in grid.select(f"{c}_p", f"tau_{c}").collect()}) for c in ("score", "margin")}  # of 289 rows
    reached = lambda c, t: F.when(F.col(c) >= t, 1).otherwise(0)
    cell = lambda c: reduce(lambda a, x: a + reached(c, x[1]), steps[c], F.lit(0))
    cells = points.groupBy(cell("score").alias("i"), cell("margin").alias("j")).agg(F.count(F.lit(1)).alias("n"), F.count_if("right").alias("hits"))
    spread = points.sparkSession.range(18 * 18).select(F.floor(F.col("id") / 18).cast("int").alias("i"), (F.col("id") % 18).cast("int").alias("j"))
    full = spread.join(cells, ["i", "j"], "left").fillna(0, ["n", "hits"])
    for one, other in (("i", "j"), ("j", "i")):
        down = Window.partitionBy(one).orderBy(F.desc(other))
        full = full.withColumns({"n": F.sum("n").over(down), "hits": F.sum("hits").over(down)})
    at = lambda c: F.array_position(F.array(*[F.lit(p) for p, _ in steps[c]]), F.col(f"{c}_p")).cast("int")
    total = full.filter("i = 0 and j = 0").select("n").scalar()
    covered = full.select("i", "j", F.col("n").alias("covered"), "hits")
    rows = grid.withColumns({"i": at("score"), "j": at("margin"), "total": total}).filter("total > 0").join(covered, ["i", "j"])
    return rows.select("score_p", "margin_p", "tau_score", "tau_margin", F.round(F.col("covered") / F.col("total"), 4).alias("coverage"), F.when(F.col("covered") > 0, F.round(F.col("hits") / F.col("covered"), 4)).otherwise(0.0).alias("precision"), "covered")


def envelope(grid: DataFrame) -> DataFrame:
    """Of a grid of 289 rows, by falling coverage, those with a better precision than all before."""
    before = F.max("precision").over(Window.orderBy(F.desc("coverage"), F.desc("precision"), "score_p", "margin_p").rowsBetween(Window.unboundedPreceding, -1))
    return grid.withColumn("before", before).filter(F.col("before").isNull() | (F.col("precision") > F.col("before"))).drop("before")


def gate_sweep(calibration: DataFrame, test: DataFrame, ood: DataFrame, golden: DataFrame) -> DataFrame:
    """The grid of calibration thresholds with what the points of each set give there, and which gates hold.

    chosen marks the row to use: among rows where all gates hold that with the largest coverage, then precision; else
    among precise ones, else the most precise. The test set is reported and decides nothing.
    """
    grid = thresholds(calibration)
    key = ["score_p", "margin_p"]
    share = lambda points, name: threshold_grid(points.withColumn("right", F.lit(False)), grid).select(*key, F.col("coverage").alias(name))
    tested = threshold_grid(test, grid).select(*key, F.col("coverage").alias("test_coverage"), F.col("precision").alias("test_precision"))
    rows = threshold_grid(calibration, grid).join(tested, key, "left").join(share(ood, "ood"), key, "left").join(share(golden, "golden"), key, "left")
    rows = rows.withColumns({"ood": F.coalesce("ood", F.lit(0.0)), "golden": F.coalesce("golden", F.lit(0.0))})
    rows = rows.withColumns({"ood_ok": F.col("ood") < 0.10, "golden_ok": F.col("golden") >= 0.15, "precision_ok": F.col("precision") >= 0.70, "enough": F.col("covered") >= 20})
    usable = F.when(F.col("ood_ok") & F.col("golden_ok") & F.col("precision_ok") & F.col("enough"), 2).when(F.col("precision_ok") & F.col("enough"), 1).otherwise(0)
    order = Window.orderBy(F.desc("_u"), F.desc(F.when(F.col("_u") > 0, F.col("coverage")).otherwise(F.col("precision"))), F.desc(F.when(F.col("_u") > 0, F.col("precision")).otherwise(F.col("coverage"))), *key)
    best = Window.orderBy(F.desc(F.col("golden") - F.col("ood")), *key)
    rows = rows.withColumn("_u", usable)
    return rows.withColumns({"chosen": F.row_number().over(order) == 1, "best_compromise": F.row_number().over(best) == 1}).drop("_u")


def majority_baseline(train: DataFrame, test: DataFrame, key: str = "query_id") -> DataFrame:
    """key, by_all and by_side: the most frequent class of all training rows, and of the row's side."""
    def top(rows: DataFrame, by: list[str], name: str) -> DataFrame:
        counts = rows.groupBy(*by, "class").agg(F.count(F.lit(1)).alias("n"))
        return counts.withColumn("p", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "class"))).filter("p = 1").select(*by, F.col("class").alias(name))

    whole = top(train, [], "by_all").scalar()
    return test.join(top(train.filter("side is not null"), ["side"], "by_side"), "side", "left").select(key, whole.alias("by_all"), F.coalesce("by_side", whole).alias("by_side"))


def knn_baseline(vectors: DataFrame, k: int = 10, fold: str = "fold") -> DataFrame:
    """chunk_id, class and confidence: the most frequent class of the k nearest rows of other folds, and its share."""
    near = knn_out_of_fold(vectors, k, fold).join(vectors.select("chunk_id", "class"), "chunk_id")
    counts = near.groupBy("query_id", "class").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("pos"))
    whole = Window.partitionBy("query_id")
    best = counts.withColumns({"confidence": F.round(F.col("n") / F.sum("n").over(whole), 4), "p": F.row_number().over(whole.orderBy(F.desc("n"), "pos"))}).filter("p = 1")
    return best.select(F.col("query_id").alias("chunk_id"), "class", "confidence")


def threshold_share(points: DataFrame, tau_score: float, tau_margin: float, by: list[str] | None = None) -> DataFrame:
    """By group: rows, the share that passes both thresholds, and 10th, middle and 90th percentile of each value."""
    passed = (F.col("score") >= tau_score) & (F.col("margin") >= tau_margin)
    by = by or []
    out = points.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(passed.cast("double")), 4).alias("share"))
    for column in ("score", "margin"):
        for q, name in ((0.1, "p10"), (0.5, "median"), (0.9, "p90")):
            value = nearest_rank_quantile(points, column, q, by).select(*by, F.round("value", 3).alias(f"{column}_{name}"))
            out = out.join(value, by, "left") if by else out.withColumn(f"{column}_{name}", value.scalar())
    return out


def accuracy_report(points: DataFrame, coverage: float = 0.30, key: str = "query_id") -> DataFrame:
    """One row from points (class, predicted, knn, majority, confidence): accuracies on all points, the model's lead over
    the baselines on its most confident share, and whether that is enough.

    A point without a baseline's class has no part in that baseline's accuracy, nor in the model's lead over it.
    """
    n = points.count()
    right = lambda c, where="predicted": F.round(F.avg(F.when(F.col(where).isNotNull(), (F.col(c) == F.col("class")).cast("double"))), 4)
    whole = points.agg(*[right(c).alias(c) for c in ("predicted", "knn", "majority")])
    top = points.orderBy(F.desc("confidence"), key).limit(max(1, round(coverage * n)))
    lead = top.agg((right("predicted", "majority") - right("majority")).alias("a"), (right("predicted", "knn") - right("knn")).alias("b"))
    return whole.withColumns({"over_majority": F.round(lead.select("a").scalar(), 4), "over_knn": F.round(lead.select("b").scalar(), 4)}).withColumns({"majority_ok": F.col("over_majority") >= 0.15, "knn_ok": F.col("over_knn") >= 0.05})


def top_lemmas(weights: DataFrame, n: int = 40) -> DataFrame:
    best = Window.partitionBy("class").orderBy(F.desc("z"), "lemma")
    return weights.filter("z > 0").withColumn("place", F.row_number().over(best)).filter(F.col("place") <= n)


def stratified_sample(df: DataFrame, n: int = 60, seed: int = 42, key: str = "query_id", fold: str | None = "test") -> DataFrame:
    """n rows of a fold, in turn from each class, in an order that a seed shuffles."""
    rows = df if fold is None else df.filter(F.col("fold") == fold)
    turn = F.row_number().over(Window.partitionBy("class").orderBy(F.xxhash64(F.lit(seed), key), key))
    return rows.withColumn("turn", turn).orderBy("turn", "class").limit(n)


def label_agreement(audit: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Of answers (field, class, answer; t or n) by field and further columns: filled, share of t, unfilled, enough."""
    answer = F.lower(F.trim("answer"))
    yes, no = F.count_if(answer == "t"), F.count_if(answer == "n")
    rows = audit.groupBy("field", *(by or [])).agg(yes.alias("yes"), (yes + no).alias("filled"), (F.count(F.lit(1)) - yes - no).alias("unfilled"))
    return rows.withColumn("share", F.when(F.col("filled") > 0, F.round(F.col("yes") / F.col("filled"), 4))).withColumn("ok", F.coalesce(F.col("share") >= 0.30, F.lit(False)))
