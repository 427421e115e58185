"""Reading and writing: request logs, article files, chunk tables, question banks, score tables, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lists
from ..functions.text import strip

#: Fields of a log line with the JSON kinds that count; a value of another kind is null.
LOG_FIELDS = {
    "typ": "string", "czas": "string", "id": "string", "lang": "string", "strona": "string", "sekcja": "string", "wynik": "string", "powod": "string", "powod_etap2": "string",
    "bramki_pominiete": "array<string>", "latencja_s": "double", "cache_hit": "boolean", "pytanie": "string", "tokeny_we": "bigint", "tokeny_wy": "bigint", "koszt_usd": "double", "tokeny_szacowane": "boolean",
    "cechy.rerank_top1": "double", "cechy.chunkow": "int", "cechy.zrodlo_top1": "string", "cechy.sedzia_ok": "boolean", "cechy.pokrycie": "double", "cechy.etap": "int",
    "ocena": "string", "id_zapytania": "string", "odpowiedz": "string", "kategoria": "string", "ticket": "string", "sukces": "boolean", "blad": "string",
}
_KINDS = {"string": ["STRING"], "boolean": ["BOOLEAN"], "double": ["BIGINT", "DOUBLE", "DECIMAL"], "bigint": ["BIGINT"], "int": ["BIGINT"], "array<string>": ["ARRAY"]}


def _field(name: str, kind: str) -> Column:
    """A field of the parsed line where its JSON value has the right kind: a boolean is no number, a number no text."""
    path = f"$.{name}"
    found = F.schema_of_variant(F.try_variant_get("line", path, "variant"))
    right = F.coalesce(F.regexp_extract(found, "^[A-Z]+", 0).isin(_KINDS[kind]), F.lit(False))
    return F.when(right, F.try_variant_get("line", path, kind))


def parse_log(lines: DataFrame) -> DataFrame:
    """Log events from a column `value` of JSON lines; blank and undecodable lines are dropped, other objects too.

    seq orders the lines within a file and files by name.
    """
    objects = lines.withColumn("line", F.try_parse_json("value")).filter(F.col("line").isNotNull() & F.schema_of_variant("line").startswith("OBJECT"))
    top = [_field(n, k).alias(n) for n, k in LOG_FIELDS.items() if "." not in n]
    features = F.struct(*[_field(n, k).alias(n.split(".")[1]) for n, k in LOG_FIELDS.items() if "." in n])
    keep = ["seq"] if "seq" in lines.columns else []
    return objects.select(*keep, *top, features.alias("cechy"))


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop)
    return found is not None and len(found) > 0


def read_query_log(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Request logs as one table; a missing file has no rows."""
    there = [p for p in ([paths] if isinstance(paths, str) else paths) if _exists(spark, p)]
    if there:
        lines = spark.read.text(there).select("value", F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("n")).alias("seq"))
    else:
        lines = spark.createDataFrame([], "value string, seq struct<file:string,n:bigint>")
    return parse_log(lines)


def read_query_log_with_archives(spark: SparkSession, folder: str, name: str = "log_analytics.jsonl", archives: str = ".przed-resetem-*") -> DataFrame:
    return read_query_log(spark, [f"{folder}/{name}{archives}", f"{folder}/{name}"])


def parse_frontmatter(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(articles, quarantine) from columns path and value: front matter between the first two '---', then the body.

    Files without the two marks, or whose front matter has a line that isn't `key: value`, are set aside.
    """
    parts = F.split("value", "---", 3)
    lines = F.filter(F.transform(F.split(F.get(parts, 1), "\n"), strip), lambda x: x != "")
    good = (F.size(parts) == 3) & F.forall(lines, lambda x: x.rlike(r"^[A-Za-z_]\w*:(?:\s|$)"))
    bare = lambda v: F.regexp_replace(strip(v), r"""^(["'])(.*)\1$""", "$2")
    pairs = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"^(\w+):", 1).alias("k"), bare(F.regexp_replace(x, r"^\w+:", "")).alias("v")))
    whole = files.withColumn("meta", F.when(F.coalesce(good, F.lit(False)), F.map_from_entries(pairs))).withColumn("body", strip(F.get(parts, 2)))
    read = lambda k, to: F.element_at("meta", k).alias(to)
    articles = whole.filter("meta is not null").select("path", read("url", "url"), read("tytul", "title"), read("agent", "section"), read("podslug", "subslug"), "body")
    return articles, whole.filter("meta is null").select("path")


def read_frontmatter_docs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    return parse_frontmatter(files.select(F.col("_metadata.file_path").alias("path"), "value"))


def to_frontmatter(df: DataFrame) -> DataFrame:
    """section, file name and text of each article (url, title, section, subslug, body)."""
    name = F.concat(F.element_at(F.split(F.rtrim("url", F.lit("/")), "/"), -1), F.lit(".md"))
    line = lambda k, c: F.concat(F.lit(f"{k}: "), F.coalesce(F.col(c), F.lit("")))
    head = F.concat_ws("\n", F.lit("---"), line("url", "url"), line("tytul", "title"), line("agent", "section"), line("podslug", "subslug"), F.lit("---"))
    return df.select("section", name.alias("file"), F.concat(head, F.lit("\n\n"), F.coalesce("body", F.lit(""))).alias("value"))


CHUNK = "chunk_id long, url string, title string, section string, subslug string, heading string, text string"


def read_chunks(spark: SparkSession, path: str, array: bool = True) -> DataFrame:
    """A chunk table: one JSON array to a file, each read by one task, or JSON lines as write_chunks() makes them."""
    return spark.read.schema(CHUNK).option("multiLine", array).json(path)


def write_chunks(df: DataFrame, path: str) -> None:
    """JSON lines in a folder per section, so that a section of any size is written and read in parts."""
    df.write.partitionBy("section").json(path)


def read_questions(spark: SparkSession, path: str, sources: list[str] | None = None) -> DataFrame:
    """A bank of questions: rows of these sources, those of `forum` with a board; no sources: all rows as they are."""
    schema = "pytanie string, strona string, lang string, zrodlo string, board string, url string, rozwiazane boolean, odpowiedzi int, data string, hash string"
    rows = spark.read.schema(schema).json(path)
    return rows if sources is None else keep_sources(rows, sources)


def keep_sources(rows: DataFrame, sources: list[str]) -> DataFrame:
    return rows.filter(F.col("zrodlo").isin(sources) & ((F.col("zrodlo") != "forum") | (F.coalesce("board", F.lit("")) != "")))


def normalize_side(side: Column) -> Column:
    return F.when(side.isin(lists.SIDES), side).otherwise("nieznana")


def export_time(time: Column) -> Column:
    """As written, to the second, without its offset; unparsable text as it is."""
    shape = r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2})(:\d{2})?.*$"
    made = F.regexp_replace(time, shape, "$1 $2$3")
    made = F.when(time.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(time, F.lit(" 00:00:00"))).when(F.length(made) == 16, F.concat(made, F.lit(":00"))).otherwise(made)
    return F.when(time.rlike(shape + r"|^\d{4}-\d{2}-\d{2}$") & F.try_to_timestamp(made, F.lit("yyyy-MM-dd HH:mm:ss")).isNotNull(), made).otherwise(time)


def export_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Question events with known columns in canonical order: those asked for, or the default ones."""
    chosen = [c for c in lists.EXPORT_COLUMNS if c in (columns or [])] or lists.EXPORT_DEFAULT
    special = {"czas": export_time(F.col("czas")), "strona": normalize_side(F.col("strona"))}
    return df.filter("typ is null").select(*[special.get(c, F.col(c)).alias(c) for c in chosen])


def csv_cells(df: DataFrame) -> DataFrame:
    """All cells as text: null empty, and text that a spreadsheet would take for a formula behind a quote."""
    text = lambda c: F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)
    return df.select(*[F.coalesce(text(F.col(n)) if k == "string" else F.col(n).cast("string"), F.lit("")).alias(n) for n, k in df.dtypes])


def export_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """Semicolons, header, byte order mark in front of the header's first name, UTF-8."""
    rows = csv_cells(export_rows(df, columns))
    first = rows.columns[0]
    rows.withColumnRenamed(first, "﻿" + first).write.option("sep", ";").option("header", True).option("emptyValue", "").csv(path)


def export_json(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    export_rows(df, columns).write.option("ignoreNullFields", False).json(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_score_table(df: DataFrame, fingerprints: dict[str, str], path: str, version: int = 2) -> None:
    """(lang, query, side, pos, url, score, sha) and, beside it, the fingerprints of what the scores came from."""
    df.write.mode("overwrite").parquet(f"{path}/rows")
    df.sparkSession.createDataFrame([(version, k, v) for k, v in sorted(fingerprints.items())], "version int, name string, value string").coalesce(1).write.mode("overwrite").parquet(f"{path}/fingerprints")


def read_score_table(spark: SparkSession, path: str, fingerprints: dict[str, str] | None = None, version: int = 2) -> DataFrame:
    """Fails if the version or any fingerprint given differs from what was written; None reads without a check."""
    if fingerprints is not None:
        stored = spark.read.parquet(f"{path}/fingerprints").collect()  # a few rows: one per corpus file
        if {r.version for r in stored} != {version}:
            raise ValueError(f"the table has another version than {version}")
        names = {r.name: r.value for r in stored}
        wrong = sorted(k for k in names.keys() | fingerprints.keys() if names.get(k) != fingerprints.get(k))
        if wrong:
            raise ValueError(f"the table was built from other data: {', '.join(wrong)}")
    return spark.read.parquet(f"{path}/rows")


def corpus_stamp(spark: SparkSession, paths: list[str]) -> int:
    """The newest modification time of the files in seconds, 0 without files."""
    there = [p for p in paths if _exists(spark, p)]
    if not there:
        return 0
    newest = spark.read.format("binaryFile").load(there).agg(F.max("modificationTime").cast("double")).first()[0]
    return int(newest or 0)
