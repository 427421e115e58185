"""Text functions: a column in, a column out. All but accent folding and edit distance are built-in expressions."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .lists import CHARS_PER_TOKEN

#: Runs of letters, as a Unicode-aware `[^\W\d_]+`; a character of a word; white space, likewise.
WORD = r"[\p{L}\p{Nl}\p{No}]+"
IN_WORD = r"[\p{L}\p{N}_]"
SPACE = r"[\s\p{Z}\x1c-\x1f\x85]"


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def tokenize_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def _folding(lower_l_only: bool):
    import unicodedata

    table = {ord("ł"): "l"} if lower_l_only else {ord("ł"): "l", ord("Ł"): "L"}

    @F.pandas_udf("string")
    def fold_all(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: None if t is None else t if t.isascii() else "".join(c for c in unicodedata.normalize("NFKD", t.translate(table)) if not unicodedata.combining(c)))

    return fold_all


def fold(text: Column) -> Column:
    """ł to l, then without combining marks after compatibility decomposition; case stays."""
    return _folding(True)(text)


def strip_accents(text: Column) -> Column:
    """As fold(), and Ł to L."""
    return _folding(False)(text)


def normalize_question(text: Column) -> Column:
    """Lower case, no accents, white space collapsed and stripped."""
    return strip(F.regexp_replace(strip_accents(F.lower(text)), f"{SPACE}+", " "))


def normalize_lexical(text: Column) -> Column:
    return F.lower(strip_accents(text))


def char_ngrams(token: Column, n: int = 3) -> Column:
    """n-grams of '#' + token; the token itself where that is shorter than n."""
    marked = F.concat(F.lit("#"), token)
    grams = F.transform(F.sequence(F.lit(1), F.length(marked) - (n - 1)), lambda i: F.substring(marked, i, F.lit(n)))
    return F.when(F.length(marked) < n, F.array(marked)).otherwise(grams)


def lookup(words: Column, table: Column | None) -> Column:
    """Each word by a map column, itself where the map has none."""
    return words if table is None else F.transform(words, lambda w: F.coalesce(F.element_at(table, w), w))


def lexical_tokens(text: Column, lemmas: Column | None = None) -> Column:
    """For each word between white space its normalised lemma, then the trigrams of the lemma as it is.

    The normalised forms are taken in one pass: lemmas joined by a line end, which no word holds.
    """
    words = lookup(F.filter(F.split(text, f"{SPACE}+"), lambda w: w != ""), lemmas)
    plain = F.split(normalize_lexical(F.array_join(words, "\n")), "\n")
    return F.flatten(F.zip_with(plain, words, lambda p, w: F.concat(F.array(p), char_ngrams(w))))


def lemmas(text: Column, table: Column | None = None, min_len: int = 4) -> Column:
    """The set of lemmas of words of at least min_len letters."""
    return F.array_distinct(lookup(F.filter(tokenize_words(text), lambda w: F.length(w) >= min_len), table))


def letter_ratio(text: Column) -> Column:
    return F.when(F.length(text) == 0, 0.0).otherwise(F.length(F.regexp_replace(text, r"\P{L}", "")) / F.length(text))


def latin_ratio(text: Column) -> Column:
    letters = F.regexp_replace(text, r"\P{L}", "")
    return F.when(F.length(letters) == 0, 1.0).otherwise(F.length(F.regexp_replace(letters, r"\P{IsLatin}", "")) / F.length(letters))


#: E-mail addresses; phone numbers; words of four and more characters with a digit; web addresses. Fixed patterns.
PII = [
    r"[^\s\p{Z}@]+@[^\s\p{Z}@]+\.[^\s\p{Z}@]+",
    r"(?:\+\p{Nd}{1,3}[\s\p{Z}-]?)?(?:\p{Nd}[\s\p{Z}.-]?){9,}",
    r"(?<![\p{L}\p{N}_])(?=[\p{L}\p{N}]*\p{Nd})[\p{L}\p{N}]{4,}(?![\p{L}\p{N}_])",
    r"(?<![\p{L}\p{N}_])https?://[^\s\p{Z}]+",
]


def redact_pii(text: Column, put: str = "[ukryte]") -> Column:
    for pattern in PII:
        text = F.regexp_replace(text, pattern, put)
    return text


def pii_tokens(text: Column) -> Column:
    found = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in PII])
    return F.array_distinct(F.flatten(F.transform(found, tokenize_words)))


def osa(a: str, b: str, most: int) -> int:
    """Optimal string alignment distance, or most + 1 once it must exceed most."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    codes = np.frombuffer(b.encode("utf-32-le"), np.uint32)
    steps = np.arange(len(b) + 1)
    before, now = None, steps
    for i, x in enumerate(a):
        change = now[:-1] + (codes != ord(x))
        best = np.append(i + 1, np.minimum(change, now[1:] + 1))
        if before is not None and len(b) > 1:
            swapped = (codes[1:] == ord(a[i - 1])) & (codes[:-1] == ord(x))
            best[2:] = np.where(swapped, np.minimum(best[2:], before[:-2] + 1), best[2:])
        best = np.minimum.accumulate(best - steps) + steps  # insertions
        if best.min() > most and now.min() > most:
            return most + 1
        before, now = now, best
    return int(min(now[-1], most + 1))


def osa_distance(a: Column, b: Column, most: int = 1 << 20) -> Column:
    """Levenshtein distance with adjacent transpositions; null where either is null."""

    @F.pandas_udf("int")
    def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in batches:
            there = np.flatnonzero(left.notna().to_numpy() & right.notna().to_numpy())
            out = pd.array([None] * len(left), dtype="Int32")
            out[there] = osa_all([left.iloc[k] for k in there], [right.iloc[k] for k in there], most)
            yield pd.Series(out)

    return of(a, b)


def osa_all(a: list[str], b: list[str], most: int, cells: int = 1 << 18) -> np.ndarray:
    """osa() of many pairs, a bounded number of letters at a time; the longest alone."""
    out = np.zeros(len(a), np.int64)
    longest = np.array([max(len(x), len(y)) for x, y in zip(a, b)], np.int64)
    order = np.argsort(longest, kind="stable")
    begin = 0
    while begin < len(order):
        end = begin + 1
        while end < len(order) and longest[order[end]] <= 64 and (end - begin) * longest[order[end]] < cells:
            end += 1
        some = order[begin:end]
        if end - begin == 1:
            out[some] = osa(a[some[0]], b[some[0]], most)
        else:
            out[some] = _osa_matrix([a[k] for k in some], [b[k] for k in some], most)
        begin = end
    return out


def _osa_matrix(a: list[str], b: list[str], most: int) -> np.ndarray:
    def letters(words: list[str], pad: int) -> tuple[np.ndarray, np.ndarray]:
        n = np.array([len(w) for w in words])
        out = np.full((len(words), max(1, n.max())), pad, np.int64)
        out[np.arange(out.shape[1])[None, :] < n[:, None]] = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        return out, n

    x, n = letters(a, -1)
    y, m = letters(b, -2)
    steps = np.arange(y.shape[1] + 1)
    before, now = None, np.broadcast_to(steps, (len(a), len(steps))).copy()
    out = m.copy()
    for i in range(x.shape[1]):
        best = np.empty_like(now)
        best[:, 0] = i + 1
        best[:, 1:] = np.minimum(now[:, :-1] + (y != x[:, i : i + 1]), now[:, 1:] + 1)
        if before is not None and y.shape[1] > 1:
            swapped = (y[:, 1:] == x[:, i - 1 : i]) & (y[:, :-1] == x[:, i : i + 1])
            best[:, 2:] = np.where(swapped, np.minimum(best[:, 2:], before[:, :-2] + 1), best[:, 2:])
        best = np.minimum.accumulate(best - steps, axis=1) + steps  # insertions
        before, now = now, best
        ends = n == i + 1
        out[ends] = best[ends, m[ends]]
    return np.minimum(out, most + 1)


def estimate_tokens(text: Column) -> Column:
    return F.when(text.isNull() | (text == ""), 0).otherwise(F.greatest(F.lit(1), F.bround(F.length(text) / CHARS_PER_TOKEN).cast("int")))


def collapse_markdown_links(text: Column) -> Column:
    """[label](address) to the label, in brackets where it is a number."""
    tail = r"\]\(\s*(?:https?://|www\.)[^\s()]+\s*\)"
    text = F.regexp_replace(text, rf"\[\s*(\d+)\s*{tail}", "[$1]")
    return F.regexp_replace(text, rf"\[\s*([^\[\]]*[^\[\]\s])\s*{tail}", "$1")


_HEADING = r"(?iu)^[ \t]*#{0,6}[ \t]*[*_]{0,2}[ \t]*(?:źródła|źródło|zrodla|zrodlo|sources|source|references|bibliografia)[ \t]*:?[ \t]*[*_]{0,2}[ \t]*:?[ \t]*(?:\[\d+\][ \t]*,?[ \t]*)*$"
_LISTED = r"^[ \t]*(?:[-*+][ \t]+|\d+[.)][ \t]+)?[*_]{0,2}\[\d+\]"


def drop_sources_section(text: Column) -> Column:
    """Without the first line that is a heading of sources, and without all that follows it if that is a list."""
    lines = F.split(text, "\n", -1)
    at = F.array_position(F.transform(lines, lambda x: x.rlike(_HEADING)), True).cast("int")
    head = F.slice(lines, F.lit(1), at - 1)
    rest = F.slice(lines, at + 1, F.size(lines))
    only_list = F.forall(rest, lambda x: (strip(x) == "") | x.rlike(_LISTED))
    cut = F.regexp_replace(F.array_join(head, "\n"), f"{SPACE}+$", "")
    return F.when(at == 0, text).when(only_list, cut).otherwise(F.array_join(F.concat(head, rest), "\n"))


#: Web addresses in an answer; what may follow one without being of it; article addresses, a parameter. Fixed patterns.
URL = r"(?i)https?://[^\s\p{Z}]+|(?<![\p{L}\p{N}_])www\.[^\s\p{Z}]+"
AFTER_URL = ".,;:!?)]}>\"'"
ARTICLE = r"^https://[^/]+/(?:[^/]+/)*[^/]+-[A-Za-z0-9]{6,}$"
_MARKS = r"\[(\d+)\]"


def verify_answer(text: Column, hits: Column, article: str = ARTICLE) -> Column:
    """struct(text, citations, foreign_urls) of an answer with markers [n] into hits, an array of (n, url, title).

    Links are collapsed, addresses removed (those that aren't article addresses are listed as they stood), brackets
    that aren't markers and the list of sources go. citations has each marker with a hit once, in order of first use.
    Lines of markers only go; of the markers that end the text those stay that occur once and have a hit.
    """
    text = collapse_markdown_links(F.coalesce(text, F.lit("")))
    urls = F.regexp_extract_all(text, F.lit(URL), F.lit(0))
    foreign = F.filter(urls, lambda u: ~F.rtrim(u, F.lit(AFTER_URL)).rlike(article))
    text = F.regexp_replace(text, URL, "")
    text = F.regexp_replace(F.regexp_replace(text, r"(?i)\[(?:Security|Note|Disclaimer|Warning)[^\[\]]*:[^\[\]]*\]\s*", ""), rf"^{SPACE}+", "")
    text = drop_sources_section(F.regexp_replace(text, r"\[(?!\d+\])[^\[\]]*\]", ""))
    numbers = lambda t: F.transform(F.regexp_extract_all(t, F.lit(_MARKS), F.lit(1)), lambda n: n.cast("int"))
    known = F.transform(hits, lambda h: h["n"])
    used = F.filter(F.array_distinct(numbers(text)), lambda n: F.array_contains(known, n))
    citations = F.transform(used, lambda n: F.filter(hits, lambda h: h["n"] == n)[0])
    text = F.regexp_replace(text, r"(?m)^[ \t]*(?:\[\d+\][ \t]*)+$\n?", "")
    every = numbers(text)
    tail = F.regexp_extract(text, r"((?:[ \t]*\[\d+\])+)[ \t]*$", 1)
    head = F.regexp_replace(text, r"(?:[ \t]*\[\d+\])+[ \t]*$", "")

    def kept(mark: Column) -> Column:
        n = F.regexp_extract(mark, _MARKS, 1).cast("int")
        once = F.size(F.filter(every, lambda x: x == n)) <= 1
        return F.when(once & F.array_contains(known, n), mark).otherwise(F.regexp_replace(mark, _MARKS, ""))

    text = F.concat(head, F.array_join(F.transform(F.regexp_extract_all(tail, F.lit(r"[ \t]*\[\d+\]"), F.lit(0)), kept), ""))
    text = F.regexp_replace(F.regexp_replace(text, r"[ \t]{2,}", " "), r"[ \t]+([,.;:!?])", "$1")
    citations = F.transform(citations, lambda h: F.struct(h["n"].alias("n"), h["url"].alias("url"), h["title"].alias("title")))
    return F.struct(strip(text).alias("text"), citations.alias("citations"), foreign.alias("foreign_urls"))


def context_block(hits: Column) -> Column:
    """The hits, an array of (title, heading, text), as numbered blocks."""
    label = lambda h: F.when(F.coalesce(h["heading"], F.lit("")) == "", h["title"]).otherwise(F.concat(h["title"], F.lit(" ("), h["heading"], F.lit(")")))
    return F.array_join(F.transform(hits, lambda h, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), label(h), F.lit("\n"), h["text"])), "\n\n")


def source_title(url: Column, title: Column) -> Column:
    """struct(url, title, domain): a missing title comes from the last path segment without its hash, else the domain."""
    host = F.try_parse_url(url, F.lit("HOST"))
    domain = F.regexp_replace(host, r"^www\.", "")
    segments = F.filter(F.split(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/"), lambda s: s != "")
    last = F.regexp_replace(F.coalesce(F.get(segments, F.size(segments) - 1), F.lit("")), r"-[a-zA-Z0-9]{6,}$", "")
    words = F.transform(F.filter(F.split(last, "[-_]"), lambda w: w != ""), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w))))
    own = F.nullif(title, F.lit(""))
    made = F.when(F.size(words) > 0, F.array_join(words, " ")).otherwise(domain)
    return F.when(host.isNull(), F.struct(url.alias("url"), F.coalesce(title, url).alias("title"), F.lit("").alias("domain"))).otherwise(
        F.struct(url.alias("url"), F.coalesce(own, made).alias("title"), domain.alias("domain"))
    )


def renumber_citations(text: Column, citations: Column) -> Column:
    """struct(text, urls, cited): distinct addresses of citations (n, url) count from 1, markers become links to them.

    urls has the cited addresses, or all of them where no marker has a citation.
    """
    urls = F.array_distinct(F.transform(citations, lambda c: c["url"]))
    url_of = F.map_from_entries(F.transform(F.array_distinct(F.transform(citations, lambda c: c["n"])), lambda n: F.struct(n, F.element_at(F.filter(citations, lambda c: c["n"] == n), -1)["url"])))
    parts = F.regexp_extract_all(text, F.lit(r"(?s)\[\d+\]|(?:(?!\[\d+\]).)+"), F.lit(0))
    number = lambda p: F.when(p.rlike(r"^\[\d+\]$"), F.regexp_extract(p, r"(\d+)", 1).try_cast("int"))
    target = lambda p: F.element_at(url_of, F.coalesce(number(p), F.lit(-1)))
    link = lambda p: F.concat(F.lit("[["), F.array_position(urls, target(p)).cast("string"), F.lit("]]("), target(p), F.lit(")"))
    made = F.array_join(F.transform(parts, lambda p: F.coalesce(link(p), p)), "")
    cited = F.array_distinct(F.filter(F.transform(parts, target), lambda u: u.isNotNull()))
    some = F.size(cited) > 0
    empty = F.size(citations) == 0
    return F.struct(F.when(empty, text).otherwise(made).alias("text"), F.when(some, F.filter(urls, lambda u: F.array_contains(cited, u))).otherwise(urls).alias("urls"), (some & ~empty).alias("cited"))


def split_draft(text: Column, preamble: str = r"^(?:Szkic wiadomości do .+?\(uzupełnij dane przed wysłaniem\):|Draft message to .+?\(fill in your details before sending\):)\s*\n+") -> Column:
    """struct(subject, body): the first subject line, and all other lines up to a second subject line."""
    lines = F.split(F.regexp_replace(text, preamble, ""), "\n", -1)
    bare = F.transform(lines, lambda x: strip(F.replace(F.regexp_replace(x, r"^[ \t]*#{0,6}[ \t]*", ""), F.lit("**"), F.lit(""))))
    pattern = r"^(?:Temat|Subject):\s*(.+)$"
    marks = F.transform(bare, lambda x: x.rlike(pattern))
    first = F.array_position(marks, True).cast("int")
    second = F.array_position(F.slice(marks, first + 1, F.size(marks)), True).cast("int")
    after = F.slice(lines, first + 1, F.when(second > 0, second - 1).otherwise(F.size(lines)))
    body = strip(F.regexp_replace(F.array_join(F.concat(F.slice(lines, F.lit(1), first - 1), after), "\n"), r"\n{3,}", "\n\n"))
    return F.when(first == 0, F.struct(F.lit("").alias("subject"), strip(F.array_join(lines, "\n")).alias("body"))).otherwise(
        F.struct(strip(F.regexp_extract(F.element_at(bare, first), pattern, 1)).alias("subject"), body.alias("body"))
    )


def shorten(text: Column, most: int = 46) -> Column:
    """White space collapsed; more than `most` characters are cut and marked."""
    flat = strip(F.regexp_replace(text, f"{SPACE}+", " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("…"))).otherwise(flat)


def l2_normalize(vector: Column) -> Column:
    """The vector over its length; a zero vector as it is."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm == 0, F.transform(vector, lambda x: x.cast("double"))).otherwise(F.transform(vector, lambda x: x / norm))


def content_sha(title: Column, text: Column) -> Column:
    return F.sha1(F.concat_ws("\n", title, text).cast("binary"))


def subslug(url: Column) -> Column:
    return F.get(F.split(url, "/"), 5)


def sha1_mod(text: Column, modulus: int = 100) -> Column:
    """sha1 of the text, as one large number, modulo a small one."""
    digits = F.filter(F.split(F.sha1(text.cast("binary")), ""), lambda d: d != "")
    return F.aggregate(digits, F.lit(0), lambda r, d: (r * 16 + F.conv(d, 16, 10).cast("int")) % modulus)
