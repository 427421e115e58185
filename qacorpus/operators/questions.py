"""Questions before retrieval: screening, typos, language, turns of a conversation, mail and side signals."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lists
from ..functions.text import IN_WORD, SPACE, WORD, fold, latin_ratio, letter_ratio, normalize_question, osa_distance, pii_tokens, strip, strip_accents, tokenize_words


def _array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def _by_lang(lang: Column, of) -> Column:
    """of(language) for the row's language; Polish where it has none of the known ones."""
    return F.when(lang == "en", of("en")).otherwise(of("pl"))


def _java(pattern: str) -> str:
    """A pattern with Unicode word characters and boundaries written out."""
    return pattern.replace(r"\b", f"(?:(?<={IN_WORD})(?!{IN_WORD})|(?<!{IN_WORD})(?={IN_WORD}))").replace(r"\w", IN_WORD).replace(r"\s", SPACE)


def detect_injection(text: Column) -> Column:
    """Whether a pattern of instructions to the model matches the question without accents, or with digits and signs
    read as the letters they stand for."""
    pattern = "|".join(_java(p) for p in lists.INJECTIONS)
    plain = normalize_question(text)
    return plain.rlike(pattern) | F.translate(plain, "01345@$", "oleasas").rlike(pattern)


def screen_question(text: Column, min_chars: int = 3, max_chars: int = 500) -> Column:
    """The first reason not to take a question, or null."""
    q = strip(text)
    return (
        F.when(F.length(q) < min_chars, "za_krotkie").when(F.length(q) > max_chars, "za_dlugie").when(letter_ratio(q) < 0.4, "nie_rozumiem").when(latin_ratio(q) < 0.5, "zly_alfabet").when(detect_injection(q), "injekcja")
    )


def guard_message(lang: Column, reason: Column) -> Column:
    return _by_lang(lang, lambda x: reduce(lambda c, kv: c.when(reason == kv[0], kv[1]), lists.GUARD_MESSAGES[x].items(), F.when(F.lit(False), "")))


def removal_reason(text: Column) -> Column:
    """obcy_alfabet with a Cyrillic or Chinese character, bez_tresci with fewer than two words of two letters, or null."""
    words = F.filter(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.length(w) >= 2)
    return F.when(text.rlike(r"[Ѐ-ӿ一-鿿]"), "obcy_alfabet").when(F.size(words) <= 1, "bez_tresci")


def clean_questions(df: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept, removed, counts by reason)."""
    rows = df.withColumn("reason", removal_reason(F.coalesce(F.col(text), F.lit(""))))
    removed = rows.filter("reason is not null")
    return rows.filter("reason is null").drop("reason"), removed, removed.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def long_words(text: Column, min_len: int = 4) -> Column:
    return F.filter(tokenize_words(text), lambda w: F.length(w) >= min_len)


def detect_language(df: DataFrame, freq: DataFrame, key: str = "query_id", text: str = "text", langs: tuple[str, str] = ("pl", "en")) -> DataFrame:
    """key and detected: the language whose frequencies (lang, word, zipf) sum higher over words of four letters and
    more; null for fewer than two words or equal sums."""
    rows = df.select(key, F.posexplode(long_words(F.col(text))).alias("pos", "word"))
    by_lang = freq.filter(F.col("lang").isin(*langs)).groupBy("word").agg(*[F.sum(F.when(F.col("lang") == x, F.col("zipf"))).alias(x) for x in langs])
    total = lambda x: F.round(F.coalesce(F.sum(x), F.lit(0.0)), 9)
    sums = rows.join(by_lang, "word", "left").groupBy(key).agg(F.count(F.lit(1)).alias("n"), total(langs[0]).alias("a"), total(langs[1]).alias("b"))
    detected = F.when((F.col("n") >= 2) & (F.col("a") > F.col("b")), langs[0]).when((F.col("n") >= 2) & (F.col("b") > F.col("a")), langs[1])
    return df.select(key).join(sums.select(key, detected.alias("detected")), key, "left")


def effective_language(hint: Column, detected: Column, default: str = "pl") -> Column:
    """The hint, else the detected language, else the default; empty ones count as missing."""
    return F.coalesce(F.nullif(hint, F.lit("")), F.nullif(detected, F.lit("")), F.lit(default))


def best_candidate(tokens: DataFrame, dictionary: DataFrame) -> DataFrame:
    """token, word and distance for each token (token) with a word of the dictionary (word, cnt) close enough.

    Compared without accents; one edit is allowed up to six letters, two above. Least distance, then most frequent, then
    first in the dictionary's order (a column place, if it has one), then by spelling.

    Words of up to 12 letters are joined on what is left of a form when up to so many letters are taken out, which two
    forms within the distance share: first one letter, then two for tokens without a word at a distance of one. Longer ones are cut into five parts: two edits, each of which touches two parts at
    most (an exchange of neighbours), leave one whole, at its place or up to two letters away. So a token's keys don't
    grow with its letters. Words of a length that no token can reach are left out before.
    """
    allowed = F.when(F.length("token") <= 6, 1).otherwise(2)
    asked = tokens.select("token").distinct().select("token", fold(F.col("token")).alias("folded"), allowed.alias("allowed"))
    reach = F.explode(F.sequence(F.length("folded") - F.col("allowed"), F.length("folded") + F.col("allowed"))).alias("n")
    lengths = asked.select(reach).agg(F.collect_set("n")).scalar()  # at most as many as the longest token has letters, and two
    place = F.col("place") if "place" in dictionary.columns else F.lit(0)
    known = dictionary.select("word", "cnt", place.alias("place"), fold(F.col("word")).alias("wfolded")).filter(F.array_contains(lengths, F.length("wfolded")))
    short, words = asked.filter(F.length("folded") <= SHORT + 2), known.filter(F.length("wfolded") <= SHORT)

    def near(left: DataFrame, right: DataFrame, most: Column) -> DataFrame:
        pairs = left.join(right, "key").filter(F.abs(F.length("folded") - F.length("wfolded")) <= most).drop("key").distinct()
        return pairs.withColumn("distance", osa_distance(F.col("folded"), F.col("wfolded"), 2)).filter(F.col("distance") <= most)

    def cut(rows: DataFrame, form: str, most: int) -> DataFrame:
        return rows.select("*", F.explode(_without(F.col(form), F.lit(most))).alias("key"))

    one = near(cut(short, "folded", 1), cut(words, "wfolded", 1), F.lit(1))
    rest = short.filter("allowed = 2").join(one.select("token").distinct(), "token", "left_anti")
    two = near(cut(rest, "folded", 2), cut(words, "wfolded", 2), F.lit(2))
    long_left = asked.filter(F.length("folded") + F.col("allowed") > SHORT).select("*", F.explode(_segments_near(F.col("folded"), F.col("allowed"))).alias("key"))
    long_right = known.filter(F.length("wfolded") > SHORT).select("*", F.explode(_segments(F.col("wfolded"))).alias("key"))
    found = one.unionByName(two).unionByName(near(long_left, long_right, F.col("allowed")))
    best = Window.partitionBy("token").orderBy("distance", F.desc("cnt"), "place", "word")
    return found.withColumn("rank", F.row_number().over(best)).filter("rank = 1").select("token", "word", "distance")


#: Up to so many letters words are compared by what is left of them; beyond, by their parts.
SHORT = 12
PARTS = 5


def _cut(length: Column, i: Column) -> tuple[Column, Column]:
    """Where the i-th of five parts of a word of a length begins, and how many letters it has."""
    begin = F.floor(length * i / PARTS).cast("int")
    return begin, F.floor(length * (i + 1) / PARTS).cast("int") - begin


def _segments(word: Column) -> Column:
    """A word's parts with its length and their numbers: five keys."""
    def key(i: Column) -> Column:
        begin, n = _cut(F.length(word), i)
        return F.concat_ws(" ", F.length(word), i, F.substring(word, begin + 1, n))

    return F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), key)


def _segments_near(word: Column, most: Column) -> Column:
    """The keys by which words of up to `most` letters more or fewer can be near: for each length and part what stands at
    its place in this word, or up to `most` letters away; 125 at most."""
    steps = F.sequence(-most, most)

    def of(length: Column) -> Column:
        def part(i: Column) -> Column:
            begin, n = _cut(length, i)
            here = F.filter(steps, lambda s: (begin + s >= 0) & (begin + s + n <= F.length(word)))
            return F.transform(here, lambda s: F.concat_ws(" ", length, i, F.substring(word, begin + s + 1, n)))

        return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), part))

    lengths = F.filter(F.transform(steps, lambda s: F.length(word) + s), lambda x: x > SHORT)
    return F.array_distinct(F.flatten(F.transform(lengths, of)))


def _without(word: Column, most: Column) -> Column:
    """The distinct forms of a word with up to `most` (0 to 2) letters taken out."""
    cut = lambda w: F.transform(F.when(F.length(w) > 0, F.sequence(F.lit(1), F.length(w))).otherwise(F.array().cast("array<int>")), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    one = F.array_distinct(cut(word))
    two = F.array_distinct(F.flatten(F.transform(one, cut)))
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.array(word), F.when(most >= 1, one).otherwise(none), F.when(most >= 2, two).otherwise(none)))


def correct_questions(df: DataFrame, dictionary: DataFrame, freq: DataFrame, key: str = "query_id", text: str = "text", min_len: int = 4, known_from: float = 2.0, store: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """key, corrected, changed, changes (array of from, to) and unknown: words of min_len letters and more that neither
    the dictionary nor the frequencies (word, zipf) know give way to their best candidate; what isn't a word stays.

    With a store, the dictionary and the unknown words are made once, and not for each of the joins that read them."""
    store = store or (lambda df, name: df)
    dictionary = store(dictionary, "dictionary")
    parts = F.regexp_extract_all(text, F.lit(f"{WORD}|[^\\p{{L}}\\p{{Nl}}\\p{{No}}]+"), F.lit(0))
    rows = df.select(key, F.posexplode_outer(F.when(F.length(text) > 0, parts)).alias("pos", "part"))
    rows = rows.withColumn("token", F.when(F.col("part").rlike(WORD) & (F.length("part") >= min_len), F.lower("part")))
    known = dictionary.select(F.col("word").alias("token")).union(freq.filter(F.col("zipf") >= known_from).select(F.col("word").alias("token"))).distinct()
    strange = store(rows.filter("token is not null").select("token").distinct().join(known, "token", "left_anti"), "strange")
    fixes = strange.join(best_candidate(strange, dictionary), "token", "left").select("token", F.when(F.col("word") != F.col("token"), F.col("word")).alias("fix"), F.lit(True).alias("strange"))
    done = rows.join(fixes, "token", "left").withColumn("put", F.coalesce("fix", "part"))
    listed = F.array_sort(F.collect_list(F.struct("pos", "put", "part", "fix", "strange")))
    out = done.groupBy(key).agg(listed.alias("p"))
    changes = F.transform(F.filter("p", lambda x: x["fix"].isNotNull()), lambda x: F.struct(x["part"].alias("from"), x["fix"].alias("to")))
    unknown = F.transform(F.filter("p", lambda x: x["strange"] & x["fix"].isNull()), lambda x: x["part"])
    return out.select(key, F.array_join(F.transform("p", lambda x: x["put"]), "").alias("corrected"), (F.size(changes) > 0).alias("changed"), changes.alias("changes"), unknown.alias("unknown"))


def unintelligible(corrected: Column, unknown: Column) -> Column:
    n = F.size(long_words(corrected))
    return (n >= 1) & (F.size(unknown) >= n)


def hard_words(df: DataFrame, now) -> DataFrame:
    """czas and nieznane of each question (text, unknown) with unknown words outside of personal data."""
    words = F.array_sort(F.array_distinct(F.array_except(F.transform("unknown", F.lower), pii_tokens(F.col("text")))))
    return df.select("query_id", F.lit(now).alias("czas"), words.alias("nieznane")).filter(F.size("nieznane") > 0)


def is_followup(text: Column, lang: Column) -> Column:
    low = strip(F.lower(text))
    starts = lambda x: reduce(lambda a, p: a | low.startswith(p), lists.FOLLOWUP_PREFIXES[x], F.lit(False))
    return _by_lang(lang, lambda x: starts(x) | F.arrays_overlap(tokenize_words(low), _array(lists.PRONOUNS[x])))


def mail_signal(text: Column, lang: Column) -> Column:
    low = F.lower(text)

    def of(x: str) -> Column:
        words = [w for c in lists.MAIL_CATEGORIES[x].values() for w in c["words"]]
        phrases = [p for c in lists.MAIL_CATEGORIES[x].values() for p in c["phrases"]]
        return F.arrays_overlap(tokenize_words(low), _array(words)) | F.exists(_array(phrases), lambda p: F.contains(low, p))

    return _by_lang(lang, of)


def mail_category_from_offer(text: Column, lang: Column) -> Column:
    low = F.lower(strip(text))
    return _by_lang(lang, lambda x: F.coalesce(*[F.when(low == c["offer"].lower(), k) for k, c in lists.MAIL_CATEGORIES[x].items()]))


def explicit_mail_request(text: Column, lang: Column) -> Column:
    words = tokenize_words(text)
    both = _by_lang(lang, lambda x: F.arrays_overlap(words, _array(lists.MAIL_VERBS[x])) & F.arrays_overlap(words, _array(lists.MAIL_OBJECTS[x])))
    return mail_category_from_offer(text, lang).isNotNull() | both


def folded_words(text: Column) -> Column:
    """Words without accents; folded together, as one text, since no word has a space."""
    return F.filter(F.split(strip_accents(F.array_join(tokenize_words(text), " ")), " "), lambda w: w != "")


def _plain(phrase: str) -> list[str]:
    import re
    import unicodedata

    text = phrase.lower().replace("ł", "l")
    return re.findall(r"[^\W\d_]+", "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)))


def matches_list(words: Column, phrases: list[str], fillers: int = 2) -> Column:
    """Whether a phrase occurs as a run of words, with at most so many other words around it."""
    padded = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    plain = [_plain(p) for p in phrases]
    return reduce(lambda a, p: a | (F.contains(padded, F.lit(" " + " ".join(p) + " ")) & (F.size(words) <= len(p) + fillers)), plain, F.lit(False))


def strip_greeting(text: Column, lang: Column) -> Column:
    """What follows the first greeting of the list that the text begins with, if it has two words of four letters."""
    stripped = strip(text)
    low = strip_accents(F.lower(stripped))

    def of(x: str) -> Column:
        out = None
        for phrase in lists.GREETINGS[x]:
            n = len(phrase)
            fits = low.startswith(strip_py(phrase)) & ~F.substring(stripped, n + 1, 1).rlike(r"^\p{L}")
            rest = strip(F.regexp_replace(F.substring(stripped, F.lit(n + 1), F.length(stripped)), r"^[ ,:;\-]+", ""))
            found = F.when(F.size(long_words(rest)) >= 2, rest)
            out = F.when(fits, found) if out is None else out.when(fits, found)
        return out

    return _by_lang(lang, of)


def strip_py(phrase: str) -> str:
    import unicodedata

    return "".join(c for c in unicodedata.normalize("NFKD", phrase.lower().replace("ł", "l")) if not unicodedata.combining(c))


def control_subclass(text: Column, lang: Column) -> Column:
    words = folded_words(text)
    return _by_lang(lang, lambda x: F.coalesce(*[F.when(matches_list(words, lists.CONTROL[x][k]), k) for k in lists.CONTROL[x]], F.lit("prosciej")))


def classify_turn(df: DataFrame, text: str = "text", most_words: int = 5) -> DataFrame:
    """Adds class and rest to turns (text, lang, has_history, prev_section): what kind of talk a turn is, null for a
    question, and the text without its greeting."""
    lang, old = F.col("lang"), F.col("has_history")
    words = folded_words(F.col(text))
    df = df.withColumns({"_words": words, "_rest": strip_greeting(F.col(text), lang)})
    few = F.size("_words") <= most_words
    hit = lambda table: _by_lang(lang, lambda x: matches_list(F.col("_words"), table[x]))
    control = _by_lang(lang, lambda x: matches_list(F.col("_words"), [p for c in lists.CONTROL[x].values() for p in c]))
    kind = (
        F.when(F.col("_rest").isNotNull(), None).when(few & ~old & hit(lists.GREETINGS), "powitanie").when(few & hit(lists.THANKS), "podziekowanie").when(hit(lists.META), "meta")
        .when(old & (F.coalesce("prev_section", F.lit("")) != "") & control, "sterowanie").when(old & few & hit(lists.GREETINGS), "powitanie_ponowne")
    )
    return df.withColumns({"class": kind, "rest": F.coalesce("_rest", F.col(text))}).drop("_words", "_rest")


def history_window(turns: DataFrame, n: int = 3) -> DataFrame:
    """Adds to turns (conv_id, turn, role, text) the last n before each, the last user text and both texts for retrieval."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    history = F.collect_list(F.struct("role", "text")).over(order.rowsBetween(-n, -1))
    asked = F.when((F.col("role") == "user") & (strip(F.coalesce("text", F.lit(""))) != ""), F.col("text"))
    previous = F.last(asked, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return turns.withColumns({"history": history, "previous": previous, "retrieval_text": F.concat_ws(" ", previous, "text")})


def side_prior(text: Column, prev_section: Column, followup: Column) -> Column:
    """struct(side, strength): from words and phrases of one side only, else from the section before."""
    low = F.lower(text)
    words = tokenize_words(low)
    hits = {s: F.arrays_overlap(words, _array(m["words"])) | F.exists(_array(m["phrases"]), lambda p: F.contains(low, p)) for s, m in lists.SIDE_MARKERS.items()}
    buyer, seller = hits[lists.SIDES[0]], hits[lists.SIDES[1]]
    side = F.when(buyer & ~seller, lists.SIDES[0]).when(seller & ~buyer, lists.SIDES[1])
    sticky = (F.coalesce(prev_section, F.lit("")) != "") & (followup | ~(buyer | seller))
    old = F.when(sticky, F.when(prev_section == lists.SELLER_SECTION, lists.SIDES[1]).otherwise(lists.SIDES[0]))
    return F.struct(F.coalesce(side, old).alias("side"), F.when(side.isNotNull(), "leksykalna").when(old.isNotNull(), "lepka").alias("strength"))


def new_by_hash(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """Clean incoming rows whose hash isn't known yet, one of each hash."""
    kept, _, _ = clean_questions(incoming, "pytanie")
    return kept.dropDuplicates(["hash"]).join(known.select("hash").distinct(), "hash", "left_anti").select(*incoming.columns)


def mail_offer_gate(signal: Column, top_url: Column, slugs: list[str]) -> Column:
    return signal | F.exists(_array(slugs), lambda s: F.contains(F.coalesce(top_url, F.lit("")), s))
