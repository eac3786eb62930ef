"""Benchmark decontamination with a distributed positional inverted index.

The training texts are cut into words once and stored so.  Counts of all terms say
which terms of a test window are the rarest, and the postings, (term, text key,
position), are stored for the two rarest of each.
The list of the rarest term, shifted by its offset, gives the places where a
window could start; intersecting it with the shifted list of the next rarest
leaves few.  Texts that hold such a place are cut into short overlapping pieces, and each
piece compares all terms of its places: at the start plus their offset for an exact
match, within ``slop`` words of there for a proximity match.  A piece is a row of
bounded length, so a text of millions of repeated words is dealt over many
tasks.  A text key is a 128-bit hash of the text, so
exact copies, however many, share one posting list.

Only DataFrame functions are used.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoquilt.storage import broadcast_within, discard, stored

#: Between words; they are runs of digits, letters and everything beyond ASCII.
_OTHER = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW, SLOP = 10, 1
TERM_BYTES, WINDOW_BYTES, KEY_BYTES = 200, 1000, 64
#: Words of a piece of a text; a match of pieces takes as many words, and looks ahead for those that a match may need.
PIECE_WORDS = 64
_PIECES = r"(?=((?:[^ ]++ ?+){1,%d}+))(?:[^ ]++ ?+){1,%d}+"
HITS = "array<struct<start:int,n:int,items:array<string>>>"


def _spaced(text: Column) -> Column:
    """The words of ``text``, as they are, with single spaces; null has none."""
    return F.coalesce(F.trim(F.regexp_replace(text, _OTHER, " ")), F.lit(""))


def words(text: Column) -> Column:
    """Words of ``text``, A-Z lower-cased; a null text has none."""
    normal = F.translate(_spaced(text), UPPER, LOWER)
    return F.when(normal == "", F.array().cast("array<string>")).otherwise(F.split(normal, " "))


def word_count(text: Column) -> Column:
    """Number of words of ``text``."""
    spaced = _spaced(text)
    return F.when(spaced == "", 0).otherwise(F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit(""))) + 1).cast("long")


def text_key(text: Column) -> Column:
    """128-bit key of a text: two hashes with different seeds."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))


def test_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows of ``benchmark(item_id, text)``: phrase, terms, items.

    A window is ``window`` consecutive words of an item; an item of fewer words,
    but not none, is one window.  ``items`` holds the ids as strings, a null id
    as the empty string.
    """
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("w"))
    n = F.size("w")
    starts = F.sequence(F.lit(1), F.greatest(n - window + 1, F.lit(1)))
    cut = F.transform(starts, lambda i: F.slice("w", i, window))
    return (
        items.where(n > 0)
        .select("item", F.explode(cut).alias("terms"))
        .groupBy(F.array_join("terms", " ").alias("phrase"), "terms")
        .agg(F.collect_set("item").alias("items"))
    )


def cut_texts(docs: DataFrame) -> DataFrame:
    """Stored (key, cut): the words of every text with single spaces, the only pass that looks for words."""
    cut = docs.where("text IS NOT NULL").select(text_key(F.col("text")).alias("key"), F.translate(_spaced(F.col("text")), UPPER, LOWER).alias("cut"))
    return stored(cut.where("cut <> ''"), "cut-texts")


def term_counts(texts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Occurrences over all ``cut_texts`` of each term of ``vocabulary(term)``; absent ones are left out."""
    tokens = texts.select(F.explode(F.split("cut", " ")).alias("token"))
    return tokens.join(broadcast_within(vocabulary, TERM_BYTES), F.col("token") == F.col("term")).groupBy("term").agg(F.count("*").alias("n"))


def postings(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """Distinct (term, key, pos) of the terms of ``terms(term)`` over all ``cut_texts``."""
    tokens = texts.select("key", F.posexplode(F.split("cut", " ")).alias("pos", "token"))
    hits = tokens.join(broadcast_within(terms, TERM_BYTES), F.col("token") == F.col("term"))
    return hits.select("term", "key", "pos").distinct()


def rarest_terms(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """``windows`` with their two rarest terms and offsets: t1, o1, t2, o2.

    Windows with a term that the corpus lacks cannot occur and are dropped.  A
    window of one word has the same term twice.
    """
    known = counts.withColumnsRenamed({"term": "known", "n": "cf"})
    ranked = (
        windows.select("phrase", "terms", "items", F.posexplode("terms").alias("offset", "t"))
        .join(known, F.col("t") == F.col("known"))
        .groupBy("phrase", "terms", "items")
        .agg(F.array_sort(F.collect_list(F.struct("cf", "offset", "t"))).alias("by"))
        .where(F.size("by") == F.size("terms"))
    )
    first, second = F.get("by", F.lit(0)), F.coalesce(F.get("by", F.lit(1)), F.get("by", F.lit(0)))
    return ranked.select(
        "phrase", "terms", "items",
        first["t"].alias("t1"), first["offset"].alias("o1"), second["t"].alias("t2"), second["offset"].alias("o2"),
    )


def build_index(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored windows (with their rarest terms), postings of those terms, distinct (term, key, pos), and ``cut_texts``."""
    windows = stored(test_windows(benchmark, window), "windows")
    texts = cut_texts(docs)
    counts = stored(term_counts(texts, windows.select(F.explode("terms").alias("term")).distinct()), "term-counts")
    ranked = stored(rarest_terms(windows, counts), "ranked-windows")
    wanted = ranked.select(F.col("t1").alias("term")).union(ranked.select("t2")).distinct()
    index = stored(postings(texts, wanted), "postings")
    discard(windows, counts)
    return ranked, index, texts


def intersect(index: DataFrame, windows: DataFrame, slop: int = 0) -> DataFrame:
    """Distinct places (key, phrase, start, exact) where the two rarest terms of a window agree.

    The list of t1 shifted by o1 is intersected with that of t2 shifted by o2.
    ``start`` is t1's shifted position, and the place is exact if t2's is the same.
    With a ``slop`` both may stand that many words off their places, so up to twice
    as many apart.  Positions are dealt into cells so that it stays an equality join.
    """
    reach = 2 * slop
    cell = lambda pos: F.floor(pos / (reach + 1)).cast("int")
    near = F.array(*[cell(F.col("start") + F.col("o2")) + d for d in ((-1, 0, 1) if slop else (0,))])
    starts = (
        index.join(broadcast_within(windows.select("phrase", "t1", "o1", "t2", "o2"), WINDOW_BYTES), F.col("term") == F.col("t1"))
        .select("key", "phrase", (F.col("pos") - F.col("o1")).alias("start"), "t2", "o2")
        .where(F.lit(slop > 0) | (F.col("start") >= 0))
        .withColumn("cell", F.explode(near))
    )
    second = index.select(F.col("key").alias("key2"), F.col("term").alias("term2"), F.col("pos").alias("pos2"), cell(F.col("pos")).alias("cell2"))
    same = (F.col("key") == F.col("key2")) & (F.col("t2") == F.col("term2")) & (F.col("cell") == F.col("cell2"))
    off = F.col("pos2") - F.col("start") - F.col("o2")
    placed = starts.join(second, same & (F.abs(off) <= reach))
    return placed.groupBy("key", "phrase", "start").agg(F.max(off == 0).alias("exact"))


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = 0) -> tuple[DataFrame, DataFrame]:
    """Stored (key, phrase, start, n, exact) of every match of a test window in a text, and the stored windows.

    A match is a start from which each of the window's ``n`` terms stands within
    ``slop`` words of its place; it is ``exact`` if each stands in it.
    """
    windows, index, texts = build_index(docs, benchmark, window)
    places = stored(intersect(index, windows, slop).select("key", "phrase", "start"), "places")
    # all words of the texts with a place, once per text, in pieces that overlap by what a match may span
    keys = broadcast_within(places.select("key").distinct(), KEY_BYTES)
    held = texts.join(keys, "key", "left_semi").groupBy("key").agg(F.first("cut").alias("cut"))
    pieces = F.regexp_extract_all("cut", F.lit(_PIECES % (PIECE_WORDS + window + 4 * slop, PIECE_WORDS)), F.lit(1))
    pieces = held.select(F.col("key").alias("p_key"), F.posexplode(pieces).alias("p_piece", "words")).withColumn("words", F.split(F.trim("words"), " "))
    piece = F.floor(F.greatest(F.col("start") - 2 * slop, F.lit(0)) / PIECE_WORDS).cast("int")
    by_piece = places.withColumn("piece", piece).groupBy("key", "piece").agg(F.collect_list(F.struct("phrase", "start")).alias("places"))

    def found_at(p: Column) -> Column:
        """The matches among the starts near one place of the piece: every term near its place, and whether all are in theirs."""
        terms = F.transform(F.split(p["phrase"], " "), lambda t, i: F.struct(t.alias("t"), i.alias("i")))
        word = lambda start, x, off: F.coalesce(F.get("words", start - F.col("piece") * PIECE_WORDS + x["i"] + off) == x["t"], F.lit(False))

        def near(start: Column, x: Column) -> Column:
            return functools.reduce(operator.or_, [word(start, x, off) for off in range(-slop, slop + 1)])

        def match(shift: int) -> Column:
            start = p["start"] + shift
            exact = (start >= 0) & F.forall(terms, lambda x: word(start, x, 0))
            return F.when(F.forall(terms, lambda x: near(start, x)), F.struct(p["phrase"].alias("phrase"), start.alias("start"), F.size(terms).alias("n"), exact.alias("exact")))

        return F.array_compact(F.array(*[match(k) for k in range(-slop, slop + 1)]))

    met = by_piece.join(pieces, (F.col("key") == F.col("p_key")) & (F.col("piece") == F.col("p_piece")))
    found = stored(met.select("key", F.inline(F.flatten(F.transform("places", found_at)))).distinct(), "matches")
    discard(index, texts, places)
    return found, windows


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = 0, spans: bool = True) -> DataFrame:
    """``docs`` with n_words, n_hit, items, n_near and contaminated, and with ``spans`` also hits and near.

    ``n_hit`` words of the whole text stand in exact occurrences of test windows, those
    of the sorted ``items``, and any makes it ``contaminated``; ``n_near`` windows have a proximity match: a start
    from which every term of the window stands within ``slop`` words of its place; with a slop of 0 these
    are the exact ones.  ``hits`` lists (start, n, items) of every exact occurrence, ``near``
    (phrase, items) of the windows with a proximity match.
    Null texts have no words and no hits, repeated rows get
    equal results, an empty benchmark gives no hits, and texts of any length are
    compared whole.  A column of ``docs`` that bears one of the new names is replaced.
    """
    found, windows = matches(docs, benchmark, window, slop)
    items = broadcast_within(windows.select(F.col("phrase").alias("i_phrase"), F.col("items").alias("own")), WINDOW_BYTES)
    exact = found.where("exact")
    # covered words: each occurrence adds what lies behind the furthest end before it; the window is over one text
    furthest = F.max(F.col("start") + F.col("n")).over(Window.partitionBy("key").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    longest = exact.groupBy("key", "start").agg(F.max("n").alias("n")).withColumn("from", F.greatest(F.col("start"), F.coalesce(furthest, F.lit(0))))
    covered = longest.groupBy("key").agg(F.sum(F.greatest(F.col("start") + F.col("n") - F.col("from"), F.lit(0))).alias("n_hit"))
    with_items = lambda rows: rows.join(items, F.col("phrase") == F.col("i_phrase"))
    named = with_items(exact.select("key", "phrase").distinct()).groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("own")))).alias("items"))
    close = found.select("key", "phrase").distinct()
    parts = [covered, named, close.groupBy("key").agg(F.count("*").alias("n_near"))]
    if spans:
        parts.append(with_items(exact).groupBy("key").agg(F.collect_list(F.struct("start", "n", F.col("own").alias("items"))).alias("hits")))
        parts.append(with_items(close).groupBy("key").agg(F.collect_list(F.struct("phrase", F.col("own").alias("items"))).alias("near")))
    per_text = found.select("key").distinct()
    for part in parts:
        per_text = per_text.join(part, "key", "left")
    new = ["n_words", "n_hit", "items", "n_near", *(["hits", "near"] if spans else []), "contaminated"]
    # stored, so that its exchange is a join's own and Spark can split a text that very many rows share
    per_text = stored(per_text.select(F.col("key").alias("__key"), *[F.col(c).alias(f"__{c}") for c in new[1:-1]]), "contaminated-texts")
    discard(found, windows)
    joined = docs.withColumn("__text_key", text_key(F.col("text"))).join(per_text, F.col("__text_key") == F.col("__key"), "left")
    empty = {"items": "array<string>", "hits": HITS, "near": "array<struct<phrase:string,items:array<string>>>"}
    none = lambda c: F.array().cast(empty[c]) if c in empty else F.lit(0).cast("long")
    kept = [F.col(c) for c in docs.columns if c not in new]
    return joined.select(*kept, word_count(F.col("text")).alias("n_words"), *[F.coalesce(f"__{c}", none(c)).alias(c) for c in new[1:-1]], (F.coalesce("__n_hit", F.lit(0)) > 0).alias("contaminated"))


def hit_digest(hits: Column) -> dict[str, Column]:
    """n_hit, n_items and items_sha256 of a ``hits`` column."""
    covered = F.array_distinct(F.flatten(F.transform(hits, lambda h: F.sequence(h["start"], h["start"] + h["n"] - 1))))
    items = F.array_sort(F.array_distinct(F.flatten(F.transform(hits, lambda h: h["items"]))))
    return {
        "n_hit": F.size(covered).cast("long"),
        "n_items": F.size(items).cast("long"),
        "items_sha256": F.sha2(F.array_join(items, ",").cast("binary"), 256),
    }
