"""Divergence of sources within a language, by in-mapper stripes.

A stripe belongs to a term of a language and holds, for each source, the documents
with the term and its occurrences there.  Every task folds whole documents into a
hash table of stripes and spills them as rows when the table is full, so that a term
leaves a task once a spill, however often it occurs.  Stripes are dealt by (language,
term) and merged: the exchange satisfies both sums, over sources and over terms.
Groups of merged stripes of bounded number, each with the totals of its language's
sources beside it, give the divergences at once: per pair of sources the sum over
the group's terms, per source its highest terms.  What then remains is to add up the
groups' sums and to rank.

All arithmetic is in whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoquilt.storage import discard, stored

#: Letters and everything beyond ASCII; A-Z are lower-cased, what is between words becomes a space.
_TO_TERM = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
#: Counts in a task's table before it spills, and bytes of a text cut into terms at a time.
TABLE_ENTRIES, PIECE_BYTES = 200_000, 1 << 20
#: Stripes handed to a task at a time, and cells of the table of their shares.
GROUP_STRIPES, BLOCK_CELLS = 4096, 1 << 18
MIN_DOCUMENTS, SMOOTHING, GRAIN, TOP_TERMS = 30, 5, 1_000_000_000, 50

FOLDED = pa.schema([("lang", pa.string()), ("term", pa.string()), ("stripe", pa.list_(pa.struct([("source", pa.string()), ("docs", pa.int64()), ("n", pa.int64())])))])
FOLDED_DDL = "lang string, term string, stripe array<struct<source:string,docs:bigint,n:bigint>>"
EMITTED_DDL = "lang string, source string, part string, item string, value long"


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text, in pieces that end between terms."""
    at = 0
    while at < len(text):
        piece = text[at : at + PIECE_BYTES].translate(_TO_TERM)
        if at + PIECE_BYTES < len(text) and (end := piece.rfind(b" ")) >= 0:
            piece = piece[: end + 1]
        elif at + PIECE_BYTES < len(text):  # a term longer than a piece: look for its end
            end = text[at:].translate(_TO_TERM).find(b" ")
            piece = text[at : at + end + 1 if end >= 0 else len(text)].translate(_TO_TERM)
        yield piece.split()
        at += len(piece)


def _spill(table: dict) -> pa.RecordBatch:
    """Rows of all stripes of a task's table."""
    keys = list(table)
    stripes = [[{"source": s, "docs": c[0], "n": c[1]} for s, c in table[k].items()] for k in keys]
    terms = [None if t is None else t.decode() for _, t in keys]
    return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array(terms, pa.string()), pa.array(stripes, FOLDED.field("stripe").type)], schema=FOLDED)


def fold(table_entries: int = TABLE_ENTRIES):
    """The task: batches of (lang, source, text) to spilled stripes; a null term stands for the group itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, entries = {}, 0
        for batch in batches:
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                counts: dict[bytes | None, int] = {None: 0}
                for piece in terms_of(text.encode()):
                    for t in piece:
                        counts[t] = counts.get(t, 0) + 1
                for t, n in counts.items():
                    stripe = table.setdefault((lang, t), {})
                    if (cell := stripe.get(source)) is None:
                        stripe[source] = [1, n]
                        entries += 1
                    else:
                        cell[0] += 1
                        cell[1] += n
                if entries >= table_entries:
                    yield _spill(table)
                    table, entries = {}, 0
        if table:
            yield _spill(table)

    return run


def stripes(docs: DataFrame, table_entries: int = TABLE_ENTRIES) -> DataFrame:
    """Merged stripes of all rows of ``docs(text, lang, source)``: lang, term, docs, stripe of (source, n).

    Null text, lang and source count as empty.  The row of a null term lists all
    sources of a language.  One exchange by (lang, term) serves both sums.
    """
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    spilled = rows.mapInArrow(fold(table_entries), FOLDED_DDL).repartition("lang", "term")
    merged = spilled.select("lang", "term", F.inline("stripe")).groupBy("lang", "term", "source").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    return merged.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("stripe"))


def shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """1 + floor(GRAIN * counts / totals) in whole numbers, three digits at a time, for totals below 2**53."""
    base, left = 1000, GRAIN
    whole, rest = counts // totals, counts % totals
    while left > 1:
        rest = rest * base
        whole = whole * base + rest // totals
        rest, left = rest % totals, left // base
    return whole + 1


def emit(top: int = TOP_TERMS):
    """The task: the stripes of a group and its language's totals to sums per pair of sources and the highest terms per source."""

    def run(key: tuple, found: pa.Table, totals: pa.Table) -> pa.Table:
        lang = key[0].as_py()
        v = totals.column("n_terms")[0].as_py()
        names = [g["source"] for g in totals.column("groups")[0].as_py()]
        place = {s: i for i, s in enumerate(names)}
        sizes = np.array([g["n"] for g in totals.column("groups")[0].as_py()], np.int64)
        whole = int(sizes.sum()) + SMOOTHING * v
        own = sizes + SMOOTHING * v
        sums = np.zeros((len(names), len(names)), np.int64)
        best: list[list[tuple[int, str]]] = [[] for _ in names]
        step = max(1, BLOCK_CELLS // max(1, len(names)))
        for at in range(0, found.num_rows, step):
            part = found.slice(at, step)
            terms = part.column("term").to_pylist()
            counts = np.zeros((len(terms), len(names)), np.int64)
            for i, stripe in enumerate(part.column("stripe").to_pylist()):
                for c in stripe:
                    counts[i, place[c["source"]]] = c["n"]
            p = shares(counts + SMOOTHING, own)
            for s in range(len(names) - 1):
                sums[s, s + 1 :] += np.abs(p[:, s + 1 :] - p[:, s : s + 1]).sum(0)
            over = np.where(counts > 0, p - shares(counts.sum(1, keepdims=True) + SMOOTHING, np.array([[whole]])), 0)
            for s in range(len(names)):
                rows = np.flatnonzero(over[:, s] > 0)
                best[s] = sorted(best[s] + [(-int(over[i, s]), terms[i]) for i in rows], key=lambda x: (x[0], x[1].encode()))[:top]
        rows = [(lang, names[s], "pair", names[t], int(sums[s, t])) for s in range(len(names)) for t in range(s + 1, len(names))]
        rows += [(lang, names[s], "term", t, -d) for s in range(len(names)) for d, t in best[s]]
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        return pa.table({n: pa.array(c, pa.int64() if n == "value" else pa.string()) for n, c in zip(("lang", "source", "part", "item", "value"), columns, strict=True)})

    return run


def divergences(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, top: int = TOP_TERMS, table_entries: int = TABLE_ENTRIES, group_stripes: int = GROUP_STRIPES) -> DataFrame:
    """(lang, source, part, item, value, rank) of every source of every language of ``docs(text, lang, source)``.

    Part ``pair`` ranks the other sources of the language by the summed differences of
    their shares of all kept terms, part ``term`` the ``top`` terms that the source uses
    more than its language.  Kept are the terms in ``min_documents`` documents of the
    language at least.  Null text, lang and source count as empty, repeated rows count
    as often as they stand there, a language without kept terms gives pairs of value 0,
    one with a single source gives no pairs, an empty table gives no rows.  Texts of
    any length are read whole; other columns are not read.
    """
    merged = stored(stripes(docs, table_entries), "stripes")
    kept = merged.where(F.col("term").isNotNull() & (F.col("docs") >= min_documents))
    used = kept.select("lang", F.inline("stripe")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    known = merged.where(F.col("term").isNull()).select(F.col("lang").alias("k_lang"), F.explode("stripe.source").alias("k_source"))
    sized = known.join(used, (F.col("lang") == F.col("k_lang")) & (F.col("source") == F.col("k_source")), "left")
    groups = sized.groupBy(F.col("k_lang").alias("lang")).agg(F.array_sort(F.collect_list(F.struct(F.col("k_source").alias("source"), F.coalesce("n", F.lit(0)).cast("long").alias("n")))).alias("groups"))
    n_terms = kept.groupBy(F.col("lang").alias("v_lang")).agg(F.count("*").alias("n_terms"))
    parts = F.greatest(F.ceil(F.coalesce("n_terms", F.lit(0)) / group_stripes), F.lit(1)).cast("int")
    totals = stored(groups.join(n_terms, F.col("lang") == F.col("v_lang"), "left").select("lang", "groups", F.coalesce("n_terms", F.lit(0)).alias("n_terms"), parts.alias("parts")), "totals")
    dealt = kept.join(totals.select(F.col("lang").alias("t_lang"), "parts"), F.col("lang") == F.col("t_lang")).select(
        "lang", F.pmod(F.xxhash64("term"), F.col("parts")).cast("int").alias("slice"), "term", "stripe"
    )
    heads = totals.select("lang", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("slice"), "groups", "n_terms")
    emitted = stored(dealt.groupBy("lang", "slice").cogroup(heads.groupBy("lang", "slice")).applyInArrow(emit(top), EMITTED_DDL), "divergences")
    discard(merged, totals)
    pairs = emitted.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.unionByName(pairs.select("lang", F.col("item").alias("source"), "part", F.col("source").alias("item"), "value"))
    return _ranked(pairs).unionByName(_ranked(emitted.where("part = 'term'")).where(F.col("rank") <= top))


def _ranked(rows: DataFrame) -> DataFrame:
    order: list[Column] = [F.col("value").desc(), F.col("item")]
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(*order)))
