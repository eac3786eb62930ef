"""Alignment of two tokenizers over whole texts, and how often their tokens meet.

Both tokenizers cut the same bytes; a token's end is its byte offset.  Aligning two
token lists means finding the ends they share.  Most texts run along a diagonal for
long stretches, token for token, so the ends are compared at the present shift between
the two indices in blocks that double while they are equal (exponential probing) and
halve where they are not; the group that broke the run is resolved by moving whichever
side ends first, and the shift that it leaves is the next one probed.

A task tokenizes and aligns a document at a time and returns its distinct links.
Spark counts in how many documents a link occurs and gives the counts back to the
documents: links in many documents, few in number, by a broadcast of checked size,
the rest, each in few documents, by a shuffled join.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoquilt.storage import discard, stored

TOKENIZERS, BYTE_FILE, RANK_FILE, PIECE_FILE = "/opt/tokenizers", "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
#: How the byte tokenizer splits a text before its merges (a fixed value of the vocabulary).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A space in pieces, and pieces that stand for one byte.
SPACE, BYTE_PIECE = "▁", re.compile(r"<0x([0-9A-F]{2})>")
#: Links in this many documents or more are looked up in a broadcast, if so many rows of them are all.
FREQUENT, BROADCAST_ROWS = 16, 1 << 20
#: A link is a pair of token ids in one number.
ID_BASE = 1 << 31
ROWS_DDL = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<bigint>, times array<int>"


def _byte_symbols() -> dict[str, int]:
    """The printable symbol of every byte in a byte-level vocabulary: itself if it is printable, else the next free one from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Tokenizers:
    """Both tokenizers of a folder, with the bytes of every token.

    The byte tokenizer runs from the rank file of the same vocabulary, which is
    several times as fast; its ids are translated to those of the json file by
    their bytes.
    """

    folder: str

    def __post_init__(self) -> None:
        import sentencepiece
        import tiktoken

        symbols = _byte_symbols()
        with open(f"{self.folder}/{BYTE_FILE}", encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"] for t in spec.get("added_tokens", ())}
        known = {i: bytes(symbols[c] for c in t) for t, i in spec["model"]["vocab"].items() if t not in special}
        with open(f"{self.folder}/{RANK_FILE}", "rb") as f:
            ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
        ids = {t: i for i, t in known.items()}
        self.id_of_rank = [ids[t] for t, _ in sorted(ranks.items(), key=lambda x: x[1])]
        self.same_ids = self.id_of_rank == list(range(len(ranks)))
        self.ranked = tiktoken.Encoding("byte_bpe_50k", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=f"{self.folder}/{PIECE_FILE}")
        p = self.pieces
        texts = [p.id_to_piece(i) for i in range(p.get_piece_size())]
        self.bytes_a = [known.get(i, b"") for i in range(max(known) + 1)]
        self.bytes_b = [bytes([int(BYTE_PIECE.fullmatch(t)[1], 16)]) if p.is_byte(i) else t.replace(SPACE, " ").encode() for i, t in enumerate(texts)]
        self.sizes_a, self.sizes_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        self.text_a, self.text_b = (list(map(str, range(len(x)))) for x in (self.bytes_a, self.bytes_b))

    def encode(self, text: str) -> tuple[list[int], list[int], list[int], list[int]] | None:
        """Ids of both, and the ends of their tokens, in the bytes of the space and ``text``; null if joined bytes differ."""
        a = self.ranked.encode_ordinary(" " + text)
        if not self.same_ids:
            a = [self.id_of_rank[r] for r in a]
        b = self.pieces.encode(text)
        if not b"".join(map(self.bytes_a.__getitem__, a)) == b"".join(map(self.bytes_b.__getitem__, b)) == b" " + text.encode():
            return None
        return a, b, self.sizes_a[a].cumsum().tolist(), self.sizes_b[b].cumsum().tolist()


@lru_cache(maxsize=2)
def tokenizers(folder: str) -> Tokenizers:
    """The tokenizers of a folder, loaded once by each worker."""
    return Tokenizers(folder)


def run_length(ends_a: list[int], ends_b: list[int], i: int, j: int) -> int:
    """How many ends from ``i`` and ``j`` on agree at this shift, by blocks that double, then halve."""
    k, width, left = 0, 1, len(ends_a) - i
    while k < left and ends_a[i + k : i + k + width] == ends_b[j + k : j + k + width]:
        k, width = k + width, 2 * width
    if k >= left:
        return left  # both lists end here, since their last ends agree
    while width > 1:
        width //= 2
        if ends_a[i + k : i + k + width] == ends_b[j + k : j + k + width]:
            k += width
    return k


def align(a: list[int], b: list[int], ends_a: list[int], ends_b: list[int], text_a: list[str], text_b: list[str]) -> tuple[int, str, list[int], list[int]]:
    """Number of groups, their text ``a1,a2|b1;...``, and the two ids of every link in order.

    ``text_a`` and ``text_b`` hold every id as text; both lists of ends reach the same offset.
    Tokens of a group link where their bytes overlap; within a group no inner
    ends agree, so each step along it gives one link.
    """
    groups: list[str] = []
    link_a: list[int] = []
    link_b: list[int] = []
    i = j = 0
    n = len(a)
    while i < n:
        x, y = ends_a[i], ends_b[j]
        if x == y:
            k = run_length(ends_a, ends_b, i, j)
            run_a, run_b = a[i : i + k], b[j : j + k]
            groups += [f"{text_a[p]}|{text_b[q]}" for p, q in zip(run_a, run_b)]  # noqa: B905
            link_a += run_a
            link_b += run_b
            i, j = i + k, j + k
            continue
        first_a, first_b = i, j
        while x != y:
            link_a.append(a[i])
            link_b.append(b[j])
            if x < y:
                i += 1
                x = ends_a[i]
            else:
                j += 1
                y = ends_b[j]
        link_a.append(a[i])
        link_b.append(b[j])
        i, j = i + 1, j + 1
        groups.append(",".join([text_a[p] for p in a[first_a:i]]) + "|" + ",".join([text_b[q] for q in b[first_b:j]]))
    return len(groups), ";".join(groups), link_a, link_b


def aligned_rows(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The task: batches of (row, doc_id, text) to rows with the distinct links of each text and how often they occur."""

    def one(text: str | None) -> tuple:
        both = tokenizers(folder)
        found = both.encode(text) if text else None
        if found is None:
            return 0, 0, 0, 0, "", [], []
        a, b = found[:2]
        n, groups, link_a, link_b = align(*found, both.text_a, both.text_b)
        links, times = np.unique(np.array(link_a, np.int64) * ID_BASE + np.array(link_b, np.int64), return_counts=True)
        return len(a), len(b), n, len(link_a), hashlib.sha256(groups.encode()).hexdigest(), links, times.astype(np.int32)

    kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32())]
    names = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                columns = zip(*[one(t.as_py()) for t in part.column("text")], strict=True)
                arrays = [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), *arrays], ["row", "doc_id", *names])

    return run


def token_alignment(docs: DataFrame, folder: str = TOKENIZERS, frequent: int = FREQUENT, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of ``docs(doc_id, text)``.

    The first tokenizer reads the space and the text, the second adds the space itself.
    A link's count is the number of rows that hold it; it is a best one if no other
    link of its first id has a higher count.  Null and empty texts, and those that the
    tokens do not give back byte for byte, have no tokens: zeros and an empty string.
    Repeated rows and ids count as often as they stand there, texts of any length are
    read whole, an empty table gives an empty result, other columns are not read.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = stored(rows.mapInArrow(aligned_rows(folder), ROWS_DDL), "alignments")
    links = rows.select("row", F.col("links").alias("link"), "times").select("row", F.inline(F.arrays_zip("link", "times")))
    counts = stored(rows.select(F.explode("links").alias("link")).groupBy("link").agg(F.count("*").alias("docs")), "link-counts")
    first = F.shiftright(F.col("link"), 31)
    highest = counts.groupBy(first.alias("a")).agg(F.max("docs").alias("most"))
    judged = counts.join(highest, first == F.col("a")).select(F.col("link").alias("c_link"), "docs", (F.col("docs") == F.col("most")).alias("best"))
    judged = stored(judged, "judged-links")
    discard(counts)
    # all links if they are few enough, else the least bound from which they are
    n = n_all = judged.count()
    bound = 0
    while n > broadcast_rows:
        bound = max(frequent, 4 * bound)
        n = judged.where(F.col("docs") >= bound).count()
    common = F.broadcast(judged.where(F.col("docs") >= bound))
    met = links.join(common, F.col("link") == F.col("c_link"), "left")

    def value(table: DataFrame) -> DataFrame:
        return table.select("row", F.when(F.col("best"), F.col("times")).otherwise(0).cast("long").alias("best"), (F.col("docs") * F.col("times")).alias("sum"))

    found = value(met.where("c_link IS NOT NULL"))
    if n < n_all:
        rare = judged.where(F.col("docs") < bound)
        found = found.unionByName(value(met.where("c_link IS NULL").select("row", "link", "times").join(rare, F.col("link") == F.col("c_link"))))
    sums = found.groupBy(F.col("row").alias("s_row")).agg(F.sum("best").alias("n_best"), F.sum("sum").alias("count_sum"))
    return rows.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(sums, F.col("row") == F.col("s_row"), "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256"
    )
