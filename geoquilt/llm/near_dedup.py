"""Near duplicates by DartMinHash signatures and banded joins.

A text is a weighted set: its shingles of five words with their counts.  The
weight axis of every shingle is cut into regions [0,1), [1,2), [2,4), ...; into
each region hashed darts fall as a Poisson process in rank.  Darts below a
shingle's weight hit the set.  Each dart has a coordinate, and the earliest hit
of a coordinate is its value, so two texts agree on a coordinate with the
probability of their weighted Jaccard similarity.  Only ranks up to a limit set
by the total weight are drawn, about k*(ln k + 2) darts a text.

Bands of coordinates are buckets.  Pairs are never made of a bucket.  First each
text is compared with the head of each of its buckets, the text that shares its
buckets with most others and so stands in the middle of its copies; this is linear,
and what is linked is contracted.  Buckets in which texts of two or more components remain go
through rounds: a growing number of their texts are heads, every chunk of a bucket
meets them once, heads are then done with, and what is linked is contracted again,
until no bucket holds two texts that are neither connected nor compared.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoquilt.llm.runs import runs
from geoquilt.llm.shingles import ShingleSets, mix, shingle_sets, similarities
from geoquilt.operators.components import components
from geoquilt.storage import broadcast_within, discard, stored

SIMILARITY = 0.8
BANDS, ROWS = 25, 5
K = BANDS * ROWS
#: Texts that one task compares with the heads of a bucket, or with one text, at a time.
CHUNK = 256
#: Heads of a bucket in the first round after the stars, and how many times as many in each further one.
HEADS, GROWTH = 64, 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_OTHER = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_A_WORD = r"[0-9A-Za-z]|[^\x00-\x7F]"
_U = np.uint64
#: Pairs below this share of agreeing signature bytes are four standard deviations below the similarity.
_CUT = SIMILARITY - 4 * (SIMILARITY * (1 - SIMILARITY) / K) ** 0.5


def normal_text(text: Column) -> Column:
    """Lower-cased words (digits, a-z and everything beyond ASCII) with single spaces; a null text has none."""
    return F.coalesce(F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), _OTHER, " ")), F.lit(""))


def node(normal: Column) -> Column:
    """128-bit id of a normal text: two hashes with different seeds."""
    return F.struct(F.xxhash64(normal).alias("a"), F.xxhash64(F.lit(1), normal).alias("b"))


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53


def _darts(region: np.ndarray, low: np.ndarray, size: np.ndarray, weight: np.ndarray, owner: np.ndarray, limit: np.ndarray) -> tuple:
    """(rank, dart, owner) of the darts of rank up to ``limit[owner]`` that fall below the regions' weights."""
    found: list[tuple] = []
    few = limit[owner] * size < 0.5
    for part, m in ((few, 1), (~few, 4)):  # darts drawn at once
        seed, lo, sz, w, own = (x[part] for x in (region, low, size, weight, owner))
        rank, step = np.zeros(len(seed)), 1
        while len(seed):
            m = max(m, min(64, 4096 // len(seed)))
            h = mix(seed[:, None] + np.arange(step, step + m).astype(_U)[None] * _U(0xD1B54A32D192ED03))
            r = rank[:, None] + np.cumsum(-np.log(_uniform(h)) / sz[:, None], axis=1)
            d = mix(h ^ _U(0x8CB92BA72F3D8DD7))
            top = limit[own][:, None]
            hit = (r <= top) & (lo[:, None] + _uniform(d) * sz[:, None] < w[:, None])
            found.append((r[hit], mix(d[hit]), np.broadcast_to(own[:, None], hit.shape)[hit]))
            on = r[:, -1] <= top[:, 0]
            seed, lo, sz, w, own, rank, step = seed[on], lo[on], sz[on], w[on], own[on], r[on, -1], step + m
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def dart_minhash(items: np.ndarray, counts: np.ndarray, owner: np.ndarray, n: int, k: int = K) -> np.ndarray:
    """The earliest dart of each of ``k`` coordinates for ``n`` sets of weighted items; zeros for an empty set."""
    sig, best = np.zeros(n * k, _U), np.full(n * k, np.inf)
    levels = np.ceil(np.log2(np.maximum(counts, 1))).astype(int) + 1  # regions that a weight reaches into
    at = np.repeat(np.arange(len(items)), levels)
    level = np.arange(len(at)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level > 0, 2.0 ** (level - 1), 0.0)
    regions = (mix(items[at] + level.astype(_U) * _U(0x9E3779B97F4A7C15)), low, np.maximum(low, 1.0), counts[at].astype(float), owner[at])
    total = np.bincount(owner, counts, n) if len(owner) else np.zeros(n)
    limit = k * (np.log(k) + 2) / np.maximum(total, 1)
    open_sets = total > 0
    while open_sets.any():
        now = open_sets[regions[4]]
        rank, dart, own = _darts(*(x[now] for x in regions), limit)
        key = own * k + ((dart >> _U(8)) % _U(k)).astype(np.int64)
        np.minimum.at(best, key, rank)
        first = rank == best[key]
        sig[key[first]] = dart[first]
        # a coordinate was missed: draw on, the earlier darts stay the same
        open_sets &= np.isinf(best.reshape(n, k)).any(1)
        limit[open_sets] *= 1.5
    return sig.reshape(n, k)


def bands_of(sig: np.ndarray) -> np.ndarray:
    """One bucket key per text and band."""
    key = np.broadcast_to(np.arange(1, BANDS + 1).astype(_U), (len(sig), BANDS))
    for column in np.moveaxis(sig.reshape(-1, BANDS, ROWS), 2, 0):
        key = mix(key ^ column) + _U(1)
    return key.view(np.int64)


def prefix_of(sets: ShingleSets, least: float) -> list[np.ndarray]:
    """Bucket keys of the exact mode: the first occurrences, in hash order, one of which similar texts must share.

    The k-th occurrence of a shingle is an item of its own.  Two sets of which
    ``least`` of the union is common share an item among the first
    ``n - ceil(least * n) + 1`` of each, in any order that both follow.
    """
    at = np.repeat(np.arange(len(sets.items)), sets.counts)
    turn = np.arange(len(at)) - np.repeat(np.cumsum(sets.counts) - sets.counts, sets.counts)
    keys = mix(sets.items[at] + turn.astype(_U) * _U(0xD6E8FEB86659FD93))
    ends = np.concatenate([[0], np.cumsum(sets.weight)])
    sizes = sets.weight - np.ceil(least * sets.weight - 1e-9).astype(int) + 1
    return [np.sort(keys[ends[d] : ends[d + 1]])[: sizes[d] if sets.weight[d] else 0].view(np.int64) for d in range(len(sets.weight))]


SIGNED = pa.struct([("buckets", pa.list_(pa.int64())), ("sketch", pa.binary()), ("weight", pa.int64())])


def _signed(normal: Column, exact: bool, least: float) -> Column:
    """(buckets, sketch, weight) of normal texts; no buckets for one without words."""

    @F.arrow_udf("struct<buckets:array<bigint>,sketch:binary,weight:bigint>")
    def sign(texts: pa.Array) -> pa.Array:
        buckets, sizes, sketches, weights = [np.zeros(0, np.int64)], [0], [b""], [np.zeros(0, np.int64)]
        for _, sets in shingle_sets(texts):
            n = len(sets.weight)
            weights.append(sets.weight)
            sig = np.zeros((n, 0), _U) if exact else dart_minhash(sets.items, sets.counts, sets.owner, n)
            sketches.append((sig & _U(255)).astype(np.uint8).tobytes())
            if exact:
                keys = prefix_of(sets, least)
                buckets += keys
                sizes += [len(x) for x in keys]
            else:
                full = sets.weight > 0
                buckets.append(bands_of(sig[full]).ravel())
                sizes += np.where(full, BANDS, 0).tolist()
        width = 0 if exact else K
        ends = np.arange(len(texts) + 1, dtype=np.int32) * width
        sketch = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(ends), pa.py_buffer(b"".join(sketches))])
        lists = pa.ListArray.from_arrays(np.cumsum(sizes).astype(np.int32), np.concatenate(buckets))
        return pa.StructArray.from_arrays([lists, sketch, np.concatenate(weights)], fields=list(SIGNED))

    return sign(normal)


# --- comparing ----------------------------------------------------------------

NODE = "struct<a:bigint,b:bigint>"
_NODE = pa.struct([("a", pa.int64()), ("b", pa.int64())])
PAIR = pa.schema([("u", _NODE), ("v", _NODE), ("cu", _NODE), ("cv", _NODE)])
PAIR_DDL = f"u {NODE}, v {NODE}, cu {NODE}, cv {NODE}"


def _nodes(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.StructArray.from_arrays([a, b], fields=list(_NODE))


def _checked(least: float):
    """Pairs that are similar, of batches sorted by (v, chunk) with the text of v itself in front."""

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, head = None, None
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            leads = np.asarray(batch.column("member")) == 0
            parts = iter(runs(batch, ("v", "chunk")))
            run = next(parts, None)
            for at, sets in shingle_sets(batch.column("normal")):
                upto = at + len(sets.weight)
                while run is not None and run[1] < upto:
                    key, a, b = run
                    low, high = max(a, at), min(b, upto)
                    if key != current:
                        current, head = key, None
                    if leads[low]:
                        head = tuple(x.copy() for x in sets.of(low - at))
                        low += 1
                    if low < high:
                        keep[low:high] = similarities(head, sets, np.arange(low - at, high - at)) >= least
                    if b > upto:
                        break
                    run = next(parts, None)
            kept = batch.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([_nodes(*kept.column(c).flatten()) for c in PAIR.names], schema=PAIR)

    return check


def _similar(pairs: DataFrame, members: DataFrame, least: float) -> DataFrame:
    """The stored ``pairs(u, v, cu, cv)`` whose texts are similar.

    The pairs of one ``v`` are dealt into chunks by their count, and each chunk
    gets the text of ``v`` once, so a ``v`` of very many pairs is many groups.
    """
    # stored, so that the join has an exchange of its own and Spark can split a head of very many pairs
    counts = stored(pairs.groupBy(F.col("v").alias("cv_v")).agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")), "pair-counts")
    dealt = pairs.join(counts, F.col("v") == F.col("cv_v")).withColumn("chunk", F.pmod(F.xxhash64("u"), F.col("chunks")).cast("int"))
    text = members.select(F.col("node").alias("m"), "normal")
    tails = dealt.join(text, F.col("u") == F.col("m")).select("v", "chunk", F.lit(1).alias("member"), "u", "cu", "cv", "normal")
    heads = counts.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).join(text, F.col("cv_v") == F.col("m"))
    heads = heads.select(F.col("cv_v").alias("v"), "chunk", F.lit(0).alias("member"), "m", "m", "m", "normal")
    rows = tails.unionAll(heads.toDF(*tails.columns)).repartition("v", "chunk").sortWithinPartitions("v", "chunk", "member")
    return stored(rows.mapInArrow(_checked(least), PAIR_DDL), "similar")


def _met(cut: float, least: float):
    """Links of the chunks of each bucket with its heads; rows are sorted by (bucket, chunk) with the heads in front.

    Weights and signatures rule pairs out before shingles are counted.  A pair that
    shares several bands is compared in the first of them only.
    """

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, heads = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.stack([np.asarray(c) for name in ("node", "comp") for c in batch.column(name).flatten()], 1)
            weight, lead = np.asarray(batch.column("weight")), np.asarray(batch.column("member")) == 0
            bucket = np.asarray(batch.column("bucket"))
            sketch = np.stack([np.frombuffer(x, np.uint8) for x in batch.column("sketch").to_pylist()])
            bands = np.asarray(batch.column("bands").flatten()).reshape(len(bucket), -1)
            found, parts = [], iter(runs(batch, ("bucket", "chunk")))
            part = next(parts, None)
            for at, sets in shingle_sets(batch.column("normal")):
                upto = at + len(sets.weight)
                while part is not None and part[1] < upto:
                    key, a, b = part
                    a, b = max(a, at), min(b, upto)
                    if key != current:
                        current, heads = key, []
                    split = a + int(lead[a:b].sum())  # heads come first
                    heads += [(ids[i], weight[i], sketch[i], bands[i], tuple(x.copy() for x in sets.of(i - at))) for i in range(a, split)]
                    for h_ids, h_weight, h_sketch, h_bands, h_set in heads if split < b else ():
                        rest = slice(split, b)
                        near = (ids[rest, 2:] != h_ids[2:]).any(1) & (ids[rest, :2] != h_ids[:2]).any(1)
                        near &= np.minimum(h_weight, weight[rest]) >= (least - 1e-12) * np.maximum(h_weight, weight[rest])
                        if bands.shape[1]:
                            near &= (sketch[rest] == h_sketch).mean(1) >= cut
                            same = bands[rest] == h_bands
                            near &= bands[rest][np.arange(b - split), same.argmax(1)] == bucket[rest]
                        if len(texts := split + np.flatnonzero(near)):
                            texts = texts[similarities(h_set, sets, texts - at) >= least]
                            own = np.broadcast_to(h_ids, (len(texts), 4))
                            found.append(np.concatenate([ids[texts, :2], own[:, :2], ids[texts, 2:], own[:, 2:]], 1))
                    if part[2] > upto:
                        break
                    part = next(parts, None)
            if found:
                flat = np.concatenate(found)
                yield pa.RecordBatch.from_arrays([_nodes(*(pa.array(flat[:, k]) for k in (2 * c, 2 * c + 1))) for c in range(4)], schema=PAIR)

    return meet


def _links_of_round(alive: DataFrame, heads: DataFrame, members: DataFrame, cut: float, least: float) -> DataFrame:
    """Stored links between the texts of each bucket and its ``heads(bucket, node)`` of other components."""
    sizes = stored(alive.groupBy(F.col("bucket").alias("b")).agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")), "bucket-sizes")
    text = members.select(F.col("node").alias("m"), "sketch", "bands", "normal")
    columns = ("bucket", "chunk", "member", "node", "comp", "weight", "sketch", "bands", "normal")
    sized = alive.join(sizes, F.col("bucket") == F.col("b"))
    tails = sized.withColumns({"chunk": F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"), "member": F.lit(1)})
    lead = sized.join(heads, ["bucket", "node"], "left_semi")
    lead = lead.withColumns({"chunk": F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)), "member": F.lit(0)})
    both = tails.select(*columns[:6]).unionAll(lead.select(*columns[:6]))
    rows = both.join(text, F.col("node") == F.col("m")).select(*columns)
    rows = rows.repartition("bucket", "chunk").sortWithinPartitions("bucket", "chunk", "member")
    return stored(rows.mapInArrow(_met(cut, least), PAIR_DDL), "links-of-round")


def _unsettled(alive: DataFrame) -> DataFrame:
    """The rows of buckets in which two or more components remain, stored."""
    ends = alive.groupBy(F.col("bucket").alias("b")).agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
    return stored(alive.join(stored(ends.select("b"), "open-buckets"), F.col("bucket") == F.col("b"), "left_semi"), "alive")


def links(docs: DataFrame, exact: bool = False, least: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Stored texts (doc_id, node, raw) and links (u, v) that connect the nodes of ``docs(doc_id, text)``.

    With ``exact`` the buckets are the prefixes of the shingle sets, which
    similar texts always share, and no signature is looked at.
    """
    cut = -1.0 if exact else least - (SIMILARITY - _CUT)
    normal = docs.select("doc_id", F.xxhash64("text").alias("raw"), normal_text(F.col("text")).alias("normal"))
    keyed = normal.withColumn("node", node(F.col("normal")))
    signed = stored(keyed.withColumn("s", _signed(F.col("normal"), exact, least)).select("doc_id", "node", "raw", "s.*"), "signatures")
    rows = signed.select("node", "weight", F.explode("buckets").alias("bucket"))
    ends = [f(F.col(f"node.{x}")).alias(f"{x}{k}") for x in "ab" for k, f in enumerate((F.min, F.max))]
    shared = rows.groupBy(F.col("bucket").alias("shared")).agg(*ends).where("a0 <> a1 OR b0 <> b1")
    entries = rows.join(stored(shared.select("shared"), "shared-buckets"), F.col("bucket") == F.col("shared")).select("bucket", "node", "weight").distinct()
    entries = stored(entries, "entries")
    crowds = entries.groupBy(F.col("bucket").alias("b")).agg(F.count("*").alias("n"))
    crowd = entries.join(crowds, F.col("bucket") == F.col("b")).groupBy(F.col("node").alias("n")).agg(F.sum("n").alias("crowd"))
    alive = entries.join(crowd, F.col("node") == F.col("n")).select("bucket", "node", "weight", "crowd", F.col("node").alias("comp"))
    alive = stored(alive, "entries")
    wanted = stored(alive.select(F.col("node").alias("n")).distinct(), "candidate-nodes")
    bands = F.first("buckets" if not exact else F.array().cast("array<bigint>")).alias("bands")
    picked = signed.join(wanted, F.col("node") == F.col("n")).groupBy("node").agg(F.min(F.struct("doc_id", "raw")).alias("rep"), F.first("sketch").alias("sketch"), bands)
    picked = picked.select("node", "sketch", "bands", F.col("rep.doc_id").alias("rep_id"), F.col("rep.raw").alias("rep_raw"))
    raws = docs.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("raw"), "text")
    texts = raws.join(broadcast_within(picked, 600), (F.col("raw") == F.col("rep_raw")) & F.col("d").eqNullSafe(F.col("rep_id")))
    members = stored(texts.select("node", "sketch", "bands", normal_text(F.col("text")).alias("normal")).dropDuplicates(["node"]), "members")

    # every text with the head of each of its buckets
    heads = stored(alive.groupBy(F.col("bucket").alias("hb")).agg(F.max(F.struct("crowd", "node", "weight")).alias("head")), "heads")
    near = F.least("weight", "head.weight") / F.greatest("weight", "head.weight") >= least - 1e-12
    stars = alive.join(heads, F.col("bucket") == F.col("hb")).where((F.col("node") != F.col("head.node")) & near)
    pairs = stored(stars.select(F.col("node").alias("u"), F.col("head.node").alias("v")).distinct().withColumns({"cu": F.col("u"), "cv": F.col("v")}), "stars")
    heads = heads.select(F.col("hb").alias("bucket"), "head.node")
    found, n_heads = [_similar(pairs, members, least)], HEADS
    while True:
        alive = alive.join(heads, ["bucket", "node"], "left_anti")  # compared with all others of their bucket
        if len(found) == 1 or 100 * found[-1].count() > alive.count():  # fewer links spare no work
            joined = stored(components(found[-1].select(F.col("cu").alias("u"), F.col("cv").alias("v"))).toDF("old", "new"), "joined")
            alive = alive.join(joined, F.col("comp") == F.col("old"), "left").withColumn("comp", F.coalesce("new", "comp")).drop("old", "new")
        alive = _unsettled(alive)
        if alive.isEmpty():
            break
        salt = F.pmod(F.xxhash64(F.lit(n_heads), "node"), F.lit(n_heads))
        heads = stored(alive.groupBy("bucket", salt.alias("salt")).agg(F.max(F.struct("crowd", "node"))["node"].alias("node")).drop("salt"), "heads")
        found.append(_links_of_round(alive, heads, members, cut, least))
        n_heads *= GROWTH
    edges = found[0]
    for more in found[1:]:
        edges = edges.unionByName(more)
    edges = stored(edges.select("u", "v"), "links")
    discard(members, wanted, *found)
    return signed.select("doc_id", "node", "raw"), edges


def _classed(docs: DataFrame, exact: bool) -> DataFrame:
    texts, found = links(docs, exact)
    parts = stored(components(found), "classes").withColumnsRenamed({"node": "member", "component": "root"})
    empty = node(F.lit(""))
    rooted = texts.join(parts, F.col("node") == F.col("member"), "left").select(
        "doc_id", "node", "raw", F.coalesce("root", "node").alias("root"), (F.col("node") == empty).alias("empty")
    )
    sizes = rooted.where("NOT empty").groupBy(F.col("root").alias("r")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))
    # stored, so that the join has exchanges of its own and Spark can split a class of very many rows
    return rooted.join(stored(sizes, "class-sizes"), F.col("root") == F.col("r"), "left").select(
        "doc_id", "node", F.when(F.col("empty"), F.col("doc_id")).otherwise(F.col("first_id")).alias("class_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("n_class"), "empty", "raw", "root",
    )


def classes(docs: DataFrame, exact: bool = False) -> DataFrame:
    """(doc_id, node, class_id, n_class, empty) of every row of ``docs(doc_id, text)``.

    Texts are linked if the weighted Jaccard similarity of their five-word
    shingles, counted, is 0.8 or more; a class is what links connect, and its id
    is its smallest doc_id (null if all are).  Texts with equal words are equal;
    a text of fewer than five words, but not none, is one shingle.  Null texts
    and texts without words are linked to nothing, not even each other: their
    class is their own id.  Repeated rows are counted and fall into one class.
    Very long texts are compared whole; a task holds one chunk of them at a time.
    Other columns of ``docs`` are not looked at, whatever their names.

    Links between texts that share no band are not seen, and a pair that shares
    one is dropped unread if its signatures agree four standard deviations less
    than at 0.8; ``exact`` has neither loss and costs a bucket for a fifth of
    all shingles.
    """
    return _classed(docs, exact).drop("raw", "root")


def deduplicate(docs: DataFrame, exact: bool = False) -> DataFrame:
    """``docs`` with one row of each class: that of its smallest doc_id.

    Rows equal in id and words are one; rows without words all stay.  A class
    with a null id keeps it only if it has no other.
    """
    found = _classed(docs.select("doc_id", "text"), exact)
    own = found.where(~F.col("empty") & F.col("doc_id").eqNullSafe(F.col("class_id")))
    # of a class's rows with that id the one whose words, then text, have the least hash
    kept = own.groupBy("root").agg(F.min(F.struct("node", "raw"))["raw"].alias("__keep"), F.min("class_id").alias("__class"))
    keyed = docs.withColumn("__raw", F.xxhash64("text"))
    has_words = F.coalesce(F.col("text").rlike(_A_WORD), F.lit(False))
    first = keyed.where(has_words).join(kept, (F.col("__raw") == F.col("__keep")) & F.col("doc_id").eqNullSafe(F.col("__class")))
    first = first.dropDuplicates(["__raw", "doc_id"])
    return first.select(*docs.columns).unionByName(keyed.where(~has_words).select(*docs.columns))
