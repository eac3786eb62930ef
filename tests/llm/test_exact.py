"""Operators that have an exact answer, against brute force, with the awkward inputs."""

from __future__ import annotations

import base64
import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoquilt.llm import curriculum, decontam, multi_index, near_dedup, quotes, url_rules, warc
from geoquilt.storage import shared_dir

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOCS)


# --- curriculum -------------------------------------------------------------


def filled(sizes: dict, weights=(5, 2, 1)) -> dict:
    """Targets by sharing again and again what the caps cut off."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, open_names = dict.fromkeys(names, 0.0), set(names)
    rest = float(sum(sizes.values()))
    while open_names:
        total = sum(w[s] for s in open_names)
        over = {s for s in open_names if rest * w[s] / total > 3 * sizes[s]}
        if not over:
            return target | {s: rest * w[s] / total for s in open_names}
        for s in over:
            target[s] = 3.0 * sizes[s]
        rest -= sum(target[s] for s in over)
        open_names -= over
    return target


def test_mix_meets_targets_exactly(spark):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(["w"] * int(n)), s) for i, (n, s) in enumerate(zip(rng.integers(0, 40, 200), rng.choice(["a", "b", "c", "d", "e"], 200, p=[0.02, 0.5, 0.28, 0.1, 0.1]), strict=True))]
    rows += [(None, None, None), (7, "x\x0by z", None), (7, "x\x0by z", None), (900, "", "f"), (901, "long " * 40_000, "e")]
    rows += [(None, f"no id {i}", "b") for i in range(100)]
    got = curriculum.mix(docs(spark, rows), rows_per_bucket=5).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = filled(sizes | {"f": 0})
    assert len(got) == len(rows)
    for s in want:
        own = [r for r in got if r.source == s]
        assert {r.source_size for r in own} == {sizes[s]} and own[0].target == pytest.approx(want[s])
        assert sum(r.taken for r in own) == int(want[s] + 0.5)
    assert all(r.taken <= 3 * r.size and sum(p.words for p in r.placements) == r.taken for r in got)
    again = curriculum.mix(docs(spark, rows).repartition(3), rows_per_bucket=50).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.taken)
    assert [(r.doc_id, r.taken) for r in sorted(got, key=key)] == [(r.doc_id, r.taken) for r in sorted(again, key=key)]


def test_words_are_counted_whole(spark):
    long = "w\u00e4 \t" * 300_000
    texts = [None, "", " ", "\t\n", "a", " a", "a ", "a b", "  a\x0b b\r\n c ", "\u00e9 \u00fc x", "x", "\x00 a", "a\x85b", long, long + "x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = [r.n for r in df.select("i", curriculum.word_count(F.col("text")).alias("n")).orderBy("i").collect()]
    assert got == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]


def test_positions_follow_the_schedule(spark):
    rows = [(i, "w " * 10, s) for i, s in enumerate(["a", "b", "c"] * 200)]
    order = curriculum.training_order(curriculum.mix(docs(spark, rows)), 4)
    got = order.collect()
    assert [r.position for r in got] == sorted(r.position for r in got)
    share = lambda rs: sum(r.words for r in rs if r.source == "a") / sum(r.words for r in rs)
    assert share(got[: len(got) // 4]) > share(got[-len(got) // 4 :])
    assert curriculum.mix(docs(spark, [])).count() == 0


# --- URL rules --------------------------------------------------------------


def verdict(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate(str.maketrans(url_rules.UPPER, url_rules.LOWER))
    best = None
    for action, h, p in rules:
        if h and host and (host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best or (0,), (len(h + p), len(h), h + p, action))
    return host, path, best and best[2], best[3] if best else default


def test_rules_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(url_rules, "ROWS_PER_RANGE", 7)  # many key ranges, so that intervals cross their bounds
    rng = np.random.default_rng(1)
    labels, parts = ["a", "b", "com", "net", "x-y"], ["", "p", "p/q", "p/q/r", "pé", "pq"]
    host = lambda: ".".join(rng.choice(labels, rng.integers(1, 5)))
    rules = sorted({(str(rng.choice(["allow", "block"])), host(), "/" + str(rng.choice(parts))) for _ in range(60)})
    rules = list({(h, p): (a, h, p) for a, h, p in rules}.values())
    urls = [f"http://{host()}/{rng.choice(parts)}{rng.choice(['', '?q', '#f', '/z'])}" for _ in range(300)]
    urls += [f"http://a.com/p/{'q' * 5000}{i}" for i in range(30)]  # keys that share a long beginning
    urls += [None, "", "nothing", "http://", "http://A.COM/p/q", "http://com?x://b/", "http://com", "x://com/p\U0010ffff", urls[0]]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, node string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(pages, url_rules.rules_frame(spark, rules)).collect()}
    assert got == {i: verdict(u, rules) for i, u in enumerate(urls)}


def test_rules_of_nothing(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    rules = url_rules.rules_frame(spark, [("block", "net", "/")])
    assert url_rules.judge(none, rules).count() == 0
    one = spark.createDataFrame([(None, "http://net/")], "page_id long, url string")
    assert url_rules.judge(one, url_rules.rules_frame(spark, [])).first().verdict == "allow"
    assert url_rules.judge(one, rules.unionByName(url_rules.rules_frame(spark, [("allow", "net", "/")]))).first().verdict == "block"


# --- WARC -------------------------------------------------------------------


def test_archives_round_trip(spark):
    rows = [(i, f"http://h/{i}", "p" * (i % 4) * 100) for i in range(40)]
    rows += [(100, None, None), (101, "http://é\r\nx: y", "grüße\r\n\r\n\x00"), (None, "u", "only"), (None, "u", "only"), (5, "http://h/5", "p" * 100), (102, "l", "z" * 200_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    folder = shared_dir(spark, "warc-test")
    manifest = warc.write_archives(pages, folder, roll_bytes=1500, rows_per_shard=10)
    files = manifest.collect()
    assert len(files) > len({f.shard for f in files}) > 1  # shards, some of which rolled
    got = warc.read_archives(manifest, folder).collect()
    assert len(got) == len(rows)
    groups = {}
    for i, u, h in rows:
        groups.setdefault((h or "").encode(), []).append(i)
    for payload, ids in groups.items():
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        own = [r for r in got if r.payload_digest == digest]
        leader = max((i for i in ids if i is not None), default=None)
        assert Counter(r.page_id for r in own) == Counter(ids) and {r.payload_bytes for r in own} == {len(payload)}
        response = [r for r in own if r.record_type == "response"]
        assert [(r.page_id, r.payload) for r in response] == [(leader, payload)]
        assert all(r.refers_to == leader and r.payload is None for r in own if r.record_type == "revisit")
    again = warc.write_archives(pages.repartition(5), shared_dir(spark, "warc-test"), roll_bytes=1500, rows_per_shard=10)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, files))
    small = warc.write_archives(pages, (other := shared_dir(spark, "warc-test")), min_revisit_bytes=150)
    assert {r.payload_bytes for r in warc.read_archives(small, other).collect() if r.record_type == "revisit"} == {200, 300}
    none = warc.write_archives(pages.limit(0), (empty := shared_dir(spark, "warc-test")))
    assert warc.read_archives(none, empty).count() == 0


def headers_of(folder, files):
    """Headers of every record, by a reader of its own."""
    import gzip

    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder + "/records")
    for f in files:
        with store.open_input_stream(f"{root}/{f.file}", compression=None) as stream:
            data = gzip.decompress(stream.read())
        first = True
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            assert (fields["WARC-Type"] == "warcinfo") == first and (not first or fields["WARC-Filename"] == f.file)
            first, data = False, rest[int(fields["Content-Length"]) + 4 :]
            yield fields


def test_revisits_resolve_and_frequent_ids_are_dealt(spark):
    rng = np.random.default_rng(11)
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"http://h/{i % 50}", f"body {rng.integers(0, 90)}") for i in range(600)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = shared_dir(spark, "warc-test")
    files = warc.write_archives(pages, folder, rows_per_shard=40).collect()
    got = list(headers_of(folder, files))
    pages_of = [h for h in got if h["WARC-Type"] != "warcinfo"]
    ids = {h["WARC-Record-ID"]: h for h in pages_of}
    assert len(pages_of) == len(ids) == len(rows)
    for h in pages_of:
        if h["WARC-Type"] == "revisit":
            target = ids[h["WARC-Refers-To"]]
            assert target["WARC-Type"] == "response" and target["WARC-Payload-Digest"] == h["WARC-Payload-Digest"]
            assert target["WARC-Target-URI"] == h["WARC-Refers-To-Target-URI"] and target.get("X-Page") == h.get("X-Refers-To-Page")
    response = Counter(h["WARC-Payload-Digest"] for h in pages_of if h["WARC-Type"] == "response")
    assert set(response.values()) == {1} and len(response) == len({t for _, _, t in rows})
    by_file = {}
    for r in warc.read_archives(spark.createDataFrame(files), folder).withColumn("x", F.lit(0)).collect():
        by_file.setdefault(r.page_id, 0)
        by_file[r.page_id] += 1
    assert by_file[None] == by_file[7] == 200
    shards = warc.shards_for(warc.digests(pages.select("page_id", "url", F.col("html").cast("binary").alias("payload"))), 1 << 27, 40)
    known = pages.select("page_id", F.xxhash64("url", F.col("html").cast("binary")).alias("salt"))
    dealt = known.select("page_id", shards.of(F.col("page_id"), F.col("salt")).alias("s")).collect()
    assert len({r.s for r in dealt if r.page_id is None}) > 3 and len({r.s for r in dealt if r.page_id == 7}) > 3
    order = sorted({(r.s, r.page_id is not None, r.page_id or 0) for r in dealt})
    assert [x[1:] for x in order] == sorted(x[1:] for x in order) and max(r.s for r in dealt) < shards.count


def test_ranges_of_ids_are_cut_into_steps(spark):
    shards = warc.Shards(2, 4, (10, 20, 20, 20, 90), 1, 100)
    ids = spark.range(1, 101).select(F.col("id").alias("page_id"), F.explode(F.sequence(F.lit(0), F.lit(8))).alias("salt"))
    got = ids.select("page_id", shards.of(F.col("page_id"), F.col("salt")).alias("s")).collect()
    order = sorted({(r.page_id, r.s) for r in got})
    assert [s for _, s in order] == sorted(s for _, s in order) and {s for i, s in order if i == 20} == set(range(10, 19))
    assert order[0][1] == 2 and order[-1][1] < shards.count


def test_a_changed_archive_is_refused(spark):
    folder = shared_dir(spark, "warc-test")
    manifest = warc.write_archives(spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string"), folder)
    with pytest.raises(Exception, match="not what the manifest says"):
        warc.read_archives(manifest.withColumn("sha256", F.lit("0")), folder).collect()


# --- decontamination --------------------------------------------------------


def hits_of(text, items, window=10):
    words = lambda t: re.findall(WORD, (t or "").translate(str.maketrans(decontam.UPPER, decontam.LOWER)))
    w, covered, found = words(text), set(), set()
    for i, t in items:
        v = words(t)
        for k in range(max(1, len(v) - window + 1) if v else 0):
            piece = v[k : k + window]
            for s in range(len(w) - len(piece) + 1):
                if w[s : s + len(piece)] == piece:
                    covered |= set(range(s, s + len(piece)))
                    found.add("" if i is None else str(i))
    return len(w), len(covered), sorted(found)


def test_windows_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    word = lambda: str(rng.choice(["the", "of", "Zé", "a1", "q", "rare" + str(rng.integers(0, 50))], p=[0.3, 0.25, 0.15, 0.15, 0.1, 0.05]))
    phrase = lambda n: " ".join(word() for _ in range(n))
    items = [(i, phrase(int(n))) for i, n in enumerate(rng.integers(1, 25, 25))] + [(None, phrase(12)), (90, None), (91, "..."), (3, phrase(11))]
    rows = [(i, f"{phrase(30)}, {items[int(rng.integers(0, 25))][1].upper()} - {phrase(int(rng.integers(0, 40)))}", "s") for i in range(60)]
    rows += [(100, None, "s"), (101, "", "s"), (102, items[26][1] or "", "s"), (3, rows[3][1], "s"), (None, rows[4][1], "s"), (103, "the " * 3000 + items[0][1], "s")]
    frame = docs(spark, rows).withColumn("hits", F.lit(1)).withColumn("key", F.lit(2)).withColumn("phrase", F.lit("x"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contamination(frame, bench).withColumns(decontam.hit_digest(F.col("hits"))).collect()
    want = Counter()
    for i, t, _ in rows:
        n, covered, found = hits_of(t, items)
        want[i, n, covered, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), covered > 0] += 1
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == want
    assert decontam.contamination(docs(spark, []), bench).count() == 0
    assert decontam.contamination(docs(spark, rows), bench.limit(0)).where("contaminated").count() == 0


def near_windows(text, items, slop, window=10):
    """Phrases of which every word stands within ``slop`` of its place from some start."""
    words = lambda t: re.findall(WORD, (t or "").translate(str.maketrans(decontam.UPPER, decontam.LOWER)))
    w, found = words(text), set()
    for _, t in items:
        v = words(t)
        for k in range(max(1, len(v) - window + 1) if v else 0):
            piece = v[k : k + window]
            starts = range(-slop - len(piece), len(w) + slop + 1)
            if any(all(x in w[max(0, a + i - slop) : max(0, a + i + slop + 1)] for i, x in enumerate(piece)) for a in starts):
                found.add(" ".join(piece))
    return found


@pytest.mark.parametrize("slop", [0, 1, 3])
def test_proximity_equals_brute_force(spark, slop):
    rng = np.random.default_rng(7)
    phrase = lambda n: " ".join(rng.choice(["the", "of", "a", "zé", "q", "r", "s", "t"], n))
    items = [(1, "alpha one two three beta"), (2, "q"), (None, phrase(6)), (4, phrase(12)), (5, None)]
    rows = [(i, t, "s") for i, t in enumerate(["alpha one two three beta", "alpha one extra two three beta", "beta alpha", "alpha nope no nothing beta", "one alpha two three beta", "beta three two one alpha", None, ""])]
    for i in range(40):
        w = phrase(12).split() + items[int(rng.integers(0, 4))][1].split() + phrase(8).split()
        for _ in range(int(rng.integers(0, 4))):
            w.insert(int(rng.integers(0, len(w))), "x")
        rows.append((100 + i, " ".join(w), "s"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contamination(docs(spark, rows), bench, slop=slop).collect()
    assert {r.doc_id: {x.phrase for x in r.near} for r in got} == {i: near_windows(t, items, slop) for i, t, _ in rows}
    assert all(r.contaminated == bool(hits_of(r.text, items)[1]) for r in got)


def test_long_texts_of_one_word(spark):
    n = 1_000_000
    bench = spark.createDataFrame([(1, "the"), (2, " ".join(["the"] * 10)), (3, "the end")], "item_id long, text string")
    got = {r.doc_id: r for r in decontam.contamination(docs(spark, [(1, "the " * n, "s"), (2, "an end", "s"), (3, "the " * 5 + "end", "s")]), bench, spans=False).collect()}
    assert (got[1].n_words, got[1].n_hit, got[1]["items"], got[1].n_near) == (n, n, ["1", "2"], 2)
    assert (got[2].n_hit, got[3].n_hit, got[3]["items"]) == (0, 6, ["1", "3"])


# --- near duplicates --------------------------------------------------------


def shingled(text):
    w = re.findall(WORD, (text or "").translate(str.maketrans(decontam.UPPER, decontam.LOWER)))
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def class_of(rows):
    sets, root = [shingled(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = sum((sets[i] & sets[j]).values())
            if both and both >= 0.8 * (sum(sets[i].values()) + sum(sets[j].values()) - both):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    return Counter((rows[i][0], min((x for x in groups[find(i)] if x is not None), default=None), len(groups[find(i)])) for i in range(len(rows)))


@pytest.fixture(scope="module")
def copies():
    rng = np.random.default_rng(3)
    text = lambda n: [f"w{rng.integers(0, 4000)}" for _ in range(n)]
    rows, k = [], 0
    for _ in range(25):
        base = text(int(rng.integers(60, 200)))
        for _ in range(int(rng.integers(1, 6))):
            w = list(base)
            for _ in range(int(rng.integers(0, 4))):
                w[int(rng.integers(0, len(w)))] = "changed"
            rows.append((k := k + 1, " ".join(w)))
    rows += [(500, "one two"), (501, "One, TWO!"), (502, "one three"), (503, None), (504, ""), (505, "..."), (1, rows[0][1]), (None, rows[0][1]), (None, "lonely text with no id")]
    rows += [(600, "be " * 400), (601, "be " * 390), (602, "be " * 200)]
    return rows


def test_dart_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(4)
    agree, true = [], []
    for _ in range(60):
        n = int(rng.integers(1, 400))
        items = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        a = rng.integers(1, 9, len(items))
        b = np.where(rng.random(len(items)) < 0.3, rng.integers(1, 30, len(items)), a)
        owner = np.zeros(len(items), int)
        agree.append((near_dedup.dart_minhash(items, a, owner, 1) == near_dedup.dart_minhash(items, b, owner, 1)).mean())
        true.append(np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(np.array(agree) - np.array(true))) < 0.015


def test_sets_of_many_texts_are_those_of_each(monkeypatch):
    import pyarrow as pa

    from geoquilt.llm import shingles

    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice(["a", "bc", "dé", "f日"], rng.integers(0, 40))) for _ in range(200)] + [None, "", "x " * 3000 + "y", "one"]
    monkeypatch.setattr(shingles, "CHUNK_BYTES", 300)
    names, seen = {}, 0
    for at, sets in shingles.shingle_sets(pa.array(texts)):
        for d in range(len(sets.weight)):
            w = (texts[at + d] or "").split(" ") if texts[at + d] else []
            want = Counter(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()
            items, counts = sets.of(d)
            assert sorted(counts) == sorted(want.values()) and sets.weight[d] == sum(want.values())
            for s in want:
                names.setdefault(s, []).append({x for x, c in zip(items.tolist(), counts.tolist(), strict=True) if c == want[s]})
            seen += 1
    assert seen == len(texts) and all(set.intersection(*found) for found in names.values())  # equal shingles, equal hashes


@pytest.mark.parametrize("exact, chunk, heads", [(True, 256, 16), (False, 3, 2)])  # the latter: buckets of many chunks, many rounds
def test_classes_equal_brute_force(spark, copies, monkeypatch, exact, chunk, heads):
    monkeypatch.setattr(near_dedup, "CHUNK", chunk)
    monkeypatch.setattr(near_dedup, "HEADS", heads)
    monkeypatch.setattr(near_dedup, "GROWTH", 4)
    frame = spark.createDataFrame(copies, "doc_id long, text string").withColumn("node", F.lit(1))
    got = near_dedup.classes(frame, exact).collect()
    assert Counter((r.doc_id, r.class_id, r.n_class) for r in got) == class_of(copies)


def test_families_below_the_similarity_stay_apart(spark):
    rng = np.random.default_rng(12)
    base = [f"w{i}" for i in range(120)]
    rows = [(k, " ".join("x%d" % rng.integers(0, 9999) if rng.random() < 0.035 else w for w in base)) for k in range(60)]
    rows += [(100, " ".join(base * 60)), (101, " ".join((base * 60)[:7000]))]
    got = near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string"), True).collect()
    want = class_of(rows)
    assert 1 < len({c for _, c, _ in want}) < 61 and Counter((r.doc_id, r.class_id, r.n_class) for r in got) == want


def test_one_row_of_each_class_is_kept(spark, copies):
    frame = spark.createDataFrame(copies, "doc_id long, text string").withColumn("node", F.lit(1))
    got = near_dedup.classes(frame).collect()
    kept = near_dedup.deduplicate(frame).collect()
    classes = {(r.class_id, r.node) if r.empty else r.class_id for r in got}
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(c if not isinstance(c, tuple) else c[0] for c in classes if c is not None)
    assert kept[0].asDict().keys() == {"doc_id", "text", "node"}
    assert near_dedup.classes(frame.limit(0)).count() == 0


# --- embeddings -------------------------------------------------------------


def test_links_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 16))
    near = np.repeat(x[:10], 12, axis=0) + rng.normal(size=(120, 16)) * 0.15
    v = [r.tolist() for r in np.vstack([x, near, x[:3], 5 * x[4:6]])] + [None, [0.0] * 16, [1.0, None] + [0.0] * 14, [float("nan")] * 16, [1.0], [1.0, 0.0], []]
    rows = [*enumerate(v), (None, v[0]), (0, v[0])]
    ok = [r for r in range(len(rows)) if rows[r][1] and all(c is not None and np.isfinite(c) for c in rows[r][1]) and any(rows[r][1])]
    m = np.zeros((len(ok), 16))
    for k, r in enumerate(ok):
        m[k, : len(rows[r][1])] = rows[r][1]
    m /= np.linalg.norm(m, axis=1)[:, None]
    link = m @ m.T >= 0.95
    part = np.arange(len(ok))
    for _ in range(len(ok)):
        part = np.array([part[link[i]].min() for i in range(len(ok))])
    want = Counter()
    for r, (i, _) in enumerate(rows):
        if r in ok:
            k = ok.index(r)
            ids = [rows[ok[j]][0] for j in np.flatnonzero(part == part[k])]
            component = min(x for x in ids if x is not None)
            want[i, int(link[k].sum()) - 1, component] += 1
        else:
            want[i, 0, i] += 1
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("node", F.lit(0))
    for block in (2048, 5):
        got = multi_index.classes(frame, target=0.9999, block=block).collect()
        assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == want
    assert multi_index.classes(frame.limit(0)).count() == 0


def test_traversal_visits_cells_in_order():
    rng = np.random.default_rng(6)
    a, b = rng.random(9), rng.random(7)
    got = list(multi_index.multi_sequence(a, b, 1.1))
    assert [d for d, _, _ in got] == sorted(d for d, _, _ in got)
    assert {(i, j) for _, i, j in got} == {(i, j) for i in range(9) for j in range(7) if a[i] + b[j] <= 1.1}


# --- quotations -------------------------------------------------------------


def test_short_quotes_and_lines_are_linked(spark):
    rows = [
        (1, 0, "user", "Shall we go?"),
        (1, 1, "assistant", "Yes, I agree. ---"),
        (1, 2, "user", "> Yes, I agree.\nfine"),
        (1, 3, "user", "a list without any stops\nof several plain lines\nand one more"),
        (1, 4, "assistant", ">  of several plain  lines\nthat one"),
        (1, 5, "user", "> and one more\n> ---\nthat too"),
        (1, 6, "user", "> ---\nnothing said"),
        (2, 0, "user", "> Yes, I agree.\nnot here"),
        (2, 1, "user", "> a list without any stops\nfrom there"),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    parent = {(r.conv_id, r.turn): (r.parent_conv, r.parent_turn) for r in quotes.link_quotes(frame).collect()}
    want = {(1, 2): (1, 1), (1, 4): (1, 3), (1, 5): (1, 3), (2, 1): (1, 3)}
    assert parent == {(c, t): want.get((c, t), (None, None)) for c, t, _, _ in rows}


def test_quotes_are_linked_and_cut(spark):
    rows = [
        (1, 0, "user", "The first statement is here. Another long sentence follows!"),
        (1, 1, "assistant", "> The first  statement is here.\nI answer with a new statement."),
        (1, 2, "user", "> > The first statement is here.\n> I answer with a new statement.\n\nA third voice speaks now."),
        (1, 3, "user", "> nobody ever said this sentence\nok"),
        (2, 0, "user", ">Another long sentence follows!\nelsewhere entirely, a reply"),
        (2, 1, "user", None),
        (None, 1, "user", "> The first statement is here."),
        (3, 0, "user", "> I say this to myself only.\nI say this to myself only."),
        (1, 0, "user", "The first statement is here. Another long sentence follows!"),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("node", F.lit(1))
    got = {(r.conv_id, r.turn): r for r in quotes.reply_order(quotes.link_quotes(frame)).collect()}
    parent = {k: (r.parent_conv, r.parent_turn) for k, r in got.items()}
    none = (None, None)
    assert parent == {(1, 0): none, (1, 1): (1, 0), (1, 2): (1, 1), (1, 3): none, (2, 0): (1, 0), (2, 1): none, (None, 1): none, (3, 0): none}
    assert (got[1, 2].thread_conv, got[1, 2].thread_turn, got[1, 2].max_level, got[1, 2].n_quoted) == (1, 0, 2, 2)
    assert got[1, 2].body == "\nA third voice speaks now." and got[2, 1].body == "" and got[2, 0].thread_turn == 0
    assert quotes.link_quotes(frame).count() == len(rows) and quotes.link_quotes(frame.limit(0)).count() == 0


def test_marks_and_texts_of_any_length_are_read(spark):
    said = "A sentence that somebody wrote. "
    rows = [
        (1, 0, "user", said + "x" * 1_000_000),
        (1, 1, "user", ">" * 100_000 + " deep\n> " + said),
        (1, 2, "user", "> " * 50_000 + "\n" + ">" * 3 + said),
        (1, 3, "user", "\n".join(">" * k + " " + said for k in range(1, 300))),
        (1, 4, "user", ">>\n\n>"),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.turn: r for r in quotes.link_quotes(frame).collect()}
    assert [got[k].max_level for k in range(5)] == [0, 100_000, 50_000, 299, 2]
    assert [got[k].parent_turn for k in range(5)] == [None, 0, 0, 0, None]


def test_replies_are_numbered_parents_first(spark):
    n = 40
    rows = [(1, t, "user", f"Message number {t} says this. It was written by hand.") for t in range(n)]
    parent = {t: (t * 7) % t if t % 5 else t - 1 for t in range(1, n)}
    rows = [(c, t, r, f"> Message number {parent[t]} says this.\n{x}" if t else x) for c, t, r, x in rows]
    rows += [(2, t, "user", "> It was written by hand." if t % 2 else "A third thing, said alone.") for t in range(9)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): r for r in quotes.link_quotes(frame).collect()}
    above = {(1, t): (1, p) for t, p in parent.items()} | {(2, t): (1, 0) for t in range(1, 9, 2)}

    def depth(m):
        return 1 + depth(above[m]) if m in above else 0

    for m, r in got.items():
        assert ((r.parent_conv, r.parent_turn) if m in above else above.get(m)) == above.get(m) and r.depth == depth(m)
    thread = sorted((m for m in got if m == (1, 0) or m in above), key=lambda m: (depth(m), m))
    assert [got[m].reply_no for m in thread] == list(range(len(thread)))
    assert all(got[above[m]].reply_no < got[m].reply_no for m in above)
