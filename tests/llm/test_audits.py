"""Shards, divergences and token alignment against brute force, with the awkward inputs."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoquilt.llm import divergence, kd_shards, token_align

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " ", "a", "▁x", "  two  spaces ", "tab\tand\nline\r\n", "<|endoftext|> </s> <unk> <0x41>", "café naïve 中文 \U0001f600", "x" * 5000, "don't we'll 12345 !!! ...", " nbsp  em", "\x00\x01 \x7f"]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, None) for i, t, lang, s in rows], DOCS).withColumns({"size": F.lit("clash"), "term": F.lit(1), "row": F.lit("clash"), "h": F.lit(0)})


def some_rows(n=300, seed=0):
    rng = np.random.default_rng(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)] + ["Été", "THE", "the", "x-y"]
    out = []
    for i in range(n):
        text = " ".join(rng.choice(words, int(rng.integers(0, 60))))
        out.append((i, text, str(rng.choice(["en", "de", "fr"], p=[0.7, 0.2, 0.1])), str(rng.choice(["s1", "s2", "s3"], p=[0.6, 0.3, 0.1]))))
    # a third of the rows are copies, some without any id
    return out + [(1000 + i, "the same text", "en", "s1") for i in range(n // 4)] + [(None, None, None, None)] * (n // 4) + [(5, "", None, "s1"), (5, "", None, "s1"), (6, "long " * 20_000, "en", "s2")]


# --- k-d shards ---------------------------------------------------------------


def test_shards_have_near_equal_bytes_and_gapless_slots(spark, monkeypatch):
    monkeypatch.setattr(kd_shards, "OPEN_ROWS", 4)  # every cell is split by hash digits first
    rows = some_rows()
    got = kd_shards.kd_shards(docs(spark, rows), 7).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _, _ in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(7))


@pytest.mark.parametrize("shards", [1, 2, 5, 24])
def test_shards_of_short_texts_are_near_equal(spark, shards):
    rows = [r for r in some_rows(600, shards) if r[0] != 6]
    got = kd_shards.kd_shards(docs(spark, rows), shards).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    mean, largest = sum(r.b for r in got) / shards, max(len((t or "").encode()) + 8 for _, t, _, _ in rows)
    assert len(got) == shards and all(abs(r.b - mean) <= 2 * largest for r in got)


def test_open_cells_and_whole_sorts_give_the_same_tree(spark, monkeypatch):
    rows = docs(spark, some_rows(200, 3)).where("doc_id is not null")
    whole = sorted(map(tuple, kd_shards.kd_shards(rows, 6).collect()))
    monkeypatch.setattr(kd_shards, "OPEN_ROWS", 1)
    monkeypatch.setattr(kd_shards, "BROADCAST_NODES", 0)
    monkeypatch.setattr(kd_shards, "ROWS_PER_BUCKET", 3)
    assert sorted(map(tuple, kd_shards.kd_shards(rows, 6).collect())) == whole


def test_shards_of_target_bytes_and_of_nothing(spark):
    rows = docs(spark, [(i, "x" * 92, "en", "s") for i in range(100)])
    got = Counter(r.shard for r in kd_shards.kd_shards(rows, target_bytes=1000).collect())
    assert len(got) == 10 and set(got.values()) == {10}
    assert kd_shards.kd_shards(rows.where("false"), 24).count() == 0
    assert kd_shards.kd_shards(rows.where("doc_id < 3"), 24).count() == 3
    with pytest.raises(ValueError):
        kd_shards.kd_shards(rows)


# --- divergences ----------------------------------------------------------------


def brute_divergences(rows, least, top):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, df, sources = defaultdict(Counter), Counter(), defaultdict(set)
    for _, t, lang, s in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(lower))
        sources[lang or ""].add(s or "")
        counts[lang or "", s or ""].update(terms)
        df.update((lang or "", w) for w in set(terms))
    out = []
    for lang, names in sources.items():
        kept = [w for (x, w), n in df.items() if x == lang and n >= least]

        def share(count, kept=kept):
            total = sum(count[w] for w in kept)
            return {w: 1 + 10**9 * (count[w] + 5) // (total + 5 * len(kept)) for w in kept}

        p = {s: share(counts[lang, s]) for s in names}
        q = share(sum((counts[lang, s] for s in names), Counter()))
        for s in names:
            pairs = [(sum(abs(p[s][w] - p[o][w]) for w in kept), o) for o in names if o != s]
            terms = [(p[s][w] - q[w], w) for w in kept if counts[lang, s][w] and p[s][w] > q[w]]
            for part, found, limit in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, i, v, r + 1) for r, (v, i) in enumerate(found[:limit])]
    return sorted(out)


@pytest.mark.parametrize(("entries", "group", "cells"), [(200_000, 4096, 1 << 18), (7, 3, 4)])
def test_divergences_equal_brute_force(spark, monkeypatch, entries, group, cells):
    monkeypatch.setattr(divergence, "BLOCK_CELLS", cells)
    rows = some_rows() + [(1, "only one", "it", "s1"), (2, "", "es", "s1"), (3, None, "es", "s2")]
    got = divergence.divergences(docs(spark, rows), 5, 10, entries, group).collect()
    assert sorted(map(tuple, got)) == brute_divergences(rows, 5, 10)


def test_terms_are_cut_whole_in_pieces(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE_BYTES", 7)
    for text in ["", "abc def", "A" * 50 + " b", "é" * 20, "one, two;three" * 5, "ab cdefghijklmnop", "x "]:
        want = [w.encode() for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.replace("A", "a"))]
        assert [t for piece in divergence.terms_of(text.encode()) for t in piece] == want


def test_shares_are_exact_for_large_counts():
    counts, totals = np.array([[10**15, 7, 0]]), np.array([3 * 10**15 + 1, 9, 1])
    assert divergence.shares(counts, totals).tolist() == [[1 + 10**9 * int(c) // int(t) for c, t in zip(counts[0], totals, strict=True)]]


def test_divergences_of_nothing(spark):
    assert divergence.divergences(docs(spark, some_rows(5)).where("false")).count() == 0


# --- token alignment --------------------------------------------------------------


@pytest.fixture(scope="module")
def plain():
    """Both tokenizers, each over whole texts with the json file: text to ids and bytes."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(f"{token_align.TOKENIZERS}/{token_align.BYTE_FILE}")
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=f"{token_align.TOKENIZERS}/{token_align.PIECE_FILE}")
    symbols = token_align._byte_symbols()

    def encode(text):
        ids_a = a.encode(" " + text, add_special_tokens=False).ids
        ids_b = b.encode(text)
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        return ids_a, ids_b, [bytes(symbols[c] for c in a.id_to_token(i)) for i in ids_a], bytes_b

    return encode


def brute_alignment(texts, encode):
    out, counts = [], Counter()
    for t in texts:
        a, b, x, y = encode(t) if t else ([], [], [], [])
        if not t or not b"".join(x) == b"".join(y) == (" " + t).encode():
            out.append(None)
            continue
        ends_a, ends_b = np.cumsum(list(map(len, x))).tolist(), np.cumsum(list(map(len, y))).tolist()
        at, cuts = [0, 0], []
        for e in sorted(set(ends_a) & set(ends_b)):
            i, j = ends_a.index(e) + 1, ends_b.index(e) + 1
            cuts.append((at[0], i, at[1], j))
            at = [i, j]
        links = []
        for i, i2, j, j2 in cuts:
            for k in range(i, i2):
                links += [(a[k], b[m]) for m in range(j, j2) if max(ends_a[k] - len(x[k]), ends_b[m] - len(y[m])) < min(ends_a[k], ends_b[m])]
        text = ";".join(",".join(map(str, a[i:i2])) + "|" + ",".join(map(str, b[j:j2])) for i, i2, j, j2 in cuts)
        counts.update(set(links))
        out.append((len(a), len(b), len(cuts), links, hashlib.sha256(text.encode()).hexdigest()))
    best = defaultdict(int)
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    return [(0, 0, 0, 0, 0, 0, "") if r is None else (*r[:3], len(r[3]), sum(counts[p] == best[p[0]] for p in r[3]), sum(counts[p] for p in r[3]), r[4]) for r in out]


def odd_texts():
    rng = np.random.default_rng(1)
    alphabet = list("ab  cdeT,.!\n\t0123'") + ["é", "中", "\U0001f600", "▁", " ", "́", "\x00"]
    words = ["Understanding", "tokenization", "zqxv", "don't", "10000", "naïve", "the", "https://a.b/c?d=e"]
    return ODD + ["".join(rng.choice(alphabet, int(rng.integers(1, 80)))) for _ in range(150)] + [" ".join(rng.choice(words, int(rng.integers(1, 40)))) for _ in range(60)]


@pytest.mark.parametrize("rows", [1 << 20, 5])
def test_alignment_equals_brute_force(spark, plain, rows):
    texts = odd_texts()
    texts += texts[:40]
    frame = docs(spark, [(i % 200, t, "en", None) for i, t in enumerate(texts)] + [(None, "no id", None, None)])
    got = token_align.token_alignment(frame, frequent=2, broadcast_rows=rows).collect()
    want = [(i % 200, *r) for i, r in enumerate(brute_alignment([*texts, "no id"], plain))]
    want[-1] = (None, *want[-1][1:])
    assert Counter(map(tuple, got)) == Counter(want)


def test_fast_tokenizer_equals_the_json_file(plain):
    both = token_align.tokenizers(token_align.TOKENIZERS)
    for text in odd_texts():
        found = both.encode(text or "")
        if found:
            assert plain(text or "")[:2] == tuple(found[:2])


def test_runs_are_probed_to_their_end():
    for n in range(1, 40):
        same = list(range(1, n + 1))
        for more in range(1, 12):
            a, b = [*same, n + 50, *range(n + 60, n + 60 + more)], [*same, n + 40, n + 50, *range(n + 60, n + 60 + more)]
            assert token_align.run_length(a, b, 0, 0) == n and token_align.run_length(a, b, n, n + 1) == 1 + more
    names = list(map(str, range(20)))
    assert token_align.align([1, 2, 3], [4, 5, 6, 7], [2, 5, 9], [2, 3, 7, 9], names, names) == (2, "1|4;2,3|5,6,7", [1, 2, 2, 3, 3], [4, 5, 6, 6, 7])
    assert token_align.align([], [], [], [], names, names) == (0, "", [], [])
