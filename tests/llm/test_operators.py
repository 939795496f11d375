"""Corpus operators against brute force, on a fixture of odd rows and on the smallest tables."""

import hashlib
import os
import random
import re
import subprocess
import sys
import threading
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from activity_engine.llm.common import components, freeing, merged, word_spans, written
from activity_engine.llm.decontaminate import contamination, signature_length
from activity_engine.llm.line_dedup import later_runs, line_dedup, line_runs
from activity_engine.llm.mixing import mixture, sainte_lague
from activity_engine.llm.near_dedup import near_duplicates
from activity_engine.llm.queries import QUERIES
from activity_engine.llm.shard import shard, shard_of, write_shards
from activity_engine.llm.simhash import _place_among, edited_fingerprints, id_bounds, near_fingerprints
from activity_engine.llm.substring_dedup import GROUP_BYTES, _Windows, names_at, prefix_lengths, repeats, substring_dedup, word_numbers
from activity_engine.llm.tokens import ENTRY_BYTES, LONG_PIECE, parts_of, safe_pieces, token_counts
from activity_engine.llm.tokens import Counter as Counts
from activity_engine.llm.toxicity import (
    Matcher, clause, compose, grammar, keep_clean, matches_of_clauses, negation, reported_speech, scored, sustained, tabulate, threat_frame, toxicity,
)
from activity_engine.llm.warc import read_warc, write_warc

SMALL = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i * 7919 % 5003}x{i % 13}" for i in range(30_000))
BASE = " ".join(f"b{i}" for i in range(200))
SCHEMA = "doc_id long, text string, source string, id string, h long, n int, key string, size string, bucket int, lines string"


def odd_rows():
    texts = [None, "", "   \n\t ", "one", "one", "one two", "ONE two", LONG, LONG + " tail", BASE, BASE, BASE + " more", "pre " + BASE, "a b c " * 60, "a b c " * 60]
    texts += ["x\ny\nz\nx\ny\nz", "x\ny\n\nq", "\n\n\n", "q\nx\ny", "é ü ß  <|endoftext|> tail ", "1 2 3 4 5 6 7 8 9 10", "1 2 3 4 5 6 7 8 9 11"]
    rows = [(100 + i, t, None if i % 5 == 0 else f"s{i % 3}") for i, t in enumerate(texts)]
    return [(*r, "x", 1, 2, "k", "s", 3, "l") for r in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return written(spark.createDataFrame(odd_rows(), SCHEMA), "odd")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def with_nulls(spark, odd):
    """Null ids and rows that repeat."""
    return written(odd.union(odd.filter("doc_id IN (103, 109)")).union(odd.filter("doc_id IN (109, 110)").withColumn("doc_id", F.lit(None).cast("long"))), "nulls")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "source")


def texts_of(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def shingles(t, k):
    w = words(lower(t))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def roots(ids, links):
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {i: find(i) for i in ids}


# --- op 1 ------------------------------------------------------------------------------------------------------


def check_near(df, got, k):
    t = {i: shingles(x, k) for i, x in texts_of(df).items()}
    ids = sorted(t)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if t[a] and t[b] and 100 * len(t[a] & t[b]) >= 80 * len(t[a] | t[b])]
    want = roots(ids, links)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {i: (len(t[i]), want[i], want[i] == i) for i in ids}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, odd, docs, k):
    for df in (odd, docs):
        check_near(df, near_duplicates(df, words=k).collect(), k)


def test_near_duplicates_of_chains_and_stars(spark):
    """Leaves that link to each other but not to their bucket's centre are linked in later rounds."""
    base = [f"t{i}" for i in range(40)]
    rows, n = [], 0
    for step in range(30):
        for cut in (0, 2, 4, 6, 8):
            rows.append((n, " ".join(base[cut : 40 - step % 7] + [f"u{step % 5}"])))
            n += 1
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check_near(df, near_duplicates(df, words=2).collect(), 2)


def test_near_duplicates_edges(with_nulls, empty):
    assert near_duplicates(empty).collect() == []
    rows = near_duplicates(with_nulls, words=2).collect()
    assert len(rows) == with_nulls.count()
    assert all(r["component_id"] is None and r["kept"] for r in rows if r["doc_id"] is None)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 50)] + [(100, 200 + i) for i in range(30)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {100: 100} | {200 + i: 100 for i in range(30)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
    found = components(spark.createDataFrame([(5, 6), (8, 9)], "a long, b long"))
    more = spark.createDataFrame([(6, 9), (20, 21), (1, 21)], "a long, b long")
    assert {r["node"]: r["root"] for r in merged(found, more).collect()} == {5: 5, 6: 5, 8: 5, 9: 5, 20: 1, 21: 1, 1: 1}
    assert {r["node"]: r["root"] for r in merged(found, more.limit(0)).collect()} == {5: 5, 6: 5, 8: 8, 9: 8}


# --- op 2 ------------------------------------------------------------------------------------------------------


def test_shard(spark, odd, with_nulls, empty, docs, tmp_path):
    for df in (odd, with_nulls, docs):
        rows = shard(df, 4, bucket_bytes=5000).collect()
        assert sorted((r["doc_id"] or -1, r["text"] or "") for r in rows) == sorted((r["doc_id"] or -1, r["text"] or "") for r in df.collect())
        slots = defaultdict(list)
        for r in rows:
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert sorted(map(str, rows)) == sorted(map(str, shard(df, 4, bucket_bytes=5000).collect()))
    assert shard(empty, 4).collect() == []
    moved = spark.range(20_000).select(shard_of(F.col("id"), 8).alias("a"), shard_of(F.col("id"), 9).alias("b")).groupBy("a", "b").count().collect()
    assert all(r["a"] == r["b"] or r["b"] == 8 for r in moved)
    totals = defaultdict(int)
    for r in moved:
        totals[r["a"]] += r["count"]
    assert max(totals.values()) < 1.1 * min(totals.values())
    write_shards(shard(odd, 2), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == odd.count()


def test_op2_columns(spark):
    t = texts_of(spark.read.parquet(f"{SMALL}/documents.parquet"))
    rows = QUERIES["op2_sharding"](spark, SMALL).collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"], r["law"]) for r in rows} == {i: (len(x.encode()) + 1, zlib.crc32(x.encode()), "key") for i, x in t.items()}
    assert all(r["grown_shard"] in (r["shard"], 8) for r in rows)


# --- op 3 ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("limit", [1 << 20, 7])
def test_contamination(spark, odd, with_nulls, empty, docs, limit):
    items = spark.createDataFrame([(1, "B5 b6 b7 b8 b9 b10 b11"), (2, "one two"), (3, None), (4, " "), (5, "b1 b2 b3 b4 b5 b6 zz"), (6, "B5 b6 b7 b8 b9 b10 b11"), (7, "1 2 3 4 5 6 7 8 9 0")], "item_id long, text string")
    real = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    for df, bench in ((odd, items), (docs, real)):
        want = set()
        for i, x in texts_of(df).items():
            for j, y in ((r["item_id"], r["text"]) for r in bench.collect()):
                k = min(5, len(words(y)))
                if k and 100 * len(shingles(y, k) & (shingles(x, k) if len(words(x)) >= k else set())) >= 80 * len(shingles(y, k)):
                    want.add((i, j, len(shingles(y, k)), len(shingles(y, k) & shingles(x, k))))
        assert {tuple(r) for r in contamination(df, bench, block_values=limit).collect()} == want
        assert want
    assert contamination(empty, items).collect() == [] and contamination(odd, items.limit(0)).collect() == []
    assert all(r["doc_id"] is not None for r in contamination(with_nulls, items).collect())


def test_recall_of_long_items(spark):
    """Items whose signature holds fewer shingles than may be missing are found by chance: measured against exact search."""
    rng = random.Random(2)
    items, texts, want = [], [], set()
    for i in range(60):
        n = rng.choice([120, 300, 900])
        item = [f"i{i}w{j}" for j in range(n)]
        items.append((i, " ".join(item)))
        held = list(item)
        for j in rng.sample(range(n), max(1, int(n * rng.choice([0.0, 0.01, 0.03, 0.036, 0.06])))):
            held[j] = "other"
        text = [f"d{i}x{j}" for j in range(rng.choice([10, 5000]))]
        texts.append((i, " ".join(text[:50] + held + text[50:])))
        x, y = shingles(items[-1][1], 5), shingles(texts[-1][1], 5)
        if 100 * len(x & y) >= 80 * len(x):
            want.add((i, i))
    got = contamination(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {(r["doc_id"], r["item_id"]) for r in got}
    assert found <= want and len(want) > 25 and len(found) >= 0.9 * len(want)


def test_signature_length():
    assert signature_length(1, 0.8) == 1 and signature_length(5, 0.8) == 2 and signature_length(10_000, 0.8) == 13


# --- op 4 ------------------------------------------------------------------------------------------------------


def test_token_counts(spark, odd, with_nulls, empty, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    for df in (odd, docs):
        want = {i: (len((x or "").encode()), len(library.encode(x or "", add_special_tokens=False).ids)) for i, x in texts_of(df).items()}
        rows = token_counts(df, path).collect()
        assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in rows} == want
        assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in rows)
    assert token_counts(with_nulls, path).count() == with_nulls.count() and token_counts(empty, path).collect() == []
    cases = ["  a", "a  b", "a \n b", " \n", "a\n b", "x  y z", "<|endoftext|> <|endoftext|>", "tail \n", "a\x1c b", "it's 1 2  \t3 '", "é" * 3000, "\n\n a\n\nb  "]
    odd_texts = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts(odd_texts, path).collect()} == {i: len(library.encode(x, add_special_tokens=False).ids) for i, x in enumerate(cases)}
    for x in cases:
        assert " ".join(safe_pieces(x)) == x


def test_token_counts_of_unspaced_texts():
    """Long pieces split at letters' ends, whole counts equal the library's, and only short pieces stay in the tables."""
    import public_tokenizers

    counter = Counts(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(2)
    signs = [*"abZ09 .,;:!?()'\n\t\r<|>_-\u3001\u3002\u300c\u300d\uff0c\u6f22\u5b57\u304b\u30ab\ud55c\u0436\xe9\x1c\u3000", "'s", "'ll", "<|endoftext|>", "\n\n"]
    texts = ["".join(rng.choices(signs, [rng.random() ** 2 + 0.01 for _ in signs], k=rng.choice([3, 80, 400]))) for _ in range(3000)]
    texts += ["\u6f22" * 30_000, "\u6f22\u5b57\u3002" * 20_000, "word," * 20_000, "a" * 65 + "\n" + "b" * 65]
    want = [len(e.ids) for e in counter.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert counter.count(texts) == want
    assert all(len(p) <= LONG_PIECE for table in counter.tables.values() for p in table)
    assert Counter(parts_of("\u6f22\u5b57\u3002" * 40)[0]) == {"\u6f22\u5b57": 1, "\u3002\u6f22\u5b57": 39, "\u3002": 1}
    for lead, table in counter.tables.items():
        assert counter.held[lead] == sum(sys.getsizeof(p) + ENTRY_BYTES for p in table)


def test_token_tables_are_bounded(monkeypatch):
    import public_tokenizers

    monkeypatch.setattr("activity_engine.llm.tokens.REMEMBERED_BYTES", 20_000)
    counter = Counts(public_tokenizers.path("byte_bpe_50k.json"))
    for i in range(20):
        texts = [f"w{i}x{j} and w{j}" for j in range(40)]
        assert counter.count(texts) == [len(counter.tokenizer.encode(x, add_special_tokens=False).ids) for x in texts]
        assert max(counter.held.values()) <= 20_000


def test_freeing_leaves_other_threads_tables(spark):
    """Each thread deletes what it wrote itself, also when both are at work at once."""
    both, kept = threading.Barrier(2, timeout=120), {}

    def work(frees):
        if frees:
            with freeing(spark):
                both.wait()
                kept["own"] = written(spark.range(3), "own").inputFiles()[0]
                both.wait()
        else:
            both.wait()
            kept["other"] = written(spark.range(4), "other").inputFiles()[0]
            both.wait()

    threads = [threading.Thread(target=work, args=(frees,)) for frees in (True, False)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    there = {k: os.path.exists(v.removeprefix("file://")) for k, v in kept.items()}
    assert there == {"own": False, "other": True}


# --- op 5 ------------------------------------------------------------------------------------------------------


def brute_substrings(texts, window):
    first = {}
    for i in sorted(texts):
        w = words(texts[i])
        for s in range(len(w) - window + 1):
            first.setdefault(tuple(w[s : s + window]), i)
    out = {}
    for i, t in texts.items():
        w, gone = words(t), set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < i:
                gone.update(range(s, s + window))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    return out


@pytest.mark.parametrize("window, prefix, group", [(8, 8, GROUP_BYTES), (10, 3, 20_000), (30, 4, 30_000), (50, 16, GROUP_BYTES), (50, 16, 60_000), (50, 16, 0)])
def test_substring_dedup(odd, docs, window, prefix, group, monkeypatch):
    monkeypatch.setattr("activity_engine.llm.substring_dedup.CHUNK_BYTES", 1 << 14)
    for df in (odd, docs):
        got = {r["doc_id"]: tuple(r)[1:] for r in substring_dedup(df, window=window, prefix=prefix, group_bytes=group).collect()}
        assert got == brute_substrings(texts_of(df), window)


def test_names_are_exact():
    rng = random.Random(3)
    words_ = [rng.choice("ab") for _ in range(300)]
    raw = np.frombuffer(" ".join(words_).encode(), np.uint8)
    starts, stops, _ = word_spans(raw, np.array([0, len(raw)]))
    numbers = word_numbers(raw, starts, stops)
    for depth in (1, 2, 3, 7, 50):
        names = names_at(numbers, depth)
        runs = [tuple(words_[i : i + depth]) for i in range(300 - depth + 1)]
        assert len(set(zip(runs, names.tolist(), strict=True))) == len(set(runs)) == len(set(names.tolist()))


def test_longer_prefixes_split_groups():
    """Equal windows have equal keys at every length, and windows of one key have one key at all shorter lengths."""
    rng = random.Random(5)
    common = [f"c{i}" for i in range(24)]
    texts = [" ".join(rng.choices("abc", k=rng.randrange(40)) + common + rng.choices("xyz", k=rng.randrange(60))) for _ in range(40)]
    window, lengths = 30, prefix_lengths(30, 4)
    assert lengths == [4, 12, 20, 28] and prefix_lengths(8, 8) == [8]
    w = _Windows(pa.array(texts * 2), window)
    runs = [tuple(words(texts[r % 40])[p : p + window]) for r, p in zip(w.row, w.place, strict=True)]
    keys, before, groups = None, None, []
    for length in lengths:
        keys = w.keys(w.row, w.place, length, keys)
        assert len(set(zip(runs, keys.tolist(), strict=True))) == len(set(runs))
        if before is not None:
            assert len(set(zip(keys.tolist(), before.tolist(), strict=True))) == len(set(keys.tolist()))
        groups.append(len(set(keys.tolist())))
        before = keys
    assert groups == sorted(set(groups)) and groups[-1] < len(set(runs))


@pytest.mark.parametrize("group", [300_000, 100_000, 0])
def test_groups_too_large_are_split(spark, group):
    """One passage with many continuations: its group is split by longer prefixes; nothing is lost at any bound."""
    rng = random.Random(6)
    common = [f"c{i}" for i in range(16)]
    tails = [[f"t{k}w{i}" for i in range(40)] for k in range(12)]
    rows = [(i, " ".join([f"h{i}"] * rng.randrange(5) + common + tails[i % 12][: rng.randrange(20, 40)] + [f"e{i}"])) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in substring_dedup(df, window=30, prefix=4, group_bytes=group).collect()}
    assert got == brute_substrings(dict(rows), 30)
    assert sum(v[1] > 0 for v in got.values()) > 150


def test_a_group_at_the_bound_fits_memory():
    """A worker that builds the largest subtree that is allowed grows by less than 200 MB."""
    code = """
import random, resource
import numpy as np, pyarrow as pa
from activity_engine.llm.substring_dedup import BYTE_COST, GROUP_BYTES, WORD_COST, copies_in
rng = random.Random(1)
vocabulary = ["w%d" % i for i in range(5000)]
texts, size = [], 0
while size < GROUP_BYTES:
    texts.append(" ".join(rng.choices(vocabulary, k=50)))
    size += len(texts[-1]) * BYTE_COST + 50 * WORD_COST
n = len(texts)
rows = pa.table([pa.array(range(n)), pa.array(range(n)), pa.array(np.zeros(n, np.int32)), pa.array(np.ones(n, np.int32)), pa.array(texts)], ["id", "t", "place", "n", "words"])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
copies_in(rows, 50)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=300)
    assert int(out.stdout) < 200, out.stdout


@pytest.mark.parametrize("group", [GROUP_BYTES, 0])
def test_repeats_are_maximal(spark, group):
    a, b = [f"a{i}" for i in range(30)], [f"b{i}" for i in range(30)]
    rows = [(1, " ".join(a + ["x"] + b)), (2, " ".join(["p", "q"] + a[5:20] + ["r"] + b[:12])), (3, " ".join(a + ["x"] + b)), (4, " ".join(a[:9] + ["s"] + a[:12] * 2))]
    got = repeats(spark.createDataFrame(rows, "doc_id long, text string"), window=10, prefix=4, group_bytes=group).collect()
    assert sorted((r["doc_id"], r["place"], r["n_words"]) for r in got if r["n_words"]) == [(2, 2, 15), (2, 18, 12), (4, 10, 12), (4, 22, 12)]
    assert [(r["doc_id"], r["place"]) for r in got if r["n_words"] is None] == [(3, 0)]


def test_substring_dedup_of_repeated_ids(spark):
    """Rows of one id lose what stands under a smaller id, each in its own text."""
    run = " ".join(f"w{i}" for i in range(12))
    rows = [(1, run), (2, run + " tail"), (2, "head head head " + run), (2, "no copy at all"), (2, run + " tail")]
    got = substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), window=10, prefix=4).collect()
    assert sorted((r["doc_id"], r["kept_text"]) for r in got) == [(1, run), (2, "head head head"), (2, "no copy at all"), (2, "tail"), (2, "tail")]


def test_substring_dedup_edges(with_nulls, empty):
    assert substring_dedup(empty).collect() == []
    rows = substring_dedup(with_nulls).collect()
    assert len(rows) == with_nulls.count() and all(r["n_removed"] == 0 for r in rows if r["doc_id"] is None)


# --- op 6 ------------------------------------------------------------------------------------------------------


def check_mix(rows, weights=(5, 2, 1)):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["source"]] += r["size"]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    target, free, goal = {}, set(order), 1.5 * sum(sizes.values())
    while free:
        level = goal / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > 2 * sizes[s]}
        for s in over or free:
            target[s] = 2 * sizes[s] if over else level * w[s]
        goal -= sum(target[s] for s in over)
        free = free - over if over else set()
    taken = defaultdict(int)
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]])
        taken[r["source"]] += r["taken"]
    for s in order:
        assert abs(taken[s] - target[s]) <= 70 + 0.01 * target[s]


def test_mixture(spark, odd, with_nulls, empty, docs):
    for df in (odd, with_nulls, docs):
        rows = mixture(df).collect()
        assert len(rows) == df.count()
        check_mix(rows)
        assert sorted(map(str, rows)) == sorted(map(str, mixture(df).collect()))
    assert mixture(empty).collect() == []
    blank = mixture(odd.filter("doc_id <= 102")).collect()
    assert len(blank) == 3 and all(r["taken"] == 0 and r["target"] == 0 for r in blank)


def test_mixture_of_many_shards(docs, monkeypatch):
    monkeypatch.setattr("activity_engine.llm.mixing.SHARD_WORDS", 1000)
    check_mix(mixture(docs, block=16).collect())


def brute_seats(parties, house):
    """Highest quotients one seat at a time; parties: (key, quota, cap)."""
    held = {k: 0 for k, _, _ in parties}
    for _ in range(house):
        free = [(-q / (2 * held[k] + 1), k) for k, q, cap in parties if held[k] < cap and q > 0]
        if not free:
            break
        held[min(free)[1]] += 1
    return held


def test_sainte_lague(spark):
    """A hot party beside many small ones lies far from its quota."""
    rng = random.Random(5)
    groups = {
        "small": [("hot", 100.0, 1000)] + [(f"p{i:03}", 0.4, 5) for i in range(100)],
        "large": [("hot", 100.0, 1000)] + [(f"p{i:03}", 0.6, 5) for i in range(100)],
        "full": [("hot", 100.0, 100)] + [(f"p{i:03}", 0.4, 2) for i in range(100)],
        "all": [("a", 6.0, 6), ("b", 4.0, 4), ("c", 0.0, 0)],
        "none": [("a", 0.0, 4), ("b", 0.0, 2)],
        "one": [("a", 7.0, 9)],
        "empty": [("a", 0.0, 0)],
    }
    for n in range(12):
        caps = [rng.choice([0, 1, 2, 3, 50, 400]) for _ in range(rng.randint(1, 60))]
        groups[f"r{n}"] = [(f"p{i:03}", rng.choice([c, c / 2, c * rng.random()]) * 1.0, c) for i, c in enumerate(caps)]
    house = {g: round(sum(q for _, q, _ in parties)) for g, parties in groups.items()}
    rows = [(g, k, q, cap, house[g]) for g, parties in groups.items() for k, q, cap in parties]
    df = spark.createDataFrame(rows, "g string, k string, quota double, cap long, house long")
    got = {(r["g"], r["k"]): r["held"] for r in sainte_lague(df, ["g"], ["g", "k"], "quota", "cap", "house", "held").collect()}
    assert got == {(g, k): n for g, parties in groups.items() for k, n in brute_seats(parties, house[g]).items()}
    assert got["small", "hot"] == 125 and got["large", "hot"] == 83 and got["full", "hot"] == 100


# --- op 7 ------------------------------------------------------------------------------------------------------


def test_warc(spark, tmp_path):
    import base64
    import gzip

    inner = gzip.compress(b"WARC/1.1\r\nnot a record") * 3
    pages = [(1, "http://a/", "same"), (2, "http://b/\r\nx: y", "same"), (3, "u", None), (4, None, ""), (5, "u", "x" * 3_000_000), (None, "u", "same"), (6, "u", "WARC/1.1\r\n\r\n\x1f"), (7, "u", inner.decode("latin1"))]
    pages += [(10 + i, f"u{i}", hashlib.sha256(str(i).encode()).hexdigest() * (i % 50)) for i in range(500)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("path", F.lit("x"))
    manifest = write_warc(df, f"file://{tmp_path}/w", file_bytes=40_000)
    last = defaultdict(int)
    for i, _, h in pages:
        last[h or ""] = max(last[h or ""], i or 0)
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    want = sorted(str((i, len((h or "").encode()), digest(h), "response" if i is None or last[h or ""] == i else "revisit", None if i is None or last[h or ""] == i else last[h or ""])) for i, _, h in pages)
    for split in (700, 9_000, 8 << 20):
        rows = read_warc(spark, manifest, f"file://{tmp_path}/w", split_bytes=split).collect()
        assert sorted(str((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])) for r in rows) == want
        whole = {i: (h or "").encode() for i, _, h in pages}
        assert all(bytes(r["payload"]) == whole[r["page_id"]] for r in rows if r["record_type"] == "response" and r["page_id"])
    assert manifest.count() > 1
    assert read_warc(spark, write_warc(df.limit(0), f"file://{tmp_path}/e"), f"file://{tmp_path}/e").collect() == []


def test_warc_of_another_writer(spark, tmp_path):
    """Records of all types, odd headers, ids that aren't numbers, several records in one member, and rubbish between."""
    import gzip

    def member(*records):
        return gzip.compress(b"".join(h.encode() + b"\r\n\r\n" + block + b"\r\n\r\n" for h, block in records))

    u = lambda n: f"<urn:uuid:00000000-0000-0000-0000-{n:012}>"
    http = b"HTTP/1.1 200 OK\r\ncontent-TYPE: text/html\r\n\r\n<p>x</p>"
    data = member((f"WARC/1.0\r\nwarc-type: warcinfo\r\nWARC-Record-ID:{u(1)}\r\nContent-Type: application/warc-fields\r\nContent-Length: 12", b"software: x\n"))
    data += member((f"WARC/1.1\r\nWARC-Type: response\r\nWARC-RECORD-ID: {u(2)}\r\nWARC-Target-URI:   http://a/\r\n b\r\ncontent-type: Application/HTTP;msgtype=response\r\ncontent-length:{len(http)}", http))
    data += gzip.compress(b"no record at all") + b"\x1f\x8b\x08 not a member"
    data += member(
        (f"WARC/1.1\r\nWARC-Type: request\r\nWARC-Record-ID: {u(3)}\r\nContent-Type: application/http; msgtype=request\r\nContent-Length: 18", b"GET / HTTP/1.1\r\n\r\n"),
        (f"WARC/1.1\r\nWARC-Type: metadata\r\nWARC-Record-ID: {u(4)}\r\nContent-Length: 0", b""),
    )
    data += member((f"WARC/1.1\r\nWARC-Type: revisit\r\nWARC-Record-ID: {u(5)}\r\nWARC-Refers-To: {u(2)}\r\nWARC-Payload-Digest: sha1:ABC\r\nContent-Length: 0", b""))
    data += gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: many\r\n\r\n") + member(("WARC/1.1\r\nWARC-Type: conversion\r\nContent-Length: 3", b"abc"))
    (tmp_path / "foreign.warc.gz").write_bytes(data)
    manifest = spark.createDataFrame([(f"{tmp_path}/foreign.warc.gz", len(data))], "path string, size long")
    for split in (50, 1 << 20):
        rows = {r["record_type"]: r for r in read_warc(spark, manifest, f"file://{tmp_path}", split_bytes=split).collect()}
        assert set(rows) == {"warcinfo", "response", "request", "metadata", "revisit", "conversion"}
        assert bytes(rows["response"]["payload"]) == b"<p>x</p>" and rows["response"]["url"] == "http://a/ b" and rows["response"]["page_id"] is None
        assert (rows["revisit"]["refers_to_id"], rows["revisit"]["payload_digest"], rows["revisit"]["payload_bytes"]) == (u(2), "ABC", None)
        assert bytes(rows["conversion"]["payload"]) == b"abc" and rows["conversion"]["record_id"] is None and rows["warcinfo"]["record_id"] == u(1)


# --- op 8 ------------------------------------------------------------------------------------------------------


def solid_lines(text):
    lines = (text or "").split("\n")
    return lines, [j for j, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x)]


def brute_prefixes(texts):
    """{(doc, place): lines from there on that also begin at another place}."""
    lines = {i: [ls[j] for j in solid] for i, t in texts.items() for ls, solid in [solid_lines(t)]}
    alive, out, d = [(i, p) for i, x in lines.items() for p in range(len(x))], {}, 1
    while alive:
        seen = Counter(tuple(lines[i][p : p + d]) for i, p in alive)
        alive = [(i, p) for i, p in alive if seen[tuple(lines[i][p : p + d])] > 1]
        out |= {x: d for x in alive}
        d += 1
        alive = [(i, p) for i, p in alive if p + d <= len(lines[i])]
    return out


def brute_lines(texts, n):
    seen, out, common = set(), {}, brute_prefixes(texts)
    for i in sorted(texts):
        lines, solid = solid_lines(texts[i])
        gone = set()
        for p in range(len(solid) - n + 1):
            run = tuple(lines[j] for j in solid[p : p + n])
            if run in seen:
                gone.update(solid[p : p + n])
            seen.add(run)
        kept = "\n".join(x for j, x in enumerate(lines) if j not in gone)
        longest = max([common.get((i, p), 0) for p in range(len(solid))], default=0)
        out[i] = (len(solid), len(gone), longest, hashlib.sha256(kept.encode()).hexdigest(), kept)
    return out


@pytest.fixture(scope="module")
def nested(spark):
    """Runs of many lengths inside each other."""
    rng = random.Random(11)
    base = [f"line {i}" for i in range(40)]
    rows = []
    for i in range(25):
        parts = []
        for _ in range(rng.randint(0, 4)):
            a = rng.randrange(40)
            parts += base[a : a + rng.choice([1, 2, 3, 5, 8, 13])] + [f"own {i} {rng.random()}"] * rng.randint(0, 1)
        rows.append((i, "\n".join(parts)))
    return written(spark.createDataFrame([*rows, (30, rows[3][1]), (31, rows[3][1] + "\nlast"), (32, "z\nz\nz\nz\nz")], "doc_id long, text string"), "nested")


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8])
def test_line_dedup(odd, docs, nested, n):
    for df in (odd, nested) if n in (3, 8) else (odd, docs, nested):
        assert {r["doc_id"]: tuple(r)[1:] for r in line_dedup(df, min_lines=n).collect()} == brute_lines(texts_of(df), n)


@pytest.mark.parametrize("n", [1, 4])
def test_line_runs(nested, n):
    texts = {}
    for i, t in sorted(texts_of(nested).items()):
        if t not in texts.values():
            texts[i] = t
    common = brute_prefixes(texts)
    want = {(i, p, d) for (i, p), d in common.items() if d >= n and common.get((i, p - 1), 0) <= d}
    assert {(r["doc_id"], r["place"], r["n_lines"]) for r in line_runs(nested, min_lines=n).collect()} == want


@pytest.mark.parametrize("n", [1, 4])
def test_later_runs(nested, n):
    """A run that begins earlier, too, by comparing each place with all before it."""
    texts = {}
    for i, t in sorted(texts_of(nested).items()):
        if t not in texts.values():
            texts[i] = t
    lines = {i: [ls[j] for j in solid] for i, t in texts.items() for ls, solid in [solid_lines(t)]}
    seen, common = set(), {}
    for i, x in lines.items():
        for p in range(len(x)):
            common[i, p] = max((d for d in range(len(x) - p + 1) if tuple(x[p : p + d]) in seen), default=0)
            seen |= {tuple(x[p : p + d]) for d in range(1, len(x) - p + 1)}
    want = {(i, p, d) for (i, p), d in common.items() if d >= n and common.get((i, p - 1), 0) <= d}
    assert {(r["doc_id"], r["place"], r["n_lines"]) for r in later_runs(nested, min_lines=n).collect()} == want


def test_deletion_comes_from_the_deeper_levels(nested, monkeypatch):
    """Without names of two lines and more there are no runs of three, and nothing but whole copies goes."""
    from activity_engine.llm import line_dedup as module

    whole = module._doubled
    monkeypatch.setattr(module, "_doubled", lambda names: whole(names)[:1])
    rows = {r["doc_id"]: r["n_removed"] for r in line_dedup(nested, min_lines=3).collect()}
    assert {i for i, n in rows.items() if n} <= {30} and len(rows) == nested.count()


def test_line_dedup_edges(with_nulls, empty):
    assert line_dedup(empty).collect() == []
    rows = line_dedup(with_nulls).collect()
    assert len(rows) == with_nulls.count() and all(r["n_removed"] == 0 for r in rows if r["doc_id"] is None)


# --- op 9 ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("bucket", [300, 50_000, 24 << 20])
def test_edited_fingerprints(odd, docs, bucket, monkeypatch):
    monkeypatch.setattr("activity_engine.llm.simhash.BUCKET_BYTES", bucket)
    for df in (odd, docs, docs.limit(1)):
        t = {i: x or "" for i, x in texts_of(df).items()}
        order = sorted(t, reverse=True)
        rows = {r["doc_id"]: r for r in edited_fingerprints(df).collect()}
        assert sorted(rows) == sorted(t)
        prints = defaultdict(set)
        for i, r in rows.items():
            k = len(t[i]) // 2
            after = order[(order.index(i) + 1) % len(order)]
            edited = t[i][: len(t[i]) - k] + t[after][:k]
            assert (r["n_chars"], r["edited_sha256"]) == (len(t[i]), hashlib.sha256(edited.encode()).hexdigest())
            prints[t[i]].add(r["fingerprint"])
            near = lambda a, b: 1 - (int(a, 16) ^ int(b, 16)).bit_count() / 128
            assert r["n_near"] == sum(0 < (int(r["fingerprint"], 16) ^ int(x, 16)).bit_count() <= 3 for x in {y["fingerprint"] for y in rows.values()})
            assert r["near_edited"] == near(r["fingerprint"], r["edited_fingerprint"]) and r["near_next"] == near(r["fingerprint"], rows[after]["fingerprint"])
        assert all(len(x) == 1 for x in prints.values())


def test_edited_fingerprints_edges(with_nulls, empty):
    assert edited_fingerprints(empty).collect() == []
    rows = edited_fingerprints(with_nulls).collect()
    assert Counter(str(r["doc_id"]) for r in rows) == Counter(str(r["doc_id"]) for r in with_nulls.collect())


def test_votes(spark, odd, docs):
    """Each bit is set if more than half of the terms' hashes set it; a term votes as often as it occurs."""
    for df in (odd, docs):
        w = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda x: x != "")
        pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - 2, F.lit(0))), lambda i: F.struct(F.get("w", i).alias("x"), F.get("w", i + 1).alias("y")))
        t = df.select("doc_id", w.alias("w")).filter("size(w) > 0").select("doc_id", F.explode(pairs).alias("p")).select("doc_id", "p.*")
        terms = defaultdict(list)
        for r in t.select("doc_id", F.xxhash64("x", "y").alias("a"), F.xxhash64(F.lit(1), "y", "x").alias("b")).collect():
            terms[r["doc_id"]].append((r["a"] % (1 << 64)) << 64 | r["b"] % (1 << 64))
        for r in edited_fingerprints(df).collect():
            hashes = terms[r["doc_id"]]
            want = sum(1 << j for j in range(128) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))
            assert int(r["fingerprint"], 16) == want
    assert len({r["fingerprint"] for r in edited_fingerprints(docs).collect()}) > 150


@pytest.mark.parametrize("n", [1, 2, 7, 100])
def test_id_bounds(spark, n):
    ids = [3 * i for i in range(500)] + [7] * 200
    bounds = id_bounds(spark.createDataFrame([(i,) for i in ids] + [(None,)], "id long"), n)
    assert bounds == sorted(set(bounds), reverse=True) and bounds[0] == max(ids) and set(bounds) <= set(ids)
    assert n // 3 <= len(bounds) <= 2 * n + 1
    placed = spark.createDataFrame([(i,) for i in ids], "id long").select("id", _place_among(F.col("id"), bounds).alias("p")).distinct().collect()
    assert all(r["p"] == sum(b >= r["id"] for b in bounds) for r in placed)


def test_near_fingerprints(spark):
    import random

    rng = random.Random(5)
    prints = [rng.getrandbits(128) for _ in range(60)]
    for p in prints[:30]:
        for n in (1, 3, 4):
            prints.append(p ^ sum(1 << b for b in rng.sample(range(128), n)))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(signed(p >> 64), signed(p & (1 << 64) - 1)) for p in prints]
    got = near_fingerprints(spark.createDataFrame(rows + rows[:5] + [(None, 1)], "f1 long, f2 long")).collect()
    want = {frozenset((rows[i], rows[j])) for i, a in enumerate(prints) for j, b in enumerate(prints) if i < j and 0 < (a ^ b).bit_count() <= 3}
    assert {frozenset(((r["a1"], r["a2"]), (r["b1"], r["b2"]))) for r in got} == want and len(got) == len(want)


# --- op 10 -----------------------------------------------------------------------------------------------------


def test_grammar():
    m = Matcher({"idiot": 0.9, "moron": 0.8})
    kinds = lambda s: [k for k, _ in m.matches(s)]
    assert kinds("You are an idiot") == ["targeted"] and kinds("the idiot that you are") == ["targeted"]
    assert kinds("the idiot ran") == [] and kinds("the idiot ran. a dog. the idiot slept. moron!") == ["sustained", "sustained"]
    assert kinds("idiot and moron") == ["piled"]
    assert kinds("she is not an idiot") == ["negated"]
    assert kinds("someone said the word idiot") == ["reported"] and kinds("someone said. idiot, you") == ["targeted"]
    assert kinds("i will kill you") == ["threat"] and kinds("kill time") == [] and kinds("you kill time") == []
    assert [w for _, w in m.matches("you moron")] == [0.8]
    stems = Matcher({"scum": 0.9, "scumm*": 0.7, "dumm*": 0.75})
    assert [w for _, w in stems.matches("you scum! you scummy dummer dumm")] == [0.9, 0.7, 0.75]


def test_clauses_not_words():
    """Mentions, compounds and verbs of violence without intent and person score nothing; frames do, in one clause alone."""
    m = Matcher({"idiot": 0.9, "moron": 0.8, "trash": 0.9, "garbage": 0.9, "trottel": 0.9})
    kinds = lambda s: [k for k, _ in m.matches(s)]
    for text in ("The word idiot. The word moron.", "Garbage collection. Trash bin.", "kill the process, they said", "they shoot photos; crush your goals", "I burn them", "will kill. you", "you will kill time", "going home to beat the eggs for you"):
        assert kinds(text) == []
    for text in ("we'll hurt them", "kill yourself", "they are going to beat him", "people will crush you", "i want to punish her"):
        assert kinds(text) == ["threat"]
    assert kinds("i will not kill you") == [] and kinds("he said i will kill you") == []
    assert kinds("trash truck, you trash") == ["targeted"] and kinds("i will kill you idiot") == ["threat", "targeted"]
    assert kinds("ein trottel, dich meine ich") == ["targeted"] and kinds("kein trottel") == ["negated"] and kinds("dijo idiot") == ["reported"]


def test_scores_by_hand(spark):
    """1 - (1 - floor) * prod(1 - weight * class weight), worked out match by match; a match has the weight of the word that ends it, persons have 1."""
    classes = {"threat": 0.95, "targeted": 0.9, "piled": 0.8, "sustained": 0.5, "reported": 0.4, "negated": 0.25}
    model = {"weights": {"idiot": 0.8, "moron": 0.5, "scumm*": 0.6}, "classes": classes, "floor": 0.1}
    cases = {
        None: 0.1, "": 0.1, "  ": 0.1, "a clean text": 0.1, "the idiot ran": 0.1, "the word idiot. a word, moron.": 0.1, "trash bin": 0.1,
        "you idiot": 1 - 0.9 * (1 - 0.72), "idiot! you": 0.1, "the moron they saw": 1 - 0.9 * (1 - 0.9), "you scummy dog": 1 - 0.9 * (1 - 0.54),
        "idiot and moron": 1 - 0.9 * (1 - 0.4), "idiot. moron.": 1 - 0.9 * (1 - 0.25), "idiot. moron. idiot.": 1 - 0.9 * 0.75 * 0.6,
        "not an idiot": 1 - 0.9 * (1 - 0.2), "said idiot": 1 - 0.9 * (1 - 0.32), "said idiot and moron": 1 - 0.9 * 0.68 * 0.8,
        "i will hurt you": 1 - 0.9 * (1 - 0.95), "hurt you": 0.1, "i will hurt you, moron": 1 - 0.9 * 0.05 * (1 - 0.45), "you idiot. moron.": 1 - 0.9 * 0.28 * 0.75,
        "idiot " * 3: 1 - 0.9 * (1 - 0.64) ** 2,
    }
    rows = scored(spark.createDataFrame([(x,) for x in cases], "text string"), model).collect()
    assert len(rows) == len(cases) and all(abs(r["score"] - cases[r["text"]]) < 1e-12 for r in rows)


def test_composition_is_one_after_the_other():
    """What a composed table writes is what its parts write in turn, on all short inputs and on random long ones."""
    whole = grammar()
    for parts in ([negation(), reported_speech(), clause(), sustained()], [negation(), reported_speech(), threat_frame(), matches_of_clauses(), sustained()]):
        check_composition(whole, parts)
    halves = tabulate(0, ("a",), lambda s, x: (1 - s, "b", 0.5))
    assert list(compose(halves, tabulate(0, ("b",), lambda s, x: (s, "c", 0.5))).run([("a", 1.0)] * 2)) == [("c", 0.25)] * 2


def check_composition(whole, parts):
    from itertools import product

    rng = random.Random(7)
    inputs = [list(x) for n in range(4) for x in product(whole.inputs, repeat=n)] + [rng.choices(whole.inputs, k=200) for _ in range(200)]
    for symbols in inputs:
        weighted = [(s, 0.5 + 0.001 * i) for i, s in enumerate(symbols)]
        one, turn = list(whole.run(weighted)), iter(weighted)
        for p in parts:
            turn = iter(list(p.run(turn)))
        assert one == list(turn)


def test_toxicity(spark, with_nulls, empty):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = toxicity(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    held = [(r["predicted"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert sum(p == t for p, t in held) / len(held) > 0.93
    caught = [p for p, t in held if t]
    assert sum(caught) / len(caught) > 0.6 and sum(p for p, t in held if not t) <= 0.02 * len(held)
    none = labels.limit(0)
    assert toxicity(empty, none).collect() == [] and toxicity(with_nulls, none).count() == with_nulls.count()
