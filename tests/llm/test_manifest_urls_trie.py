"""Merkle manifest, url filters and conversation trie against brute force, on odd rows and on the smallest tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from activity_engine.llm.merkle import merkle_manifest, tampered, verified
from activity_engine.llm.trie import BAND, BLOCK, PIECE, conversation_trie, placed_turns, prefix_trie, rebuilt
from activity_engine.llm.url_filters import LINK, RULES, host_links, rule_table, url_verdicts


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def lower(t):
    return t if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


# --- Merkle manifest -------------------------------------------------------------------------------------------


def leaf(r, text):
    out = ""
    for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text):
        out += "-" if v is None else f"{len(str(v).encode())}:{v}"
    return sha(out)


def climb_all(digests):
    """The root over a list, and of each item its siblings as (before, after) level by level."""
    ways, at, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        runs = [level[i : i + 8] for i in range(0, len(level), 8)]
        for w, p in zip(ways, at, strict=True):
            run = runs[p // 8]
            w.append(("".join(run[: p % 8]), "".join(run[p % 8 + 1 :])))
        at = [p // 8 for p in at]
        level = [sha("".join(r)) for r in runs]
    return (level[0] if level else None), ways


def manifest_of(rows):
    langs = defaultdict(list)
    for r in rows:
        hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
        langs[r["lang"]].append((r["doc_id"], leaf(r, r["text"]), leaf(r, lower(r["text"]) if hit else r["text"])))
    names = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    for n in names:
        langs[n].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
    subs = [climb_all([x[1] for x in langs[n]]) for n in names]
    root, over = climb_all([s[0] for s in subs])
    out = []
    for n, (sub, ways), above in zip(names, subs, over, strict=True):
        for (i, mine, now), way in zip(langs[n], ways, strict=True):
            folded = now
            for b, a in way + above:
                folded = sha(b + folded + a)
            out.append((i, mine, sub, root, sha("".join(b + a for b, a in way + above)), folded, folded == root))
    return sorted(map(str, out))


MERKLE = "doc_id long, source string, lang string, n_chars long, text string, tree int, leaf string, place int, n int, value string, id string, now string"


def merkle_rows():
    rows = [(i, f"s{i % 3}", "en", i, f"Text NUMBER {i}") for i in range(600)]
    rows += [(i, None, None, None, None) for i in range(1000, 1009)] + [(2000, "s", "de", 1, ""), (7, "s1", "en", 7, "Text NUMBER 7"), (7, "s1", "en", 7, "another")]
    rows += [(None, "s", "en", 3, "ABC"), (None, "s", "en", 3, "ABC"), (3000, "é", "日本", 9, "Ünï ABC\n"), (3001, "", "", 0, "Q" * 300_000)]
    rows += [(4000 + i, "s", f"l{i}", 1, "T") for i in range(12)]
    return [(*r, 5, "l", 6, 7, "v", "i", "n") for r in rows]


def merkle_result(df):
    return sorted(str(tuple(r)) for r in df.select("id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())


def test_merkle_odd_rows(spark):
    docs = spark.createDataFrame(merkle_rows(), MERKLE)
    got = verified(merkle_manifest(docs, now=tampered(docs)))
    assert merkle_result(got) == manifest_of([r.asDict() for r in docs.collect()])


@pytest.mark.parametrize("n, langs", [(1, 1), (8, 1), (9, 1), (3, 3), (10, 9)])
def test_merkle_small_trees(spark, n, langs):
    docs = spark.createDataFrame([(i, "s", f"l{i % langs}", 1, f"A{i}") for i in range(n)], "doc_id long, source string, lang string, n_chars long, text string")
    assert merkle_result(verified(merkle_manifest(docs, now=tampered(docs)))) == manifest_of([r.asDict() for r in docs.collect()])


def test_merkle_empty_and_untouched(spark):
    docs = spark.createDataFrame(merkle_rows(), MERKLE)
    m = merkle_manifest(docs.limit(0))
    assert m.root is None and verified(m).count() == 0
    assert verified(merkle_manifest(docs)).filter("NOT verified").count() == 0


def test_merkle_finds_one_changed_row(spark):
    docs = spark.createDataFrame(merkle_rows(), MERKLE)
    changed = {"text": F.when(F.col("doc_id") == 123, F.lit("changed")).otherwise(F.col("text"))}
    assert [r["id"] for r in verified(merkle_manifest(docs, now=changed)).filter("NOT verified").collect()] == [123]


# --- url filters -----------------------------------------------------------------------------------------------


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    return lower(host), re.match(r"[^?#]*", rest[len(host) :]).group()


def verdicts_of(pages, rules, rounds=20, damping=85, percent=50):
    def fit(host, path):
        found = [(len(h + p), len(h), v == "block", h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(found) if found else None

    seeds, links = Counter(), Counter()
    for _, url, html in pages:
        host, path = parts(url)
        best = fit(host, path)
        if best and host:
            seeds[int(best[2]), host] += 10**6
        for dst in {lower(x) for x in re.findall(LINK, html or "")}:
            if host and dst != host:
                links[0, host, dst] += 1
                links[1, dst, host] += 1
    totals = Counter()
    for (k, a, _), n in links.items():
        totals[k, a] += n
    mass, came = Counter(seeds), seeds
    for _ in range(rounds):
        new = Counter()
        for (k, a, b), n in links.items():
            new[k, b] += came[k, a] * damping * n // (100 * totals[k, a])
        came = new
        mass.update(new)
    out = []
    for i, url, _ in pages:
        host, path = parts(url)
        best, t, d = fit(host, path), mass[0, host], mass[1, host]
        verdict = ("block" if best[2] else "allow") if best else "block" if d * (100 - percent) > t * percent else "allow"
        out.append((i, host, path, best[3] if best else None, verdict, t, d))
    return sorted(map(str, out))


URLS = "page_id long, url string, html string, host string, path string, verdict string, n int, kind int, at string"


def linked_pages():
    rows = [(1, "http://good.org/x", '<a href="http://Mid.net/p">m</a> <a href=//far.net>f</a> <a href="/own">o</a>'), (2, "https://mid.net/", "<a class='x' href='https://end.net?q'>"), (3, "http://end.net", None)]
    rows += [(4, "http://spam.com/de/1", "<a href='http://victim.net/'>"), (5, "http://farm.net/a", '<a href="http://spam.com/de/2"><a href="http://spam.com/de/2">'), (6, "http://boss.net/", '<a href="http://farm.net/x"> <a href="http://good.org/">')]
    rows += [(7, None, None), (8, "no scheme", "<a href='http://good.org'>"), (9, "http://", ""), (10, "HTTP://User@EXAMPLE.org:80/es/x#y", ""), (11, "a://example.org/es/é?x://y", ""), (12, "http://xexample.org/es/", "")]
    rows += [(13, "http://a.example.org/en/10", ""), (14, "http://example.org/en/2", ""), (15, "http://a.b.c.com/fr/", ""), (16, "http://com/de/", ""), (17, "http://com", ""), (18, "http://" + "a." * 3000 + "com/fr/" + "p" * 9000, "<a href=http://big.net/>" * 2000)]
    rows += [(None, "http://good.org/x", ""), (1, "http://good.org/x", '<a href="http://Mid.net/p">'), (19, "http://good.org?x=/y", ""), (20, "http://x.org/\nz", "")]
    rows += [(100 + i, f"http://hot.net/{i % 5}", f'<a href="http://h{i % 40}.net/"><a href="http://spam.com/de/">') for i in range(300)]
    return [(*r, "h", "p", "v", 1, 2, "a") for r in rows]


def test_urls_with_links(spark):
    pages = spark.createDataFrame(linked_pages(), URLS)
    got = url_verdicts(pages, rule_table(spark))
    want = verdicts_of([tuple(r)[:3] for r in pages.collect()], RULES)
    assert sorted(str(tuple(r)) for r in got.collect()) == want
    by_id = {r["page_id"]: r for r in got.filter("page_id IS NOT NULL").collect()}
    assert [by_id[i]["verdict"] for i in (2, 3, 5, 6, 7, 100)] == ["allow", "allow", "block", "block", "allow", "block"]
    assert by_id[3]["trust"] > 0 and by_id[6]["distrust"] > 0


def test_urls_rules(spark):
    """Ties of length go to the longer host, then to what blocks; rules may be empty, null or repeated, as may pages."""
    pages = spark.createDataFrame([r for r in linked_pages() if r[0] is None or r[0] < 18], URLS)
    rules = [("allow", "b.c.com", ""), ("block", "c.com", "/f"), ("block", "org", "/"), ("allow", "org", "/"), ("allow", "org", "/"), ("allow", "example.org", "/es/é"), ("block", "", "/"), ("block", "com", "/fr/")]
    got = url_verdicts(pages, rule_table(spark, rules + [("block", None, "/"), ("block", "net", None)]), rounds=3)
    assert sorted(str(tuple(r)) for r in got.collect()) == verdicts_of([tuple(r)[:3] for r in pages.collect()], rules, rounds=3)
    none = url_verdicts(pages, rule_table(spark, []))
    assert none.filter("verdict = 'allow' AND rule IS NULL").count() == pages.count()
    assert url_verdicts(pages.limit(0), rule_table(spark)).count() == 0


def test_urls_no_python_and_no_pairs(spark):
    pages = spark.createDataFrame(linked_pages(), URLS)
    for df in (url_verdicts(pages, rule_table(spark)), host_links(pages)):
        plan = df._jdf.queryExecution().toString()
        assert not re.search("ArrowEval|BatchEvalPython|MapInArrow|CartesianProduct|NestedLoop", plan)


# --- conversation trie -----------------------------------------------------------------------------------------


def trie_of(convs):
    """From {conv_id: [(role, text), ..]}; a node is numbered by the node above it and its turn."""
    numbers, above, last, depth, members, ends = {}, [None], [""], [0], defaultdict(list), defaultdict(list)
    for c, turns in sorted(convs.items()):
        at = 0
        members[0].append(c)
        for t in turns:
            if (at, t) not in numbers:
                numbers[at, t] = len(above)
                above.append(at), last.append(t[1]), depth.append(depth[at] + 1)
            at = numbers[at, t]
            members[at].append(c)
        ends[at].append(c)
    n = len(above) if convs else 0
    children = Counter(above[1:])
    leaves, saved = [int(not children[k]) for k in range(n)], [(len(members[k]) - 1) * len(last[k]) for k in range(n)]
    for k in range(n - 1, 0, -1):  # children have larger numbers
        leaves[above[k]] += leaves[k]
        saved[above[k]] += saved[k]
    row = lambda k: (members[k][0], depth[k], members[above[k]][0] if k else None, len(members[k]), children[k], leaves[k], saved[k], sha(",".join(map(str, sorted(ends[k])))))
    return sorted(str(row(k)) for k in range(n))


def ordered(rows):
    out = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            out[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in out.items()}


def rebuilt_of(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = convs.get(c - c % 100, [])[:h] + turns[h:]
    return out


TRIE = "conv_id long, turn long, role string, text string, place int, depth int, a string, x int, row int"


def trie_rows():
    rows = [(c, t, "user" if t % 2 else "assistant", f"turn {t} é" if t < 3 else f"turn {t} of {c % 4}") for c in range(100, 160) for t in range(c % 11)]
    rows += [(c, t, "u", "same") for c in range(300, 300 + 3 * PIECE) for t in range(2)]
    rows += [(7, t, "u", f"long {t % 7}") for t in range(2 * BLOCK + 3 * BAND + 5)] + [(8, t, "u", f"long {t % 7}") for t in range(BLOCK + BAND)]
    rows += [(20, None, None, None), (20, 1, None, "x"), (20, 1, None, "x"), (20, 1, "b", "a"), (20, 1, "a", "b"), (21, None, "", ""), (None, 1, "u", "lost"), (22, 5, "u", "y" * 200_000)]
    rows += [(400 + k, 0, "u", "copy") for k in range(6)] * 2
    return [(*r, 1, 2, "a", 3, 4) for r in rows]


def trie_result(df):
    return sorted(str(tuple(r)) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())


def test_trie_odd_rows(spark):
    df = spark.createDataFrame(trie_rows(), TRIE)
    convs = ordered([r[:4] for r in trie_rows()])
    assert trie_result(conversation_trie(df)) == trie_of(convs)
    assert trie_result(prefix_trie(*rebuilt(placed_turns(df)))) == trie_of(rebuilt_of(convs))


def test_trie_empty(spark):
    df = spark.createDataFrame(trie_rows(), TRIE)
    assert trie_result(conversation_trie(df.limit(0))) == []
    assert trie_result(conversation_trie(df.filter("conv_id IS NULL"))) == []
    one = df.filter("conv_id = 21")
    assert trie_result(prefix_trie(*rebuilt(placed_turns(one)))) == trie_of(rebuilt_of({21: [("", "")]}))
