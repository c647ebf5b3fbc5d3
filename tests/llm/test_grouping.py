"""Spelling groups, clusters and URL filters against brute force, and on nulls, ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabmend.llm.blocked_filter import BlockedFilter, among, not_among
from tabmend.llm.centroids import Centroids, cluster_vectors
from tabmend.llm.spelling import spelling_groups
from tabmend.llm.url_filter import canonical, filter_urls, host_path

CLASH = ["word", "n", "key", "canon", "canon_", "row_", "host_", "possible_", "block_", "v", "c_", "cluster", "rule_"]


def clashing(df):
    return df.withColumns({c: F.lit(1) for c in CLASH if c not in df.columns})


def bag(df):
    return Counter(tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in df.collect())


# --- spelling ---


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_groups(rows, slips=97, letters=5, times=3):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            at = h % len(run)
            count[run[:at] + run[at + 1 :] if h % slips == 0 else run] += 1
    count = {w: n for w, n in count.items() if len(w) >= letters and n >= times}
    near = {w: [o for o in count if one_edit(w, o)] for w in count}
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda o: (-count[o], o))
            if count[best] >= 2 * count[w]:
                form[w] = best
    out = Counter()
    for w, n in count.items():
        root = w
        while root in form:
            root = form[root]
        out[(w, form.get(w), root, n, len(near[w]), count[form[w]] if w in form else None)] += 1
    return out


def dense_words(seed, alphabet="abéÀ", n=4_000):
    r = random.Random(seed)
    some = ["".join(r.choice(alphabet) for _ in range(r.randint(4, 7))) for _ in range(300)]
    return [some[int(300 * r.random() ** 3)] for _ in range(n)]


@pytest.mark.parametrize(("first", "second"), [(1, 4), (3, 1), (2, 3), (1, 2)])
def test_spelling(spark, first, second):
    """Words over four letters, so that anagrams and neighbours abound."""
    words = dense_words(first)
    rows = [(i if i % 9 else None, " ".join(words[i * 40 : i * 40 + 40])) for i in range(100)]
    rows += [(7, "Chain chain, CHAIN chain; chains chains\nchaine4chaine_chaine"), (7, None), (8, ""), (9, " \n\t 12 é"), (8, "")]
    rows += [(20, "x" * 50_000 + " " + "long words " * 3_000)]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    got = bag(spelling_groups(df, slips=5, first=first, second=second))
    assert got == brute_groups(rows, slips=5)
    assert sum(k[2] != k[0] for k in got) > 30


def test_spelling_chain(spark):
    """a form of a form of a form ...: roots of long chains, and ties for the smaller word."""
    chain = ["aaaaaaaaaa"[:i] + "bbbbbbbbbb"[i:] for i in range(11)]
    rows = [(1, " ".join([w] * (3 * 2**i))) for i, w in enumerate(chain[:9])]
    rows += [(1, "ccccc " * 6 + "ccccd " * 6 + "cccce " * 3)]
    got = spelling_groups(spark.createDataFrame(rows, "doc_id long, text string"), slips=0).collect()
    by = {r.word: r for r in got}
    assert {by[w].root for w in chain[:9]} == {chain[8]}
    assert by["cccce"].form == "ccccc" and by["ccccc"].form is None and by["ccccc"].n_near == 2
    none = spelling_groups(spark.createDataFrame([], "doc_id long, text string"))
    assert none.columns == ["word", "form", "root", "n", "n_near", "form_n"] and none.isEmpty()


# --- clusters ---


def brute_clusters(rows, k, rounds, dims, seed="3"):
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    cents = [v for _, v in start[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cents))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for j in range(len(cents)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == j]
            if mine:
                cents[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    told = [(i, *nearest(v)) for i, v in kept]
    sums = Counter()
    for _, d, j in told:
        sums[j] += d
    return Counter((i, j, d, sums[j], sum(sums.values()), tuple(cents[j])) for i, d, j in told)


@pytest.mark.parametrize(("k", "seed"), [(8, 0), (1, 1), (40, 2)])
def test_clusters(spark, k, seed):
    r = random.Random(seed)
    rows = [(i, [round(r.gauss(i % 5, 0.3), 2) for _ in range(6)]) for i in range(300)]
    rows += rows[:20] + [(None, [0.0] * 6), (None, [0.5] * 6)]  # repeated rows and null ids
    rows += [(900 + i, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]) for i in range(100)]  # a hot point, so that centroids coincide
    rows += [(1000, None), (1001, []), (1002, [1.0] * 5), (1003, [1.0] * 5 + [None]), (1004, [float("nan")] + [0.0] * 5), (1005, [float("-inf")] + [0.0] * 5)]
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5))
    got = cluster_vectors(df, clusters=k, components=6, rounds=6)
    assert bag(got) == brute_clusters(rows, k, 6, 6)


def test_clusters_small(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert cluster_vectors(df).collect() == []
    few = spark.createDataFrame([(1, [1.0, -1.0]), (2, [1.0, -1.0]), (3, [-0.0001, 5.0])], "vec_id long, embedding array<float>")
    assert bag(cluster_vectors(few, components=2)) == brute_clusters([(1, [1, -1]), (2, [1, -1]), (3, [-0.0001, 5])], 8, 10, 2)
    with pytest.raises(ValueError, match="long"):
        cluster_vectors(spark.createDataFrame([(1, [1e200, 1.0])], "vec_id long, embedding array<double>"), components=2)


@pytest.mark.parametrize("k", [1, 2, 7, 60])
def test_orchard(k):
    """Ties included, the walk finds what a full search finds, with fewer distances."""
    r = np.random.default_rng(k)
    points = r.integers(0, 4, (k, 3)) * (100 if k == 60 else 1)
    v = np.concatenate((r.integers(0, 4, (2_000, 3)) * (100 if k == 60 else 1), points))
    best, dist, looked = Centroids.of(points).nearest(v)
    every = ((v[:, None, :] - points[None]) ** 2).sum(axis=2)
    assert (best == every.argmin(axis=1)).all() and (dist == every.min(axis=1)).all()
    centers = r.integers(0, 10_000, (60, 3))
    assert Centroids.of(centers).nearest(centers[r.integers(0, 60, 2_000)])[2] < 0.6 * 60 * 2_000


# --- URLs ---

URLS = [
    None, "", "nothing", "http://", "https://?x", "ftp://A.Org", "http://a.org/x?u=http://b.com/de/", "HTTP://WWW.Example.ORG/en/1?q#f",
    "http://example.org/EN/1", "http://sub.example.org/es/", "http://example.org.evil.net/es/", "http://notexample.org/es/", "x://com/fr/1",
    "x://a.com:80/de/", "x://a.com/de/#://", "x://a.com/de", "x://u@b.net//p///q/?b=2&a=1&utm_source=z&&ref=1#t", "x://b.net/p/q?a=1&b=2",
    "x://\n.net/a\nb", "x://b.net/p/q?a=1", "y://www.b.net./p/q/?a=1", "z://b.net:443/p/q?a=1", "z://b.net:444/p/q?a=1",
]
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def brute_url(url, listed):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = ("".join(c.lower() if c < "\x80" else c for c in m[1]), m[2]) if m else ("", "")
    fit = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, None, "block" if listed else "allow"))
    return host, path, best[1], best[2]


@pytest.mark.parametrize(("bits", "blocks"), [(12, 1 << 20), (1, 1)])
def test_urls(spark, bits, blocks):
    """A filter of any size gives the same verdicts; with one block nearly every URL is a possible hit."""
    urls = URLS + [f"http://h{i % 50}.net/{i}" for i in range(3_000)] + ["http://hot.net/"] * 1_500
    listed = ["http://www.h7.net/7/", "x://b.net/p/q?a=1&b=2", "http://hot.net", None, "no", "http://hot.net"]
    listed += [f"http://list.net/{i}" for i in range(200)] + [f"http://h3.net/{i}?utm_x=1" for i in range(3, 3_000, 100)]
    pages = clashing(spark.createDataFrame([(i if i % 7 else None, u) for i, u in enumerate(urls)], "page_id long, url string"))
    got = filter_urls(pages, spark.createDataFrame([(u,) for u in listed], "url string"), RULES, bits=bits, max_blocks=blocks)
    assert set(pages.columns) < set(got.columns)
    forms = lambda df: [r[0] for r in df.select(canonical(F.col("url"))).collect()]
    own = forms(pages.orderBy("page_id"))
    there = set(forms(spark.createDataFrame([(u,) for u in listed], "url string"))) - {None}
    assert {x for x in own if x in there} >= {"h7.net/7", "hot.net", "b.net/p/q?a=1&b=2", "h3.net/503"}
    told = {r.url: r.c for r in pages.select("url", canonical(F.col("url")).alias("c")).collect()}
    want = Counter((i if i % 7 else None, *brute_url(u, told[u] in there)) for i, u in enumerate(urls))
    assert bag(got.select("page_id", "host", "path", "rule", "verdict")) == want
    assert got.filter("listed AND url = 'http://hot.net/'").count() == 1_500


def test_canonical(spark):
    same = ["x://b.net/p/q?a=1", "y://www.b.net./p/q/?a=1", "z://b.net:443/p/q?a=1", "x://me:pw@B.net//p//q?utm_medium=1&a=1#z"]
    df = spark.createDataFrame([(u,) for u in same], "url string")
    assert {r[0] for r in df.select(canonical(F.col("url"))).collect()} == {"b.net/p/q?a=1"}
    assert [tuple(r) for r in df.select(*host_path(F.col("url"))).limit(1).collect()] == [("b.net", "/p/q")]


def test_filter_rate(spark):
    """Nothing listed is missed, and few others pass."""
    names = spark.range(20_000).select(F.concat(F.lit("h.net/"), "id").alias("canon"))
    marked = BlockedFilter(names, "canon").marked(spark.range(40_000).select("id", F.concat(F.lit("h.net/"), "id").alias("c")), "c")
    assert marked.filter("id < 20000 AND NOT possible_").isEmpty()
    assert marked.filter("id >= 20000 AND possible_").count() < 600


def test_among(spark):
    rows = spark.createDataFrame([(i if i % 10 else None, f"t{i}") for i in range(500)], "k long, t string")
    keys = spark.createDataFrame([(i,) for i in range(0, 600, 3)], "id long")
    inside = {f"t{i}" for i in range(500) if i % 10 and i % 3 == 0}
    assert {r.t for r in among(rows, "k", keys, "id").collect()} == inside
    assert {r.t for r in not_among(rows, "k", keys, "id").collect()} == {f"t{i}" for i in range(500)} - inside
    assert among(rows, "k", keys.limit(0), "id").isEmpty() and not_among(rows, "k", keys.limit(0), "id").count() == 500


def test_urls_empty(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    some = spark.createDataFrame([(1, "http://a.net/"), (1, "http://a.net/"), (None, None)], "page_id long, url string")
    assert filter_urls(none, some).columns == ["page_id", "url", "host", "path", "rule", "listed", "verdict"]
    assert filter_urls(none, some).isEmpty()
    assert bag(filter_urls(some, none).select("page_id", "verdict")) == Counter({(1, "allow"): 2, (None, "allow"): 1})
