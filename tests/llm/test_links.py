"""URL rules, SimHash and the components both rest on."""

import random

import pytest
from xxhash import xxh64_intdigest

from flowbench.llm import simhash, url_filters
from flowbench.llm.components import connected_components

RULES = [url_filters.UrlRule("org", "/", True), url_filters.UrlRule("bad.org", "/x/", False), url_filters.UrlRule("com", "/de/", False)]


@pytest.mark.parametrize("kind", ["chain", "star", "random", "none"])
def test_components(spark, union, kind):
    rng = random.Random(5)
    if kind == "chain":
        edges = [(i, i + 1) for i in range(60)]
    elif kind == "star":
        edges = [(500, i) for i in range(200)]
    else:
        edges = [(rng.randrange(150), rng.randrange(150)) for _ in range(90)] if kind == "random" else []
    rng.shuffle(edges)
    for a, b in edges:
        if a != b:
            union.join(a, b)
    table = spark.createDataFrame([*edges, *edges[:3], (None, 1), (1, None)], "a long, b long")
    found = {r["node"]: r["component"] for r in connected_components(table, "a", "b").collect()}
    assert found == {x: union.find(x) for x in union.up}


def judged(spark, rows, redirects=None):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, node string")
    if redirects is not None:
        redirects = spark.createDataFrame(redirects, "source string, target string")
    out = url_filters.judge(pages, RULES, redirects).collect()
    assert len(out) == len(rows)
    return {r["page_id"]: r for r in out}


def test_decisions_reach_aliases(spark):
    link = '<head><LINK title="t" href="{}" rel=\'canonical\'></head>'
    rows = [
        (1, "http://a.com/de/1", "", "h", "n"),  # blocked by rule
        (2, "http://other.net/p", link.format("http://a.com/de/1"), "h", "n"),  # alias of 1
        (3, "http://third.net/q", '<meta http-equiv="Refresh" content="0; URL=//other.net/p#x">', "h", "n"),  # alias of 2
        (4, "http://free.net/", "", "h", "n"),
        (5, "http://good.org/", link.format("/y"), "h", "n"),  # allowed by rule
        (6, "https://good.org/y?utm_source=z", link.format("http://third.net/mixed"), "h", "n"),
        (7, "http://third.net/mixed", link.format("http://b.com/de/9"), "h", "n"),  # alias of an allowed and a blocked page
        (8, "http://c.net/c", "<!-- " + link.format("http://a.com/de/1") + " -->", "h", "n"),
        (9, "http://target.net/only", link.format("http://unseen.com/de/5"), "h", "n"),  # the target is no page here
        (10, "http://moved.net/", None, None, None),
        (11, None, link.format("http://a.com/de/1"), "h", "n"),
        (12, "no scheme", "", "h", "n"),
        (13, "http://sub.BAD.org:443/x/1?q#f", "", "h", "n"),
    ]
    found = judged(spark, rows, [("http://moved.net/", "http://a.com/de/1"), (None, "http://a.com/de/1")])
    assert {k: v["verdict"] for k, v in found.items()} == {
        1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "allow", 8: "allow", 9: "block", 10: "block", 11: "allow", 12: "allow", 13: "allow",
    }
    assert found[2]["decided_by"] == found[7]["decided_by"] == "alias" and found[4]["decided_by"] == "default"
    assert (found[13]["host"], found[13]["path"], found[13]["rule"]) == ("sub.bad.org:443", "/x/1", None)
    assert (found[11]["host"], found[11]["path"], found[12]["host"]) == ("", "", "")


def test_longest_rule_and_repeats(spark):
    rows = [(1, "http://sub.bad.org/x/1", "", "", ""), (2, "http://bad.org/y", "", "", ""), (3, "http://nobad.org", "", "", "")]
    found = judged(spark, rows)
    assert {k: (v["rule"], v["verdict"]) for k, v in found.items()} == {1: ("bad.org/x/", "block"), 2: ("org/", "allow"), 3: (None, "allow")}
    pages = spark.createDataFrame([rows[0], rows[0], (None, None, None, None, None)], "page_id long, url string, html string, host string, node string")
    assert url_filters.judge(pages, RULES).count() == 3
    assert url_filters.judge(pages.limit(0), RULES).count() == 0


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(union, prints):
    """Smallest id reachable, over all pairs of distinct fingerprints."""
    least = {}
    for key, value in prints:
        least[value] = min(least.get(value, key), key)
    values = sorted(least)
    for i, a in enumerate(values):
        union.find(a)
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                union.join(a, b)
    smallest = {}
    for v in values:
        smallest[union.find(v)] = min(smallest.get(union.find(v), least[v]), least[v])
    return {key: smallest[union.find(value)] for key, value in prints}


def test_near_duplicates_of_the_table(spark, sf_dir, union):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    prints = [(r["doc_id"], plain_fingerprint(r["text"])) for r in docs.collect()]
    found = simhash.near_duplicates(docs).collect()
    assert {r["doc_id"]: r["fingerprint"] % 2**64 for r in found} == dict(prints)
    assert {r["doc_id"]: r["component_id"] for r in found} == plain_components(union, prints)


def test_every_near_pair_shares_a_key():
    import numpy as np

    rng = random.Random(3)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randrange(3)):
            b ^= 1 << bit
        keys, owners = simhash.golay_keys(np.array([a, b], np.uint64).view(np.int64))
        assert set(keys[owners == 0]) & set(keys[owners == 1])
    code = simhash.Golay()
    words = np.arange(1 << 12, dtype=np.int64) << 11
    codewords = words | code.remainder
    for bits in ((0,), (3, 22), (5, 11, 17)):
        assert (code.index(codewords ^ sum(1 << b for b in bits)) == np.arange(1 << 12)).all()


@pytest.mark.parametrize("bits", [1, 2])
def test_links_of_a_crowd(spark, union, bits):
    """Hundreds of fingerprints around one: more than are compared in pairs."""
    rng = random.Random(8)
    base = rng.getrandbits(64)
    values = {base} | {base ^ (1 << i) ^ (1 << j) for i in range(30) for j in range(30)} | {rng.getrandbits(64) for _ in range(200)}
    values |= {base ^ 7 << 40 ^ (1 << i) for i in range(8)}
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    found = simhash.links(spark.createDataFrame([(v,) for v in signed], "fingerprint long"), bits).collect()
    assert all(1 <= ((r["a"] ^ r["b"]) % 2**64).bit_count() <= bits for r in found)
    for r in found:
        union.join(r["a"], r["b"])
    other = type(union)()
    for i, a in enumerate(signed):
        for b in signed[i + 1 :]:
            if ((a ^ b) % 2**64).bit_count() <= bits:
                other.join(a, b)
    assert {x: union.find(x) for x in union.up} == {x: other.find(x) for x in other.up}


def test_simhash_edges(edge_docs, no_docs):
    found = simhash.near_duplicates(edge_docs).collect()
    assert len(found) == edge_docs.count()
    by_print = {}
    for r in found:
        by_print.setdefault(r["fingerprint"], set()).add(r["component_id"])
    assert all(len(ids) == 1 for ids in by_print.values())
    assert by_print[0] == {3}  # empty, blank and null texts
    assert sum(r["component_id"] == 1 for r in found) == 3
    assert simhash.near_duplicates(no_docs).count() == 0
    assert simhash.near_duplicates(edge_docs, max_bits=0).count() == edge_docs.count()
