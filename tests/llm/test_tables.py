"""Operators that place whole rows: exact dedup, WARC, sharding, mixing, and the pipeline."""

import base64
import gzip
import hashlib
import itertools
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from flowbench.llm import mixing, sharding, warc
from flowbench.llm.common import written
from flowbench.llm.exact_dedup import DigestIndex
from flowbench.session import shared_folder


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_index_keeps_what_came_first(spark):
    path = shared_folder(spark, "test-index")
    schema = "doc_id long, text string"
    first = DigestIndex(spark, path, buckets=4).absorb(spark.createDataFrame([(1, "A"), (2, "a"), (3, "b")], schema))
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in first.collect()) == [(1, 2, 2, False), (2, 2, 2, True), (3, 3, 1, True)]
    again = DigestIndex(spark, path, buckets=4)  # as a later session would open it
    second = again.absorb(spark.createDataFrame([(9, "a"), (8, "c"), (7, "C")], schema))
    assert sorted((r["doc_id"], r["keep_id"], r["kept"]) for r in second.collect()) == [(7, 8, False), (8, 8, True), (9, 2, False)]
    assert again.table().count() == 3
    plan = second._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan or "AdaptiveSparkPlan" in plan


def test_index_edges(spark, edge_docs, no_docs):
    found = DigestIndex(spark, shared_folder(spark, "test-index"), buckets=4).absorb(edge_docs).collect()
    assert len(found) == edge_docs.count()
    groups = defaultdict(list)
    for r in found:
        groups[bytes(r["digest"])].append(r)
    assert sorted(map(len, groups.values())) == sorted(map(len, groupby_text(edge_docs).values()))
    for rows in groups.values():
        assert sum(r["kept"] for r in rows) == 1
        ids = [r["doc_id"] for r in rows if r["doc_id"] is not None]
        assert all(r["keep_id"] == max(ids, default=None) and r["group_size"] == len(rows) for r in rows)
    assert DigestIndex(spark, shared_folder(spark, "test-index"), buckets=4).absorb(no_docs).count() == 0


def test_index_reopened_with_other_buckets(spark):
    path = shared_folder(spark, "test-index")
    docs = spark.range(2000).select(F.col("id").alias("doc.id"), F.concat(F.lit("text "), "id").alias("the.text"))
    assert DigestIndex(spark, path, buckets=8).absorb(docs, "doc.id", "the.text").where("kept").count() == 2000
    with pytest.raises(ValueError):
        DigestIndex(spark, path, buckets=4)
    again = DigestIndex(spark, path)
    assert again.buckets == 8 and again.absorb(docs, "doc.id", "the.text").where("kept").count() == 0
    assert again.table().count() == 2000


def test_index_repeats_a_named_batch(spark):
    """A batch that is absorbed again, whole or in part, keeps the same rows; another batch does not."""
    path = shared_folder(spark, "test-index")
    docs = spark.createDataFrame([(i, f"text {i % 700}") for i in range(2000)], "doc_id long, text string")
    answer = lambda found: sorted((r["doc_id"], r["keep_id"], r["kept"]) for r in found.collect())
    # Of the first attempt only a part arrived.
    DigestIndex(spark, path, buckets=4).absorb(docs.where("doc_id % 700 < 300"), batch="b1").count()
    first = answer(DigestIndex(spark, path).absorb(docs, batch="b1"))
    assert first == answer(DigestIndex(spark, path).absorb(docs.repartition(3), batch="b1"))
    assert sum(kept for *_, kept in first) == 700 and all(keep == max(range(d % 700, 2000, 700)) for d, keep, _ in first)
    assert not any(kept for *_, kept in answer(DigestIndex(spark, path).absorb(docs, batch="b2")))


def groupby_text(docs):
    groups = defaultdict(list)
    for r in docs.collect():
        groups[lowered(r["text"])].append(r)
    return groups


def test_loser_tree():
    rng = random.Random(1)
    for _ in range(1000):
        runs = [sorted((rng.randrange(5), i, j) for j in range(rng.randrange(6))) for i in range(rng.randrange(8))]
        assert list(warc.LoserTree(runs)) == sorted(itertools.chain(*runs))


PAGES = "page_id long, url string, html string, digest string, file string, seen string"


def expected_captures(rows, least=0):
    last = defaultdict(list)
    for r in rows:
        last[r["html"] or ""].append(r["page_id"])
    out = []
    for r in rows:
        body = (r["html"] or "").encode()
        newest = max((i for i in last[r["html"] or ""] if i is not None), default=None)
        again = len(body) >= least and newest is not None and r["page_id"] != newest
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        out.append((r["page_id"], len(body), digest, "revisit" if again else "response", newest if again else None))
    return sorted(out, key=str)


def test_archives_round_trip(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    folder = shared_folder(spark, "test-warc")
    index = warc.capture_index(pages, folder=folder).collect()
    found = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in index]
    assert sorted(found, key=str) == expected_captures(pages.collect())
    keys = [(r["url_key"], r["captured"], r["page_id"]) for r in index]
    assert keys == sorted(keys)
    files = {r["path"]: bytes(r["content"]) for r in spark.read.format("binaryFile").load(folder).collect()}
    for r in index[:50]:
        record = zlib.decompress(files[r["file"]], 31)[r["at"] : r["at"] + r["length"]]
        assert record.startswith(b"WARC/1.1\r\n") and f"<urn:x-page:{r['page_id']}>".encode() in record


def test_archive_edges(spark):
    rows = [
        (1, "http://a.b/c", "same", "d", "f", "2024-01-01 00:00:02"),
        (2, "http://A.b/c#frag", "same", "d", "f", "2024-01-01 00:00:01"),
        (2, "http://a.b/c", "same", "d", "f", None),
        (3, None, None, None, None, None),
        (4, "", "", "d", "f", None),
        (None, "no scheme\r\nX: y", "line\r\n\r\nWARC/1.1\r\n\r\n", "d", "f", None),
        (None, "http://h/ü", "solo", "d", "f", None),
        (None, "http://h/ü", "solo", "d", "f", None),
        (7, "http://h?q", "ü" * 3_000_000, "d", "f", None),
    ]
    pages = spark.createDataFrame(rows, PAGES)
    for least in (0, 5):
        found = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.capture_index(pages, least).collect()]
        assert sorted(found, key=str) == expected_captures(pages.collect(), least)
    timed = [(r["url_key"], r["captured"]) for r in warc.capture_index(pages, time_col="seen").collect()]
    assert timed == sorted(timed) and ("b,a)/c", "2024-01-01T00:00:01Z") in timed
    assert warc.capture_index(pages.limit(0)).count() == 0


def test_archive_with_a_gzip_member_for_each_record(spark, tmp_path):
    """The usual form of archives: records are compressed one by one."""
    body = lambda i: f"page {i} ".encode() * (i * 40_000 % 90_001)
    whole = b""
    for i in range(30):
        http = b"HTTP/1.1 200 OK\r\nContent-Length: " + str(len(body(i))).encode() + b"\r\n\r\n" + body(i)
        digest = base64.b32encode(hashlib.sha1(body(i)).digest()).decode()
        head = (
            f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:{i}>\r\nWARC-Target-URI: http://a.b/{i}\r\nWARC-Date: 2024-01-01T00:00:00Z\r\n"
            f"WARC-Payload-Digest: sha1:{digest}\r\nContent-Length: {len(http)}\r\n\r\n"
        )
        whole += gzip.compress(head.encode() + http + b"\r\n\r\n")
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.warc.gz").write_bytes(whole)
    rows = warc.read_archives(spark, str(tmp_path / "a")).collect()
    assert sorted((r["page_id"], r["payload_bytes"]) for r in rows) == [(i, len(body(i))) for i in range(30)]
    with pytest.raises(ValueError):
        list(warc._unpacked(memoryview(whole[:-9])))


def least_largest(sizes, shards):
    """Every way to cut, by recursion."""
    if shards == 1:
        return sum(sizes)
    return min(max(sum(sizes[:i]), least_largest(sizes[i:], shards - 1)) for i in range(len(sizes) + 1))


def test_cut_is_minimax():
    rng = random.Random(7)
    for _ in range(400):
        sizes = [rng.choice([0, 1, 2, 3, 10, 50]) for _ in range(rng.randrange(9))]
        shards = rng.randrange(1, 5)
        capacity = sharding.smallest_capacity(sizes, shards)
        assert capacity == least_largest(sizes, shards)
        placed = sharding.cut(sizes, shards)
        assert len(placed) == len(sizes) and placed == sorted(placed)
        assert all(sum(s for s, p in zip(sizes, placed) if p == k) <= capacity for k in range(shards))


def check_shards(docs, shards):
    rows = {(r["doc_id"], lowered(None) + (r["text"] or "")) for r in docs.collect()}
    found = sharding.shard_by_bytes(docs, shards).collect()
    assert len(found) == docs.count()
    slots, of_text = defaultdict(list), defaultdict(set)
    for r in found:
        slots[r["shard"]].append(r["slot"])
        of_text[r["text_crc32"], r["size"]].add(r["shard"])
        assert 0 <= r["shard"] < shards and r["law"] == "bytes"
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in of_text.values())
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in found} <= {(i, len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in rows}
    return found


def test_shards_of_the_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = check_shards(docs, 8)
    loads = defaultdict(int)
    for r in found:
        loads[r["shard"]] += r["size"]
    mean = sum(loads.values()) / 8
    assert max(loads.values()) < 1.1 * mean and min(loads.values()) > 0.9 * mean


def test_shards_of_a_hot_text(spark):
    rows = [(i, "same") for i in range(3000)] + [(i, f"text {i}") for i in range(3000, 6000)]
    check_shards(spark.createDataFrame(rows, "doc_id long, text string"), 5)


@pytest.mark.parametrize("n", [40, 5000])
def test_slots_have_one_order_at_every_size(spark, n):
    """Rows of one text stand by a hash of their id, whether their text is hot or not."""
    rows = [(i, "same" if i < 0.6 * n else f"text {i}") for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sharding.shard_by_bytes(docs, 3).join(docs, "doc_id").where("text = 'same'")
    turn = F.pmod(F.xxhash64("doc_id", F.lit(None).cast("long")), F.lit(sharding.CELLS))
    assert [r["doc_id"] for r in found.orderBy("slot").collect()] == [r["doc_id"] for r in found.orderBy(turn, "doc_id").collect()]


def test_shard_edges(edge_docs, no_docs):
    assert len(check_shards(edge_docs, 24)) == edge_docs.count()
    assert sharding.shard_by_bytes(no_docs, 24).count() == 0


def test_flow_is_cheapest():
    rng = random.Random(3)
    for _ in range(60):
        cells = {}
        for p in range(rng.randint(1, 2)):
            distinct = rng.randint(0, 4)
            for s in range(2):
                if rng.random() < 0.8:
                    cells[p, s] = (rng.randint(0, 4), distinct)
        sizes = [sum(w for (_, s), (w, _) in cells.items() if s == i) for i in range(2)]
        goals = [int(t) for t in mixing.targets(sizes, [1, 2])]
        taken = mixing.route(cells, goals)
        assert [sum(x for (_, s), x in taken.items() if s == i) for i in range(2)] == goals
        keys = list(cells)
        ways = itertools.product(*[range(3 * cells[k][0] + 1) for k in keys])
        costs = [flow_cost(cells, dict(zip(keys, w))) for w in ways if [sum(x for (_, s), x in zip(keys, w) if s == i) for i in range(2)] == goals]
        assert flow_cost(cells, taken) == min(costs, default=0)


def flow_cost(cells, taken):
    total, used = 0, defaultdict(int)
    for c, x in taken.items():
        total += sum(k * max(0, min(cells[c][0], x - k * cells[c][0])) for k in range(3))
        used[c[0]] += x
    for p, x in used.items():
        step, cost, done = max(1, next(d for (q, _), (_, d) in cells.items() if q == p)), 0, 0
        while x > 0:
            total += cost * min(x, step)
            x, done, cost = x - step, done + step, cost + 1
            step = done
    return total


def check_mix(docs):
    found = mixing.mix(docs).collect()
    assert len(found) == docs.count()
    source = {(r["doc_id"], len((r["text"] or "").split())): r["source"] for r in docs.collect()}
    sizes, goal, taken = defaultdict(int), {}, defaultdict(int)
    for r in found:
        assert r["taken"] in (0, r["size"], 2 * r["size"], 3 * r["size"])
    return found, source, sizes, goal, taken


def test_mix_meets_targets(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = mixing.mix(docs).withColumnRenamed("target", "goal").join(docs, "doc_id").collect()
    assert len(found) == docs.count()
    sizes, taken, goals = defaultdict(int), defaultdict(int), {}
    for r in found:
        assert r["taken"] in (0, r["size"], 2 * r["size"], 3 * r["size"])
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        goals[r["source"]] = r["goal"]
    names = sorted(sizes)
    assert [goals[n] for n in names] == pytest.approx(mixing.targets([sizes[n] for n in names], [1 + i % 3 for i in range(len(names))]))
    assert sum(goals.values()) == pytest.approx(sum(sizes.values()))
    # Sources of 50 documents, whole ones; test_mix_of_more_documents is stricter.
    assert all(abs(taken[n] - goals[n]) < 0.1 * goals[n] for n in names)
    assert {r["source_size"] for r in found if r["source"] == names[0]} == {sizes[names[0]]}
    again = mixing.mix(docs.repartition(3)).select("doc_id", "taken").collect()
    assert {r["doc_id"]: r["taken"] for r in again} == {r["doc_id"]: r["taken"] for r in found}


def test_mix_of_more_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    mixed = mixing.mix(docs).withColumnRenamed("target", "goal").join(docs.select("doc_id", "source"), "doc_id")
    sums = mixed.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("goal").alias("goal"))
    assert sums.where("abs(taken - goal) > 0.001 * goal").count() == 0


def test_targets_stop_at_three_times():
    assert mixing.targets([10, 10, 10], [1, 2, 3]) == pytest.approx([5, 10, 15])
    assert mixing.targets([100, 1, 1], [1, 2, 3]) == pytest.approx([96, 3, 3])
    assert mixing.targets([0, 0], [1, 2]) == [0, 0] and mixing.targets([], []) == []


def test_mix_edges(edge_docs, no_docs):
    check_mix(edge_docs)
    assert mixing.mix(no_docs).count() == 0


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "SimHash near-dedup", "mixing", "byte-level BPE"]
    before, columns = docs.collect(), docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "test-stage")
        after = docs.collect()
        assert docs.columns == columns and set(after) <= set(before)
        if name == "exact dedup":
            newest = {}
            for r in before:
                newest[lowered(r["text"])] = max(newest.get(lowered(r["text"]), 0), r["doc_id"])
            assert {r["doc_id"] for r in after} == set(newest.values()) and len(after) == len(newest)
        if name != "mixing":
            assert len(after) == len(set(after))
        before = after
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == len(before)


def test_pipeline_edges(spark, edge_docs, no_docs, sf_dir):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    words = " ".join(f"w{i}" for i in range(30))
    longer = edge_docs.withColumn("text", F.concat("text", F.lit(" " + words)))
    for docs in (edge_docs.select(columns), longer.select(columns), longer, no_docs):
        for _, stage in corpus_pipeline.STAGES:
            kept = written(stage(spark, docs, sf_dir), "test-stage")
            assert kept.count() <= 3 * docs.count()
            docs = kept


def test_pipeline_tells_rows_apart_without_ids(spark, sf_dir):
    schema = "doc_id long, text string, source string"
    first, second, third, fourth = (" ".join(f"{name}{i}" for i in range(40)) for name in ("ab", "cd", "ef", "gh"))
    rows = [(None, first, "a"), (None, first, "b"), (None, first.upper(), "a"), (5, second, "a"), (None, second, "a"), (7, third, "a"), (7, third.upper(), "b"), (7, fourth, "a")]
    kept = corpus_pipeline.near(spark, spark.createDataFrame(rows, schema), sf_dir).collect()
    assert sorted((str(r["doc_id"]), lowered(r["text"])) for r in kept) == sorted([("None", first), ("5", second), ("7", third), ("7", fourth)])
    rows = [(i if i % 5 == 0 else 3 if i % 5 == 1 else None, " ".join(f"{'abc'[i % 3]}{i}x{k}" for k in range(10 + i % 4)), "abc"[i % 3]) for i in range(300)]
    docs = spark.createDataFrame(rows, schema)
    words, times = defaultdict(int), defaultdict(int)
    for r in corpus_pipeline.mix(spark, docs, sf_dir).collect():
        words[r["source"]] += len(r["text"].split())
        times[r["text"]] += 1
    assert max(times.values()) <= 3 and len(times) < 300
    goals = mixing.targets([sum(len(t.split()) for _, t, s in rows if s == x) for x in "abc"], list(mixing.WEIGHTS))
    assert all(abs(words[x] - goal) < 14 for x, goal in zip("abc", goals))


def test_mix_does_not_switch_by_size(spark, monkeypatch):
    """Texts of many sets of sources are mixed the same way however many sets there are."""
    rng = random.Random(5)
    rows = [(10 * i + s, " ".join([f"w{i}"] * rng.randint(1, 9)), f"s{s}") for i in range(60) for s in rng.sample(range(5), rng.randint(1, 4))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1)
    taken = lambda: {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect()}
    before = taken()
    monkeypatch.setattr(mixing, "MAX_PATTERNS", 1, raising=False)
    assert taken() == before
