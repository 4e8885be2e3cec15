import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from yardframe.llm import periodic_runs, queries, ranked_search, simhash_trie
from yardframe.llm.components import components, with_value_of_key

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def prose(seed, n, words=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(words)}" for _ in range(n))


def groups_of(ids, linked):
    """Least id reachable from each, by plain search."""
    near = {i: {j for j in ids if i != j and linked(i, j)} for i in ids}
    out = {}
    for i in sorted(ids):
        if i in out:
            continue
        todo = [i]
        while todo:
            j = todo.pop()
            if j not in out:
                out[j] = i
                todo.extend(near[j])
    return out


# SimHash

def plain_fingerprint(text):
    words = SPACED.findall(lower(text))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def near_copies(seed, groups=25, copies=6):
    r = random.Random(seed)
    rows = []
    for g in range(groups):
        words = prose(g, 150).split()
        for _ in range(copies):
            changed = list(words)
            for _ in range(r.randrange(3)):
                changed[r.randrange(150)] = f"new{r.randrange(9)}"
            rows.append(" ".join(changed))
    r.shuffle(rows)
    return [(i + 1, t) for i, t in enumerate(rows)]


def test_fingerprints_match_spark_and_plain(docs_of):
    rows = [(i, prose(i, i * 7 + 1)) for i in range(12)] + [(20, "Ab cDÉ"), (21, None), (22, " \t"), (23, "a b")]
    got = {r["key"]: r["fingerprint"] for r in simhash_trie.fingerprints(docs_of(rows)).collect()}
    assert {k: v % (1 << 64) for k, v in got.items()} == {k: plain_fingerprint(t) for k, t in rows}


@pytest.mark.parametrize("leaf", [20, 4096])
def test_simhash_groups(docs_of, leaf):
    rows = near_copies(5)
    got = {r["doc_id"]: r for r in simhash_trie.simhash_groups(docs_of(rows), leaf=leaf).collect()}
    prints = {i: plain_fingerprint(t) for i, t in rows}
    want = groups_of(list(prints), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 2)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["fingerprint"] == f"{prints[i]:016x}" for i, r in got.items())
    assert len(set(want.values())) < len(want)


@pytest.mark.parametrize("distance", [0, 1, 2, 3, 5])
def test_all_close_pairs(spark, distance):
    r = random.Random(distance)
    values = {0, (1 << 64) - 1}
    for _ in range(12):
        base = r.getrandbits(64)
        for _ in range(30):
            v = base
            for _ in range(r.randrange(6)):
                v ^= 1 << r.randrange(64)
            values.add(v)
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    table = spark.createDataFrame([(v,) for v in signed], "fingerprint long")
    got = sorted(tuple(x) for x in simhash_trie.close_pairs(table, distance, leaf=50).collect())
    want = sorted((a, b, bits) for i, a in enumerate(signed) for b in signed[i + 1 :]
                  if (bits := ((a ^ b) & ((1 << 64) - 1)).bit_count()) <= distance)
    assert got == want


def test_simhash_edges(docs_of, edge_rows):
    got = simhash_trie.simhash_groups(docs_of(edge_rows)).collect()
    assert len(got) == len(edge_rows)
    by_id = {r["doc_id"]: r for r in got}
    for i in (1, 2, 3):
        assert by_id[i]["fingerprint"] == "0" * 16 and by_id[i]["component_id"] == 1
    assert by_id[5]["component_id"] == by_id[None]["component_id"] == 4
    assert simhash_trie.simhash_groups(docs_of([])).collect() == []
    assert [r["component_id"] for r in simhash_trie.simhash_groups(docs_of([(None, "a b c d")])).collect()] == [None]


def test_components_of_chains_and_hubs(spark):
    r = random.Random(3)
    links = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 3000)] + [(5000 + r.randrange(200), 5000 + r.randrange(200)) for _ in range(90)]
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {x for pair in links for x in pair}
    label = {x: x for x in nodes}

    def top(x):
        while label[x] != x:
            x = label[x]
        return x
    for a, b in links:
        x, y = top(a), top(b)
        label[max(x, y)] = min(x, y)
    assert got == {x: top(x) for x in nodes}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_join_on_hot_keys(spark):
    rows = spark.createDataFrame([(0 if i % 3 else i, i) for i in range(6000)], "k long, i long")
    table = rows.groupBy("k").agg(F.count("*").alias("n"), (F.first("k") * 2).alias("twice"))
    got = with_value_of_key(rows, table, "k")
    assert sorted((r["i"], r["twice"]) for r in got.collect()) == [(i, 0 if i % 3 else 2 * i) for i in range(6000)]


def test_keys_that_are_all_hot_or_none_take_one_join(spark):
    """Each scan, shuffle and broadcast of a plan takes memory of the driver, on small tables too."""
    for keys, repeats in ((3000, 1), (50, 3), (1, 2000)):
        rows = spark.createDataFrame([(i % keys, i) for i in range(keys * repeats)] + [(None, -1)], "k long, i long")
        table = rows.where("k is not null").groupBy("k").agg(F.count("*").alias("n"), (F.first("k") * 2).alias("twice"))
        got = with_value_of_key(rows, table, "k")
        assert sorted((r["i"], r["twice"]) for r in got.collect()) == [(i, 2 * (i % keys)) for i in range(keys * repeats)]
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join") == 1 and "Union" not in plan
    none = spark.createDataFrame([], "k long, n long, twice long")
    assert with_value_of_key(rows, none, "k").collect() == []


def test_components_end_when_neighbours_agree(spark):
    got = components(spark.createDataFrame([(7, 3), (3, 5), (9, 9), (None, 4), (12, 11)], "a long, b long"))
    assert sorted(map(tuple, got.collect())) == [(3, 3), (5, 3), (7, 3), (9, 9), (11, 11), (12, 11)]
    links = spark.createDataFrame([(i, i + 1) for i in range(8)], "a long, b long")
    spark.sparkContext.setJobGroup("chain", "chain")
    try:
        got = components(links)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(map(tuple, got.collect())) == [(i, 0) for i in range(9)]
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain")) < 50  # 58 when every round was a whole one


# periodic runs

def plain_runs(words, min_length=24, min_exponent=3):
    out = []
    for q in range(1, len(words) // min_exponent + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(min_length, min_exponent * q) and not any(
                    all(words[x] == words[x + p] for x in range(i, i + length - p)) for p in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def repetitive(seed):
    r = random.Random(seed)
    words = []
    while len(words) < r.randrange(5, 220):
        if r.random() < 0.4:
            words += [r.choice("abcde") for _ in range(r.randrange(1, 11))]
        else:
            root = [r.choice("ab" + "cdefgh" * r.randrange(2)) for _ in range(r.randrange(1, 15))]
            words += (root * 40)[: r.randrange(1, len(root) * 6 + 1)]
    return words


def test_lyndon_array():
    r = random.Random(2)
    for _ in range(800):
        word = [r.randrange(r.randrange(1, 5)) for _ in range(r.randrange(1, 20))]
        used = sorted(set(word))
        word = [used.index(c) for c in word]
        want = []
        for i in range(len(word)):
            want.append(max(j - i for j in range(i + 1, len(word) + 1) if all(word[i:j] < word[k:j] for k in range(i + 1, j))))
        assert periodic_runs.lyndon_array(word) == want


def test_runs_match_brute_force():
    found = 0
    for seed in range(500):
        words = [w.encode() for w in repetitive(seed)]
        want = plain_runs(words)
        assert periodic_runs.runs_of(words) == want
        found += len(want)
    assert found > 200


def test_runs_with_misleading_sums(monkeypatch):
    monkeypatch.setattr(periodic_runs, "PRIMES", (7, 11))
    for seed in range(60):
        words = [w.encode() for w in repetitive(seed)]
        want = set(plain_runs(words))
        assert set(periodic_runs.runs_of(words)) <= want  # false sums never make a run


def test_other_bounds():
    for seed in range(100):
        words = [w.encode() for w in repetitive(seed)]
        assert periodic_runs.runs_of(words, 9, 3) == plain_runs(words, 9, 3)
        assert periodic_runs.runs_of(words, 30, 5) == plain_runs(words, 30, 5)
    with pytest.raises(ValueError, match="below 3"):
        periodic_runs.periodic_runs(None, min_exponent=2)


def plain_row(doc_id, text):
    words = SPACED.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {x for s, length, q in runs for x in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    first = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *first, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_periodic_runs_query(spark, docs_of, tmp_path):
    rows = [(i, " ".join(repetitive(i))) for i in range(150)] + [(i, prose(i, 90)) for i in range(150, 220)]
    rows += [(300, None), (301, ""), (302, "é   é"), (None, "a " * 40), (303, "x " * 3000), (303, "x " * 3000)]
    docs_of(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op12_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted((plain_row(*r) for r in rows), key=str)
    assert sum(r["n_runs"] for r in got.collect()) > 50


def test_runs_edges(docs_of, edge_rows):
    got = {r["doc_id"]: r for r in periodic_runs.periodic_runs(docs_of(edge_rows)).collect()}
    assert got[1]["runs"] == [] and got[1]["collapsed"] == "" and got[1]["n_words"] == 0
    assert [tuple(r) for r in got[6]["runs"]] == [(0, 30_000, 1)] and got[6]["collapsed"] == "word"
    assert periodic_runs.periodic_runs(docs_of([])).collect() == []


# ranked search

def plain_ranking(docs, items, k):
    held = [(i, TERMS.findall(lower(t))) for i, t in docs]
    held = [(i, w) for i, w in held if w]
    n_docs, n_terms = len(held), sum(len(w) for _, w in held)
    df = {}
    for _, w in held:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        wanted = set(TERMS.findall(lower(text)))
        scores = []
        for i, w in held:
            m = 50 + 50 * len(w) * n_docs // n_terms
            score = 0
            for t in wanted & set(w):
                tf = w.count(t)
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf // (1000 * tf + 20 * m))
            if score:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, rank + 1, s[3], -s[0]) for rank, s in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize(("block", "bucket"), [(1 << 20, 4096), (40, 16)])
def test_ranking(spark, docs_of, monkeypatch, block, bucket):
    monkeypatch.setattr(ranked_search, "BLOCK", block)
    monkeypatch.setattr(ranked_search, "BUCKET", bucket)
    r = random.Random(8)
    docs = [(i, prose(i % 140, r.randrange(1, 90) if i < 140 else 30, 120)) for i in range(200)]
    docs += [(200, None), (201, "!!"), (None, prose(3, 30, 120)), (7, prose(3, 30, 120)), (202, "W1, w2; W3é w1")]
    items = [(i, prose(1000 + i, r.randrange(1, 25), 150)) for i in range(12)] + [(90, None), (91, "?"), (92, "w3é"), (93, "zzz")]
    table = spark.createDataFrame([(*x, "k") for x in items], "item_id long, text string, doc_id string")
    got = ranked_search.rank_documents(docs_of(docs), table, k=9)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_ranking(docs, items, 9)


def test_ranking_with_ties_and_empty_tables(spark, docs_of):
    docs = [(i, "alpha beta") for i in range(500, 0, -1)] + [(1000, "gamma")]
    items = spark.createDataFrame([("x", "alpha gamma"), ("y", "beta")], "item_id string, text string")
    got = ranked_search.rank_documents(docs_of(docs), items, k=50)
    assert sorted(map(tuple, got.collect()), key=str) == plain_ranking(docs, [("x", "alpha gamma"), ("y", "beta")], 50)
    assert ranked_search.rank_documents(docs_of([]), items).collect() == []
    assert ranked_search.rank_documents(docs_of(docs), items.limit(0)).collect() == []
    texts = docs_of(docs).withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    assert [r["doc_id"] for r in ranked_search.rank_documents(texts, items.where("item_id = 'y'"), k=2).collect()] == ["d1", "d10"]


def test_traverse_needs_bounded_room(monkeypatch):
    monkeypatch.setattr(simhash_trie, "_PAIRS", 64)
    r = np.random.default_rng(4)
    a = np.unique(r.integers(0, 1 << 63, 400, dtype=np.uint64))
    a = np.unique(np.concatenate([a, a ^ np.uint64(5)]))
    x, _ = simhash_trie.traverse(a, None, 0, 0, 2)
    assert len(x) == len(a) // 2
