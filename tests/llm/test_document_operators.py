import collections
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from yardframe.llm import decontamination, exact_dedup, html_extraction, lm_scoring, mixing, ngram_join, repeated_passages, toxicity
from yardframe.llm.tables import shared_dir

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def prose(seed, n, words=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(words)}" for _ in range(n))


# mixing

def levels(sizes, weights, most=3):
    """Target by source: shared by weight again and again until none is above its cap."""
    total, capped = sum(sizes.values()), {}
    while True:
        rest = {s: w for s, w in weights.items() if s not in capped}
        left = total - sum(capped.values())
        share = {s: left * w / sum(rest.values()) for s, w in rest.items()} if rest else {}
        over = {s: most * sizes[s] for s in share if share[s] > most * sizes[s]}
        if not over:
            return {**share, **capped}
        capped |= over


def test_targets_and_draws(docs_of):
    r = random.Random(1)
    rows = [(i, prose(i, r.randrange(1, 60)), r.choice(["a", "b", "b", "b", "b", "b", "é", None, "z"])) for i in range(900)]
    got = mixing.mix_counts(docs_of(rows)).collect()
    sizes = collections.Counter()
    for _, text, source in rows:
        sizes[source] += len(SPACED.findall(text))
    order = sorted((s for s in sizes if s is not None)) + [None]
    want = levels(sizes, {s: i % 3 + 1 for i, s in enumerate(order)})
    taken, smallest = collections.Counter(), {}
    for x in got:
        assert x["source_size"] == sizes[x["source"]]
        assert math.isclose(x["target"], want[x["source"]], rel_tol=1e-9)
        assert x["taken"] == x["size"] * len(x["draws"]) and x["taken"] <= 3 * x["size"]
        assert all(0 <= shard < 16 for shard in x["draws"])
        taken[x["source"]] += x["taken"]
        smallest[x["source"]] = max(smallest.get(x["source"], 0), x["size"])
    assert len(got) == 900
    for s in sizes:
        assert 0 <= want[s] - taken[s] + 1e-6 <= smallest[s] + 1e-6
    again = mixing.mix_counts(docs_of(rows).repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    mixed = mixing.mixed_rows(docs_of(rows))
    assert mixed.columns == docs_of([]).columns
    assert collections.Counter(x["doc_id"] for x in mixed.collect()) == collections.Counter({x["doc_id"]: len(x["draws"]) for x in got if x["draws"]})


def test_hypergeometric_has_its_law(spark):
    marked, others, drawn = 5, 7, 6
    got = spark.range(4000).select(mixing.hypergeometric(F.lit(marked).cast("long"), F.lit(others).cast("long"), F.lit(drawn).cast("long"),
                                                         (F.col("id") + 0.5) / 4000).alias("k")).groupBy("k").count().collect()
    for row in got:
        p = math.comb(marked, row["k"]) * math.comb(others, drawn - row["k"]) / math.comb(marked + others, drawn)
        assert abs(row["count"] / 4000 - p) < 1e-3


def test_tree_keeps_quotas(spark):
    quotas = spark.createDataFrame([(0, 1000), (1, 3), (2, 0), (3, 77)], "rank long, quota long")
    rows = mixing.split_quotas(quotas, 3, 5).collect()
    for rank in range(4):
        starts = [r["first"] for r in sorted((r for r in rows if r["rank"] == rank), key=lambda r: r["shard"])]
        assert len(starts) == 8 and starts[0] == 0 and starts == sorted(starts)
    total = collections.Counter()
    ends = {0: 1000, 1: 3, 2: 0, 3: 77}
    for rank, end in ends.items():
        starts = [r["first"] for r in sorted((r for r in rows if r["rank"] == rank), key=lambda r: r["shard"])] + [end]
        for s in range(8):
            total[s] += starts[s + 1] - starts[s]
    assert max(total.values()) - min(total.values()) <= 1


def test_the_driver_plans_little_for_the_mix(spark, docs_of):
    def planned(df):
        return df._jdf.queryExecution().optimizedPlan().toString()

    one = [F.col(c) for c in ("marked", "others", "drawn")]
    draws = spark.createDataFrame([(5, 7, 6)], "marked long, others long, drawn long")
    assert len(planned(draws.select(mixing.hypergeometric(*one, F.lit(0.5)).alias("k")))) < 4000
    rows = mixing.mixed_rows(docs_of([(i, prose(i, 20), "ab"[i % 2]) for i in range(20)]))
    assert "Window" not in planned(rows)  # the table of blocks is stored, its plan is not part of that of the rows


def test_mixing_edges(docs_of, edge_rows):
    assert mixing.mix_counts(docs_of([])).count() == 0
    assert mixing.mixed_rows(docs_of([])).count() == 0
    got = mixing.mix_counts(docs_of(edge_rows)).collect()
    assert len(got) == len(edge_rows)
    assert {r["taken"] for r in got if r["size"] == 0} == {0}


# n-gram join

def brute_components(rows, size, percent):
    sets = []
    for _, text in rows:
        w = SPACED.findall(lower(text))
        sets.append({tuple(w[k:k + size]) for k in range(max(1, len(w) - size + 1))} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(rows[i][0])
    least = {g: min((k for k in keys if k is not None), default=None) for g, keys in groups.items()}
    return sorted(((rows[i][0], len(sets[i]), least[root(i)]) for i in range(len(rows))), key=str)


@pytest.mark.parametrize("size,percent", [(4, 85), (5, 80)])
def test_near_duplicates_equal_all_pairs(docs_of, edge_rows, size, percent):
    r = random.Random(size)
    rows = [(10 + i, prose(i, r.randrange(3, 120))) for i in range(25)]
    hub = prose(99, 80).split()
    for i in range(60):  # copies of one text that differ from each other twice as much as from it
        w = list(hub)
        for _ in range(r.randrange(0, 4)):
            w[r.randrange(len(w))] = f"c{i}"
        rows.append((100 + i, " ".join(w) + " " * (i % 3)))
    shared = prose(7, 40)
    rows += [(300 + i, shared + " " + prose(1000 + i, 30)) for i in range(30)]
    rows += [x for x in edge_rows if x[0] != 7]
    got = ngram_join.near_duplicates(docs_of(rows), size=size, percent=percent).collect()
    assert sorted(map(tuple, got), key=str) == brute_components(rows, size, percent)
    assert ngram_join.near_duplicates(docs_of([])).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["component"] for r in ngram_join.components(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


# language model

def test_backoff_scores(docs_of, edge_rows):
    rows = [(i, prose(i, 50, 30)) for i in range(40)] + edge_rows
    got = lm_scoring.score_documents(docs_of(rows), chunk_chars=900).collect()
    words = [SPACED.findall(lower(t)) for _, t in rows]
    one, two = collections.Counter(), collections.Counter()
    for w in words:
        one.update(w)
        two.update(zip(w, w[1:], strict=False))
    n = sum(one.values())
    want = []
    for (key, _), w in zip(rows, words, strict=True):
        total = sum(math.log(one[x] / n) if k == 0 else math.log(two[w[k - 1], x] / one[w[k - 1]]) if two[w[k - 1], x] >= 2 else math.log(0.4 * one[x] / n)
                    for k, x in enumerate(w))
        want.append((str(key), len(w), round(total, 4)))
    assert sorted((str(r["doc_id"]), r["n_words"], round(r["log_score"], 4)) for r in got) == sorted(want)
    assert all((r["mean_log_score"] is None) == (r["n_words"] == 0) for r in got)
    assert lm_scoring.score_documents(docs_of([])).count() == 0


def test_counts_travel_in_blocks_and_come_back_without_the_ngrams(spark):
    rows = [(i % 4, prose(i, 40, 30) + " often" * (i % 4) * 60) for i in range(40)]
    blocks = lm_scoring.count_ngrams(spark.createDataFrame(rows, "chunk int, text string").repartition(2, "chunk"), 3)
    found = {(r["chunk"], r["part"]): r["grams"] for r in blocks.collect()}
    back = {(r["chunk"], r["part"]): r for r in lm_scoring.total_counts(blocks).collect()}
    assert set(back) == set(found) and len(found) == 4 * 3
    one = collections.Counter()
    for _, text in rows:
        words, pairs, _ = lm_scoring._grams([text])
        one.update(words.view("i8").tolist() + pairs[pairs != 0].view("i8").tolist())
    assert set(one) == {g for grams in found.values() for g in grams}
    for block, grams in found.items():
        large = iter(back[block]["total_large"])
        assert [b if b < lm_scoring.LARGE else next(large) for b in back[block]["total"]] == [one[g] for g in grams]
    assert max(one.values()) > lm_scoring.LARGE


def test_texts_are_shuffled_once_for_counts_and_scores(docs_of):
    scores = lm_scoring.score_documents(docs_of([(i, prose(i, 50, 30)) for i in range(40)]), chunk_chars=900)
    assert len(scores.collect()) == 40
    final = scores._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("ReusedExchange") == 1


# decontamination

def test_hits_equal_all_windows(spark, docs_of, edge_rows, monkeypatch):
    items = [(1, prose(1, 40)), (2, prose(2, 13)), (3, "Short one!"), (4, None), (5, ""), (6, prose(2, 13)), (None, "a b c d")]
    rows = [(10 + i, prose(50 + i, 60) + " " + " ".join(prose(1, 40).split()[i:i + 15]) + "-" + prose(80 + i, 9)) for i in range(12)]
    rows += [(40, prose(2, 13)), (41, "so SHORT, one"), (42, "short x one"), (43, prose(2, 12)), (44, "A.b c d")] + edge_rows
    windows = collections.defaultdict(set)
    for key, text in items:
        w = ALNUM.findall(lower(text))
        for k in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[k:k + 13])].add("" if key is None else str(key))
    want = []
    for key, text in rows:
        w, hit, names = ALNUM.findall(lower(text)), set(), set()
        for length in {len(x) for x in windows}:
            for k in range(len(w) - length + 1):
                if tuple(w[k:k + length]) in windows:
                    hit.update(range(k, k + length))
                    names |= windows[tuple(w[k:k + length])]
        want.append((str(key), len(w), len(hit), ",".join(sorted(names)), bool(hit) and 20 * len(hit) >= len(w)))
    table = spark.createDataFrame([(k, t, 1) for k, t in items], "item_id long, text string, doc_id long")
    for block in (decontamination.BLOCK_WINDOWS, 7):  # one block, and several
        monkeypatch.setattr(decontamination, "BLOCK_WINDOWS", block)
        got = decontamination.mark_contaminated(docs_of(rows), table).collect()
        assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], ",".join(r["hit_items"]), r["contaminated"]) for r in got) == sorted(want)
    assert decontamination.mark_contaminated(docs_of([]), table).count() == 0
    clean = decontamination.mark_contaminated(docs_of(rows), table.limit(0)).collect()
    assert len(clean) == len(rows) and not any(r["n_hit"] for r in clean)


# repeated passages

def test_spans_equal_all_windows(docs_of, edge_rows):
    passage, other = prose(1, 70), prose(2, 50)
    rows = [(10 + i, prose(100 + i, 40) + " " + passage + " " + prose(200 + i, 30)) for i in range(20)]
    rows += [(40, other + " " + prose(300, 20)), (41, prose(301, 20) + "\n" + other), (42, prose(302, 10) + " " + " ".join(other.split()[:49])),
             (43, prose(303, 90)), (44, prose(303, 90)), (45, passage + " " + passage)]
    rows += [x for x in edge_rows if x[0] != 6]
    own = collections.defaultdict(set)
    words = [SPACED.findall(t or "") for _, t in rows]
    for i, w in enumerate(words):
        for k in range(len(w) - 49):
            own[tuple(w[k:k + 50])].add(i)
    want = collections.Counter()
    for i, w in enumerate(words):
        covered = set()
        for k in range(len(w) - 49):
            if len(own[tuple(w[k:k + 50])]) > 1:
                covered.update(range(k, k + 50))
        if covered:
            want[rows[i][0]] = frozenset(covered)
    got = collections.defaultdict(set)
    for r in repeated_passages.repeated_passages(docs_of(rows)).collect():
        assert r["n_words"] == r["end_word"] - r["first_word"] >= 50
        got[r["doc_id"]].update(range(r["first_word"], r["end_word"]))
    assert {k: frozenset(v) for k, v in got.items()} == dict(want)
    assert repeated_passages.repeated_passages(docs_of([])).count() == 0


def test_very_long_copies(docs_of):
    got = repeated_passages.repeated_passages(docs_of([(1, "word " * 30_000), (2, "word " * 30_000), (3, "word " * 20_000)])).collect()
    assert sorted((r["doc_id"], r["first_word"], r["end_word"]) for r in got) == [(1, 0, 30000), (2, 0, 30000), (3, 0, 20000)]


# exact duplicates

def brute_groups(rows):
    groups = collections.defaultdict(list)
    for key, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), key is None, key))
    return sorted(str((key, min(groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")])[2], len(groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")]))) for key, text in rows)


def test_exact_groups_and_collisions(spark, docs_of, edge_rows):
    rows = edge_rows + [(20, "A b"), (21, "Ab"), (22, "A\tb "), (23, "ab"), (24, "A b"), (25, "xy"), (26, "x  y")]
    path = shared_dir(spark)
    docs_of(rows).write.parquet(path)
    weak = lambda normal: F.substring(exact_dedup.sha256_of(normal), 1, 1)  # noqa: E731  nearly all digests collide
    for digest in (exact_dedup.sha256_of, weak):
        got = exact_dedup.dedup_folder(spark, path, digest=digest).collect()
        assert sorted(str((r["doc_id"], r["keep_id"], r["group_size"])) for r in got) == brute_groups(rows)
        assert all(r["doc_id"] == r["keep_id"] and len(r["text_sha256"]) == 64 for r in got if r["kept"])
        kept = collections.Counter((r["keep_id"], r["text_sha256"]) for r in got if r["kept"])
        assert set(kept.values()) == {1} and len(kept) == len({r["text_sha256"] for r in got})


def test_one_row_of_a_repeated_id_is_kept(spark, docs_of):
    path = shared_dir(spark)
    docs_of([(1, "a b"), (1, "a  b"), (2, "ab"), (3, "c"), (3, "c")]).coalesce(1).write.parquet(path)
    got = exact_dedup.dedup_folder(spark, path).collect()
    assert [r["kept"] for r in got if r["group_size"] == 3].count(True) == 1
    assert [r["kept"] for r in got if r["group_size"] == 2].count(True) == 1


def test_exact_groups_of_text_ids(spark, docs_of):
    path = shared_dir(spark)
    docs_of([(10, "a b"), (9, "ab"), (7, None)]).selectExpr("concat('id', doc_id) AS doc_id", "text", "key").write.parquet(path)
    got = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in exact_dedup.dedup_folder(spark, path).collect()}
    assert got == {"id10": ("id10", True), "id9": ("id10", False), "id7": ("id7", True)}


def test_large_groups_are_compared_in_parts(spark, docs_of, monkeypatch):
    monkeypatch.setattr(exact_dedup, "GROUP_PART", 3)
    path = shared_dir(spark)
    docs_of([(i, "same" + " " * (i % 4)) for i in range(50)] + [(60, "other")]).write.parquet(path)
    got = exact_dedup.dedup_folder(spark, path).collect()
    assert sorted({(r["keep_id"], r["group_size"]) for r in got}) == [(3, 50), (60, 1)]


def test_stream_goes_on_with_new_files(spark, docs_of):
    path, state = shared_dir(spark), shared_dir(spark)
    first, second = [(5, "a b"), (6, "c")], [(2, "ab"), (3, "a  b"), (7, "c")]
    for rows in (first, second):
        docs_of(rows).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(docs_of([]).schema).parquet(path)
        exact_dedup.update_groups(stream, f"{state}/state", f"{state}/groups")
    groups = {(r["keep"], r["size"]) for r in exact_dedup.latest_groups(spark, f"{state}/groups").collect()}
    assert groups == {(3, 3), (6, 2)}


# toxicity

def test_toxicity_on_planted_words(spark, docs_of):
    r = random.Random(3)
    rows, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        words = prose(i, 60).split()
        if toxic:
            for _ in range(3):
                words[r.randrange(60)] = r.choice(["glarf", "glarfen", "Moron", "you"]) if i % 8 else "idiot"
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic), 5))
    rows += [(700, None), (701, ""), (None, "no id"), (702, "you moron, you idiot, glarfen " + prose(5, 30)), (3, rows[3][1])]
    table = spark.createDataFrame([*labels, (None, 1, 1), (1, None, 1)], "doc_id long, toxic int, text int")
    got = toxicity.score_toxicity(docs_of(rows), table, rounds=8).collect()
    assert len(got) == len(rows) and all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.5) for x in got)
    held = [(x["predicted"], int(x["doc_id"] % 4 == 0)) for x in got if x["held_out"] and x["doc_id"] is not None and x["doc_id"] < 600]
    assert len(held) > 80 and sum(a == b for a, b in held) / len(held) > 0.93
    assert {x["doc_id"]: x["predicted"] for x in got}[702] == 1


def test_toxicity_without_labels(spark, docs_of, edge_rows):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs_of(edge_rows), none).collect()
    assert len(got) == len(edge_rows) and {x["score"] for x in got} == {0.0}
    few = spark.createDataFrame([(1, 0), (2, 1), (4, 0), (5, 1), (6, 0), (7, 1)], "doc_id long, toxic int")
    assert toxicity.score_toxicity(docs_of(edge_rows), few, rounds=2).count() == len(edge_rows)
    assert toxicity.score_toxicity(docs_of([]), few).count() == 0


# pages

ARTICLE = "<article><h1>A title</h1><p>First, a   sentence\nhere.<br>More &amp; more &#233;.<p>Second one.</article>"


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("<p", ""), ("<html><body></body></html>", ""),
    ("plain words only", "plain words only"),
    (f"<html><head><title>t</title><script>var a='</p>';</script></head><body><nav><a href=x>Home</a></nav><div class='ad'>Buy, now.</div>{ARTICLE}"
     "<footer>&copy; us</footer><section id='comments'><p>I agree, fully.</p></section>", "A title\n\nFirst, a sentence here. More & more é.\n\nSecond one."),
    ("<body><header>Top</header><div class='cookie-notice'>We use cookies, ok.</div><div><h2>Head</h2><p>A long enough paragraph, with commas, and text.</p>"
     "<p>And, of course, a second paragraph of about this length.</p></div><aside>Side bar.</aside><form><p>Name</p></form></body>",
     "Head\n\nA long enough paragraph, with commas, and text.\n\nAnd, of course, a second paragraph of about this length."),
    ("<article><p>Cut in an entity &am", "Cut in an entity &am"),
])
def test_main_text(page, text):
    assert html_extraction.main_text(page) == text


def test_extraction_keeps_other_columns(spark):
    pages = spark.createDataFrame([(1, "u", ARTICLE, "old"), (1, "u", ARTICLE, "old"), (None, None, None, None)], "page_id long, url string, html string, text string")
    got = html_extraction.extract_main_text(pages).collect()
    assert [r["n_chars"] for r in got] == [len(r["text"]) for r in got]
    assert got[0]["text"] == got[1]["text"].strip() and got[2]["text"] == ""
    assert html_extraction.extract_main_text(pages.limit(0)).count() == 0


def test_long_page():
    page = "<body>" + "<div>" * 3000 + "<p>deep text, here.</p>" + "<p>x</p>" * 20_000
    assert html_extraction.main_text(page).startswith("deep text, here.")
