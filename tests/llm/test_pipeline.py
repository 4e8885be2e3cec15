import collections
import random
import re

import pytest

import corpus_pipeline as pipeline
from yardframe.llm import toxicity
from yardframe.llm.tables import numbered

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, source string, n_words string, contaminated int, row_of_stage string, hit_spans string"


def prose(seed, n, words=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(words)}" for _ in range(n))


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture
def folder(spark, tmp_path):
    """A folder with labels and benchmark; makes documents whose column names clash with those of the operators."""
    labels = [(i, int(i % 4 == 0)) for i in range(400)] + [(None, 1)]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    items = [(i, prose(5000 + i, 14)) for i in range(5)] + [(9, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


@pytest.fixture
def docs_like(spark):
    def make(rows):
        return spark.createDataFrame([(i, t, s, f"n{k}", k, "r", "h") for k, (i, t, s) in enumerate(rows)], SCHEMA)
    return make


def kept(df):
    return sorted(r["contaminated"] for r in df.collect())


HARD = [(None, None, "a"), (None, "", "a"), (5, "unrelated one two three", "b"), (5, "another text of five words", None),
        (None, "a fourth text is here too", "b"), (6, "word " * 20_000, "a")]


def test_unrelated_rows_with_null_and_equal_ids_stay(spark, docs_like, folder):
    docs = docs_like(HARD)
    for stage in (pipeline.keep_one_of_each_group, pipeline.drop_benchmark_text):
        out = stage(spark, docs, folder)
        assert kept(out) == list(range(6)) and out.columns == docs.columns
        assert stage(spark, docs.limit(0), folder).count() == 0
    assert pipeline.keep_decent(spark, docs.limit(0), folder).columns == docs.columns


def test_row_numbers_differ_and_stay(spark, docs_like, tmp_path):
    docs_like(HARD * 4).repartition(3).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    first, again = ({r["contaminated"]: r["x"] for r in numbered(docs, "x").collect()} for _ in range(2))
    assert first == again and len(set(first.values())) == 24


def test_toxicity_goes_by_row(spark, docs_like, folder):
    r = random.Random(1)
    rows = []
    for i in range(400):
        words = prose(i, 50).split()
        if i % 4 == 0:
            for _ in range(4):
                words[r.randrange(50)] = "glarf"
        rows.append((i, " ".join(words), "a"))
    words = prose(9, 50).split()
    words[3] = words[17] = words[30] = words[41] = "glarf"
    toxic = " ".join(words)
    rows += [(None, toxic, "a"), (None, prose(8, 50), "a"), (900, toxic, "a"), (900, prose(7, 50), "a"), (2, None, "a")]
    docs = docs_like(rows)
    out = pipeline.keep_decent(spark, docs, folder)
    assert out.columns == docs.columns
    numbers = set(kept(out))
    assert 400 not in numbers and 402 not in numbers  # toxic rows, one with a null id and one with a clean row's id
    assert {401, 403, 404, 1, 2} <= numbers
    # the stage is exactly the operator's decision, row by row
    scored = toxicity.score_toxicity(numbered(docs.coalesce(1), "at"), spark.read.parquet(f"{folder}/labels.parquet"), row="at")
    assert scored.columns[:2] == ["at", "doc_id"]
    assert scored.where("predicted = 0").count() == len(numbers)


def test_one_row_of_each_near_group_stays(spark, docs_like, folder):
    r = random.Random(4)
    rows = []
    for g in range(12):
        base = prose(g, 80).split()
        for _ in range(5):
            words = list(base)
            for _ in range(r.randrange(3)):
                words[r.randrange(80)] = "x"
            rows.append((r.choice([None, *range(40)]), " ".join(words), "a"))
    rows += [(None, None, "a"), (3, "", "a"), (3, "two words", "a"), (7, "Two  words", "b")]
    sets = []
    for _, t, _ in rows:
        w = SPACED.findall(lower(t))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(rows)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                group[top(i)] = top(j)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[top(i)].append(i)
    out = {r["contaminated"] for r in pipeline.keep_one_of_each_group(spark, docs_like(rows), folder).collect()}
    assert len(out) == len(groups)
    for members in groups.values():
        stays = [i for i in members if i in out]
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        assert len(stays) == 1 and rows[stays[0]][0] == (min(ids) if ids else None)


def test_benchmark_text_goes(spark, docs_like, folder):
    items = [prose(5000 + i, 14) for i in range(5)]
    rows = [(1, prose(1, 100), "a"), (2, prose(2, 60) + " " + items[0], "a"), (None, items[1].upper(), "a"),
            (2, prose(3, 400) + " " + items[2], "a"), (4, " ".join(items[3].split()[:12]), "a"), (5, None, "a")]
    want = []
    for k, (_, text, _) in enumerate(rows):
        words, hit = ALNUM.findall(lower(text)), set()
        for item in items:
            w = ALNUM.findall(item)
            for s in range(len(w) - 12):
                for p in range(len(words) - 12):
                    if words[p : p + 13] == w[s : s + 13]:
                        hit.update(range(p, p + 13))
        if not (hit and 20 * len(hit) >= len(words)):
            want.append(k)
    docs = docs_like(rows)
    out = pipeline.drop_benchmark_text(spark, docs, folder)
    assert kept(out) == want == [0, 3, 4, 5] and out.columns == docs.columns


def test_mix_repeats_whole_rows(spark, docs_like, folder):
    rows = [(i % 30, prose(i % 45, 20), "abc"[i % 3]) for i in range(90)] + [(1, prose(1, 20), None), (None, None, "a")]
    docs = docs_like(rows)
    out = pipeline.mix_sources(spark, docs, folder)
    assert out.columns == docs.columns
    copies = collections.Counter(r["contaminated"] for r in out.collect())
    assert max(copies.values()) <= 3 and all(rows[k][2] == r["source"] for k in copies for r in [out.where(f"contaminated = {k}").first()][:1] if k < 5)
    taken = sum(len(SPACED.findall(rows[k][1] or "")) * n for k, n in copies.items())
    assert abs(taken - 1820) <= 20 * 5


def test_run_writes_every_stage(spark, docs_like, folder):
    rows = [(i, prose(i, 60), "ab"[i % 2]) for i in range(40)] + HARD
    docs_like(rows).write.parquet(f"{folder}/documents.parquet")
    out = pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    found = sorted((r["start"], r["n_tokens"]) for r in out.collect())
    assert found[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(found, found[1:], strict=False))
    assert [name for name, _ in pipeline.STAGES] == ["toxicity", "near duplicates", "decontamination", "mixing", "token ids"]
