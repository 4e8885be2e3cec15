import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from yardframe.llm import token_counts, token_output
from yardframe.llm.tables import running_totals, shared_dir
from yardframe.llm.token_files import SPACE_CODES, Encoder
from yardframe.llm.words import ALNUM_LOWER, SPACED, gram_hashes, pieces, split_words, window_hashes

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", "a", "  a", " \n a", "\n \n\n x  ", "a<|endoftext|>b <|endoftext|>", "'s it's '' 's", "\x1c a\x1db", "a　b  c", "\t\t a\t", "é ß 你好 😀😀 x",
       "don't  I'LL", "x" * 200 + " y", " \u0085 ᠎ z", "\r\n\r\n a"]


def test_words_are_the_runs_of_the_contract():
    texts = ["Ab c-d  É9\n", None, "", "x\x0by"]
    w = split_words(texts, SPACED)
    found = [[w.data[a:b].tobytes().decode() for a, b in zip(w.start[i:j], w.end[i:j], strict=True)] for i, j in zip(w.first[:-1], w.first[1:], strict=True)]
    assert found == [["Ab", "c-d", "É9"], [], [], ["x", "y"]]
    w = split_words(texts, ALNUM_LOWER)
    assert w.counts().tolist() == [4, 0, 0, 2]


def test_equal_words_and_grams_have_equal_hashes_wherever_they_stand():
    a, b = split_words(["one two three four"], SPACED), split_words(["zero " * 300_000, "x one two three four"], SPACED)
    assert a.hash.tolist() == b.hash[-4:].tolist()
    for size in (1, 3, 4):
        assert gram_hashes(a.hash, size)[0] == gram_hashes(b.hash, size)[-(4 - size + 1)]
    long_a, long_b = np.arange(60, dtype=np.uint64), np.concatenate([np.full(7, 9, np.uint64), np.arange(60, dtype=np.uint64)])
    assert gram_hashes(long_a, 50).tolist() == gram_hashes(long_b, 50)[7:].tolist()


def test_windows_stay_inside_their_text():
    _, text, first = window_hashes(split_words(["a b c", "d", "e f"], SPACED), 2)
    assert list(zip(text.tolist(), first.tolist(), strict=True)) == [(0, 0), (0, 1), (2, 0)]


def test_pieces_cover_all_texts():
    assert list(pieces(["a" * 5, None, "b" * 20, "c"], 10)) == [(0, 2), (2, 3), (3, 4)]
    assert list(pieces([])) == []


@pytest.mark.parametrize("plain", [False, True])
def test_encoder_equals_the_library(plain):
    library = Tokenizer.from_file(VOCABULARY)
    library.encode_special_tokens = plain
    own = Encoder(VOCABULARY, plain)
    for text in ODD:
        assert np.frombuffer(own.encode(text), own.dtype).tolist() == library.encode(text, add_special_tokens=False).ids


def test_odd_texts_are_cut_as_the_library_cuts_them():
    library, own = Tokenizer.from_file(VOCABULARY), Encoder(VOCABULARY)
    r = random.Random(5)
    texts = [f"{a}{b}{c}" for a in ("x", " ", "'") for b in map(chr, range(128)) for c in ("x1", " y", "'s")]
    texts += [f"w{b}{c}{d} v" for b in "a\u00e9\u4f603'." for c in map(chr, [*range(0x2000, 0x2070), *SPACE_CODES, 0xD7, 0x301, 0x24F, 0x250]) for d in ("", "a", " ")]
    texts += ["".join(r.choices("ab Z09\u00e9\u00a0\u4f60'.,\n\t \x0b\x1c\x00_dlmrstv", k=r.randrange(1, 40))) for _ in range(3000)] + ["it's " + "long" * 40 + ", x"]
    for text in texts:
        assert np.frombuffer(own.encode(text), own.dtype).tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_words_before_other_marks_are_not_encoded_again(monkeypatch):
    own, words, encoded = Encoder(VOCABULARY), [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou\u00e9" for c in "lmnrt"], []
    word = own._word
    monkeypatch.setattr(own, "_word", lambda shown: encoded.append(shown) or word(shown))
    for mark in ("", ".", ",", "!", ".\n"):
        own.encode("so " + " ".join(w + mark + "A" * (mark == ".\n") for w in words))
    assert len(encoded) == len(set(encoded)) <= 1 + len(words) + 6


def test_words_before_marks_are_looked_up_without_them():
    library, own = Tokenizer.from_file(VOCABULARY), Encoder(VOCABULARY)
    words = ["word", "caf\u00e9", "w2", "2", "\u4f60", "it's", "'", "x'", "(a", "a\u00b2", "\u2014", "a-b"]
    for mark in (".", ",", "!!", ",'", "'.", "***", ".***", "\u2014,", ".\nA", ")-"):
        text = " ".join(["so", *[w + mark for w in words], "end"])
        for _ in range(2):
            assert np.frombuffer(own.encode(text), own.dtype).tolist() == library.encode(text, add_special_tokens=False).ids, text
    own.forget()
    own.encode("so " + " ".join(w + m for w in ("word", "caf\u00e9", "w2") for m in (".", ",", "!!", ".***")))
    assert not own.marked and set(own.parts) == {"word", "caf\u00e9", "w2"}


def test_white_space_before_a_space_is_not_cut():
    library, own = Tokenizer.from_file(VOCABULARY), Encoder(VOCABULARY)
    for text in ("a  b", "a b ", " a b", "a\n b c", "a b\n ", "a \n b", "a \nb c", "a b\u00a0 c", "a b   c", "a b\n\n c", " ", "  ", "a " + "x" * 99 + " " + "x" * 99):
        for _ in range(2):
            assert np.frombuffer(own.encode(text), own.dtype).tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_other_tokenizers_take_the_plain_way():
    path = public_tokenizers.path("word_bpe_49k.json")
    own, library = Encoder(path), Tokenizer.from_file(path)
    assert not own.by_piece
    assert np.frombuffer(own.encode("Some Words here"), own.dtype).tolist() == library.encode("Some Words here", add_special_tokens=False).ids


def expected_tokens(rows, end):
    library = Tokenizer.from_file(VOCABULARY)
    at, out = 0, []
    for key, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        ids = library.encode(text or "", add_special_tokens=False).ids + [end]
        out.append((key, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_token_output_round_trip(docs_of):
    rows = [(i * 7 % 101, t) for i, t in enumerate(ODD * 3)] + [(None, "no name"), (999, None)]
    got = token_output.token_documents(docs_of(rows), VOCABULARY).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == expected_tokens(rows, 0)


def test_token_output_edges(docs_of, edge_rows):
    got = token_output.token_documents(docs_of(edge_rows), VOCABULARY).collect()
    got = sorted(got, key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [1, 2, 3, 4, 4, 5, 6, 7, None]
    assert [r["n_tokens"] for r in got[:2]] == [1, 1]
    starts = [r["start"] for r in got]
    assert starts == np.cumsum([0, *[r["n_tokens"] for r in got]])[:-1].tolist()
    assert token_output.token_documents(docs_of([]), VOCABULARY).count() == 0


def test_perfect_hash_is_minimal_and_rejects_strangers():
    h = np.random.default_rng(3).integers(0, 1 << 63, 5000, dtype=np.uint64)
    raw = token_output.index_bytes(h, np.zeros(5000, np.int64), np.arange(5000), np.ones(5000, np.int64))
    index = token_output.Index(raw)
    assert sorted(index.hashed.slots(h).tolist()) == list(range(5000))
    assert index.look_up(h)["first"].tolist() == list(range(5000))
    assert index.look_up(h + np.uint64(1))["count"].sum() <= 1


def test_index_finds_only_written_keys(spark, docs_of):
    folder = shared_dir(spark)
    token_output.write_tokens(docs_of([(i, "a b") for i in range(50)]), folder, VOCABULARY)
    asked = spark.range(40, 60).withColumnRenamed("id", "doc_id")
    assert {r["key"] for r in token_output.find_tokens(asked, folder).where("count > 0").collect()} == set(range(40, 50))


@pytest.mark.parametrize("block", [2, 10, 64, 1 << 22])
def test_separator_scan_stitches_blocks(spark, docs_of, edge_rows, block):
    folder = shared_dir(spark)
    rows = [r for r in edge_rows if r[0] not in (6, 7) or block > 1000] + [(90 + i, t) for i, t in enumerate(ODD)]
    names = token_counts.write_flat(docs_of(rows).coalesce(2), folder, VOCABULARY, 50256).collect()
    lengths = token_counts.document_lengths(token_counts.scan_blocks(spark, folder, 2, 50256, block)).collect()
    found = {(r["file"], r["ordinal"]): r["n_tokens"] for r in lengths}
    library = Tokenizer.from_file(VOCABULARY)
    library.encode_special_tokens = True
    want = sorted((r[0] is None, r[0] or 0, len(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows)
    assert sorted((r["key"] is None, r["key"] or 0, found[r["file"], r["ordinal"]]) for r in names) == want
    assert len(found) == len(rows)


def test_separator_scan_of_unfinished_and_empty_files(spark):
    from yardframe.llm.token_files import write_whole

    folder = shared_dir(spark)
    write_whole(f"{folder}/a.ids", [np.array([5, 9, 9, 7, 7], "<u2").tobytes()])
    write_whole(f"{folder}/b.ids", [])
    rows = token_counts.document_lengths(token_counts.scan_blocks(spark, folder, 2, 9, 4)).collect()
    assert sorted((r["ordinal"], r["first"], r["n_tokens"]) for r in rows) == [(0, 0, 1), (1, 2, 0), (2, 3, 2)]


def test_token_counts_of_an_empty_table(spark, docs_of):
    assert token_counts.token_counts(docs_of([]), shared_dir(spark), VOCABULARY, 50256).count() == 0


def test_running_totals(spark):
    rows = spark.createDataFrame([(i % 7, i) for i in range(50)] + [(None, 100)], "k long, v long")
    got = sorted(running_totals(rows, ["k", "v"], ["v"]).collect(), key=lambda r: (r["k"] is None, r["k"], r["v"]))
    assert [r["before_v"] for r in got] == np.cumsum([0, *[r["v"] for r in got]])[:-1].tolist()
    assert got[-1]["k"] is None


def test_pattern_of_words_matches_the_jvm(spark):
    from yardframe.llm.mixing import word_count

    texts = ["a b", "\x0b a b\x1fc ", "", None, " 　x"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(word_count("t")).collect()]
    assert got == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
