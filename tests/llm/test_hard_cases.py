"""Regular strings, very long texts, crowded buckets, repeated ids."""

import random
import resource

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from csvloom.llm import byte_bpe, ngram_join, substring_dedup, textops, warc_archive
from csvloom.llm.common import keep_rows, text_key
from test_operators import as_counter, components_by_hand, removed_by_hand, rows_of, sets_by_hand

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def thue_morse(n, a="a", b="b"):
    s = a
    while len(s) < n:
        s += s.translate(str.maketrans(a + b, b + a))
    return s


@pytest.fixture(scope="module")
def bpe():
    with open(RANKS, "rb") as f:
        return byte_bpe.ByteBpe.from_file(f.read(), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(bpe):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})


@pytest.mark.parametrize("n", [16, 64, 1 << 10, 1 << 12])
def test_words_that_polynomials_confuse(spark, bpe, library, n):
    texts = [thue_morse(n), thue_morse(n, "b", "a")]
    assert [np.frombuffer(x, "<u4").tolist() for x in bpe.encode_batch(texts)] == [library.encode_ordinary(t) for t in texts]
    assert len(set(textops.Words(pa.array(texts)).hashes().tolist())) == 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["component_id"] for r in ngram_join.jaccard_components(docs).orderBy("doc_id").collect()] == [0, 1]
    words = [" ".join(t) for t in (thue_morse(256, "x", "y"), thue_morse(256, "y", "x"))]
    assert len(set(textops.gram_hashes(textops.Words(pa.array([" ".join(words)])).hashes(), 256)[[0, 256]].tolist())) == 2


def test_pieces_of_equal_hash_are_compared(monkeypatch, bpe, library):
    """With every hash the same, bytes alone tell pieces apart."""
    monkeypatch.setattr(byte_bpe, "run_hashes", lambda data, start, stop, blocks: np.zeros(len(start), np.uint64))
    rnd = random.Random(4)
    for _ in range(50):
        texts = ["".join(rnd.choice(["ab", "a", " the", "b" * 70, " ", "abcdefgh", "abcdefgi"]) for _ in range(rnd.randint(0, 30))) for _ in range(6)]
        assert [np.frombuffer(x, "<u4").tolist() for x in bpe.encode_batch(texts)] == [library.encode_ordinary(t) for t in texts]


def test_long_texts_are_cut_where_pieces_end(monkeypatch, bpe, library):
    monkeypatch.setattr(byte_bpe, "CHUNK_BYTES", 5)
    rnd = random.Random(1)
    for _ in range(1000):
        text = "".join(rnd.choice("ab'strevldmL 1  \n\t é日Ω!'²½the ing") for _ in range(rnd.randint(0, 60)))
        ids = bpe.encode_long(text)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text) and bpe.decode(np.frombuffer(ids, "<u4")) == text.encode()


def test_sections_hold_every_run_once():
    rnd = random.Random(3)
    for _ in range(200):
        text = "".join(rnd.choice(["a", "bc", " ", "  ", "\n", "d" * 30]) for _ in range(rnd.randint(0, 60))).encode()
        words = text.split()
        for overlap in (0, 1, 4):
            runs = []
            for before, part in textops.sections(np.frombuffer(text, np.uint8), overlap, 12):
                some = part.tobytes().split()
                assert some == words[before : before + len(some)]
                runs += [(before + i, tuple(some[i : i + overlap + 1])) for i in range(len(some) - overlap)]
            assert runs == [(i, tuple(words[i : i + overlap + 1])) for i in range(len(words) - overlap)]


@pytest.mark.parametrize("section", [200, 1 << 22])
def test_long_documents_among_short_ones(spark, monkeypatch, section):
    """The same results however small the sections."""
    for module in (textops, substring_dedup, ngram_join):
        monkeypatch.setattr(module, "SECTION", section)
    monkeypatch.setattr(textops.sections, "__defaults__", (section,))
    monkeypatch.setattr(textops.chunks, "__defaults__", (section,))
    rnd = random.Random(9)
    base = [f"w{rnd.randrange(40)}" for _ in range(400)]
    rows = [(i, " ".join(base[: 380 + i] if i % 2 else base[i * 3 :] + [f"v{i}"])) for i in range(12)] + [(50, "a b"), (51, None)]
    texts = [t for _, t in rows]
    got = list(ngram_join.sets_of(pa.array(texts[:1]), 5))
    assert len(got[0]) == len(sets_by_hand(rows[:1], 5)[0][1])
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([0] * len(rows)), pa.array(texts)], ["id", "th", "text"])
    seen = set()
    for words, where, before in substring_dedup.units(batch, 2, 49):
        start, stop, _ = substring_dedup.window_minimisers(words, 50, 8)
        for a, b in zip(start.tolist(), stop.tolist()):
            place = int(np.searchsorted(words.first, a, side="right")) - 1
            new = {(int(where[place]), w - int(words.first[place]) + before) for w in range(a, b)}
            assert not new & seen
            seen |= new
    assert seen == {(r, w) for r, t in enumerate(texts) for w in range(len((t or "").split()) - 49)}


def test_a_text_of_fifty_megabytes(bpe):
    """Memory beside the text stays a few times its size (measured before: some fifty times)."""
    text = " ".join(f"word{i % 99_991} and{i % 7}" for i in range(3_500_000))
    data = text.encode()
    assert len(data) > 50_000_000
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    grams = next(iter(ngram_join.sets_of(pa.array([text]), 5)))
    assert len(grams) > 600_000
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([0]), pa.array([text])], ["id", "th", "text"])
    assert sum(len(substring_dedup.window_minimisers(w, 50, 8)[0]) for w, _, _ in substring_dedup.units(batch, 2, 49)) > 100_000
    ids = bpe.encode_long(text)
    assert bpe.decode(np.frombuffer(ids, "<u4")) == data
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_200_000  # kilobytes


@pytest.mark.parametrize("room,hot", [(1, 10**6), (3000, 10**6), (3000, 1)])
def test_buckets_that_do_not_fit_go_to_a_second_round(corpus, room, hot):
    got = substring_dedup.remove_repeats(corpus, hot_rows=hot, room=room)
    assert as_counter(got.collect()) == as_counter(removed_by_hand(rows_of(corpus), 50))


def test_one_document_that_repeats_a_passage(spark):
    rnd = random.Random(2)
    passage = " ".join(f"p{rnd.randrange(1000)}" for _ in range(60))
    rows = [(9, " - ".join([passage] * 300)), (3, "x " + passage), (20, passage), (20, passage + " tail")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert as_counter(substring_dedup.remove_repeats(docs, hot_rows=50).collect()) == as_counter(removed_by_hand(rows, 50))


@pytest.mark.parametrize("frequent,lists", [(0, 64), (0, 2), (3, 4)])
def test_ngrams_combined_before_they_are_sent(corpus, frequent, lists):
    sets = sets_by_hand(rows_of(corpus), 4)
    ids = [((1 << 63) - 1 if i is None else i, k) for k, (i, _) in enumerate(sets)]
    links = [(ids[a], ids[b]) for a in range(len(sets)) for b in range(a) if sets[a][1] and sets[b][1] and 100 * len(sets[a][1] & sets[b][1]) >= 85 * len(sets[a][1] | sets[b][1])]
    want = components_by_hand(ids, links)
    got = ngram_join.jaccard_components(corpus, 4, 85, list_size=lists, frequent=frequent)
    assert as_counter((r[0], r[2]) for r in got.collect()) == as_counter((i, None if want[ids[k]][0] == (1 << 63) - 1 else want[ids[k]][0]) for k, (i, _) in enumerate(sets))


def test_rows_are_kept_by_id_and_text(spark):
    docs = spark.createDataFrame([(5, "A", 1), (5, "B", 2), (9, "B", 3), (None, None, 4), (7, "", 5), (8, "C", 6), (8, "C", 7)], "doc_id long, text string, th int")
    verdict = [(5, "A", True), (5, "B", False), (9, "B", True), (None, None, False), (7, "", True), (8, "C", True), (8, "C", False)]
    rows = spark.createDataFrame(verdict, "doc_id long, text string, kept boolean").select("doc_id", text_key(F.col("text")).alias("th"), "kept")
    got = keep_rows(docs, rows)
    assert got.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == [(5, "A"), (7, ""), (8, "C"), (9, "B")]


def test_one_row_of_each_group_also_where_ids_repeat(spark):
    long = [f"w{i}" for i in range(100)]
    docs = spark.createDataFrame([(5, " ".join(long)), (5, " ".join(long + ["x"])), (5, "another text"), (6, " ".join(long[1:])), (7, ""), (8, None)], "doc_id long, text string")
    got = keep_rows(docs, ngram_join.jaccard_components(docs, keys=True)).collect()
    assert len([r for r in got if (r["text"] or "").startswith("w")]) == 1
    assert sorted(r["doc_id"] for r in got) == [5, 5, 7, 8]


def test_urls_read_back_as_they_were(spark):
    urls = ["http://a/?q=WARC-Type: response", "", None, "http://a/\r\nWARC-Type: revisit\r\n", "a%0D%0Ab", "a\r\nb", "a\nb", "é"]
    pages = spark.createDataFrame([(i, u, "same") for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {int(r["record_id"]): (r["target_uri"], r["record_type"]) for r in warc_archive.read_archive(warc_archive.write_archive(pages)).collect()}
    assert got == {i: (u, "response" if i == len(urls) - 1 else "revisit") for i, u in enumerate(urls)}
