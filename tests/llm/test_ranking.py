"""Lexical search, alignment of tokenizers and mixing: against brute force, and on awkward input."""

import hashlib
import math
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from matriq.llm import alignment, common, mixing, registry, search
from matriq.llm.pieces import load_model
from tests.llm import brute

SCHEMA = "doc_id long, text string, source string"
A, B = (load_model(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def mixed(spark):
    """Nulls, empty texts, ties, repeated rows, odd characters, a long text, null ids and sources, and columns with clashing names."""
    rng = random.Random(8)
    word = lambda n, of: " ".join(f"w{rng.randrange(of)}" for _ in range(n))
    rows = [(i, word(rng.randrange(1, 60), 40), f"s{i % 4}") for i in range(60)]
    rows += [(60, None, "s1"), (61, "", "s1"), (62, " \n\t ", None), (63, "é中\U0001f600 ▁ x", "s2"), (64, "<|endoftext|> </s> <0x41> a\x00b", "é"), (65, word(4000, 10**6), "long")]
    rows += [rows[5], rows[6], (5, "w1 w2 w3", "s1"), (None, "w1 w1 w9", None), (None, "w1 w1 w9", None), (66, "W1 W2", "s0"), (67, "w1 w2", "s0"), (68, "x", "only"), (69, "  two words  ", "Z")]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("id", "sk", "size", "key", "q", "term", "score", "rank", "pair", "_row", "n_a", "item", "lo", "u", "_q"):
        df = df.withColumn(c, F.lit("clash"))
    return df, rows


@pytest.fixture(scope="module")
def libraries():
    t = tokenizers.Tokenizer.from_str(A.decode())
    t.encode_special_tokens = True
    s = sentencepiece.SentencePieceProcessor(model_proto=B)
    letters = alignment.byte_letters()

    def piece(i):
        name = s.id_to_piece(i)
        return bytes([int(name[3:5], 16)]) if s.is_byte(i) else name.replace("▁", " ").encode()

    return lambda x: t.encode(x, add_special_tokens=False).ids, s.encode, lambda i: bytes(letters[c] for c in t.id_to_token(i)), piece


def test_alignment_is_brute_force(spark, mixed, libraries, monkeypatch):
    df, rows = mixed
    want = brute.alignment([r[:2] for r in rows], *libraries)
    for most in (500_000, 10):
        monkeypatch.setattr(alignment, "PAIR_ROWS", most)
        monkeypatch.setattr(common, "ATTACH_ROWS", most)
        got, pairs = alignment.align_tokenizers(df, A, B)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert pairs.where("best").select("b_id").distinct().count() == pairs.select("b_id").distinct().count()
    assert pairs.agg(F.sum("count")).first()[0] == sum(r[4] for r in want)
    zero = {r[0] for r in want if not r[1]}
    assert {60, 61, 63} <= zero and 64 not in zero and 62 not in zero


def test_alignment_on_tables(spark, duck, sf_dir, libraries):
    rows = duck.sql("SELECT doc_id, text FROM documents").fetchall()
    got = registry.queries()["op12_alignment"](spark, sf_dir).collect()
    assert sorted(map(tuple, got)) == sorted(brute.alignment(rows, *libraries))


def test_alignment_of_nothing(spark, mixed):
    out, pairs = alignment.align_tokenizers(mixed[0].limit(0), A, B)
    assert out.count() == 0 and pairs.count() == 0
    out, pairs = alignment.align_tokenizers(mixed[0].where("doc_id IN (60, 61)"), A, B)
    assert [tuple(r) for r in out.orderBy("doc_id").collect()] == [(i, 0, 0, 0, 0, 0, 0, "") for i in (60, 61)] and pairs.count() == 0


@given(st.lists(st.integers(1, 6), min_size=1, max_size=40), st.lists(st.integers(1, 6), min_size=1, max_size=40))
@settings(max_examples=80, deadline=None)
def test_groups_are_least(a, b):
    short = sum(a) - sum(b)
    a, b = a + [-short] * (short < 0), b + [short] * (short > 0)
    ga, gb, u, v = alignment.align(np.array(a), np.array(b))
    ends = np.cumsum(a), np.cumsum(b)
    both = np.intersect1d(*ends)
    assert ga.tolist() == np.searchsorted(both, ends[0]).tolist() and gb.tolist() == np.searchsorted(both, ends[1]).tolist()
    assert list(zip(ends[0][u], ends[1][v], strict=True)) == [(e, e) for e in both]


def test_union_find_of_chains_and_loops():
    u, v = np.array([5, 4, 3, 9, 7, 6]), np.array([4, 3, 2, 9, 6, 7])
    assert alignment.union_find(u, v, 10).tolist() == [0, 1, 2, 2, 2, 2, 6, 6, 8, 9]


def test_byte_bpe_by_parts_is_the_librarys(libraries):
    t = alignment.ByteBpe(A)
    assert t.fast is not None
    rng = random.Random(3)
    texts = ["a" * 200_000, " " * 70_000 + "x", "ab cd " * 30_000, "\n \n" * 30_000 + "don't  stop", "é中" * 40_000, "<|endoftext|>" * 9_000]
    texts += ["".join(rng.choice("ab' \n\t1é中.,'s") for _ in range(150_000)), " ".join(rng.choice(("we'll", "x", "  ", "\n", "it's", "12", "né")) for _ in range(60_000))]
    for text in texts:
        assert t.encode(text) == libraries[0](text)


def test_search_is_brute_force(spark, mixed, monkeypatch):
    df, rows = mixed
    items = [(0, "w1 w1 W2 w9 nothing"), (1, ""), (2, None), (3, rows[65][1]), (0, "w5"), (4, "é中 x"), (5, "w1 w1 w9"), (5, "w1 w1 w9"), (None, "w3 w4"), (6, " ".join(f"w{i}" for i in range(40)))]
    it = spark.createDataFrame(items, "item_id long, text string").withColumn("q", F.lit("clash")).withColumn("term", F.lit("clash"))
    want = brute.search([r[:2] for r in rows], items)
    for size, block, first in ((16 << 20, 200_000, 16), (300, 1500, 4)):
        monkeypatch.setattr(search, "SHARD_BYTES", size)
        monkeypatch.setattr(search, "BLOCK_ROWS", block)
        monkeypatch.setattr(search, "FIRST_SHARDS", first)
        got = search.search(df, it)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    for a, b in ((df.limit(0), it), (df, it.limit(0)), (df.where("doc_id IN (60, 61)"), it)):
        assert search.search(a, b).count() == 0
    assert search.search(df, it, k=3).groupBy("item_id").count().agg(F.max("count")).first()[0] <= 6


def test_terms_of_long_texts(monkeypatch):
    text = "Straße, ab12-CD é\x00中x " * 400
    want = [t.encode() for t in brute.lower("Straße ab12 CD é 中x " * 400).split()]
    for chunk in (1 << 20, 7, 1):
        monkeypatch.setattr(search, "CHUNK", chunk)
        assert [t for c in search.terms_of(text) for t in c] == want


@given(st.data())
@settings(max_examples=60, deadline=None)
def test_max_score_keeps_all_that_reach_the_bar(data):
    n = data.draw(st.integers(1, 30))
    lists, full, weights = [], np.zeros(n, np.int64), []
    for _ in range(data.draw(st.integers(1, 6))):
        docs = np.array(sorted(data.draw(st.sets(st.integers(0, n - 1), min_size=1))), np.int64)
        values = np.array(data.draw(st.lists(st.integers(1, 50), min_size=len(docs), max_size=len(docs))), np.int64)
        w = data.draw(st.integers(1, 5))
        lists.append((int(values.max()) + data.draw(st.integers(0, 9)), docs, values))
        weights.append(w)
        full[docs] += w * values
    must = data.draw(st.integers(1, int(full.max()) + 2))
    docs, scores = search.max_score(lists, np.array(weights, np.int64), n, must)
    assert dict(zip(docs.tolist(), scores.tolist(), strict=True)) == {i: s for i, s in enumerate(full.tolist()) if s >= must}


def _key(i, text, weight):
    name = ":".join(x for x in ("mix", None if i is None else str(i), hashlib.md5((text or "").encode()).hexdigest()) if x is not None)
    return -math.log((int(hashlib.md5(name.encode()).hexdigest()[:13], 16) + 0.5) / 2**52) / weight


@pytest.mark.parametrize("edge,ranges,rows", [(2000, 1024, 200_000), (3, 4, 2), (0, 2, 2)])
def test_mixing_is_brute_force(spark, mixed, monkeypatch, edge, ranges, rows):
    for module, name, value in ((mixing, "EDGE_ROWS", edge), (mixing, "RANGES", ranges), (common, "ATTACH_ROWS", rows), (common, "BROADCAST_ROWS", rows)):
        monkeypatch.setattr(module, name, value)
    df, plain = mixed
    quality = {i: (4.0 if i % 2 else 0.25) for i in range(0, 60, 3)}
    q = spark.createDataFrame(list(quality.items()), "doc_id long, weight double")
    got = mixing.mix(df, q).collect()
    want = brute.mixture(plain, quality, _key)
    same = lambda r: (str(r[0]), str(r[1]), r[2], r[3], round(r[4], 6), r[5])
    assert sorted(map(same, got)) == sorted(map(same, want))
    for s in {r["source"] for r in got}:
        mine = [r for r in got if r["source"] == s]
        assert sum(r["taken"] for r in mine) == math.floor(mine[0]["target"] + 0.5) and all(r["taken"] <= 2 * r["size"] for r in mine)


def test_mixing_prefers_better_documents(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.when(F.col("id") < 3000, "a").otherwise("b").alias("source"))
    q = spark.range(0, 4000, 2).select(F.col("id").alias("doc_id"), F.lit(9.0).alias("weight"))
    got = mixing.mix(docs, q, weights=(1, 1)).where("source = 'a'").groupBy(F.col("doc_id") % 2).agg(F.sum("taken"))
    by = {r[0]: r[1] for r in got.collect()}
    assert by[0] > 1.1 * by[1]


def test_mixing_of_nothing_and_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "EDGE_ROWS", 5)
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(empty).count() == 0
    none = spark.createDataFrame([(1, None, "a"), (2, "", None)], SCHEMA)
    assert sorted((r["doc_id"], r["size"], r["target"], r["taken"]) for r in mixing.mix(none).collect()) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]
    alike = spark.createDataFrame([(7, "one two three", "a")] * 40 + [(8, "one two", "b")] * 60, SCHEMA)
    got = mixing.mix(alike).collect()
    for s in ("a", "b"):
        mine = [r for r in got if r["source"] == s]
        assert len({r["target"] for r in mine}) == 1 and sum(r["taken"] for r in mine) == math.floor(mine[0]["target"] + 0.5) and max(r["taken"] for r in mine) <= 2 * mine[0]["size"]
