"""Aligning two tokenizers' tokens of the same bytes: union-find over overlapping tokens, links, and counts of linked pairs.

Tokens of both sides are nodes; two that share a byte are joined. A component is a least group of tokens that covers the same
bytes on both sides. Within it, an A token and a B token that end together are linked. Counts of linked pairs are summed over
all documents and come back to each document by a join.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matriq.llm.common import attach, discard, materialize, read, small, small_batches
from matriq.llm.features import pieces
from matriq.llm.pieces import BYTE, SPACE, _fields, load_model

#: Text of documents that are aligned at once.
BATCH_BYTES = 1 << 20
#: Long texts are encoded in parts of so many characters, cut where the byte-level tokenizer always cuts.
PART = 1 << 16
CUT = re.compile(r"(?<=[!-~]) (?=[A-Za-z])")
#: Distinct pairs that are broadcast (24 bytes each); beyond, hot pairs alone are.
PAIR_ROWS = 500_000
#: Fixed value: how byte-level BPE splits text before it merges.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
AFTER = (",", "|", ";", "")
ROWS = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<bigint>, times array<bigint>"


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: themselves if printable, else the next letters from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """A byte-level BPE of the tokenizers library's format, without special tokens: their strings are plain text."""

    def __init__(self, file: bytes):
        import tiktoken
        from tokenizers import Tokenizer

        spec, letters = json.loads(file), byte_letters()
        vocab = spec["model"]["vocab"]
        special = {t["content"] for t in spec["added_tokens"]}
        known = {bytes(map(letters.__getitem__, word)): i for word, i in vocab.items() if word not in special}
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for b, i in known.items():
            self.bytes[i] = b
        self.library = Tokenizer.from_str(file.decode())
        self.library.encode_special_tokens = True
        # Merges in order of their results' ids are what the faster library assumes.
        made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        before = spec.get("pre_tokenizer") or {}
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not spec.get("normalizer")
        self.fast = None
        if plain and all(a < b for a, b in zip(made, made[1:], strict=False)) and len(known) == 256 + len(made):
            self.fast = tiktoken.Encoding("pairs", pat_str=PATTERN, mergeable_ranks=known, special_tokens={})

    def encode(self, text: str) -> list[int]:
        out, at = [], 0
        while at < len(text):
            cut = CUT.search(text, at + PART)
            end = cut.start() if cut else len(text)
            out += self._part(text[at:end])
            at = end
        return out

    def _part(self, text: str) -> list[int]:
        if self.fast and len(text) <= 2 * PART:
            return self.fast.encode_ordinary(text)
        return self.library.encode(text, add_special_tokens=False).ids


class Pieces:
    """A SentencePiece model, without marks of begin and end."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        named = [dict(_fields(value)) for number, value in _fields(model) if number == 1]
        self.bytes = [bytes([int(p[1][3:5], 16)]) if p.get(3) == BYTE else p[1].replace(SPACE, b" ") for p in named]

    def encode(self, text: str) -> list[int]:
        return self.library.encode(text)


def union_find(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The smallest node that edges (u, v) reach from each of n nodes: roots hook to smaller roots, all edges at once, and paths are halved until flat."""
    parent = np.arange(n)
    while len(u):
        a, b = parent[u], parent[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
    return parent


def align(size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Group of each A and B token, and the linked places (a, b), of two sequences of token sizes with the same sum. No token is empty."""
    end_a, end_b, n_a, n_b = np.cumsum(size_a), np.cumsum(size_b), len(size_a), len(size_b)
    total = int(end_a[-1]) if n_a else 0
    at_a, at_b = np.zeros(total + 1, bool), np.zeros(total + 1, bool)
    at_a[end_a], at_b[end_b] = True, True
    seg = np.flatnonzero(at_a | at_b)  # where a stretch of one A and one B token ends: an edge of the overlap graph
    both_a, both_b = at_a[seg], at_b[seg]
    u, v = np.cumsum(both_a) - both_a, np.cumsum(both_b) - both_b
    root = union_find(u, v + n_a, n_a + n_b)
    number = np.cumsum(root[:n_a] == np.arange(n_a)) - 1
    linked = both_a & both_b
    return number[root[:n_a]], number[root[n_a:]], u[linked], v[linked]


class Side:
    """A tokenizer with the bytes of all its entries in one array."""

    def __init__(self, tokenizer: ByteBpe | Pieces):
        self.encode, self.count = tokenizer.encode, len(tokenizer.bytes)
        self.size = np.array([len(x) for x in tokenizer.bytes], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.body = np.frombuffer(b"".join(tokenizer.bytes), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of the tokens in turn."""
        size = self.size[ids]
        return self.body[np.arange(int(size.sum())) + np.repeat(self.begin[ids] - (np.cumsum(size) - size), size)]


class Aligner:
    """Both tokenizers in a worker, and strings of all ids with what may follow them."""

    def __init__(self, a: bytes, b: bytes):
        self.a, self.b = Side(ByteBpe(a)), Side(Pieces(b))
        self.names = [f"{i}{s}" for i in range(max(self.a.count, self.b.count)) for s in AFTER]
        self.bits = self.b.count.bit_length(), self.a.count.bit_length()

    def tokens(self, texts: Sequence[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both sides for each text; none if either side's bytes are not the text's after a space."""
        want = [f" {t}".encode() if t else b"" for t in texts]
        a = [np.array(self.a.encode(f" {t}") if t else [], np.int64) for t in texts]
        b = [np.array(self.b.encode(t) if t else [], np.int64) for t in texts]
        for side, ids in ((self.a, a), (self.b, b)):
            fits = [int(side.size[x].sum()) == len(w) for x, w in zip(ids, want, strict=True)]
            at = np.cumsum([len(w) if f else 0 for w, f in zip(want, fits, strict=True)])
            text = np.frombuffer(b"".join(w for w, f in zip(want, fits, strict=True) if f), np.uint8)
            wrong = np.flatnonzero(side.joined(np.concatenate([x[: len(x) * f] for x, f in zip(ids, fits, strict=True)])) != text)
            for i in {*np.searchsorted(at, wrong, "right").tolist(), *(i for i, f in enumerate(fits) if not f)}:
                a[i] = b[i] = a[i][:0]
                want[i] = b""
        return a, b

    def run(self, texts: Sequence[str]) -> tuple[dict[str, np.ndarray], list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Counts, digests, and per text its linked pairs (a << 32 | b) and their times, as one array with offsets."""
        n = len(texts)
        got = self.tokens(texts)
        n_a, n_b = (np.array([len(x) for x in side], np.int64) for side in got)
        a, b = (np.concatenate(side) for side in got)
        group_a, group_b, u, v = align(self.a.size[a], self.b.size[b])
        of_a = np.repeat(np.arange(n), n_a)
        first = np.diff(group_a, prepend=-1) > 0
        n_groups = int(first.sum())
        in_a, in_b = np.bincount(group_a, minlength=n_groups), np.bincount(group_b, minlength=n_groups)
        upto_a, upto_b = np.cumsum(in_a), np.cumsum(in_b)
        code = np.empty(len(a) + len(b), np.int64)
        places_a, places_b = np.arange(len(a)), np.arange(len(b))
        code[places_a + (upto_b - in_b)[group_a]] = a * 4 + (places_a == upto_a[group_a] - 1)
        code[places_b + upto_a[group_b]] = b * 4 + 2 * (places_b == upto_b[group_b] - 1)
        ends = np.cumsum(n_a + n_b)
        code[ends[n_a > 0] - 1] |= 3
        digests, start = [], 0
        for end in ends.tolist():
            digests.append(hashlib.sha256("".join(map(self.names.__getitem__, code[start:end].tolist())).encode()).hexdigest() if end > start else "")
            start = end
        bits_b, bits_a = self.bits
        key, times = np.unique(of_a[u] << bits_a + bits_b | a[u] << bits_b | b[v], return_counts=True)
        doc, pair = key >> bits_a + bits_b, key & (1 << bits_a + bits_b) - 1
        pair = pair >> bits_b << 32 | pair & (1 << bits_b) - 1
        counts = {"n_a": n_a, "n_b": n_b, "n_groups": np.bincount(of_a[first], minlength=n), "n_links": np.bincount(of_a[u], minlength=n)}
        return counts, digests, np.searchsorted(doc, np.arange(n + 1)), pair, times


_aligners: dict[int, Aligner] = {}


def aligner(a: bytes, b: bytes) -> Aligner:
    """One a worker process and pair of tokenizers."""
    key = hash((a, b))
    if key not in _aligners:
        _aligners.clear()
        _aligners[key] = Aligner(a, b)
    return _aligners[key]


def aligned(docs: DataFrame, a: bytes, b: bytes, id_col: str, text_col: str) -> DataFrame:
    """(_row, id, ROWS) of each row of docs: each task encodes and aligns its own texts, about BATCH_BYTES at a time."""
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast((a, b))  # two vocabulary files

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(*sent.value)
        for batch in batches:
            for rows in pieces(batch, 2, BATCH_BYTES):
                counts, digests, at, pair, times = both.run([t or "" for t in rows.column(2).to_pylist()])
                lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x, pa.int64())) for x in (pair, times)]
                arrays = [rows.column(0), rows.column(1), *(pa.array(x, pa.int64()) for x in counts.values()), pa.array(digests, pa.string()), *lists]
                yield pa.RecordBatch.from_arrays(arrays, names=["_row", id_col, *counts, "groups_sha256", "pairs", "times"])

    numbered = small_batches(docs).select(F.monotonically_increasing_id().alias("_row"), id_col, text_col)
    return numbered.mapInArrow(run, f"_row bigint, `{id_col}` {kind}, {ROWS}")


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, count, best): how many links of all rows hold each pair of ids, and whether that is the most of its B id."""
    counts = materialize(rows.select(F.explode(F.arrays_zip("pairs", "times")).alias("e")).groupBy(F.col("e.pairs").alias("pair")).agg(F.sum("e.times").alias("count")))
    b = F.col("pair").bitwiseAND((1 << 32) - 1)
    most = counts.groupBy(b.alias("_b")).agg(F.max("count").alias("_most"))
    out = materialize(counts.join(most, b == F.col("_b")).select("pair", "count", (F.col("count") == F.col("_most")).alias("best")))
    discard(counts)
    return out


def align_tokenizers(docs: DataFrame, a: bytes, b: bytes, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, pairs). Rows, one per row of docs: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256. Pairs: a_id, b_id, count, best.

    a: a byte-level BPE file, b: a SentencePiece model that puts a space before the text. n_best: links whose pair is its B id's most frequent, ties
    included; count_sum: their pairs' counts, summed over links. groups_sha256 is of the ids of all groups, written a1,a2|b1;a3|b2,b3.

    Null and empty texts, and texts whose tokens don't give back a space and the text (U+2581 in a text, for one), have no
    tokens: zeros, and '' for the digest. Whole texts are aligned, at any length. Repeated rows and ids each keep their row and each count;
    null ids stay null; no rows give none; other columns are ignored.
    """
    rows = materialize(aligned(docs, a, b, id_col, text_col))
    pairs = pair_counts(rows)
    each = rows.select("_row", F.explode(F.arrays_zip("pairs", "times")).alias("e")).select("_row", F.col("e.pairs").alias("pair"), F.col("e.times").alias("times"))
    if small(pairs, PAIR_ROWS):
        known = each.join(F.broadcast(pairs), "pair")
    else:
        known = attach(each, pairs, "pair", ["count", "best"], "_row")
    sums = known.groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = rows.drop("pairs", "times").join(sums, "_row", "left")
    out = out.select(id_col, "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
    half = F.col("pair").bitwiseAND((1 << 32) - 1)
    return out, pairs.select(F.shiftright("pair", 32).cast("int").alias("a_id"), half.cast("int").alias("b_id"), "count", "best")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, by the byte-level BPE of 50k and the SentencePiece model of 32k; nulls as in align_tokenizers()."""
    import public_tokenizers

    a, b = (load_model(public_tokenizers.path(name)) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return align_tokenizers(read(spark, sf_dir, "documents"), a, b)[0]
