"""Removal of every byte that lies in a string of LENGTH bytes which also starts elsewhere.

Windows of LENGTH bytes are dealt out by the least hash of their GRAM-byte grams, so equal windows meet
in one place. Neighbouring windows with the same least hash form a block of text, shipped once. Blocks
that occur twice as a whole are settled by counting. The others of a least hash are joined to one
text, whose Burrows-Wheeler transform is extended backward, breadth first: the common prefixes of
neighbouring suffixes come out by increasing length, until LENGTH; what is left undefined then shares
LENGTH bytes or more.

Beside the removal, passages of PASSAGE words that another text has too are reported, which may be shorter than
LENGTH bytes. Windows of words are dealt out likewise, and those whose least hash another text has are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matriq.llm.common import attach, broadcast_if_small, discard, materialize, read, small_batches
from matriq.llm.features import flat, mix, pieces, powers, word_hashes

LENGTH, GRAM = 400, 32
#: Words of a passage that is reported, and of the grams that windows of so many words are dealt out by.
PASSAGE, WORD_GRAM = 50, 16
PIECE = 1 << 18
#: Bytes that one transform takes; a least hash with more is settled by hashes of its windows.
TEXT = 2_000_000
#: Texts of several least hashes are joined up to this size.
BATCH = 400_000
#: Bytes compared outright when suffixes are sorted; extension begins there.
SEED = 16
END = 255


def _sums(body: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = powers(len(body) + 1)
    with np.errstate(over="ignore"):
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum((body.astype(np.uint64) + np.uint64(1)) * up[: len(body)], dtype=np.uint64)]), down


def gram_hashes(body: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each `size` neighbouring bytes, or words given by their hashes."""
    sums, down = _sums(body)
    with np.errstate(over="ignore"):
        return mix((sums[size:] - sums[:-size]) * down[: len(body) - size + 1])


def sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w neighbours, from running minima of blocks of w in both directions."""
    n = len(x)
    m = -(-n // w) * w
    padded = np.full(m, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    rows = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def blocks(body: np.ndarray, at: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """row, first byte, bytes, least hash and whether its gram occurs twice, of each run of windows with one least hash."""
    none = np.zeros(0, np.int64)
    if len(body) < length:
        return none, none, none, np.zeros(0, np.uint64), np.zeros(0, bool)
    v = gram_hashes(body, gram)
    m = sliding_least(v, length - gram + 1)
    size = np.diff(at)
    good = np.flatnonzero(size >= length)
    count = size[good] - length + 1
    row = np.repeat(good, count)
    start = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(at[good], count)
    if not len(start):
        return none, none, none, np.zeros(0, np.uint64), np.zeros(0, bool)
    value = m[start]
    first = np.flatnonzero(np.concatenate([[True], (value[1:] != value[:-1]) | (row[1:] != row[:-1])]))
    windows = np.diff(np.concatenate([first, [len(start)]]))
    a, least = start[first], value[first]
    few = np.flatnonzero(v <= least.max())
    order = np.lexsort((few, v[few]))
    names, at_name = np.unique(v[few][order], return_inverse=True)
    place = at_name.astype(np.int64) * (len(v) + 1) + few[order]
    mine = np.searchsorted(names, least).astype(np.int64) * (len(v) + 1)
    twice = np.searchsorted(place, mine + a + windows + length - gram) - np.searchsorted(place, mine + a) > 1
    return row[first], a, windows + length - 1, least, twice


def sorted_suffixes(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array by prefix doubling, in order of the first `depth` bytes at least, and the first 8 bytes at each place."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    head = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)[:n]).view(">u8").ravel().astype(np.uint64)
    sa = np.argsort(head, kind="stable")
    new = np.concatenate([[True], head[sa][1:] != head[sa][:-1]])
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.zeros(n + depth + 8, np.int64)
    rank[sa] = group + 1
    open_ = np.flatnonzero(~(new & np.concatenate([new[1:], [True]])))
    h = 8
    while h < depth and len(open_):
        p = sa[open_]
        key = rank[p] * (n + 2) + rank[p + h]
        order = np.argsort(key, kind="stable")
        p, key = p[order], key[order]
        sa[open_] = p
        new = np.concatenate([[True], key[1:] != key[:-1]])
        begin = np.maximum.accumulate(np.where(new, open_, 0))
        rank[p] = begin + 1
        open_ = open_[~(new & np.concatenate([new[1:], [True]]))]
        h *= 2
    return sa, head


def repeated(text: np.ndarray, length: int) -> np.ndarray:
    """Places of text whose next `length` bytes start elsewhere too; END bytes never match across.

    Breadth-first backward extension of intervals of the Burrows-Wheeler transform: an interval is extended by every byte before it, and where the
    extended interval ends at a place without a value yet, the common prefix there is as long as the string before extension.
    """
    n = len(text)
    sa, head = sorted_suffixes(text, length)
    long = np.concatenate([head, np.zeros(16, np.uint64)])
    x = np.concatenate([[np.uint64(2**64 - 1)], long[sa[1:]] ^ long[sa[:-1]]])
    y = np.concatenate([[np.uint64(0)], long[sa[1:] + 8] ^ long[sa[:-1] + 8]])
    same = lambda z: sum((z < np.uint64(1 << (64 - 8 * j))).astype(np.int16) for j in range(1, 8)) + (z == 0)
    lcp = np.where(x == 0, 8 + same(y), same(x)).astype(np.int16)
    lcp[lcp >= SEED] = -1
    lcp[0] = 0
    lcp = np.concatenate([lcp, np.zeros(1, np.int16)])
    before = text[sa - 1]
    by_byte = np.argsort(before, kind="stable")
    to = np.empty(n, np.int64)
    to[by_byte] = np.arange(n)
    equal = before[by_byte][1:] == before[by_byte][:-1]
    later, earlier = np.full(n, n, np.int64), np.full(n, -1, np.int64)
    later[by_byte[:-1][equal]] = by_byte[1:][equal]
    earlier[by_byte[1:][equal]] = by_byte[:-1][equal]

    known = np.flatnonzero(lcp >= 0)
    ends = np.flatnonzero(lcp == SEED - 1)
    ends = ends[ends > 0]
    lo, hi = known[np.searchsorted(known, ends) - 1], ends - 1
    for value in range(SEED, length):
        if not len(lo):
            break
        size = hi - lo + 1
        t = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - lo, size)
        lo_of, hi_of = np.repeat(lo, size), np.repeat(hi, size)
        lo = np.sort(to[t[earlier[t] < lo_of]])
        hi = np.sort(to[t[later[t] > hi_of]])
        new = lcp[hi + 1] < 0
        lo, hi = lo[new], hi[new]
        lcp[hi + 1] = value
    pair = np.flatnonzero(lcp[:n] < 0)
    return np.unique(np.concatenate([sa[pair], sa[pair - 1]]))


def windows_to_spans(places: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Ascending window starts to maximal covered runs."""
    if not len(places):
        return []
    cut = np.flatnonzero(np.diff(places) > length) + 1
    a = places[np.concatenate([[0], cut])]
    b = places[np.concatenate([cut - 1, [len(places) - 1]])] + length
    return list(zip(a.tolist(), b.tolist(), strict=True))


def _row_key(i, t: bytes) -> int:
    """Names a row by its id and text, so that null and repeated ids do no harm."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(t, seed=xxhash.xxh3_64_intdigest(repr(i)) & 0xFFFFFFFF)).view(np.int64)))


def _blocks(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(k, a, n, least, s, u, twice): blocks of rows (id, t); s, u are a 128-bit hash of the block's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in pieces(batch, 1, PIECE):
                body, at, _ = flat(rows.column(1))
                row, a, n, least, twice = blocks(body, at, length, gram)
                raw = body.tobytes()
                used = np.unique(row)
                ids = rows.column(0)
                keys = dict(zip(used.tolist(), (_row_key(ids[int(r)].as_py(), raw[at[r] : at[r + 1]]) for r in used), strict=True))
                digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(raw[x : x + y]) for x, y in zip(a.tolist(), n.tolist(), strict=True)), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([keys[r] for r in row.tolist()], pa.int64()), pa.array((a - at[row]).astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(least.view(np.int64)), pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy()), pa.array(twice)],
                    names=["k", "a", "n", "least", "s", "u", "twice"],
                )

    return docs.mapInArrow(run, "k bigint, a bigint, n bigint, least bigint, s bigint, u bigint, twice boolean")


def _texts(docs: DataFrame, places: DataFrame, wide: bool, length: int) -> DataFrame:
    """Text of blocks at places (k, a, n, least, c). wide: instead, two hashes of each of their windows."""
    per = places.groupBy("k").agg(F.collect_list(F.struct("a", "n", "least", "c")).alias("at"))  # no more than its document's length allows

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch, 1, PIECE):
                out: list[list] = [[], [], [], [], []]
                for k, t, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    t = t.encode()
                    for p in at:
                        part = t[p["a"] : p["a"] + p["n"]]
                        if wide:
                            body = np.frombuffer(part, np.uint8)
                            g = gram_hashes(body, length)
                            other = gram_hashes(body[::-1], length)[::-1]
                            row = (np.full(len(g), k), p["a"] + np.arange(len(g)), g.view(np.int64), other.view(np.int64), np.full(len(g), min(p["c"], 2)))
                        else:
                            row = ([k], [p["a"]], [p["least"]], [part], [p["c"]])
                        for to, v in zip(out, row, strict=True):
                            to.extend(v)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary() if x and isinstance(x[0], bytes) else pa.int64()) for x in out], names=names)

    names = ["k", "a", "g", "o", "c"] if wide else ["k", "a", "least", "part", "c"]
    named = docs.mapInArrow(_named, "k bigint, t string")
    keys = broadcast_if_small(materialize(per.select("k")))
    joined = named.join(keys, "k", "left_semi").dropDuplicates(["k"]).join(per, "k")
    return joined.select("k", "t", "at").mapInArrow(cut, "k bigint, a bigint, g bigint, o bigint, c bigint" if wide else "k bigint, a bigint, least bigint, part binary, c bigint")


def _extended(texts: DataFrame, parts: int, length: int) -> DataFrame:
    """Spans (k, a, b) that the transform finds in blocks which occur once; texts of one least hash meet in one task."""

    def settle(rows: list[tuple]) -> Iterator[tuple[int, int, int]]:
        text = np.frombuffer(b"".join(r[3] + b"\xff" for r in rows), np.uint8)
        size = np.array([len(r[3]) + 1 for r in rows])
        begin = np.cumsum(size) - size
        found = repeated(text, length)
        of = np.searchsorted(begin, found, "right") - 1
        inside = found + length < begin[of] + size[of]
        found, of = found[inside], of[inside]
        edge = np.searchsorted(of, np.arange(len(rows) + 1))
        for i, (k, a, _, _, c) in enumerate(rows):
            if c == 1:
                for x, y in windows_to_spans(found[edge[i] : edge[i + 1]] - begin[i], length):
                    yield k, a + x, a + y

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[2] != last and size >= min(BATCH, TEXT):
                    yield table(settle(held))
                    held, size = [], 0
                last = row[2]
                held.append(row)
                size += len(row[3]) + 1
        if held:
            yield table(settle(held))

    def table(spans: Iterator[tuple[int, int, int]]) -> pa.RecordBatch:
        cols = list(zip(*spans, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["k", "a", "b"])

    return texts.repartition(parts, "least").sortWithinPartitions("least").mapInArrow(run, "k bigint, a bigint, b bigint")


def _word_blocks(docs: DataFrame, words: int, gram: int) -> DataFrame:
    """(k, a, n, least, s): runs of n words from word a on, of rows (id, t), whose windows of `words` words have one least gram hash; s is a hash of the run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in pieces(batch, 1, PIECE):
                hashed, edge = word_hashes(rows.column(1))
                row, a, n, least, _ = blocks(hashed, edge, words, gram)
                if len(row):
                    used = np.unique(row)
                    keys = np.zeros(rows.num_rows, np.int64)
                    keys[used] = [_row_key(rows.column(0)[int(r)].as_py(), rows.column(1)[int(r)].as_py().encode()) for r in used]
                    sums, down = _sums(hashed)
                    with np.errstate(over="ignore"):
                        s = mix((sums[a + n] - sums[a]) * down[a] + n.astype(np.uint64))
                    yield pa.RecordBatch.from_arrays([pa.array(keys[row]), pa.array((a - edge[row]).astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(least.view(np.int64)), pa.array(s.view(np.int64))], names=["k", "a", "n", "least", "s"])

    return docs.mapInArrow(run, "k bigint, a bigint, n bigint, least bigint, s bigint")


def _word_windows(docs: DataFrame, places: DataFrame, words: int) -> DataFrame:
    """(k, a, w, many): a 128-bit hash of each window of `words` words of the runs at places (k, a, n, many) of rows (id, t)."""
    per = materialize(places.groupBy("k").agg(F.collect_list(F.struct("a", "n", "many")).alias("at")))  # no more than its document's length allows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch, 1, PIECE):
                hashed, edge = word_hashes(b.column(1))
                ks, starts, many = [], [], []
                for i, (k, at) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)):
                    for p in at:
                        m = p["n"] - words + 1
                        starts.append(edge[i] + p["a"] + np.arange(m))
                        ks.append(np.full(m, k))
                        many.append(np.full(m, p["many"]))
                if starts:
                    at = np.concatenate(starts)
                    first = edge[np.searchsorted(edge, at, "right") - 1]
                    two = np.stack([gram_hashes(hashed, words)[at], gram_hashes(hashed[::-1], words)[::-1][at]], 1)
                    w = pa.Array.from_buffers(pa.binary(16), len(at), [None, pa.py_buffer(two.tobytes())]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ks)), pa.array((at - first).astype(np.int64)), w, pa.array(np.concatenate(many))], names=["k", "a", "w", "many"])

    return docs.mapInArrow(_named, "k bigint, t string").join(_light(per), "k").select("k", "t", "at").mapInArrow(run, "k bigint, a bigint, w binary, many boolean")


def _light(per: DataFrame) -> DataFrame:
    """per (k, at: an array), to be broadcast if it has few rows and entries: 20 MB at most."""
    size = per.select(F.count("*").alias("rows"), F.coalesce(F.sum(F.greatest(F.size("at"), F.lit(0))), F.lit(0)).alias("entries")).first()
    return F.broadcast(per) if size["rows"] <= 200_000 and size["entries"] <= 1_000_000 else per


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        k = [_row_key(i, t.encode()) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), b.column(1)], names=["k", "t"])


def _passages(rows: DataFrame, words: int, gram: int) -> DataFrame:
    """(k, n_passage_words) of rows (id, t) with words in a passage of `words` words that a row of another name has too.

    Runs that a row of another name has whole are settled by counting. The others that share their least hash with a row of
    another name are cut into windows, and so is one of each kind that is settled.
    """
    found = materialize(_word_blocks(rows, words, gram))
    per = found.groupBy("least").agg(F.count("*").alias("_n"), F.min("k").alias("lo"), F.max("k").alias("hi"), (F.min("s") != F.max("s")).alias("_mixed"))
    shared = materialize(per.where("lo <> hi").select("least", "_n", "_mixed"))
    open_ = materialize(attach(found, shared, "least", ["_mixed"], "k", "_n").where("_mixed IS NOT NULL"))
    kinds = open_.where("_mixed").groupBy("least", "s").agg(F.count("*").alias("_n"), F.min(F.struct("k", "a", "n")).alias("at"), (F.min("k") != F.max("k")).alias("many"))
    kinds = materialize(kinds.where("many").select(F.xxhash64("least", "s").alias("kind"), "_n", "at.*", "many").dropDuplicates(["kind"]))
    known = attach(open_.withColumn("kind", F.when(F.col("_mixed"), F.xxhash64("least", "s"))), kinds, "kind", ["many"], "k", "_n")
    known = materialize(known.select("k", "a", "n", (F.coalesce("many", F.lit(False)) | ~F.col("_mixed")).alias("many")))
    whole = known.where("many").select("k", "a", (F.col("a") + F.col("n")).alias("b"))
    windows = materialize(_word_windows(rows, known.where("NOT many").union(kinds.select("k", "a", "n", "many")), words))
    again = windows.groupBy("w").agg(F.count("*").alias("_n"), F.min("k").alias("lo"), F.max("k").alias("hi"), F.bool_or("many").alias("_any"))
    again = materialize(again.where("lo <> hi OR _any").select("w", "_n", F.lit(True).alias("_again")))
    part = attach(windows.where("NOT many"), again, "w", ["_again"], "k", "_n").where("_again").select("k", "a", (F.col("a") + words).alias("b"))
    spans = F.array_sort(F.collect_set(F.struct("a", "b")))  # no more than its document's length allows
    none = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("b"))
    covered = F.aggregate(
        "at", none, lambda x, s: F.struct((x["n"] + F.greatest(s["b"] - F.greatest(x["b"], s["a"]), F.lit(0))).alias("n"), F.greatest(x["b"], s["b"]).alias("b")), lambda x: x["n"]
    )
    out = materialize(whole.union(part).groupBy("k").agg(spans.alias("at")).select("k", covered.alias("n_passage_words")))
    discard(found, shared, open_, kinds, known, windows, again)
    return out


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, keep_text: bool = False, passage: int = 0) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256, and with keep_text also spans and kept.

    With a passage of so many words, also n_passage_words: the words (A-Z as a-z, parted by ASCII white space) in runs of
    `passage` words that a row of another id or text has too; nothing is removed for that.
    Bytes are those of the UTF-8 text. A byte goes if it lies in a string of `length` bytes that starts
    at another place of the input too, of the same text or another; overlaps count. Null counts as empty; texts
    shorter than length lose nothing. Repeated rows are texts of their own, so their long strings go
    from all of them. Ids may be null or repeat. kept is binary (a cut may part a character's bytes). No rows give none; extra columns are ignored.
    """
    if not 8 < gram < length or length <= SEED:
        raise ValueError("gram must be over 8 and below length")
    rows = small_batches(docs).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    found = materialize(_blocks(rows, length, gram))
    kinds = materialize(
        found.groupBy("least", "s", "u").agg(F.count("*").alias("c"), F.min(F.struct("k", "a", "n", "twice")).alias("at")).select("least", "s", "u", "c", "at.*")
    )
    per = kinds.groupBy("least").agg(F.count("*").alias("v"), F.count_if((F.col("c") == 1)).alias("once"), F.sum("n").alias("bytes"), F.bool_or("twice").alias("twice"))
    per = per.where("once > 0 AND (v > 1 OR twice)").withColumn("wide", F.col("bytes") > TEXT)
    open_ = materialize(kinds.select("least", "c", "k", "a", "n").join(per.select("least", "wide"), "least"))
    spans = []

    whole_kinds = materialize(kinds.where("c > 1").groupBy("s").agg(F.sum("c").alias("n"), F.collect_set("u").alias("us")))
    whole = attach(found, whole_kinds, "s", ["us"], "k", "n")
    spans.append(whole.where(F.array_contains("us", F.col("u"))).select("k", "a", (F.col("a") + F.col("n")).alias("b")))

    total = open_.groupBy("wide").agg(F.sum("n").alias("n")).collect()
    sums = {r["wide"]: r["n"] for r in total}
    least_parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if sums.get(False):
        texts = _texts(rows, open_.where("NOT wide"), False, length)
        spans.append(_extended(texts, max(least_parts, sums[False] // (4 * TEXT)), length))
    if sums.get(True):
        windows = materialize(_texts(rows, open_.where("wide"), True, length))
        again = windows.groupBy("g", "o").agg(F.sum("c").alias("m")).where("m > 1").select("g", "o")
        spans.append(windows.where("c = 1").join(again, ["g", "o"], "left_semi").select("k", "a", (F.col("a") + length).alias("b")))
    out = spans[0]
    for s in spans[1:]:
        out = out.union(s)
    gone = materialize(out.distinct().groupBy("k").agg(F.collect_list(F.struct("a", "b")).alias("gone")))  # no more than its text's length allows
    discard(found, kinds, whole_kinds, open_, *([windows] if sums.get(True) else []))
    if passage:
        gone = materialize(gone.join(_passages(rows, passage, WORD_GRAM), "k", "full"))
    return _cut(rows, gone, id_col, keep_text, passage > 0)


def _cut(rows: DataFrame, gone: DataFrame, id_col: str, keep_text: bool, passage: bool) -> DataFrame:
    id_type = rows.schema["id"].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", spans array<struct<a:bigint,b:bigint>>, kept binary" if keep_text else "") + (", n_passage_words bigint" if passage else "")

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = [_row_key(i, t.encode()) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(k, pa.int64())], names=["id", "t", "k"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch, 1, 8 << 20):
                out: list[list] = [[], [], [], [], [], []]
                for t, at in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    t = t.encode()
                    merged: list[list[int]] = []
                    for p in sorted(at or [], key=lambda p: (p["a"], p["b"])):
                        if merged and p["a"] <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], p["b"])
                        else:
                            merged.append([p["a"], p["b"]])
                    ends = [0, *(y for _, y in merged)]
                    kept = b"".join(t[x:y] for x, y in zip(ends, [*(x for x, _ in merged), len(t)], strict=True)) if merged else t
                    row = (len(t), len(t) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), [{"a": x, "b": y} for x, y in merged], kept)
                    for to, v in zip(out, row, strict=True):
                        to.append(v)
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])), pa.binary()]
                names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"]
                n = 6 if keep_text else 4
                more = {"n_passage_words": b.column(3).fill_null(0)} if passage else {}
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(v, t) for v, t in zip(out[:n], types, strict=False)), *more.values()], names=[id_col, *names[:n], *more])

    named = rows.mapInArrow(name, f"id {id_type}, t string, k bigint")
    few = gone.select(F.count("*").alias("rows"), F.coalesce(F.sum(F.greatest(F.size("gone"), F.lit(0))), F.lit(0)).alias("spans")).first()
    gone = F.broadcast(gone) if few["rows"] <= 200_000 and few["spans"] <= 1_000_000 else gone  # 20 MB at most
    return named.join(gone, "k", "left").select("id", "t", "gone", *(["n_passage_words"] if passage else [])).mapInArrow(run, schema)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The removal of 400-byte strings; n_passage_words beside it, since passages of 50 words are often shorter than 400 bytes."""
    return dedup_substrings(read(spark, sf_dir, "documents"), passage=PASSAGE)
