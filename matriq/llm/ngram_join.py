"""N-gram Jaccard join as a blocked sparse matrix product.

Rows are distinct shingle sets, columns are shingles. In a global order of columns (frequent ones last,
else by hash) two sets that link share l columns among their first n - ceil(T n / 100) + l, so only those
entries of the incidence matrix are multiplied, and only of sets that share as many columns with sets of
fitting sizes. Blocks of columns are multiplied in separate tasks, overlap counts of a pair add up, and pairs
below the l of their sizes are discarded. The others are compared in full.

No group is expanded into all its pairs. Sets that agree in a band of least hashes form families first; a family's
product is taken block by block of rows, within tasks that give out a forest of its links alone, and the product by
columns then runs between different families, so families decide where a pair is compared, never whether.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matriq.llm.common import attach, broadcast_if_small, materialize, read, small_batches
from matriq.llm.components import connected_components
from matriq.llm.features import mix, pieces, word_hashes

PIECE = 1 << 18
#: A column is frequent if at least 1/FREQUENT of the documents have it near the front of their set.
FREQUENT = 1000
CHUNK = 500_000
#: Rows of a column that one block holds; longer columns are multiplied block by block.
BLOCK = 2000
#: And members of their sets: 32 MB.
BLOCK_MEMBERS = 4_000_000
#: Columns of one dense product.
DENSE = 2048
SALTS = 64
#: Names of sets that a task remembers, so as not to repeat the entries of copies.
REMEMBERED = 200_000
#: Sets in one band's agreement are of one family: likely from a similarity of 0.7, rare below 0.4.
BANDS, BAND_ROWS = 16, 3
HOT = np.uint64(1 << 63)
_M = np.uint64(0x9E3779B97F4A7C15 | 1)
_FACTORS = mix(np.arange(1, BANDS * BAND_ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its k-word shingles; of fewer words, of the whole sequence."""
    words, edge = word_hashes(column)
    n, total = len(edge) - 1, len(words)
    with np.errstate(over="ignore"):
        hashed = words.copy()
        for j in range(1, k):
            m = max(total - j, 0)
            hashed[:m] = mix(hashed[:m] * _M + words[j : j + m])
        hashed[:] = mix(hashed)
    out = []
    for i in range(n):
        a, b = edge[i], edge[i + 1]
        if b - a >= k:
            out.append(np.unique(hashed[a : b - k + 1]))
        elif b > a:
            h = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for w in words[a:b]:
                    h = mix(np.array([h * _M + w], np.uint64))[0]
            out.append(np.array([h], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_key(s: np.ndarray) -> int:
    """The name of a set: a hash of its members as a signed 64-bit integer."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) * _M + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def share(n, percent: int):
    """How many columns of their fronts two sets have in common at least, if the smaller has n members and they link.

    Never more than the least overlap that they link with, which is the whole set's at low percents.
    """
    return np.maximum(1, np.minimum(n * (100 - percent) // 200, -(-percent * n // 100)))


def front(n: int, percent: int) -> int:
    """The number of first columns of which sets that link have share() in common: any whole overlap leaves out the rest only."""
    return min(n, n - -(-percent * n // 100) + int(share(n, percent)))


def needed(a, b, percent: int):
    """The least overlap with which sets of sizes a and b link."""
    return -(-percent * (a + b) // (100 + percent))


def bands(s: np.ndarray) -> np.ndarray:
    """A hash for each band of a set's least hashes under BANDS * BAND_ROWS multiplications."""
    low = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(s), 4096):
            low = np.minimum(low, mix(s[at : at + 4096, None] * _FACTORS[None]).min(0))
        h = np.arange(BANDS, dtype=np.uint64)
        for column in low.reshape(BANDS, BAND_ROWS).T:
            h = mix(h * _M + column)
    return h


def _scan(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """Rows of three kinds: 0, a document (id, n, s); 1, a column that comes up often in a task (h, c); 2, a band of a set (h, s)."""
    id_type = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, met, kind = [], 0, set(), None

        def table(what: int, rows_: int, **given: np.ndarray | pa.Array) -> pa.RecordBatch:
            cols = [given.get("id", pa.nulls(rows_, kind)), *(pa.array(given[c]) if c in given else pa.nulls(rows_, pa.int64()) for c in ("n", "s", "h", "c"))]
            return pa.RecordBatch.from_arrays([*cols, pa.array(np.full(rows_, what, np.int32))], names=["id", "n", "s", "h", "c", "kind"])

        def often() -> pa.RecordBatch:
            h, c = np.unique(np.concatenate(held), return_counts=True)
            h, c = h[c >= 2], c[c >= 2]
            return table(1, len(h), h=h.view(np.int64), c=c.astype(np.int64))

        for batch in batches:
            kind = batch.column(0).type
            for rows in pieces(batch, 1, PIECE):
                sets = shingle_sets(rows.column(1), k)
                key = np.array([set_key(s) for s in sets], np.int64)
                yield table(0, len(sets), id=rows.column(0), n=np.array([len(s) for s in sets], np.int64), s=key)
                fresh = [(s, x) for s, x in zip(sets, key.tolist(), strict=True) if len(s) and not (x in met or met.add(x))]
                if len(met) > REMEMBERED:
                    met.clear()
                if fresh:
                    yield table(2, BANDS * len(fresh), h=np.concatenate([bands(s) for s, _ in fresh]).view(np.int64), s=np.repeat(np.array([x for _, x in fresh], np.int64), BANDS))
                more = [s[: 2 * front(len(s), percent)] >> np.uint64(1) for s in sets if len(s)]
                held += more
                size += sum(map(len, more))
                if size >= CHUNK:
                    yield often()
                    held, size = [], 0
        if held:
            yield often()

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string")).mapInArrow(
        run, f"id {id_type.simpleString()}, n bigint, s bigint, h bigint, c bigint, kind int"
    )


def _entries(docs: DataFrame, text_col: str, hot: np.ndarray, k: int, percent: int) -> DataFrame:
    """(h, s, n): the front entries of each document's row. h has its top bit set for frequent columns."""
    sent = docs.sparkSession.sparkContext.broadcast(np.sort(hot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, met = sent.value, set()
        for batch in batches:
            for rows in pieces(batch, 0, PIECE):
                out: list[list[np.ndarray]] = [[], [], []]
                for s in shingle_sets(rows.column(0), k):
                    key = set_key(s)
                    if len(s) and key not in met:
                        if len(met) >= REMEMBERED:
                            met.clear()
                        met.add(key)
                        h = ordered(s, frequent)[: front(len(s), percent)]
                        for to, v in zip(out, (h.view(np.int64), key, len(s)), strict=True):
                            to.append(np.broadcast_to(np.asarray(v, np.int64), len(h)))
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["h", "s", "n"])

    return docs.select(F.col(text_col).cast("string")).mapInArrow(run, "h bigint, s bigint, n bigint")


def ordered(s: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """A set's columns in global order: 63 bits of hash, below those of frequent columns, whose top bit is set."""
    h = s >> np.uint64(1)
    if len(frequent):
        i = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
        h = np.where(frequent[i] == h, h | HOT, h)
    return np.unique(h)


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """Runs of rows with equal first columns, from batches that are sorted by them."""
    rest: list[np.ndarray] | None = None
    for batch in batches:
        cols = [np.asarray(c) for c in batch.columns]
        if rest is not None:
            cols = [np.concatenate([a, b]) for a, b in zip(rest, cols, strict=True)]
        change = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols[:keys]])) + 1
        edges = [0, *change.tolist()]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b - a > 1:
                yield [c[a:b] for c in cols]
        rest = [c[edges[-1] :] for c in cols]
    if rest is not None and len(rest[0]) > 1:
        yield rest


PAIR = "a bigint, b bigint, n bigint, c bigint"


def _pairs(n, s, i, j, percent: int) -> tuple[np.ndarray, ...]:
    """Of index pairs i, j with n[i] <= n[j]: those whose sizes let them link, the smaller name first."""
    ok = (n[j] * percent <= n[i] * 100) & (s[i] != s[j])
    i, j = i[ok], j[ok]
    return np.minimum(s[i], s[j]), np.maximum(s[i], s[j]), n[i], np.ones(len(i), np.int64)


def _gather(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """One row for each pair, with its count, of what a task has at hand."""
    cols = [np.concatenate(x) for x in zip(*parts, strict=True)]
    order = np.lexsort((cols[1], cols[0]))
    cols = [c[order] for c in cols]
    new = np.concatenate([[True], (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])]) if len(order) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    count = np.add.reduceat(cols[3], at) if len(at) else cols[3]
    return pa.RecordBatch.from_arrays([*(pa.array(c[at]) for c in cols[:3]), pa.array(count)], names=["a", "b", "n", "c"])


def _apart(entries: DataFrame) -> DataFrame:
    """Entries dealt by column and sorted by column, size and name; a frequent column is dealt to SALTS tasks.

    All of a frequent column's entries go on, so its parts need not meet here.
    """
    parts = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salt = F.when(F.col("h") < 0, F.pmod(F.xxhash64("s"), F.lit(SALTS))).otherwise(F.lit(0))
    return entries.withColumn("_salt", salt).repartition(parts, "h", "_salt").drop("_salt").sortWithinPartitions("h", "n", "s").select("h", "n", "s")


def _shared(entries: DataFrame, percent: int) -> DataFrame:
    """Entries, once for each set, that share their column with a set of a size to link with, and all of frequent columns.

    In order of size the sizes nearest to a set's are those beside it. One row is held at a time.
    """
    names = ["h", "n", "s"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, met = None, False
        for batch in batches:
            cols = _deduped(last, batch)
            h, n, _ = cols
            if not len(h):
                continue
            same = (h[1:] == h[:-1]) & (n[1:] * percent <= n[:-1] * 100)
            keep = np.concatenate([[met], same])[:-1] | same | (h[:-1] < 0)
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(c[:-1][keep]) for c in cols], names=names)
            met = bool(same[-1]) if len(same) else met
            last = [c[-1:] for c in cols]
        if last is not None and (met or last[0][0] < 0):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in last], names=names)

    return _apart(entries).mapInArrow(run, "h bigint, n bigint, s bigint")


def _able(entries: DataFrame, percent: int) -> DataFrame:
    """Entries of sets that share as many columns with any as the smallest that they may link with asks for."""
    able = entries.groupBy("s").agg(F.count("*").alias("c"), F.min("n").alias("n"))
    able = able.where(F.col("c") >= _share(F.ceil(F.col("n") * percent / 100), percent)).select("s")
    return materialize(entries.join(broadcast_if_small(materialize(able)), "s", "left_semi").select("h", "n", "s"))


def _deduped(last: list[np.ndarray] | None, batch: pa.RecordBatch) -> list[np.ndarray]:
    """The batch after the row before it, without rows that repeat the column and set of the one before."""
    cols = [np.asarray(c) for c in batch.columns]
    if last is not None:
        cols = [np.concatenate([a, b]) for a, b in zip(last, cols, strict=True)]
    one = np.concatenate([np.ones(min(1, len(cols[0])), bool), (cols[0][1:] != cols[0][:-1]) | (cols[2][1:] != cols[2][:-1])])
    return [c[one] for c in cols]


def _families(banded: DataFrame) -> DataFrame:
    """(s, k): sets of families of two or more, which a chain of shared bands (h, s) connects."""
    low = banded.groupBy("h").agg(F.min("s").alias("low"), F.max("s").alias("high")).where("low <> high").select("h", "low")
    star = attach(banded, materialize(low), "h", ["low"], "s").where("low IS NOT NULL AND low <> s")
    near = materialize(star.select(F.col("s").alias("a"), F.col("low").alias("b")).distinct())
    return materialize(connected_components(near).select(F.col("node").alias("s"), F.col("component").alias("k")))


def forest(sets: list[np.ndarray], of: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links of rows, enough to connect what links connect. of: 0 or 1; if both occur, only pairs across them count.

    Overlaps are the product of the incidence matrix with its transpose: columns of many rows as dense blocks, columns of
    few by their pairs of rows.
    """
    r = len(sets)
    size = np.array([len(x) for x in sets])
    row = np.repeat(np.arange(r), size)
    order = np.argsort(np.concatenate(sets), kind="stable")
    column, row = np.concatenate(sets)[order], row[order]
    start = np.flatnonzero(np.concatenate([[True], column[1:] != column[:-1]]))
    m = np.diff(np.concatenate([start, [len(column)]]))
    overlap = np.zeros((r, r), np.float32)
    dense = np.flatnonzero(m >= max(8, r // 32))
    for at in range(0, len(dense), DENSE):
        part = dense[at : at + DENSE]
        x = np.zeros((r, len(part)), np.float32)
        for c, g in enumerate(part):
            x[row[start[g] : start[g] + m[g]], c] = 1
        overlap += x @ x.T
    for k in np.unique(m[(m > 1) & (m < max(8, r // 32))]):
        g = start[m == k]
        members = row[g[:, None] + np.arange(k)]
        i, j = np.triu_indices(k, 1)
        for a, b in zip(i, j, strict=True):
            np.add.at(overlap, (members[:, a], members[:, b]), 1)
            np.add.at(overlap, (members[:, b], members[:, a]), 1)
    links = overlap >= needed(size[:, None], size[None], percent)
    if of.any() and not of.all():
        links &= of[:, None] != of[None]
    np.fill_diagonal(links, False)
    seen, out = np.zeros(r, bool), []
    for i in range(r):
        if not seen[i]:
            seen[i] = True
            todo = [i]
            while todo:
                x = todo.pop()
                for j in np.flatnonzero(links[x] & ~seen):
                    seen[j] = True
                    out.append((x, int(j)))
                    todo.append(j)
    return out


def _family_links(docs: DataFrame, families: DataFrame, names: DataFrame, sizes: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """A forest (a, b) of the links within families, whose rows are cut into blocks that meet in pairs."""
    f = families.join(sizes, "s")
    per = f.groupBy("k").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_MEMBERS)).cast("int").alias("nb"))
    f = f.join(broadcast_if_small(materialize(per)), "k").select("s", "k", "nb")
    f = materialize(f.join(names, "s"))
    sets = _members(docs, f.select("id"), id_col, text_col, k).join(broadcast_if_small(f.select("s", F.col("k").alias("fam"), "nb")), "s")
    blk = F.pmod(F.xxhash64("s"), F.col("nb")).cast("int")
    cells = sets.withColumn("blk", blk).withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    cells = cells.select("fam", F.least("blk", "_j").alias("i"), F.greatest("blk", "_j").alias("j"), "blk", "s", "m")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None
        for batch in batches:
            for fam, i, j, blk, s, m in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (fam, i, j) != key:
                    yield from settle(held, key)
                    held, key = [], (fam, i, j)
                held.append((blk, s, m))
        yield from settle(held, key)

    def settle(held: list[tuple], key: tuple | None) -> Iterator[pa.RecordBatch]:
        held = list({s: (b, s, m) for b, s, m in held}.values())
        if len(held) > 1:
            of = np.array([b == key[2] for b, _, _ in held]) if key[1] != key[2] else np.zeros(len(held), bool)
            links = forest([np.frombuffer(m, np.uint64) for _, _, m in held], of, percent)
            yield pa.RecordBatch.from_arrays([pa.array([held[x[k]][1] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(cells.repartition(parts, "fam", "i", "j").sortWithinPartitions("fam", "i", "j").mapInArrow(run, "a bigint, b bigint"))


def _members(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(s, m): the sets, as bytes, of the documents with these ids."""
    ids = broadcast_if_small(materialize(ids.select(F.col("id").alias("_wanted")).distinct()))
    texts = docs.join(ids, docs[id_col] == ids["_wanted"], "left_semi").select(F.col(text_col).cast("string").alias("t"))

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in pieces(batch, 0, PIECE):
                sets = shingle_sets(rows.column(0), k)
                yield pa.RecordBatch.from_arrays([pa.array([set_key(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["s", "m"])

    return texts.mapInArrow(members, "s bigint, m binary")


def _product(entries: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components within each block; entries (h, i, j, n, s, k, blk) are sorted so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for _, bi, bj, n, s, comp, blk in _runs(batches, 3):
            one = np.concatenate([[True], s[1:] != s[:-1]])
            n, s, comp, blk = (x[one] for x in (n, s, comp, blk))
            across = bi[0] != bj[0]
            upto = np.searchsorted(n, n * 100 // percent, "right")
            for x in range(len(s) - 1):
                j = np.arange(x + 1, upto[x])
                j = j[(comp[j] != comp[x]) & ((blk[j] != blk[x]) if across else True)]
                if len(j):
                    parts.append(_pairs(n, s, np.full(len(j), x), j, percent))
                    size += len(j)
                    if size > 500_000:
                        yield _gather(parts)
                        parts, size = [], 0
        if parts:
            yield _gather(parts)

    return entries.select("h", "i", "j", "n", "s", "k", "blk").mapInArrow(run, PAIR)


def _share(n: Column, percent: int) -> Column:
    """share() of a column."""
    return F.greatest(F.lit(1), F.least(F.floor(n * (100 - percent) / 200), F.ceil(n * percent / 100))).cast("bigint")


def _enough(pairs: DataFrame, percent: int) -> DataFrame:
    """Counts of a pair added up; pairs (a, b) whose fronts have as much in common as the smaller size asks for."""
    pairs = pairs.groupBy("a", "b").agg(F.min("n").alias("n"), F.sum("c").alias("c"))
    return pairs.where(F.col("c") >= _share(F.col("n"), percent)).select("a", "b")


def _verified(pairs: DataFrame, docs: DataFrame, names: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of set names whose whole sets link. names: (s, id) of one document for each set."""
    pairs = materialize(pairs.select("a", "b"))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("s")).distinct()
    sets = materialize(_members(docs, names.join(wanted, "s", "left_semi"), id_col, text_col, k))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                ok.append(int((large[at] == small).sum()) >= needed(len(x), len(y), percent))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    both = pairs.join(sets.select(F.col("s").alias("a"), F.col("m").alias("ma")), "a").join(sets.select(F.col("s").alias("b"), F.col("m").alias("mb")), "b")
    return materialize(both.select("a", "b", "ma", "mb").mapInArrow(compare, "a bigint, b bigint"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (the smallest id that links reach, its own included).

    A document is the set of its k-word shingles (A-Z lower-cased, words parted by ASCII white space);
    with fewer words the whole sequence is one shingle; without words it is empty and links with nothing. Two link
    when 100 * |intersection| >= percent * |union|. Sets are compared by 64-bit hashes of shingles.
    Equal sets link, so copies and repeated rows share a component; repeated ids each keep their row.
    Null ids keep their row, and get the smallest other id of their component, or null. No rows give none;
    extra columns are ignored.
    """
    if k < 1 or not 0 < percent <= 100:
        raise ValueError("k must be 1 or more and percent from 1 to 100")
    docs = small_batches(docs)
    seen = materialize(_scan(docs, id_col, text_col, k, percent))
    rows = seen.where("kind = 0").select("id", "n", "s")
    total = rows.count()
    # At most 2 * front / n * FREQUENT columns of an average set: a number that does not grow with the input.
    hot = seen.where("kind = 1").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") * FREQUENT >= max(total, 20 * FREQUENT)).select("h").toPandas()["h"].to_numpy(np.int64)
    entries = _able(materialize(_shared(_entries(docs, text_col, hot.view(np.uint64), k, percent), percent)), percent)
    # Without the sets that went, columns of others may be left alone.
    entries = _able(materialize(_shared(entries, percent)), percent)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_set = materialize(rows.where("n > 0").groupBy("s").agg(F.min("id").alias("id"), F.count("*").alias("size")))
    names = by_set.select("s", "id")

    first = _families(seen.where("kind = 2").select("h", "s"))
    sizes = rows.where("n > 0").select("s", "n").distinct()
    inner = _family_links(docs, first, names, sizes, id_col, text_col, k, percent)

    known = entries.join(first.withColumnRenamed("k", "_k"), "s", "left").withColumn("k", F.coalesce("_k", "s")).drop("_k")
    known = materialize(known)
    wide = known.groupBy("h").agg(F.count("*").alias("m"), F.min("k").alias("lo"), F.max("k").alias("hi")).where("lo <> hi")
    wide = wide.select("h", F.ceil(F.col("m") / BLOCK).cast("int").alias("nb"))
    cells = known.join(broadcast_if_small(materialize(wide)), "h").withColumn("blk", F.pmod(F.xxhash64("s"), F.col("nb")))
    cells = cells.withColumn("_j", F.explode(F.sequence(F.lit(0).cast("bigint"), (F.col("nb") - 1).cast("bigint"))))
    cells = cells.select("h", F.least("blk", "_j").alias("i"), F.greatest("blk", "_j").alias("j"), "n", "s", "k", "blk")
    cells = cells.repartition(parts, "h", "i", "j").sortWithinPartitions("h", "i", "j", "n", "s")
    more = _verified(_enough(_product(cells, percent), percent), docs, names, id_col, text_col, k, percent)

    node = materialize(connected_components(inner.union(more)))
    sets = by_set.join(node.select(F.col("node").alias("s"), F.col("component").alias("k")), "s", "left").withColumn("k", F.coalesce("k", "s"))
    low = sets.groupBy("k").agg(F.min("id").alias("component_id"), F.sum("size").alias("members")).where("members > 1")
    values = materialize(sets.select("s", "k").join(low, "k").select("s", "component_id"))
    out = attach(rows.withColumn("s", F.when(F.col("n") > 0, F.col("s"))), values, "s", ["component_id"], "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"), k=3, percent=90)
