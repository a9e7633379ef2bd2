"""Ranked lexical search by MaxScore over shards of an inverted index.

A shard is a run of documents of a task: for each query term the places of the documents that hold it, with its counts.
For a query, a list's bound is its weight by the most that any of its postings can add. Lists in order of their bounds are
non-essential as long as the bounds' sum stays below the score that a document must reach; documents come from the others
alone, and the non-essential lists are probed, largest bound first, for documents that can still reach it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matriq.llm.common import ASCII_LOWER, ASCII_UPPER, discard, materialize, read, small_batches

#: Text and documents of a shard at most; a longer text is a shard of its own.
SHARD_BYTES, SHARD_DOCS = 16 << 20, 20_000
#: Long texts are cut into terms by so many bytes.
CHUNK = 1 << 20
#: Rows (query, term) of a block of queries, all of which a task holds.
BLOCK_ROWS = 200_000
#: One shard in so many is searched first, for scores that results must reach.
FIRST_SHARDS = 16
#: Parts that a query's candidates are ranked in before they meet.
SALTS = 64

TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
PAST = re.compile(rb"[^0-9a-z\x80-\xff]")
SHARD = (
    "n_docs bigint, n_terms bigint, doc_ids array<bigint>, sizes array<bigint>, terms array<string>, ends array<int>, docs array<int>, counts array<int>, least array<bigint>, most array<bigint>"
)


def terms_of(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text in turn, by chunks that end between terms. Only A-Z are lower-cased."""
    b, at = (text or "").encode().lower(), 0
    while at < len(b):
        cut = PAST.search(b, at + CHUNK)
        end = cut.start() if cut else len(b)
        yield TERM.findall(b, at, end)
        at = end


class Shard:
    """Postings of the words asked for, of the documents that are added."""

    def __init__(self, words: frozenset[bytes]):
        self.words, self.ids, self.sizes, self.bytes = words, [], [], 0
        self.lists: dict[bytes, tuple[list[int], list[int]]] = {}

    def add(self, doc_id: int | None, text: str | None) -> None:
        n, found = 0, Counter()
        for chunk in terms_of(text):
            n += len(chunk)
            found.update(filter(self.words.__contains__, chunk))
        self.bytes += len(text or "")
        if not n:
            return
        for word, count in found.items():
            docs, counts = self.lists.setdefault(word, ([], []))
            docs.append(len(self.ids))
            counts.append(count)
        self.ids.append(doc_id)
        self.sizes.append(n)

    def row(self) -> list:
        sizes, lists = np.array(self.sizes, np.int64), list(self.lists.values())
        return [
            len(self.ids),
            int(sizes.sum()),
            self.ids,
            self.sizes,
            [w.decode() for w in self.lists],
            np.cumsum([len(d) for d, _ in lists], dtype=np.int32),
            [x for d, _ in lists for x in d],
            [x for _, c in lists for x in c],
            [int(sizes[d].min()) for d, _ in lists],
            [max(c) for _, c in lists],
        ]


def index(docs: DataFrame, words: frozenset[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shards of docs, as rows of SHARD: documents with a term at all, and the postings of `words`.

    ends: where each term's postings end; least and most: its documents' least size and most occurrences. A shard lies
    within a task, so nothing is shuffled.
    """
    types = pa.schema(
        [("n_docs", pa.int64()), ("n_terms", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("terms", pa.list_(pa.string()))]
        + [(c, pa.list_(pa.int32())) for c in ("ends", "docs", "counts")]
        + [(c, pa.list_(pa.int64())) for c in ("least", "most")]
    )
    sent = docs.sparkSession.sparkContext.broadcast(words)  # of a block of queries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def written() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(shard.row(), types, strict=True)], schema=types)

        shard = Shard(sent.value)
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                shard.add(doc_id.as_py(), text.as_py())
                if shard.bytes >= SHARD_BYTES or len(shard.ids) >= SHARD_DOCS:
                    yield written()
                    shard = Shard(sent.value)
        if shard.ids:
            yield written()

    return small_batches(docs).select(F.col(id_col).cast("long"), text_col).mapInArrow(run, SHARD)


@dataclass
class Best:
    """The best documents of a query so far: scores falling, then ids rising, null ids last."""

    k: int
    floor: int
    scores: np.ndarray
    ids: np.ndarray
    null: np.ndarray

    def must(self) -> int:
        """The score that another document must reach at least."""
        return max(self.floor, int(self.scores[-1]) if len(self.scores) >= self.k else 1)

    def add(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        scores, ids, null = (np.concatenate(x) for x in ((self.scores, scores), (self.ids, ids), (self.null, null)))
        order = np.lexsort((ids, null, -scores))[: self.k]
        self.scores, self.ids, self.null = scores[order], ids[order], null[order]


def impact(count: np.ndarray, size: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What each occurrence count of a term adds to a document of so many terms, for a weight of 1."""
    m = 25 + 75 * size * n_docs // n_terms
    return 1_000_000_000 * count // (1000 * count + 8 * m)


def max_score(lists: list[tuple[int, np.ndarray, np.ndarray]], weights: np.ndarray, n: int, must: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the documents of a shard of n that reach `must`.

    lists: the bound of an occurrence, the places of documents and their impacts, for each term; weights: of the terms in the query.
    """
    bounds = np.array([b for b, _, _ in lists], np.int64) * weights
    order = np.argsort(bounds, kind="stable")
    below = np.cumsum(bounds[order])
    first = int(np.searchsorted(below, must))  # lists before it together stay below
    if first == len(order):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    score = np.zeros(n, np.int64)
    for i in order[first:]:
        _, docs, values = lists[i]
        score[docs] += weights[i] * values
    found = np.flatnonzero(score)
    total = score[found]
    for j in range(first - 1, -1, -1):
        can = total + below[j] >= must
        found, total = found[can], total[can]
        if not len(found):
            return found, total
        _, docs, values = lists[order[j]]
        at = np.minimum(np.searchsorted(docs, found), len(docs) - 1)
        total = total + np.where(docs[at] == found, weights[order[j]] * values[at], 0)
    good = total >= must
    return found[good], total[good]


def _search(shards: DataFrame, queries: list[tuple[int, list[tuple[str, int]], int]], n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(q, doc_id, score): at least the k best documents of each query, of those that reach its floor, from each task.

    queries: number, terms with weights (repeats multiplied in), floor. What a task has found raises what later shards must reach.
    """
    sent = shards.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        best = [Best(k, floor, none, none, np.zeros(0, bool)) for _, _, floor in sent.value]
        for batch in batches:
            for row in range(batch.num_rows):
                ids, sizes, terms, ends, docs, counts, least, most = (batch.column(c)[row].values for c in range(8))
                null = ids.is_null().to_numpy(zero_copy_only=False)
                ids = ids.fill_null(0).to_numpy()
                sizes, docs, counts, ends, least, most = (x.to_numpy().astype(np.int64) for x in (sizes, docs, counts, ends, least, most))
                start = ends - np.diff(ends, prepend=0)
                top = impact(most, least, n_docs, n_terms)
                values = impact(counts, sizes[docs], n_docs, n_terms)
                of = {t: (int(top[i]), docs[start[i] : ends[i]], values[start[i] : ends[i]]) for i, t in enumerate(terms.to_pylist())}
                for b, (_, wanted, _) in zip(best, sent.value, strict=True):
                    here = [(of[t], w) for t, w in wanted if w and t in of]
                    if here:
                        found, score = max_score([x for x, _ in here], np.array([w for _, w in here], np.int64), len(ids), b.must())
                        if len(found):
                            b.add(score, ids[found], null[found])
        for b, (q, _, _) in zip(best, sent.value, strict=True):
            if len(b.scores):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b.scores), q)), pa.array(b.ids, pa.int64(), mask=b.null), pa.array(b.scores)], names=["q", "doc_id", "score"])

    parts = shards.select("doc_ids", "sizes", "terms", "ends", "docs", "counts", "least", "most")
    return parts.mapInArrow(run, "q bigint, doc_id bigint, score bigint")


def top(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The k best rows of each `by`, with their rank: first in SALTS parts of them, then what these keep."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    salt = F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS))
    few = found.withColumn("_s", salt).withColumn("_r", F.row_number().over(Window.partitionBy(*by, "_s").orderBy(*order))).where(F.col("_r") <= k)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k).drop("_s", "_r")


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item, rank, doc_id, score): the k best documents of each item, by integer scores of term frequency, length and rarity.

    Scores and terms are those of the contract of op11: BM25 with k1 = 0.8 and b = 0.75, in whole numbers. Equal scores go by id,
    null ids last; repeated documents each count and may each be ranked. Items that are equal in id and text count once; an
    item without a term, or whose terms no document holds, has no rows. Null texts have no terms. No documents or no items:
    no rows. Ids of documents are whole numbers; other columns are ignored.

    Queries are taken by blocks of about BLOCK_ROWS rows (item, term), each against an index of its own terms over all
    documents; the driver and the tasks hold one block. A first search over one shard in FIRST_SHARDS finds scores that k
    documents reach, so the whole search starts with bounds that leave out most documents.
    """
    spark = docs.sparkSession
    plain = items.select(F.col(item_col).alias("item"), F.translate(item_text, ASCII_UPPER, ASCII_LOWER).alias("_t"), F.md5(F.col(item_text).cast("binary")).alias("_d")).where("_t IS NOT NULL")
    plain = plain.dropDuplicates(["item", "_d"])
    asked = plain.withColumn("q", F.monotonically_increasing_id()).withColumn("term", F.explode(F.array_remove(F.split("_t", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), "")))
    asked = materialize(asked.groupBy("q", "item", "term").agg(F.count("*").alias("times")))
    blocks = max(1, -(-asked.count() // BLOCK_ROWS))
    out, used = [], [asked]
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == block)
        words = frozenset(r[0].encode() for r in rows.select("term").distinct().toLocalIterator())
        shards = materialize(index(docs, words, id_col, text_col))
        n_docs, n_terms = shards.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
        size = F.get("ends", F.col("i")) - F.coalesce(F.get("ends", F.col("i") - 1), F.lit(0))
        held = shards.select(F.posexplode("terms").alias("i", "term"), "ends").select("term", size.alias("df"))
        df = held.groupBy("term").agg(F.sum("df").alias("df"))
        weight = F.floor(1000 * F.log((2.0 * n_docs + 2.0) / (2.0 * F.col("df") + 1.0))).cast("long")
        weighed = materialize(rows.join(df, "term").select("q", "item", "term", (F.col("times") * weight).alias("w")))
        wanted: dict[int, list[tuple[str, int]]] = {}
        for r in weighed.select("q", "term", "w").toLocalIterator():
            wanted.setdefault(r["q"], []).append((r["term"], r["w"]))
        first = shards.where(F.pmod(F.xxhash64("n_docs", "n_terms", F.get("doc_ids", F.lit(0))), F.lit(FIRST_SHARDS)) == 0)
        early = top(_search(first, [(q, t, 1) for q, t in wanted.items()], n_docs, n_terms, k), ["q"], k)
        floor = {r["q"]: r["score"] for r in early.where(F.col("rank") == k).select("q", "score").toLocalIterator()}
        found = _search(shards, [(q, t, floor.get(q, 1)) for q, t in wanted.items()], n_docs, n_terms, k)
        names = weighed.select("q", "item").distinct()
        out.append(materialize(top(found, ["q"], k).join(F.broadcast(names), "q").select(F.col("item").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("doc_id").alias(id_col), "score")))
        used += [shards, weighed]
    discard(*used)
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark item; nulls and repeated rows as in search()."""
    return search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t FROM documents),
i AS (SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t FROM (SELECT DISTINCT item_id, text FROM benchmark)),
c AS (SELECT count(*) AS n_docs, sum(len(t))::BIGINT AS n_terms FROM d WHERE len(t) > 0),
a AS (SELECT q, item_id, term, count(*) AS times FROM (SELECT q, item_id, unnest(t) AS term FROM i) GROUP BY ALL),
p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM a) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), c),
s AS (SELECT q, item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
      FROM a JOIN w USING (term) JOIN p USING (term), c GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10
"""
