"""Toxicity: a lexicon trie met by Levenshtein automata, scored in context windows.

The lexicon is learned from labelled rows: words and word stems that toxic documents have and others
don't. A word of a text matches a term if the automaton of the word, of at most EDITS edits, and the trie accept a
common string; a stem must begin the word. Matches are summed over windows of neighbouring words, less
where they stand in quotation marks or after reporting words, more beside words of address.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matriq.llm.common import read, small_batches
from matriq.llm.features import pieces
from matriq.llm.language import bounded_sample, fold_of

WORD = re.compile(r"[^\W_]+")
EDITS, FUZZY_FROM = 1, 5
STEMS = (4, 5, 6, 7, 8)
#: Fitting reads at most so many labelled rows of each class.
FIT_ROWS = 4000
#: An entry stands in this share of the toxic rows or more, so there are at most a hundred times as many as a toxic row has words and stems.
LEAST_SHARE, LEAST_DOCS, PRECISION = 0.01, 5, 0.95
#: Rows of a class that agree in so many least word hashes count once.
SKETCH = 4
WINDOW, NEAR = 40, 6
THRESHOLD = 0.7
# Marks of quotation, words that report speech, words of address.
QUOTES = {'"': '"', "“": "”", "„": "“", "«": "»", "‘": "’", "‹": "›"}
REPORTING = {"said", "says", "quoted", "quote", "called", "word", "term", "slur", "wrote", "sagte", "wort", "dijo", "palabra", "dit", "mot"}
ADDRESS = {"you", "your", "youre", "u", "du", "dich", "dein", "ihr", "tu", "te", "toi", "ton", "vous", "usted", "tú", "vos", "eres"}
CACHE = 200_000


class Automaton:
    """Strings within k edits of a word. A state is the tuple of (position, edits) that are reachable; () is dead."""

    def __init__(self, word: str, k: int):
        self.word, self.k = word, k

    def start(self) -> tuple:
        return self._close({(0, 0)})

    def _close(self, states: set) -> tuple:
        todo = list(states)
        while todo:
            at, e = todo.pop()
            if e < self.k and at < len(self.word) and (at + 1, e + 1) not in states:
                states.add((at + 1, e + 1))
                todo.append((at + 1, e + 1))
        return tuple(states)

    def step(self, state: tuple, char: str) -> tuple:
        out = set()
        for at, e in state:
            if at < len(self.word) and self.word[at] == char:
                out.add((at + 1, e))
            elif e < self.k:
                out.add((at, e + 1))
                if at < len(self.word):
                    out.add((at + 1, e + 1))
        return self._close(out) if out else ()

    def accepts(self, state: tuple) -> int | None:
        """Fewest edits with which the whole word is read, if it can be."""
        return min((e for at, e in state if at == len(self.word)), default=None)


@dataclass
class Lexicon:
    """Terms and stems with weights. The trie is of nested dicts; key "" holds a term's weight."""

    terms: dict[str, float]
    stems: dict[str, float]
    trie: dict = field(default_factory=dict)
    heads: set = field(default_factory=set)
    tails: set = field(default_factory=set)

    def __post_init__(self):
        for t, w in self.terms.items():
            node = self.trie
            for c in t:
                node = node.setdefault(c, {})
            node[""] = w
            if len(t) >= FUZZY_FROM:  # one edit leaves one half of the term as it is
                half = len(t) // 2
                self.heads.add(t[:half])
                self.tails.add(t[half:])
        self.sizes = sorted({len(x) for x in self.heads}), sorted({len(x) for x in self.tails})
        self.longest = max(map(len, self.terms), default=0)

    def near(self, word: str) -> bool:
        """False only if no term of FUZZY_FROM letters or more is within one edit of the word."""
        if not FUZZY_FROM - EDITS <= len(word) <= self.longest + EDITS:
            return False
        return any(word[:n] in self.heads for n in self.sizes[0]) or any(word[-n:] in self.tails for n in self.sizes[1])

    def match(self, word: str) -> tuple[float, int] | None:
        """Weight and kind (0 exact, 1 misspelt, 2 stem) of the best entry for a word."""
        if word in self.terms:
            return self.terms[word], 0
        stem = max((self.stems[word[:n]] for n in STEMS if len(word) > n and word[:n] in self.stems), default=None)
        if stem is not None:
            return stem, 2
        if not self.near(word):
            return None
        best, a = 0.0, Automaton(word, EDITS)
        todo = [(self.trie, a.start(), 0)]
        while todo:
            node, state, depth = todo.pop()
            if "" in node and depth >= FUZZY_FROM and a.accepts(state) is not None:
                best = max(best, node[""])
            for c, below in node.items():
                if c and (after := a.step(state, c)):
                    todo.append((below, after, depth + 1))
        return (best, 1) if best else None


FEATURES = 7


class Scorer:
    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.known = lexicon, {}

    def entry(self, word: str) -> tuple[float, int] | None:
        if word not in self.known:
            if len(self.known) >= CACHE:
                self.known.clear()
            self.known[word] = self.lexicon.match(word)
        return self.known[word]

    def features(self, text: str) -> np.ndarray:
        """Sums of exact, misspelt and stem matches, largest window, rate, quoted share, addressed share."""
        out = np.zeros(FEATURES)
        text = text.lower()
        words = WORD.findall(text)
        hits = {w: m for w in set(words) if (m := self.entry(w)) is not None}
        if not hits:
            return out
        spans = [(i, m.start(), m.group()) for i, m in enumerate(WORD.finditer(text)) if m.group() in hits]
        inside = quoted(text, [s for _, s, _ in spans])
        at, value, sums, addressed = [], [], [0.0, 0.0, 0.0], 0
        for (i, _, w), q in zip(spans, inside, strict=True):
            near = words[max(0, i - NEAR) : i + NEAR + 1]
            reported = q or any(x in REPORTING for x in words[max(0, i - 3) : i])
            direct = any(x in ADDRESS for x in near)
            addressed += direct
            weight, kind = hits[w]
            weight *= (0.25 if reported else 1.0) * (1.5 if direct else 1.0)
            sums[kind] += weight
            at.append(i)
            value.append(weight)
        left, total, most = 0, 0.0, 0.0
        for right, v in enumerate(value):
            total += v
            while at[right] - at[left] >= WINDOW:
                total -= value[left]
                left += 1
            most = max(most, total)
        out[:3] = np.log1p(sums)
        out[3:] = math.log1p(most), math.log1p(100 * sum(value) / len(words)), sum(inside) / len(at), addressed / len(at)
        return out


def quoted(text: str, starts: list[int]) -> list[bool]:
    """Whether each of the ascending places lies between a mark of quotation and its closing one on the same line, however long."""
    out, pairs, next_ = [], [], {}
    line = -1
    for m in re.finditer("[" + "".join(QUOTES) + "]", text):
        if pairs and m.start() <= pairs[-1][1]:
            continue
        if line < m.end():
            line = text.find("\n", m.end())
            line = len(text) if line < 0 else line
        mark = QUOTES[m.group()]
        if next_.get(mark, -1) < m.end():  # looked for once between two closing marks, so the search is linear
            end = text.find(mark, m.end())
            next_[mark] = len(text) if end < 0 else end
        if next_[mark] < line:
            pairs.append((m.start(), next_[mark]))
    k = 0
    for s in starts:
        while k < len(pairs) and pairs[k][1] < s:
            k += 1
        out.append(k < len(pairs) and pairs[k][0] < s)
    return out


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    weights: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -30, 30)))


def tokens(text: str) -> set[str]:
    """Words of two letters or more, and stems as *stem."""
    words = {w for w in WORD.findall(text.lower()) if len(w) > 1}
    return words | {"*" + w[:n] for w in words for n in STEMS if len(w) > n}


def learn_lexicon(counts: Iterable[tuple[str, int, int]], toxic: int, clean: int) -> Lexicon:
    """counts: token, toxic documents with it, others with it. Entries are common enough in toxic ones and rare elsewhere.

    The rates in each class count, not the numbers of rows that happened to be labelled.
    """
    least = max(LEAST_DOCS, LEAST_SHARE * toxic)
    rated = []
    for t, a, b in counts:
        p, q = a / max(toxic, 1), (b + 0.5) / max(clean, 1)
        if a >= least and p / (p + q) >= PRECISION:
            rated.append((math.log(p / q), a, t))
    return Lexicon({t: w for w, _, t in rated if t[0] != "*"}, {t[1:]: w for w, _, t in rated if t[0] == "*"})


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.02, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Class-balanced ridge logistic regression by Newton steps."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    each = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    penalty = np.diag([ridge / 10] * x.shape[1] + [1e-4])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (each * p * (1 - p) + 1e-9)[:, None]).T @ z + penalty, z.T @ (each * (y - p)) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = FIT_ROWS) -> ToxicityModel:
    """Fit on at most per_class labelled rows of each class (a bound, whatever the input's size).

    Copies would make a text's chance words look telling, so of a class's rows with the same SKETCH least word hashes
    one counts. Without rows of both classes every score is the share of toxic rows, 0.5 if there are none.
    """
    l = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_i")).agg(F.max(label_col).cast("int").alias("_y"))
    ids = docs.select(F.col(id_col).alias("_i")).join(l, "_i")
    ids = F.broadcast(bounded_sample(ids, "_i", "_y", per_class).dropDuplicates(["_i"]).select("_i", "_y", "_share"))
    rows = docs.select(F.col(id_col).alias("_i"), F.coalesce(F.col(text_col), F.lit("")).alias("_t")).join(ids, "_i").select("_i", "_y", "_t")

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            low = [",".join(map(str, sorted(set(map(stable, set(WORD.findall(t.lower())))))[:SKETCH])) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(low, pa.string())], names=["_i", "_y", "_low"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Counter(), Counter()
        for b in batches:
            for y, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                found[y].update(tokens(t))
        words = list(found[0].keys() | found[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([found[1][w] for w in words], pa.int64()), pa.array([found[0][w] for w in words], pa.int64())], names=["w", "a", "b"])

    id_type = rows.schema["_i"].dataType.simpleString()
    one = rows.mapInArrow(least, f"_i {id_type}, _y int, _low string").groupBy("_y", "_low").agg(F.min("_i").alias("_i"))
    alone = rows.join(F.broadcast(one.select("_i")), "_i")
    sizes = {r["_y"]: r["n"] for r in alone.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        share = toxic / (toxic + clean) if toxic + clean else 0.5
        return ToxicityModel(Lexicon({}, {}), np.zeros(FEATURES), math.log((share + 1e-6) / (1 - share + 1e-6)))
    counts = alone.repartition(8).mapInArrow(count, "w string, a bigint, b bigint").groupBy("w").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    least_docs = max(LEAST_DOCS, LEAST_SHARE * toxic)
    rate = F.col("a") / toxic
    counts = counts.where((F.col("a") >= least_docs) & (rate / (rate + (F.col("b") + 0.5) / clean) >= PRECISION))
    lexicon = learn_lexicon(counts.toPandas().itertuples(index=False), toxic, clean)
    fitted = _features(rows, lexicon, ["_i", "_y"], "_t").toPandas().sort_values("_i")
    x, y = np.stack(fitted["_x"]) if len(fitted) else np.zeros((0, FEATURES)), fitted["_y"].to_numpy()
    return ToxicityModel(lexicon, *logistic(x, y))


def stable(word: str) -> int:
    """A hash that is the same in every process."""
    import xxhash

    return xxhash.xxh3_64_intdigest(word) >> 1


def _features(docs: DataFrame, lexicon: Lexicon, cols: list[str], text_col: str) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)  # bounded by LEAST_SHARE
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in batches:
            for rows in pieces(batch, len(cols), 1 << 20):
                x = [scorer.features(t or "").tolist() for t in rows.column(len(cols)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(x, pa.list_(pa.float64()))], names=[*cols, "_x"])

    return small_batches(docs).select(*cols, text_col).mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in cols) + ", _x array<double>")


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: id, score (0 to 1, higher is likelier toxic), predicted (1 at the threshold or more).

    Whole texts are read, at any length. Null and empty texts match nothing and have the score of such
    texts. Repeated rows each keep their row, null ids stay null, no rows give none; extra columns are ignored.
    """
    weights = F.array(*(F.lit(float(w)) for w in model.weights))
    rows = docs.select(F.col(id_col).alias("_i"), F.col(text_col).alias("_t"))
    found = _features(rows, model.lexicon, ["_i"], "_t")
    line = F.aggregate(F.zip_with("_x", weights, lambda x, w: x * w), F.lit(float(model.bias)), lambda a, x: a + x)
    score = 1 / (1 + F.exp(-F.greatest(F.least(line, F.lit(30.0)), F.lit(-30.0))))
    return found.select(F.col("_i").alias(id_col), score.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held = F.coalesce(fold_of(F.col("doc_id"), 3) == 1, F.lit(False))
    labels = read(spark, sf_dir, "labels")
    model = train(docs.where(~held), labels.where(~held), label_col="toxic")
    return score_toxicity(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")
