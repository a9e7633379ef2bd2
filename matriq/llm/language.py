"""Language ID by string kernels: blended-spectrum presence, Nystrom landmarks, one-versus-rest kernel ridge regression.

A text is cut into blocks of equal size, of at most BLOCK bytes. A block is the set of the byte n-grams of 1 to ORDER
bytes that begin in it, hashed to SPACE slots: a 0/1 row. The kernel of two blocks is the size of the slots'
intersection over the root of the sizes' product. Scores of a batch are two matrix products: rows by landmarks,
kernels by weights; a text's score is the mean of its blocks', so that no length of text fills the slots.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matriq.llm.common import attach, materialize, read, small_batches
from matriq.llm.features import flat, pieces

ORDER, SPACE, BLOCK = 4, 4096, 2048
#: Blocks whose rows are in memory at once: 8 MB.
BLOCKS = 512
#: At most so many labelled rows of each language are fitted on, and so many of them are landmarks.
FIT_ROWS, LANDMARKS, RIDGE = 400, 48, 1e-2
BATCH_BYTES = 1 << 18
UNDECIDED = "und"


def presence(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """0/1 rows (float32) of the blocks' hashed byte n-grams, each block's text, and its share of it; at most BLOCKS at a time.

    Case-folded for ASCII; spaces and their like are one byte, digits another. Every n-gram of a text is in one block; empty texts have one too.
    """
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    fold[48:58] = 48
    fold[:33] = 32
    body, at, _ = flat(column)
    blocks = np.maximum(-(-np.diff(at) // BLOCK), 1)
    text = np.repeat(np.arange(len(blocks)), blocks)
    place = np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    first = at[text] + place * np.diff(at)[text] // blocks[text]
    start = np.append(first, at[-1])
    for lo in range(0, len(text), BLOCKS):
        of = text[lo : lo + BLOCKS]
        begin, end = int(start[lo]), int(start[lo + len(of)])
        part = fold[body[begin : end + ORDER - 1]]
        row = np.repeat(np.arange(len(of), dtype=np.int64), np.diff(start[lo : lo + len(of) + 1]))
        left = at[of + 1][row] - np.arange(begin, end)
        seen = np.zeros(len(of) * SPACE, np.float32)
        code = np.zeros(len(part), np.uint32)
        for k in range(1, ORDER + 1):
            m = len(part) - k + 1
            if m < 1:
                break
            code = (code[:m] << np.uint32(8)) | part[k - 1 :]
            hashed = ((code + np.uint32(k)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - SPACE.bit_length() + 1)
            m = min(m, len(row))
            seen[(row[:m] * SPACE + hashed[:m])[left[:m] >= k]] = 1
        yield seen.reshape(len(of), SPACE), of, 1 / blocks[of]


@dataclass
class LanguageModel:
    languages: list[str]
    landmarks: np.ndarray
    weights: np.ndarray

    def kernels(self, rows: np.ndarray) -> np.ndarray:
        size = np.sqrt(np.maximum(rows.sum(1), 1))
        return rows @ self.landmarks.T / (size[:, None] * np.sqrt(np.maximum(self.landmarks.sum(1), 1))[None])

    def scores(self, column: pa.Array) -> np.ndarray:
        """(n, languages) regression values, about 1 for a text's own language and 0 for others: the mean over its blocks."""
        out = np.zeros((len(column), len(self.languages)))
        for rows, of, share in presence(column):
            np.add.at(out, of, (self.kernels(rows) @ self.weights) * share[:, None])
        return out


def fit(texts: list[str], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> LanguageModel:
    """Landmarks are the middle blocks of the first texts of each language as given; ridge regression of all blocks in their Nystrom feature space."""
    languages = sorted(set(langs))
    column = pa.array(texts, pa.large_string())
    y = (np.array(langs)[:, None] == np.array(languages)[None]).astype(np.float64)
    chosen = np.concatenate([np.flatnonzero(y[:, k])[:landmarks] for k in range(len(languages))]) if languages else np.zeros(0, int)
    model = LanguageModel(languages, np.zeros((len(chosen), SPACE), np.float32), np.zeros((len(chosen), len(languages)), np.float32))
    if not languages:
        return model
    for i, c in enumerate(chosen):
        middle = max(-(-len(texts[c].encode()) // BLOCK), 1) // 2
        for rows, _, _ in presence(column.slice(c, 1)):
            if 0 <= middle < len(rows):
                model.landmarks[i] = rows[middle]
            middle -= len(rows)
    weight = 1 / y.sum(0)[y.argmax(1)]
    left = ridge * model.kernels(model.landmarks).astype(np.float64) + 1e-9 * np.eye(len(chosen))
    right = np.zeros((len(chosen), len(languages)))
    for rows, of, share in presence(column):
        k = model.kernels(rows).astype(np.float64)
        kw = (k * (weight[of] * share)[:, None]).T
        left += kw @ k
        right += kw @ y[of]
    model.weights = np.linalg.solve(left, right).astype(np.float32)
    return model


def bounded_sample(rows: DataFrame, id_col: str, class_col: str, per_class: int) -> DataFrame:
    """At most per_class rows of each class: those whose hash of id is smallest. A filter on the hash leaves little over that to each class's sort."""
    counts = materialize(rows.where(F.col(class_col).isNotNull()).groupBy(class_col).agg(F.count("*").alias("_size")))
    share = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    cut = F.lit(1.5 * per_class + 20) / F.col("_size")
    few = attach(rows, counts, class_col, ["_size"], id_col, "_size").withColumn("_share", share).where(F.col("_share") <= cut)
    k = F.row_number().over(Window.partitionBy(class_col).orderBy("_share", id_col))
    return few.withColumn("_k", k).where(F.col("_k") <= per_class).drop("_k", "_size")


def train(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int = FIT_ROWS) -> LanguageModel:
    """Fit on at most per_language rows of each language (a bound, whatever the input's size); null labels are left out."""
    named = labelled.where(F.col(lang_col).isNotNull())
    found = bounded_sample(named.select(F.col(id_col).alias("_i"), F.col(lang_col).alias("_l")), "_i", "_l", per_language)
    ids = found.select("_i", "_share")
    rows = named.join(F.broadcast(ids), F.col(id_col) == F.col("_i")).select("_share", F.col(lang_col).alias("l"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    got = rows.toPandas().sort_values(["_share", "t"])
    got = got.groupby("l", sort=False).head(per_language)
    return fit(got["t"].tolist(), got["l"].tolist())


def has_letter(text: str | None) -> bool:
    """Whether a character is a letter, of Unicode's category L: no digit, fraction or number letter."""
    return bool(text) and any(map(str.isalpha, text))


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """One row per input row: id, lang_pred, score (0 to 1: softmax of the languages' regression values), and the columns in keep.

    names: of the two new columns, where keep has such columns already.

    Whole texts are read, at any length. Null texts, and those without a letter, are `und` with score 0,
    and so is every text if the model knows no language. Equal values: the first language by name.
    Repeated rows each keep their row, null ids stay null, no rows give none; other columns are ignored.
    """
    cols = [id_col, *(c for c in keep if c not in (id_col, text_col)), text_col]
    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    outer = [c for c in cols if c != text_col or text_col in keep]
    schema = ", ".join([*(f"`{c}` {fields[c]}" for c in outer), f"`{names[0]}` string", f"`{names[1]}` double"])
    sent = docs.sparkSession.sparkContext.broadcast(model)  # landmarks and weights: bounded by the model's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for rows in pieces(batch, len(cols) - 1, BATCH_BYTES):
                texts = rows.column(len(cols) - 1)
                n = len(texts)
                letters = np.array([has_letter(t.as_py()) for t in texts], bool)
                best, top = np.full(n, UNDECIDED, object), np.zeros(n)
                if m.languages and n:
                    s = m.scores(texts)
                    e = np.exp(8 * (s - s.max(1, keepdims=True)))
                    win = e.argmax(1)
                    best = np.where(letters, np.array(m.languages, object)[win], UNDECIDED)
                    top = np.where(letters, (e / e.sum(1, keepdims=True))[np.arange(n), win], 0.0)
                arrays = [rows.column(i) for i, c in enumerate(cols) if c in outer]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(best.tolist(), pa.string()), pa.array(top, pa.float64())], names=[*outer, *names])

    return small_batches(docs).select(*cols).mapInArrow(run, schema)


def fold_of(c, folds: int):
    """crc32 of the id as text, by the number of folds."""
    return F.crc32(c.cast("string")) % folds


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held = F.coalesce(fold_of(F.col("doc_id"), 4) == 2, F.lit(False))
    model = train(docs.where(~held), "doc_id", "text", "lang")
    out = identify(docs, model)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")
