"""SentencePiece encoding and decoding that keeps, for every piece, its byte span in the original text.

The normaliser walks the text by longest prefix in the model's compiled character map and records which
source byte each normalised byte comes from; the library segments; piece lengths summed over the
normalised text then project each piece to the source.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from matriq.llm.common import read, small_batches

SPACE = "▁".encode()
CONTROL, USER, BYTE = 3, 4, 6


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol buffer message: number and value."""

    def number(i: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            x = b[i]
            out, i, shift = out | (x & 127) << shift, i + 1, shift + 7
            if x < 128:
                return out, i

    i = 0
    while i < len(b):
        tag, i = number(i)
        kind = tag & 7
        if kind == 0:
            value, i = number(i)
        else:
            n, i = number(i) if kind == 2 else (4 if kind == 5 else 8, i)
            value, i = b[i : i + n], i + n
        yield tag >> 3, value


class CharacterMap:
    """The compiled map: a double-array trie over UTF-8 bytes, and NUL-ended replacements."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.texts = blob[4 + size :]

    def longest(self, b: bytes, i: int) -> tuple[bytes, int] | None:
        """Replacement and length of the longest key that starts at b[i]."""
        units, node, best = self.units, 0, None
        if not units:
            return None
        at = self._step(units[0])
        for j in range(i, len(b)):
            node = at ^ b[j]
            unit = units[node] if node < len(units) else 0
            if unit & 0x800000FF != b[j]:
                break
            at = node ^ self._step(unit)
            if unit >> 8 & 1:
                best = (units[at] & 0x7FFFFFFF, j + 1 - i)
        if best is None:
            return None
        return self.texts[best[0] : self.texts.index(b"\0", best[0])], best[1]

    @staticmethod
    def _step(unit: int) -> int:
        return (unit >> 10) << ((unit & 1 << 9) >> 6)


class Codec:
    """One model. encode() and decode() are the library's; spans() adds where each piece lies in the source."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        spec, kinds, names = {}, [], []
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                names.append(piece[1])
                kinds.append(piece.get(3, 1))
            elif number == 3:
                spec = dict(_fields(value))
        self.map = CharacterMap(spec.get(2, b""))
        self.dummy, self.trim, self.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        self.user = sorted((n for n, k in zip(names, kinds, strict=True) if k == USER), key=len, reverse=True)
        #: Bytes that each piece stands for in the normalised text.
        self.length = np.array([{BYTE: 1, CONTROL: 0}.get(k, len(n)) for n, k in zip(names, kinds, strict=True)], dtype=np.int64)
        self.unknown = self.library.unk_id()
        self.plain = not self.map.units and not self.user and not self.trim and self.escape

    def _prefix(self, b: bytes, i: int) -> tuple[bytes, int]:
        for u in self.user:
            if b.startswith(u, i):
                return u, len(u)
        found = self.map.longest(b, i)
        if found:
            return found
        n = 1 if b[i] < 0x80 else 2 if b[i] < 0xE0 else 3 if b[i] < 0xF0 else 4
        return b[i : i + n], n

    def normalise(self, b: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised bytes of valid UTF-8, and for each of them, and for the end, its offset in the source."""
        if self.plain:
            if not b:
                return b"", np.zeros(1, np.int64)
            head = SPACE if self.dummy else b""
            x = np.frombuffer(b, np.uint8)
            source = np.repeat(np.arange(len(b)), np.where(x == 32, 3, 1))
            return head + b.replace(b" ", SPACE), np.concatenate([np.zeros(len(head), np.int64), source, [len(b)]])
        out, source, i = bytearray(), [], 0
        space = SPACE if self.escape else b" "
        if self.trim:
            while i < len(b) and (p := self._prefix(b, i))[0] == b" ":
                i += p[1]
        if i == len(b):
            return b"", np.zeros(1, np.int64)
        if self.dummy:
            out += space
            source += [i] * len(space)
        after_space = self.trim
        while i < len(b):
            text, n = self._prefix(b, i)
            while after_space and text.startswith(b" "):
                text = text[1:]
            if text:
                new = text.replace(b" ", space)
                out += new
                source += [i] * len(new)
                after_space = text.endswith(b" ")
            i += n
            after_space = after_space and self.trim
        if self.trim:
            while out.endswith(space):
                i = source[-len(space)]
                del out[-len(space) :], source[-len(space) :]
        return bytes(out), np.array([*source, i])

    def encode(self, text: str) -> list[int]:
        return self.library.encode(text, add_bos=True, add_eos=True)

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)

    def spans(self, text: str, ids: list[int]) -> np.ndarray:
        """(n, 2) begin and end, in bytes of the source, of each id; marks of begin and end have none (empty spans)."""
        plain, source = self.normalise(text.encode())
        i = np.asarray(ids, np.int64)
        size = self.length[i]
        if self.unknown in ids and size.sum() != len(plain):
            size = self._with_unknown(text, ids)
        end = np.cumsum(size)
        if len(end) and end[-1] != len(plain):
            raise ValueError("the pieces do not add up to the normalised text")
        return np.stack([source[end - size], source[end]], 1)

    def _with_unknown(self, text: str, ids: list[int]) -> np.ndarray:
        """An unknown piece may be any string: lengths by the library's own pieces."""
        pieces = iter(self.library.encode(text, out_type="immutable_proto").pieces)
        return np.array([0 if self.library.is_control(i) else len(next(pieces).piece.encode()) if i == self.unknown else self.length[next(pieces).id] for i in ids])


_codecs: dict[int, Codec] = {}


def codec(model: bytes) -> Codec:
    """One codec a worker process and model."""
    key = hash(model)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(model)
    return _codecs[key]


def load_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_pieces(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ("ids", "begins", "ends", "decoded")) -> DataFrame:
    """One row per input row: id, n_tokens, n_bytes, ids_sha256, decoded_sha256, and of ids, begins, ends, decoded those in `keep`.

    model: the bytes of a SentencePiece model, sent with the tasks (half a megabyte). ids have begin and end marks; digests
    are of ids as little-endian unsigned 32-bit integers, and of the decoded text in UTF-8. begins and
    ends are byte offsets in the text. Null counts as empty, whose ids are the two marks. Each row
    is encoded by itself, whole, at any length; repeated rows and ids each keep their row; null ids
    stay null; no rows give none; extra columns are ignored.
    """
    kinds = {"ids": "array<int>", "begins": "array<bigint>", "ends": "array<bigint>", "decoded": "string"}
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, n_tokens bigint, n_bytes bigint, ids_sha256 string, decoded_sha256 string" + "".join(f", {k} {kinds[k]}" for k in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in batches:
            for part in range(0, batch.num_rows, 256):
                rows = batch.slice(part, 256)
                out: dict[str, list] = {k: [] for k in ("n_tokens", "n_bytes", "ids_sha256", "decoded_sha256", *keep)}
                for text in rows.column(1):
                    text = text.as_py() or ""
                    ids = c.encode(text)
                    spans = c.spans(text, ids)
                    decoded = c.decode(ids)
                    out["n_tokens"].append(len(ids))
                    out["n_bytes"].append(int((spans[:, 1] - spans[:, 0]).sum()) if c.plain else len(text.encode()))
                    out["ids_sha256"].append(hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest())
                    out["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
                    for k, v in (("ids", ids), ("begins", spans[:, 0]), ("ends", spans[:, 1]), ("decoded", decoded)):
                        if k in keep:
                            out[k].append(v)
                types = {"n_tokens": pa.int64(), "n_bytes": pa.int64(), "ids": pa.list_(pa.int32()), "begins": pa.list_(pa.int64()), "ends": pa.list_(pa.int64())}
                yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(v, types.get(k, pa.string())) for k, v in out.items())], names=[id_col, *out])

    return small_batches(docs).select(id_col, text_col).mapInArrow(run, schema)


def default_model() -> bytes:
    import public_tokenizers

    return load_model(public_tokenizers.path("piece_bpe_32k.model"))


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(read(spark, sf_dir, "documents"), default_model(), keep=())
