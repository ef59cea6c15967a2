"""SentencePiece encoding and decoding that keeps source offsets.

A text is normalised by the model's compiled character map: at every byte the longest prefix that the map knows is
replaced, and each normalised byte records the source byte it came from. Pieces partition the normalised text, so every
piece is projected to a span of original bytes. Pieces never cross from a word into the white space after it where the
vocabulary has no such piece; then a text is the sequence of its words, and words seen before come from a cache.

Defined results: a null text is empty; an empty text has no pieces, only the end id; U+2581 is white space, as in the
library; repeated rows are encoded each; a text of any length is encoded whole; other columns are left alone; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm.common import table
from spanforge.llm.hashing import by_bytes

SPACE = "▁"
#: Words kept in a worker's cache, and their bytes, before it is begun anew.
CACHE_WORDS, CACHE_BYTES = 120_000, 4 << 20


class CharacterMap:
    """The compiled character map: a double-array trie over bytes whose values point to replacement strings."""

    def __init__(self, blob: bytes):
        self.units: np.ndarray = np.zeros(0, np.uint32)
        self.replacements = b""
        if blob:
            (size,) = struct.unpack("<I", blob[:4])
            self.units = np.frombuffer(blob[4 : 4 + size], np.uint32)
            self.replacements = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest known prefix of ``data[at:]`` and its replacement."""
        if not len(self.units):
            return None
        found = None
        unit = int(self.units[0])
        node = (unit >> 10) << ((unit & 0x200) >> 6)
        for n in range(at, len(data)):
            node ^= data[n]
            if node >= len(self.units):
                break
            unit = int(self.units[node])
            if unit & 0x800000FF != data[n]:
                break
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit >> 8 & 1:
                value = int(self.units[node]) & 0x7FFFFFFF
                found = n + 1 - at, self.replacements[value : self.replacements.index(b"\0", value)]
        return found


class Codec:
    """Encodes and decodes with one model; built once in each Python worker."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        spec = model.normalizer_spec
        self.spec, self.map = spec, CharacterMap(spec.precompiled_charsmap)
        self.end = self.library.eos_id()
        self.table: list[bytes] = []
        for piece in model.pieces:
            if piece.type == 6:  # a byte
                raw = bytes([int(piece.piece[3:5], 16)])
            elif piece.type == 3:  # control
                raw = b""
            elif piece.type == 2:  # unknown
                raw = " ⁇ ".encode()
            else:
                raw = piece.piece.replace(SPACE, " ").encode()
            self.table.append(raw)
        inner = any(SPACE in p.piece.lstrip(SPACE) or "\n" in p.piece for p in model.pieces)
        self.by_words = not inner and not len(self.map.units) and spec.add_dummy_prefix and not spec.remove_extra_whitespaces and model.trainer_spec.byte_fallback
        self.words: dict[str, tuple[str, int, bytes]] = {}
        self.held = 0

    # normalisation

    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        """Normalised bytes (white space as a plain blank) and, for each and for the end, the source byte it came from."""
        data, spec = text.replace(SPACE, " ").encode(), self.spec
        shift = np.zeros(len(data) + 1, np.int64)
        if SPACE in text:  # a three-byte sign became one byte
            wide = np.frombuffer(b"".join(b"\3\0\0" if c == SPACE else b"\1" * len(c.encode()) for c in text), np.uint8)
            shift[1:] = np.cumsum(wide[wide > 0]) - np.arange(1, len(data) + 1)
        if not len(self.map.units) and not spec.remove_extra_whitespaces:
            # an empty map has no prefix to find: every byte comes from itself
            front = b" " if spec.add_dummy_prefix and data else b""
            own = np.arange(len(data) + 1) + shift
            return front + data, np.concatenate([own[: len(front)], own])
        def prefix(at: int) -> tuple[int, bytes]:
            """Length of the longest known prefix, else of one character, and what it becomes."""
            width = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
            return self.map.longest(data, at) or (width, data[at : at + width])

        out, source, at, blank = bytearray(), [], 0, True
        while spec.remove_extra_whitespaces and at < len(data) and prefix(at)[1] == b" ":
            at += prefix(at)[0]
        if spec.add_dummy_prefix and at < len(data):
            out += b" "
            source.append(at)
        while at < len(data):
            size, new = prefix(at)
            for k, byte in enumerate(new):
                if spec.remove_extra_whitespaces and byte == 0x20 and blank:
                    continue
                blank = byte == 0x20
                out.append(byte)
                source.append(at + (k if new == data[at : at + size] else 0))
            at += size
        end = len(data)
        while spec.remove_extra_whitespaces and out[-1:] == b" ":
            out.pop()
            end = source.pop()
        aligned = np.array([*source, end], np.int64)
        return bytes(out), aligned + shift[aligned]

    # encoding

    def learn(self, texts: list[str]) -> list[list[str]]:
        """The words of each text; those not yet known are encoded together and cached."""
        split = [WORDS.findall(" " + t.replace(SPACE, " ")) if t else [] for t in texts]
        new = {w for words in split for w in words if w not in self.words}
        self.held += sum(map(len, new))
        if len(self.words) + len(new) > CACHE_WORDS or self.held > CACHE_BYTES:
            self.words.clear()
            new = {w for words in split for w in words}
            self.held = sum(map(len, new))
        fresh = list(new)
        for start in range(0, len(fresh), 20_000):
            part = fresh[start : start + 20_000]
            # the library puts a blank before each; a word's own first blank is left to it, a line's first piece is dropped
            for word, ids in zip(part, self.library.encode([w[1:] if w[0] == " " else w for w in part], num_threads=1), strict=True):
                ids = ids[1:] if word[0] == "\n" else ids or [self.library.piece_to_id(SPACE)]
                self.words[word] = " ".join(map(str, ids)), len(ids), bytes(len(self.table[i]) for i in ids)
        return split

    def encode_batch(self, texts: list[str]) -> Iterator[tuple[str, int, np.ndarray]]:
        """For each text its ids joined by blanks (end id included), their number, and the n+1 edges of the pieces in source bytes."""
        if not self.by_words:
            for text in texts:
                ids = self.library.encode(text, num_threads=1)
                _, source = self.normalise(text)
                edges = np.cumsum([0, *(len(self.table[i]) for i in ids)])
                yield " ".join(map(str, [*ids, self.end])), len(ids) + 1, source[np.minimum(edges, len(source) - 1)]
            return
        known = self.words
        for text, words in zip(texts, self.learn(texts), strict=True):
            parts = [known[w] for w in words]
            edges = np.zeros(1, np.int64)
            if parts:
                edges = np.concatenate([edges, np.cumsum(np.frombuffer(b"".join([p[2] for p in parts]), np.uint8), dtype=np.int64)])
                edges = self.normalise(text)[1][edges]
            yield " ".join([*[p[0] for p in parts], str(self.end)]), sum([p[1] for p in parts]) + 1, edges

    # decoding

    def decode(self, ids: list[int]) -> str:
        """As the library's decode(ids)."""
        table = self.table
        data = b"".join([table[i] for i in ids])
        if self.spec.add_dummy_prefix and data[:1] == b" ":
            data = data[1:]
        try:
            return data.decode()
        except UnicodeDecodeError:
            return self.library.decode(ids)


WORDS = re.compile(r" +[^ \n]*|\n[^ \n]*")
#: Rows handled together; a batch's texts and results are in memory at once.
ROWS, ROWS_BYTES = 1_000, 1 << 20
_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _batches(frames: Iterator[pd.DataFrame], text: str) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for start in range(0, len(frame), ROWS):
            part = frame.iloc[start : start + ROWS]
            for low, high in by_bytes(part[text].tolist(), ROWS_BYTES, lambda t: 0 if t is None else len(t)):
                yield part.iloc[low:high]


def encode_documents(docs: DataFrame, model: str | None = None, text: str = "text", spans: bool = True) -> DataFrame:
    """Add ``ids`` (end id last) and, with ``spans``, ``piece_starts`` and ``piece_ends`` in bytes of the text; the end id has an empty span."""
    path = model or default_model()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(path)
        for frame in _batches(frames, text):
            ids, starts, ends = [], [], []
            for joined, _, edges in own.encode_batch(["" if t is None else t for t in frame[text]]):
                ids.append(np.array(joined.split(" "), np.int32))
                starts.append(edges)
                ends.append(np.append(edges[1:], edges[-1]))
            yield frame.assign(ids=ids, **({"piece_starts": starts, "piece_ends": ends} if spans else {}))

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name not in ("ids", "piece_starts", "piece_ends")]
    return docs.drop("ids", "piece_starts", "piece_ends").mapInPandas(run, ", ".join([*kept, "ids array<int>", *(["piece_starts array<long>", "piece_ends array<long>"] if spans else [])]))


def decode_documents(encoded: DataFrame, model: str | None = None, ids: str = "ids") -> DataFrame:
    """Add ``decoded``, the text that the library's decode gives for the ids; null ids give null."""
    path = model or default_model()

    @F.pandas_udf("string")
    def decode(batch: pd.Series) -> pd.Series:
        own = codec(path)
        return batch.map(lambda x: None if x is None else own.decode([int(i) for i in x]))

    return encoded.withColumn("decoded", decode(F.col(ids)))


def encode_digests(docs: DataFrame, model: str | None = None) -> DataFrame:
    """The operator's ids, spans and decoded text, kept as digests: per row of (doc_id, text)."""
    path = model or default_model()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(path)
        for frame in _batches(frames, "text"):
            rows = []
            for joined, n, edges in own.encode_batch(["" if t is None else t for t in frame["text"]]):
                decoded = own.decode(list(map(int, joined.split(" "))))
                rows.append((n, hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), int(edges[-1]), hashlib.sha256(edges.astype("<i8").tobytes()).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", "span_bytes", "spans_sha256"]).assign(doc_id=frame["doc_id"].array)

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, span_bytes long, spans_sha256 string")


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded and decoded; ``span_bytes`` is where the last piece ends in the source."""
    return encode_digests(table(spark, sf_dir, "documents"))
