"""SentencePiece encoding and decoding that keeps offsets.

A text is normalised by the model's compiled character map: at each position the longest prefix that the map
knows is replaced, any other character is kept, and for every normalised byte the source byte is recorded.
The pieces of the encoded text tile the normalised text, so each piece is projected to a span of bytes of the
original. Ids are exactly those of the sentencepiece library for the whole text.

Defined results: null is the empty text (begin and end ids only); texts of any length are encoded whole;
equal rows give equal rows; extra columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from xylem.llm.shared import over_texts

SPACE = "▁".encode()


@dataclass
class Encoding:
    """ids with begin and end; ``begins`` and ``ends``: byte spans in the original text (empty for the two added ids)."""

    ids: np.ndarray
    begins: np.ndarray
    ends: np.ndarray


class Normalizer:
    """The model's normalisation with source alignment."""

    def __init__(self, spec, suffix: bool = False):
        self.prefix, self.squeeze, self.escape, self.suffix = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces, suffix
        blob = spec.precompiled_charsmap
        self.units = self.texts = None
        if blob:
            size = int.from_bytes(blob[:4], "little")
            self.units, self.texts = np.frombuffer(blob[4 : 4 + size], "<u4"), blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[bytes, int]:
        """Replacement of the longest known prefix at ``at`` and its length; else the character itself."""
        found = None
        if self.units is not None:
            unit = int(self.units[0])
            node = unit >> 10 << ((unit & 512) >> 6)
            for k in range(at, len(data)):
                node ^= data[k]
                unit = int(self.units[node]) if node < len(self.units) else 0
                if unit & 0x800000FF != data[k]:
                    break
                node ^= unit >> 10 << ((unit & 512) >> 6)
                if unit >> 8 & 1:
                    start = int(self.units[node]) & 0x7FFFFFFF
                    found = self.texts[start : self.texts.index(b"\0", start)], k + 1 - at
        if found:
            return found
        lead = data[at]
        width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return data[at : at + width], width

    def __call__(self, data: bytes) -> tuple[int, np.ndarray]:
        """Length of the normalised text in bytes, and the source byte of each of its bytes and of its end."""
        if self.units is None and not self.squeeze and self.escape and not self.suffix:
            wide = np.where(np.frombuffer(data, np.uint8) == 32, len(SPACE), 1)
            source = np.repeat(np.arange(len(data)), wide)
            lead = np.zeros(len(SPACE) if self.prefix and data else 0, np.int64)
            return len(lead) + len(source), np.concatenate([lead, source, [len(data)]])
        out, source = bytearray(), []
        space = SPACE if self.escape else b" "
        at, blank = 0, self.squeeze
        if self.squeeze:
            while at < len(data) and self.longest(data, at)[0] == b" ":
                at += self.longest(data, at)[1]
        if self.prefix and at < len(data) and not self.suffix:
            out += space
            source += [at] * len(space)
        blank = self.squeeze
        while at < len(data):
            text, width = self.longest(data, at)
            while blank and text.startswith(b" "):
                text = text[1:]
            if text:
                blank = self.squeeze and text.endswith(b" ")
                put = text.replace(b" ", space)
                out += put
                source += [at] * len(put)
            at += width
        end = len(data)
        if self.squeeze:
            while out.endswith(space):
                end = source[-len(space)]
                del out[-len(space) :], source[-len(space) :]
        if self.prefix and self.suffix and out:
            out += space
            source += [end] * len(space)
        return len(out), np.array([*source, end], np.int64)


class Pieces:
    """A model: encoding with spans, and decoding."""

    def __init__(self, model: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        proto = sentencepiece_model_pb2.ModelProto()
        with open(model, "rb") as f:
            proto.ParseFromString(f.read())
        self.unknown = self.library.unk_id()
        byte, control = proto.SentencePiece.BYTE, proto.SentencePiece.CONTROL
        self.widths = np.array([1 if p.type == byte else 0 if p.type == control else len(p.piece.encode()) for p in proto.pieces])
        self.normalize = Normalizer(proto.normalizer_spec, proto.trainer_spec.treat_whitespace_as_suffix)

    def encode(self, text: str, ids: list[int] | None = None) -> Encoding:
        ids = np.array(self.library.encode(text, add_bos=True, add_eos=True) if ids is None else ids, np.uint32)
        data = text.encode()
        length, source = self.normalize(data)
        cuts = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(self.widths[ids], out=cuts[1:])
        if cuts[-1] != length or (ids == self.unknown).any():  # unknown pieces are as wide as the text they stand for
            spans = self.library.encode(text, out_type="immutable_proto").pieces
            at = np.concatenate([[0], np.cumsum([len(c.encode()) for c in text])])
            begins = np.array([0, *(at[p.begin] for p in spans), len(data)], np.int64)
            ends = np.array([0, *(at[p.end] for p in spans), len(data)], np.int64)
            return Encoding(ids, begins, ends)
        return Encoding(ids, source[cuts[:-1]], source[cuts[1:]])

    def encode_all(self, texts: list[str]) -> list[Encoding]:
        return [self.encode(t, i) for t, i in zip(texts, self.library.encode(texts, add_bos=True, add_eos=True, num_threads=1), strict=True)]

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


@cache
def load(model: str) -> Pieces:
    return Pieces(model)


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids, begins, ends (byte spans in the original) of each row."""

    def run(batches):
        own = load(model)
        for batch in batches:
            found = own.encode_all([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([getattr(x, k).astype(np.int64) for x in found], pa.list_(pa.int64())) for k in ("ids", "begins", "ends"))], ["doc_id", "ids", "begins", "ends"])

    return over_texts(docs.select("doc_id", "text"), run, "doc_id long, ids array<long>, begins array<long>, ends array<long>")


def decode(rows: DataFrame, model: str) -> DataFrame:
    """doc_id and text of each row of (doc_id, ids)."""

    def run(batches):
        own = load(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.decode([int(i) for i in x or []]) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return over_texts(rows.select("doc_id", "ids"), run, "doc_id long, text string")


def encoded_digests(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, spans_sha256: encode and decode in one pass, without moving ids."""

    def run(batches):
        own = load(model)
        digest = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            rows = []
            for k in range(0, len(texts), 64):
                part = texts[k : k + 64]
                ids = own.library.encode(part, add_bos=True, add_eos=True, num_threads=1)
                for text, one, back in zip(part, ids, own.library.decode(ids, num_threads=1), strict=True):
                    e = own.encode(text, one)
                    rows.append((len(one), digest(e.ids.astype("<u4").tobytes()), digest(back.encode()), digest(np.stack([e.begins, e.ends]).astype("<i8").tobytes())))
            n, a, b, c = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *(pa.array(x, pa.string()) for x in (a, b, c))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"])

    return over_texts(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_sentencepiece(spark, sf_dir) -> DataFrame:
    return encoded_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_model())
