"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies."""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from importlib import import_module

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from palimpsest.llm.common import registry, table

QUERIES, SQL, query = registry()

SPACE = "▁"
MODEL = "piece_bpe_32k.model"
#: One document in so many is encoded and decoded by the sentencepiece library too, and must agree.
CHECK_EVERY = 64
#: Words whose ids a worker remembers, and the longest of them; longer ones are encoded anew each time.
MEMORY, LONGEST = 400_000, 48


class Pieces:
    """Encoder and decoder for a model of type BPE with byte fallback and the identity normaliser.

    Pairs of neighbouring symbols that form a piece wait in an agenda ordered
    by score, then by place; the best is merged until none is left.  Symbols
    that are no piece become bytes.  No piece goes on after a space, so text is
    cut before each space that follows something else, and what was found for
    a part is remembered (up to a bound).
    """

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kinds = model.SentencePiece
        spec, trained = model.normalizer_spec, model.trainer_spec
        if trained.model_type != trained.BPE or spec.name != "identity" or spec.precompiled_charsmap or spec.remove_extra_whitespaces:
            raise ValueError("only BPE models with the identity normaliser are supported")
        if not trained.byte_fallback or any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("only models with byte fallback and without user-defined or unused pieces are supported")
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.begin, self.end, self.unknown = trained.bos_id, trained.eos_id, trained.unk_id
        self.prefix = SPACE if spec.add_dummy_prefix else ""
        self.pieces = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        #: Place in the agenda of a piece that two symbols form: the best score first.
        self.ranked = {p.piece: -p.score for p in model.pieces if p.type == kinds.NORMAL and len(p.piece) > 1}
        self.bytes = [0] * 256
        self.surface: list[bytes] = []
        self.is_byte = np.zeros(len(model.pieces), dtype=bool)
        for i, p in enumerate(model.pieces):
            if p.type == kinds.BYTE:
                self.bytes[int(p.piece[1:-1], 16)] = i
                self.is_byte[i] = True
                self.surface.append(bytes([int(p.piece[1:-1], 16)]))
            elif p.type == kinds.CONTROL:
                self.surface.append(b"")
            elif p.type == kinds.UNKNOWN:
                self.surface.append(trained.unk_surface.encode())
            else:
                self.surface.append(p.piece.replace(SPACE, " ").encode())
        #: Whether text may be cut before a space that follows something else.
        self.cuts = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.pieces)
        self.known: dict[str, bytes] = {}

    def merge(self, text: str) -> tuple[int, ...]:
        """Ids of one part of a text, by the agenda."""
        ranked = self.ranked
        symbols = list(text)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        pairs = list(map(str.__add__, symbols, symbols[1:]))
        agenda = [(ranked[both], i, i + 1, both) for i, both in enumerate(pairs) if both in ranked]
        heapq.heapify(agenda)
        while agenda:
            _, a, b, both = heapq.heappop(agenda)
            left, right = symbols[a], symbols[b]
            if not left or not right or len(left) + len(right) != len(both):
                continue  # one of the two has been merged elsewhere
            symbols[a], symbols[b] = both, ""
            follows, leads = after[b], before[a]
            after[a] = follows
            if follows >= 0:
                before[follows] = a
                new = both + symbols[follows]
                if new in ranked:
                    heapq.heappush(agenda, (ranked[new], a, follows, new))
            if leads >= 0:
                new = symbols[leads] + both
                if new in ranked:
                    heapq.heappush(agenda, (ranked[new], leads, a, new))
        out: list[int] = []
        for s in symbols:
            if s:
                found = self.pieces.get(s)
                out.extend((found,) if found is not None else [self.bytes[x] for x in s.encode()])
        return tuple(out)

    def packed(self, text: str | None) -> bytes:
        """Ids as little-endian 32-bit integers, with the begin and end ids; a null text is an empty one."""
        if not text:
            return _pack((self.begin, self.end))
        text = self.prefix + text.replace(" ", SPACE)
        parts = _PART.findall(text) if self.cuts else [text]
        found = list(map(self.known.get, parts))
        if None in found:
            for i, ids in enumerate(found):
                if ids is None:
                    found[i] = self.known.get(parts[i]) or self._learn(parts[i])
        return b"".join((_pack((self.begin,)), *found, _pack((self.end,))))

    def encode(self, text: str | None) -> list[int]:
        """The ids of :meth:`packed`."""
        return np.frombuffer(self.packed(text), dtype="<u4").tolist()

    def _learn(self, part: str) -> bytes:
        ids = _pack(self.merge(part))
        if len(part) <= LONGEST:
            if len(self.known) >= MEMORY:
                self.known.clear()
            self.known[part] = ids
        return ids

    def decode(self, ids: list[int]) -> str:
        """Text of ``ids``: control ids vanish, the leading space goes, broken byte runs become U+FFFD."""
        surface = self.surface
        inner = ids[1:-1]
        if self.begin in inner or self.end in inner:
            return self._decode_runs(ids)
        raw = b"".join([surface[i] for i in ids])
        if self.prefix:
            first = next((i for i in ids if surface[i]), None)
            if first is not None and surface[first][:1] == b" " and not self.is_byte[first] and first != self.unknown:
                raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return self._decode_runs(ids)

    def _decode_runs(self, ids: list[int]) -> str:
        out, run, first = [], bytearray(), True
        for i in [*ids, self.begin]:
            if self.is_byte[i]:
                run += self.surface[i]
                first = False
                continue
            while run:
                size = next((n for n in range(1, min(4, len(run)) + 1) if _whole(bytes(run[:n]))), 0)
                out.append(run[:size].decode() if size else "�")
                del run[: size or 1]
            s = self.surface[i].decode()
            if s and first and self.prefix and s[0] == " " and i != self.unknown:
                s = s[1:]
            first = first and not self.surface[i]
            out.append(s)
        return "".join(out)


_PART = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def _pack(ids: tuple[int, ...]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _whole(raw: bytes) -> bool:
    try:
        return len(raw.decode()) == 1
    except UnicodeDecodeError:
        return False


@lru_cache(maxsize=2)
def _load(path: str) -> Pieces:
    return Pieces(path)


def _path(model: str) -> str:
    return model if "/" in model else import_module("public_tokenizers").path(model)


def _digest_batches(model: str, text_at: int, check_every: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = _load(_path(model))
        seen = 0
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            for value in batch.column(text_at):
                text = value.as_py()
                packed = sp.packed(text)
                ids = np.frombuffer(packed, dtype="<u4").tolist()
                back = sp.decode(ids)
                if check_every and seen % check_every == 0:
                    want = [sp.begin, *sp.library.encode(text or "", num_threads=1), sp.end]
                    if ids != want or back != sp.library.decode(want):
                        raise ValueError("encoding differs from the sentencepiece library")
                seen += 1
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(packed).hexdigest())
                text_sha.append(hashlib.sha256(back.encode()).hexdigest())
            columns = [c for i, c in enumerate(batch.columns) if i != text_at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], schema=schema)

    return run


def token_digests(docs: DataFrame, key: str = "doc_id", text: str = "text", model: str = MODEL, check_every: int = CHECK_EVERY) -> DataFrame:
    """``key, n_tokens, ids_sha256, decoded_sha256`` of every row, in Arrow batches, without an exchange.

    Texts are encoded whole with begin and end ids; a null text is encoded as
    an empty one.  Rows keep their order within a partition; other columns are
    not read.  ``model`` is a file of the public tokenizers or a path that
    every executor can open.
    """
    small = docs.select(key, text)
    out = T.StructType([small.schema[0], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
                        T.StructField("decoded_sha256", T.StringType())])
    return small.mapInArrow(_digest_batches(model, 1, check_every, _arrow(out)), out)


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", model: str = MODEL) -> DataFrame:
    """``key, ids`` (array of int)."""
    small = docs.select(key, text)
    out = T.StructType([small.schema[0], T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = _load(_path(model))
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([sp.encode(x.as_py()) for x in part.column(1)], pa.list_(pa.int32()))], schema=_arrow(out))

    return small.mapInArrow(run, out)


def decode(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", model: str = MODEL) -> DataFrame:
    """``key, text`` of id arrays; null ids give an empty text."""
    small = encoded.select(key, ids)
    out = T.StructType([small.schema[0], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = _load(_path(model))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sp.decode(x.as_py() or []) for x in batch.column(1)], pa.string())], schema=_arrow(out))

    return small.mapInArrow(run, out)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


@query("op4_sentencepiece")
def sentencepiece_digests(spark, sf):
    return token_digests(table(spark, sf, "documents"))
