"""How the tokens of two tokenizers cover the same bytes, and which pairs of them meet most often."""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache
from importlib import import_module
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import heavy, join_unique, materialize, registry, table

QUERIES, SQL, query = registry()

FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Code points that a task encodes together, and bytes of ids that it aligns again together (a longer text alone).
TOGETHER, TOGETHER_IDS = 500_000, 1_000_000
#: Links of a group from which its ids are counted before they are paired.
WIDE = 1 << 16
#: Pair counts that a task holds before it hands them on, and that one broadcast carries.
HELD, SHARD = 2_000_000, 4_000_000
#: A pair of ids as one number.
_PAIR = 1 << 32
_SPACE = "▁"


def _path(model: str) -> str:
    return model if "/" in model else import_module("public_tokenizers").path(model)


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes as they are, others from U+0100 on."""
    kept = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b if b in kept else next(others)) for b in range(256)]


class Tokenizers:
    """Both tokenizers, the bytes of each of their tokens, and how ids are written in a digest."""

    def __init__(self, first: str, second: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_file(first)
        self.first.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_file=second)
        from sentencepiece import sentencepiece_model_pb2 as proto

        with open(first, encoding="utf-8") as f:
            spec = json.load(f)
        vocabulary = spec["model"]["vocab"]
        model = proto.ModelProto()
        with open(second, "rb") as f:
            model.ParseFromString(f.read())
        #: Whether neither can change a text but for U+2581.
        self.lossless = (not spec["normalizer"] and (spec["pre_tokenizer"] or {}).get("type") == "ByteLevel" and model.trainer_spec.byte_fallback
                         and model.normalizer_spec.name == "identity" and not model.normalizer_spec.remove_extra_whitespaces)
        byte_of = {c: b for b, c in enumerate(_byte_letters())}
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        pieces = [self.second.id_to_piece(i) for i in range(self.second.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.second.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.sizes_a, self.sizes_b = (np.array(list(map(len, x)), dtype=np.int64) for x in (self.bytes_a, self.bytes_b))
        self.quick, self.unsure = _same_encoder(self.first, spec, self.bytes_a)
        #: An id and what follows it: another of its side, or the end of its part of the group.
        self.written_a, self.written_b = (np.array([f"{i}{end}" for i in range(n) for end in ("," + last)], dtype=object)
                                          for n, last in ((len(self.bytes_a), "|"), (len(self.bytes_b), ";")))

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both for each text; none where either doesn't give its bytes back.

        A byte-level vocabulary without a normaliser loses nothing, and with
        byte fallback and the identity normaliser only U+2581 can come back as
        something else, so bytes are only compared where lengths are equal and
        the text has that character.
        """
        slow = [i for i, t in enumerate(texts) if self.quick is None or self.unsure.search(t)]
        ids = {i: e.ids for i, e in zip(slow, self.first.encode_batch_fast([" " + texts[i] for i in slow], add_special_tokens=False), strict=True)}
        first = [np.array(ids[i] if i in ids else self.quick.encode_ordinary(" " + t), dtype=np.int64) for i, t in enumerate(texts)]
        second = [np.array(ids, dtype=np.int64) for ids in self.second.encode(texts, num_threads=1)]
        for i, text in enumerate(texts):
            size = len(text.encode()) + 1
            if self.sizes_a[first[i]].sum() != size or self.sizes_b[second[i]].sum() != size or not self._gives_back(text, first[i], second[i]):
                first[i] = second[i] = np.zeros(0, np.int64)
        return first, second

    def _gives_back(self, text: str, first: np.ndarray, second: np.ndarray) -> bool:
        if self.lossless and _SPACE not in text:
            return True
        raw = (" " + text).encode()
        return all(b"".join([spelled[i] for i in ids]) == raw for ids, spelled in ((first.tolist(), self.bytes_a), (second.tolist(), self.bytes_b)))


def _same_encoder(first, spec: dict, spelled: list[bytes]):
    """tiktoken's much faster encoder with the vocabulary of ``first`` where it is sure to give the same ids, and a pattern of what it isn't sure about.

    It merges whatever two neighbours spell a token, lowest rank first, where
    ``first`` goes by its list of merges.  With ranks in the order of that
    list, the two can only part where a token is spelled by a pair not on it;
    then that token's own text, encoded by ``first``, would end as this pair.
    So they agree if ``first`` encodes each token's text as the token.  The
    pattern that cuts texts knows characters by class only; characters that
    the two engines class differently, and those beyond U+FFFF, are unsure.
    """
    import tiktoken

    model, before = spec["model"], spec["pre_tokenizer"] or {}
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    made = [model["vocab"].get("".join(p), -1) for p in pairs]
    letters = [model["vocab"].get(c, -1) for c in _byte_letters()]
    plain = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not spec["normalizer"]
    odd = [model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")]
    ordered = min(letters) >= 0 and made and max(letters) < made[0] and all(x < y for x, y in zip(made, made[1:], strict=False))
    if not (plain and ordered and not any(odd) and all(len(first.model.tokenize("".join(p))) == 1 for p in pairs)):
        return None, None
    cut = import_module("public_tokenizers").PATTERN
    quick = tiktoken.Encoding("same", pat_str=cut, mergeable_ranks={spelled[i]: i for i in [*letters, *made]}, special_tokens={})
    # A piece that is a token of its own shows whether a character joins the one before it.
    points = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000]
    joined = {(a + c).encode(): 256 + n for n, (a, c) in enumerate((a, c) for a in "a1.\n" for c in points)}
    probe = tiktoken.Encoding("probe", pat_str=cut, mergeable_ranks={bytes([b]): b for b in range(256)} | joined, special_tokens={})
    split, tokens = first.pre_tokenizer.pre_tokenize_str, probe.encode_ordinary

    def classed(c: str, pieces) -> str | None:
        """The character that ``c`` stays with: a letter, a digit, a sign or white space."""
        return next((a for a in "a1.\n" if len(pieces(a + c)) == 1), None)

    unsure = [c for c in points if classed(c, split) != classed(c, tokens)]
    return quick, re.compile("[" + "".join(map(re.escape, unsure)) + "\U00010000-\U0010ffff]")


@lru_cache(maxsize=2)
def _load(first: str, second: str) -> Tokenizers:
    return Tokenizers(_path(first), _path(second))


class Aligned(NamedTuple):
    """Some texts' ids one after the other, cut into groups where tokens of both sides end.

    ``docs`` is the text of each group.  Links of a text's pair of ids are in
    ``link_docs, link_pairs, link_counts``; one pair may have several rows.
    """

    a: np.ndarray
    b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    docs: np.ndarray
    link_docs: np.ndarray
    link_pairs: np.ndarray
    link_counts: np.ndarray


def align(first: list[np.ndarray], second: list[np.ndarray], sizes_a: np.ndarray, sizes_b: np.ndarray) -> Aligned:
    """Groups and links of a few texts at once."""
    a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (first, second))
    ends_a, ends_b = np.cumsum(sizes_a[a]), np.cumsum(sizes_b[b])
    # Texts cover the same bytes on both sides, so each text's end is a common end.
    at = np.searchsorted(ends_b, ends_a)
    common_a = ends_b[at] == ends_a if len(a) else np.zeros(0, bool)
    common_b = np.zeros(len(b), bool)
    common_b[at[common_a]] = True
    group_a, group_b = np.cumsum(common_a) - common_a, np.cumsum(common_b) - common_b
    n_groups = int(common_a.sum())
    counts_a, counts_b = np.bincount(group_a, minlength=n_groups), np.bincount(group_b, minlength=n_groups)
    owner = np.repeat(np.arange(len(first)), [len(x) for x in first])
    starts_a, starts_b = np.cumsum(counts_a) - counts_a, np.cumsum(counts_b) - counts_b
    docs = owner[starts_a]
    wide = counts_a * counts_b > WIDE
    # Each first token with all second tokens of its group.
    times = np.where(wide[group_a], 0, counts_b[group_a])
    left = np.repeat(np.arange(len(a)), times)
    inside = np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times)
    pairs = a[left] * _PAIR + b[starts_b[group_a[left]] + inside]
    found = [(owner[left], pairs, np.ones(len(left), np.int64))]
    for g in np.flatnonzero(wide):
        x, n = np.unique(a[starts_a[g]:starts_a[g] + counts_a[g]], return_counts=True)
        y, m = np.unique(b[starts_b[g]:starts_b[g] + counts_b[g]], return_counts=True)
        links = (n[:, None] * m[None, :]).ravel()
        found.append((np.full(len(links), docs[g]), (x[:, None] * _PAIR + y[None, :]).ravel(), links))
    return Aligned(a, b, group_a, group_b, docs, *(np.concatenate(c) for c in zip(*found, strict=True)))


def _digests(t: Tokenizers, x: Aligned, n: int) -> list[str]:
    """SHA-256 of ``a1,a2|b1;a3|b2,b3`` per text; empty where it has no tokens."""
    last_a, last_b = (np.append(g[1:] != g[:-1], True) if len(g) else np.zeros(0, bool) for g in (x.group_a, x.group_b))
    before_b = np.searchsorted(x.group_b, x.group_a, side="left")  # second tokens in earlier groups
    before_a = np.searchsorted(x.group_a, x.group_b, side="right")  # first tokens up to this group
    text = np.empty(len(x.a) + len(x.b), dtype=object)
    text[np.arange(len(x.a)) + before_b] = t.written_a[x.a * 2 + last_a]
    text[np.arange(len(x.b)) + before_a] = t.written_b[x.b * 2 + last_b]
    sizes = np.bincount(x.docs[x.group_a], minlength=n) + np.bincount(x.docs[x.group_b], minlength=n)
    ends = np.cumsum(sizes)
    return [hashlib.sha256("".join(text[e - s:e].tolist())[:-1].encode()).hexdigest() if s else "" for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]


class _Tally:
    """Documents per pair of ids, added up in sorted arrays."""

    def __init__(self):
        self.codes, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.new: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, codes: np.ndarray, counts: np.ndarray) -> None:
        self.new.append((codes, counts))
        self.size += len(codes)
        if self.size >= HELD:
            self.merge()

    def merge(self) -> None:
        codes = np.concatenate([self.codes, *[c for c, _ in self.new]])
        counts = np.concatenate([self.counts, *[n for _, n in self.new]])
        order = np.argsort(codes, kind="stable")
        codes, counts = codes[order], counts[order]
        starts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.zeros(0, np.int64)
        self.codes, self.counts = codes[starts], np.add.reduceat(counts, starts) if len(starts) else counts
        self.new, self.size = [], 0


_MEASURES = ["n_a", "n_b", "n_groups", "n_links"]
_ENCODED = "_digest string, _n long, ids binary, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pair long, docs long"
_COLUMNS = [c.split()[0] for c in _ENCODED.split(", ")]
_KINDS = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}


def _batch(columns: dict, rows: int) -> pa.RecordBatch:
    kinds = {c.split()[0]: _KINDS[c.split()[1]] for c in _ENCODED.split(", ")}
    return pa.RecordBatch.from_arrays([pa.array(columns[c], kinds[c]) if c in columns else pa.nulls(rows, kinds[c]) for c in _COLUMNS], _COLUMNS)


def _chunks(batches: Iterator[pa.RecordBatch], size, limit: int) -> Iterator[list[tuple]]:
    """Rows of a partition, some at a time: those whose sizes add up to ``limit``, or one alone."""
    held, total = [], 0
    for batch in batches:
        for row in zip(*batch.columns, strict=True):
            values = tuple(v.as_py() for v in row)
            if held and total + size(values) > limit:
                yield held
                held, total = [], 0
            held.append(values)
            total += size(values)
    if held:
        yield held


def _packed(a: np.ndarray, b: np.ndarray) -> bytes:
    """Ids of a text, compressed: how many the first has, then all, low bytes apart from high ones."""
    both = np.concatenate([[len(a)], a, b]).astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.compress(np.ascontiguousarray(both).tobytes(), 3)


def _unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(4, -1)
    both = np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)
    return both[1:1 + both[0]], both[1 + both[0]:]


def _encode(first: str, second: str):
    """Each text's ids and sizes, and the pair counts of all texts of the task as rows of their own."""

    def counted(tally: _Tally) -> Iterator[pa.RecordBatch]:
        tally.merge()
        for at in range(0, len(tally.codes), 100_000):
            part = slice(at, at + 100_000)
            yield _batch({"pair": tally.codes[part], "docs": tally.counts[part]}, len(tally.codes[part]))
        tally.codes = tally.counts = np.zeros(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, tally = _load(first, second), _Tally()
        for rows in _chunks(batches, lambda r: len(r[0]), TOGETHER):
            texts, times, digests = zip(*rows, strict=True)
            a, b = t.encode(list(texts))
            x = align(a, b, t.sizes_a, t.sizes_b)
            size = len(texts)
            # The different pairs of each text; text, first and second id fit one number (20 bits are more texts than a chunk has).
            dense = (x.link_docs * len(t.sizes_a) + (x.link_pairs >> 32)) * len(t.sizes_b) + (x.link_pairs & (_PAIR - 1))
            docs, pair = np.divmod(np.unique(dense), len(t.sizes_a) * len(t.sizes_b))
            tally.add((pair // len(t.sizes_b)) * _PAIR + pair % len(t.sizes_b), np.array(times, np.int64)[docs])
            links = np.bincount(x.link_docs, weights=x.link_counts, minlength=size).astype(np.int64)
            yield _batch({"_digest": digests, "_n": times, "ids": list(map(_packed, a, b)), "n_a": list(map(len, a)), "n_b": list(map(len, b)),
                          "n_groups": np.bincount(x.docs, minlength=size), "n_links": links, "groups_sha256": _digests(t, x, size)}, size)
            if len(tally.codes) >= HELD:
                yield from counted(tally)
        yield from counted(tally)

    return run


def distinct_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``_text, _n, _digest``: each different text that is neither null nor empty, how many rows have it, and its SHA-256.

    Rows are grouped by the whole text; equal ones are merged inside each task
    first, so a text that a third of all rows hold is one row per task.
    """
    texts = docs.select(F.col(text).alias("_text")).where(F.col("_text") != "").groupBy("_text").agg(F.count(F.lit(1)).alias("_n"))
    return texts.withColumn("_digest", F.sha2("_text", 256))


def encoded_texts(docs: DataFrame, text: str = "text", first: str = FIRST, second: str = SECOND) -> DataFrame:
    """Each different text encoded and aligned once, written: rows with a ``_digest`` are texts, the others pair counts of a task."""
    texts = distinct_texts(docs, text).select("_text", "_n", "_digest")
    return materialize(texts.mapInArrow(_encode(first, second), _ENCODED), "align-encoded")


def pair_counts(encoded: DataFrame) -> DataFrame:
    """``a, b, docs``: in how many documents the ids ``a`` and ``b`` are linked.

    Tasks have added up their own counts (a bounded number of pairs at a
    time), so what is exchanged grows with the vocabularies in use.
    """
    return encoded.where("pair is not null").groupBy("pair").agg(F.sum("docs").alias("docs")).select(
        F.shiftright("pair", 32).cast("int").alias("a"), F.col("pair").bitwiseAND(_PAIR - 1).cast("int").alias("b"), "docs")


def _shards(pairs: DataFrame) -> list[tuple[int, int]]:
    """Ranges of first ids with at most :data:`SHARD` pairs each; there are no more rows to look at than ids in the vocabulary."""
    out, start, held = [], 0, 0
    for a, n in sorted(pairs.groupBy("a").count().collect()):
        if held and held + n > SHARD:
            out.append((start, a))
            start, held = a, 0
        held += n
    return [*out, (start, 2**31 - 1)]


def _sums(first: str, second: str, shard):
    """Sums of the shard's pair counts over each text's links, and how many of these are best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _load(first, second)
        codes, counts, best = shard.value
        for rows in _chunks(batches, lambda r: len(r[1]), TOGETHER_IDS):
            digests, raw = zip(*rows, strict=True)
            a, b = zip(*map(_unpacked, raw), strict=True)
            x = align(list(a), list(b), t.sizes_a, t.sizes_b)
            at = np.minimum(np.searchsorted(codes, x.link_pairs), max(len(codes) - 1, 0))
            here = np.flatnonzero(codes[at] == x.link_pairs) if len(codes) else np.zeros(0, np.int64)
            total, top = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
            np.add.at(total, x.link_docs[here], x.link_counts[here] * counts[at[here]])
            np.add.at(top, x.link_docs[here], x.link_counts[here] * best[at[here]])
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(top), pa.array(total)], ["_digest", "n_best", "count_sum"])

    return run


def link_sums(encoded: DataFrame, first: str = FIRST, second: str = SECOND) -> DataFrame:
    """``_digest, n_best, count_sum`` of each different text.

    Pair counts go to every task in shards of at most :data:`SHARD` pairs (one
    first id has at most as many pairs as the second vocabulary has pieces);
    each shard is one pass over the ids, and sums of passes are added.  How
    many there are depends on the vocabularies, not on the number of texts.
    """
    spark = encoded.sparkSession
    pairs = materialize(pair_counts(encoded), "align-pairs")
    top = pairs.groupBy("a").agg(F.max("docs").alias("_most"))
    marked = materialize(pairs.join(F.broadcast(top), "a").withColumn("best", F.col("docs") == F.col("_most")).drop("_most"), "align-marked")
    texts = encoded.where("n_links > 0").select("_digest", "ids")
    done = None
    for low, high in _shards(marked):
        part = marked.where((F.col("a") >= low) & (F.col("a") < high)).toPandas()
        codes = part["a"].to_numpy(np.int64) * _PAIR + part["b"].to_numpy(np.int64)
        order = np.argsort(codes)
        shard = spark.sparkContext.broadcast((codes[order], part["docs"].to_numpy(np.int64)[order], part["best"].to_numpy(np.int64)[order]))
        sums = materialize(texts.mapInArrow(_sums(first, second, shard), "_digest string, n_best long, count_sum long"), f"align-sums-{uuid.uuid4().hex[:8]}")
        shard.destroy()
        done = sums if done is None else done.unionByName(sums)
    return done.groupBy("_digest").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


_RESULT = [*_MEASURES, "n_best", "count_sum", "groups_sha256"]


def align_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", first: str = FIRST, second: str = SECOND) -> DataFrame:
    """``key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row.

    Both tokenizers encode space + text without special tokens.  Byte offsets
    where a token of each ends cut the tokens into groups; all pairs of tokens
    within a group are links.  A pair's count is the number of documents
    (rows) that have it linked; ``count_sum`` adds the counts up over a
    document's links, and ``n_best`` is how many of them have the highest
    count that their first id has anywhere.  ``groups_sha256`` is of
    ``a1,a2|b1;a3|b2,b3``.

    Each different text is encoded and aligned once, whatever the number of
    rows that hold it, and its ids are kept for the second look, when counts
    are known.  Null and empty texts, and those that either side doesn't give
    back byte for byte (U+2581 becomes a space), have no tokens: zeros, and an
    empty digest; they count for nothing.  Keys may be null or repeat; other
    columns are not read; an empty table gives none.
    """
    encoded = encoded_texts(docs, text, first, second)
    texts = encoded.where("_digest is not null").select("_digest", "_n", *_MEASURES, "groups_sha256")
    measures = materialize(texts.join(link_sums(encoded, first, second), "_digest", "left").select(
        "_digest", "_n", *_MEASURES, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")], "groups_sha256"), "align-measures")
    rows = docs.select(F.col(key).alias("_key"), F.when(F.col(text) != "", F.sha2(F.col(text), 256)).alias("_digest"))
    total = measures.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    hot = heavy(measures.where("_n > 1"), "_n", total)
    out = join_unique(rows.where("_digest is not null"), measures, ["_digest"], hot).select("_key", *_RESULT)
    none = rows.where("_digest is null").select(
        "_key", *[F.lit("" if c == "groups_sha256" else 0).cast("string" if c == "groups_sha256" else "long").alias(c) for c in _RESULT])
    return out.unionByName(none).withColumnRenamed("_key", key)


@query("op12_alignment")
def alignment(spark, sf):
    return align_documents(table(spark, sf, "documents"))
