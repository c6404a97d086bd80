"""What a session remembers between micro-batches, as keyed state."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from palimpsest.functions import text as T
from palimpsest.operators import dialogue

#: Sentences in one part of a word's list.
LIST_PART = 256
#: Words and places in a bucket, about: what is rewritten when a sentence is added.
BUCKET = 512
#: Turns that a micro-batch remembers having read.
TURNS = 1024
#: What JSON leaves out of a turn.
NOTHING = dict.fromkeys(("turn", "may", "blank", "subject", "core", "said_tokens", "core_tokens", "subject_tokens"))
#: Before a text that was cited; no word has it.
CITED = "\0"


def prepared_turns(turns: DataFrame, session: str, turn: str, role: str, text: str) -> DataFrame:
    """Everything about a turn that can be told without its session, in one column as JSON: a session's rows are handed over one by one, which costs by the column."""
    said = F.coalesce(F.col(text), F.lit(""))
    user = F.col(role).eqNullSafe(F.lit("user"))
    rows = turns.select(session, F.col(turn).cast("bigint").alias("turn"), user.alias("asks"), said.alias("said"))
    none = F.array().cast("array<string>")

    def asked(column):
        return F.when(F.col("asks"), column)

    rows = rows.select(
        session, "turn", "asks", "said", asked(dialogue.may_follow(F.col("said"))).alias("may"), asked(T.strip(F.col("said")) == "").alias("blank"),
        asked(dialogue.subject_of(F.col("said"))).alias("subject"), asked(dialogue.core_of(F.col("said"))).alias("core"),
        F.when(F.col("asks"), none).otherwise(T.sentence_array(F.col("said"))).alias("sentences"))
    rows = rows.select(
        "*", *[asked(T.question_tokens(F.col(c))).alias(f"{c}_tokens") for c in ("said", "core", "subject")],
        F.transform("sentences", lambda s: F.array_join(T.question_tokens(s), " ")).alias("sentence_tokens"))
    return rows.select(session, F.to_json(F.struct(*[c for c in rows.columns if c != session])).alias("packed"))


def _home(word: str, buckets: int) -> int:
    """The bucket of a word among ``buckets`` (linear hashing: one more bucket takes its words from one other)."""
    i, top = zlib.crc32(word.encode()), 1 << (buckets - 1).bit_length()
    return i % top if i % top < buckets else i % (top // 2)


class SessionMemory(StatefulProcessor):
    """Topic, sentences and cited texts of a session.

    Sentences are kept by turn and found through the words they hold.  A word's
    list is kept in full parts of :data:`LIST_PART` and a rest; the rests lie
    in buckets of about :data:`BUCKET` entries, one more of which is split off
    another when they are full.  A question reads the buckets of its own words
    and their lists only, the shortest first, and stops when what is left can't
    beat the ``k`` sentences it has.  So a micro-batch costs what it holds and
    asks, not what the session has said.  Each value is read and written once
    in a micro-batch, and nothing is read of a session without any, as a call
    to the store costs more than what is done with its answer.  Entries end
    ``ttl_ms`` after they were written, if it is given.
    """

    def __init__(self, k: int, ttl_ms: int | None):
        self.k, self.ttl_ms = k, ttl_ms

    def init(self, handle) -> None:
        ttl = self.ttl_ms
        self.session = handle.getValueState("session", "talk string, buckets bigint, entries bigint", ttl)
        self.sentences = handle.getMapState("sentences", "para bigint", "said string", ttl)
        self.rests = handle.getMapState("rests", "bucket bigint", "words string", ttl)
        self.lists = handle.getMapState("lists", "word string, part bigint", "places string", ttl)

    def close(self) -> None:
        pass

    def _open(self, now: int) -> None:
        """Begin a session's micro-batch."""
        self._now = now
        known = self.session.get()
        self._new = known is None
        talk, buckets, entries = known or (None, 1, 0)
        self._buckets, self._entries = int(buckets), int(entries)
        self._read: dict[int, dict] = {}
        self._changed: set[int] = set()
        self._turns: dict[int, list] = {}
        #: When the topic was written, topic, its words, the first turn that said something.
        self._talk = json.loads(talk) if talk else None
        if self._talk and not self._lively([0, self._talk[0]]):
            self._talk = None

    def _save(self) -> None:
        """Write what the micro-batch has changed."""
        if self.ttl_ms:
            for at in self._changed:
                ended = [w for w, entry in self._read[at].items() if not self._lively(entry)]
                self._entries -= sum(len(self._read[at].pop(w)) // 2 for w in ended)
        while self._entries > BUCKET * self._buckets:
            before, self._buckets = self._buckets, self._buckets + 1
            source = before - (1 << (before.bit_length() - 1))
            bucket = self._bucket(source)
            self._read[before] = {w: bucket.pop(w) for w in [w for w in bucket if _home(w, self._buckets) == before]}
            self._changed |= {source, before}
        for at in sorted(self._changed):
            self.rests.updateValue((at,), (json.dumps(self._read[at], ensure_ascii=False),))
        self.session.update((json.dumps(self._talk, ensure_ascii=False) if self._talk else None, self._buckets, self._entries))

    def _bucket(self, at: int) -> dict[str, list]:
        """Words of a bucket: ``[size of the list, when it was written, turn, sentence, turn, sentence, ...]`` with the rest of the list.

        A text cited is a word that begins with :data:`CITED`, without a list.
        """
        if at not in self._read:
            found = None if self._new else self.rests.getValue((at,))
            self._read[at] = json.loads(found[0]) if found else {}
        return self._read[at]

    def _lively(self, entry: list | None) -> bool:
        return entry is not None and (not self.ttl_ms or entry[1] + self.ttl_ms > self._now)

    def _turn(self, para: int) -> list:
        """The sentences of a turn with their words."""
        if para not in self._turns:
            if len(self._turns) >= TURNS:
                self._turns.clear()
            found = self.sentences.getValue((para,))
            self._turns[para] = json.loads(found[0]) if found else []
        return self._turns[para]

    def _hear(self, turns) -> None:
        """Add what was said; each bucket is read and written once for all of it."""
        heard: dict[int, list] = {}
        places: dict[str, list[tuple[int, int]]] = {}
        for row in turns:
            para = row.turn
            if para not in heard:
                found = None if self._new else self.sentences.getValue((para,))
                heard[para] = json.loads(found[0]) if found else []
            there = len(heard[para])  # of a turn that is sent again
            for nth, (text, packed) in enumerate(zip(row.sentences, row.sentence_tokens, strict=True)):
                if nth < there:
                    continue
                heard[para].append((text, packed))
                for word in filter(None, packed.split(" ")):
                    places.setdefault(word, []).append((para, nth))
            if len(heard[para]) > there:
                self.sentences.updateValue((para,), (json.dumps(heard[para], ensure_ascii=False),))
        if self._new and len(heard) <= TURNS:
            self._turns = heard
        for word, new in places.items():
            at = _home(word, self._buckets)
            bucket = self._bucket(at)
            self._changed.add(at)
            entry = bucket.get(word)
            if not self._lively(entry):
                self._entries += 1 - (len(entry) // 2 if entry else 0)
                entry = [0, 0]
            entry[0] += len(new)
            entry[1] = self._now
            entry += [x for place in new for x in place]
            self._entries += len(new)
            part, rest = (entry[0] - (len(entry) // 2 - 1)) // LIST_PART, entry[2:]
            while len(rest) >= 2 * LIST_PART:
                self.lists.updateValue((word, part), (json.dumps(rest[:2 * LIST_PART]),))
                part, rest = part + 1, rest[2 * LIST_PART:]
                self._entries -= LIST_PART
            bucket[word] = [*entry[:2], *rest]

    def _cited(self, said: str) -> bool:
        return self._lively(self._bucket(_home(CITED + said, self._buckets)).get(CITED + said))

    def _cite(self, said: str) -> None:
        at = _home(CITED + said, self._buckets)
        bucket = self._bucket(at)
        self._entries += CITED + said not in bucket
        bucket[CITED + said] = [0, self._now]
        self._changed.add(at)

    def _answer(self, turn: int, tokens: list[str]) -> list[tuple[int, str]]:
        """The ``k`` best sentences said before ``turn``, by share of the question's words, less if cited before; then by place."""
        found = {w: self._bucket(_home(w, self._buckets)).get(w) for w in tokens}
        entries = {w: entry for w, entry in found.items() if self._lively(entry)}
        ordered = sorted(entries, key=lambda w: (entries[w][0], w))
        best: list[tuple] = []
        seen: set[tuple[int, int]] = set()
        asked = set(tokens)
        for i, word in enumerate(ordered):
            if len(best) == self.k and (len(ordered) - i) / len(tokens) < -best[-1][0]:
                break
            rest = entries[word][2:]
            for part in range((entries[word][0] - len(rest) // 2) // LIST_PART + 1):
                # a part or a sentence that is not there has come to its end
                if 2 * LIST_PART * part + len(rest) < 2 * entries[word][0]:
                    got = self.lists.getValue((word, part))
                    listed = json.loads(got[0]) if got else []
                else:
                    listed = rest
                for at in zip(listed[::2], listed[1::2], strict=True):
                    if at[0] >= turn or at in seen:
                        continue
                    seen.add(at)
                    sentences = self._turn(at[0])
                    if at[1] >= len(sentences):
                        continue
                    said, packed = sentences[at[1]]
                    away = -(len(asked & set(packed.split(" "))) / len(tokens))
                    if len(best) == self.k and (away, *at) > best[-1][:3]:
                        continue
                    if self._cited(said):
                        away *= dialogue.CITED_PENALTY
                    best = sorted([*best, (away, *at, said)])[:self.k]
        for _, _, _, said in best:
            self._cite(said)
        return [(para, said) for _, para, _, said in best]

    def _resolve(self, row) -> tuple[str, bool, str, list[str]]:
        """Topic, whether the question follows up on it, the question in full, and its words."""
        _, topic, tokens, first = self._talk or (0, None, [], None)
        if first is None and not row.blank:
            first = row.turn
        follows = bool(row.may) and first is not None and row.turn > first
        if not follows:
            topic, tokens = row.subject, list(row.subject_tokens)
        self._talk = [self._now, topic, list(tokens or []), first]
        if not follows:
            return topic or "", False, row.said, list(row.said_tokens)
        core, own = row.core, list(row.core_tokens)
        if topic and topic in core or not topic:
            return topic or "", True, core.strip(), own
        if core == "":
            return topic, True, topic.strip(), list(tokens)
        return topic, True, f"{topic} {core}".strip(), list(dict.fromkeys([*tokens, *own]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """One session's turns of a micro-batch, which bounds what is held here."""
        turns = sorted((SimpleNamespace(**NOTHING | json.loads(packed)) for frame in rows for packed in frame["packed"]), key=lambda row: row.turn)
        out = []
        self._open(timerValues.getCurrentProcessingTimeInMs() if self.ttl_ms else 0)
        self._hear(row for row in turns if not row.asks)
        for row in turns:
            if not row.asks:
                continue
            topic, follows, resolved, tokens = self._resolve(row)
            hits = self._answer(row.turn, tokens)
            done = {"turn": row.turn, "topic": topic, "is_followup": follows, "said": row.said, "resolved": resolved, "citations": [{"para": p, "text": s} for p, s in hits]}
            out.append((key[0], json.dumps(done, ensure_ascii=False)))
        self._save()
        yield pd.DataFrame(out, columns=["session", "packed"])


def answers(turns: DataFrame, *, k: int = 3, session: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
            ttl_ms: int | None = None) -> DataFrame:
    """The columns of :func:`~palimpsest.operators.dialogue.answer_turns` for a stream of turns.

    A turn is answered in the micro-batch it comes in, from what its session
    has said under smaller turn numbers by then.  Needs the RocksDB state store.
    """
    # Exchanged before they are prepared, so that the input's files don't say how many tasks do it; the state needs the same exchange.
    rows = prepared_turns(turns.select(session, turn, role, text).repartition(session), session, turn, role, text)
    kind = rows.schema[session].dataType.simpleString()
    schema = "turn bigint, topic string, is_followup boolean, said string, resolved string, citations array<struct<para:bigint,text:string>>"
    done = rows.groupBy(session).transformWithStateInPandas(
        statefulProcessor=SessionMemory(k, ttl_ms), outputStructType=f"session {kind}, packed string", outputMode="Append", timeMode="ProcessingTime" if ttl_ms else "None")
    done = done.select(F.col("session").alias(session), F.from_json("packed", schema).alias("p")).select(session, "p.*")
    return dialogue.finished(done, session)
