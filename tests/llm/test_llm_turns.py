"""Conversation repair against a brute-force search over whole conversations, with blocks of a few rows too."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

from palimpsest.llm import turns

SCHEMA = "conv_id long, turn long, role string, text string, _k string, cost string, _block int"  # columns with clashing names
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """Uniform-cost search over edit sequences, by cost and then audit; the roles' pattern is only tested at the end and by its beginnings."""
    agenda = [(0, "", 0, "", ())]
    done = set()
    while agenda:
        cost, audit, i, roles, out = heapq.heappop(agenda)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, out
        state = (i, roles[-1:])
        if state in done:
            continue
        done.add(state)
        fits = [r for r in ("user", "assistant") if re.fullmatch("s?(ua)*u?", roles + r[0])]
        for r in fits:
            heapq.heappush(agenda, (cost + 3, audit + "I", i, roles + r[0], (*out, r + ":")))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(agenda, (cost + 4, audit + "D", i + 1, roles, out))
            if found[i] not in ("blank", "duplicate"):
                extra = 3 * (found[i] == "truncated")
                if role and re.fullmatch("s?(ua)*u?", roles + role[0]):
                    heapq.heappush(agenda, (cost + extra, audit + "K", i + 1, roles + role[0], (*out, role + ":" + text)))
                for r in fits:
                    heapq.heappush(agenda, (cost + 3 + extra, audit + "R", i + 1, roles + r[0], (*out, r + ":" + text)))


def report(rows):
    """The contract's columns per conversation, from ``(conv, turn, role, text)``."""
    convs = defaultdict(list)
    for conv, *row in rows:
        convs[conv].append((row[0], " " if row[1] is None else row[1], " " if row[2] is None else row[2]))
    out = {}
    for conv, found in convs.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        bad = faults(found)
        numbered = {r[0] for r in found if r[0] is not None}
        gaps = max(numbered) - min(numbered) + 1 - len(numbered) if numbered else 0
        initials = [r[1][:1] for r in found]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        cost, audit, text = cheapest(found, bad)
        out[conv] = (gaps, *[bad.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(text).encode()).hexdigest())
    return out


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA)


def check(spark, rows):
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    whole, after = {r[0] for r in rows}, damage(rows)
    want = report(after)
    df = frame(spark, rows)
    got = turns.repair_report(df, turns.damaged(df))
    assert got.columns == COLUMNS
    assert sorted([tuple(r) for r in got.collect()], key=repr) == sorted([(c, *want.get(c, nothing)) for c in whole], key=repr)


def random_rows(seed, convs, most):
    rng = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "User", "usher"]
    texts = ["One.", "Two!", "Three?", "cut", "cut off \n", "", None, " \t", "One.", "late. \x0b", "é", "a.\nb", ". x", "\x1c", "end.\x1c"]
    rows = []
    for c in range(convs):
        for t in range(rng.randint(1, most)):
            rows.append((c, rng.choice([t, t, t, t, t + 3, None, 0]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.6 else f"text {rng.random()}."))
    return rows


def test_search_is_optimal():
    """Every start is the beginning, every end lawful: against brute force on short rows of codes."""
    rng = random.Random(3)
    full = {"s": "system", "u": "user", "a": "assistant", "o": "tool"}
    for _ in range(400):
        codes = "".join(rng.choice("sSuuuUaaaAoOxx") for _ in range(rng.randint(0, 9)))
        rows = [(i, full.get(c.lower(), "user"), f"{i}.") for i, c in enumerate(codes)]
        found = ["blank" if c == "x" else "truncated" if c.isupper() else "" for c in codes]
        want = cheapest(rows, found)
        got = min(filter(None, (turns.search(codes, "-", g) for g in "-a")))
        assert got == want[:2], codes
        out = [full[codes[i].lower()] if r is None else r for i, r in turns.replay(codes, "-", got[1])]
        assert out == [x.split(":")[0] for x in want[2]]


def test_search_is_short_on_long_rows():
    assert turns.search("su" + "ua" * 511, "-", "a")[0] > 0
    assert turns.search("uuuuuuuu" * 128, "-", "a") == (3 * 512, "KR" * 512)
    assert turns.search("s" * 1024, "-", "-") == (4096, "D" * 1024)


def test_against_brute_force(spark):
    rows = random_rows(1, 60, 9)
    rows += [(None, 1, "user", "Hello."), (None, 2, "assistant", "Yes."), (None, None, None, None)]
    rows += [(900, 0, "user", "Again.")] * 7 + [(901, t, "user", "Same.") for t in range(30)] + [(902, None, "system", "x.")] * 2
    rows += [(903, 5, "user", "long " * 40_000 + "."), (903, 9, "assistant", "ok.")]
    check(spark, rows)


def test_long_conversations_in_small_blocks(spark, monkeypatch):
    """Blocks of four rows, combined two at a time: many rounds, the same results."""
    monkeypatch.setattr(turns, "BLOCK_BITS", 2)
    monkeypatch.setattr(turns, "FAN", 2)
    check(spark, random_rows(2, 8, 60) + [(50, t, "ua"[t % 2].replace("u", "user").replace("a", "assistant"), f"{t}.") for t in range(150)])


def test_one_conversation_holds_most_rows(spark):
    rng = random.Random(9)
    rows = [(1, t, rng.choice(["user", "assistant"]), rng.choice(["Yes.", f"t {t}.", f"c {t}"])) for t in range(1500)] + random_rows(4, 5, 4)
    check(spark, rows)


def test_repaired_rows(spark):
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "user", "Why?"), (1, 2, "user", "How?"), (2, 0, "system", "Be."), (2, 1, "user", "A."), (2, 2, "assistant", "B.")]
    fixed = turns.repair(frame(spark, rows)).rows.orderBy("_conv", "_pos", "_seq").select("_conv", "role", "text").collect()
    assert [tuple(r) for r in fixed if r[0] == 2] == [(2, "system", "Be."), (2, "user", "A."), (2, "assistant", "B.")]
    assert [r.role for r in fixed if r[0] == 1] == ["user", "assistant"] * (len([r for r in fixed if r[0] == 1]) // 2)


def test_empty_table(spark):
    assert turns.repair_report(frame(spark, []), turns.damaged(frame(spark, []))).count() == 0
    lone = frame(spark, [(3, 1, "user", "a.")])
    assert [tuple(r)[:7] for r in turns.repair_report(lone, frame(spark, [])).collect()] == [(3, 0, 0, 0, 0, 0, 0)]


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query_on_the_table(spark, sf):
    path = f"/root/testdata/{sf}"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = report(damage(rows))
    got = {r[0]: tuple(r)[1:] for r in turns.QUERIES["op11_conversations"](spark, path).collect()}
    assert {c: got[c] for c in want} == want and got.keys() == {r[0] for r in rows}
