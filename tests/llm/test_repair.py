"""Conversation repair against searches that know nothing of tables, bands and chunks."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from souk.llm import queries, repair

KIND = "conv_id bigint, turn bigint, role string, text string"


def cheapest(turns):
    """(cost, audit) by a search over (turns used, roles so far by phase), cheapest and then least audit first."""
    seen, heap = set(), [(0, "", 0, 0)]
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    while heap:
        cost, audit, i, phase = heapq.heappop(heap)
        if i == len(turns) and phase in (0, 3):
            return cost, audit
        if len(audit) > 3 * len(turns) + 4:
            continue
        key = (cost, audit, i, phase)
        if key in seen:
            continue
        seen.add(key)
        for role in "ua":
            if (phase, role) in step:
                heapq.heappush(heap, (cost + 2, audit + "I", i, step[phase, role]))
        if i == len(turns):
            continue
        role, fault = turns[i]
        heapq.heappush(heap, (cost + 3, audit + "D", i + 1, phase))
        if fault in (repair.BLANK, repair.DUPLICATE):
            continue
        extra = fault == repair.TRUNCATED
        if (phase, role) in step:
            heapq.heappush(heap, (cost + extra, audit + "K", i + 1, step[phase, role]))
        for to in "ua":
            if (phase, to) in step:
                heapq.heappush(heap, (cost + 2 + extra, audit + "R", i + 1, step[phase, to]))


def by_phases(turns):
    """(cost, audit) in time linear in the turns: costs from each turn and phase on, then the least initial that keeps them."""
    far, n = 1 << 30, len(turns)
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    cost = [[far] * 4 for _ in range(n + 1)]
    cost[n][0] = cost[n][3] = 0

    def moves(i, p):
        out = [("I", 2, i, step[p, r]) for r in "ua" if (p, r) in step]
        if i < n:
            role, fault = turns[i]
            out.append(("D", 3, i + 1, p))
            if fault not in (repair.BLANK, repair.DUPLICATE):
                extra = int(fault == repair.TRUNCATED)
                out += [("K", extra, i + 1, step[p, role])] if (p, role) in step else []
                out += [("R", 2 + extra, i + 1, step[p, r]) for r in "ua" if (p, r) in step]
        return out

    for i in range(n, -1, -1):
        for _ in range(4):
            for p in range(4):
                cost[i][p] = min([cost[i][p], *[c + cost[j][q] for _, c, j, q in moves(i, p)]])
    out, at = [], {(0, 0)}
    left = cost[0][0]
    while not any(i == n and p in (0, 3) for i, p in at):
        options = {}
        for i, p in at:
            for letter, c, j, q in moves(i, p):
                if c + cost[j][q] == left:
                    options.setdefault(letter, (c, set()))[1].add((j, q))
        letter = min(options)
        out.append(letter)
        left -= options[letter][0]
        at = options[letter][1]
    return cost[0][0], "".join(out)


TURN = st.tuples(st.sampled_from("suaua "), st.sampled_from([0, 0, 0, 1, 2, 3]))


@settings(max_examples=150, deadline=None)
@given(st.lists(TURN, max_size=5))
def test_small_conversations_against_a_whole_search(turns):
    assert repair.align(turns) == cheapest(turns) == by_phases(turns)


@settings(max_examples=300, deadline=None)
@given(st.lists(TURN, max_size=40), st.integers(1, 9))
def test_chunks_do_not_matter(turns, chunk):
    assert repair.align(turns, chunk) == by_phases(turns)


def test_long_conversation():
    dice = random.Random(3)
    turns = [(dice.choice("uuaas "), dice.choice([0, 0, 0, 0, 1, 2, 3])) for _ in range(5000)]
    assert repair.align(turns) == by_phases(turns)


def expected(rows):
    """The contract, row by row."""
    blank = lambda v: " " if v is None else str(v)
    out = {}
    for conv in {r[0] for r in rows}:
        kept = []
        for _, turn, role, text in [r for r in rows if r[0] == conv]:
            h = zlib.crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20
            role, text = blank(role), blank(text)
            if h == 0:
                continue
            text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
            kept += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        numbers = [r[0] for r in kept if r[0] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        turns, seen = [], set()
        for _, role, text in kept:
            body = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = repair.BLANK if not body else repair.DUPLICATE if (role, text) in seen else repair.TRUNCATED if body[-1] not in ".!?" else repair.NONE
            seen.add((role, text))
            turns.append((role[:1] if role[:1] in ("s", "u", "a") else " ", fault))
        cost, audit = by_phases(turns)
        fixed, i, phase = [], 0, "u"
        for edit in audit:
            if edit == "I":
                fixed.append({"u": "user:", "a": "assistant:"}[phase])
                phase = "a" if phase == "u" else "u"
                continue
            _, role, text = kept[i]
            i += 1
            if edit == "D":
                continue
            if edit == "K" and role[:1] == "s":
                fixed.append(f"{role}:{text}")
                continue
            fixed.append((role if edit == "K" else {"u": "user", "a": "assistant"}[phase]) + ":" + text)
            phase = "a" if phase == "u" else "u"
        n = [sum(f == k for _, f in turns) for k in range(4)]
        illegal = sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in zip(turns, turns[1:]))
        out[conv] = (gaps, n[1], n[2], n[3], illegal, cost, audit, hashlib.sha256("\n".join(fixed).encode()).hexdigest())
    return out


def got(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


def test_query_against_the_contract(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    df = queries.queries()["op13_conversation_repair"](spark, sf)
    assert df.count() == len({r[0] for r in rows})
    assert got(df) == expected(rows)


ODD = [
    (1, 0, "user", "a."), (1, 0, "user", "a."), (1, 1, None, None), (1, None, "assistant", "b"), (1, None, None, "x."), (1, 5, "system", "s!"),
    (2, 7, "", ""), (2, 7, "user", "q "), (2, 8, "assistant", "é?\n\t"), (2, 9, "tool", "z."),
    (None, 3, "user", "who."), (None, 4, "assistant", "me."), (None, None, None, None),
    *[(3, i, ("user", "assistant")[i % 2], f"t{i % 7}.") for i in range(60)],
    *[(k, 0, "user", "only.") for k in range(10, 60)],
]


def test_nulls_ties_repeats_and_clashing_columns(spark):
    df = spark.createDataFrame([(*r, "x") for r in ODD], KIND + ", codes string").withColumnRenamed("codes", "audit")
    assert got(repair.damage_report(df)) == expected(ODD)
    assert repair.damage_report(df.limit(0)).count() == 0


def test_stretches_of_one_conversation_meet_in_order(spark, monkeypatch):
    monkeypatch.setattr(repair, "STRETCH", 7)
    rows = [(1, i // 2, ("user", "assistant")[i % 3 % 2], f"text {i % 50}" + ".!?,"[i % 4]) for i in range(400)]
    df = spark.createDataFrame(rows, KIND).repartition(5)
    assert got(repair.damage_report(df)) == expected(rows)


@pytest.mark.parametrize("damage", [True, False])
def test_repaired_turns_follow_the_grammar(spark, damage):
    df = repair.repaired(spark.createDataFrame([r for r in ODD if r[0] is not None], KIND), damage)
    roles = {}
    for r in df.orderBy("conv_id", "pos").collect():
        roles[r.conv_id] = roles.get(r.conv_id, "") + r.role[:1]
    assert roles and all(re.fullmatch("(s?(ua)+)?", v) for v in roles.values())
