"""Repair of conversations: the cheapest edits that make their roles follow ``(s?(ua)+)?``, by Wagner-Fischer alignment to target strings.

The turns of a conversation, in order, are aligned to the grammar's strings of each
feasible length (with or without ``s``). Aligned from the end, all strings that end
alike share one table: cell (i, r) is the least cost of turning the turns from i on
into the last r characters, so one pass of the recurrence serves every length.
*Band*: a plain left-to-right repair gives an incumbent cost; a cell whose length
differs so much that its insertions or deletions alone cost more is left out.
*Audit*: the edits' initials are read off the tables from the front, for all lengths
that tie, always by the least initial that keeps the cost; so the least audit of all is
found without listing the others.

Edits: Keep 0; Rerole to user or assistant 2; Delete 3 (a must for blank and
duplicate turns); Insert an empty user or assistant turn anywhere 2; a truncated turn
that stays adds 1.

Long conversations are cut into chunks of ``CHUNK`` turns; what a chunk needs of the
later ones is the cost from each of four phases (nothing yet, after s, after u, after
a). So work is linear in the turns and a table is bounded.

Size and skew: faults are found by plain aggregates and joins over digests; turns
are dealt by ranges of (conversation, turn), so that a hot conversation is spread,
and each stretch of at most ``STRETCH`` turns becomes one row with a byte a turn. The
audit of a conversation is one value, so these bytes meet in one place; texts do not.
The repaired text's SHA-256 is sequential, so a conversation's texts stream through
one task in order, a batch at a time.

Edge cases: a null role or text is one blank, as is a null id or turn in the damage's
key; null turns come first; rows of equal turn go by role and the text's MD5; equal
rows are told apart by number only; null ids are one conversation; an empty table
gives no rows; other columns are not read; texts of any length are only digested, cut
and hashed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.llm.common import Workspace, by_columns

BLANKS = "\t\n\x0b\x0c\r "
CHUNK = 256
STRETCH = 4096
FAR = 1 << 30
ROLES = "sua"
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
NAMES = {"u": b"user", "a": b"assistant"}


def cheap(role: str, fault: int) -> tuple[int | None, int | None]:
    """(cost of a turn that stays in role, cost of one with another role); None: must go."""
    if fault in (BLANK, DUPLICATE):
        return None, None
    return int(fault == TRUNCATED), 2 + int(fault == TRUNCATED)


def incumbent(turns: list[tuple[str, int]]) -> int:
    """Cost of a plain repair from left to right: keep what fits, insert where that helps, else change the role."""
    cost, due = 0, "u"
    for role, fault in turns:
        keep, other = cheap(role, fault)
        if keep is None:
            cost += 3
        elif role == due:
            cost, due = cost + keep, "a" if due == "u" else "u"
        elif role in "ua":
            cost += 2 + keep
        else:
            cost, due = cost + other, "a" if due == "u" else "u"
    return cost + 2 * (due == "a")


class Chunk:
    """Tables of some turns. after: least cost of what follows, by phase (0: nothing yet, 1: after s, 2: after u, 3: after a)."""

    def __init__(self, turns: list[tuple[str, int]], after: list[int], final: bool) -> None:
        n = len(turns)
        self.turns, self.after, self.n = turns, after, n
        most = incumbent(turns) + 8  # entering in another phase costs less than 8 more
        short, long = most // 3 + 1, most // 2 + 1
        width = n + long + 1
        r = np.arange(width)
        # row 0: the target ends with u, row 1: with a; need_u: the character that r asks for
        need_u = np.stack([r % 2 == 1, r % 2 == 0])
        g = np.full((n + 1, 2, width), FAR, dtype=np.int64)
        g[n, :, 0] = after[2:]
        if final:
            g[n] = np.minimum(g[n, :, :1] + 2 * r, FAR)
        for i in range(n - 1, -1, -1):
            lo, hi = max(0, n - i - short), n - i + long
            keep, other = cheap(*turns[i])
            now = g[i + 1] + 3
            if keep is not None:
                role = turns[i][0]
                cost = np.where(need_u == (role == "u"), keep, other) if role in "ua" else other
                now[:, 1:] = np.minimum(now[:, 1:], g[i + 1][:, :-1] + (cost[:, 1:] if role in "ua" else cost))
            now[:, :lo] = FAR
            now[:, hi + 1 :] = FAR
            now = np.minimum.accumulate(now - 2 * r, axis=1) + 2 * r  # insertions
            g[i] = np.minimum(now, FAR)
        self.g, self.width = g, width
        # strings that begin here, after s, or with s: by turn
        self.fresh = [self._least(i) for i in range(n + 1)]
        self.one = [min(f, 3 * (n - i) + after[1]) for i, f in enumerate(self.fresh)]
        zero = [after[0]] * (n + 1)
        for i in range(n - 1, -1, -1):
            role, fault = turns[i]
            zero[i] = min(FAR, 3 + zero[i + 1])
            if role == "s" and cheap(role, fault)[0] is not None:
                zero[i] = min(zero[i], cheap(role, fault)[0] + self.one[i + 1])
        self.zero = zero

    def _least(self, i: int) -> int:
        """Least cost of a string of one character or more that begins with u."""
        g = self.g[i]
        return int(min(g[0, 1::2].min(initial=FAR), g[1, 2::2].min(initial=FAR)))

    def before(self) -> list[int]:
        """Least cost from each phase, at the first turn."""
        g = self.g[0]
        from_a = min(self.fresh[0], int(g[1, 0]))
        from_u = int(min(g[0, 0::2].min(initial=FAR), g[1, 1::2].min(initial=FAR)))
        return [min(self.fresh[0], self.zero[0]), self.one[0], from_u, from_a]

    def _enter(self, phase: int, i: int, cost: int) -> set:
        """The targets of that cost from a phase on: (row, r), or the phases 0 and 1 where this chunk may add nothing."""
        g, found = self.g[i], set()
        begin = {2: (0, 1), 3: (1, 0)}.get(phase, (1, 2))  # least r of each row, by what is due
        for row in (0, 1):
            found |= {(row, 2 * int(k) + begin[row]) for k in np.flatnonzero(g[row, begin[row] :: 2] == cost)}
        if phase == 0 and self.zero[i] == cost:
            found.add(0)
        if phase == 1 and 3 * (self.n - i) + self.after[1] == cost:
            found.add(1)
        return found

    def audit(self, phases: set[int], cost: int) -> tuple[str, set[int], int]:
        """Least initials from some phases of equal cost on; with the phases after them, and the cost of what follows."""
        g, out = self.g, []
        states = set().union(*[self._enter(p, 0, cost) for p in phases])
        i = 0
        while True:
            if i == self.n and any(s in (0, 1) or s[1] == 0 for s in states):
                return "".join(out), {s if s in (0, 1) else 2 + s[0] for s in states if s in (0, 1) or s[1] == 0}, cost
            role, fault = self.turns[i] if i < self.n else ("", BLANK)
            keep, other = cheap(role, fault)
            options: dict[str, tuple[int, set]] = {}

            def offer(letter: str, spent: int, state) -> None:
                options.setdefault(letter, (spent, set()))[1].add(state)

            for s in states:
                if s in (0, 1):
                    left = self.zero[i + 1] if s == 0 else 3 * (self.n - i - 1) + self.after[1]
                    if 3 + left == cost:
                        offer("D", 3, s)
                    if s == 0 and role == "s" and keep is not None and keep + self.one[i + 1] == cost:
                        for t in self._enter(1, i + 1, cost - keep):
                            offer("K", keep, t)
                    continue
                row, r = s
                if i < self.n and 3 + g[i + 1, row, r] == cost:
                    offer("D", 3, s)
                if r and 2 + g[i, row, r - 1] == cost:
                    offer("I", 2, (row, r - 1))
                if r and keep is not None:
                    due = "u" if (r % 2 == 1) == (row == 0) else "a"
                    if role == due and keep + g[i + 1, row, r - 1] == cost:
                        offer("K", keep, (row, r - 1))
                    elif role != due and other + g[i + 1, row, r - 1] == cost:
                        offer("R", other, (row, r - 1))
            letter = min(options)
            spent, states = options[letter]
            out.append(letter)
            cost -= spent
            i += letter != "I"


def align(turns: list[tuple[str, int]], chunk: int = CHUNK) -> tuple[int, str]:
    """Least cost and its least audit."""
    cuts = [turns[i : i + chunk] for i in range(0, len(turns), chunk)] or [[]]
    afters = [[0, FAR, FAR, 0]]
    for k in range(len(cuts) - 1, 0, -1):
        afters.append(Chunk(cuts[k], afters[-1], k == len(cuts) - 1).before())
    phases, out, least = {0}, [], None
    for k, turns_of in enumerate(cuts):
        table = Chunk(turns_of, afters[len(cuts) - 1 - k], k == len(cuts) - 1)
        if least is None:
            least = left = table.before()[0]
        letters, phases, left = table.audit(phases, left)
        out.append(letters)
    return least, "".join(out)


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, times``: faults set by the key's CRC-32; times 0: dropped, 2: repeated."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    text = F.when(h == 1, "").when(h == 2, F.translate(blank("text"), ".!?", "")).otherwise(blank("text"))
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.when(h == 4, "user").otherwise(blank("role")).alias("role"), text.alias("text"), F.when(h == 0, 0).when(h == 3, 2).otherwise(1).alias("times"))


def as_they_are(rows: DataFrame) -> DataFrame:
    """Rows without damage, in the shape of :func:`damaged`."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"), F.lit(1).alias("times"))


def faults(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, digest`` of distinct rows, with ``codes``: a character for each time the row stands, for its role's initial and its first fault."""
    said = F.rtrim(F.col("text"), F.lit(BLANKS))
    gone = F.col("times") == 0
    none = lambda c: F.when(~gone, F.col(c))
    facts = turns.select("conv_id", none("turn").alias("turn"), none("role").alias("role"), F.when(~gone, F.md5("text")).alias("digest"), "times", (said == "").alias("blank"), (~F.substring(said, -1, 1).isin(".", "!", "?")).alias("cut"))
    rows = facts.groupBy("conv_id", "turn", "role", "digest").agg(F.sum("times").alias("times"), F.max("blank").alias("blank"), F.max("cut").alias("cut"))
    at = F.struct(F.col("turn").isNotNull(), "turn")
    firsts = rows.groupBy(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("digest").alias("_d")).agg(F.min(at).alias("first"))
    met = rows.join(firsts, F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("role").eqNullSafe(F.col("_r")) & F.col("digest").eqNullSafe(F.col("_d")))
    role = F.when(F.col("role").startswith("s"), 0).when(F.col("role").startswith("u"), 1).when(F.col("role").startswith("a"), 2).otherwise(3)
    code = lambda fault: F.char(48 + 4 * role + fault)
    fresh = F.when(F.col("blank"), BLANK).when(~F.col("turn").eqNullSafe(F.col("first")["turn"]), DUPLICATE).when(F.col("cut"), TRUNCATED).otherwise(NONE)
    again = F.when(F.col("blank"), BLANK).otherwise(DUPLICATE)
    codes = F.when(F.col("times") > 0, F.concat(code(fresh), F.repeat(code(again), F.col("times").cast("int") - 1))).otherwise("")
    return met.select("conv_id", "turn", "role", "digest", codes.alias("codes"))


def stretches(facts: DataFrame) -> DataFrame:
    """``conv_id, at, lo, hi, turns, codes``: a row for some thousand turns in order; lo, hi, turns: first, last and number of different turns."""

    def condense(batches):
        part, number, now, held, size = TaskContext.get().partitionId(), 0, None, [], 0

        def row():
            seen = [t for t, _ in held if t is not None]
            return now, (part << 32) + number, seen[0] if seen else None, seen[-1] if seen else None, len(set(seen)), "".join(c for _, c in held)

        def batch_of(rows):
            kinds = [pa.int64()] * 5 + [pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["conv_id", "at", "lo", "hi", "turns", "codes"])

        for batch in batches:
            rows = []
            for conv, turn, codes in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
                if held and (conv != now or size >= STRETCH):
                    rows.append(row())
                    number, held, size = number + 1, [], 0
                now = conv
                held.append((turn, codes))
                size += max(len(codes), 1)
            if rows:
                yield batch_of(rows)
        if held:
            yield batch_of([row()])

    order = ["conv_id", "turn", "role", "digest"]
    dealt = facts.repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.select("conv_id", "turn", "codes").mapInArrow(condense, "conv_id bigint, at bigint, lo bigint, hi bigint, turns bigint, codes string")


REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def report(parts: list[dict]) -> tuple:
    """gaps, counts of faults, illegal neighbours, cost and audit of one conversation's stretches, in order."""
    parts = sorted(parts, key=lambda p: p["at"])
    met = [p for p in parts if p["lo"] is not None]
    shared = sum(a["hi"] == b["lo"] for a, b in zip(met, met[1:]))
    gaps = max(p["hi"] for p in met) - min(p["lo"] for p in met) + 1 - (sum(p["turns"] for p in met) - shared) if met else 0
    turns = [((ROLES + " ")[(ord(c) - 48) // 4], (ord(c) - 48) % 4) for p in parts for c in p["codes"]]
    n = [0] * 4
    for _, f in turns:
        n[f] += 1
    illegal = sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in zip(turns, turns[1:]))
    cost, audit = align(turns)
    return gaps, n[BLANK], n[DUPLICATE], n[TRUNCATED], illegal, cost, audit


def reports(facts: DataFrame) -> DataFrame:
    """A row a conversation: ``conv_id``, the counts, ``cost`` and ``audit``."""
    whole = stretches(facts).groupBy("conv_id").agg(F.collect_list(F.struct("at", "lo", "hi", "turns", "codes")).alias("parts"))  # a row for some thousand turns

    def each(parts):
        rows = [report(p) for p in parts.to_pylist()]
        kinds = [pa.int64()] * 6 + [pa.string()]
        return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], [*REPORT, "audit"])

    found = by_columns(each, "struct<" + ",".join(f"{c}:bigint" for c in REPORT) + ",audit:string>")("parts")
    return whole.select("conv_id", found.alias("f")).select("conv_id", "f.*")


class Repaired:
    """Applies an audit to turns as they come."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.out, self.system = audit, 0, 0, 0

    def _due(self) -> str:
        return "ua"[(self.out - self.system) % 2]

    def inserted(self):
        """(role, text) of the turns inserted before the next one."""
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            yield NAMES[self._due()], b""
            self.at, self.out = self.at + 1, self.out + 1

    def turn(self, role: str, text: str):
        yield from self.inserted()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit == "D":
            return
        self.system += role.startswith("s") and edit == "K" and self.out == 0
        yield (role.encode("utf-8", "surrogatepass") if edit == "K" else NAMES[self._due()]), text.encode("utf-8", "surrogatepass")
        self.out += 1


def _streamed(turns: DataFrame, found: DataFrame, run, kind: str) -> DataFrame:
    """Each conversation's report, then its turns in order, through one task."""
    kinds = {"conv_id": "bigint", "turn": "bigint", "role": "string", "text": "string", "times": "int", "digest": "string", "audit": "string", **{c: "bigint" for c in REPORT}}
    none = lambda names: [F.lit(None).cast(kinds[c]).alias(c) for c in names]
    heads = found.select("conv_id", *none(["turn", "role", "text", "times", "digest"]), "audit", *REPORT, F.lit(0).alias("kind"))
    rows = turns.where("times > 0").select("conv_id", "turn", "role", "text", F.col("times").cast("int").alias("times"), F.md5("text").alias("digest"), *none(["audit", *REPORT]), F.lit(1).alias("kind"))
    both = heads.unionByName(rows).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "digest")
    return both.select("conv_id", "kind", "role", "text", "times", "audit", *REPORT).mapInArrow(run, kind)


def hashed(turns: DataFrame, found: DataFrame) -> DataFrame:
    """The reports with ``repaired_sha256``: of ``role:text`` of the repaired turns, joined by line feeds."""

    def run(batches):
        state = None
        names = ["conv_id", *REPORT, "audit", "repaired_sha256"]

        def feed(state, rows):
            for role, text in rows:
                if state[3]:
                    state[2].update(b"\n")
                state[2].update(role + b":" + text)
                state[3] = True

        def close_row(state):
            feed(state, state[1].inserted())
            return (*state[0], state[2].hexdigest())

        def batch_of(rows):
            kinds = [pa.int64()] * 7 + [pa.string()] * 2
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

        for batch in batches:
            done = []
            for conv, kind, role, text, times, audit, *numbers in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if kind == 0:
                    if state:
                        done.append(close_row(state))
                    state = [(conv, *numbers, audit), Repaired(audit), hashlib.sha256(), False]
                    continue
                for _ in range(times):
                    feed(state, state[1].turn(role, text))
            if done:
                yield batch_of(done)
        if state:
            yield batch_of([close_row(state)])

    return _streamed(turns, found, run, "conv_id bigint, " + ", ".join(f"{c} bigint" for c in REPORT) + ", audit string, repaired_sha256 string")


def repaired(rows: DataFrame, damage: bool = False) -> DataFrame:
    """``conv_id, role, text`` of repaired conversations, with ``pos`` from 0; rows: conv_id, turn, role, text."""
    turns = damaged(rows) if damage else as_they_are(rows)
    found = Workspace(rows.sparkSession).cut(reports(faults(turns)), "reports")

    def run(batches):
        conv_now, fix, pos = None, None, 0
        for batch in batches:
            out = []
            for conv, kind, role, text, times, audit, *_ in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if kind == 0:
                    if fix:
                        for r, t in fix.inserted():
                            out.append((conv_now, pos, r.decode(), t.decode()))
                            pos += 1
                    conv_now, fix, pos = conv, Repaired(audit), 0
                    continue
                for _ in range(times):
                    for r, t in fix.turn(role, text):
                        out.append((conv_now, pos, r.decode("utf-8", "surrogatepass"), t.decode("utf-8", "surrogatepass")))
                        pos += 1
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate([pa.int64(), pa.int64(), pa.string(), pa.string()])], ["conv_id", "pos", "role", "text"])
        tail = []
        if fix:
            for r, t in fix.inserted():
                tail.append((conv_now, pos, r.decode(), t.decode()))
                pos += 1
        if tail:
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in tail], t) for k, t in enumerate([pa.int64(), pa.int64(), pa.string(), pa.string()])], ["conv_id", "pos", "role", "text"])

    return _streamed(turns, found, run, "conv_id bigint, pos bigint, role string, text string")


def damage_report(rows: DataFrame) -> DataFrame:
    """Conversations after set damage: faults, cheapest repair and the repaired text's digest, for every conv_id of rows."""
    ws = Workspace(rows.sparkSession)
    turns = damaged(rows.select(rows["conv_id"], rows["turn"], rows["role"], rows["text"]))
    found = ws.cut(reports(ws.cut(faults(turns), "faults")), "reports")
    return hashed(turns, found)
