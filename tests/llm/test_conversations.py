"""Conversation audit and repair: against plain searches, ties, hash collisions, split conversations, and edge cases."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from lapforge.llm import audit_paths, conversations

SOUND = re.compile(r"(s?(ua)+)?")


def plain_search(rows):
    """Cheapest edits by uniform-cost search over (cost, edits, rows done, initials); ``rows``: (initial, must go, truncated)."""
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, edits, at, roles = heapq.heappop(heap)
        if at == len(rows) and SOUND.fullmatch(roles):
            return cost, edits
        key = at, roles[-1:], len(roles) > 0
        if key in done:
            continue
        done.add(key)
        options = [(cost + 2, edits + "I", at, roles + r) for r in "ua"]
        if at < len(rows):
            initial, gone, cut = rows[at]
            options.append((cost + 3, edits + "D", at + 1, roles))
            if not gone:
                options.append((cost + cut, edits + "K", at + 1, roles + (initial or "-")))
                options += [(cost + 2 + cut, edits + "R", at + 1, roles + r) for r in "ua"]
        for option in options:
            if any(SOUND.fullmatch(option[3] + tail) for tail in ("", "a", "ua")):
                heapq.heappush(heap, option)
    raise AssertionError


def letter(row):
    initial, gone, cut = row
    return "d" if gone else (initial if initial in ("s", "u", "a") else "x").upper() if cut else initial if initial in ("s", "u", "a") else "x"


def plain_audit(rows):
    """The whole contract for the rows (turn, role, text) of one conversation after damage."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    blank = duplicate = truncated = 0
    kinds, seen = [], set()
    for _, role, text in rows:
        end = text.rstrip(" \t\n\x0b\x0c\r")
        gone, cut = False, False
        if not end:
            blank, gone = blank + 1, True
        elif (role, text) in seen:
            duplicate, gone = duplicate + 1, True
        elif end[-1] not in ".!?":
            truncated, cut = truncated + 1, True
        seen.add((role, text))
        kinds.append((role[:1], gone, cut))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    cost, audit = plain_search(kinds)
    lines, at, last = [], iter(rows), ""
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(at)[1:]
        if edit == "D":
            continue
        if edit != "K":
            role = "assistant" if last == "u" else "user"
        last = role[:1]
        lines.append(f"{role}:{text}")
    return gaps, blank, duplicate, truncated, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def plain_damage(rows):
    kept = {}
    for conv, turn, role, text in rows:
        out = kept.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return kept


def expected(rows):
    return {(conv, *plain_audit(kept)) for conv, kept in plain_damage(rows).items()}


@pytest.mark.parametrize("length", range(6))
def test_search_equals_plain(length):
    for kinds in itertools.product("suaxSUAXd", repeat=length) if length < 4 else (random.Random(length).choices("suaxSUAd", k=length) for _ in range(300)):
        rows = [(k.lower() if k != "d" else "u", k == "d", k.isupper()) for k in kinds]
        ends = audit_paths.paths("".join(kinds))
        assert min(ends[s] for s in audit_paths.FINAL if ends[s] is not None) == plain_search(rows), kinds


def test_colliding_hashes_do_not_decide():
    draw = random.Random(5)
    for _ in range(300):
        kinds = "".join(draw.choices("suaxSUAd", k=draw.randint(1, 40)))
        assert audit_paths.cheapest(kinds, modulus=3) == audit_paths.cheapest(kinds)
        assert audit_paths.cheapest(kinds, modulus=1) == audit_paths.cheapest(kinds)


def test_segments_join_to_the_whole():
    draw = random.Random(6)
    for _ in range(200):
        kinds = "".join(draw.choices("suaxSUAd", k=draw.randint(0, 60)))
        cuts = sorted(draw.choices(range(len(kinds) + 1), k=draw.randint(0, 6)))
        cells = [(0, None), None, None, None]
        for a, b in itertools.pairwise([0, *cuts, len(kinds)]):
            cells = audit_paths.follow(cells, [audit_paths.cheapest(kinds[a:b], e) for e in audit_paths.STATES])
        ends = audit_paths.cheapest(kinds)
        assert audit_paths.best(cells) == min(ends[s] for s in audit_paths.FINAL if ends[s] is not None)


def messy_rows(seed=1, convs=120):
    draw = random.Random(seed)
    rows = []
    for conv in range(convs):
        for turn in range(draw.randint(0, 12)):
            text = draw.choice(["Fine.", "Cut", "", "  \n", "One more!", "Why?", f"t{draw.random()}.", "é. ", None, "x" * 500 + "."])
            rows.append((conv, draw.choice([turn, turn, turn, turn + 5, None]), draw.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"]), text))
    rows += [(None, 0, "user", "Hm."), (None, None, "assistant", "Ha."), (7_000, 1, "user", "a."), (7_000, 1, "user", "a.")]
    return rows + [(8_000, t % 3, "user" if t % 2 else "assistant", "same.") for t in range(400)] + [(9_000, t, "user assistant".split()[t % 2], "y" * (t % 7) + ".") for t in range(300)]


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("range_rows", [10_000, 7])
def test_equals_plain_version(spark, monkeypatch, range_rows):
    monkeypatch.setattr(conversations, "RANGE_ROWS", range_rows)
    rows = messy_rows()
    # names that the operator uses itself
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA + ", n int, c string, digest string")
    got = conversations.audit_report(conversations.damaged(conversations.plain_rows(df)))
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == expected(rows)


def test_given_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = conversations.op13_conversation_repair(spark, sf_dir)
    assert {tuple(r) for r in got.collect()} == expected(rows)
    assert [(f.name, f.dataType.simpleString()) for f in got.schema][1:7] == [(n, "bigint") for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]


def test_empty_table_and_lost_conversations(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    assert conversations.audit_report(conversations.damaged(conversations.plain_rows(nothing))).collect() == []
    lost = next(c for c in itertools.count() if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(lost, 0, "user", "Hello.")], SCHEMA)
    row = conversations.audit_report(conversations.damaged(conversations.plain_rows(df))).first()
    assert tuple(row) == (lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())


def test_repaired_turns_are_sound(spark):
    rows = conversations.plain_rows(spark.createDataFrame(messy_rows(3, 40), SCHEMA))
    audits = conversations.audit_conversations(rows)
    roles = {}
    for r in conversations.repaired_turns(rows, audits).toPandas().sort_values(["c", "position"]).itertuples():
        roles[r.c] = roles.get(r.c, "") + r.role[:1]
    assert all(SOUND.fullmatch(r) for r in roles.values())
