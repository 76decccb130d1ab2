import hashlib
import itertools
import random
import re
import zlib

import pytest

from apiquarry.llm import conversations, queries
from apiquarry.llm.conversations import Audits, chunk_table, cheapest

SCHEMA = "conv_id bigint, turn bigint, role string, text string, conv string, copies string, `a.b` int"


# --- plain rules


def brute_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        plain = [" " if v is None else str(v) for v in (conv, turn, role, text)]
        kind = zlib.crc32(f"{plain[0]}:{plain[1]}".encode()) % 20
        own = out.setdefault(conv, [])
        if kind == 0:
            continue
        role, text = "user" if kind == 4 else plain[2], "" if kind == 1 else re.sub("[.!?]", "", plain[3]) if kind == 2 else plain[3]
        own += [(turn, role, text)] * (2 if kind == 3 else 1)
    for own in out.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    return out


def faults(rows):
    out, seen = [], set()
    for _, role, text in rows:
        bare = re.sub(r"[\x20\x09-\x0D]+", "", text)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def brute_repair(rows):
    """Dijkstra over (turns done, roles written last) with whole audits as strings."""
    marks = faults(rows)
    best = {(0, ""): (0, "", ())}
    for i in range(len(rows) + 1):
        for _ in range(3):
            for (at, last), (cost, audit, lines) in list(best.items()):
                if at == i:
                    role = "assistant" if last == "u" else "user"
                    offer(best, (i, role[0]), (cost + 3, audit + "I", (*lines, f"{role}:")))
        if i == len(rows):
            break
        _, role, text = rows[i]
        for (at, last), (cost, audit, lines) in list(best.items()):
            if at != i:
                continue
            offer(best, (i + 1, last), (cost + 4, audit + "D", lines))
            if marks[i] in ("blank", "duplicate"):
                continue
            more, want = 3 * (marks[i] == "truncated"), "assistant" if last == "u" else "user"
            if role[:1] == want[0] or (role[:1] == "s" and last == "" and not lines):
                offer(best, (i + 1, role[0]), (cost + more, audit + "K", (*lines, f"{role}:{text}")))
            offer(best, (i + 1, want[0]), (cost + 3 + more, audit + "R", (*lines, f"{want}:{text}")))
    return min(best[len(rows), last] for last in ("", "a") if (len(rows), last) in best)


def offer(best, state, entry):
    if state not in best or entry[:2] < best[state][:2]:
        best[state] = entry


def brute(rows):
    out = []
    for conv, own in brute_damage(rows).items():
        marks, turns = faults(own), {r[0] for r in own} - {None}
        cost, audit, lines = brute_repair(own)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((conv, gaps, marks.count("blank"), marks.count("duplicate"), marks.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


# --- the shared audits


def test_order_of_shared_audits():
    draw, audits = random.Random(5), Audits()
    nodes = [0]
    for _ in range(300):
        nodes.append(audits.grow(draw.choice(nodes), draw.choice("DIK")))
    for a, b in itertools.product(draw.sample(nodes, 60), repeat=2):
        x, y = audits.text(a), audits.text(b)
        assert audits.less(a, b) == (x < y)
        common = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
        assert audits.common(a, b) == common


def test_labels_of_several_letters_and_colliding_hashes():
    draw = random.Random(6)
    audits = Audits()
    nodes = [0]
    for _ in range(200):
        nodes.append(audits.grow(draw.choice(nodes), draw.choice(["KI", "K", "IK", "DD", "D"])))
    audits.hash = [0] * len(audits.hash)
    for a, b in itertools.product(draw.sample(nodes, 50), repeat=2):
        assert audits.less(a, b) == (audits.text(a) < audits.text(b))


def test_chunks_decide_like_the_whole():
    draw = random.Random(7)
    for _ in range(400):
        codes = "".join(draw.choice("suaoSUAOx") for _ in range(draw.randrange(0, 14)))
        cost, parts = cheapest([chunk_table(codes)])
        cut = draw.randrange(1, 5)
        pieces = [codes[i : i + cut] for i in range(0, len(codes), cut)] or [""]
        cost2, parts2 = cheapest([chunk_table(p) for p in pieces])
        assert (cost, "".join(parts)) == (cost2, "".join(parts2)), (codes, cut)
        names = {"s": "system", "u": "user", "a": "assistant", "o": "tool"}
        rows = [(i, names[c.lower()], "" if c == "x" else f"text {i}{'' if c.isupper() else '.'}") if c != "x" else (i, "user", "") for i, c in enumerate(codes)]
        assert brute_repair(rows)[:2] == (cost, "".join(parts)), codes


def test_long_chunk_stays_fast():
    assert cheapest([chunk_table("ua" * 2000)]) == (0, ["K" * 4000])
    cost, parts = cheapest([chunk_table("o" * 3000)])
    assert cost == 9000 and parts[0] == "R" * 3000


# --- the operator


def odd_rows():
    draw = random.Random(8)
    rows = []
    for conv in [None, *range(40)]:
        for _ in range(draw.randrange(0, 15)):
            turn = draw.choice([None, *range(8)])
            rows.append((conv, turn, draw.choice(["user", "assistant", "system", "tool", "", None]), draw.choice([None, "", " \n", "same.", "open", "Fine!", "é😀 ok?", "a.b.c", f"own {draw.random()}."])))
    rows += [(99, 1, "user", "twice."), (99, 1, "user", "twice."), (98, 0, "user", "long " * 50_000 + "."), (98, 1, "assistant", "end")]
    return rows


@pytest.mark.parametrize("chunk", [1, 3, 4096])
def test_repair_of_odd_rows(spark, monkeypatch, chunk):
    monkeypatch.setattr(conversations, "CHUNK_TURNS", chunk)
    rows = odd_rows()
    docs = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA)
    got = [tuple(r) for r in conversations.repair(conversations.damaged(docs)).collect()]
    assert sorted(got, key=repr) == sorted(brute(rows), key=repr)


def test_repaired_turns(spark):
    rows = odd_rows()
    docs = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA)
    got = conversations.repaired(conversations.damaged(docs)).collect()
    want = []
    for conv, own in brute_damage(rows).items():
        want += [(conv, i + 1, *line.split(":", 1)) for i, line in enumerate(brute_repair(own)[2])]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_rows_as_given_and_no_rows(spark):
    docs = spark.createDataFrame([(1, 0, "user", "Hi.", "", "", 1), (1, 1, "user", "Still here?", "", "", 1)], SCHEMA)
    (row,) = conversations.repair(conversations.as_given(docs)).collect()
    assert (row.cost, row.audit, row.illegal) == (3, "KR", 1)
    assert conversations.repair(conversations.damaged(spark.createDataFrame([], SCHEMA))).collect() == []


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = [tuple(r) for r in queries.QUERIES["op13_conversations"](spark, sf).collect()]
    assert sorted(got) == sorted(brute(rows))
