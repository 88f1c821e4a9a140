"""Conversation repair against a search over all edit scripts."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from rowloom.llm import conversation_repair, queries

SOUND = re.compile(r"(s?(ua)+)?\Z")
SPACE = "\t\n\v\f\r "


def brute_repair(rows):
    """Cheapest edits of (role, text) rows by a best-first search over all prefixes."""
    seen, faults = set(), []
    for role, text in rows:
        if not text.strip(SPACE):
            faults.append("blank")
        elif (role, text) in seen:
            faults.append("duplicate")
        else:
            faults.append("" if text.strip(SPACE)[-1] in ".!?" else "truncated")
        seen.add((role, text))
    # (cost, audit, position, roles so far as far as the grammar can tell them apart, lines)
    heap, best = [(0, "", 0, "", ())], None
    while heap:
        cost, audit, at, made, lines = heapq.heappop(heap)
        if best is not None and cost > best[0]:
            break
        if at == len(rows) and SOUND.match(made):
            if best is None or (cost, audit) < best[:2]:
                best = (cost, audit, lines)
        steps = [("I", 3, at, "u", "user:"), ("I", 3, at, "a", "assistant:")]
        if at < len(rows):
            (role, text), fault = rows[at], faults[at]
            steps.append(("D", 4, at + 1, "", None))
            if fault not in ("blank", "duplicate"):
                extra = 3 if fault else 0
                steps.append(("K", extra, at + 1, role[:1] or "?", f"{role}:{text}"))  # an empty role fits nowhere
                steps += [("R", 3 + extra, at + 1, r[0], f"{r}:{text}") for r in ("user", "assistant")]
        for letter, more, to, initial, line in steps:
            now = made + initial
            if re.match(r"s?(ua)*u?\Z", now):
                heapq.heappush(heap, (cost + more, audit + letter, to, re.sub("(ua)+", "ua", now), lines if line is None else (*lines, line)))
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return best[0], best[1], hashlib.sha256("\n".join(best[2]).encode()).hexdigest(), counts


def random_rows(draw, most):
    texts = ["Yes.", "No", "", " \n", "More?", "a b!", "é.", "same."] + [f"text {k}." for k in range(6)]
    roles = ["user", "assistant", "system", "tool", " ", "u", ""]
    return [(draw.choices(roles, [6, 6, 2, 1, 1, 1, 1])[0], draw.choice(texts)) for _ in range(draw.randint(0, most))]


def brute_summary(rows):
    cost, audit, sha, counts = brute_repair([r[1:] for r in rows])
    turns = {t for t, _, _ in rows if t is not None}
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts, illegal, cost, audit, sha)


def test_repair_of_one_conversation():
    draw = random.Random(1)
    for _ in range(400):
        rows = [(k, *r) for k, r in enumerate(random_rows(draw, 6))]
        found = conversation_repair.repair_rows(rows)
        assert tuple(found.values()) == brute_summary(rows), rows


def test_segments_are_chained_like_one_parse():
    draw = random.Random(2)
    for _ in range(300):
        codes = "".join(draw.choices("uasoxUASO", [5, 5, 1, 1, 2, 1, 1, 1, 1], k=draw.randint(1, 24)))
        size = draw.randint(1, 7)
        parts = [codes[k:k + size] for k in range(0, len(codes), size)]
        cost, audits = conversation_repair.chain([conversation_repair.segment_weights(p) for p in parts])
        assert (cost, "".join(audits)) == conversation_repair.repair_codes(codes)


NAMES = "gaps blank duplicate truncated illegal cost audit repaired_sha256".split()


@pytest.mark.parametrize("whole, segment", [(2048, 512), (3, 2)])
def test_conversations(spark, monkeypatch, whole, segment):
    """Also with every longer conversation cut into segments of two rows."""
    monkeypatch.setattr(conversation_repair, "WHOLE_ROWS", whole)
    monkeypatch.setattr(conversation_repair, "SEGMENT_ROWS", segment)
    draw = random.Random(3)
    talks = {c: [(draw.choice([None, k, k + 3]), *r) for k, r in enumerate(random_rows(draw, 7))] for c in [*range(60), None]}
    talks[None] = [(0, "user", "Hi."), (1, "assistant", "Well")]
    talks[90] = [(None, "user", "x" * 2_000_000 + ".")] * 2
    rows = [(c, *r, "clash", 1) for c, t in talks.items() for r in t]
    draw.shuffle(rows)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part string, cost int")
    found = {r.conv_id: tuple(r[n] for n in NAMES) for r in conversation_repair.repair_conversations(frame.repartition(5)).collect()}
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest())
    assert found == {c: brute_summary(sorted(t, key=order)) for c, t in talks.items() if t}
    assert conversation_repair.repair_conversations(frame.limit(0)).count() == 0


def test_damaged_conversations(spark, tmp_path):
    draw = random.Random(4)
    rows = [(c, t, role, text) for c in [*range(150), None] for t, (role, text) in enumerate(random_rows(draw, 6))]
    rows += [(200, None, None, None), (201, None, "user", None), (202, 5, None, "Fine."), *[(300, t, "user", "Hm. And?") for t in range(4)]]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    talks = {c: [] for c, *_ in rows}
    for c, t, role, text in rows:
        role, text = role or (" " if role is None else ""), text if text is not None else " "
        damage = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if damage == 1 else re.sub("[.!?]", "", text) if damage == 2 else text
        talks[c] += [(t, "user" if damage == 4 else role, text)] * (0 if damage == 0 else 2 if damage == 3 else 1)
    found = {r.conv_id: tuple(r[n] for n in NAMES) for r in queries.op11_conversation_repair(spark, str(tmp_path)).collect()}
    assert found == {c: brute_summary(t) for c, t in talks.items()}
