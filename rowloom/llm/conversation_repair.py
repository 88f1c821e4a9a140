"""Repair of conversations: a generalised LR parse of their roles with weighted edits.

The roles of a sound conversation follow ``(s?(ua)+)?``. Rows are parsed from the last to
the first, so the grammar is the mirrored one:

    C -> (nothing) | T | T s        T -> T P | P        P -> a u

The parser keeps a graph-structured stack: a node is an LR state with links to the nodes
below it. A row can be kept, given another role or deleted, and roles can be inserted before
it; each action shifts (and reduces) on every stack top. Equal tops become one node with all
their links and the least (cost, audit). The audit gains letters at its front only, so the
least audit of a top stays the least whatever is put before it. That would not hold from the
first row to the last, where one audit may be the beginning of another.

Rows are dealt by ranges of (conversation, turn), once. A task repairs the conversations that
lie whole in its range. The few at the borders of ranges, and those with more than WHOLE_ROWS
rows or WHOLE_CHARS characters, are cut into segments: a segment gives, for every stack top it
may meet on its right, the least audits to every top on its left, and segments are chained
in the end. Only the digest of a long conversation's text is taken row after row in one task,
as SHA-256 cannot be taken in parts; it reads a stream and holds no row but one.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import keep
from rowloom.operators.skew import join_unique

WHOLE_ROWS, WHOLE_CHARS = 2048, 1 << 23  # beyond this a conversation is cut into segments
SEGMENT_ROWS, SEGMENT_CHARS = 512, 1 << 22
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
ROLES = {"u": "user", "a": "assistant"}
SOUND = ("su", "ua", "au")
WORD = re.compile(r"[^\x20\x09-\x0D]")
LAST = re.compile(r"[^\x20\x09-\x0D][\x20\x09-\x0D]*\Z")

# -- grammar -----------------------------------------------------------------------------

START, PAIRS, OPEN, CLOSED, LED, FIRST, NEXT = range(7)
SHIFT = {(START, "a"): OPEN, (PAIRS, "a"): OPEN, (OPEN, "u"): CLOSED, (PAIRS, "s"): LED}
REDUCE = {CLOSED: (2, "P"), FIRST: (1, "T"), NEXT: (2, "T")}
GOTO = {(START, "P"): FIRST, (PAIRS, "P"): NEXT, (START, "T"): PAIRS}
ACCEPT = (START, PAIRS, LED)

Node = tuple  # (state, frozenset of the nodes below)
EMPTY: Node = (START, frozenset())


def merged(a: Node, b: Node) -> Node:
    return (a[0], a[1] | b[1])


@lru_cache(maxsize=1024)
def shift(top: Node, role: str) -> Node | None:
    """The stack top after ``role`` and all reductions; None where the grammar refuses it."""
    state = SHIFT.get((top[0], role))
    if state is None:
        return None
    todo, settled = [(state, frozenset([top]))], None
    while todo:
        node = todo.pop()
        if node[0] not in REDUCE:
            settled = node if settled is None else merged(settled, node)  # all ways lead to one state here
            continue
        size, symbol = REDUCE[node[0]]
        below = {node}
        for _ in range(size):
            below = {b for n in below for b in n[1]}
        todo += [(GOTO[b[0], symbol], frozenset([b])) for b in below]
    return settled


def canonical() -> dict[int, Node]:
    """The node of each stack top a parse can stand on between two roles."""
    pairs: Node = (PAIRS, frozenset([EMPTY]))
    return {START: EMPTY, PAIRS: pairs, OPEN: (OPEN, frozenset([EMPTY, pairs])), LED: (LED, frozenset([pairs]))}


TOPS = canonical()

# -- weighted parse ------------------------------------------------------------------------


def least(audits: set[str], whole: bool) -> tuple[str, ...]:
    """The audits that can still be the least: one, or each beginning of a kept one while more letters follow."""
    order = sorted(audits)
    if whole:
        return (order[0],)
    kept: list[str] = []
    for audit in order:
        if all(audit.startswith(k) for k in kept):
            kept.append(audit)
    return tuple(kept)


Frontier = dict  # state -> (cost, audits, node)


def offer(tops: Frontier, node: Node, cost: int, audits, whole: bool) -> bool:
    """Put a stack top into the frontier; equal tops are merged. Returns whether the weight changed."""
    old = tops.get(node[0])
    if old is None or cost < old[0]:
        tops[node[0]] = (cost, tuple(audits), node if old is None else merged(old[2], node))
        return True
    if cost > old[0]:
        return False
    best = least({*old[1], *audits}, whole)
    tops[node[0]] = (cost, best, merged(old[2], node))
    return best != old[1]


def inserted(tops: Frontier, whole: bool) -> Frontier:
    """All tops reached by inserting roles."""
    todo = list(tops)
    while todo:
        cost, audits, node = tops[todo.pop()]
        for role in ROLES:
            top = shift(node, role)
            if top is not None and offer(tops, top, cost + INSERT, ["I" + x for x in audits], whole):
                todo.append(top[0])
    return tops


def parse(codes: str, start: Frontier, whole: bool) -> Frontier:
    """Frontier before the rows of ``codes``, given the one behind them.

    A code is ``x`` for a row that must go, else its role's initial (``o`` for other roles),
    in upper case if the text is truncated.
    """
    tops = inserted(dict(start), whole)
    for code in reversed(codes):
        step: Frontier = {}
        for cost, audits, node in tops.values():
            offer(step, node, cost + DELETE, ["D" + x for x in audits], whole)
            if code == "x":
                continue
            role, extra = code.lower(), TRUNCATED if code.isupper() else 0
            top = shift(node, role)
            if top is not None:
                offer(step, top, cost + extra, ["K" + x for x in audits], whole)
            for other in ROLES:
                top = shift(node, other)
                if other != role and top is not None:
                    offer(step, top, cost + extra + REROLE, ["R" + x for x in audits], whole)
        tops = inserted(step, whole)
    return tops


@lru_cache(maxsize=1 << 15)
def repair_codes(codes: str) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair, the ASCII-least audit among equals."""
    tops = parse(codes, {START: (0, ("",), EMPTY)}, True)
    return min((cost, audits[0]) for state, (cost, audits, _) in tops.items() if state in ACCEPT)


def segment_weights(codes: str) -> dict[int, dict[int, tuple[int, tuple[str, ...]]]]:
    """For each top on the right of the rows: the least cost to each top on their left, with its audits."""
    return {
        state: {s: (cost, audits) for s, (cost, audits, _) in parse(codes, {state: (0, ("",), node)}, False).items()}
        for state, node in TOPS.items()
    }


def chain(segments: list[dict]) -> tuple[int, list[str]]:
    """Cost and one audit per segment, from the weights of all segments in order."""
    best: dict[int, tuple[int, str, tuple]] = {START: (0, "", ())}  # the parts as a linked list: (audit, rest)
    for weights in reversed(segments):
        step: dict[int, tuple[int, str, tuple]] = {}
        for right, (cost, tail, parts) in best.items():
            for left, (more, audits) in weights[right].items():
                for audit in audits:
                    new = (cost + more, audit + tail, (audit, parts))
                    if left not in step or new[:2] < step[left][:2]:
                        step[left] = new
        best = step
    cost, _, parts = min((x for state, x in best.items() if state in ACCEPT), key=lambda x: x[:2])
    found = []
    while parts:
        found.append(parts[0])
        parts = parts[1]
    return cost, found


# -- rows --------------------------------------------------------------------------------------


def blank(text: str) -> bool:
    return WORD.search(text) is None


def truncated(text: str) -> bool:
    last = LAST.search(text)
    return last is not None and last.group()[0] not in ".!?"


def code_of(role: str, cut: bool) -> str:
    initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
    return initial.upper() if cut else initial


class Lines:
    """The repaired lines of rows that come one after the other, given their audit."""

    def __init__(self, audit: str, role: str = ""):
        self.letters, self.at, self.last = audit, 0, role

    def _next_role(self) -> str:
        self.last = "a" if self.last == "u" else "u"
        return ROLES[self.last]

    def inserts(self) -> Iterator[str]:
        while self.letters[self.at:self.at + 1] == "I":
            self.at += 1
            yield f"{self._next_role()}:"

    def row(self, role: str, text: str) -> Iterator[str]:
        """The lines inserted before the row, and the row itself if it stays."""
        yield from self.inserts()
        letter = self.letters[self.at]
        self.at += 1
        if letter == "K":
            self.last = role[0]
            yield f"{role}:{text}"
        elif letter == "R":
            yield f"{self._next_role()}:{text}"


def repaired_lines(rows: list[tuple[str, str]], audit: str) -> Iterator[str]:
    lines = Lines(audit)
    for role, text in rows:
        yield from lines.row(role, text)
    yield from lines.inserts()


def digest(lines: Iterator[str]) -> str:
    sha, first = hashlib.sha256(), True
    for line in lines:
        sha.update((line if first else "\n" + line).encode("utf-8", "surrogatepass"))
        first = False
    return sha.hexdigest()


def repair_rows(rows: list[tuple[int | None, str, str]]) -> dict:
    """The repair of one conversation, rows (turn, role, text) in order."""
    seen, codes, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        fault = "blank" if blank(text) else "duplicate" if (role, text) in seen else "truncated" if truncated(text) else ""
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        codes.append("x" if fault in ("blank", "duplicate") else code_of(role, fault == "truncated"))
    turns = {t for t, _, _ in rows if t is not None}
    initials = [role[:1] for _, role, _ in rows]
    cost, audit = repair_codes("".join(codes))
    return {
        "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0, **counts,
        "illegal": sum(x + y not in SOUND for x, y in zip(initials, initials[1:])),
        "cost": cost, "audit": audit, "repaired_sha256": digest(repaired_lines([r[1:] for r in rows], audit)),
    }


# -- conversations in Spark ----------------------------------------------------------------------

FIGURES = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
PLACED = f"conv_id long, {FIGURES}, part int, segment int, place long, turn long, role string, text string"
NAMES = [f.split()[0] for f in FIGURES.split(", ")]


def _repair_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repair what lies whole in this range; pass on the rows of conversations that may not."""
    out: list[dict] = []
    run: list[tuple] = []  # rows of the present conversation
    state = {"conv": None, "any": False, "first": True, "long": False, "chars": 0, "segment": 0, "rows": 0, "place": 0}
    part = None

    def pass_on() -> None:
        for turn, role, text in run:
            if state["rows"] >= SEGMENT_ROWS or state["rows"] and state["chars"] + len(text) > SEGMENT_CHARS:
                state["segment"] += 1
                state["rows"] = state["chars"] = 0
            out.append({"conv_id": state["conv"], "part": part, "segment": state["segment"], "place": state["place"], "turn": turn, "role": role, "text": text})
            state["place"] += 1
            state["rows"] += 1
            state["chars"] += len(text)
        run.clear()

    def close(last: bool) -> None:
        if not state["any"]:
            return
        if state["first"] or last or state["long"]:
            pass_on()
            state["segment"] += 1
            state["rows"] = state["chars"] = 0
        else:
            out.append({"conv_id": state["conv"], **repair_rows(run)})
            run.clear()
        state["first"], state["long"] = False, False

    def written() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_pylist(out, schema=SCHEMA)
        out.clear()
        return batch

    held = 0
    for batch in batches:
        columns = [batch.column(k) for k in range(5)]
        for k in range(batch.num_rows):
            conv, turn, role, text, part = (c[k].as_py() for c in columns)
            if not state["any"] or conv != state["conv"]:
                close(False)
                state["conv"], state["any"], held = conv, True, 0
            run.append((turn, role, text))
            held += len(text)
            if state["long"] or len(run) > WHOLE_ROWS or held > WHOLE_CHARS:
                if not state["long"]:
                    state["rows"] = state["chars"] = 0
                state["long"] = True
                pass_on()
                held = 0
            if len(out) >= 4096 or sum(len(o.get("text") or "") for o in out[-64:]) > WHOLE_CHARS:
                yield written()
    close(True)
    if out:
        yield written()


SCHEMA = pa.schema(
    [("conv_id", pa.int64()), *[(n, pa.string() if n in ("audit", "repaired_sha256") else pa.int64()) for n in NAMES],
     ("part", pa.int32()), ("segment", pa.int32()), ("place", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]
)


def repair_conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation of (conv_id, turn, role, text): its faults and its cheapest repair.

    gaps, blank, duplicate, truncated, illegal, cost, audit (K keep, R new role, D delete,
    I insert) and the SHA-256 of the repaired ``role:text`` lines. Rows go by turn, nulls
    first; ties by role, then by the MD5 of the text, then as they were read. An empty role fits nowhere. Null roles and
    texts count as one space. Null ids are one conversation. Repeated rows are duplicates. No
    rows in, no rows out; further columns are ignored.
    """
    rows = turns.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
    )
    # the copy keeps equal rows apart, so that a range never has to hold all copies of one row
    rows = rows.withColumn("digest", F.md5("text")).withColumn("copy", F.monotonically_increasing_id())
    order = ["conv_id", "turn", "role", "digest", "copy"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = dealt.select("conv_id", "turn", "role", "text", F.spark_partition_id().alias("part"))
    found = keep(dealt.mapInArrow(_repair_ranges, PLACED), "repaired")
    whole = found.where("place is null").select("conv_id", *NAMES)
    return whole.union(_repair_spread(found.where("place is not null").drop(*NAMES)))


def _repair_spread(rows: DataFrame) -> DataFrame:
    """Conversations cut into segments; ``part``, ``segment`` and ``place`` give the order of their rows."""
    rows = rows.withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))).withColumn("digest", F.md5("text"))
    key = ["conv", "role", "digest"]
    again = rows.groupBy(*key).agg(F.min(F.struct("part", "place")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    marks = join_unique(rows.select("conv", "role", "digest", "part", "segment", "place", "turn", F.length("text").alias("n_chars"),
                                    (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("empty"),
                                    F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1).alias("end")), again, key, "left")
    fault = F.when(F.col("empty"), "blank").when(F.struct("part", "place") > F.col("first"), "duplicate").when(~F.col("end").isin(".", "!", "?"), "truncated")
    initial = F.substring("role", 1, 1)
    code = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    marks = marks.withColumn("fault", fault).withColumn(
        "code", F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(code)).otherwise(code)
    )
    marks = keep(marks.select("conv", "part", "segment", "place", "turn", "fault", "code", initial.alias("initial")), "marks")
    counts = marks.groupBy("conv").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"),
        *[F.sum(F.when(F.col("fault") == f, 1).otherwise(0)).alias(f) for f in ("blank", "duplicate", "truncated")],
    )
    ordered = F.array_sort(F.collect_list(F.struct("place", "code", "initial")))  # a segment has at most SEGMENT_ROWS rows
    segments = marks.groupBy("conv", "part", "segment").agg(ordered.alias("rows")).select(
        "conv", "part", "segment", F.array_join("rows.code", "").alias("codes"), F.col("rows.initial").alias("initials")
    )

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, initials = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            illegal = [sum(x + y not in SOUND for x, y in zip(i, i[1:])) for i in initials]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([pickle.dumps(segment_weights(c)) for c in codes], pa.binary()), pa.array(illegal, pa.int64()),
                 pa.array([i[0] for i in initials], pa.string()), pa.array([i[-1] for i in initials], pa.string()), batch.column(3)],
                ["conv", "part", "segment", "weights", "illegal", "low", "high", "codes"],
            )

    weighed = keep(segments.mapInArrow(weigh, "conv string, part int, segment int, weights binary, illegal long, low string, high string, codes string"), "segments")

    def chained(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["part", "segment"])
        cost, audits = chain([pickle.loads(w) for w in group["weights"]])
        between = sum(x + y not in SOUND for x, y in zip(group["high"], group["low"][1:]))
        group["audit"], group["cost"], group["illegal"] = audits, cost, int(group["illegal"].sum()) + between
        last, roles = "", []
        for audit, codes in zip(audits, group["codes"]):
            roles.append(last)
            last = role_after(codes, audit, last)
        group["role"] = roles
        return group[["conv", "part", "segment", "audit", "cost", "illegal", "role"]]

    slices = keep(weighed.groupBy("conv").applyInPandas(chained, "conv string, part int, segment int, audit string, cost long, illegal long, role string"), "slices")

    def lines(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        (piece,) = right.to_pylist()
        made = Lines(piece["audit"], piece["role"])
        for row in sorted(left.to_pylist(), key=lambda r: r["place"]):
            out += [(row["place"], n, x) for n, x in enumerate(made.row(row["role"], row["text"]))]
        end = max(r["place"] for r in left.select(["place"]).to_pylist())
        out += [(end, len(out) + n, x) for n, x in enumerate(made.inserts())]
        columns = list(zip(*out)) or [[], [], []]
        same = {k: [right[k][0].as_py()] * len(out) for k in ("conv", "part", "segment")}
        return pa.table({**same, "place": pa.array(columns[0], pa.int64()), "n": pa.array(columns[1], pa.int32()), "line": pa.array(columns[2], pa.string())},
                        schema=pa.schema([("conv", pa.string()), ("part", pa.int32()), ("segment", pa.int32()), ("place", pa.int64()), ("n", pa.int32()), ("line", pa.string())]))

    at = ["conv", "part", "segment"]
    made = rows.select(*at, "place", "role", "text").groupBy(*at).cogroup(slices.groupBy(*at)).applyInArrow(
        lines, "conv string, part int, segment int, place long, n int, line string"
    )

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, sha = None, None
        done: list[dict] = []
        for batch in batches:
            for name, line in zip(batch.column(0), batch.column(1)):
                if name.as_py() != conv:
                    if conv is not None:
                        done.append({"conv": conv, "repaired_sha256": sha.hexdigest()})
                    conv, sha = name.as_py(), hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(line.as_py().encode("utf-8", "surrogatepass"))
        if conv is not None:
            done.append({"conv": conv, "repaired_sha256": sha.hexdigest()})
        yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("conv", pa.string()), ("repaired_sha256", pa.string())]))

    streamed = made.repartition("conv").sortWithinPartitions("conv", "part", "segment", "place", "n").select("conv", "line")
    shas = streamed.mapInArrow(hashed, "conv string, repaired_sha256 string")
    audits = slices.groupBy("conv").agg(
        F.max("cost").alias("cost"), F.max("illegal").alias("illegal"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "segment", "audit"))), lambda x: x["audit"]), "").alias("audit"),
    )
    found = counts.join(audits, "conv").join(shas, "conv", "left")
    return found.select(
        F.when(F.col("conv") != "null", F.col("conv")).cast("long").alias("conv_id"), F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"),
        "blank", "duplicate", "truncated", "illegal", "cost", "audit",
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )


def role_after(codes: str, audit: str, last: str) -> str:
    """The initial of the last repaired role after a segment."""
    made = Lines(audit, last)
    for code in codes:
        for _ in made.row(code.lower(), ""):
            pass
    for _ in made.inserts():
        pass
    return made.last
