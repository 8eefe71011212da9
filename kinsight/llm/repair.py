"""Repair of damaged conversations over an automaton of shared suffixes.

A conversation is read as a signature, one letter a row for its role and its fault. Signatures are shared from their
end: sorted by their reversed letters, they walk an automaton in which one node stands for all conversations that end
alike. A node holds, for each state of the grammar before it and after it, the cheapest edits and, among those, the
least audit; it is valued once for all conversations that reach it. A conversation of more than ``CHUNK`` rows is a
chain of such values, joined from the end.

Grammar of role initials: ``(s?(ua)+)?``. Edits: keep a row; rerole it to user or assistant; delete it; insert an empty
row of user or assistant.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby, takewhile

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinsight.llm.common import ship, stored

#: White space, sentence ends, costs.
WHITE, ENDS = " \t\n\x0b\x0c\r", ".!?"
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
ROLES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
#: Rows of a signature that are valued as one suffix.
CHUNK = 64

# States of the grammar: nothing yet, after the system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
_AFTER = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
_WANTS = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
_ALLOWED = {START: "su", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
_END = (START, ASSISTANT)

Value = tuple[int, str]


# --- the automaton ---------------------------------------------------------------------------------------------------


def _least(options: list[Value | None]) -> Value | None:
    return min((o for o in options if o is not None), default=None)


def _plus(cost: int, letter: str, rest: Value | None) -> Value | None:
    return None if rest is None else (cost + rest[0], letter + rest[1])


def _with_inserts(plain: list[list[Value | None]]) -> tuple:
    """Values with inserts before them. One row is enough before a user or an assistant row: two lead back."""
    u, a = [_least([x, _plus(INSERT, "I", y)]) for x, y in zip(plain[USER], plain[ASSISTANT], strict=True)], [
        _least([x, _plus(INSERT, "I", y)]) for x, y in zip(plain[ASSISTANT], plain[USER], strict=True)
    ]
    first = [[_least([x, _plus(INSERT, "I", y)]) for x, y in zip(plain[p], u, strict=True)] for p in (START, SYSTEM)]
    return (*first, u, a)


#: Node of the empty suffix.
EMPTY = _with_inserts([[(0, "") if p == q else None for q in range(4)] for p in range(4)])


def preceded(letter: str, node: tuple) -> tuple:
    """The node of a suffix with one more row before it. Letters: ``d`` must go; the role initial (``x`` for any
    other) in lower case, in upper case if the row is truncated."""
    plain = []
    for p in range(4):
        options = [[_plus(DELETE, "D", v) for v in node[p]]]
        if letter != "d":
            extra, initial = TRUNCATED * letter.isupper(), letter.lower()
            options.append([_plus(REROLE + extra, "R", v) for v in node[_AFTER[_WANTS[p]]]])
            if initial in _ALLOWED[p]:
                options.append([_plus(extra, "K", v) for v in node[_AFTER[initial]]])
        plain.append([_least(list(of)) for of in zip(*options, strict=True)])
    return _with_inserts(plain)


class Suffixes:
    """Nodes along the current path from the end; signatures come sorted by their reversed letters."""

    def __init__(self) -> None:
        self.letters, self.nodes, self.valued = "", [EMPTY], 0

    def node(self, reverse: str) -> tuple:
        shared = sum(1 for _ in takewhile(lambda x: x[0] == x[1], zip(reverse, self.letters, strict=False)))
        del self.nodes[shared + 1 :]
        for letter in reverse[shared:]:
            self.nodes.append(preceded(letter, self.nodes[-1]))
            self.valued += 1
        self.letters = reverse
        return self.nodes[-1]


class Rope:
    """An audit in pieces, so that a long conversation's is put together once."""

    __slots__ = ("cost", "piece", "rest")

    def __init__(self, cost: int, piece: str, rest: Rope | None):
        self.cost, self.piece, self.rest = cost, piece, rest

    def text(self) -> str:
        parts, at = [], self
        while at is not None:
            parts.append(at.piece)
            at = at.rest
        return "".join(parts)

    def __lt__(self, other: Rope) -> bool:
        if self.cost != other.cost:
            return self.cost < other.cost
        mine, theirs, a, b = "", "", self, other
        while True:
            if not mine and not theirs and a is b:
                return False
            while not mine and a is not None:
                mine, a = a.piece, a.rest
            while not theirs and b is not None:
                theirs, b = b.piece, b.rest
            n = min(len(mine), len(theirs))
            if not n or mine[:n] != theirs[:n]:
                return mine[:n] < theirs[:n] if n else len(mine) < len(theirs)
            mine, theirs = mine[n:], theirs[n:]


# --- rows and faults -------------------------------------------------------------------------------------------------


def key_text(name: str) -> Column:
    """An identifier as text; the null identifier is the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def clean(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text; null roles and texts are one space."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text"))
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), role, text)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows spoilt by the crc32 of ``conv_id:turn`` (a null is one space) modulo 20: 0 drops the row, 1 empties its
    text, 2 removes sentence ends, 3 repeats it, 4 makes it the user's."""
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = clean(conversations).withColumn("fate", F.crc32(name.cast("binary")) % 20).filter("fate <> 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.sequence(F.lit(1), F.when(F.col("fate") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("nth")).drop("nth")


def faults(rows: DataFrame) -> DataFrame:
    """One row per distinct (conv, turn, role, text): how many ``copies``, whether ``blank``, ``truncated``, and
    whether the same role and text was said in an earlier turn (``said``). Texts are known by their digest."""
    last = F.substring(F.rtrim(F.col("text"), F.lit(WHITE)), -1, 1)
    slim = rows.select(
        key_text("conv_id").alias("conv"), "turn", "role", F.sha2(F.col("text").cast("binary"), 256).alias("digest"),
        (last == "").alias("blank"), (~last.isin(*ENDS)).alias("truncated"),
    )
    turn = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    once = slim.groupBy("conv", "turn", "role", "digest", "blank", "truncated").agg(F.count("*").alias("copies"))
    first = once.groupBy("conv", "role", "digest").agg(F.min(turn).alias("first"))
    return once.join(first, ["conv", "role", "digest"]).withColumn("said", F.col("first") < turn).drop("first")


# --- signatures and values -------------------------------------------------------------------------------------------

SIGNED = "conv string, part long, chunk long, signature string, first string, last string, blank long, duplicate long, truncated long, illegal long"
VALUED = "conv string, part long, chunk long, costs array<long>, audits array<string>"
REPORT = "conv string, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    for batch in batches:
        yield from batch.itertuples(index=False)


def _frames(rows: Iterator[tuple], schema: str, size: int = 2000) -> Iterator[pd.DataFrame]:
    out = []
    for row in rows:
        out.append(row)
        if len(out) >= size:
            yield pd.DataFrame(out, columns=_names(schema))
            out = []
    if out:
        yield pd.DataFrame(out, columns=_names(schema))


def _letter(initial: str, truncated: bool) -> str:
    known = initial if initial and initial in "sua" else "x"
    return known.upper() if truncated else known


def _signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Chunks of the conversations in this partition; rows come in order."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()

    def letters(rows):
        for row in rows:
            initial = row.role[:1]
            if row.blank:
                yield initial, "d", "blank"
            elif row.said:
                yield initial, "d", "duplicate"
            else:
                yield initial, _letter(initial, row.truncated), "truncated" if row.truncated else ""
            for _ in range(row.copies - 1):
                yield initial, "d", "blank" if row.blank else "duplicate"

    def chunks():
        for conv, rows in groupby(_runs(batches), lambda r: r.conv):
            of = letters(rows)
            for chunk, held in enumerate(iter(lambda of=of: list(zip(range(CHUNK), of)), [])):  # noqa: B905
                seen = [x for _, x in held]
                kinds = [k for _, _, k in seen]
                illegal = sum(a[0] + b[0] not in LEGAL for a, b in zip(seen, seen[1:], strict=False))
                counts = (kinds.count(k) for k in ("blank", "duplicate", "truncated"))
                yield conv, part, chunk, "".join(x for _, x, _ in seen), seen[0][0], seen[-1][0], *counts, illegal

    yield from _frames(chunks(), SIGNED)


def _valued(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    suffixes = Suffixes()

    def rows():
        for r in _runs(batches):
            node = [v for row in suffixes.node(r.reverse) for v in row]
            yield r.conv, r.part, r.chunk, [-1 if v is None else v[0] for v in node], ["" if v is None else v[1] for v in node]

    yield from _frames(rows(), VALUED)


def _reported(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A conversation's chunks come from its end: the values of what follows are put behind each."""

    def rows():
        for conv, chunks in groupby(_runs(batches), lambda r: r.conv):
            after = [Rope(0, "", None) if q in _END else None for q in range(4)]
            counts, follows = [0, 0, 0, 0], None
            for r in chunks:
                before = []
                for p in range(4):
                    found = [
                        Rope(r.costs[4 * p + q] + rest.cost, r.audits[4 * p + q], rest)
                        for q, rest in enumerate(after)
                        if rest is not None and r.costs[4 * p + q] >= 0
                    ]
                    before.append(min(found, default=None))
                crossing = follows is not None and r.last + follows not in LEGAL
                counts = [x + y for x, y in zip(counts, (r.blank, r.duplicate, r.truncated, r.illegal + crossing), strict=True)]
                after, follows = before, r.first
            yield conv, *counts, after[START].cost, after[START].text()

    yield from _frames(rows(), REPORT, 200)


def audits(found: DataFrame) -> DataFrame:
    """Per conversation with rows: its counts of faults, the cost of its repair and the audit, one letter an edit:
    K keep, R rerole, D delete, I insert. ``found`` comes from ``faults``, stored."""
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    signed = stored(found.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(_signed, SIGNED), "repair-signatures")
    path = [F.col(c) for c in ("reverse", "conv", "part", "chunk")]
    ends = signed.select("conv", "part", "chunk", F.reverse("signature").alias("reverse"))
    valued = ends.repartitionByRange(*path).sortWithinPartitions(*path).mapInPandas(_valued, VALUED)
    whole = signed.drop("signature").join(valued, ["conv", "part", "chunk"])
    backwards = [F.col("conv"), F.col("part").desc(), F.col("chunk").desc()]
    return whole.repartition("conv").sortWithinPartitions(*backwards).mapInPandas(_reported, REPORT)


# --- repaired rows ---------------------------------------------------------------------------------------------------

REPAIRED = "conv string, place long, turn long, role string, text string, edit string"


def _repaired(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each conversation comes as its audit, then its rows in order; it is never held as a whole."""

    def rows():
        for conv, held in groupby(_runs(batches), lambda r: r.conv):
            audit, state, place = next(held).audit, START, 0
            for edit in audit:
                wanted = _WANTS[state]
                if edit == "I":
                    turn, role, text = None, ROLES[wanted], ""
                else:
                    row = next(held)
                    if edit == "D":
                        continue
                    turn, text = None if pd.isna(row.turn) else int(row.turn), row.text
                    role = row.role if edit == "K" else ROLES[wanted]
                state = _AFTER[role[0]]
                yield conv, place, turn, role, text, edit
                place += 1

    for frame in _frames(rows(), REPAIRED, 500):
        yield frame.astype({"turn": "Int64"})


def repaired(rows: DataFrame, reports: DataFrame) -> DataFrame:
    """The repaired rows: conv (the identifier as text), place, turn (null for inserted rows), role, text, edit. Rows of
    a conversation stay together, in order, in one partition."""
    none = F.lit(None).cast("string")
    said = rows.select(
        key_text("conv_id").alias("conv"), F.lit(1).alias("kind"), "turn", "role", "text",
        F.sha2(F.col("text").cast("binary"), 256).alias("digest"), none.alias("audit"),
    )
    head = reports.select(
        "conv", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), none.alias("role"), none.alias("text"),
        none.alias("digest"), "audit",
    )
    order = [F.col("conv"), F.col("kind"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    return said.unionByName(head).repartition("conv").sortWithinPartitions(*order).mapInPandas(_repaired, REPAIRED)


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def rows():
        for conv, held in groupby(_runs(batches), lambda r: r.conv):
            whole = hashlib.sha256()
            for r in held:
                whole.update(("\n" * (r.place > 0) + f"{r.role}:{r.text}").encode())
            yield conv, whole.hexdigest()

    yield from _frames(rows(), "conv string, repaired_sha256 string")


def report(rows: DataFrame, every: DataFrame) -> DataFrame:
    """One row per conversation of ``every``: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256.

    Rows are taken by turn, nulls first, then role, then the text's digest; repeated rows are adjacent. Of a row's
    faults the first counts: blank, duplicate (its role and text came earlier), truncated. A null identifier is a
    conversation of its own. A conversation without rows has zeros, an empty audit and the digest of the empty text.
    No rows give an empty table. Only the digest and the audit of a conversation, one sequence each, are made in one
    task; its rows pass by and are not held there.
    """
    ship(rows.sparkSession)
    rows = clean(rows)
    found = stored(faults(rows), "repair-faults")
    reports = stored(audits(found), "repair-audits")
    digests = repaired(rows, reports).mapInPandas(_digests, "conv string, repaired_sha256 string")
    turns = found.groupBy("conv", "turn").agg(F.lit(1).alias("one")).groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps")
    )
    kind = every.schema["conv_id"].dataType
    names = every.select(key_text("conv_id").alias("conv")).distinct()
    joined = names.join(turns, "conv", "left").join(reports, "conv", "left").join(digests, "conv", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select(
        F.expr("nullif(conv, '')").cast(kind).alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
