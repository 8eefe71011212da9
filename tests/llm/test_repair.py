import hashlib
import heapq
import random
import re
import zlib

from kinsight.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"
NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        if fate:
            out += [(conv, turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return out


def cheapest(initials, faults, rows):
    """Uniform-cost search; among equal costs the least audit comes first."""
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, said, lines = heapq.heappop(heap)
        if (i, said[-1:]) in done:
            continue
        if i == len(rows) and said[-1:] in ("", "a"):
            return cost, audit, "\n".join(lines)
        done.add((i, said[-1:]))
        ok = NEXT[said[-1:]]
        steps = [(3, "I", i, x, f"{name}:") for x, name in (("u", "user"), ("a", "assistant")) if x in ok]
        if i < len(rows):
            role, text = rows[i][2:]
            steps.append((4, "D", i + 1, "", None))
            if faults[i] not in ("blank", "duplicate"):
                extra = 3 * (faults[i] == "truncated")
                if initials[i] and initials[i] in ok:
                    steps.append((extra, "K", i + 1, initials[i], f"{role}:{text}"))
                steps += [(3 + extra, "R", i + 1, x, f"{n}:{text}") for x, n in (("u", "user"), ("a", "assistant")) if x in ok]
        for more, edit, j, x, line in steps:
            heapq.heappush(heap, (cost + more, audit + edit, j, said + x, lines if line is None else (*lines, line)))


def expected(rows):
    out, left = [], damaged(rows)
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in left if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest()))
        turns = [r[1] for r in own if r[1] is not None]
        faults, seen = [], set()
        for _, _, role, text in own:
            signs = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not signs else "duplicate" if (role, text) in seen else "truncated" if signs[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [r[2][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        cost, audit, whole = cheapest(initials, faults, own)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        out.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256(whole.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of_all_kinds():
    rng, rows = random.Random(5), []
    roles, texts = ["user", "assistant", "assistant", "system", "tool", "", None], ["a.", "b", "c!", "", " \n", None, "d? ", "a.", "é"]
    for conv in range(80):
        rows += [(conv, t + rng.choice([0, 0, 0, 3]), rng.choice(roles), rng.choice(texts)) for t in range(rng.randint(0, 12))]
    rows += [(None, None, "user", "x."), (None, None, "user", "x."), (None, 3, "assistant", "y"), (500, None, "user", "a")]
    rows += [(2**53 + 1, 0, "user", "q."), (2**53 + 1, 1, "assistant", "word " * 50_000 + ".")]
    # longer than one chunk, with rows that tie
    return rows + [(600, i // 2, rng.choice(roles[:5]), rng.choice(["a", "b.", f"c{i}.", f"d{i}"])) for i in range(400)]


def test_report_equals_search(spark):
    rows = rows_of_all_kinds()
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", conv string, fate int")
    got = repair.report(repair.damaged(frame), frame).collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(rows)


def test_nothing_to_report(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert repair.report(repair.damaged(none), none).collect() == []
    alone = spark.createDataFrame([(1, 0, "user", "a.")], SCHEMA)
    row = repair.report(none, alone).collect()[0]
    assert tuple(row) == (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_suffixes_are_valued_once():
    suffixes, rng = repair.Suffixes(), random.Random(2)
    ends = sorted("".join(rng.choices("suadUA", k=rng.randint(0, 6))) for _ in range(500))
    for reverse in ends:
        node = repair.EMPTY
        for letter in reverse:
            node = repair.preceded(letter, node)
        assert suffixes.node(reverse) == node
    assert suffixes.valued == len({e[:n] for e in ends for n in range(1, len(e) + 1)})


def test_repaired_rows_are_legal(spark):
    rows = spark.createDataFrame(rows_of_all_kinds(), SCHEMA)
    clean = repair.clean(repair.damaged(rows))
    reports = repair.audits(repair.faults(clean))
    whole = {}
    for r in sorted(repair.repaired(clean, reports).collect(), key=lambda r: (r.conv, r.place)):
        whole[r.conv] = whole.get(r.conv, "") + r.role[0]
    assert whole and all(re.fullmatch("(s?(ua)+)?", w) for w in whole.values())
