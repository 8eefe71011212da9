"""The registered fingerprints against plain Python: the passages, and the likeness from the two returned texts alone."""

import random
import re
import time

import xxhash
from pyspark.sql import functions as F

from kinsight.llm import iblt
from kinsight.llm.queries import QUERIES

MASK = (1 << 64) - 1
SPACES = " \t\n\x0b\f\r"
OWN_WORD = re.compile("[฀-႟ក-៿぀-ヿ㐀-鿿\U00010000-\U0010ffff]")


def hashed(data, seed=42):
    return xxhash.xxh64(data, seed=seed).intdigest()


def words_of(text):
    """Word by word: white space ends one, characters of scripts without spaces begin one, and so does each behind 24."""
    out, run = [""], 0
    for c in text:
        if c in SPACES:
            out.append("")
            run = 0
            continue
        if OWN_WORD.match(c) or run >= 24:
            out.append("")
        run += 1
        out[-1] += c
    return [w for w in out if w]


def passages(text):
    out, now = set(), []
    for i, w in enumerate(words_of(text)):
        now.append(w)
        if i < 4 or hashed(w.encode()) % 8 == 0:
            out.add(" ".join(now))
            now = []
    return out | ({" ".join(now)} if now else set())


def alike(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def cells(fingerprint):
    size, _, rest = fingerprint.partition("|")
    found = (c.split(":") for c in rest.split(",") if c)
    return int(size or 8), {int(at): (int(n), int(key, 16), int(check, 16)) for at, n, key, check in found}


def places(digest, size):
    first = hashed(digest.to_bytes(8, "little"))
    return [(hashed(t.to_bytes(4, "little"), first) & (size - 1)) * 3 + t for t in range(3)]


def likeness(one, other):
    """Folds the larger table onto the smaller, subtracts, peels; None if something is left."""
    (size_a, a), (size_b, b) = cells(one), cells(other)
    size, left = min(size_a, size_b), {}

    def add(at, n, key, check):
        m, k, c = left.get(at, (0, 0, 0))
        left[at] = (m + n, k ^ key, c ^ check)

    for table, sign in ((a, 1), (b, -1)):
        for at, (n, key, check) in table.items():
            add((at // 3 & (size - 1)) * 3 + at % 3, sign * n, key, check)
    only, moved = {1: 0, -1: 0}, True
    while moved:
        moved = False
        for at, (n, key, check) in list(left.items()):
            if left[at] == (n, key, check) and abs(n) == 1 and check == hashed(key.to_bytes(8, "little")) & 0xFFFFFFFF and at in places(key, size):
                only[n] += 1
                moved = True
                for p in places(key, size):
                    add(p, -n, key, check)
    if any(c != (0, 0, 0) for c in left.values()):
        return None
    of_a = sum(n for at, (n, _, _) in a.items() if at % 3 == 0)
    total = of_a + only[-1]
    return (of_a - only[1]) / total if total else 1.0


def texts(rng):
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(1, 9)))
    rows = [rng.choice([" ", "  ", "\n"]).join(word() for _ in range(rng.choice([0, 1, 3, 30, 300, 900]))) for _ in range(60)]
    rows += ["".join(chr(0x4E00 + rng.randrange(90)) for _ in range(200)), "x" * 300, "abc😀def😀", "é a b", " \t\n", None]
    return [(i * 3, t) for i, t in enumerate(rows)] + [(1000, rows[4]), (1001, rows[4])]


def test_query_against_passages_and_its_own_fingerprints(spark, tmp_path):
    rows = texts(random.Random(8))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in QUERIES["op8_fingerprints"](spark, str(tmp_path)).collect()}
    order = sorted(((i, t or "") for i, t in rows), reverse=True)
    solved = 0
    for k, (doc_id, text) in enumerate(order):
        following, r = order[(k + 1) % len(order)], got[doc_id]
        edited = text[: len(text) - len(text) // 3] + following[1][: len(text) // 3]
        assert abs(r.near_edited - alike(passages(text), passages(edited))) < 1e-12
        assert abs(r.near_next - alike(passages(text), passages(following[1]))) < 1e-12
        for near, other in ((r.near_edited, r.edited_fingerprint), (r.near_next, got[following[0]].fingerprint)):
            from_texts = likeness(r.fingerprint, other)
            solved += from_texts is not None
            assert from_texts is None or abs(from_texts - near) < 1e-12
        assert sum(n for at, (n, _, _) in cells(r.fingerprint)[1].items() if at % 3 == 1) == r.n_parts == len(passages(text))
    assert solved > 1.4 * len(rows)  # those of very different sizes need larger tables than the returned ones
    assert got[1000].fingerprint == got[1001].fingerprint == got[12].fingerprint


def test_what_every_size_leaves_is_compared_whole(spark):
    a, b = list(range(1, 400)), list(range(300, 700))
    pairs = spark.createDataFrame([(0, 0, a, b), (1, 0, a, a), (2, 1, [], [7])], "row long, pair int, a array<long>, b array<long>")
    for sizes in ((1,), (1, 2), (1, 64)):
        found = {(r.row, r.pair): (r.only_a, r.only_b) for r in iblt.differences(pairs.repartition("row"), sizes).collect()}
        assert found == {(0, 0): (299, 300), (2, 1): (0, 1)}


def test_work_is_in_proportion_to_a_texts_length(spark):
    frame = spark.range(1).select(F.lit(0).alias("row"), F.lit(0).alias("pair"))
    seconds = []
    for n in (50_000, 200_000):
        arrays = [F.expr(f"transform(sequence({first}, {first + n}), x -> xxhash64(x) & 281474976710655L)") for first in (0, n // 2)]
        pairs = frame.select("row", "pair", arrays[0].alias("a"), arrays[1].alias("b")).repartition("row")
        start = time.monotonic()
        (found,) = iblt.differences(pairs).collect()
        seconds.append(time.monotonic() - start)
        assert (found.only_a, found.only_b) == (n // 2, n // 2)
    assert seconds[1] < 10 * max(1.0, seconds[0])
