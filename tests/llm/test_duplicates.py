import hashlib
import random
import re

import numpy as np

from kinsight.llm import bagminhash, exact_dedup, iblt
from kinsight.llm.mixing import mixed
from kinsight.llm.queries import QUERIES
from tests.llm.cases import ROWS, SCHEMA, awkward, nothing, texts_of


def test_trie_finds_owners_whatever_it_spills():
    rng = random.Random(4)
    texts = ["".join(rng.choices("ab", k=rng.randint(0, 12))).encode() for _ in range(3000)]
    trie, want, spilled = exact_dedup.Patricia(), {}, {}
    for i, text in enumerate(texts):
        trie.insert(text, i % 7, i, 1)
        want.setdefault(text, []).append((-(i % 7), i))
        if i % 500 == 499 and trie.held:
            for key, owner in trie.spill(max(trie.held, key=trie.held.get)):
                spilled.setdefault(key, []).append((-owner.chars, owner.doc_id, owner.copies))
    for key, owner in trie.terminals():
        spilled.setdefault(key, []).append((-owner.chars, owner.doc_id, owner.copies))
    assert {k: (min(v)[:2], sum(x[2] for x in v)) for k, v in spilled.items()} == {k: (min(v), len(v)) for k, v in want.items()}


def owners_by_hand(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text), []).append((doc_id, text))
    out = []
    for body, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))
        sha, kept = hashlib.sha256(body.encode()).hexdigest(), False
        for m in members:
            mine = m == keep and not kept
            kept |= mine
            out.append((m[0], keep[0], len(members), mine, sha))
    return sorted(out, key=str)


def test_exact_duplicates(spark):
    rows = ROWS + [(20, "a b", "en", "s", 1), (21, "ab", "en", "s", 1), (22, "a\tb ", "en", "s", 1), (23, "a\u00a0b", "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sorted(map(tuple, exact_dedup.exact_duplicates(docs).collect()), key=str)
    assert got == owners_by_hand(texts_of(rows))
    assert sorted(exact_dedup.survivors(docs).columns) == sorted(docs.columns)
    assert exact_dedup.survivors(docs).count() == sum(r[3] for r in got)
    tiny = exact_dedup.classes(docs, memory=100).count()
    assert tiny == len({r[4] for r in got})
    assert exact_dedup.exact_duplicates(nothing(spark)).collect() == []
    assert exact_dedup.survivors(awkward(spark)).columns == awkward(spark).columns


def test_signatures_estimate_weighted_jaccard():
    rng, items = np.random.default_rng(1), mixed(np.arange(60), 5)
    a, b = rng.integers(0, 40, 60), rng.integers(0, 40, 60)
    b = np.where(rng.random(60) < 0.6, a, b)
    bags = []
    for w in (a, b):
        order = np.argsort(items[w > 0])
        bags.append((items[w > 0][order], w[w > 0][order]))
    exact = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs(bagminhash.similarity(*bags) - exact) < 1e-12
    shares = [(s[0] == s[1]).mean() for s in (bagminhash.signatures(bags, 256, seed) for seed in range(40))]
    assert abs(np.mean(shares) - exact) < 4 * np.sqrt(exact * (1 - exact) / (256 * 40)) + 0.01


def classes_by_hand(rows, threshold=0.8):
    bags, parent = [bagminhash.shingles(t, 5) for _, t in rows], list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][1] == rows[j][1] or bagminhash.similarity(bags[i], bags[j]) >= threshold - 1e-12:
                parent[find(i)] = find(j)
    out = {}
    for i in range(len(rows)):
        out.setdefault(find(i), []).append(rows[i][0])
    named = {k: min((m for m in v if m is not None), default=None) for k, v in out.items()}
    return sorted([(rows[i][0], named[find(i)], len(out[find(i)])) for i in range(len(rows))], key=str)


def corpus_of_families():
    """Chains in which only neighbours are near, families around one text, texts that repeat a run, and strangers."""
    rng, rows = random.Random(7), []
    new = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    for _ in range(6):
        chain = new(100)
        for _ in range(9):
            rows.append(" ".join(chain))
            at = rng.randrange(90)
            chain = chain[:at] + new(3) + chain[at + 3 :]
    for _ in range(4):
        first = new(120)
        rows += [" ".join([*first[:k], "x", *first[k + 1 :]]) for k in range(0, 120, 6)]
    rows += ["spam " * n for n in (50, 52, 90, 91, 400)]
    rows += [" ".join(new(rng.randint(1, 60))) for _ in range(60)]
    rows += [rows[0], rows[5], "four words only here", "four words  only here"]
    return list(enumerate(rows, 100))


def test_near_duplicate_classes(spark):
    rows = corpus_of_families() + texts_of(ROWS)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, bagminhash.near_duplicates(docs).collect()), key=str)
    want = classes_by_hand(rows)
    assert [g[:2] for g in got if g[0] is not None] == [w[:2] for w in want if w[0] is not None]
    assert sum(g[1] is not None for g in got) and len(got) == len(rows)
    kept = bagminhash.survivors(docs)
    assert kept.count() == len({(w[1], w[2]) if w[1] is not None else w for w in want})


def test_bounds_of_what_texts_share(spark):
    """A group of edited copies with strays: the bound never falls below a similarity, and rules most strays out."""
    from kinsight.llm import bagminhash

    rng = random.Random(6)
    base = [f"w{i}" for i in range(300)]
    edited = lambda share: " ".join(w if rng.random() > share else f"x{rng.random()}" for w in base)
    texts = [edited(0.01) for _ in range(30)] + [edited(0.08) for _ in range(30)] + ["", "one", "one two one two one two one"]
    frame = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    found = {r.node: r for r in bagminhash.overlaps(frame, frame.select("node"), 5).collect()}
    bags = [bagminhash.shingles(t, 5) for t in texts]
    ruled_out = 0
    for i, a in enumerate(bags):
        assert found[i].size == a[1].sum()
        for j, b in enumerate(bags):
            if i != j and found[i].size + found[j].size:
                shared = min(found[i].shared, found[j].shared)
                limit = shared / (found[i].size + found[j].size - shared)
                assert bagminhash.similarity(a, b) <= limit + 1e-12
                ruled_out += limit < 0.8 and 30 <= i < 60 and j < 60
    assert ruled_out > 0.9 * 30 * 59
    rows = list(enumerate(texts))
    got = {(r.doc_id, r.class_id, r.class_size) for r in bagminhash.near_duplicates(frame.withColumnRenamed("node", "doc_id")).collect()}
    assert got == set(classes_by_hand(rows))


def test_strays_that_share_their_edits_find_each_other(spark):
    """One edit in a short text is too far from the original, but texts with the same edit are near."""
    rng, rows = random.Random(12), []
    for family in range(2):
        base = [f"f{family}w{i}" for i in range(40)]
        for _ in range(120):
            at, words = rng.randrange(5, 30), list(base)
            words[at] = f"edit{rng.randrange(3)}"
            rows.append(" ".join([*words, *rng.choice([[], ["end"], ["end", "more"], ["so"]])]))
        rows += [" ".join(base), " ".join(base[:38]), " ".join(base + base[:6])]
    rows = list(enumerate(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, bagminhash.near_duplicates(docs).collect()), key=str)
    assert got == classes_by_hand(rows)


def test_near_duplicates_of_awkward_rows(spark):
    got = bagminhash.near_duplicates(awkward(spark)).collect()
    assert len(got) == len(ROWS)
    assert {r.class_id for r in got if r.doc_id in (1, 2, 3)} == {1}
    assert {r.class_size for r in got if r.doc_id == 1} == {4}
    assert {r.class_id for r in got if r.doc_id in (4, 5)} == {4}  # null counts as empty
    assert {r.class_id for r in got if r.doc_id == 6} == {6}
    assert bagminhash.near_duplicates(nothing(spark)).collect() == []
    assert bagminhash.survivors(awkward(spark)).columns == awkward(spark).columns


def units(text):
    cut = r"\s" if len(text) < 100 else r"\n|(?<=[.!?]) " if len(text) < 1000 else r"\n|(?<=[.!?]) (?=[A-D])"
    return {p.strip(" ") for p in re.split(cut, text, flags=re.ASCII) if p.strip(" ")}


def alike(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints_against_sets_of_paragraphs(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(f"{rng.choice('ABCDEFG')}{rng.randrange(99)} tail.{rng.choice([' ', chr(10)])}" for _ in range(rng.choice([1, 9, 60, 900])))) for i in range(40)]
    rows += [(100, rows[3][1]), (101, rows[3][1] + " More."), (102, ""), (103, " \n "), (104, None), (-5, "日本語。🎉 e\u0301")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, own string").repartition(4)
    got = {r.doc_id: r for r in iblt.document_fingerprints(docs).collect()}
    order = sorted(((i, t or "") for i, t in rows), reverse=True)
    for k, (doc_id, text) in enumerate(order):
        following, cut = order[(k + 1) % len(order)][1], len(text) // 3
        edited, r = text[: len(text) - cut] + following[:cut], got[doc_id]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r.near_edited - alike(units(text), units(edited))) < 1e-12
        assert abs(r.near_next - alike(units(text), units(following))) < 1e-12
        assert (r.fingerprint == r.edited_fingerprint) == (units(text) == units(edited))
    assert got[100].fingerprint == got[3].fingerprint != got[101].fingerprint


def test_near_copies_of_any_length_and_script(spark, tmp_path):
    """Pairs of texts are next to each other by doc_id; the measure beside is of pairs of neighbouring words or letters."""
    rng = random.Random(3)
    words = lambda n: " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(n))[:n]
    han = "".join(chr(0x4E00 + rng.randrange(900)) for _ in range(1100))
    more, kinds = " Then one more sentence ends it.", {}
    kinds["across 100"] = [(t, t + more) for t in (words(n) for n in range(88, 100))]
    kinds["across 1000"] = [(t, t + more) for t in (words(n) for n in range(960, 1000, 4))]
    kinds["no cut"] = [(t, t[:600] + " new " + t[620:]) for t in (words(n) for n in range(1100, 3000, 200))]
    kinds["han"] = [(han[k : k + n], "\u65b0" + han[k : k + n]) for k, n in ((0, 90), (100, 99), (200, 400), (90, 1000))]
    kinds["one run"] = [(t, "z" + t) for t in ("".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=n)) for n in (400, 999, 2000))]
    kinds["strange"] = [(words(900), words(1100)) for _ in range(9)]
    pairs = [(kind, *p) for kind, some in kinds.items() for p in some]
    rows = [(2 * i + side, p[2 - side]) for i, p in enumerate(pairs) for side in (1, 0)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in QUERIES["op8_fingerprints"](spark, str(tmp_path)).collect()}

    def two(text):
        parts = text.split() if " " in text else list(text)
        return set(zip(parts, parts[1:]))

    for kind in kinds:
        found = [(got[2 * i + 1].near_next, alike(two(a), two(b))) for i, (k, a, b) in enumerate(pairs) if k == kind]
        assert abs(sum(f for f, _ in found) - sum(w for _, w in found)) / len(found) < 0.2, (kind, found)
    assert all(r.near_edited > 0.1 for r in got.values())


def test_fingerprints_of_repeated_and_null_rows(spark):
    got = iblt.document_fingerprints(awkward(spark)).collect()
    assert len(got) == len(ROWS) and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    twice = [r for r in got if r.doc_id == 2]
    assert sorted(r.near_next for r in twice) == [1.0, 1.0]  # its repetition, then the equal text of document 1
    assert iblt.document_fingerprints(nothing(spark)).collect() == []
    (alone,) = iblt.document_fingerprints(awkward(spark).filter("doc_id = 1")).collect()
    assert alone.near_next == 1.0


def test_a_table_that_is_too_small_is_tried_again_larger(spark):
    a, b = list(range(1, 400)), list(range(300, 700))
    frame = spark.createDataFrame([(0, "p", a, b), (1, "p", [], []), (2, "p", a, a), (3, "p", [5], [])], "row long, pair string, a array<long>, b array<long>")
    for sizes in ((8, 8, 16, 32, 64, 128), (8, 64), (8,)):
        got = {r.row: r.likeness for r in iblt.likeness(frame, sizes).collect()}
        assert got[1] == 1.0 and got[2] == 1.0 and got[3] == 0.0
        if len(sizes) > 2:
            assert abs(got[0] - 100 / 699) < 1e-12
