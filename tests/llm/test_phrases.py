import random
import re
from collections import Counter, defaultdict

from kinsight.llm import phrases
from kinsight.llm.queries import QUERIES
from tests.llm.cases import awkward, nothing

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def expected(rows, least, longest=5, top=2000):
    langs, out = defaultdict(list), []
    for lang, text in rows:
        langs["und" if lang is None else lang].append((text or "").translate(LOWER))
    for lang, texts in langs.items():
        f, n = Counter(), 0
        for text in texts:
            for piece in re.split("[.,;:!?\x0a-\x0d]", text):
                words = re.findall("[^\x20\x09]+", piece)
                n += len(words)
                f.update(tuple(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = {
            p[i : i + k] for p, a in found.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if a >= found[p[i : i + k]]
        }
        scored = []
        for p, a in found.items():
            if p not in inside:
                cuts = [(1000 * a * n // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p))]
                score, _, left, right = min(cuts)
                scored.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def invented(rng, size):
    words = ["of", "The", "new", "york", "ÉCOLE", "école", "a-b", "x", "日本", "\x00", "é"]
    marks = [" ", " ", " ", "  ", "\t", ". ", "\n", ", ", "\r\n", ":"]
    return "".join(rng.choice(words) + rng.choice(marks) for _ in range(size))


def test_equal_to_counting_all_phrases(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["en", "de", None]), invented(rng, rng.randint(0, 60))) for _ in range(400)]
    rows += [("en", "new york new york the school of")] * 300 + [("fr", None), ("fr", ""), (None, " \t\n")]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, text string, n long, state string")
    for sizes in ({}, {"block_words": 700, "cell_words": 300}):
        got = phrases.collocations(frame, least=20, **sizes).collect()
        assert sorted(tuple(r) for r in got) == expected(rows, 20)
    assert sorted(tuple(r) for r in phrases.collocations(frame, least=20, longest=3, top=5).collect()) == expected(rows, 20, 3, 5)


def test_awkward_rows(spark):
    frame = awkward(spark)
    rows = [(r.lang, r.text) for r in frame.collect()]
    assert sorted(tuple(r) for r in phrases.collocations(frame, least=3).collect()) == expected(rows, 3)
    assert phrases.collocations(nothing(spark)).collect() == []


def test_query_on_the_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = QUERIES["op13_collocations"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(tuple(r) for r in got) == expected([(r.lang, r.text) for r in docs.collect()], 100)


def test_slices_of_long_texts_end_with_a_piece():
    rng = random.Random(1)
    text = " ".join(invented(rng, 50) for _ in range(20)).encode()
    whole, sliced = phrases.Shard(), phrases.Shard()
    whole.add(text)
    sliced.add(text, slice_bytes=97)
    assert whole.ids == sliced.ids and list(whole.numbers) == list(sliced.numbers)


def test_emptied_tables_give_back_their_space(spark):
    from kinsight.llm.common import emptied, stored

    kept = stored(spark.range(100), "emptied-test")
    folder = kept.inputFiles()[0].rsplit("/", 1)[0]
    emptied(kept)
    assert spark.read.parquet(folder).count() == 0
