import itertools
import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from kinsight.llm import language, toxicity, url_filter
from tests.llm.cases import ROWS, awkward, nothing, texts_of

SF = "/root/testdata/sf0.01"
LABELS = "doc_id long, quality int, toxic int"


def test_toxicity_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = toxicity.score(docs, labels)
    rows = got.join(labels, "doc_id").filter("held_out").collect()
    assert got.count() == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_toxicity_takes_awkward_rows_and_empty_tables(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (3, 0, 1), (5, None, None), (None, 1, 1), (8, 1, 0)], LABELS)
    got = toxicity.score(awkward(spark), labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(nothing(spark), labels).collect() == []
    assert {r.score for r in toxicity.score(awkward(spark), labels.filter("false")).collect()} == {0.0}
    kept = toxicity.accepted(awkward(spark), labels.filter("false"))
    assert {r["__score"] for r in kept.collect()} <= {"x__score"}
    assert kept.columns == awkward(spark).columns and kept.count() == len(ROWS)


def test_isotonic_is_the_best_monotone_fit():
    rng = np.random.default_rng(0)
    margin = rng.normal(size=60)
    y = (rng.random(60) < 1 / (1 + np.exp(-margin))).astype(float)
    at, share = toxicity.isotonic(margin, y)
    assert (np.diff(share) > 0).all() and (np.diff(at) > 0).all()
    ordered = y[np.argsort(margin)]
    cuts = [max(min(ordered[i : j + 1].mean() for j in range(k, 60)) for i in range(k + 1)) for k in range(60)]
    assert np.allclose(sorted(set(np.round(cuts, 9))), np.unique(np.round(share, 9)))


def test_trees_separate_a_nonlinear_rule():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    assert ((toxicity.Trees().fit(x[:2000], y[:2000]).margins(x[2000:]) > 0) == (y[2000:] > 0)).mean() > 0.95


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows)
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97


def test_language_takes_awkward_rows_and_empty_tables(spark):
    got = language.identify(awkward(spark)).collect()
    assert len(got) == len(ROWS)
    letters = {(i, any(c.isalpha() for c in t)) for i, t in texts_of(ROWS)}
    assert all((r.lang_pred == "und") == ((r.doc_id, True) not in letters) for r in got if r.doc_id is not None)
    assert all(r.score == 0 for r in got if r.lang_pred == "und") and all(0 <= r.score <= 1 for r in got)
    assert language.identify(nothing(spark)).collect() == []
    assert {r.lang_pred for r in language.identify(awkward(spark).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.accepted(awkward(spark)).columns == awkward(spark).columns


def test_texts_in_no_learned_language_go_and_short_ones_stay(spark):
    rng, docs = random.Random(6), spark.read.parquet(f"{SF}/documents.parquet")
    alphabets = {
        "cyrillic": [chr(c) for c in range(0x430, 0x450)], "greek": [chr(c) for c in range(0x3B1, 0x3CA)],
        "han": [chr(c) for c in range(0x4E00, 0x5200)], "arabic": [chr(c) for c in range(0x627, 0x64B)], "random": list("abcdefghijklmnopqrstuvwxyz"),
    }
    word = lambda letters: "".join(rng.choices(letters, k=rng.randint(2, 9)))
    made = [(-1 - i, " ".join(word(letters) for _ in range(150)), None) for i, letters in enumerate(a for a in alphabets.values() for _ in range(30))]
    rows = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(made, "doc_id long, text string, lang string"))
    short = docs.filter("length(text) > 100").select((F.col("doc_id") + 10_000_000).alias("doc_id"), F.expr("left(text, 60)").alias("text"), F.lit(None).cast("string").alias("lang"))
    kept = {r.doc_id for r in language.accepted(rows.unionByName(short)).select("doc_id").collect()}
    assert sum(i in kept for i, _, _ in made) <= 3
    clean = {r.doc_id for r in docs.filter("text rlike '[a-z]'").select("doc_id").collect()}
    assert len(clean - kept) <= 0.005 * len(clean)
    brief = {r.doc_id for r in short.select("doc_id").collect()}
    assert len(brief - kept) <= 0.03 * len(brief)


def test_many_distinct_letters_take_bounded_memory():
    import tracemalloc

    rng = np.random.default_rng(8)
    texts = ["".join(map(chr, rng.integers(0x4E00, 0x9FA5, 395))) for _ in range(500)]
    space = language.LetterSpace(1024, 3, 5)
    space.sums(texts[:1])
    tracemalloc.start()
    sums = space.sums(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 250e6
    alone = np.concatenate([language.LetterSpace(1024, 3, 5).sums([t]) for t in texts[:3]])
    assert np.allclose(sums[:3], alone, atol=1e-5)


def test_profile_is_the_sum_of_bound_letters():
    space = language.LetterSpace(256, 3, 5)
    text = "Ab, é1c"
    marks = [0, ord("a"), ord("b"), 0, ord("é"), 0, ord("c"), 0]
    want = sum(np.roll(space.letter(a), 2) * np.roll(space.letter(b), 1) * space.letter(c).astype(int) for a, b, c in zip(marks, marks[1:], marks[2:]))
    assert np.allclose(space.sums([text, "", "12"])[0], want / np.linalg.norm(want), atol=1e-6)
    assert not space.sums(["", "12 !"]).any()
    assert np.allclose(space.sums([text] * 50, together=3), space.sums([text] * 50))


RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
URLS = [
    "http://A.Example.COM/en/x?y#z", "https://www.example.com/en/", "http://www.example.com/de", "ftp://x.net/es/1", "//x.net/es/1",
    "http://example.com", "http://notexample.com/en/", "http://net/fr/#a", "a://b://c/d", "http://x.org?x=/en/", "", None,
    "http://casino-win.org/en/1", "http://example.com:80/en/", "http://ÄB.com/ü", "http://spamfarm.org/x", "http://x.com/" + "a" * 5000, "http:///p",
]


def by_hand(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    end = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    host = "".join(c.lower() if c in url_filter.UPPER else c for c in rest[:end])
    path = rest[end:]
    path = path[: min([i for i in (path.find(c) for c in "?#") if i >= 0], default=len(path))]
    best = (None, None)
    for verdict, rule in sorted(RULES, key=lambda r: len(r[1])):
        domain, beginning = rule.split("/", 1)
        if (host == domain or host.endswith("." + domain)) and path.startswith("/" + beginning):
            best = rule, verdict
    return host, path, *best


def test_urls_are_taken_apart_and_ruled(spark):
    pages = spark.createDataFrame([(i, u, "<title>cheap pills spam farm win</title>", "x") for i, u in enumerate(URLS)] + [(None, None, None, None)], "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in url_filter.judge(pages, RULES, most_words=100).collect()}
    for i, url in enumerate(URLS):
        host, path, rule, verdict = by_hand(url)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), url
        assert got[i].verdict in ({verdict} if verdict else {"allow", "block"})
    assert got[12].verdict == "block" and got[11].verdict == "allow"
    assert got[15].words == ["spam", "farm", "org", "x"]
    assert url_filter.judge(pages.filter("false"), RULES).collect() == []


def test_split_is_the_most_probable():
    words = url_filter.Unigrams({"cheap": 4, "pills": 3, "on": 9, "line": 5, "online": 2, "a": 9, "heap": 1})

    def score(parts):
        return sum(words.logs.get(p, words.unknown[len(p)]) for p in parts)

    for text in ("cheappillsonline", "aheap", "xonline", "zzzz"):
        cuts = range(1, len(text))
        ways = (
            [text[a:b] for a, b in itertools.pairwise([0, *c, len(text)])] for n in range(min(len(text), 5)) for c in itertools.combinations(cuts, n)
        )
        assert math.isclose(score(words.split(text)), max(map(score, ways)))
    assert words.split("cheappillsonline") == ["cheap", "pills", "online"]


def test_samples_of_huge_tables_are_bounded_and_not_empty(spark):
    from pyspark.sql import functions as F

    from kinsight.llm.common import bounded_sample, hash_bound

    for total in (30_000, 2 * 10**10, 5 * 10**10, 10**12, 10**15):
        share = (hash_bound(20_000, total) + 2**63) / 2**64
        assert 0.999 < share * total / 20_000 < 1.001
    rows = spark.range(50_000).withColumn("text", F.lit("x"))
    assert 1_800 < bounded_sample(rows, "id", 2_000).count() < 2_200


def test_accepted_languages_learn_from_every_learning_text(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    want = sorted(r.doc_id for r in language.accepted(docs).collect())
    assert len(want) > 280
    model = language.fit(docs, None)
    learning = [r for r in docs.collect() if r.text is not None and r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    space = language.letter_space(1024, 3, 5)
    for lang, length in zip(model.languages, model.lengths, strict=True):
        assert math.isclose(np.linalg.norm(space.sums([r.text for r in learning if r.lang == lang]).sum(axis=0)), length, rel_tol=1e-3)
    monkeypatch.setattr(language, "bounded_sample", lambda rows, *_: rows.limit(0))
    assert sorted(r.doc_id for r in language.accepted(docs).collect()) == want
