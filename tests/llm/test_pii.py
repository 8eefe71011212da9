import random
import re

from kinsight.llm import pii
from kinsight.llm.common import stored
from tests.llm.cases import LONG, awkward, nothing


def plain_spans(text):
    """The four forms, read with their patterns as given."""
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        if 13 <= len(digits) <= 19 and sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits[::-1])) % 10 == 0:
            found.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append(("phone", *m.span()))
    return found


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def test_forms_equal_their_patterns():
    rng = random.Random(1)
    for _ in range(5000):
        text = "".join(rng.choices("a.@-1234+ ()_é9%" + rng.choice(["1", "@b.", ".", "+4"]), k=rng.randint(0, 45)))
        assert pii.base_spans(text) == plain_spans(text), text
    for _ in range(500):
        bits = ["4111 1111 1111 1111", "4111-1111-1111-1112", "+49 (0) 30 901820-5", "10.0.0.256", "10.0.0.25.7", "a@b.c_d@e.f", "+1 2"]
        text = " ".join(rng.choices(bits, k=6))
        assert pii.base_spans(text) == plain_spans(text), text


def test_long_runs_take_no_longer_than_their_length():
    for text in ("1" * 300_000, "a" * 300_000, "a@" * 100_000, "+1" * 100_000, "1." * 100_000):
        pii.base_spans(text)


def test_query_on_awkward_rows(spark):
    got = pii.personal_data(awkward(spark)).collect()
    assert len(got) == awkward(spark).count() and all(r.base == r.spans == "" for r in got)
    rows = [(None, "a@b.cd"), (1, None), (1, "a@b.cd 1.2.3.4"), (1, "a@b.cd 1.2.3.4"), (2, LONG + " +49 30 1234567")]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, digest string")
    got = {(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base) for r in pii.personal_data(frame).collect()}
    assert got == {(i, *(joined(plain_spans(t or "")).count(k + ":") for k in pii.KINDS), joined(plain_spans(t or ""))) for i, t in rows}
    assert pii.personal_data(nothing(spark)).collect() == []


def corpus():
    rng = random.Random(4)
    filler = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(400)]
    some = lambda n: " ".join(rng.choices(filler, k=n))
    rows = [(i, f"{some(9)} zorblax {some(3)} bob@x.org {some(9)}") for i in range(12)]
    rows += [(100 + i, f"{some(20)} the zorblax {some(5)}") for i in range(2)]
    rows += [(200 + i, some(25)) for i in range(300)]
    # near copies: their rare words stand beside the address in every text that has them
    copy = some(8) + " unusual rarely seen words carl@y.org beside another address "
    return rows + [(1000 + i, f"{copy}{some(8)} tail{i}") for i in range(60)] + [(2000 + i, rows[0][1]) for i in range(40)]


def test_words_that_disclose_by_brute_force(spark):
    """Probabilities counted again text by text, from the rule in the module's docstring."""
    import math
    import zlib

    texts = sorted({t for _, t in corpus()})
    joins, beside, words_of = {}, {}, {}
    for text in texts:
        spans = plain_spans(text)
        inside = lambda m, spans=spans: any(m.start() < b and a < m.end() for _, a, b in spans)
        words = [m for m in re.finditer(r"\w{3,}", text) if not inside(m)]
        words_of[text] = {m[0].lower() for m in words}
        for kind, a, b in spans:
            entity = (kind, text[a:b].lower())
            beside.setdefault(entity, set()).add(text)
            near = {m[0].lower() for m in [m for m in words if m.end() <= a][-8:] + [m for m in words if m.start() >= b][:8]}
            for word in near:
                mark = min(near - {word}, key=lambda w: (zlib.crc32(w.encode()), w), default="")
                joins.setdefault((entity, word), set()).add((text, mark))
    disclosed = {}
    for (entity, word), found in joins.items():
        both, marks, n_entity = len({t for t, _ in found}), len({m for _, m in found}), len(beside[entity])
        n_word = sum(word in w for w in words_of.values())
        if marks >= 5 and marks >= 0.2 * both and n_entity < len(texts):
            gain = 1 + math.log(both / n_word) / math.log(len(texts) / n_entity)
            disclosed[word] = max(gain, disclosed.get(word, 0))
    kinds = {w: "removed" if g >= 0.98 else "general" for w, g in disclosed.items() if g >= 0.9}
    assert kinds.get("zorblax") == "general" and not kinds.keys() & {"unusual", "rarely", "another"}
    frame = spark.createDataFrame(corpus(), "doc_id long, text string")
    got = {(r.doc_id, r.spans) for r in pii.personal_data(frame).collect()}
    want = set()
    for doc_id, text in corpus():
        extra = [(kinds[m[0].lower()], *m.span()) for m in re.finditer(r"\w{3,}", text) if m[0].lower() in kinds]
        spans = plain_spans(text)
        extra = [x for x in extra if not any(x[1] < b and a < x[2] for _, a, b in spans)]
        want.add((doc_id, joined(spans + sorted(extra))))
    assert got == want


def test_sanitised_texts_keep_other_columns(spark):
    frame = spark.createDataFrame([(*r, "kept", 1) for r in corpus()] + [(None, None, None, 2)], "doc_id long, text string, digest_0 string, SPANS_0 int")
    got = {r.doc_id: r for r in pii.sanitised(frame).collect()}
    assert len(got) == len({i for i, _ in corpus()}) + 1 and got[None].text == ""
    assert "zorblax" not in got[100].text and "[WORD]" in got[100].text
    assert "bob@x.org" not in got[0].text and "[EMAIL]" in got[0].text
    assert got[200].text == dict(corpus())[200] and got[200].digest_0 == "kept"


def test_tables_on_the_way_are_few_files(spark, monkeypatch):
    """Each file costs a process or two on local file systems, whatever the number of partitions of tables and shuffles."""
    made = {}

    def noted(df, purpose, **bounds):
        made[purpose] = stored(df, purpose, **bounds)
        return made[purpose]

    monkeypatch.setattr(pii, "stored", noted)
    settings = {"spark.sql.shuffle.partitions": "97", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        frame = spark.createDataFrame(corpus(), "doc_id long, text string").repartition(50)
        assert pii.personal_data(frame).count() == len(corpus())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    files = {purpose: len(df.inputFiles()) for purpose, df in made.items()}
    assert made["pii-places"].count() > 10 and files.keys() == {"pii-scan", "pii-candidates", "pii-places"}
    assert max(files.values()) <= spark.sparkContext.defaultParallelism, files
