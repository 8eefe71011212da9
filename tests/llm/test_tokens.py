import random

import numpy as np
import pytest

from kinsight.llm import gumbel_pieces, packing, token_files
from kinsight.llm.common import run_folder
from kinsight.llm.encoding import ChunkEncoder, vocabulary_path
from kinsight.llm.mixing import mixed
from tests.llm.cases import LONG, ROWS, awkward, nothing, texts_of

BYTES, WORDS, PIECES = (vocabulary_path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))


@pytest.mark.parametrize(("path", "kept"), [(BYTES, True), (WORDS, False)])
def test_ids_are_the_librarys(path, kept):
    rng = random.Random(5)
    alphabet = [" ", "\n", "\t", "a", "b", ".", ",", "'s", "1", "é", "İ", "ß", "A", "中", "\u0301", "\x1c", "\u00a0", "<|endoftext|>", "ing", "²"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(3000)] + ["", " ", "don't  stop", LONG]
    encode = ChunkEncoder(path, kept, limit=500)
    want = [np.array(encode.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert encode(texts) == want and encode(texts) == want


@pytest.mark.parametrize(("path", "kept"), [(BYTES, True), (WORDS, False)])
def test_two_byte_ids_and_lines_ends_between_words(path, kept):
    texts = ["one two.\nThree four", "a\n b", "a \nb", "x.\n\nY z", " lead", "trail ", "two  spaces", "naïve,\nÉté!? it's\nso", "\n", "é\u00a0b c", "a b\n", "", "a<|endoftext|> b"]
    encode = ChunkEncoder(path, kept)
    want = [encode.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for together in (1, 10, 4_000_000):
        for width in (2, 4):
            assert [np.frombuffer(b, f"<u{width}").tolist() for b in encode(texts, width=width, together=together)] == want


def test_words_are_looked_up_without_case_and_closing_marks():
    encode, rng = ChunkEncoder(WORDS, False), random.Random(8)
    encode(["Word word, WORD; word! word*** \u00c9t\u00e9. \u00e9t\u00e9"])
    assert len(encode.chunks.new) == 2
    letters = [chr(c) for c in range(0x260) if chr(c).isalpha()] + list("'_*.,!?-(\"$%~ 1\u2c65\u0301\n")
    texts = ["".join(rng.choices(letters, k=rng.randint(1, 12))) + rng.choice(["", ".", "!!", "'s", "'", "_.", "***", "\u2026"]) for _ in range(6000)]
    want = [encode.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(b, "<u2").tolist() for b in encode(texts, width=2, together=5000)] == want


def ids_of(encode, text, end):
    return np.array([*encode.tokenizer.encode(text, add_special_tokens=False).ids, end], "<u4")


def check_pieces(pieces, window):
    by_sequence, by_document = {}, {}
    for p in pieces:
        assert len(p.ids) == 4 * p.length and p.length > 0
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
        by_document.setdefault((p.doc_id, p.doc_tokens), []).append((p.start, p.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == window or at & (at - 1) == 0 and at < window
    return by_sequence, by_document


def test_packing_loses_no_id(spark):
    pieces = packing.pack(awkward(spark), BYTES, bucket_rows=1).collect()
    check_pieces(pieces, 1024)
    encode, got, want = ChunkEncoder(BYTES, True), {}, {}
    for p in pieces:
        got.setdefault(p.doc_id, []).append(p.ids)
    for doc_id, text in texts_of(ROWS):
        want.setdefault(doc_id, []).append(ids_of(encode, text, 0))
    for doc_id, texts in want.items():
        assert sum(len(x) for x in got[doc_id]) == sum(4 * len(t) for t in texts)
        if len(texts) == 1:
            parts = sorted((p for p in pieces if p.doc_id == doc_id), key=lambda p: p.start)
            assert b"".join(p.ids for p in parts) == texts[0].tobytes()
    assert packing.pack(nothing(spark), BYTES).collect() == []


def test_packing_when_all_rests_are_alike(spark):
    docs = spark.range(500).selectExpr("id as doc_id", "'one two three' as text")
    pieces = packing.pack(docs, BYTES, window=16).collect()
    _, documents = check_pieces(pieces, 16)
    assert len({p.doc_id for p in pieces}) == 500 and sum(p.length for p in pieces) == 500 * 4


def test_plan_places_every_rest_once():
    rng = np.random.default_rng(2)
    for counts in (rng.integers(0, 50, 64), np.where(np.arange(64) == 40, 1000, 0), rng.integers(0, 2, 64)):
        plan = packing.Plan(dict(enumerate(counts.tolist())), 64)
        used = {}
        for length in range(1, 64):
            for rank in range(int(counts[length])):
                parts = plan.place(length, rank)
                assert sum(p[0] for p in parts) == length
                for size, sequence, offset in parts:
                    cells = used.setdefault(sequence, set())
                    new = set(range(offset, offset + size))
                    assert not cells & new and offset + size <= 64
                    cells |= new
        assert all(s < plan.first_whole for s in used)
        assert all(len(c) == 64 or len(c) & (len(c) - 1) == 0 for c in used.values())
        assert all(c == set(range(len(c))) for c in used.values())


def test_combinations_and_least_squares():
    columns = packing.combinations(np.array([1, 3, 4, 5, 9]), 10)
    assert sorted(map(tuple, columns.tolist())) == [(1, 4, 5), (1, 9, 0), (3, 3, 4), (5, 5, 0)]
    counts = np.array([0, 7, 0, 8, 6, 4, 0, 0, 0, 5], float)  # 5 x (1,9), 2 x (1,4,5), 4 x (3,3,4), 1 x (5,5)
    x = packing.least_squares(columns, counts)
    want = {(1, 9, 0): 5, (1, 4, 5): 2, (3, 3, 4): 4, (5, 5, 0): 1}
    assert (x >= 0).all() and all(abs(x[k] - want[tuple(c)]) < 0.1 for k, c in enumerate(columns.tolist()))


def test_perfect_hash_is_minimal_and_tells_strangers():
    values = mixed(np.arange(20_000), 1)
    table = token_files.PerfectHash.build(values)
    assert sorted(table.slots(values)) == list(range(20_000))
    assert len(table.bits) < 5 * 20_000
    assert token_files.PerfectHash.build(values[:0]).slots(values[:3]).tolist() == [-1, -1, -1]


def test_token_files_round_trip(spark):
    folder = run_folder(spark, "tokens")
    token_files.write(awkward(spark), folder, WORDS, 2, shard_tokens=50)
    rows = token_files.read(spark, folder).orderBy("start").collect()
    encode, at = ChunkEncoder(WORDS, False), 0
    want = sorted(texts_of(ROWS), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in rows] == [w[0] for w in want]
    for r in rows:
        assert r.start == at and r.n_tokens * 4 == len(r.ids)
        at += r.n_tokens
    encoded = {}
    for doc_id, text in want:
        encoded.setdefault(doc_id, []).append(ids_of(encode, text, 2).tobytes())
    assert all(sorted(r.ids for r in rows if r.doc_id == k) == sorted(v) for k, v in encoded.items())
    found = token_files.lookup(spark, folder, [1, 8, -9, 77]).collect()
    assert {r.doc_id: r.ids for r in found} == {k: encoded[k][0] for k in (1, 8, -9)}
    empty = run_folder(spark, "tokens")
    token_files.write(nothing(spark), empty, WORDS, 2)
    assert token_files.read(spark, empty).collect() == []


def every_path(lattices, text):
    """All segmentations of a small text with their probabilities, by recursion."""
    whole, found = gumbel_pieces.MARK + text.replace(" ", gumbel_pieces.MARK), {}

    def go(i, ids, weight):
        if i == len(whole):
            found[ids] = found.get(ids, 0) + weight
            return
        single = False
        for j in range(i + 1, len(whole) + 1):
            hit = lattices.pieces.get(whole[i:j])
            if hit:
                go(j, (*ids, hit[0]), weight * hit[1])
                single |= j == i + 1
        if not single:
            raw = whole[i].encode()
            go(i + 1, (*ids, *(lattices.bytes[b] for b in raw)), weight * lattices.byte_weight ** len(raw))

    go(0, (), 1.0)
    total = sum(found.values())
    return {k: w / total for k, w in found.items()}


def test_samples_follow_the_distribution_without_replacement():
    lattices = gumbel_pieces.Lattices(PIECES, 0.2)
    exact, n = every_path(lattices, "ab c\n中a"), 6000
    groups = gumbel_pieces.sample_group(lattices, ["ab c\n中a"] * n, mixed(np.arange(n), 3), 3)
    ids = [[tuple(lattices.ids[p.children].tolist()) for p in paths] for paths, _ in groups]
    assert all(len(set(x)) == 3 for x in ids)
    for path, p in exact.items():
        second = sum(exact[o] * p / (1 - exact[o]) for o in exact if o != path)
        for place, want in ((0, p), (1, second)):
            share = sum(x[place] == path for x in ids) / n
            assert abs(share - want) < 4 * np.sqrt(want * (1 - want) / n) + 1e-3
    for paths, following in groups[:200]:
        values = [p.perturbed for p in paths] + [following]
        assert values == sorted(values, reverse=True)
        assert all(abs(p.log_prob - np.log(exact[tuple(lattices.ids[p.children].tolist())])) < 1e-9 for p in paths)
    # with the inclusion scores as weights, the sampled probabilities add up to one on average
    sums = [sum(np.exp(p.log_prob) / -np.expm1(-np.exp(p.log_prob - after)) for p in paths) for paths, after in groups]
    assert abs(np.mean(sums) - 1) < 0.05


def test_all_segmentations_are_found_when_asked_for():
    lattices = gumbel_pieces.Lattices(PIECES, 0.2)
    for text in ("", "a", "ab c", "中"):
        exact = every_path(lattices, text) if text else {(): 1.0}
        ((paths, following),) = gumbel_pieces.sample_group(lattices, [text], mixed(np.arange(1), 3), len(exact) + 5)
        assert {tuple(lattices.ids[p.children].tolist()) for p in paths} == set(exact) and following == -np.inf


def test_samples_decode_to_the_text_and_repeat(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = gumbel_pieces.sample_segmentations(awkward(spark), PIECES, k=2).collect()
    again = gumbel_pieces.sample_segmentations(awkward(spark).repartition(5), PIECES, k=2).collect()
    order = lambda rows: sorted(map(tuple, rows), key=str)
    assert order(got) == order(again)
    texts = {}
    for doc_id, text in texts_of(ROWS):
        texts.setdefault(doc_id, set()).add(text)
    for r in got:
        assert model.decode(np.frombuffer(r.ids, np.int32).tolist()) in texts[r.doc_id] and r.n_pieces * 4 == len(r.ids)
    assert gumbel_pieces.sample_segmentations(nothing(spark), PIECES).collect() == []


def test_every_sample_decodes_in_spark(spark):
    from pyspark.sql import functions as F

    given = awkward(spark)
    found = gumbel_pieces.decode(gumbel_pieces.sample_segmentations(given, PIECES, k=3), PIECES)
    want = {}
    for doc_id, text in texts_of(ROWS):
        want.setdefault(doc_id, set()).add(text)
    rows = found.collect()
    assert {i: {r.text for r in rows if r.doc_id == i} for i in want} == want
    clashing = given.withColumn("ids", F.when(F.col("doc_id") != 3, F.lit(b"")))
    back = gumbel_pieces.decode(clashing, PIECES).collect()
    assert len(back) == len(ROWS) and {r.text for r in back} == {"", None} and back[0].source is not None
    assert gumbel_pieces.decode(nothing(spark), PIECES).collect() == []


def test_decoding_is_the_librarys():
    import sentencepiece

    model, known = sentencepiece.SentencePieceProcessor(model_file=PIECES), gumbel_pieces.Spellings(PIECES)
    rng = np.random.default_rng(4)
    size = model.get_piece_size()
    alike = [i for i in range(size) if not model.is_byte(i)]
    broken = [i for i in range(size) if model.is_byte(i)][128:]
    for _ in range(2000):
        ids = [int(rng.choice(broken if rng.random() < 0.3 else alike)) for _ in range(rng.integers(0, 12))]
        assert known.text(np.array(ids, "<i4").tobytes()) == model.decode(ids), ids
    for text in ("", "  two  spaces ", "a\tb\nc", "日本語 🎉 e\u0301", "x" * 5000):
        assert known.text(np.array(model.encode(text), "<i4").tobytes()) == model.decode(model.encode(text))
    assert known.text(np.array([-5, size + 9], "<i4").tobytes()) == " \u2047  \u2047 "


def test_long_part_without_a_cut():
    lattices = gumbel_pieces.Lattices(PIECES, 0.2)
    text = "abcde" * 800
    ((paths, _),) = gumbel_pieces.sample_group(lattices, [text], mixed(np.arange(1), 3), 2)
    assert all(np.isfinite(p.log_prob) for p in paths)
    pieces = [lattices.ids[p.children].tolist() for p in paths]
    whole = sorted((i, p) for p, (i, _) in lattices.pieces.items())
    spelled = ["".join(dict(whole)[i] for i in ids) for ids in pieces]
    assert spelled == [gumbel_pieces.MARK + text] * 2 and pieces[0] != pieces[1]


def test_lattices_of_new_words_are_made_together(monkeypatch):
    """All words of a group are added at once, with the probabilities that each has alone."""
    letters, words = "etaoinshr", []
    for n in range(600):
        words.append("".join(letters[int(x)] for x in np.base_repr(n * 7919 + 11, 9)))
    words += ["it's", "x=1;y", "日本", "a\nb", "end.", "end"]
    lattices, added = gumbel_pieces.Lattices(PIECES, 0.2), []
    add = gumbel_pieces.Lattices._add
    monkeypatch.setattr(gumbel_pieces.Lattices, "_add", lambda self, *a: (added.append(1), add(self, *a))[1])
    starts = gumbel_pieces.begun(lattices, [" ".join(words), "", "  two  spaces "])
    assert len(added) <= 20 and len(starts[1]) == 0
    for word in words[:600:7]:
        own, n = lattices.parts[gumbel_pieces.MARK + word], len(word) + 1
        lattices.release()
        other = lattices._general(gumbel_pieces.MARK + word)
        lattices.views()
        for k in range(n):
            a, b = lattices.children(own + k), lattices.children(other + k)
            assert list(lattices.ids[a.start : a.stop]) == list(lattices.ids[b.start : b.stop])
            assert np.allclose(lattices.shares[a.start : a.stop], lattices.shares[b.start : b.stop])


def test_words_are_known_with_any_punctuation():
    lattices, rng, mark = gumbel_pieces.Lattices(PIECES, 0.2), random.Random(6), gumbel_pieces.MARK
    gumbel_pieces.begun(lattices, ["words words, words; words!? words"])
    assert set(lattices.chunks) == {"words"}
    alphabet = "aetc\u00e9\u0130\u01c5\u4e2d'*1_" + ".,;:!?" * 2
    chunks = ["".join(rng.choices(alphabet, k=rng.randint(1, 6))) for _ in range(3000)] + ["etc.", "e.", "a..."]
    for chunk, states in zip(chunks, gumbel_pieces.begun(lattices, chunks), strict=True):
        word = mark + chunk
        assert states.tolist() == [lattices.parts[p] for p in ((word,) if chunk.isalpha() else lattices._cut(word))], chunk


def test_a_text_has_its_samples_in_any_group():
    lattices = gumbel_pieces.Lattices(PIECES, 0.2)
    texts, keys = [LONG[:3000], "", "a b", "end. " * 80, "x"], mixed(np.arange(5), 3)
    together = gumbel_pieces.sample_group(lattices, texts, keys, 4)
    for i, (paths, following) in enumerate(together):
        ((alone, after),) = gumbel_pieces.sample_group(lattices, texts[i : i + 1], keys[i : i + 1], 4)
        assert following == after and len(paths) == len(alone)
        for a, b in zip(paths, alone, strict=True):
            assert (a.log_prob, a.perturbed, a.children.tolist()) == (b.log_prob, b.perturbed, b.children.tolist())
