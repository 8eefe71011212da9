"""Personal data, and the words that give it away.

Four kinds of personal data are found by their form: e-mail and IP addresses, card and phone numbers. Each value is a
protected entity. A word that stands beside an entity tells something about it: seeing the word raises the
entity's probability from p(e) to p(e | t), which are log p(e | t) - log p(e) of the -log p(e) nats that name the
entity. Both are estimated from the whole corpus. A word that gives away more than a share of these nats is treated
wherever it stands: generalised to its class, or removed where it gives away nearly all.

Evidence must come from different contexts: copies of one text, near copies too, don't make the words beside their
entity suspicious. The context of a word is known by the other word of its window with the smallest hash, which near
copies seldom change.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinsight.llm.common import ship, stored, tasks_for, text_or_empty

KINDS = ("email", "ip", "card", "phone")
ADDED = ("general", "removed")

#: Rows of a stored table for which one more file is begun, until every core has one.
SMALL = 10_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# the optional part lets a run of digits that is no address be passed in one step
_IP = re.compile(r"([0-9]++)(?:\.([0-9]++)\.([0-9]++)\.([0-9]++))?")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]")
_WORD = re.compile(r"\w{3,}")

Span = tuple[int, int]


def emails(text: str) -> list[Span]:
    """Matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``: each has one ``@``, so they are found from it."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            found.append((start, free))
        at = text.find("@", at + 1)
    return found


def addresses(text: str) -> list[Span]:
    def part(digits: str) -> bool:
        digits = digits.lstrip("0")
        return len(digits) <= 3 and int(digits or "0") <= 255

    return [m.span() for m in _IP.finditer(text) if m[2] and all(map(part, m.groups()))]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def cards(text: str) -> list[Span]:
    found = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(digits := _DIGITS.sub("", m[0])) <= 19 and luhn(digits):
            found.append(m.span())
    return found


def phones(text: str) -> list[Span]:
    if "+" not in text:
        return []
    return [m.span() for m in _PHONE.finditer(text) if 9 <= len(_DIGITS.sub("", m[0])) <= 15]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start."""
    finders = zip(KINDS, (emails, addresses, cards, phones), strict=True)
    return [(kind, *span) for kind, find in finders for span in find(text)]


def entity(kind: str, value: str) -> str:
    """A value in its one spelling."""
    return f"{kind}:{_DIGITS.sub('', value) if kind in ('card', 'phone') else value.lower()}"


def _free_words(text: str, start: int, end: int, taken: list[Span]) -> list[tuple[str, int, int]]:
    """Words of a stretch, in lower case, that touch no span of ``taken``."""
    words = [(m[0].lower(), *m.span()) for m in _WORD.finditer(text, start, end)]
    return [w for w in words if not any(w[1] < b and a < w[2] for a, b in taken)]


def contexts(text: str, spans: list[tuple[str, int, int]], reach: int) -> list[tuple[str, str, int]]:
    """(entity, word, mark of the context) for the ``reach`` words on each side of each span."""
    taken, width, out = sorted((a, b) for _, a, b in spans), 40 * reach, []
    for kind, start, end in spans:
        left, right = max(0, start - width), min(len(text), end + width)
        near = [s for s in taken if s[0] < right and left < s[1]]
        before, after = _free_words(text, left, start, near), _free_words(text, end, right, near)
        if left and before and before[0][1] == left:
            before = before[1:]
        if right < len(text) and after and after[-1][2] == right:
            after = after[:-1]
        words = sorted({w for w, _, _ in before[-reach:] + after[:reach]}, key=lambda w: (zlib.crc32(w.encode()), w))
        name = entity(kind, text[start:end])
        for word in words:
            other = next((w for w in words[:2] if w != word), "")
            out.append((name, word, zlib.crc32(other.encode())))
    return out


SCANNED = (
    "doc_id string, digest binary, n_email long, n_ip long, n_card long, n_phone long, base string, "
    "contexts array<struct<entity: string, word: string, mark: long>>"
)


def _scanned(reach: int):
    names = [part.split()[0] for part in SCANNED.split(", n_")[0].split(", ")]
    names += ["n_email", "n_ip", "n_card", "n_phone", "base", "contexts"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text, digest in zip(batch["doc_id"], batch["body"], batch["digest"], strict=True):
                spans = base_spans(text)
                kinds = [k for k, _, _ in spans]
                joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
                near = [{"entity": e, "word": w, "mark": m} for e, w, m in contexts(text, spans, reach)] if spans else []
                rows.append((doc_id, digest, *map(kinds.count, KINDS), joined, near))
            yield pd.DataFrame(rows, columns=names)

    return run


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


# --- disclosure ------------------------------------------------------------------------------------------------------

#: Cells of the filter of candidate words; the filter is cells / 8 bytes, whatever the corpus.
CELLS = 1 << 26


def _cell(word: Column, salt: str) -> Column:
    return F.crc32(F.concat(F.lit(salt), word).cast("binary")) % CELLS


def candidate_filter(words: DataFrame) -> bytes:
    """A Bloom filter of two hashes over the words of ``words``; its bitmaps are made by Spark, 4 KB each, and there are
    at most CELLS / 32768 of them."""
    cells = words.select(F.explode(F.array(_cell(F.col("word"), ""), _cell(F.col("word"), "~"))).alias("cell"))
    maps = cells.groupBy(F.expr("bitmap_bucket_number(cell + 1)").alias("nth")).agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(cell + 1))").alias("bits")
    )
    table = bytearray(CELLS // 8)
    for nth, bits in maps.collect():
        table[(nth - 1) * 4096 : nth * 4096] = bits
    return bytes(table)


def _found(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = shared.value

        def maybe(word: str) -> bool:
            for salt in ("", "~"):
                cell = zlib.crc32((salt + word).encode()) % CELLS
                if not table[cell >> 3] >> (cell & 7) & 1:
                    return False
            return True

        for batch in batches:
            rows = []
            for text, digest in zip(batch["body"], batch["digest"], strict=True):
                hits = {w for w in {w.lower() for w in set(_WORD.findall(text))} if maybe(w)}
                if not hits:
                    continue
                taken = sorted({(a, b) for _, a, b in base_spans(text)})
                at: dict[str, list[int]] = {}
                nth = 0
                for m in _WORD.finditer(text):
                    word = m[0].lower()
                    if word not in hits:
                        continue
                    while nth < len(taken) and taken[nth][1] <= m.start():
                        nth += 1
                    if not any(a < m.end() and m.start() < b for a, b in taken[nth : nth + 8]):
                        at.setdefault(word, []).extend(m.span())
                rows += [(digest, word, spans) for word, spans in at.items()]
            yield pd.DataFrame(rows, columns=["digest", "word", "at"])

    return run


def disclosing(
    scanned: DataFrame, texts: DataFrame, least: int, variety: float, share: float, all_of_it: float
) -> tuple[DataFrame, DataFrame]:
    """(words that disclose an entity: word, disclosed, kind; where candidate words stand: digest, word, at).

    A candidate joins an entity in ``least`` different contexts, in ``variety`` of them for each text that joins the
    two, and would disclose enough if it stood nowhere but beside entities. In how many texts it does stand is then
    counted.
    """
    spark = scanned.sparkSession
    near = scanned.select("digest", F.explode("contexts").alias("c")).select("digest", "c.*")
    texts_of = scanned.select("digest", F.explode(F.array_distinct("contexts.entity")).alias("entity")).distinct()
    of_entity = texts_of.groupBy("entity").agg(F.count("*").alias("n_entity"))
    pairs = near.groupBy("entity", "word").agg(F.count_distinct("mark").alias("n_contexts"), F.count_distinct("digest").alias("n_both"))
    pairs = pairs.filter((F.col("n_contexts") >= least) & (F.col("n_contexts") >= variety * F.col("n_both")))
    beside = near.select("digest", "word").distinct().groupBy("word").agg(F.count("*").alias("n_beside"))
    corpus = F.lit(scanned.select("digest").distinct().count())
    rows, most = scanned.agg(F.count("*"), F.sum(F.greatest(F.size("contexts"), F.lit(0)))).first()  # pairs are at most the contexts
    gain = lambda n_word: 1 + F.log(F.col("n_both") / n_word) / F.log(corpus / F.col("n_entity"))
    likely = pairs.join(of_entity, "entity").filter(F.col("n_entity") < corpus).join(beside, "word")
    likely = stored(likely.filter(gain(F.col("n_beside")) >= share), "pii-candidates", tasks=tasks_for(spark, most or 0, small=SMALL))
    shared = spark.sparkContext.broadcast(candidate_filter(likely.select("word").distinct()))
    places = texts.mapInPandas(_found(shared), "digest binary, word string, at array<long>")
    places = stored(places.dropDuplicates(["digest", "word"]), "pii-places", tasks=tasks_for(spark, rows, 10_000, SMALL))
    anywhere = places.groupBy("word").agg(F.count("*").alias("n_word"))
    judged = likely.join(anywhere, "word").groupBy("word").agg(F.max(gain(F.col("n_word"))).alias("disclosed"))
    kind = F.when(F.col("disclosed") >= all_of_it, ADDED[1]).otherwise(ADDED[0])
    return judged.filter(F.col("disclosed") >= share).withColumn("kind", kind), places


def personal_data(
    docs: DataFrame, reach: int = 8, least: int = 5, variety: float = 0.2, share: float = 0.9, all_of_it: float = 0.98
) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base, spans, digest.

    ``base`` and ``spans`` list kind:start:end in code points, end exclusive, by kind and start, joined by commas;
    ``spans`` has the kinds ``general`` and ``removed`` besides. Words have 3 letters or digits and more, in any case,
    and none of their places overlaps a base span. ``reach`` words on each side of an entity are its context. A word
    takes part from ``least`` different contexts with an entity on, and ``variety`` of them for each text with both; it is generalised from ``share`` of the entity's information on
    and removed from ``all_of_it`` on. Texts are counted once each, however many rows repeat them. A null text is
    empty, a null identifier stays null, repeated rows give repeated results, an empty table an empty result; ties do
    not arise. Very long texts are read once from end to end for each kind.
    """
    ship(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), text_or_empty().alias("body"))
    texts = texts.withColumn("digest", _digest(F.col("body")))
    tasks = tasks_for(docs.sparkSession, docs.count(), 10_000, 100)
    scanned = stored(texts.mapInPandas(_scanned(reach), SCANNED), "pii-scan", tasks=tasks)
    result = scanned.drop("contexts")
    words, places = disclosing(scanned, texts.select("body", "digest"), least, variety, share, all_of_it)
    one = F.expr("transform(sequence(0, size(at) - 1, 2), i -> struct(kind, at[i] as a, at[i + 1] as b))")
    each = F.transform(F.sort_array(F.collect_list("s")), lambda s: F.concat_ws(":", s["kind"], s["a"], s["b"]))
    added = places.join(words, "word").select("digest", F.explode(one).alias("s")).groupBy("digest").agg(F.concat_ws(",", each).alias("added"))
    both = F.array_join(F.filter(F.array(F.nullif("base", F.lit("")), F.col("added")), lambda x: x.isNotNull()), ",")
    spans = scanned.drop("contexts").join(added, "digest", "left").withColumn("spans", both).drop("added")
    return spans.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def _word_class(word: str) -> str:
    """What a generalised word becomes."""
    return "[CODE]" if any(c.isdigit() for c in word) else "[NAME]" if word[:1].isupper() else "[WORD]"


def treated(text: str, spans: str) -> str:
    """A text with its spans exchanged; where spans overlap, the earlier start, then the longer one, covers the rest."""
    out, free = [], 0
    parts = [s.rsplit(":", 2) for s in spans.split(",")] if spans else []
    for start, back, kind in sorted((int(a), -int(b), k) for k, a, b in parts):
        if -back <= free:
            continue
        start, end = max(start, free), -back
        out.append(text[free:start])
        out.append("" if kind == "removed" else _word_class(text[start:end]) if kind == "general" else f"[{kind.upper()}]")
        free = end
    return "".join(out) + text[free:]


def sanitised(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs`` with all their columns; ``text`` without personal data and without what gives it away. Null
    texts become empty."""
    found = personal_data(docs, **parameters).filter("spans <> ''").select(F.col("digest").alias("found_digest"), F.col("spans").alias("found_spans"))
    names = {c.lower() for c in docs.columns}
    mark, spans = (next(n for i in range(len(names) + 1) if (n := f"{name}_{i}").lower() not in names) for name in ("digest", "spans"))
    found = found.dropDuplicates(["found_digest"]).toDF(mark, spans)

    @F.pandas_udf("string")
    def exchanged(text: pd.Series, own: pd.Series) -> pd.Series:
        return pd.Series([treated(t, s) for t, s in zip(text, own, strict=True)])

    marked = docs.withColumn("text", text_or_empty()).withColumn(mark, _digest(F.col("text"))).join(found, mark, "left")
    text = F.when(F.col(spans).isNull(), F.col("text")).otherwise(exchanged(F.col("text"), F.coalesce(spans, F.lit(""))))
    return marked.withColumn("text", text).select(*docs.columns)

