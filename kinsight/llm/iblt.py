"""Document fingerprints as invertible Bloom lookup tables, with DataFrame functions alone.

A text's passages end at words that their own hash chooses, so that an insertion moves no other cut and equal passages
have equal digests, however long the texts around them are. They have 48-bit digests. A fingerprint is three tables,
in each of which a digest has one cell; cells keep a count and the exclusive-or of digests and of check values.
Subtracting two fingerprints cancels what both have; a cell with one digest left gives it away, and taking it out of its
other cells opens more, until all that differs is known. A pair that can't be solved is tried again larger. The likeness
of two fingerprints is the Jaccard similarity that the differing digests leave.

Cells are rows, so filling, subtracting and peeling are sums by key: their work is in proportion to a text's length, and
a table of versions that is partitioned once by row stays so to the end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinsight.llm.common import stored, text_or_empty

#: Where words end: at white space, before each character of a script without spaces (Thai to Burmese, Khmer, kana, Han)
#: or beyond the basic plane, and behind each character of a run from its 24th on.
WORDS = r"\s+|(?=[\u0E00-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u9FFF\x{10000}-\x{10FFFF}])|(?<=\S{24})"
#: One in so many distinct words ends a passage (a power of two), and so many words at a text's beginning end one each,
#: whatever their hash: a short text has passages, too.
ONE_IN, FIRST = 8, 4
#: Where ``paragraphs`` cuts, by the text's length in code points: short texts behind every word or every sentence, long
#: ones at line breaks and between a sentence's end and a next one that begins with one of a few letters.
CUTS = ((100, r"\s"), (1000, r"\n|(?<=[.!?]) "), (None, r"\n|(?<=[.!?]) (?=[A-D])"))
#: The sizes at which pairs are tried: cells of a table for each ``DIGESTS`` digests of both sides.
SIZES, DIGESTS = (16, 64, 256), 16


def passages(text: Column) -> Column:
    """A text's passages: its first words one by one, then runs of words up to one that its hash chooses, or the text's
    end. The rule is the same for every length of text; the white space between words doesn't count."""
    words = F.filter(F.split(text, WORDS), lambda w: w != "")
    ends = lambda w: F.xxhash64(w).bitwiseAND(F.lit(ONE_IN - 1)) == 0
    marked = F.transform(words, lambda w, i: F.when((i < FIRST) | ends(w), F.concat(w, F.lit("\n"))).otherwise(w))
    return F.split(F.array_join(marked, " "), "\n ?")


def paragraphs(text: Column) -> Column:
    """A text's words, sentences or paragraphs, by its length: two texts compare only where ``CUTS`` has one rule for
    both."""
    cut = F.split(text, CUTS[-1][1])
    for below, pattern in reversed(CUTS[:-1]):
        cut = F.when(F.length(text) < below, F.split(text, pattern)).otherwise(cut)
    return cut


def digests(text: Column, cut: Callable[[Column], Column] = paragraphs) -> Column:
    """Distinct digests of a text's parts; blank ones have none."""
    parts = F.filter(cut(text), lambda p: F.trim(p) != "")
    return F.array_distinct(F.transform(parts, lambda p: F.xxhash64(F.trim(p)).bitwiseAND(F.lit((1 << 48) - 1))))


def _bits(size: Column | str) -> Column:
    """How many bits tell a table's cells apart: eight cells at least."""
    return F.ceil(F.log2(F.greatest(F.lit(8.0), F.col(size) if isinstance(size, str) else size))).cast("int")


def _check(digest: str) -> str:
    return f"(xxhash64({digest}) & 4294967295L)"


def _cell(digest: str, t: str, bits: str, level: int) -> str:
    """The number of a digest's cell in table ``t``: its place, the table and the tables' size; each level hashes anew."""
    return f"((((xxhash64({digest}, {t} + {3 * level}) & (shiftleft(1L, {bits}) - 1)) * 3 + {t}) * 64) + {bits})"


def _summed(cells: DataFrame, *keys: str) -> DataFrame:
    """Cell by cell the sum of counts and the exclusive-or of digests and of check values; what cancels leaves no row."""
    sums = cells.groupBy(*keys, "cell").agg(F.sum("n").alias("n"), F.bit_xor("key").alias("key"), F.bit_xor("chk").alias("chk"))
    return sums.filter("n <> 0 or key <> 0 or chk <> 0")


def _filled(sides: DataFrame, level: int, *keys: str) -> DataFrame:
    """Cells (keys, cell, n, key, chk) of digest arrays (keys, bits, sign, ds): three for each digest."""
    rows = sides.select(*keys, "bits", "sign", F.explode("ds").alias("key"))
    rows = rows.select(*keys, "bits", "sign", "key", F.expr(_check("key")).alias("chk"), F.explode(F.expr("array(0, 1, 2)")).alias("t"))
    return _summed(rows.select(*keys, F.expr(_cell("key", "t", "bits", level)).alias("cell"), F.col("sign").alias("n"), "key", "chk"), *keys)


def _peeled(cells: DataFrame, level: int, rounds: int) -> DataFrame:
    """The cells after ``rounds`` rounds; digests that were found are counted in cell -1 (of the first side) or -2.

    A round takes the pure cells of one of the three tables, in turn: there a digest has one cell, so none is taken
    twice. A pure cell has a count of one, the check value of its digest, and lies where that digest belongs.
    """
    for r in range(rounds):
        t = r % 3
        pure = f"cell >= 0 and abs(n) = 1 and (cell div 64) % 3 = {t} and chk = {_check('key')} and cell = {_cell('key', str(t), '(cell & 63)', level)}"
        others = [f"named_struct('cell', {_cell('key', str(o), '(cell & 63)', level)}, 'n', -n, 'key', key, 'chk', chk)" for o in range(3) if o != t]
        found = "named_struct('cell', if(n = 1, -1L, -2L), 'n', 1L, 'key', 0L, 'chk', 0L)"
        itself = "named_struct('cell', cell, 'n', n, 'key', key, 'chk', chk)"
        taken = F.expr(f"if({pure}, array({found}, {', '.join(others)}), array({itself}))")
        cells = _summed(cells.select("row", "pair", F.inline(taken)), "row", "pair")
    return cells


def tables(versions: DataFrame, *names: str) -> DataFrame:
    """(row, one text per name): the tables of the arrays of digests of these names. A text has the cells of one table,
    then its filled cells in order as cell:count:digest:check. A row without any digest is left out, and its texts are
    null where only some are empty. Rows are to be partitioned by ``row``."""
    sides = F.array(*(F.struct(F.lit(k).alias("side"), F.col(name).alias("ds")) for k, name in enumerate(names)))
    arrays = versions.select("row", F.explode(sides).alias("x")).select(
        "row", "x.side", "x.ds", _bits(2.0 * F.size("x.ds")).alias("bits"), F.lit(1).cast("long").alias("sign")
    )
    cells = _filled(arrays, 0, "row", "side")
    text = F.expr("concat_ws(':', cell div 64, n, lower(hex(key)), lower(hex(chk)))")
    texts = cells.select("row", "side", F.struct(F.expr("cell div 64").alias("at"), text.alias("text"), F.expr("cell & 63").alias("bits")).alias("c"))
    lists = texts.groupBy("row").agg(*(F.sort_array(F.collect_list(F.when(F.col("side") == k, F.col("c")))).alias(n) for k, n in enumerate(names)))
    size = lambda n: F.expr(f"cast(shiftleft(1L, get({n}, 0).bits) as string)")
    return lists.select("row", *(F.concat(size(n), F.lit("|"), F.array_join(f"{n}.text", ",")).alias(n) for n in names))


def _key(doc_id: Column, mark: Column, name: str) -> list[Column]:
    """Three columns without nulls that tell rows apart as (doc_id, mark) does: joins and windows on them share one
    partitioning."""
    return [F.coalesce(doc_id, F.lit(0)).alias(f"{name}_id"), doc_id.isNull().alias(f"{name}_none"), mark.alias(f"{name}_mark")]


def successors(docs: DataFrame) -> DataFrame:
    """(key, times, key of the previous, what the previous needs of this one): the documents by descending
    doc_id (null last), equal ones by a hash of the text; after the last comes the first. Repeated rows are one row
    with a count. Only keys are sorted, in ranges; the ends of ranges meet in a table with one row a range."""
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(text_or_empty()).alias("mark"),
        F.length(text_or_empty()).alias("n_chars"),
    )
    slim = slim.groupBy("doc_id", "mark", "n_chars").agg(F.count("*").alias("times"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("mark")]
    dealt = stored(slim.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "iblt-order")
    key = F.struct("doc_id", "mark", "n_chars")
    inside = Window.partitionBy("part").orderBy(*order)
    placed = dealt.withColumn("next", F.lead(key).over(inside)).withColumn("before", F.lag(key).over(inside))
    ends = placed.groupBy("part").agg(F.max(F.when(F.col("next").isNull(), key)).alias("last"))
    by_part = Window.orderBy("part")
    whole = by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    around = ends.select(
        "part",
        F.coalesce(F.lag("last").over(by_part), F.last("last").over(whole)).alias("last_before"),
    )
    joined = placed.join(around, "part")
    previous = F.coalesce("before", "last_before")
    return joined.select(
        *_key(F.col("doc_id"), F.col("mark"), "key"), "times",
        *_key(previous["doc_id"], previous["mark"], "before"),
        F.floor(previous["n_chars"] / 3).cast("int").alias("before_need"),
    )


def edited_versions(docs: DataFrame, cut: Callable[[Column], Column] = paragraphs) -> DataFrame:
    """One stored row per document: doc_id, next_id (doc_id of the next document), n_chars, edited_sha256, and the digests of the text (own), of the edited
    text (edited) and of the next document (following), with their numbers. The edited text has its last floor(n_chars / 3) code points
    replaced by the first as many, or all, of the next document. A repeated row's next document is its repetition."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    key, before = ["key_id", "key_none", "key_mark"], ["before_id", "before_none", "before_mark"]
    # both uses of the texts, for themselves and as the next of another, read this one shuffle
    texts = texts.select("doc_id", "text", *_key(F.col("doc_id"), F.xxhash64("text"), "key")).repartition(*key)
    chain = stored(successors(docs), "iblt-chain")
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(*key))
    placed = texts.join(chain, key).withColumn("nth", nth)
    heads = placed.filter("nth = 1").select(
        *[F.col(b).alias(k) for b, k in zip(before, key, strict=True)],
        F.col("doc_id").alias("next_id"), F.expr("left(text, before_need)").alias("head"),
        digests(F.col("text"), cut).alias("head_digests"),
    )
    both = placed.join(heads, key).select(
        "doc_id", "next_id", "text", "head", "head_digests",
        F.length("text").alias("n"), (F.col("nth") < F.col("times")).alias("repeats"),
        digests(F.col("text"), cut).alias("own"),
    )
    both = both.withColumn("need", F.floor(F.col("n") / 3).cast("int")).withColumn(
        "edited_text", F.concat(F.expr("left(text, n - need)"), F.expr("if(repeats, left(text, need), head)"))
    )
    versions = both.select(
        "doc_id", F.expr("if(repeats, doc_id, next_id)").alias("next_id"), F.col("n").cast("long").alias("n_chars"), F.sha2("edited_text", 256).alias("edited_sha256"), "own",
        digests(F.col("edited_text"), cut).alias("edited"), F.expr("if(repeats, own, head_digests)").alias("following"),
    )
    counts = {"n_parts": "own", "n_edited_parts": "edited", "n_next_parts": "following"}
    versions = versions.withColumns({n: F.size(c) for n, c in counts.items()})
    return stored(versions.withColumn("row", F.monotonically_increasing_id()), "iblt-versions", drop_shuffles=True)


def differences(
    pairs: DataFrame, sizes: tuple[int, ...] = SIZES, rounds: int = 9, again: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """(row, pair, only_a, only_b): how many digests only one side of a pair (row, pair, a, b) has; pairs that do not
    differ are left out. The pairs are to be partitioned by ``row``: then no round moves a row to another task.

    The sides' tables have one size, which their numbers of digests choose, and are subtracted by adding up cells with
    opposite signs. Pairs that peeling does not solve are tried again larger, with other hashes, size by size; what the
    last size leaves is compared digest by digest. ``again`` gives the pairs of a table (row, pair), partitioned alike.
    """
    again = again or (lambda wanted: pairs.join(wanted, ["row", "pair"], "left_semi"))
    rest, done = pairs, []
    for level, cells in enumerate(sizes):
        sides = F.array(
            F.struct(F.lit(1).cast("long").alias("sign"), F.col("a").alias("ds")),
            F.struct(F.lit(-1).cast("long").alias("sign"), F.col("b").alias("ds")),
        )
        sized = rest.select("row", "pair", _bits((F.size("a") + F.size("b")) * (cells / DIGESTS)).alias("bits"), F.explode(sides).alias("x"))
        filled = _filled(sized.select("row", "pair", "bits", "x.sign", "x.ds"), level, "row", "pair")
        found = _peeled(filled, level, rounds).groupBy("row", "pair").agg(
            F.sum(F.expr("if(cell = -1, n, 0)")).alias("only_a"),
            F.sum(F.expr("if(cell = -2, n, 0)")).alias("only_b"),
            F.max(F.expr("cell >= 0")).alias("open"),
        )
        found = stored(found, "iblt-found", drop_shuffles=True)
        done.append(found.filter("not open").drop("open"))
        unsolved = stored(found.filter("open").select("row", "pair"), "iblt-unsolved")
        if unsolved.isEmpty():
            break
        rest = again(unsolved)
    else:
        one, other = F.size(F.array_except("a", "b")), F.size(F.array_except("b", "a"))
        done.append(rest.select("row", "pair", one.cast("long").alias("only_a"), other.cast("long").alias("only_b")))
    whole = done[0]
    for part in done[1:]:
        whole = whole.unionByName(part)
    return whole


def _jaccard(size_a: str, size_b: str, only_a: str) -> Column:
    """The similarity of sets of these sizes, by what only the first has (null: nothing); two empty ones are alike."""
    alone = F.coalesce(F.col(only_a), F.lit(0))
    return F.when(F.col(size_b) + alone == 0, 1.0).otherwise((F.col(size_a) - alone) / (F.col(size_b) + alone))


def likeness(pairs: DataFrame, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """(row, pair, likeness) of pairs (row, pair, a, b) of arrays of distinct digests: the Jaccard similarity, from the
    differing digests that the subtracted tables give away; 1 for two empty arrays. ``row`` is not null."""
    found = differences(pairs.repartition("row"), sizes)
    counted = pairs.select("row", "pair", F.size("a").alias("size_a"), F.size("b").alias("size_b")).join(found, ["row", "pair"], "left")
    return counted.select("row", "pair", _jaccard("size_a", "size_b", "only_a").alias("likeness"))


def document_fingerprints(docs: DataFrame, cut: Callable[[Column], Column] = paragraphs, task_digests: int = 400_000) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    next_id, n_parts, n_next_parts (distinct digests). Fingerprints of the parts that ``cut`` makes; with ``passages``
    texts of any two lengths compare. Where two texts have fingerprints of one size, their likeness is what the two
    leave when one is subtracted from the other; elsewhere the smaller is made in a larger size, the other folded.

    Equal texts have equal fingerprints; an empty text, or one of blanks, has an empty one, and two such are wholly
    alike. In a table with one document that is its own next document. ``task_digests`` is how many digests share a task.
    """
    versions = edited_versions(docs, cut)
    total = versions.agg(F.sum(F.expr("n_parts + n_edited_parts + n_next_parts"))).first()[0] or 0
    tasks = max(8, total // task_digests)
    pair = lambda k, other: F.struct(F.lit(k).alias("pair"), F.col("own").alias("a"), F.col(other).alias("b"))

    def pairs_of(some: DataFrame) -> DataFrame:
        both = F.explode(F.array(pair(0, "edited"), pair(1, "following"))).alias("x")
        return some.repartition(tasks, "row").select("row", both).select("row", "x.*")

    def again(wanted: DataFrame) -> DataFrame:
        some = versions.join(wanted.select("row").distinct(), "row", "left_semi")
        return pairs_of(some).join(wanted, ["row", "pair"], "left_semi")

    found = differences(pairs_of(versions), again=again).groupBy("row").agg(
        *(F.max(F.when(F.col("pair") == k, F.col("only_a"))).alias(f"only_{k}") for k in (0, 1))
    )
    slim = versions.select("row", "doc_id", "n_chars", "edited_sha256", "next_id", "n_parts", "n_edited_parts", "n_next_parts")
    joined = slim.repartition(tasks, "row").join(tables(versions.repartition(tasks, "row"), "own", "edited"), "row", "left").join(found, "row", "left")
    return joined.select(
        "doc_id", "n_chars", "edited_sha256", F.coalesce("own", F.lit("")).alias("fingerprint"),
        F.coalesce("edited", F.lit("")).alias("edited_fingerprint"), _jaccard("n_parts", "n_edited_parts", "only_0").alias("near_edited"),
        _jaccard("n_parts", "n_next_parts", "only_1").alias("near_next"), "next_id", "n_parts", "n_next_parts",
    )
