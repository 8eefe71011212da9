"""Near-duplicate documents by weighted MinHash over multisets of word runs (shingles).

Each occurrence level of a shingle carries Poisson processes over time: one on the level [0, 1), one on [1, 2), and
one on each further [2^k, 2^(k+1)). A shingle that occurs w times takes the points below w, which in the topmost
interval means thinning by the point's level. Every point falls into one of the signature's components, and a
component keeps its earliest point; two texts agree in a component with the probability of their weighted Jaccard
similarity. Points are drawn in order of time and only until they can't change a signature any more.

Signatures are cut into bands; documents that share a band's value share a bucket. A bucket is never expanded into
pairs: its members are compared with its leader, which connects most of a group of copies. For members that this leaves
unconnected, shingles that one text alone has bound what it can share with any other, and rule most of them out. The
rest are joined by their rarest shingles: two texts that are near share one of the first few, where edited copies
differ, so that only texts with an edit in common meet. Similarities that decide are exact, over whole texts. Equal
texts are one node throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinsight.llm.common import remembered, ship, stored, tasks_for, text_or_empty, unused
from kinsight.llm.mixing import mixed, uniform

_ROLL = np.uint64(0x9E3779B97F4A7C15)

#: Tables of numbers have one file for so many rows until every core has one: a round of connecting writes several.
SMALL = 10_000


def shingles(text: str, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the runs of ``words`` words (all words, where there are fewer) and how often they occur."""
    parts = text.split()
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    width = min(words, len(parts))
    run = np.zeros(len(parts) - width + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            run = run * _ROLL + hashes[k : k + len(run)]
    return np.unique(mixed(run, width), return_counts=True)


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], components: int, seed: int = 1) -> np.ndarray:
    """One row per bag: the times of the earliest points of its components, as floats. An empty bag has infinities."""
    doc = np.repeat(np.arange(len(bags)), [len(h) for h, _ in bags])
    item = np.concatenate([h for h, _ in bags]) if bags else np.zeros(0, np.uint64)
    weight = np.concatenate([w for _, w in bags]) if bags else np.zeros(0, np.int64)
    rows, level = [], 0
    low, high = 0, 1
    while True:
        here = np.flatnonzero(weight > low)
        if not len(here):
            break
        rows.append((doc[here], mixed(item[here], seed * 100 + level), weight[here], np.full(len(here), low), np.full(len(here), high)))
        level, low, high = level + 1, high, 2 * high
    first = np.full((len(bags), components), np.inf)
    if not rows:
        return first
    doc, state, weight, low, high = (np.concatenate(x) for x in zip(*rows, strict=True))
    time, width, flat, step = np.zeros(len(doc)), (high - low).astype(float), first.reshape(-1), 0
    while len(doc):
        time = time - np.log(uniform(mixed(state, 3 * step + 7))) / width
        place = (mixed(state, 3 * step + 8) % np.uint64(components)).astype(np.int64)
        on = np.ones(len(doc), bool)
        part = weight < high
        if part.any():
            on[part] = low[part] + width[part] * uniform(mixed(state[part], 3 * step + 9)) < weight[part]
        np.minimum.at(flat, doc[on] * components + place[on], time[on])
        left = time < first.max(axis=1)[doc]
        doc, state, weight, low, high, time, width = (x[left] for x in (doc, state, weight, low, high, time, width))
        step += 1
    return first


def band_values(signature: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit value per band; equal where all of the band's components are equal."""
    bits = signature.view(np.uint64).reshape(len(signature), bands, -1)
    value = np.zeros(bits.shape[:2], np.uint64)
    for k in range(bits.shape[2]):
        value = mixed(value ^ bits[:, :, k], k + 1)
    return mixed(value ^ np.arange(bands, dtype=np.uint64), 99)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags: sum of minima over sum of maxima."""
    total = int(a[1].sum() + b[1].sum())
    if not total:
        return 0.0
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    both = b[0][at] == a[0] if len(b[0]) else np.zeros(len(a[0]), bool)
    shared = int(np.minimum(a[1][both], b[1][at[both]]).sum())
    return shared / (total - shared)


def nodes(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """One stored row per distinct text: node, sha, keep_id (smallest doc_id), copies, buckets (empty for a text
    without words)."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        remembered("bagminhash")
        for batch in batches:
            for at in range(0, len(batch), 400):
                some = batch.iloc[at : at + 400]
                bags = [shingles(t, words) for t in some["text"]]
                values = band_values(signatures(bags, bands * rows), bands).view(np.int64)
                buckets = [v if len(bag[0]) else v[:0] for v, bag in zip(values, bags, strict=True)]
                yield pd.DataFrame({"doc_id": some["doc_id"], "sha": some["sha"], "buckets": buckets})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    signed = texts.withColumn("sha", F.sha2("text", 256)).mapInPandas(run, "doc_id long, sha string, buckets array<long>")
    distinct = signed.groupBy("sha").agg(
        F.min("doc_id").alias("keep_id"), F.count("*").alias("copies"), F.first("buckets").alias("buckets")
    )
    tasks = tasks_for(docs.sparkSession, docs.count(), 5000)
    return stored(distinct.withColumn("node", F.monotonically_increasing_id()), "bagminhash-nodes", tasks=tasks)


def components(links: DataFrame) -> DataFrame:
    """(node, root) of all nodes in ``links`` (a, b): the smallest node each can be reached from. Labels spread along
    links and jump to their own label's label, so chains shorten by half in a round; each round is stored."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stored(both, "links", tasks=tasks_for(links.sparkSession, 2 * links.count(), small=SMALL))
    roots = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root"))
    tasks = tasks_for(links.sparkSession, both.count(), small=SMALL)
    roots = stored(roots, "roots", tasks=tasks)
    while True:
        near = both.join(roots, both["b"] == roots["node"]).groupBy("a").agg(F.min("root").alias("near"))
        step = roots.join(near, roots["node"] == near["a"]).select("node", "root", F.least("root", "near").alias("best"))
        onward = roots.select(F.col("node").alias("via"), F.col("root").alias("beyond"))
        jumped = step.join(onward, step["best"] == onward["via"]).select(
            "node", F.col("root").alias("old"), F.least("best", "beyond").alias("root")
        )
        made = stored(jumped, "roots", tasks=tasks)
        if made.filter("old <> root").isEmpty():
            return made.select("node", "root")
        roots = made.select("node", "root")


def joined_by(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """The components when ``links`` are added to what ``roots`` has connected: only the roots that the new links
    touch take part in the search."""
    if roots is None:
        return components(links)
    ends = [F.coalesce(F.col(f"root_{x}"), F.col(x)).alias(x) for x in ("a", "b")]
    between = _with_roots(links, roots).select(*ends).filter("a <> b")
    moved = components(between).select(F.col("node").alias("old"), F.col("root").alias("new"))
    nodes_now = roots.unionByName(moved.select(F.col("old").alias("node"), F.col("old").alias("root"))).distinct()
    found = nodes_now.join(moved, F.col("root") == F.col("old"), "left")
    tasks = tasks_for(roots.sparkSession, roots.count(), small=SMALL)
    return stored(found.groupBy("node").agg(F.min(F.coalesce("new", "root")).alias("root")), "roots", tasks=tasks)


def judged(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """Stored (a, b, similarity) of the pairs, which are stored, from the whole texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        remembered("bagminhash")
        last, bag = None, None
        for batch in batches:
            out = []
            for b, text_a, text_b in zip(batch["b"], batch["text_a"], batch["text_b"], strict=True):
                if b != last:
                    last, bag = b, shingles(text_b, words)
                out.append(similarity(shingles(text_a, words), bag))
            yield pd.DataFrame({"a": batch["a"], "b": batch["b"], "similarity": out})

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    count = pairs.count()
    tasks = min(4 * tasks_for(pairs.sparkSession, count, 4000), max(1, -(-count // 200)))
    return stored(both.mapInPandas(run, "a long, b long, similarity double"), "bagminhash-judged", tasks=tasks)


def overlaps(texts: DataFrame, of: DataFrame, words: int) -> DataFrame:
    """(node, size, shared): how many shingle occurrences a text has, and how many are of shingles that another text
    of the nodes ``of`` has too. No two of these texts share more than the lesser ``shared`` of theirs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        remembered("bagminhash")
        for batch in batches:
            for node, text in zip(batch["node"], batch["text"], strict=True):
                hashes, times = shingles(text, words)
                own = pd.DataFrame({"node": node, "shingle": hashes.view(np.int64), "times": times}).astype({"shingle": "Int64"})
                yield own
                yield pd.DataFrame({"node": [node], "shingle": pd.array([None], "Int64"), "times": [int(times.sum())]})

    counted = texts.join(of, "node", "left_semi").select("node", "text").mapInPandas(run, "node long, shingle long, times long")
    # a row without a shingle has the size of its text, and is a group of its own
    whole = F.when(F.col("shingle").isNull(), F.col("node")).alias("whole")
    single = counted.groupBy("shingle", whole).agg(F.count("*").alias("n"), F.min("node").alias("node"), F.sum("times").alias("times"))
    size = F.sum(F.when(F.col("shingle").isNull(), F.col("times")))
    alone = F.coalesce(F.sum(F.when(F.col("shingle").isNotNull(), F.col("times"))), F.lit(0))
    found = single.filter("n = 1").groupBy("node").agg(size.alias("size"), alone.alias("alone"))
    return stored(found.select("node", "size", (F.col("size") - F.col("alone")).alias("shared")), "bagminhash-overlaps", tasks=tasks_for(of.sparkSession, of.count(), 20_000))


def bound(shared: Column, size: Column, other: Column) -> Column:
    """No text of size ``other`` is more similar than this to one of which only ``shared`` occurs elsewhere."""
    return shared / (size + other - shared)


def rare_tokens(texts: DataFrame, of: DataFrame, words: int, threshold: float) -> DataFrame:
    """The rarest shingle occurrences of the nodes ``of`` (node, size, least, and more columns that are kept): shingle,
    kth occurrence and position, in one order for all texts, rarest first.

    Two texts of sizes a and b that reach the threshold share t / (1 + t) (a + b) occurrences, so the first that they
    share comes early in both: as many are listed as it takes, for partners of at least the size ``least``.
    Occurrences that no other text has are counted but not listed.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        remembered("bagminhash")
        for batch in batches:
            for node, text in zip(batch["node"], batch["text"], strict=True):
                hashes, times = shingles(text, words)
                yield pd.DataFrame({"node": node, "shingle": hashes.view(np.int64), "times": times})

    counted = texts.join(of.select("node"), "node", "left_semi").select("node", "text")
    counted = stored(counted.mapInPandas(run, "node long, shingle long, times long"), "bagminhash-shingles")
    spread = counted.groupBy("shingle").agg(F.count("*").alias("n"))
    before = Window.partitionBy("node").orderBy("n", "shingle").rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.join(spread, "shingle").withColumn("before", F.coalesce(F.sum("times").over(before), F.lit(0))).join(of, "node")
    needed = F.ceil(threshold / (1 + threshold) * (F.col("size") + F.greatest("least", threshold * F.col("size"))) - 1e-6)
    listed = (F.col("size") - needed + 1 - F.col("before")).cast("long")
    near = placed.withColumn("listed", F.least("times", listed)).filter("listed > 0 and n > 1")
    kth = F.explode(F.sequence(F.lit(0).cast("long"), F.col("listed") - 1)).alias("kth")
    kept = [c for c in of.columns if c != "node"]
    tokens = near.select("node", *kept, "shingle", "before", kth).withColumn("position", F.col("before") + F.col("kth"))
    return stored(tokens.drop("before"), "bagminhash-tokens", tasks=tasks_for(of.sparkSession, counted.count()))


def near_roots(all_nodes: DataFrame, docs: DataFrame, words: int, threshold: float) -> DataFrame | None:
    """(node, root): the classes of all nodes that have a near one. None where no two nodes share a bucket.

    A bucket's leader is the member that shares most buckets with others, as the original of many edited copies does.
    The members are first compared with it: each node with the best of its buckets' leaders, which connects most of a
    group at once, then with the others that it isn't connected to yet. A member that shares too little with any text
    at all to be near the smallest text of the bucket (``overlaps``) leaves the bucket. What is still unconnected in a
    bucket meets by rare shingles (``rare_tokens``): first the leader of each shingle, then, unless that has connected
    them, the others. So every two members of a bucket end up connected, compared or ruled out.
    """
    spread = all_nodes.select("node", F.posexplode("buckets").alias("band", "value"))
    spread = spread.select("node", F.xxhash64("band", "value").alias("bucket"))
    shared = spread.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    spark, count = all_nodes.sparkSession, all_nodes.count()
    members = stored(spread.join(shared, "bucket"), "bagminhash-members", tasks=tasks_for(spark, count, 10_000))
    shares = members.count()
    if not shares:
        return None
    few = tasks_for(spark, shares, small=SMALL)
    degrees = members.groupBy("node").agg(F.sum("n").alias("degree"))
    members = members.select("bucket", "node").join(degrees, "node").withColumn("rank", F.struct("degree", (-F.col("node")).alias("low")))
    leaders = members.groupBy("bucket").agg(F.max_by("node", "rank").alias("first"), F.max("rank").alias("first_rank"))
    members = stored(members.join(leaders, "bucket"), "bagminhash-members", tasks=few)
    wanted = all_nodes.join(degrees.select("node"), "node").select("node", "sha", "keep_id")
    bare = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    bare = bare.withColumn("own_sha", F.sha2("text", 256))
    same = (bare["own_sha"] == wanted["sha"]) & bare["doc_id"].eqNullSafe(wanted["keep_id"])
    texts = bare.join(wanted, same).groupBy("node").agg(F.first("text").alias("text"))
    texts = stored(texts, "bagminhash-texts", tasks=tasks_for(spark, count, 5000))

    def judge(pairs: DataFrame, known: DataFrame | None, roots: DataFrame | None):
        """Judge the pairs that were not judged before, and connect those that are near."""
        todo = pairs if known is None else pairs.join(known.select("a", "b"), ["a", "b"], "left_anti")
        made = judged(stored(todo, "bagminhash-pairs", tasks=few), texts, words)
        close = made.filter(F.col("similarity") >= threshold - 1e-12).select("a", "b")
        if not close.isEmpty():
            roots = joined_by(roots, close)
        if known is not None:
            both = known.union(made)
            made = stored(both, "bagminhash-known", tasks=tasks_for(spark, both.count(), small=SMALL))
        return made, roots

    stars = members.filter("node <> first").groupBy(F.col("node").alias("a"), F.col("first").alias("b"))
    stars = stored(stars.agg(F.max("first_rank").alias("rank")), "bagminhash-stars", tasks=few)
    known, roots = judge(stars.groupBy("a").agg(F.max_by("b", "rank").alias("b")), None, None)
    known, roots = judge(_apart(stars.select("a", "b"), roots), known, roots)
    unsettled = _mixed(members.select("bucket", "node", "rank"), roots)
    if unsettled.isEmpty():
        return roots
    sizes = overlaps(texts, unsettled.select("node").distinct(), words)
    sized = unsettled.join(sizes, "node")
    least = sized.groupBy("bucket").agg(F.min("size").alias("least"))
    nearest = bound(F.col("shared"), F.col("size"), F.greatest("least", "shared"))
    left = stored(sized.join(least, "bucket").filter(nearest >= threshold - 1e-9), "bagminhash-left", tasks=few)
    stray = F.max(F.col("root") != F.col("main")).alias("stray")
    found = _mixed(left.select("bucket", "node", "rank", "size", "least"), roots)
    of = found.groupBy("node").agg(F.min("size").alias("size"), F.min("least").alias("least"), F.max("rank").alias("rank"), stray)
    tokens = rare_tokens(texts, of, words, threshold)

    def unjudged(pairs: DataFrame) -> DataFrame:
        turned = known.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        ends = pairs.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
        return _apart(ends.join(turned, ["a", "b"], "left_anti"), roots)

    first = tokens.groupBy("shingle", "kth").agg(F.max_by("node", "rank").alias("y"))
    known, roots = judge(unjudged(tokens.select(F.col("node").alias("x"), "shingle", "kth").join(first, ["shingle", "kth"]).filter("x <> y")), known, roots)
    tokens = tokens.withColumn("root", F.col("node")) if roots is None else tokens.join(roots, "node", "left").withColumn(
        "root", F.coalesce("root", "node"))
    sides = [tokens.select("shingle", "kth", *[F.col(c).alias(f"{s}_{c}") for c in ("node", "root", "size", "position", "stray")]) for s in "xy"]
    rest = [F.col(f"{s}_size") - F.col(f"{s}_position") for s in "xy"]
    share = threshold / (1 + threshold) * (F.col("x_size") + F.col("y_size")) - 1e-6
    met = sides[0].filter("x_stray").join(sides[1], ["shingle", "kth"]).filter((F.col("x_root") != F.col("y_root")) & (F.least(*rest) >= share))
    known, roots = judge(unjudged(met.select(F.col("x_node").alias("x"), F.col("y_node").alias("y"))), known, roots)
    return roots


def _mixed(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    """The members of buckets that are not of one component: with their ``root``, and ``main``, the bucket's component
    of highest rank."""
    if roots is None:
        rooted = members.withColumn("root", F.col("node"))
    else:
        rooted = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ends = rooted.groupBy("bucket").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.max_by("root", "rank").alias("main")
    )
    tasks = tasks_for(members.sparkSession, members.count(), small=SMALL)
    return stored(rooted.join(ends.filter("low < high").select("bucket", "main"), "bucket"), "bagminhash-mixed", tasks=tasks)


def _with_roots(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    of_a = roots.select(F.col("node").alias("a"), F.col("root").alias("root_a"))
    of_b = roots.select(F.col("node").alias("b"), F.col("root").alias("root_b"))
    return pairs.join(of_a, "a", "left").join(of_b, "b", "left")


def _apart(pairs: DataFrame, roots: DataFrame | None) -> DataFrame:
    """The pairs whose nodes aren't connected yet."""
    if roots is None:
        return pairs
    return _with_roots(pairs, roots).filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def classes(docs: DataFrame, words: int = 5, threshold: float = 0.8, bands: int = 32, rows: int = 5) -> DataFrame:
    """One row per distinct text: sha, class_id (smallest doc_id of its class), class_size, owner (whether it is the
    text that stands for the class: that of the smallest doc_id, then the smallest digest)."""
    all_nodes = nodes(docs, words, bands, rows)
    roots = near_roots(all_nodes, docs, words, threshold)
    rooted = all_nodes.drop("buckets").withColumn("root", F.col("node"))
    if roots is not None:
        found = roots.withColumnRenamed("root", "found")
        rooted = all_nodes.drop("buckets").join(found, "node", "left").withColumn("root", F.coalesce("found", "node"))
    first = F.struct(F.col("keep_id").isNull().alias("none"), F.col("keep_id").alias("id"), F.col("sha").alias("sha"))
    whole = rooted.groupBy("root").agg(F.min(first).alias("first"), F.sum("copies").alias("class_size"))
    return rooted.join(whole, "root").select(
        "sha", "keep_id", F.col("first.id").alias("class_id"), "class_size", (F.col("sha") == F.col("first.sha")).alias("owner")
    )


def near_duplicates(docs: DataFrame, words: int = 5, threshold: float = 0.8, bands: int = 32, rows: int = 5) -> DataFrame:
    """One row per document: doc_id, class_id, class_size. Documents are in one class when links of at least the
    threshold connect them, over the multisets of their runs of ``words`` words; equal texts always are. A text
    without words is alike only to equal texts. Null texts are empty; null identifiers count last.

    With the default bands a pair at the threshold shares no bucket with a probability of 3 in a million.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(text_or_empty(), 256).alias("sha"))
    return slim.join(classes(docs, words, threshold, bands, rows), "sha").select("doc_id", "class_id", "class_size")


def survivors(docs: DataFrame, words: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stand for their class; one row a class."""
    sha, keep, own, key, rank = unused(docs, "__sha", "__keep", "__own", "__id", "__nth")
    found = classes(docs, words, threshold).filter("owner").select(F.col("sha").alias(sha), F.col("keep_id").alias(keep))
    marked = docs.withColumn(own, F.sha2(text_or_empty(), 256)).withColumn(key, F.col("doc_id").cast("long"))
    same = (F.col(own) == F.col(sha)) & F.col(key).eqNullSafe(F.col(keep))
    nth = F.row_number().over(Window.partitionBy(own).orderBy(key))
    return marked.join(found, same, "left_semi").withColumn(rank, nth).filter(F.col(rank) == 1).select(*docs.columns)
