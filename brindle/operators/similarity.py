"""Duplicates, similarity joins and components."""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.text import fingerprint, normalize_text, token_set
from brindle.sources.shared import stored


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage: written once to the shared folder and read again (a checkpoint would compute it twice)."""
    return stored(df, "table")


def join_by(left: DataFrame, right: DataFrame, key: str, how: str = "inner", *, share: int = 1000) -> DataFrame:
    """left joined with right, which has one row a key, where one key may hold much of left (a written table).

    Keys with over one in `share` of left's rows can be no more than `share`: their rows of right are broadcast and
    left's stay where they are. All others meet by a shuffle, in which no key is frequent.
    """
    total = left.count()
    often = [r[0] for r in left.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * share > total).select(key).collect()] if total > share else []
    hot = [k for k in often if k is not None]
    if not hot:
        return left.join(right, key, how)
    few = F.broadcast(left.sparkSession.createDataFrame([(k,) for k in hot], left.select(key).schema))
    rest = left.join(few, key, "left_anti").join(right, key, how)
    return left.join(few, key, "left_semi").join(F.broadcast(right.join(few, key, "left_semi")), key, how).unionByName(rest)


def exact_groups(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each fingerprint that several rows have: its first key and the number of rows. Null texts take no part."""
    marked = docs.where(F.col(text).isNotNull()).select(key, fingerprint(F.col(text)).alias("fingerprint"))
    return marked.groupBy("fingerprint").agg(F.min(key).alias("first_id"), F.count(F.lit(1)).alias("n_docs")).where("n_docs > 1")


def keep_first(docs: DataFrame, by: list, *, order: str = "doc_id") -> DataFrame:
    """One row of each value of `by`, the one with the smallest `order`. A partial minimum, no window over a group."""
    names = [f"__by{k}" for k in range(len(by))]
    keyed = docs.select("*", *[c.alias(n) for c, n in zip(by, names, strict=True)])
    first = keyed.groupBy(*names).agg(F.min(order).alias("__first"))
    return keyed.join(first, (keyed[order] == first["__first"]) & _equal(keyed, first, names), "left_semi").drop(*names)


def _equal(a: DataFrame, b: DataFrame, names: list[str]):
    out = F.lit(True)
    for n in names:
        out = out & a[n].eqNullSafe(b[n])
    return out


def token_rows(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row with a number of its own, the digest of its token set and the set itself as hashes; written once."""
    tokens = F.array_sort(F.transform(token_set(F.coalesce(F.col(text), F.lit(""))), lambda t: F.xxhash64(t)))
    marked = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), tokens.alias("tokens"))
    return checkpointed(marked.withColumn("digest", F.unhex(F.sha2(F.array_join(F.transform("tokens", lambda t: F.hex(t)), " "), 256))))


def token_classes(rows: DataFrame) -> DataFrame:
    """Rows with equal token sets are one class, named by its first row: digest, class, size, the smallest key and hash."""
    return checkpointed(rows.groupBy("digest").agg(F.min("row").alias("class"), F.count(F.lit(1)).alias("size"), F.min("key").alias("first"), F.min(F.get("tokens", F.lit(0))).alias("least")))


#: Token counts are kept by this many buckets of the hash: what is broadcast and what a task sends is bounded by it.
BUCKETS = 1 << 18


def _prefixes(shared, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column("tokens")
            n = pc.list_value_length(tokens).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = tokens.flatten().to_numpy(zero_copy_only=False)
            own = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((flat, shared.value[flat & (BUCKETS - 1)], own))
            begin = np.cumsum(n) - n
            long = np.where(n > 0, n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1, 0)
            place = np.arange(len(flat)) - begin[own]
            kept = order[place < long[own]]
            offsets = pa.array(np.concatenate([[0], np.cumsum(long)]), type=pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(n.astype(np.int32)), pa.ListArray.from_arrays(offsets, pa.array(flat[kept]))], names=["row", "n", "prefix"])

    return run


def class_links(rows: DataFrame, classes: DataFrame, threshold: float, *, most: int = 2_000_000) -> DataFrame:
    """J01 between classes: (a, b, similarity), a < b, Jaccard >= threshold; lossless.

    Tokens are put in one order, by how many rows have a token of the same bucket of hashes. Two sets with a Jaccard
    similarity of t or more share a token among the first n - ceil(t n) + 1 of each, so only these rare tokens are
    joined; sizes must lie within a factor of t, and where the first shared token stands must leave enough of both
    sets behind it. The exact similarity then decides. Only the sets of classes that were met are fetched, once for all
    pairs of a bucket (up to `most` numbers of them are broadcast, more are shuffled).
    """
    spark = rows.sparkSession
    df = np.zeros(BUCKETS, dtype=np.int64)
    counted = rows.select(F.explode("tokens").alias("t")).groupBy(F.col("t").bitwiseAND(BUCKETS - 1).alias("bucket")).agg(F.count(F.lit(1)).alias("n")).toArrow()
    df[counted["bucket"].to_numpy()] = counted["n"].to_numpy()
    named = rows.select("row", "tokens").mapInArrow(_prefixes(spark.sparkContext.broadcast(df), threshold), "row long, n int, prefix array<long>")
    prefix = checkpointed(named.join(classes.select(F.col("class").alias("row")), "row").select("row", "n", F.posexplode("prefix").alias("at", "token")))
    left, right = prefix.toDF("a", "na", "ia", "token"), prefix.toDF("b", "nb", "ib", "token")
    both = F.lit(threshold) / (1 + threshold) * (F.col("na") + F.col("nb")) - 1e-6  # shared tokens of two such sets
    near_size = (F.col("na") * threshold <= F.col("nb") + 1e-9) & (F.col("nb") * threshold <= F.col("na") + 1e-9)
    met = checkpointed(left.join(right, "token").where((F.col("a") < F.col("b")) & near_size & (F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) >= both)).select("a", "b").distinct())
    dealt = _dealt(met, rows, classes)
    ends = checkpointed(dealt.select("bucket", F.col("a").alias("row")).union(dealt.select("bucket", "b")).distinct())
    fetched = rows.select("row", "tokens").join(F.broadcast(ends) if ends.count() <= most else ends, "row").select("bucket", "row", "tokens")
    return dealt.groupBy("bucket").cogroup(fetched.groupBy("bucket")).applyInArrow(_verify(threshold), "a long, b long, similarity double")


def _dealt(met: DataFrame, rows: DataFrame, classes: DataFrame, *, most: int = 200_000, tokens: int = 500_000) -> DataFrame:
    """Candidate pairs in buckets of about `tokens` tokens by the smallest hash of the second set. Two sets share it as
    often as they share tokens, so most sets are sent once. Keys of over `most` pairs are cut by both ends."""
    grouped = checkpointed(met.join(classes.select(F.col("class").alias("b"), F.col("least").alias("g")), "b"))
    large = grouped.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("g", F.ceil(F.sqrt(F.col("n") / most)).alias("cut"))
    size = rows.agg(F.coalesce(F.avg(F.size("tokens")), F.lit(0))).first()[0]
    n = max(1, int(grouped.select("a").union(grouped.select("b")).distinct().count() * size / tokens))
    cut = F.coalesce("cut", F.lit(1))
    key = F.xxhash64("g", F.pmod(F.xxhash64("a"), cut), F.pmod(F.xxhash64("b"), cut))
    return checkpointed(grouped.join(F.broadcast(large), "g", "left").select(F.pmod(key, F.lit(n)).alias("bucket"), "a", "b"))


def _verify(threshold: float):
    def run(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        held = sets.column("tokens").combine_chunks()
        ends = np.cumsum(pc.list_value_length(held).to_numpy(zero_copy_only=False))
        flat = held.flatten().to_numpy(zero_copy_only=False)
        own = dict(zip(sets.column("row").to_pylist(), np.split(flat, ends[:-1]) if len(ends) else [], strict=True))
        a, b = pairs.column("a").to_pylist(), pairs.column("b").to_pylist()
        shared = np.array([np.intersect1d(own[x], own[y], assume_unique=True).size for x, y in zip(a, b, strict=True)], dtype=np.int64)
        both = np.array([own[x].size + own[y].size for x, y in zip(a, b, strict=True)], dtype=np.int64)
        similarity = shared / np.maximum(both - shared, 1)
        kept = np.flatnonzero(similarity >= threshold)
        return pa.table({"a": pairs.column("a").take(pa.array(kept)), "b": pairs.column("b").take(pa.array(kept)), "similarity": pa.array(similarity[kept])})

    return run


def components(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Node and root, the smallest node of its component. links: a, b; nodes: node.

    Rounds of the smallest label around each node, then the label's label, until a round changes none.
    """
    both = checkpointed(links.select("a", "b").union(links.select("b", "a")))
    labels = checkpointed(nodes.select("node", F.col("node").alias("root")))
    while True:
        around = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("root").alias("near"))
        nearest = checkpointed(labels.join(around, labels.node == around.a, "left").select("node", F.col("root").alias("old"), F.least("root", F.coalesce("near", "root")).alias("root")))
        jump = nearest.select(F.col("node").alias("root"), F.col("root").alias("far"))
        new = checkpointed(join_by(nearest, jump, "root", "left").select("node", "old", F.least("root", F.coalesce("far", "root")).alias("root")))
        done = new.where("root <> old").isEmpty()
        labels = new.select("node", "root")
        if done:
            return labels


def source_groups(docs: DataFrame, *, threshold: float = 0.9, key: str = "doc_id", text: str = "text") -> DataFrame:
    """J01 and A07 per document: key, group_id (the smallest key reachable) and n_links (documents it is similar to itself)."""
    rows = token_rows(docs, key=key, text=text)
    classes = token_classes(rows)
    links = checkpointed(class_links(rows, classes, threshold))
    ends = links.select(F.col("a").alias("class"), F.col("b").alias("other")).union(links.select("b", "a"))
    around = ends.join(classes.select(F.col("class").alias("other"), F.col("size").alias("others")), "other").groupBy("class").agg(F.sum("others").alias("others"))
    roots = components(links, ends.select(F.col("class").alias("node")).distinct())
    rooted = checkpointed(roots.withColumnRenamed("node", "class").join(classes.select("class", "first"), "class"))
    named = rooted.groupBy("root").agg(F.min("first").alias("group_id"))
    linked = join_by(rooted, named, "root").join(around, "class").select("class", "group_id", "others")
    n_links = F.col("size") - 1 + F.coalesce("others", F.lit(0))
    by_class = classes.join(linked, "class", "left").select("digest", F.coalesce("group_id", "first").alias("group_id"), n_links.cast("long").alias("n_links"))
    return join_by(rows.select("key", "digest"), by_class, "digest").select(F.col("key").alias(key), "group_id", "n_links")


def _blocks(rows: DataFrame, size: Column, most: int) -> Iterator[DataFrame]:
    """A set of stated queries in blocks of about `most` (tokens or characters) each."""
    total = rows.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    n = max(1, -(-total // most))
    for k in range(n):
        yield rows.where(F.pmod(F.xxhash64(*rows.columns), F.lit(n)) == k)


def _best(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, sizes, number, begin, posting = shared.value
        for batch in batches:
            tokens = batch.column("t")
            n = pc.list_value_length(tokens).to_numpy(zero_copy_only=False)
            flat = np.array([number.get(w, -1) for w in tokens.flatten().to_pylist()], dtype=np.int64)
            ends = np.cumsum(n)
            keys, found, scores = [], [], []
            for k, (end, m) in enumerate(zip(ends.tolist(), n.tolist(), strict=True)):
                own = flat[end - m : end]
                own = own[own >= 0]
                if not len(own):
                    continue
                hits = np.concatenate([posting[begin[w] : begin[w + 1]] for w in own.tolist()])
                both = np.bincount(hits, minlength=len(items))
                some = np.flatnonzero(both)
                score = both[some] / (m + sizes[some] - both[some])
                best = some[int(np.argmax(score))]  # items are in order: the first of equal ones
                keys.append(k)
                found.append(int(best))
                scores.append(float(score.max()))
            if keys:
                yield pa.RecordBatch.from_arrays([batch.column("k").take(pa.array(keys)), pa.array([items[i] for i in found], type=pa.int64()), pa.array(scores)], names=["k", "i", "s"])

    return run


def best_match(docs: DataFrame, forbidden: DataFrame, *, key: str = "doc_id", item: str = "item_id", text: str = "text", least_size: float = 0.0, block_tokens: int = 2_000_000) -> DataFrame:
    """The most similar forbidden item of each document by shared tokens: key, item, similarity rounded to 4.
    Documents that share no token have no row. Equal similarities go to the smallest item.

    The forbidden set is a list of stated queries: an index of its tokens, in blocks of block_tokens, goes to the
    documents, which are neither shuffled nor paired with every item.
    """
    own = docs.where(F.col(text).isNotNull()).select(F.col(key).cast("long").alias("k"), token_set(F.col(text)).alias("t"))
    bad = forbidden.where(F.col(text).isNotNull()).select(F.col(item).cast("long").alias("i"), token_set(F.col(text)).alias("u"))
    out = None
    for block in _blocks(bad, F.size("u"), block_tokens):
        rows = sorted((r["i"], r["u"]) for r in block.where("i IS NOT NULL").collect())
        number = {w: k for k, w in enumerate(sorted({w for _, u in rows for w in u}))}
        listed = sorted((number[w], k) for k, (_, u) in enumerate(rows) for w in u)
        words, posting = np.array([x for x, _ in listed], dtype=np.int64), np.array([x for _, x in listed], dtype=np.int64)
        begin = np.searchsorted(words, np.arange(len(number) + 1))
        shared = docs.sparkSession.sparkContext.broadcast(([i for i, _ in rows], np.array([len(u) for _, u in rows], dtype=np.int64), number, begin, posting))
        one = own.mapInArrow(_best(shared), "k long, i long, s double")
        out = one if out is None else out.union(one)
    best = out.where(F.col("s") >= least_size).groupBy("k").agg(F.min(F.struct((-F.col("s")).alias("s"), F.col("i").alias("i"))).alias("x"))
    return best.select(F.col("k").alias(key), F.col("x.i").alias(item), F.round(-F.col("x.s"), 4).alias("similarity"))


def containing(docs: DataFrame, forbidden: DataFrame, *, key: str = "doc_id", item: str = "item_id", text: str = "text", anchor: int = 5) -> DataFrame:
    """J02 by containment: documents whose normalised text holds an item's normalised text, whole words of it. Hashes of
    the items' first words (`anchor` of them, or all of a shorter item) meet those of the documents' runs of as many
    words, without texts; then the whole items are compared with the texts of the documents that were met."""
    items = forbidden.where(F.col(text).isNotNull()).select(F.col(item).alias("i"), normalize_text(F.col(text)).alias("u")).where("u <> ''").withColumn("n", F.least(F.size(F.split("u", " ")), F.lit(anchor)))
    items = items.withColumn("h", F.xxhash64("n", F.array_join(F.slice(F.split("u", " "), F.lit(1), F.col("n")), " ")))
    sizes = [r["n"] for r in items.select("n").distinct().collect()]  # at most `anchor`
    own = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.xxhash64(text).alias("d"), normalize_text(F.col(text)).alias("t"))
    runs = [f"transform(sequence(0, greatest(size(w) - {n}, 0)), j -> xxhash64({n}, array_join(slice(w, j + 1, {n}), ' ')))" for n in sizes]
    if not runs:
        return docs.select(F.col(key)).withColumn(item, F.lit(None).cast(dict(forbidden.dtypes)[item])).limit(0)
    hashes = F.expr(f"explode(array_distinct(flatten(transform(array(split(t, ' ')), w -> concat({', '.join(runs)})))))")
    met = own.select("k", "d", hashes.alias("h")).join(items.select("i", "h"), "h").select("k", "d", "i").distinct()
    padded = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    texts = own.distinct().withColumnsRenamed({"k": "k2", "d": "d2"})
    whole = met.join(texts, F.col("k").eqNullSafe(F.col("k2")) & (F.col("d") == F.col("d2"))).join(items.select("i", "u"), "i")
    found = whole.where(F.contains(padded(F.col("t")), padded(F.col("u")))).select("k", "i").distinct()
    return found.select(F.col("k").alias(key), F.col("i").alias(item))


class _Seeded:
    """difflib's ratio of many first texts with one second text, without its work at characters that seed no match.
    The second text is indexed once; characters that difflib holds for popular only extend matches."""

    def __init__(self, text: str):
        from difflib import SequenceMatcher

        self.b = text
        self.at = SequenceMatcher(None, "", text).b2j

    def longest(self, a: str, seeds: list[int], alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
        b, at = self.b, self.at
        i0, j0, size = alo, blo, 0
        last, lengths = -2, {}
        for i in seeds[bisect.bisect_left(seeds, alo) : bisect.bisect_left(seeds, ahi)]:
            old = lengths if i == last + 1 else {}
            last, lengths = i, {}
            for j in at[a[i]]:
                if j < blo:
                    continue
                if j >= bhi:
                    break
                k = lengths[j] = old.get(j - 1, 0) + 1
                if k > size:
                    i0, j0, size = i - k + 1, j - k + 1, k
        while i0 > alo and j0 > blo and a[i0 - 1] == b[j0 - 1]:
            i0, j0, size = i0 - 1, j0 - 1, size + 1
        while i0 + size < ahi and j0 + size < bhi and a[i0 + size] == b[j0 + size]:
            size += 1
        return i0, j0, size

    def ratio(self, a: str, floor: float) -> float:
        """The ratio, or -1 as soon as it is sure to be below the floor."""
        b, both = self.b, len(a) + len(self.b)
        seeds = [i for i, c in enumerate(a) if c in self.at]
        matched, most, spans = 0, min(len(a), len(b)), [(0, len(a), 0, len(b))]
        while spans:
            alo, ahi, blo, bhi = spans.pop()
            i, j, k = self.longest(a, seeds, alo, ahi, blo, bhi)
            matched += k
            left, right = (min(i - alo, j - blo), min(ahi - i - k, bhi - j - k)) if k else (0, 0)
            most += k + left + right - min(ahi - alo, bhi - blo)
            if both and 2.0 * most / both < floor:
                return -1.0
            if left:
                spans.append((alo, i, blo, j))
            if right:
                spans.append((i + k, ahi, j + k, bhi))
        return 2.0 * matched / both if both else 1.0


def _counts(text: str, number: dict[str, int]) -> np.ndarray:
    """How often the text has each numbered character."""
    out = np.zeros(len(number), dtype=np.int64)
    for c, n in Counter(text).items():
        if c in number:
            out[number[c]] = n
    return out


def _sequences(shared, least: float, piece: int = 0):
    """The best of each query in a part of the texts; with a piece, only of texts that share one of that length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = sorted(shared.value, key=lambda q: (len(q[1]), q[0]))
        lengths = np.array([len(t) for _, t, _ in queries], dtype=np.int64)
        number = {c: k for k, c in enumerate(sorted({c for _, t, _ in queries for c in t}))}
        counts = np.array([_counts(t, number) for _, t, _ in queries]).reshape(len(queries), len(number))
        floors = np.maximum(np.array([f for _, _, f in queries], dtype=np.float64), least)
        holders: dict[str, set[int]] = {}
        for n, (_, t, _) in enumerate(queries if piece else []):
            for i in range(len(t) - piece + 1):
                holders.setdefault(t[i : i + piece], set()).add(n)
        best: dict[int, tuple[float, int]] = {}
        for batch in batches:
            for key, text in zip(batch.column("k").to_pylist(), batch.column("t").to_pylist(), strict=True):
                # the shorter length, and the characters in common, bound the ratio from above
                both = np.maximum(lengths + len(text), 1)
                near = np.flatnonzero(2.0 * np.minimum(lengths, len(text)) / both >= floors) if text else np.arange(len(queries))
                if piece and len(near):
                    met = {n for i in range(0, len(text) - piece + 1, piece) for n in holders.get(text[i : i + piece], ())}
                    near = near[np.isin(near, list(met))] if met else near[:0]
                if text and len(near):
                    near = near[2.0 * np.minimum(counts[near], _counts(text, number)).sum(axis=1) / both[near] >= floors[near]]
                seeded = _Seeded(text) if len(near) else None
                for n in near.tolist():
                    q, t, _ = queries[n]
                    r = seeded.ratio(t, floors[n])
                    if r > least and (q not in best or (r, -key) > (best[q][0], -best[q][1])):
                        best[q] = (r, key)
                        floors[n] = r
        if best:
            yield pa.RecordBatch.from_arrays([pa.array(list(best), type=pa.int64()), pa.array([x[1] for x in best.values()], type=pa.int64()), pa.array([x[0] for x in best.values()])], names=["q", "k", "r"])

    return run


def best_sequence(queries: DataFrame, docs: DataFrame, *, key: str = "doc_id", query: str = "item_id", text: str = "text", least: float = 0.9, block_chars: int = 16_000_000) -> DataFrame:
    """Of each query (a stated set) the document whose text has the highest ratio of matching characters, if that
    is above `least`; equal ratios go to the smallest key. The length and the characters' counts bound the ratio from
    above, so only close texts are compared in full. A first pass over the texts that share a piece with a query finds a
    ratio that each query reaches at least; the second pass, over all texts, drops what is sure to stay below it. Rows
    with a null key or text take no part."""
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).where("k IS NOT NULL AND t IS NOT NULL")
    asked = queries.select(F.col(query).cast("long").alias("q"), F.col(text).alias("t")).where("q IS NOT NULL AND t IS NOT NULL")
    out = None
    for block in _blocks(asked, F.length("t"), block_chars):
        context, listed = docs.sparkSession.sparkContext, [(r["q"], r["t"]) for r in block.collect()]
        first = rows.mapInArrow(_sequences(context.broadcast([(q, t, least) for q, t in listed]), least, 16), "q long, k long, r double")
        reached = {r["q"]: r["r"] for r in first.groupBy("q").agg(F.max("r").alias("r")).collect()}  # one row for a query at most
        shared = context.broadcast([(q, t, reached.get(q, least)) for q, t in listed])
        one = rows.mapInArrow(_sequences(shared, least), "q long, k long, r double")
        out = one if out is None else out.union(one)
    best = out.groupBy("q").agg(F.min(F.struct((-F.col("r")).alias("r"), F.col("k").alias("k"))).alias("x"))
    return best.select(F.col("q").alias(query), F.col("x.k").alias(key), (-F.col("x.r")).alias("ratio"))


def new_only(rows: DataFrame, history: DataFrame, hash: str, *, order: str) -> DataFrame:
    """Of rows whose hash isn't in the history, the first of each hash in order."""
    fresh = rows.join(history.select(hash).distinct(), hash, "left_anti")
    return keep_first(fresh, [F.col(hash)], order=order)


def without(docs: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows whose key is not found."""
    return docs.join(found.select(key).distinct(), key, "left_anti")


def fail_if_any(docs: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows, or an error that names some of the matches."""
    some = [r[0] for r in docs.join(found, key, "left_semi").select(key).orderBy(key).limit(20).collect()]
    if some:
        raise ValueError(f"rows that must not be here: {some}")
    return docs


def first_in_order(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """The first row of each group in a given order, for groups of bounded size."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
