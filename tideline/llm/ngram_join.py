"""N-gram Jaccard join with several global token orders.

Two texts link when their shingle sets overlap by 80 percent of their union.
Candidates must share a prefix token under every order that is looked at:

1. Hash order. A set's extended prefix holds its first ``p + e`` tokens, so
   linked sets share ``e + 1`` of them.
2. Frequency order within the extended prefixes. Since ``e + 1`` tokens are
   shared, all but the ``e`` most frequent suffice: common passages fall away,
   and a set whose rarest tokens occur nowhere else has no partner.
3. A second hash order over the whole sets, intersected with the candidates
   before their sets are compared.

Texts with equal sets are one class. Buckets of a shared token are not paired
out: each round compares members with a pivot of their bucket only, links them
into components, and drops buckets that lie in one component. What stays after
a few rounds gets a fourth order, exact frequency over the whole remaining
sets, and only pairs in different components are compared. Components are
exact: any link left out lies inside one.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, fresh_names, materialize, new_path, only_cache, prepare, release_shuffles, table, text_slices
from .graph import connected_components
from .shingles import second_order, shingle_sets

PERCENT = 80
EXTRA, EXTRA_SHARE = 48, 50
#: Cheap rounds before the exact ones, and hash orders in each.
SKETCH_ROUNDS, SKETCHES = 2, 4
#: Rounds of one pivot per member; the pairs whose sizes are looked at without more rounds, in all and per row.
ROUNDS, FEW_PAIRS, PAIRS_PER_ROW = 1, 300_000, 2
#: Just over 100 / PERCENT, so that sizes which allow a link lie in one band or in neighbours.
BAND = 1.2501
#: Ids of documents with candidates: sent to every executor up to this many bytes, else joined by shuffle.
BROADCAST_BYTES = 16 << 20
#: Bytes of sets in a bucket, about.
BUCKET_BYTES = 32 << 20
_SETS = "key long, doc_id long, n long, digest binary, tokens array<long>, other array<long>"


def needed(n, percent: int = PERCENT):
    """Tokens that a set of ``n`` shares with any set it links to, at least."""
    return (percent * n + 99) // 100


def prefix_size(n):
    return n - needed(n) + 1


def extra_size(n):
    return np.minimum(n - prefix_size(n), EXTRA + n // EXTRA_SHARE)


def _list(arrays: list[np.ndarray]) -> pa.Array:
    """A list<int64> array of unsigned hashes, bit by bit."""
    offsets = np.cumsum([0] + [len(a) for a in arrays]).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, doc_id, n, the size of the extended prefix, how many of its rarest tokens count, and the prefix."""
    only_cache("")
    for batch in batches:
        for part in text_slices(batch):
            sets = shingle_sets(part.column("text").to_pylist())
            n = np.array([len(s) for s in sets], np.int64)
            full = np.where(n > 0, prefix_size(n) + extra_size(n), 0)
            count = np.where(n > 0, full - extra_size(needed(n)), 0)
            prefixes = [s[:m] for s, m in zip(sets, full, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("key"), part.column("doc_id"), pa.array(n), pa.array(full), pa.array(count), _list(prefixes)], ["key", "doc_id", "n", "m", "keep", "prefix"])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, doc_id, n, digest of the set, the set, and its prefix in the second order."""
    only_cache("")
    for batch in batches:
        for part in text_slices(batch):
            sets = shingle_sets(part.column("text").to_pylist())
            other = [s[np.argsort(second_order(s))[: prefix_size(len(s))]] if len(s) else s for s in sets]
            digests = [hashlib.sha256(s.tobytes()).digest()[:16] for s in sets]
            yield pa.RecordBatch.from_arrays(
                [part.column("key"), part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), _list(sets), _list(other)],
                ["key", "doc_id", "n", "digest", "tokens", "other"],
            )


def _keyed(docs: DataFrame) -> tuple[DataFrame, bool]:
    """doc_id, text and a row key: doc_id itself if it is unique and never null, else a hash of both; and which it is."""
    base = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    odd = base.groupBy("doc_id").count().filter("count > 1 or doc_id is null").limit(1).collect()
    return base.withColumn("key", F.xxhash64("doc_id", "text") if odd else F.col("doc_id")), bool(odd)


def _may_link(x: str, y: str) -> Column:
    """Whether the sizes of two bucket members, and what stands from the shared token on, allow a link.

    A bucket row has n tokens, m of them in its (extended) prefix and ``rest``
    from the shared token on. Linked sets share ``need`` tokens, so at least
    ``need + min(m - n)`` in their prefixes, and if this is the first of them in
    order, all of those stand in either ``rest``. Where it is not the first, the
    pair meets in that one's bucket.
    """
    a, b = (lambda c: F.col(f"{x}.{c}")), (lambda c: F.col(f"{y}.{c}"))
    near = 100 * F.least(a("n"), b("n")) >= PERCENT * F.greatest(a("n"), b("n"))
    room = F.least(a("rest"), b("rest")) - F.least(a("m") - a("n"), b("m") - b("n"))
    return near & ((100 + PERCENT) * room >= PERCENT * (a("n") + b("n")))


def _in_buckets(texts: DataFrame, n_tokens: int) -> tuple[DataFrame, str]:
    """Whole sets of ``texts`` (key, doc_id, text), written in buckets by key: as a plain table, and the name of the bucketed one."""
    spark = texts.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_tokens * 10 // BUCKET_BYTES + 1)
    sets = texts.repartition(n, "key").mapInArrow(_whole, _SETS)
    path = new_path(spark, "sets")
    name = f"tideline_sets_{path.rsplit('-', 2)[1]}"
    sets.write.format("parquet").bucketBy(n, "key").sortBy("key").option("path", path).saveAsTable(name)
    plain = spark.read.schema(_SETS).parquet(path)
    plain._tideline_path = path
    return plain, name


def _rarest(postings: DataFrame, limits: DataFrame, partners: int = 2) -> DataFrame:
    """Written out: (key, n, m, shared, t), the rarest ``keep`` tokens of each key, those of them that occur with others.

    ``postings`` is (key, token); ``limits`` (key, n, m, keep): of a key's ``m``
    tokens, those that occur nowhere else are the rarest and use up their part.
    """
    # Written out, so that the join reads two exchanges and Spark can split a hot token.
    frequency = materialize(postings.groupBy("token").agg(F.count("*").alias("df")).filter(F.col("df") >= partners), "frequency")
    release_shuffles(postings.sparkSession)
    common = postings.join(frequency.hint("shuffle_hash"), "token")
    sorted_ = common.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t"))
    joined = sorted_.join(limits.select("key", "n", "m", "keep"), "key")
    left = F.col("keep") - (F.col("m") - F.size("t"))
    rare = materialize(joined.withColumn("left", left.cast("int")).filter("left > 0").select("key", "n", "m", F.size("t").alias("shared"), F.slice("t", F.lit(1), F.greatest("left", F.lit(0))).alias("t")), "rare")
    discard(frequency)
    release_shuffles(postings.sparkSession)
    return rare


def _least_token(order: int) -> Column:
    return F.array_min(F.transform("t", lambda x: F.xxhash64(F.lit(order), x["token"])))


class _Links:
    """Verified links between class representatives, and what has been compared."""

    def __init__(self, sets: DataFrame, bucketed: str):
        self.sets, self.bucketed, self.spark = sets, bucketed, sets.sparkSession
        self.links: DataFrame | None = None
        self.compared: DataFrame | None = None
        self.parts: DataFrame | None = None
        self.tables: list[DataFrame] = []

    def _components(self, frame: DataFrame) -> DataFrame:
        if self.parts is None:
            return frame.withColumn("c", F.col("key"))
        parts = self.parts.select(F.col("node").alias("key"), F.col("component"))
        return frame.join(parts, "key", "left").withColumn("c", F.coalesce("component", "key")).drop("component")

    def compare(self, pairs: DataFrame, even: bool = True) -> None:
        """Compare pairs (m, p) not compared before; link what overlaps enough.

        ``even``: no ``m`` has more than a few pairs, but a ``p`` may have very
        many. The sets of ``m`` are then read where they lie, in buckets by key,
        and travel to their ``p``; those of ``p`` are set apart first. Otherwise
        both are dealt out. Joins by ``p`` read two exchanges, so Spark can split a hot one.
        """
        pairs = pairs.withColumns({"a": F.least("m", "p"), "b": F.greatest("m", "p")}).dropDuplicates(["a", "b"])
        if self.compared is not None:
            pairs = pairs.join(self.compared.select("a", "b"), ["a", "b"], "left_anti")
        pairs = materialize(pairs.select("a", "b", "m", "p"), "pairs")
        if not pairs.head(1):
            return
        mine = theirs = self.sets
        if even:
            mine = self.spark.table(self.bucketed)
            theirs = materialize(mine.join(pairs.select(F.col("p").alias("key")).distinct(), "key", "left_semi").select("key", "n", "other", "tokens"), "pivots")
        x, y = (lambda c: mine.select(F.col("key").alias("m"), F.col("n").alias("nm"), F.col(c).alias("x"))), (lambda c: theirs.select(F.col("key").alias("p"), F.col("n").alias("np"), F.col(c).alias("y")))
        near = pairs.join(x("other").drop("nm"), "m").join(y("other").drop("np"), "p").filter(F.arrays_overlap("x", "y")).select("a", "b", "m", "p")
        both = near.join(x("tokens"), "m").join(y("tokens"), "p")
        both = both.select("a", "b", (F.col("nm") + F.col("np")).alias("n"), F.size(F.array_intersect("x", "y")).alias("i"))
        found = materialize(both.filter(100 * F.col("i") >= PERCENT * (F.col("n") - F.col("i"))).select("a", "b"), "links")
        if even:
            discard(theirs)
        self.tables += [pairs, found]
        self.links = found if self.links is None else self.links.union(found)
        self.compared = pairs if self.compared is None else self.compared.union(pairs)
        release_shuffles(self.spark)
        if self.parts is not None and not found.head(1):
            return
        if self.parts is not None:
            discard(self.parts)
        self.parts = connected_components(self.links.select(F.col("a").alias("u"), F.col("b").alias("v")))

    def sketch(self, rare: DataFrame) -> None:
        """Gather plain near copies cheaply: documents that share the least of their
        tokens under one of a few hash orders are compared with one of them."""
        for r in range(SKETCH_ROUNDS):
            least = [F.struct(F.lit(o).alias("o"), _least_token(o).alias("h")) for o in range(r * SKETCHES, (r + 1) * SKETCHES)]
            rows = self._components(rare.select("key", "n", "t")).select("key", "n", "c", F.explode(F.array(*least)).alias("bucket"))
            rank = F.struct(F.lit(0).alias("d"), F.col("key").alias("h"))
            if self.links is not None:
                degree = self.links.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count("*").alias("degree"))
                rows = rows.join(degree, "key", "left")
                rank = F.struct((-F.coalesce("degree", F.lit(0))).alias("d"), F.xxhash64("key").alias("h"))
            heads = rows.groupBy("bucket").agg(F.min(F.struct(rank.alias("rank"), "key", "n", "c")).alias("f"), F.count("*").alias("size")).filter("size > 1")
            # Written out, here and below, so that Spark can split a hot bucket in the join.
            heads = materialize(heads.select("bucket", "size", F.col("f.key").alias("p"), F.col("f.n").alias("pn"), F.col("f.c").alias("pc")), "heads")
            near = 100 * F.least("n", "pn") >= PERCENT * F.greatest("n", "pn")
            pairs = rows.join(heads, "bucket").filter((F.col("c") != F.col("pc")) & near)
            self.compare(pairs.select(F.col("key").alias("m"), "p"))
            discard(heads)

    def _open(self, rows: DataFrame) -> DataFrame:
        """Rows (token, key, c, x) of the buckets that hold several components and a
        pair that may link, with the bucket's size and how many of its rows are strong."""
        sums = rows.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("size"), F.sum(F.col("x.strong").cast("long")).alias("strong"))
        heads = materialize(sums.filter("lo < hi and strong > 0").select("token", "size", "strong"), "heads")
        out = materialize(rows.join(heads, "token"), "buckets")
        discard(heads)
        release_shuffles(self.spark)
        return out

    def _to_pivots(self, rows: DataFrame) -> DataFrame:
        """Pairs of each member with the pivot of its fullest bucket."""
        first = F.min(F.struct((~F.col("x.strong")).alias("w"), "key", "c", "x")).alias("f")
        heads = materialize(rows.groupBy("token").agg(first).select("token", F.col("f.key").alias("p"), F.col("f.x").alias("px"), F.col("f.c").alias("pc")), "heads")
        near = rows.join(heads, "token").filter((F.col("c") != F.col("pc")) & _may_link("x", "px"))
        pairs = near.groupBy("key").agg(F.min(F.struct((-F.col("size")).alias("s"), "p")).alias("f")).select("key", "f.p")
        return pairs.select(F.col("key").alias("m"), "p")

    @staticmethod
    def _every_pair(rows: DataFrame) -> DataFrame:
        """Pairs of a bucket that may link; the smaller of the two must be strong."""
        one = rows.filter("x.strong").select("token", "key", "x", "c")
        two = rows.select("token", F.col("key").alias("key2"), F.col("x").alias("x2"), F.col("c").alias("c2"))
        pairs = one.join(two, "token").filter((F.col("x.n") <= F.col("x2.n")) & (F.col("c") != F.col("c2")) & _may_link("x", "x2"))
        return pairs.select(F.col("key").alias("m"), F.col("key2").alias("p"))

    def settle(self, rare: DataFrame) -> DataFrame | None:
        """Link what shares a bucket (see :func:`_buckets`).

        Once the pairs left in open buckets are few beside their rows, all are
        compared; until then each member is compared with one pivot a round,
        that of its fullest bucket. Returns the rows still open after the last.
        """
        rows = _buckets(self._components(rare))
        for r in range(ROUNDS + 1):
            now = self._open(rows)
            n, work = now.agg(F.count("*"), F.sum("strong")).first()
            if not n:
                return None
            if work <= FEW_PAIRS + PAIRS_PER_ROW * n:
                self.compare(self._every_pair(now), even=False)
                discard(now)
                return None
            if r == ROUNDS:
                return now
            self.compare(self._to_pivots(now))
            rows = self._components(now.select("token", "key", "x"))
        return None

    def rest(self, rows: DataFrame) -> None:
        """Settle what the rounds left: exact frequency order over whole sets, then every pair that may link."""
        sets = self.sets.join(rows.select("key").distinct(), "key", "left_semi")
        n = F.col("n")
        keep = n - F.floor((PERCENT * n + 99) / 100) + 1
        rare = _rarest(sets.select("key", F.explode("tokens").alias("token")), sets.select("key", "n", n.alias("m"), keep.alias("keep")))
        self.compare(self._every_pair(self._open(_buckets(self._components(rare), whole=True))), even=False)


def _buckets(rare: DataFrame, whole: bool = False) -> DataFrame:
    """(token, key, c, x) with tokens told apart by size: sets whose sizes allow a link share a bucket.

    ``x`` holds what :func:`_may_link` reads, and whether the row can be the
    smaller set of a linked pair: with sets of its size or more it shares
    ``2 * PERCENT / (100 + PERCENT)`` of its tokens at least, so as much must be
    left from the shared token on. ``whole``: every ``m`` is the size of a whole
    set. Otherwise a set that its extended prefix covers may still have a larger
    partner that reaches beyond its own.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(BAND)))
    each = rare.select("key", "n", "m", "c", "shared", band.alias("band"), F.posexplode("t.token").alias("i", "t"))
    left = (F.col("shared") - F.col("i")).cast("int")
    # The widest gap of any partner: m - n falls as n grows, and n grows by 100 / PERCENT at most.
    most = F.floor(F.col("n") * 100 / PERCENT).cast("int")
    need = F.floor((PERCENT * most + 99) / 100).cast("int")
    extra = F.least(need - 1, EXTRA + F.floor(most / EXTRA_SHARE).cast("int"))
    gap = F.lit(0) if whole else F.least(F.lit(0), (most - need + 1 + extra) - most, (F.col("m") - F.col("n")).cast("int"))
    strong = (100 + PERCENT) * (left - gap) >= 2 * PERCENT * F.col("n")
    x = F.struct(F.col("n").cast("int").alias("n"), F.col("m").cast("int").alias("m"), left.alias("rest"), strong.alias("strong"))
    both = F.explode(F.array(F.xxhash64("t", "band"), F.xxhash64("t", F.col("band") + 1)))
    return each.withColumn("x", x).select(both.alias("token"), "key", "c", "x")


def similar_components(docs: DataFrame) -> DataFrame:
    """Components of near-duplicate texts: key, doc_id, n_shingles, component_id, part.

    ``component_id`` is the least doc_id of a component; ``part`` tells
    components apart also where a repeated doc_id names two of them.

    Null or wordless text: an empty set, linked with nothing, its own component.
    Null doc_id: linked by its text; its component is the least doc_id there, or
    null. Repeated rows, or a doc_id with several texts: each row is placed by
    its own text. Ties cannot arise: components do not depend on pivots. Empty
    table: no rows. Other columns are ignored. Texts of any length are read whole.
    """
    spark = docs.sparkSession
    prepare(spark)
    keyed, repeated = _keyed(docs)
    profile = materialize(keyed.mapInArrow(_profile, "key long, doc_id long, n long, m long, keep long, prefix array<long>"), "profile")
    own = profile.dropDuplicates(["key"]) if repeated else profile
    rare = _rarest(own.select("key", F.explode("prefix").alias("token")), own)
    slim = materialize(profile.select("key", "doc_id", "n"), "profile")
    discard(profile)
    profile = slim
    ids = rare.select("key")
    n_ids, n_tokens = rare.agg(F.count("*"), F.sum("n")).first()
    ids = F.broadcast(ids) if n_ids * 16 <= BROADCAST_BYTES else ids
    texts = keyed.join(ids, "key", "left_semi").select("key", "doc_id", "text")
    texts = texts.dropDuplicates(["key"]) if repeated else texts
    sets, bucketed = _in_buckets(texts, n_tokens or 0)
    release_shuffles(spark)

    classes = sets.groupBy("digest", "n").agg(F.min("key").alias("rep"))
    classes = materialize(classes, "classes")
    members = materialize(sets.select("key", "doc_id", "digest", "n").join(classes, ["digest", "n"]).select("key", "doc_id", "rep"), "members")
    links = _Links(sets, bucketed)
    own_rare = rare.join(classes.select(F.col("rep").alias("key")), "key", "left_semi")
    links.sketch(own_rare)
    left = links.settle(own_rare)
    if left is not None:
        links.rest(left)

    placed = members.withColumnRenamed("key", "member").withColumnRenamed("rep", "key")
    placed = links._components(placed).select("member", "doc_id", "c")
    least = materialize(placed.groupBy("c").agg(F.min("doc_id").alias("component_id")), "least")
    place = placed.select("member", "c").distinct().join(least, "c").select(F.col("member").alias("key"), "component_id", F.col("c").alias("part"))
    out = profile.select("key", "doc_id", "n").join(place, "key", "left").withColumn("part", F.coalesce("part", "key"))
    # Written out, so that the tables behind it can go.
    out = materialize(out.select("key", "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "part"), "components")
    discard(profile, rare, sets, classes, members, least, *links.tables)
    if links.parts is not None:
        discard(links.parts)
    spark.sql(f"DROP TABLE IF EXISTS {bucketed}")
    return out


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component; all columns stay.

    The row whose doc_id names the component stays; among rows that repeat it,
    and in a component that nothing names, the one of the least row key. A
    wordless text is a component of its own.
    """
    keyed, repeated = _keyed(docs)
    mark, count = fresh_names(docs, "_mark", "_count")
    full = docs.withColumn(mark, F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")) if repeated else F.col("doc_id").cast("long"))
    found = similar_components(docs).filter("n_shingles > 0")
    head = F.struct((~F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("other"), F.col("key"))
    # Written out, so that Spark can split a large component in the join.
    first = materialize(found.groupBy("part").agg(F.min(head).alias("h")), "first")
    gone = found.select("key", "part").join(first, "part").filter("key <> h.key").select(F.col("key").alias(mark)).distinct()
    gone = materialize(gone, "gone")
    gone = F.broadcast(gone) if gone.count() * 16 <= BROADCAST_BYTES else gone
    kept = full.join(gone, mark, "left_anti")
    if repeated:
        one = Window.partitionBy(mark).orderBy(mark)
        kept = kept.withColumn(count, F.row_number().over(one)).filter((F.col(count) == 1) | F.col("text").isNull() | F.col("text").rlike(r"^[\x20\x09-\x0D]*$"))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
