"""Quality rules with risk-controlled thresholds.

Each document gets word and line measures; a base rule fails short or
repetitive texts. Beyond it, a measure may reject documents over a cutoff only
if the labelled good documents prove, per stratum, that the cutoff's false
rejection rate is under its share of ``risk``: the exact binomial tail
P(Bin(n, risk share) <= rejections seen) must be at most ``delta`` divided by
the number of measures and strata. Within a measure and stratum cutoffs are
tried in a fixed sequence, from the loosest on, until one fails, so that its
whole sequence needs no further correction. The strictest proven cutoff
applies; without one the measure rejects nothing in that stratum.
DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_rows, materialize, table

RISK, DELTA = 0.01, 0.05
GRID = (0.02, 0.05, 0.08, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.6, 0.7, 0.8, 0.9)
_SPACES, _SYMBOLS = " \t\n\x0b\f\r", "#*$%&|<>"


def measures() -> dict[str, Column]:
    """Name -> measure in 0..1 (larger is worse) from the counted columns."""
    share = lambda a, b: F.least(F.lit(1.0), F.col(a).cast("double") / F.greatest(F.col(b), F.lit(1)))
    return {"symbols": share("n_symbols", "word_chars"), "dup_lines": share("n_dup_lines", "n_lines"), "repeats": share("n_repeat_words", "n_words")}


def window_hashes(words: Column) -> Column:
    """A 64-bit hash of each 3-word window, in order."""
    return F.when(F.size(words) >= 3, F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))).otherwise(F.array().cast("array<bigint>"))


def covered_words(hashes: Column) -> Column:
    """Words inside windows that stand twice or more.

    Positions are sorted by (hash, index), so equal neighbours are the repeats;
    the words they cover are counted from the gaps between their starts.
    """
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = lambda p, i, j: F.coalesce(F.get(p, i)["h"] == F.get(p, j)["h"], F.lit(False))
    starts = lambda p: F.array_sort(F.transform(F.filter(F.transform(p, lambda x, k: F.struct(x["i"].alias("i"), (same(p, k, k - 1) | same(p, k, k + 1)).alias("d"))), lambda x: x["d"]), lambda x: x["i"]))
    covered = lambda s: F.aggregate(s, F.struct(F.lit(-3).alias("at"), F.lit(0).alias("n")), lambda a, i: F.struct(i.alias("at"), (a["n"] + F.least(F.lit(3), i - a["at"])).alias("n")), lambda a: a["n"])
    # Each step is bound by a one-element transform, so it is evaluated once.
    bind = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    return bind(pairs, lambda p: covered(starts(p)))


def measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns plus n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = docs.select(*keep, text.alias("_t"))
    df = df.withColumn("_w", F.regexp_extract_all("_t", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)))
    df = df.withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: F.translate(x, _SPACES, "") != ""))
    df = df.withColumn("_h", window_hashes(F.col("_w")))
    count = lambda c: c.cast("long")
    return df.select(
        *keep,
        count(F.size("_w")).alias("n_words"),
        count(F.length(F.translate("_t", _SPACES, ""))).alias("word_chars"),
        count(F.length("_t") - F.length(F.translate("_t", _SYMBOLS, ""))).alias("n_symbols"),
        count(F.size("_l")).alias("n_lines"),
        count(F.size("_l") - F.size(F.array_distinct("_l"))).alias("n_dup_lines"),
        count(F.when(F.size(F.array_distinct("_h")) < F.size("_h"), covered_words(F.col("_h"))).otherwise(0)).alias("n_repeat_words"),
    )


def log_tail(n: Column, k: Column, p: float) -> Column:
    """ln P(Bin(n, p) <= k) for k < n, summed term by term in logarithms."""
    first = n * F.lit(math.log1p(-p))
    odds = math.log(p) - math.log1p(-p)

    def step(a: Column, i: Column) -> Column:
        term = a["t"] + F.log((n - i + 1) / i) + F.lit(odds)
        high, low = F.greatest(a["s"], term), F.least(a["s"], term)
        return F.struct(term.alias("t"), (high + F.log1p(F.exp(low - high))).alias("s"))

    return F.when(k == 0, first).otherwise(F.aggregate(F.sequence(F.lit(1).cast("long"), k), F.struct(first.alias("t"), first.alias("s")), step, lambda a: a["s"]))


def _below(value: Column):
    return lambda c: c < value


def thresholds(labelled: DataFrame, stratum: str, risk: float = RISK, delta: float = DELTA, grid: tuple[float, ...] = GRID) -> DataFrame:
    """(stratum, cut_<measure>...) from labelled documents (stratum, measures, good).

    A cutoff is null where no value is proven. Only counts per stratum are
    gathered, by partial aggregation. A stricter cutoff rejects at least what a
    looser one does, so its tail is never smaller and the sequence that starts
    with the loosest is cut at the first failure by the test of each alone.
    """
    good = labelled.filter("good")
    names = list(measures())
    # How many cutoffs each measure is over; counts of that give the rejections of every cutoff.
    cuts = F.array(*map(F.lit, grid))
    over = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.size(F.filter(cuts, _below(F.col(m)))).alias("over")) for m in names]))
    cells = good.select(stratum, over.alias("x")).groupBy(stratum, "x.m", "x.over").agg(F.count("*").alias("n"))
    counts = cells.groupBy(stratum, "m").agg(F.sum("n").alias("n"), F.collect_list(F.struct("over", "n")).alias("h"))  # as many entries as cutoffs, at most
    tried = good.agg(F.count_distinct(F.coalesce(F.col(stratum).cast("string"), F.lit("\0"))).alias("_strata"))
    share = risk / len(names)
    limit = F.lit(math.log(delta / len(names))) - F.log(F.col("_strata").cast("double"))
    counts = counts.join(F.broadcast(tried))  # one row
    each = counts.select(stratum, "m", "n", "_strata", "h", F.posexplode(cuts).alias("i", "c"))
    cells = each.withColumn("k", F.aggregate(F.filter("h", lambda x: x["over"] > F.col("i")), F.lit(0).cast("long"), lambda a, x: a + x["n"]))
    # With rejections at or over the expected number the tail is never small; only fewer are summed.
    proven = cells.filter((F.col("k") < F.col("n") * share)).filter(log_tail(F.col("n"), F.col("k"), share) <= limit)
    cuts = [F.min(F.when(F.col("m") == m, F.col("c"))).alias(f"cut_{m}") for m in names]
    return proven.groupBy(stratum).agg(*cuts)


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, delta: float = DELTA, keep: list[str] | None = None) -> DataFrame:
    """Measures and verdict of every document; ``labels`` has doc_id and quality (1 is good).

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, then ``keep``.

    Null text: no words, so the base rule fails. Null stratum: a stratum of its
    own. Null or unmatched labels prove nothing. A doc_id has one vote in a
    stratum: it is good if all its labels say so, and counts with the worst
    measures of its rows. Repeated rows: each is judged. Equal measures stand
    or fall together. Without labels no measure rejects. Empty table: no rows.
    Other columns are ignored. Texts of any length are measured whole.
    """
    names = [*dict.fromkeys([c for c in ["doc_id", stratum, *(keep or [])]])]
    all_docs = measured(docs, names).withColumns(measures())
    all_docs = materialize(all_docs, "measures")
    marked = labels.filter("quality is not null").groupBy(F.col("doc_id").alias("_id")).agg((F.min("quality") == 1).alias("good"))
    seen = all_docs.join(marked, all_docs["doc_id"] == marked["_id"]).groupBy(stratum, "_id", "good").agg(*[F.max(m).alias(m) for m in measures()])
    cuts = thresholds(seen, stratum, risk, delta).withColumnRenamed(stratum, "_s")
    out = all_docs.join(cuts, all_docs[stratum].eqNullSafe(cuts["_s"]), "left")
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rejected = F.lit(False)
    for m in measures():
        rejected = rejected | F.coalesce(F.col(m) > F.col(f"cut_{m}"), F.lit(False))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & ~rejected).alias("kept"), *[c for c in keep or [] if c != "doc_id"])


def keep_good(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """``docs`` without the rows that :func:`judge` does not keep; columns stay.

    Null, empty and very long texts, ties, repeats and empty tables: as there.
    """
    marked = docs.withColumn("row_hash", F.xxhash64(F.col("text").cast("string")))
    bad = judge(marked, labels, stratum, keep=["row_hash"]).filter("not kept")
    return drop_rows(docs, bad.select(F.col("doc_id").cast("long"), "row_hash"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_GRID = ", ".join(map(str, GRID))
_SHARE = RISK / 3
SQL = rf"""
WITH base AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
words AS (SELECT doc_id, lang, t, regexp_extract_all(t, '([^\x20\x09-\x0D]+)', 1) AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM base),
wins AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM words, unnest(range(1, len(w) - 1)) AS r(i)),
twice AS (SELECT doc_id, i FROM wins QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + d) AS n FROM twice, unnest([0, 1, 2]) AS s(d) GROUP BY doc_id),
counted AS (
  SELECT w.doc_id, lang, len(w)::BIGINT AS n_words, length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::BIGINT AS word_chars,
    (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM words w LEFT JOIN covered c ON w.doc_id = c.doc_id),
scored AS (
  SELECT *, least(1.0, n_symbols::DOUBLE / greatest(word_chars, 1)) AS m1, least(1.0, n_dup_lines::DOUBLE / greatest(n_lines, 1)) AS m2, least(1.0, n_repeat_words::DOUBLE / greatest(n_words, 1)) AS m3 FROM counted),
votes AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
good AS (SELECT s.lang, s.doc_id, max(m1) AS m1, max(m2) AS m2, max(m3) AS m3 FROM scored s JOIN votes b ON s.doc_id = b.doc_id GROUP BY s.lang, s.doc_id),
total AS (SELECT count(DISTINCT coalesce(lang, chr(0))) AS strata FROM good),
tried AS (
  SELECT lang, c, count(*) AS n, count(*) FILTER (m1 > c) AS k1, count(*) FILTER (m2 > c) AS k2, count(*) FILTER (m3 > c) AS k3 FROM good, unnest([{_GRID}]) AS g(c) GROUP BY lang, c),
long AS (SELECT lang, c, n, 1 AS m, k1 AS k FROM tried UNION ALL SELECT lang, c, n, 2, k2 FROM tried UNION ALL SELECT lang, c, n, 3, k3 FROM tried),
proven AS (
  SELECT lang, m, min(c) AS cut FROM long, total
  WHERE k < n * {_SHARE!r} AND list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({_SHARE!r}) + (n - i) * ln(1 - {_SHARE!r})))) <= {DELTA} / (3 * strata)
  GROUP BY lang, m),
cuts AS (SELECT lang, min(cut) FILTER (m = 1) AS c1, min(cut) FILTER (m = 2) AS c2, min(cut) FILTER (m = 3) AS c3 FROM proven GROUP BY lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(m1 > c1, false) AND NOT coalesce(m2 > c2, false) AND NOT coalesce(m3 > c3, false) AS kept
FROM (SELECT s.*, c1, c2, c3, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM scored s LEFT JOIN cuts c ON s.lang IS NOT DISTINCT FROM c.lang)
"""
