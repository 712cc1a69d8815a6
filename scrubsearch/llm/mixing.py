"""Operator 10: mixing sources to target weights by Efraimidis-Spirakis sampling.

Targets: the sources, ordered by name with null last, weigh 1, 2, 3, 1, 2, 3 ...
and share the words of the whole table by weight. No target may pass
``max_epochs`` times its source's size; what is cut off is shared again by
weight among the others until none is above (water filling).

Selection: a source whose target holds e whole epochs takes every document e
times. The rest of its target is filled by weighted sampling without
replacement: a document draws u from a hash of its id and text and gets the
exponential key -ln(u) / quality; keys are sorted ascending within the source
and sizes are prefix-summed up to the remaining budget. Documents are whole:
the one across the budget's edge is taken when that ends nearer to the target.

The prefix sum never sorts a source in one task: a document's key falls into
one of ``KEY_BUCKETS`` cells of about equal mass (the key is scaled by the
source's mean quality), the cells are summed with map-side partial sums, and
only the one cell across the edge is sorted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scrubsearch.llm.common import WORD_CLASS, cut, fresh, global_rank, lookup

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
KEY_BUCKETS = 4096
SYMBOLS = r"[#*$%&|<>]"
MIN_QUALITY = 1e-9


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_CLASS)), F.lit(0)).cast("long")


def text_quality(text: Column, size: Column) -> Column:
    """Quality weight in (0, 1]: 1 for clean prose, falling with symbols per word."""
    symbols = F.coalesce(F.regexp_count(text, F.lit(SYMBOLS)), F.lit(0))
    return F.lit(1.0) / (F.lit(1.0) + symbols / F.greatest(size, F.lit(1)))


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) that depends on the given values alone."""
    joined = F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts])
    bits = F.conv(F.substring(F.md5(joined.cast("binary")), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / F.lit(2.0**52)


def water_fill(sources: DataFrame, size: str, weight: str, out: str,
               max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Add the target of each source (one row per source; a small or written table).

    Every round is one aggregate of the table to three numbers; sources whose
    share passes their cap are fixed at it. The capped set only grows.
    """
    cap = F.lit(max_epochs) * F.col(size)
    total = sources.agg(F.sum(size)).first()[0] or 0
    fixed_size, fixed_n, level = 0, -1, 0.0
    capped = F.lit(False)
    while True:
        row = sources.agg(
            F.sum(F.when(capped, cap)).alias("fixed"), F.sum(F.when(capped, 1)).alias("n"),
            F.sum(F.when(~capped, F.col(weight))).alias("open"),
        ).first()
        fixed_size, n = row["fixed"] or 0, row["n"] or 0
        if not row["open"] or n == fixed_n:
            break
        fixed_n, level = n, (total - fixed_size) / row["open"]
        capped = cap < F.col(weight) * F.lit(level)
    return sources.withColumn(
        out, F.when(capped, cap.cast("double")).otherwise(F.col(weight) * F.lit(float(level))))


def source_targets(docs: DataFrame, source: str, size: str, quality: str, weights=WEIGHTS,
                   max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source. Columns: source, source_size, source_quality, target."""
    per = docs.groupBy(F.col(source).alias("source")).agg(
        F.sum(size).alias("source_size"), F.avg(quality).alias("source_quality"))
    ranked = global_rank(per, [F.col("source").isNull(), F.col("source")], "pos")
    weight = reduce(lambda rest, kw: F.when(F.col("pos") % len(weights) == kw[0], kw[1]).otherwise(rest),
                    list(enumerate(weights)), F.lit(None))
    ranked = cut(ranked.withColumn("weight", weight.cast("double")))
    return cut(water_fill(ranked, "source_size", "weight", "target", max_epochs)
               .select("source", "source_size", "source_quality", "target"))


def plan_mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
             weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, quality: str | None = None) -> DataFrame:
    """How often the mix takes each document.

    Returns one row per input row: doc_id, source, size, source_size, target,
    copies (times taken), taken (copies * size) and quality.
    Null or blank texts have size 0 and are taken in whole epochs only; a null
    quality counts as 1 and one of 0 or less is sampled last; a null source is a
    source of its own. Ties are broken by id, then by text; rows that repeat id
    and text in one source go together. Other columns of ``docs`` are ignored.
    """
    base = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"),
        word_count(F.col(text)).alias("size"),
        F.greatest(F.coalesce(F.col(quality).cast("double"), F.lit(1.0)) if quality else
                   text_quality(F.col(text), word_count(F.col(text))),
                   F.lit(MIN_QUALITY)).alias("quality"),
        F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("digest"),
    )
    base = cut(base)  # small columns only
    targets = source_targets(base, "source", "size", "quality", weights, max_epochs)
    # A null source must meet its row, so the lookup key has a text for it.
    keyed = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))
    rows = lookup(base.withColumn("_key", keyed),
                  targets.withColumn("_key", keyed).drop("source"), "_key")
    epochs = F.floor(F.col("target") / F.col("source_size")).cast("long")
    draw = uniform(F.col("doc_id"), F.col("digest"))
    key = -F.log(draw) / F.col("quality")
    rows = rows.withColumns({
        "epochs": F.coalesce(F.when(F.col("source_size") > 0, epochs), F.lit(0)).cast("long"),
        "es_key": key,
        # Cells are numbered in key order.
        "cell": F.floor((F.lit(1.0) - F.exp(-key * F.col("source_quality"))) * KEY_BUCKETS).cast("int"),
    }).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))

    cells = rows.groupBy("_key", "cell").agg(F.sum("size").alias("cell_size"))
    before = Window.partitionBy("_key").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cut(cells.withColumn("before", F.coalesce(F.sum("cell_size").over(before), F.lit(0))))
    both = F.concat_ws("/", F.col("cell").cast("string"), F.col("_key"))
    rows = lookup(rows.withColumn("_cell", both),
                  cells.select(both.alias("_cell"), "cell_size", "before"), "_cell",
                  max_broadcast_rows=200_000)
    inside = F.col("before") + F.col("cell_size") <= F.col("rest")
    across = ~inside & (F.col("before") < F.col("rest"))
    done = rows.filter(~across).withColumn("more", inside.cast("long"))
    # A cell holds about 1 / KEY_BUCKETS of its source, and one cell of each
    # source lies across its edge. Equal rows are peers: they go together.
    upto = Window.partitionBy("_cell").orderBy("es_key", "doc_id", "digest").rangeBetween(
        Window.unboundedPreceding, Window.currentRow)
    peers = F.sum("size").over(Window.partitionBy("_cell", "es_key", "doc_id", "digest"))
    run = F.col("before") + F.sum("size").over(upto) - F.col("peers")
    sorted_edge = rows.filter(across).withColumn("peers", peers).withColumn("run", run).withColumn(
        "more", (F.col("run") + F.col("peers") / 2 <= F.col("rest")).cast("long")).drop("run", "peers")
    out = done.unionByName(sorted_edge)
    copies = F.col("epochs") + F.when(F.col("size") > 0, F.col("more")).otherwise(0)
    return out.select(
        "doc_id", "source", "size", "source_size", "target",
        copies.alias("copies"), (copies * F.col("size")).alias("taken"), "quality", "digest")


def apply_mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
              **options) -> DataFrame:
    """The mixed corpus: the rows of ``docs``, each as often as the mix takes it.

    Exactly the columns of ``docs`` return. A repeated row (same id, text and
    source) is taken as often as each of its equals.
    """
    plan = plan_mix(docs, doc_id, text, source, **options)
    k_id, k_digest, k_source, n, each = fresh(
        docs, "_mix_id", "_mix_digest", "_mix_source", "_mix_copies", "_mix_each")
    per = plan.groupBy(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"),
                       F.col("source").alias("_source")).agg(F.max("copies").alias("_copies"))
    per = per.filter("_copies > 0").toDF("_p_id", "_p_digest", "_p_source", "_p_copies")
    keyed = docs.withColumns({
        k_id: F.col(doc_id).cast("long"),
        k_digest: F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")),
        k_source: F.col(source).cast("string"),
    })
    same = (keyed[k_id].eqNullSafe(per["_p_id"]) & (keyed[k_digest] == per["_p_digest"])
            & keyed[k_source].eqNullSafe(per["_p_source"]))
    return (keyed.join(per, same).withColumn(n, F.col("_p_copies"))
            .withColumn(each, F.explode(F.sequence(F.lit(1), F.col(n))))
            .select([keyed[c] for c in docs.columns]))
