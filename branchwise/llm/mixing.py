"""Mixing sources to target weights, in blocks of words, with DataFrame functions only.

Every source is one long stream of words (its documents in the order of a hash of their ids), packed into blocks of fixed length. The mix has as
many slots as blocks are wanted from all sources together, in output shards of ``SHARD`` slots. Each shard draws the source of its slots
at random, so its source counts are multinomial; draws beyond a source's quota are handed to sources that are short of theirs,
so totals meet the targets and no source is repeated more than ``REPEATS`` times. The k-th slot of a source takes the
block at place k mod n of a pseudo-random permutation of its n blocks, another one for each round k div n
(swap-or-not: rounds of conditional exchanges with a keyed partner, a permutation of any n without tables or
sorting; with ``ROUNDS`` of them the blocks taken are spread like a random draw). Slots then meet blocks by index. Planning sees keys
and sizes only; texts meet their spans in one last join.

Everything random is a hash of a fixed seed and of positions: reruns agree, and a lost task is recomputed the same.
Documents are numbered within hash ranges of a source, whose number grows with the input, so a source with a third of all rows is
spread; blocks and slots are keyed by (source, block).

Defined cases: a null source is a source of its own, last in order; a null or empty text has size 0 and takes nothing; documents without an
id are ordered among equals by size; repeated rows are separate documents of their source; an empty table gives no rows. Other
columns of the input may have any names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from branchwise.llm.words import WORD, boxed, hash60, stored, unboxed, word_count
from branchwise.operators.skew import prefix_sum
from branchwise.session import durable

WEIGHTS = (5, 2, 1)
REPEATS = 3
BLOCK = 32
SHARD = 1 << 16
ROUNDS = 24
RANGE_ROWS = 20_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, block: int = BLOCK) -> DataFrame:
    """One row per source: rank ``_s``, source_size, target, ``_blocks``, ``_quota`` (slots) and their range ``_lo`` to ``_hi``.

    Targets: in the order of cap / weight, the level at which the remaining weights share what capped sources leave;
    sources stay below their cap from the first whose cap is not under that level.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = sources.withColumn("_s", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weighed = (ranked.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_s") % len(weights) + 1).cast("int")))
               .withColumn("_cap", (REPEATS * F.col("source_size")).cast("double")))
    order = Window.orderBy(F.col("_cap") / F.col("_w"), "_s")
    before = F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing))
    whole = Window.partitionBy()
    levels = weighed.withColumn("_level", (F.sum("source_size").over(whole) - before) / after)
    level = F.max(F.when(F.col("_level") <= F.col("_cap") / F.col("_w"), F.col("_level"))).over(whole)
    aimed = levels.withColumn("target", F.least(F.col("_cap"), F.coalesce(level * F.col("_w"), F.col("_cap"))))
    blocks = F.ceil(F.col("source_size") / block)
    quota = F.least(REPEATS * blocks, F.floor(F.coalesce(F.try_divide(F.col("target") * blocks, F.col("source_size")), F.lit(0.0)) + 0.5))
    counted = aimed.withColumn("_blocks", blocks.cast("long")).withColumn("_quota", quota.cast("long"))
    hi = F.sum("_quota").over(Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, 0))
    return counted.withColumn("_hi", hi).withColumn("_lo", F.col("_hi") - F.col("_quota")).select(
        "source", "_s", "source_size", "target", "_blocks", "_quota", "_lo", "_hi")


def pack(sized: DataFrame, sources: DataFrame, n_rows: int) -> DataFrame:
    """``sized`` with ``_s``, source_size, target and ``_off``, the words of its source that come before the document.

    Equal ids of one source go by size, then by ``_id`` where there is one.
    """
    bits = max(0, math.ceil(math.log2(max(1, n_rows / RANGE_ROWS))))
    placed = (sized.join(sources.select("source", "_s", "source_size", "target"), sized["source"].eqNullSafe(sources["source"]), "left").drop(sources["source"])
              .withColumn("_h", hash60(F.col("doc_id")))
              .withColumn("_range", F.call_function("shiftright", F.col("_h"), F.lit(60 - bits))))
    inside = Window.partitionBy("_s", "_range").orderBy("_h", "doc_id", "size", *[c for c in ("_id",) if c in sized.columns]).rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumn("_local", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    earlier = Window.partitionBy("_rs").orderBy("_rr").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (placed.groupBy(F.col("_s").alias("_rs"), F.col("_range").alias("_rr")).agg(F.sum("size").alias("_n"))
              .select("_rs", "_rr", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")))
    return (local.join(ranges, (F.col("_s") == F.col("_rs")) & (F.col("_range") == F.col("_rr")))
            .withColumn("_off", F.col("_local") + F.col("_before")).drop("_rs", "_rr", "_range", "_local", "_before", "_h"))


def _hash(*parts) -> Column:
    return hash60(F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def draw(spark: SparkSession, sources: DataFrame, n_slots: int, seed: str, shard: int = SHARD) -> DataFrame:
    """Slots of each shard and source: ``_shard``, ``_s``, ``_n`` and ``_k``, the slots of the source in earlier shards."""
    width = max(1, n_slots // 1024)
    cells = sources.where("_quota > 0").select(
        "_s", "_lo", "_hi", F.explode(F.sequence(F.expr(f"_lo div {width}"), F.expr(f"(_hi - 1) div {width}"))).alias("_cell"))
    at = F.floor(_hash(seed, "draw", F.col("id")) / float(1 << 60) * n_slots).cast("long")
    slots = spark.range(n_slots).select(F.expr(f"id div {shard}").alias("_shard"), at.alias("_at")).withColumn("_cell", F.expr(f"_at div {width}"))
    drawn = (slots.join(cells, "_cell").where("_at >= _lo and _at < _hi").groupBy("_shard", "_s").agg(F.count(F.lit(1)).alias("_c")))
    earlier = Window.partitionBy("_s").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    started = drawn.withColumn("_start", F.coalesce(F.sum("_c").over(earlier), F.lit(0))).join(sources.select("_s", "_quota"), "_s")
    kept = durable(started.withColumn("_keep", F.least(F.greatest(F.col("_quota") - F.col("_start"), F.lit(0)), F.col("_c"))))
    # surplus draws and missing slots, both numbered from 0, meet by number
    surplus = kept.where("_c > _keep").select("_shard", "_s", (F.col("_c") - F.col("_keep")).alias("_m"))
    surplus = prefix_sum(surplus, [], [F.col("_shard"), F.col("_s")], F.col("_m"), "_from").withColumn("_to", F.col("_from") + F.col("_m"))
    missing = (sources.join(kept.groupBy("_s").agg(F.sum("_keep").alias("_got")), "_s", "left")
               .withColumn("_m", F.col("_quota") - F.coalesce("_got", F.lit(0))).where("_m > 0")
               .withColumn("_to", F.sum("_m").over(Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, 0))))
    number = F.explode(F.sequence(F.col("_to") - F.col("_m"), F.col("_to") - 1)).alias("_r")
    moved = surplus.select("_shard", number).join(missing.select("_s", number), "_r").select("_shard", "_s", F.lit(1).cast("long").alias("_n"))
    # a small table, written: planning goes on from its columns instead of carrying everything above along
    final = durable(kept.where("_keep > 0").select("_shard", "_s", F.col("_keep").alias("_n")).unionByName(moved).groupBy("_shard", "_s").agg(F.sum("_n").alias("_n")))
    return final.withColumn("_k", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))


def permuted(slots: DataFrame, seed: str, rounds: int = ROUNDS) -> DataFrame:
    """``_j``, the image of ``_x`` under the permutation of 0 .. ``_blocks`` - 1 that ``_s`` and ``_round`` name."""
    def exchange(x: Column, r: Column) -> Column:
        partner = F.pmod(F.element_at("_keys", (F.col("_round") * rounds + r + 1).cast("int")) - x, F.col("_blocks"))
        coin = F.md5(F.concat_ws("|", F.lit(seed), F.lit("swap"), "_s", "_round", r, F.greatest(x, partner)))
        return F.when(F.substring(coin, 1, 1) < "8", partner).otherwise(x)

    return slots.withColumn("_j", F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), F.col("_x"), exchange))


def uses(spark: SparkSession, sources: DataFrame, n_slots: int, seed: str, rounds: int = ROUNDS) -> DataFrame:
    """Blocks that the mix takes: ``_s``, ``_j`` and ``_rounds``, with bit e set if round e takes the block."""
    keys = F.transform(F.sequence(F.lit(0), F.lit(REPEATS * rounds - 1)),
                       lambda i: F.pmod(_hash(seed, "key", F.col("_s"), i), F.greatest(F.col("_blocks"), F.lit(1))))
    counts = draw(spark, sources, n_slots, seed).join(sources.select("_s", "_blocks", keys.alias("_keys")), "_s")
    # few rows stand for many slots: dealt out by shard, so that the slots are made in as many tasks
    tasks = max(1, min(n_slots // SHARD + 1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    slots = (counts.repartition(tasks, "_shard", "_s").withColumn("_i", F.explode(F.sequence(F.col("_k"), F.col("_k") + F.col("_n") - 1)))
             .select("_s", "_blocks", "_keys", F.expr("_i div _blocks").alias("_round"), F.expr("_i % _blocks").alias("_x")))
    return permuted(slots, seed, rounds).groupBy("_s", "_j").agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("_round").cast("int"))).alias("_rounds"))


def plan(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(packed documents, taken parts). ``docs``: doc_id, source, text, and ``_id`` where rows must be told apart.

    Packed: doc_id, ``_id``, source, size, source_size, target, and the key ``_s``, ``_off``. Parts: key, ``_from`` (first word in the
    document, from 0), ``_len`` (words) and ``_rounds``.
    """
    spark = docs.sparkSession
    sized = durable(docs.select(*[docs[c] for c in ("doc_id", "_id", "source") if c in docs.columns], word_count(docs["text"]).alias("size")))
    sources = durable(targets(sized, weights, block))
    totals = sources.agg(F.sum("_quota")).first()  # one number
    n_slots = totals[0] or 0
    packed = durable(pack(sized, sources, sized.count()))
    pieces = packed.where("size > 0").select("_s", "_off", "size", F.explode(F.sequence(
        F.expr(f"_off div {block}"), F.expr(f"(_off + size - 1) div {block}"))).alias("_j"))
    begin = F.greatest(F.col("_j") * block, F.col("_off"))
    end = F.least((F.col("_j") + 1) * block, F.col("_off") + F.col("size"))
    pieces = pieces.select("_s", "_off", "_j", (begin - F.col("_off")).alias("_from"), (end - begin).alias("_len"))
    return packed, pieces.join(durable(uses(spark, sources, n_slots, seed)), ["_s", "_j"]).select("_s", "_off", "_from", "_len", "_rounds")


def shares(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target and ``taken``, the words the mix takes from it, repeats counted."""
    packed, parts = plan(docs, **options)
    taken = parts.groupBy("_s", "_off").agg(F.sum(F.col("_len") * F.bit_count("_rounds")).alias("_taken"))
    key = packed.withColumn("_key", F.when(F.col("size") > 0, F.col("_off")))
    taken = taken.select(F.col("_s").alias("_ts"), F.col("_off").alias("_key"), "_taken")
    joined = key.join(taken, (key["_s"] == taken["_ts"]) & (key["_key"] == taken["_key"]), "left")
    return joined.select(*[packed[c] for c in packed.columns if not c.startswith("_")], F.coalesce("_taken", F.lit(0)).cast("long").alias("taken"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus, in the columns of ``docs``: a row per document and round that takes words of it, with those words as its text.

    A round that takes the whole document gives its text unchanged; otherwise the taken runs of words follow each other with the white space
    behind each word, and ``n_chars`` is counted anew. Documents of which nothing is taken, those without words too, are left out.
    """
    boxes, _ = stored(boxed(docs, "doc_id", "source", "text").withColumn("_id", F.monotonically_increasing_id()))  # the key must not change
    packed, parts = plan(boxes.select("doc_id", "_id", "source", "text"), **options)
    each = parts.withColumn("_round", F.explode(F.array(*[F.lit(e) for e in range(REPEATS)]))).where(F.expr("_rounds & shiftleft(1, _round)") > 0)
    spans = each.groupBy("_s", "_off", "_round").agg(F.sort_array(F.collect_list(F.struct("_from", "_len"))).alias("_spans"), F.sum("_len").alias("_n"))
    spans = durable(packed.where("size > 0").select("_s", "_off", "_id", "size").join(spans, ["_s", "_off"]).select("_id", "size", "_spans", "_n"))
    text = F.col("_row")["text"]
    words = F.regexp_extract_all(text, F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    joined = boxes.select("_row", "_id").join(spans, "_id")
    # the words are bound once per row: named in the inner function they would be cut out anew for every span
    run = lambda ws: F.array_join(F.transform("_spans", lambda x: F.array_join(F.slice(ws, (x["_from"] + 1).cast("int"), x["_len"].cast("int")), "")), "")
    cut = F.transform(F.array(words), run)[0]
    out = joined.withColumn("_cut", F.when(F.col("_n") < F.col("size"), F.regexp_replace(cut, r"[\x20\x09-\x0D]+$", "")).otherwise(text))
    changed = {"text": F.col("_cut")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.char_length("_cut").cast(docs.schema["n_chars"].dataType)
    return out.select(unboxed(docs.columns, **changed))
