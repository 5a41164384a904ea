"""How filters interact: what each removes, alone and after others, in every order.

Five filters of a text give a mask of failures. Four look at the text alone; the fifth
fails copies of a text that a smaller id has. Copies are found by partition refinement:
texts are split by their length in code points, then by the hashes of successive blocks,
and what is alone in its class is dropped at every step; the texts that are left are
compared in full with the first of their class, and all but those of the smallest id
are marked. Masks are then counted by part: 32 numbers a part stand for all documents,
and every order of the filters is reckoned from these.

Rows: a null text is an empty one, and empty texts are copies of each other. A null part
is the empty string. A null id is larger than any other; rows of equal ids and texts are
no copies of each other. Several labels of an id count as 1 if any is 1. An empty table
has no parts and gives no rows. Extra columns are not looked at.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactum.functions.columns import held
from redactum.functions.sql import let
from redactum.llm.common import Workspace, checked_broadcast

LETTERS = "ABCDE"
# Fixed values of the filters: least words, least percent of distinct ones, most percent of capitals, signs.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SIGNS = 200, 50, 2, "[#$%&*|]"
COPY = 1 << LETTERS.index("E")
#: Code points of the first block; each further one is twice as long, so that a text of n
#: code points has about log2(n / BLOCK) of them.
BLOCK = 256
#: Members of a class that meet one copy of its first text; larger classes are dealt over more.
MEMBERS = 1_000
#: Most bytes of files of first texts that are broadcast; more meet their classes in a shuffle.
HEADS_BYTES = 4 << 20


def failures_sql(text: str) -> str:
    """Bits 1 to 8 for the filters A to D of a text that is not null."""
    words = f"filter(split({text}, '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w <> '')"
    counts = let(words, "ws", "named_struct('n', size(ws), 'u', size(array_distinct(ws)))")
    of_words = let(counts, "f", f"IF(f.n < {LEAST_WORDS}, 1, 0) + IF(100L * f.u < {LEAST_DISTINCT}L * f.n, 2, 0)")
    capitals = f"(length({text}) - length(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')))"
    return f"{of_words} + IF(100L * {capitals} > {MOST_CAPITALS}L * length({text}), 4, 0) + IF({text} RLIKE '{SIGNS}', 8, 0)"


def block_hashes_sql(text: str, bits: int = 64) -> str:
    """Hashes of the successive blocks of a text, none for an empty one; of fewer ``bits`` in tests of collisions."""
    last = f"CAST(floor(log2((length({text}) - 1) DIV {BLOCK} + 1)) AS INT)"
    block = f"substring({text}, {BLOCK} * (shiftleft(1, j) - 1) + 1, {BLOCK} * shiftleft(1, j))"
    return f"IF({text} = '', CAST(array() AS array<bigint>), transform(sequence(0, {last}), j -> shiftrightunsigned(xxhash64({block}), {64 - bits})))"


#: A text's class after all its blocks.
_CLASS = "aggregate(hashes, xxhash64(length(t_)), (a, h) -> xxhash64(a, h))"


def _refined(rows: DataFrame, space: Workspace) -> DataFrame:
    """(class): classes of two rows or more after every block, from (n_chars, hashes).

    Each round splits the classes by the next block and drops what is alone. Only what
    is left goes on; what has no further block is done.
    """
    cur = rows.select(F.xxhash64("n_chars").alias("class"), "hashes", F.lit(0).alias("at"))
    done, last, at = [], None, 0
    while True:
        shared = space.write(cur.groupBy("class").count().where("count > 1").select("class"), "shared")
        left = space.write(cur.join(checked_broadcast(shared), "class"), "left")
        space.drop(shared, *([last] if last is not None else []))
        done.append(space.write(left.where(F.size("hashes") == at).select("class").distinct(), "whole"))
        last, following = left, left.where(F.size("hashes") > at)
        if following.isEmpty():
            break
        cur = following.select(F.xxhash64("class", F.col("hashes")[at]).alias("class"), "hashes", F.lit(at + 1).alias("at"))
        at += 1
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    out = space.write(out, "classes")
    space.drop(last, *done)
    return out


def marked(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source", members: int = MEMBERS, bits: int = 64) -> DataFrame:
    """(id, part, mask): the failures of every row, a bit each, the fifth for copies.

    Lengths, hashes and masks are written once and go through the rounds; texts are
    read again and shuffled only at the end, those in a class of two or more, to meet the
    first of their class, a copy of it for every ``members`` rows. Rows whose text is not
    that of their class's first, for a collision of hashes, are parted by their texts.
    """
    space = Workspace(docs.sparkSession, "audit")
    names = [F.col(f"`{key}`").alias("id"), F.expr(f"coalesce(CAST(`{part}` AS STRING), '')").alias("part"), F.expr(f"coalesce(`{text}`, '')").alias("t_")]
    base = held(docs.select(*names), {"hashes": F.expr(block_hashes_sql("t_", bits))})
    base = held(base, {"class": F.expr(_CLASS)})
    rows = space.write(base.select("id", "part", F.expr(failures_sql("t_")).alias("mask"), F.length("t_").alias("n_chars"), "hashes", "class"), "rows")
    classes = _refined(rows, space)
    # Of each class the smallest id, null last.
    of_class = rows.join(checked_broadcast(classes), "class").groupBy("class")
    groups = space.write(of_class.agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id"))["id"].alias("first"), F.count(F.lit(1)).alias("n")), "groups")
    texts = base.select("id", "part", "class", F.col("t_").alias("text")).join(checked_broadcast(groups), "class")
    odd = space.write(_unlike_head(texts, space, members), "odd")
    later = F.expr("first IS NOT NULL AND (id IS NULL OR id > first)").cast("int") * COPY
    plain = rows.select("id", "part", "mask", "class").join(checked_broadcast(groups).select("class", "first"), "class", "left").withColumn("mask", F.col("mask") + F.coalesce(later, F.lit(0)))
    if odd.isEmpty():
        return plain.select("id", "part", "mask")
    parted = [plain.join(checked_broadcast(odd), "class", "left_anti").select("id", "part", "mask")]
    rest = space.write(texts.select("id", "part", "class", "text").join(checked_broadcast(odd), "class"), "rest")
    while not rest.isEmpty():
        firsts = rest.groupBy("class").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text")).alias("m")).select("class", "m.id", "m.text").toDF("class", "first", "head")
        met = rest.join(space.write(firsts, "firsts"), "class")
        parted.append(met.where("text = head").select("id", "part", (F.expr(failures_sql("text")) + later).alias("mask")))
        rest = space.write(met.where("text <> head").drop("first", "head"), "rest")
    out = parted[0]
    for p in parted[1:]:
        out = out.union(p)
    return out


def _unlike_head(texts: DataFrame, space: Workspace, members: int) -> DataFrame:
    """(class): classes in which a text is not that of the first, from (id, class, text, first, n)."""
    heads = texts.where("id <=> first").groupBy("class").agg(F.min("text").alias("head"), F.first("n").alias("n"))
    heads = space.write(heads.select("class", "head", F.explode(F.expr(f"sequence(0, CAST((n - 1) DIV {members} AS INT))")).alias("deal")), "heads")
    deal = F.pmod(F.xxhash64("id", F.spark_partition_id()), F.expr(f"CAST((n - 1) DIV {members} AS INT) + 1")).cast("int")
    met = texts.select("class", "text", deal.alias("deal")).join(checked_broadcast(heads, size=HEADS_BYTES), ["class", "deal"])
    return met.where("text <> head").select("class").distinct()


# Every order and step: letters, the step's number, its filter's bit, the bits before it.
_STEPS = [("".join(o), i + 1, 1 << LETTERS.index(f), sum(1 << LETTERS.index(b) for b in o[:i])) for o in permutations(LETTERS) for i, f in enumerate(o)]
_ORDERS = len(_STEPS) // len(LETTERS)


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source", **how) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    ``labels`` has the key, quality and toxic. At most 32 rows a part are left of the
    documents before the orders are laid out; each part's rows are made from these
    without a shuffle.
    """
    known = labels.groupBy(F.col(f"`{key}`").alias("label_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")).where("label_id IS NOT NULL")
    known = checked_broadcast(Workspace(docs.sparkSession, "audit-labels").write(known, "labels"))
    rows = marked(docs, key, text, part, **how).join(known, F.col("id") == F.col("label_id"), "left")
    sums = {"n": F.count(F.lit(1)), "good": F.coalesce(F.sum("good"), F.lit(0)), "toxic": F.coalesce(F.sum("toxic"), F.lit(0))}
    by_mask = rows.groupBy("part", "mask").agg(*[c.alias(n) for n, c in sums.items()])
    parts = by_mask.groupBy("part").agg(F.collect_list(F.struct("mask", *sums)).alias("masks"))
    steps = ", ".join(f"struct('{o}', {i}, {f}, {b})" for o, i, f, b in _STEPS)
    laid = parts.select("part", "masks", F.expr(f"inline(CAST(array({steps}) AS array<struct<filter_order:string,step:int,own:int,before:int>>))"))
    total = lambda test, x="n": f"aggregate(filter(masks, m -> {test}), 0L, (a, m) -> a + m.{x})"
    removed = "m.mask & own <> 0 AND m.mask & before = 0"
    return laid.select(
        "part", "filter_order", "step", F.expr(total("m.mask & (before | own) = 0")).alias("kept"), F.expr(total(removed)).alias("removed"), F.expr(total("m.mask & own <> 0 AND m.mask & before <> 0")).alias("redundant"),
        F.expr(total("m.mask = own")).alias("unique_fails"), F.expr(total(removed, "good")).alias("good_lost"), F.expr(total(removed, "toxic")).alias("toxic_lost"),
        # In an equal share of all orders each of a text's failures comes first.
        F.expr(f"aggregate(filter(masks, m -> m.mask & own <> 0), 0L, (a, m) -> a + m.n * ({_ORDERS} DIV bit_count(m.mask)))").alias("shapley"),
    )
