"""Similarity join on word n-grams: multiple-global-order filtering, exact verification, connected components.

1. A text's set holds its distinct 64-bit hashed shingles of `n` lower-cased words. Texts with one set form a class, whose smallest id
   stands for it; everything below joins classes, so copies are never paired.
2. Two sets with Jaccard at least t that are sorted by any one global order share an element among the first |x| - ceil(t |x|) + 1 of
   each. The first order puts a fixed fifth of the hash space first, by document frequency there. An element of one class only can join
   nothing, so a class with enough such elements at the front is out at once; what stays are near copies. Frequencies come from one
   aggregation, and elements found in one class never travel further. Pairs meet under this order by element and band of lengths.
3. In a group of texts that were made from one, most pairs share prefixes under any order and yet have too little in common, and such pairs grow
   as the square of the group. Each set's parities, a few bits for each of its elements, show how many elements two sets surely do not share.
4. The other orders sort by the hash, and by the hash hashed again: unlike document frequency and each other. Candidates must pass the prefix
   filter under every one of them, which bounds what two sets can share by what both prefixes show; only pairs that pass all have
   their whole sets intersected. Links between classes, class sizes and components by alternating large and small stars give the result.

Only DataFrame functions are used. Hot keys: copies are folded into classes by partial aggregation, elements that many classes share
come last in the first order and are split by length, skewed joins are left to adaptive execution (no later step depends on their partitioning).

Cases: null text and texts without words have the empty set and are linked with nothing; fewer than n words form one shingle; repeated rows
count as documents; a null id is never a component's smallest unless all are null; ties: smallest id; very long texts are whole; an
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import if_small, staged, unstage
from millrace.llm.quality import words_of

N, PERCENT, ORDERS = 5, 90, 3
#: One of so many parts of the hash space comes first in every order; there document frequencies are known.
FRONT = 5
_UPPER, _LOWER = ("".join(chr(c + k) for k in range(26)) for c in (65, 97))


def shingles(text: Column, n: int = N) -> list[tuple[str, Column]]:
    """Steps (name, expression over the names before) from a text to its sorted distinct shingle hashes `s`."""
    return [
        ("w", words_of(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER))),
        ("h", F.transform("w", lambda w: F.xxhash64(w))),
        ("d", F.when(F.size("h") >= n, F.transform(F.sequence(F.lit(0), F.size("h") - n), lambda i: F.xxhash64(*(F.get(F.col("h"), i + k) for k in range(n))))).when(F.size("h") > 0, F.array(F.xxhash64(F.col("h"), F.lit("short")))).otherwise(F.array().cast("array<bigint>"))),
        ("s", F.sort_array(F.array_distinct("d"))),
    ]


def _sets(rows: DataFrame, n: int) -> DataFrame:
    """rows (with a column text) and s, k: the set and its class."""
    keep = [c for c in rows.columns if c != "text"]
    for name, step in shingles(F.col("text"), n):
        rows = rows.select(*keep, step.alias(name))
    return rows.withColumn("k", F.xxhash64("s", F.size("s")))


def _need(size: Column, percent: int) -> Column:
    """ceil(t * size) in whole numbers."""
    return F.floor((size * percent + 99) / 100).cast("int")


def components(edges: DataFrame) -> DataFrame:
    """(u, root) for every node of the staged undirected edges (u, v): alternating large and small stars until nothing changes."""
    edges = staged(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    before = None
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if mark == before or not mark[0]:
            return edges.select("u", F.col("v").alias("root"))
        before = mark
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        again = staged(small.filter("u <> v").distinct(), "edges")
        unstage(edges)
        edges = again


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """Prefix elements under the first order (k, n, p, e, i: place) of the classes of `sets` (k, n, f, front, rest; one row a class) that another class has.

    The order is: elements of the front by document frequency, then the rest. Elements of one class alone are the rarest of the front and need no
    place; `lone` counts them. Only (e, tier, k) goes through the shuffles by element."""
    tier = lambda name, k: F.transform(name, lambda e: F.struct(e.alias("e"), F.lit(k).cast("byte").alias("tier")))
    rows = sets.select("k", F.explode(F.concat(tier("front", 0), tier("rest", 1))).alias("x")).select("x.e", "x.tier", "k")
    common = rows.groupBy("e").agg(F.count(F.lit(1)).cast("int").alias("c")).filter("c > 1")
    known = sets.select("k", "n", (F.col("n") - _need(F.col("n"), percent) + 1).alias("p"), "f")
    by = W.partitionBy("k")
    own = rows.join(common, "e").join(known, "k").withColumn("lone", F.col("f") - F.sum(F.when(F.col("tier") == 0, 1).otherwise(0)).over(by)).filter(F.col("lone") < F.col("p"))
    place = F.when(F.col("tier") == 0, F.col("lone") + F.row_number().over(by.orderBy("tier", "c", "e")) - 1).otherwise(F.col("f"))
    return staged(own.withColumn("i", place).filter("i < p").select("k", "n", "p", "e", "i"), "prefixes")


def band(size: Column, percent: int) -> Column:
    """Sizes of similar sets are in one band or in neighbouring ones (the widths are a little larger than the ratio, so that rounding can't matter)."""
    return F.floor(F.log(size.cast("double")) / F.lit(-math.log(percent / 100) * (1 + 1e-6) if percent < 100 else 1e-9)).cast("bigint")


def _pairs(prefixes: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes (k < k2) that share a prefix element under the first order and may be similar by their lengths and the element's places.

    The smaller set meets sets of its own band of lengths and the next only, so an element that very many classes share is split by length."""
    here = prefixes.withColumn("b", band(F.col("n"), percent))
    one = here.select("e", "k", "n", "i", F.explode(F.array(F.col("b"), F.col("b") + 1)).alias("b"))
    two = here.select("e", "b", F.col("k").alias("k2"), F.col("n").alias("n2"), F.col("i").alias("i2"))
    most = F.least(F.col("n") - F.col("i"), F.col("n2") - F.col("i2"))
    fit = (100 * F.col("n") >= percent * F.col("n2")) & ((100 + percent) * most >= percent * (F.col("n") + F.col("n2")))
    ordered = (F.col("n") < F.col("n2")) | (F.col("n") == F.col("n2")) & (F.col("k") < F.col("k2"))
    return one.join(two, ["e", "b"]).filter(ordered & fit).select(F.least("k", "k2").alias("k"), F.greatest("k", "k2").alias("k2")).distinct()


def other_orders(orders: int) -> list[Callable[[Column], Column]]:
    """The keys of the other global orders, all unlike document frequency and each other: the hash itself, then the hash hashed again under a number."""
    again = lambda seed: lambda e: F.xxhash64(e, F.lit(seed))
    return [(lambda e: e), *map(again, range(1, orders - 1))][: orders - 1]


def signs(s: Column, n: Column, orders: int, percent: int) -> list[Column]:
    """Prefixes of a set s under the other orders: the smallest keys, sorted."""
    p = n - _need(n, percent) + 1
    return [F.slice(F.sort_array(F.transform(s, key)), F.lit(1), p).alias(f"o{j}") for j, key in enumerate(other_orders(orders))]


def may_be_similar(x: Column, y: Column, n: Column, n2: Column, percent: int) -> Column:
    """Whether two sets may be similar by their prefixes x and y under one order.

    Both sets are known up to the smaller of the prefixes' last keys. What they share is at most what they share there and all that the
    shorter remainder has. Sets that share nothing in their prefixes fail, as do most that share little."""
    end = F.least(F.element_at(x, -1), F.element_at(y, -1))
    a, b = (F.filter(v, lambda e: e <= end) for v in (x, y))
    most = F.size(F.array_intersect(a, b)) + F.least(n - F.size(a), n2 - F.size(b))
    return F.arrays_overlap(x, y) & ((100 + percent) * most >= percent * (n + n2))


def parities(s: Column, n: Column) -> Column:
    """64-bit words of a sorted set s of n hashes, between two and four bits for each element (two words at least). A hash's high bits name
    its word, its low bits the bit that it turns over, so s is read once and neighbouring words of a longer row xor to those of a shorter one."""
    level = F.length(F.bin(F.floor((n - 1) / 32).cast("bigint")))
    words = F.call_function("shiftleft", F.lit(1), level)
    place = lambda e: (F.call_function("shiftright", e, 64 - level) + words / 2).cast("int")
    bit = lambda e: F.call_function("shiftleft", F.lit(1).cast("bigint"), e.bitwiseAND(F.lit(63)).cast("int"))
    zeros = lambda many: F.array_repeat(F.lit(0).cast("bigint"), many)
    state = lambda done, at, word: F.struct(done.alias("done"), at.alias("at"), word.alias("word"))
    step = lambda a, e: F.when(place(e) == a["at"], state(a["done"], a["at"], a["word"].bitwiseXOR(bit(e)))).otherwise(state(F.concat(a["done"], F.array(a["word"]), zeros(place(e) - a["at"] - 1)), place(e), bit(e)))
    return F.aggregate(s, state(zeros(F.lit(0)), F.lit(0), F.lit(0).cast("bigint")), step, lambda a: F.concat(a["done"], F.array(a["word"]), zeros(words - a["at"] - 1)))


def _apart(x: Column, y: Column) -> Column:
    """Bits in which two rows of parities differ, the longer one folded to the shorter; the sets have at least as many elements that they do not share."""
    to, xor = F.least(F.size(x), F.size(y)), lambda a, b: a.bitwiseXOR(b)
    fold = lambda v: F.when(F.size(v) == to, v).otherwise(F.transform(F.sequence(F.lit(0), to - 1), lambda i: F.aggregate(F.slice(v, (i * (F.size(v) / to) + 1).cast("int"), (F.size(v) / to).cast("int")), F.lit(0).cast("bigint"), xor)))
    return F.aggregate(F.zip_with(fold(x), fold(y), lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, b: a + b)


def similar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, percent: int = PERCENT, orders: int = ORDERS) -> DataFrame:
    """One row for each row of df: id_col, text_hash, n_shingles, class (bigint; null for empty sets), n_similar, component_id."""
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    base = _sets(docs.select("id", F.xxhash64("text").alias("t"), "text"), n)
    front = F.filter("s", lambda e: F.pmod(e, F.lit(FRONT)) == 0)
    base = base.select("id", "t", "k", F.size("s").alias("n"), "s", front.alias("front")).withColumn("f", F.size("front"))
    wanted = F.col("n") - _need(F.col("n"), percent) + 1 - F.col("f")
    rest = F.when(wanted > 0, F.slice(F.filter("s", lambda e: F.pmod(e, F.lit(FRONT)) != 0), F.lit(1), F.greatest(wanted, F.lit(1)))).otherwise(F.array().cast("array<bigint>"))
    base = staged(base.select("id", "t", "k", "n", "f", "front", rest.alias("rest")), "sets")
    full = base.filter("n > 0")
    classes = staged(full.groupBy("k").agg(F.min(F.struct(F.col("id").isNull().alias("z"), "id", "t")).alias("r"), F.count(F.lit(1)).alias("m")).select("k", "r.id", "r.t", "m"), "classes")
    copied = if_small(classes.filter("m > 1").select(F.col("k").alias("ck"), F.col("id").alias("cid"), F.col("t").alias("ct")))
    single = full.join(copied, F.col("k") == F.col("ck"), "left").filter(F.col("ck").isNull() | F.col("id").eqNullSafe(F.col("cid")) & (F.col("t") == F.col("ct")))
    # A repeated row has the same id and text: one of its rows is enough, and only classes of several rows can have any.
    alone, many = single.filter(F.col("ck").isNull()), single.filter(F.col("ck").isNotNull()).dropDuplicates(["k"])
    prefixes = _prefixes(alone.union(many).select("k", "n", "f", "front", "rest"), percent)
    pairs = staged(_pairs(prefixes, percent), "pairs")
    members = staged(pairs.select("k").union(pairs.select(F.col("k2").alias("k"))).distinct().join(classes, "k"), "members")
    # Whole sets of the candidates: their texts are found by hash and id, then hashed again.
    picked = if_small(members.select(F.col("t").alias("mt"), F.col("id").alias("mid")))
    found = docs.withColumn("t", F.xxhash64("text")).join(picked, (F.col("t") == F.col("mt")) & F.col("id").eqNullSafe(F.col("mid")), "left_semi").select("text")
    whole = _sets(found, n).groupBy("k").agg(F.first("s").alias("s"))
    whole = staged(whole.select("k", "s", F.size("s").alias("n"), parities(F.col("s"), F.size("s")).alias("parities"), *signs(F.col("s"), F.size("s"), orders, percent)), "whole")
    near = staged(_near(pairs, whole, percent), "near")
    links = staged(_links(_filtered(near, whole, orders, percent), whole, percent), "links")
    sides = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    others = sides.join(members.select(F.col("k").alias("v"), "m"), "v").groupBy(F.col("u").alias("k")).agg(F.sum("m").alias("others"))
    roots = components(links)
    roots = roots.union(roots.select(F.col("root").alias("u"), "root")).distinct()
    least = roots.join(members.select(F.col("k").alias("u"), "id"), "u").groupBy("root").agg(F.min("id").alias("least"))
    placed = roots.join(least, "root").select(F.col("u").alias("k"), "least")
    known = classes.filter("m > 1").select("k", "id", "m").union(members.filter("m = 1").select("k", "id", "m")).join(others, "k", "left").join(placed, "k", "left")
    known = if_small(staged(known.select(F.col("k").alias("ck"), (F.col("m") - 1 + F.coalesce("others", F.lit(0))).alias("similar"), F.coalesce("least", "id").alias("least")), "known"))
    out = base.select("id", "t", "k", "n").join(known, (F.col("k") == F.col("ck")) & (F.col("n") > 0), "left")
    return out.select(F.col("id").alias(id_col), F.col("t").alias("text_hash"), F.col("n").cast("bigint").alias("n_shingles"), F.when(F.col("n") > 0, F.col("k")).alias("class"), F.coalesce("similar", F.lit(0)).cast("bigint").alias("n_similar"), F.coalesce("least", "id").alias("component_id"))


def _near(pairs: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """The pairs whose parities leave it open that they are similar; only parities are moved for it, a small part of a prefix."""
    one = whole.select("k", "n", "parities")
    two = whole.select(F.col("k").alias("k2"), F.col("n").alias("n2"), F.col("parities").alias("parities2"))
    both = F.col("n").cast("bigint") + F.col("n2")  # what is not shared is in one set only, what is shared is in both
    fits = (100 + percent) * (both - _apart(F.col("parities"), F.col("parities2"))) >= 2 * percent * both
    return pairs.join(one, "k").join(two, "k2").filter(fits).select("k", "k2")


def _filtered(pairs: DataFrame, whole: DataFrame, orders: int, percent: int) -> DataFrame:
    """The pairs whose prefixes agree under all the other orders too; only prefixes are moved for it."""
    names = [f"o{j}" for j in range(orders - 1)]
    if not names:
        return pairs
    one = whole.select("k", "n", *names)
    two = whole.select(F.col("k").alias("k2"), F.col("n").alias("n2"), *(F.col(o).alias(f"{o}2") for o in names))
    fits = reduce(lambda a, b: a & b, (may_be_similar(F.col(o), F.col(f"{o}2"), F.col("n"), F.col("n2"), percent) for o in names))
    return pairs.join(one, "k").join(two, "k2").filter(fits).select("k", "k2")


def _links(pairs: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose whole sets are similar."""
    both = pairs.join(whole.select("k", "s"), "k").join(whole.select(F.col("k").alias("k2"), F.col("s").alias("s2")), "k2")
    shared = F.size(F.array_intersect("s", "s2"))
    return both.filter(100 * shared >= percent * (F.size("s") + F.size("s2") - shared)).select(F.col("k").alias("u"), F.col("k2").alias("v"))


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, percent: int = PERCENT) -> DataFrame:
    """The rows of df that stay when one document of each component does: that with the smallest id; of repeated rows, one.

    Documents without an id stay unless their component has an id; rows that share a component's smallest id with other texts stay."""
    found = staged(similar(df, id_col, text_col, n, percent), "similar")
    gone, hashed = (f"_{uuid.uuid4().hex}" for _ in range(2))  # names that no column of df has
    out = found.filter(~F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias(gone), F.col("text_hash").alias(hashed)).distinct()
    out = if_small(staged(out, "out"))
    same = F.col(id_col).eqNullSafe(F.col(gone)) & (F.xxhash64(F.col(text_col).cast("string")) == F.col(hashed))
    left = df.join(out, same, "left_anti")
    again = found.filter(F.col(id_col).isNotNull()).groupBy(id_col, "text_hash").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    return left if again.isEmpty() else left.dropDuplicates([id_col, text_col])
