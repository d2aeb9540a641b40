"""Sharding by a k-d tree over metadata; DataFrame functions only.

Groups of equal texts are points with weights (their bytes). Groups that weigh a good part of a shard are placed first,
whole where a shard has room; the tree deals the others to the room that is left. A node that stands for k shards is cut
along its widest dimension at the weighted quantile at which its first k/2 shards are full. All nodes of a level are cut together: the quantile is found by
histograms of 1,024 bins over a 60-bit key (30 bits of the dimension, 30 of a hash that breaks ties), each narrowing
the last one's bin. Only nodes times bins come to the driver, whatever the input; texts are read once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import place_of, prefix_sums, written

BINS, DIGITS = 10, 6  # bits a histogram, and histograms to a whole key
PIECES = 16  # a group of equal texts over this part of a shard is placed before the others


def _key(dim: str, lo: float, hi: float) -> Column:
    scaled = F.least(F.lit((1 << 30) - 1), F.floor((F.col(dim) - lo) / ((hi - lo) or 1.0) * float(1 << 30))).cast("long")
    return F.shiftleft(scaled, 30) + F.col("tie")


def tree(points: DataFrame, dims: list[str], room: list[float], weight: str = "bytes") -> DataFrame:
    """``points`` with their ``shard``, whose weights are to be as ``room``; each point has ``dims``, a weight and ``tie``
    (30 bits). The table is read some 15 times."""
    shards = len(room)
    bounds = [f(d).alias(f"{n}_{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))]
    nodes = {0: (0, shards)}  # node: first shard and number of shards
    node_of: Column = F.lit(0)
    whole = None
    while any(k > 1 for _, k in nodes.values()):
        at = points.withColumn("_node", node_of)
        stats = {r["_node"]: r for r in at.groupBy("_node").agg(F.sum(weight).alias("w"), *bounds).collect()}
        whole = whole or stats.get(0)
        cuts = {}
        for n, (low, k) in nodes.items():
            if k > 1:
                r = stats.get(n)
                part = sum(room[low : low + k // 2]) / (sum(room[low : low + k]) or 1.0)
                spread = {d: (r[f"hi_{d}"] - r[f"lo_{d}"]) / ((whole[f"hi_{d}"] - whole[f"lo_{d}"]) or 1.0) if r else 0.0 for d in dims}
                d = max(dims, key=lambda x: (spread[x], -dims.index(x)))
                key = _key(d, float(r[f"lo_{d}"]), float(r[f"hi_{d}"])) if r else F.lit(0).cast("long")
                cuts[n] = {"key": key, "goal": r["w"] * part if r else 0, "below": 0, "prefix": 0, "done": not r}
        for digit in range(DIGITS):
            if not (open_ := [n for n in cuts if not cuts[n]["done"]]):
                break
            key = F.lit(None).cast("long")
            inside = F.lit(False)
            for n in open_:
                key = F.when(F.col("_node") == n, cuts[n]["key"]).otherwise(key)
                inside = inside | ((F.col("_node") == n) & (F.shiftright(F.col("_key"), 60 - BINS * digit) == cuts[n]["prefix"]))
            keyed = at.where(F.col("_node").isin(open_)).withColumn("_key", key).where(inside)
            bins: dict[int, list[tuple[int, int, int]]] = {}
            counted = keyed.groupBy("_node", F.shiftright(F.col("_key"), 60 - BINS * (digit + 1)).alias("bin")).agg(F.sum(weight).alias("w"), F.count(F.lit(1)).alias("n"))
            for r in counted.collect():
                bins.setdefault(r["_node"], []).append((r["bin"], r["w"], r["n"]))
            for n in open_:
                c, found = cuts[n], sorted(bins.get(n, []))
                for b, w, many in found:
                    if c["below"] + w > c["goal"] or b == found[-1][0]:
                        # One point left, or all that is left is light: it goes to the side that then is nearer its share.
                        if many == 1 or digit == DIGITS - 1 or w < c["goal"] / 10_000:
                            take = abs(c["below"] + w - c["goal"]) <= abs(c["below"] - c["goal"])
                            c["cut"], c["done"] = ((b + take) << (60 - BINS * (digit + 1))), True
                        else:
                            c["prefix"] = b
                        break
                    c["below"] += w
                else:
                    c["cut"], c["done"] = 0, True
        grown: dict[int, tuple] = {}
        for n, (first, k) in nodes.items():
            if k == 1:
                grown[len(grown)] = (n, first, 1, None)
            else:
                grown[len(grown)] = (n, first, k // 2, True)
                grown[len(grown)] = (n, first + k // 2, k - k // 2, False)
        chosen = F.lit(0)
        for new, (n, _, _, side) in grown.items():
            here = node_of == n
            if side is not None:
                less = cuts[n]["key"] < F.lit(cuts[n].get("cut", 0)).cast("long")
                here = here & (less if side else ~less)
            chosen = F.when(here, F.lit(new)).otherwise(chosen)
        node_of = chosen
        nodes = {new: (first, k) for new, (_, first, k, _) in grown.items()}
        points = written(points.withColumn("_was", node_of).select(*[c for c in points.columns if c != "_was"], "_was"), "points")
        node_of = F.col("_was")
    shard = F.lit(0)
    for n, (first, _) in nodes.items():
        shard = F.when(node_of == n, F.lit(first)).otherwise(shard)
    return points.withColumn("shard", shard.cast("int"))


def _place(groups: list[tuple], share: float, count: int) -> tuple[list[tuple], list[float]]:
    """Heavy groups (h, size, crc, rows) to shards: (h, size, crc, from, to, shard), a row a piece, the piece being the rows
    whose spot in [0, 1) lies in [from, to); and the room that is left. The heaviest goes first, to the shard with most
    room, whole if it fits; a group that fits nowhere fills the shards with most room, one after another."""
    room, out = [share] * count, []
    for h, size, crc, rows in sorted(groups, key=lambda g: (-g[1] * g[3], g[0])):
        weight, at = size * rows, 0.0
        while at < 1.0:
            k = max(range(count), key=lambda i: (room[i], -i))
            left = weight * (1.0 - at)
            whole = left <= room[k] * (1 + 1 / PIECES) or rows == 1 or room[k] < size
            end = 1.0 if whole else at + room[k] / weight
            out.append((h, size, crc, at, end, k))
            room[k] -= weight * (end - at)
            at = end
    return out, [max(0.0, r) for r in room]


def shards(docs: DataFrame, count: int = 24) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row of (doc_id, text, lang, source, ...).

    size: UTF-8 bytes of the text (null as empty) plus 8. Shards are near equal in bytes. Equal texts share a shard; only
    a group that no shard has room for is cut, by a hash of doc_id, into as many pieces as it needs. Dimensions: least
    doc_id, size (logarithm), language and source (hashes; null a value of its own). slot counts from 0 without gaps
    within a shard, in an order of hashes. Nulls and repeated rows are rows like others; an empty table has no rows;
    shards may be empty if there are fewer texts than shards.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h"), place_of(F.col("lang").cast("string"), F.lit(1)).alias("lang"), place_of(F.col("source").cast("string"), F.lit(2)).alias("source"))
    base = written(base, "shard-rows")
    keys = ["h", "size", "text_crc32"]
    groups = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    share = (base.agg(F.sum("size")).first()[0] or 0) / count
    # At most PIECES * count groups can weigh so much: that bounds what is collected and broadcast.
    heavy = [tuple(r) for r in groups.where(F.col("size") * F.col("rows") > max(1.0, share / PIECES)).select(*keys, "rows").collect()]
    placed, room = _place(heavy, share, count)
    pieces = F.broadcast(spark.createDataFrame(placed, "h long, size long, text_crc32 long, lo double, hi double, own int"))
    spot = place_of("doc_id", F.lit(3))
    mine = (spot >= F.col("lo")) & (spot < F.col("hi"))
    rows = written(base.join(pieces, [*[base[k] == pieces[k] for k in keys], mine], "left").select(*[base[c] for c in base.columns], "own"), "placed")
    light = rows.where("own is null")
    points = light.groupBy(*keys).agg(F.sum("size").alias("bytes"), F.coalesce(F.min("doc_id"), F.lit(0)).cast("double").alias("d_id"), F.min("lang").alias("d_lang"), F.min("source").alias("d_source"))
    points = points.withColumn("d_size", F.log2("size")).withColumn("tie", F.shiftrightunsigned(F.xxhash64("h", "text_crc32"), 34).cast("long"))
    dealt = tree(written(points, "points"), ["d_id", "d_size", "d_lang", "d_source"], room)
    columns = ["doc_id", "size", "text_crc32", "h", "shard"]
    every = light.join(dealt.select(*keys, "shard"), keys).select(*columns).unionByName(rows.where("own is not null").withColumnRenamed("own", "shard").select(*columns))
    every = written(every.withColumn("place", place_of("h", "doc_id", F.lit(4))), "dealt")
    return prefix_sums(every.withColumn("one", F.lit(1).cast("long")), "shard", ["place", "doc_id", "h"], "one", "slot").select("doc_id", "size", "text_crc32", "shard", "slot")
