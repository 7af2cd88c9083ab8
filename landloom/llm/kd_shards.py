"""Shards as the leaves of a k-d tree over document metadata, cut at weighted medians.

Each document has four coordinates: size, language, source and id (strings by hash). A node that stands for
m shards is cut along its widest coordinate (extent over the table's extent) where the bytes below reach
floor(m / 2) / m of its own. All nodes of a level are cut together: histograms of bytes (``BINS`` a node at
most reach the driver) zoom in on the cut until it is within ``TOLERANCE`` of the node's bytes.

Rows of equal texts have the coordinates of the first of them and lie next to each other in every order, so
they stay in one shard, unless the group is so large that the shards' sizes could not be near equal: such a
group alone is cut by doc_id. DataFrame functions only.

Null texts have size 1; null languages and sources are values of their own; null ids come first. Repeated
rows are rows like others. An empty table gives no rows. With fewer groups than shards some shards are empty.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from landloom.llm.staging import shared_dir, split_join, stage

BINS, TOLERANCE = 1024, 5e-4
#: A group of equal texts stays whole if the cut beside it is off by this share of the node's bytes at most.
GROUP_TOLERANCE = 4e-3
#: Leaves that one tree is cut into at most (a level's nodes are a broadcast table of that many rows, and their histograms reach
#: the driver); for more shards each leaf stands for several and is cut by a tree of its own.
MOST_LEAVES = 512
#: Rows of a shard that are numbered by one task, about.
SLOT_ROWS = 20_000
DIMS = ("k_size", "k_lang", "k_source", "k_id")
_UNIT = 1 << 31
_LEAST = -(1 << 63)


@dataclass
class Cut:
    dim: int
    key: int  # rows with a lower key go left; those with this key if their id is at most last_id
    last_id: int


def _meta(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    # a text's bytes weigh one more, so that empty texts have a size
    return docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h"), "lang", "source")


def _units(rows: DataFrame) -> DataFrame:
    """Rows with the coordinates of their group of equal texts."""
    first = F.min(F.struct("doc_id", "lang", "source")).alias("first")
    groups = rows.groupBy("h").agg(first, F.count("*").alias("n"))
    ends = rows.agg(F.coalesce(F.min("doc_id"), F.lit(0)).alias("a"), F.coalesce(F.max("doc_id"), F.lit(0)).alias("z")).first()
    width = max(1, ends["z"] - ends["a"])
    hashed = lambda c: F.pmod(F.xxhash64(c), F.lit(_UNIT))
    groups = groups.select("h", "n", hashed("first.lang").alias("k_lang"), hashed("first.source").alias("k_source"), F.coalesce(F.floor((F.col("first.doc_id").cast("double") - float(ends["a"])) / float(width) * (_UNIT - 1)), F.lit(0)).cast("long").alias("k_id"))
    groups = stage(groups, "groups")
    joined = split_join(rows.drop("lang", "source"), groups, "h", "n", rows.count())
    return joined.select("doc_id", "size", "text_crc32", F.coalesce("doc_id", F.lit(_LEAST)).alias("own_id"), F.pmod("h", F.lit(_UNIT)).alias("g"), F.least("size", F.lit(_UNIT - 1)).alias("k_size"), "k_lang", "k_source", "k_id")


_OWN = len(DIMS)  # stands for the id where a group of equal texts is cut


def _key() -> Column:
    """A row's place along its node's dimension ``dim``: coordinate, then group of equal texts."""
    g = lambda c: F.col(c) * F.lit(_UNIT) + F.col("g")
    out = F.when(F.col("dim") == _OWN, F.col("own_id"))
    for i, c in enumerate(DIMS):
        out = out.when(F.col("dim") == i, g(c))
    return out


def _table(rows: DataFrame, values: list[tuple], schema: str) -> DataFrame:
    """A broadcast table of a row a node, MOST_LEAVES at most, from a literal."""
    names = [c.split()[0] for c in schema.split(", ")]
    literal = F.lit(json.dumps([dict(zip(names, v, strict=True)) for v in values]))
    return F.broadcast(rows.sparkSession.range(1).select(F.explode(F.from_json(literal, f"array<struct<{schema.replace(' ', ':')}>>".replace(",:", ","))).alias("x")).select("x.*"))


def _search(rows: DataFrame, dims: dict[int, int], span: dict[int, tuple[int, int]], aim: dict[int, float], total: dict[int, int]) -> dict[int, tuple[int, int, int, int]]:
    """For each node the key up to which the bytes are nearest to the aim: (key, bytes up to it, bytes below the key, 1 if good).

    ``rows`` has a column ``node``. Histograms zoom in; each round's hold BINS rows a node at most.
    """
    found, below = {}, dict.fromkeys(aim, 0)
    far = "cast(key as decimal(20, 0)) - lo" if _OWN in dims.values() else "key - lo"  # ids may lie further apart than a long holds
    while len(found) < len(aim):
        open_ = [i for i in dims if i in aim and i not in found]
        asked = _table(rows, [(i, dims[i], *span[i], max(1, -(-(span[i][1] - span[i][0] + 1) // BINS))) for i in open_], "node long, dim int, lo long, hi long, width long")
        part = rows.join(asked, "node").select("node", "size", _key().alias("key"), "lo", "hi", "width").where("key >= lo and key <= hi")
        seen: dict[int, list] = {i: [] for i in open_}
        for r in part.groupBy("node", F.expr(f"({far}) div width").alias("bin")).agg(F.sum("size").alias("w"), F.min("key").alias("a"), F.max("key").alias("z")).collect():
            seen[r.node].append(r)
        for i in open_:
            done, last = below[i], None
            for r in sorted(seen[i], key=lambda r: r.bin):
                over, under = done + r.w - aim[i], aim[i] - done
                if over < 0:
                    done, last = done + r.w, r.z
                    continue
                if over <= TOLERANCE * total[i]:
                    found[i] = (r.z, done + r.w, done, 1)
                elif under <= TOLERANCE * total[i] and last is not None:
                    found[i] = (last, done, done, 1)
                elif r.a == r.z:
                    found[i] = (r.z, done + r.w, done, 0)
                else:
                    span[i], below[i] = (r.a, r.z), done
                break
            else:
                found[i] = (last if last is not None else span[i][1], done, done, 1)
    return found


def tree(units: DataFrame, first: int, shards: int, most: int = MOST_LEAVES) -> DataFrame:
    """``units`` with the shard of each row, from ``first`` on (written anew a level)."""
    per_leaf = -(-shards // most)  # shards that a leaf of this tree stands for at most
    leaves, nodes = {}, {1: (first, shards)}
    units = units.withColumn("node", F.lit(1).cast("long"))
    whole = units.agg(*(F.coalesce(f(d), F.lit(0)).alias(f"{n}{i}") for i, d in enumerate(DIMS) for n, f in (("a", F.min), ("z", F.max)))).first()
    while nodes:
        leaves |= {i: x for i, x in nodes.items() if x[1] <= per_leaf}
        nodes = {i: x for i, x in nodes.items() if x[1] > per_leaf}
        if not nodes:
            break
        rows = units.join(_table(units, [(i,) for i in nodes], "node long"), "node")
        facts = {r.node: r for r in rows.groupBy("node").agg(F.sum("size").alias("w"), *(f(d).alias(f"{n}{i}") for i, d in enumerate(DIMS) for n, f in (("a", F.min), ("z", F.max)))).collect()}
        dim, span, aim = {}, {}, {}
        for i, r in facts.items():
            dim[i] = max(range(len(DIMS)), key=lambda d: (r[f"z{d}"] - r[f"a{d}"]) / max(1, whole[f"z{d}"] - whole[f"a{d}"]))
            span[i] = (r[f"a{dim[i]}"] * _UNIT, r[f"z{dim[i]}"] * _UNIT + _UNIT - 1)
            aim[i] = r.w * (nodes[i][1] // 2) / nodes[i][1]
        total = {i: r.w for i, r in facts.items()}
        cuts, again = {i: Cut(0, 0, 0) for i in nodes}, {}  # nodes without rows keep an empty cut
        for i, (key, upto, under, good) in _search(rows, dim, span, dict(aim), total).items():
            cuts[i] = Cut(dim[i], key, (1 << 63) - 1)
            near = min(upto - aim[i], aim[i] - under)
            if not good and near > GROUP_TOLERANCE * total[i]:
                again[i] = aim[i] - under  # one group of equal texts holds too much: cut it by id
            elif not good and aim[i] - under < upto - aim[i]:
                cuts[i].key = key - 1
        if again:
            inner = rows.join(_table(rows, [(i, dim[i], cuts[i].key) for i in again], "node long, dim int, hot long"), "node").where(_key() == F.col("hot")).drop("dim", "hot")
            ends = {r.node: (r.a, r.z) for r in inner.groupBy("node").agg(F.min("own_id").alias("a"), F.max("own_id").alias("z")).collect()}
            for i, (last, *_) in _search(inner, dict.fromkeys(again, _OWN), ends, again, total).items():
                cuts[i].last_id = last
        # the children of i are 2 i and 2 i + 1
        cut = _table(units, [(i, c.dim, c.key, c.last_id) for i, c in cuts.items()], "node long, dim int, cut long, last_id long")
        left = (_key() < F.col("cut")) | ((_key() == F.col("cut")) & (F.col("own_id") <= F.col("last_id")))
        child = F.when(F.col("cut").isNull(), F.col("node")).when(left, 2 * F.col("node")).otherwise(2 * F.col("node") + 1)
        units = stage(units.join(cut, "node", "left").withColumn("node", child).select(units.columns), "level")
        nodes = {c: x for i, (f, m) in nodes.items() for c, x in ((2 * i, (f, m // 2)), (2 * i + 1, (f + m // 2, m - m // 2)))}
    named = _table(units, [(i, f) for i, (f, _) in leaves.items()], "node long, shard int")
    if per_leaf == 1:
        return units.join(named, "node").drop("node")
    path = f"{shared_dir(units.sparkSession)}/landloom/{uuid.uuid4().hex}/leaves"
    units.write.partitionBy("node").parquet(path)  # a folder a leaf, so that each is read alone
    parts = units.sparkSession.read.schema(units.schema).parquet(path)
    to = f"{shared_dir(units.sparkSession)}/landloom/{uuid.uuid4().hex}/sharded"
    for i, (f, m) in leaves.items():
        tree(parts.where(F.col("node") == i).drop("node"), f, m, most).write.mode("append").parquet(to)
    schema = ", ".join(f"{c.name} {c.dataType.simpleString()}" for c in units.schema if c.name != "node") + ", shard int"
    return units.sparkSession.read.schema(schema).parquet(to)


def shard(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, leaves: int = MOST_LEAVES) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row: ``shards`` leaves, or as many as bring them to ``target_bytes``."""
    units = stage(_units(stage(_meta(docs), "meta")), "units")
    facts = units.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("w"), F.count("*").alias("n")).first()
    shards = shards or max(1, -(-facts["w"] // (target_bytes or 256 << 20)))
    dealt = stage(tree(units, 0, shards, leaves).select("doc_id", "size", "text_crc32", "shard", "own_id"), "dealt")
    # slots: each shard is numbered in blocks by a hash, so that no task holds a whole shard
    blocks = max(64, -(-facts["n"] // (shards * SLOT_ROWS)))
    keyed = dealt.withColumn("block", F.pmod(F.xxhash64("own_id", "text_crc32"), F.lit(blocks)))
    before = keyed.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = before.select("shard", "block", (F.sum("n").over(W.partitionBy("shard").orderBy("block")) - F.col("n")).alias("before"))
    numbered = keyed.withColumn("at", F.row_number().over(W.partitionBy("shard", "block").orderBy("own_id", "text_crc32")) - 1)
    return numbered.join(before, ["shard", "block"]).select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("at")).cast("long").alias("slot"))
