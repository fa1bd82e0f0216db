"""Tables that grow by generations: each batch adds one, readers merge them, and runs of small ones are compacted.

A generation holds the rows of the nodes that a batch has changed, and ``claims``: whose they
are. A row counts if no later generation claims its owner, so a batch of n nodes writes in proportion to n
and nothing that is stored is rewritten. A claim without rows is a deletion.

Generations are listed in a numbered manifest. A batch writes its files first and then the next number,
which only one writer can create, so a batch that fails leaves files that nobody lists. Compaction merges
the latest generations until each is at least twice as large as all after it together:
there are never more than about log2 of all nodes, and a row is rewritten as often.

Corpus statistics are sums of what each generation adds and takes away, by term and in all;
opening an index reads these and no postings.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.blocks import searchable_text
from graphloom.functions.text import embed_input, stripped, tokens
from graphloom.operators.graph import derive_edges
from graphloom.operators.search import Index, embed, postings
from graphloom.session import reach_workers, written

#: Tables with an ``owner``; nodes, edges, vectors and postings are what readers see.
TABLES = ("nodes", "edges", "vectors", "postings")
OWNED = (*TABLES, "forward")
#: How much larger than all later ones together a generation must be to stay as it is.
FACTOR = 2


class Manifest:
    """The numbered lists of generations below a folder."""

    def __init__(self, spark: SparkSession, target: str):
        self.spark, self.target = spark, target
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.store = self.path(target).getFileSystem(spark._jsc.hadoopConfiguration())

    def read(self) -> tuple[int, dict]:
        """The latest number and what it lists: ``generations``, the oldest first, and the last ``batch``."""
        folder = self.path(f"{self.target}/manifest")
        numbers = sorted((int(f.getPath().getName()) for f in self.store.listStatus(folder)), reverse=True) if self.store.exists(folder) else []
        for n in numbers:
            stream = self.store.open(self.path(f"{self.target}/manifest/{n:012}"))
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
            if text.endswith("\n"):  # a writer that was cut off has not ended its line
                return n, json.loads(text)
        return 0, {"generations": [], "batch": -1}

    def commit(self, number: int, listed: dict) -> None:
        """Write the manifest ``number``; an error if another writer has."""
        try:
            out = self.store.create(self.path(f"{self.target}/manifest/{number:012}"), False)
        except Py4JJavaError as e:
            raise RuntimeError(f"another writer has changed {self.target}") from e
        out.write(bytearray((json.dumps(listed) + "\n").encode()))
        out.close()

    def vacuum(self, keep: int = 2) -> None:
        """Delete generations and manifests that the last ``keep`` manifests do not need; no writer may be at work."""
        last, _ = self.read()
        named: set[str] = set()
        for n in range(max(1, last - keep + 1), last + 1):
            file = self.path(f"{self.target}/manifest/{n:012}")
            if self.store.exists(file):
                named |= {g["name"] for g in self.spark.read.json(file.toString()).select(F.explode("generations").alias("g")).select("g.*").collect()}
        for f in self.store.listStatus(self.path(self.target)):
            name = f.getPath().getName()
            if name.startswith("generation-") and name not in named:
                self.store.delete(f.getPath(), True)
        for f in self.store.listStatus(self.path(f"{self.target}/manifest")):
            if int(f.getPath().getName()) <= last - keep:
                self.store.delete(f.getPath(), False)


def _read(spark: SparkSession, target: str, generation: dict, table: str) -> DataFrame:
    return spark.read.parquet(f"{target}/{generation['name']}/{table}")


def _live(spark: SparkSession, target: str, generations: list[dict], table: str) -> DataFrame:
    """Rows of a table that count, with ``owner``: of each generation those that no later one claims.

    What later generations claim is small beside a large generation, so that Spark can broadcast it.
    A vector stays until its owner has another or is deleted.
    """
    parts, later = [], None
    for g in reversed(generations):
        rows = _read(spark, target, g, table)
        parts.append(rows if later is None else rows.join(later, "owner", "left_anti"))
        claims = _read(spark, target, g, "claims")
        own = claims.where("gone").select("owner").unionByName(rows.select("owner")) if table == "vectors" else claims.select("owner")
        later = own if later is None else later.unionByName(own)
    return reduce(DataFrame.unionByName, parts)


def _written(tables: dict[str, DataFrame], target: str, batch: int | None) -> dict:
    """Write the tables of a new generation and give its entry."""
    name = f"generation-{uuid.uuid4().hex}"
    for table, rows in tables.items():
        # sorted by what they are looked up by, so that scans skip the rest
        by = {"postings": ["term", "id"], "terms": ["term"], "stats": []}.get(table, ["owner"])
        (rows.repartitionByRange(*by).sortWithinPartitions(*by) if by else rows.coalesce(1)).write.parquet(f"{target}/{name}/{table}")
    size = next(iter(tables.values())).sparkSession.read.parquet(f"{target}/{name}/claims").count()
    return {"name": name, "size": size, "batch": batch}


def _statistics(new: DataFrame, old: DataFrame) -> dict[str, DataFrame]:
    """What a generation adds to the statistics: ``terms`` (term, df) and ``stats`` (n_nodes, length), either of which may be negative."""
    both = new.select("dl", "terms", F.lit(1).cast("long").alias("sign")).unionByName(old.select("dl", "terms", F.lit(-1).cast("long").alias("sign")))
    terms = both.select(F.explode("terms").alias("term"), "sign").groupBy("term").agg(F.sum("sign").alias("df")).where("df <> 0")
    stats = both.agg(F.coalesce(F.sum("sign"), F.lit(0)).alias("n_nodes"), F.coalesce(F.sum(F.col("sign") * F.col("dl")), F.lit(0)).alias("length"))
    return {"terms": terms, "stats": stats}


def _held(spark: SparkSession, target: str, generations: list[dict], ids: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """``(id, held_at)`` of the last claims on these ids, and the forward rows of those among them that are there."""
    if not generations:
        return None
    claims = reduce(DataFrame.unionByName, (_read(spark, target, g, "claims").withColumn("g", F.lit(k)) for k, g in enumerate(generations)))
    last = claims.join(ids.select(F.col("id").alias("owner")), "owner", "left_semi").groupBy("owner").agg(F.max_by("at", "g").alias("held_at"))
    forward = _live(spark, target, generations, "forward").join(ids.select(F.col("id").alias("owner")), "owner", "left_semi")
    return last.select(F.col("owner").alias("id"), "held_at"), forward


def _apply(spark: SparkSession, target: str, make: Callable[[list[dict]], dict[str, DataFrame] | None], batch: int | None, compacts: bool) -> None:
    manifest = Manifest(spark, target)
    number, listed = manifest.read()
    if batch is not None and batch <= listed["batch"]:
        return  # a batch that was repeated after it had been committed
    tables = make(listed["generations"])
    if tables is None:
        return
    added = _written(tables, target, batch)
    generations = [*listed["generations"], added]
    manifest.commit(number + 1, {"generations": generations, "batch": listed["batch"] if batch is None else batch})
    if compacts:
        compact(spark, target)


def update_tables(changed: DataFrame, target: str, embedder: Callable[[DataFrame], DataFrame] = embed, batch: int | None = None, compacts: bool = True) -> None:
    """Put changed nodes, one row per id, into the tables below ``target`` as a new generation.

    A row older than the stored one, or than a deletion, changes nothing. Edges and postings of a node are those
    of its new record only; a node whose new text is blank keeps its vector. A ``batch`` with a number that was
    applied before is left out; without one, the same rows again leave the same tables.
    """
    spark = changed.sparkSession
    reach_workers(spark)
    changed = written(changed.withColumn("raw", F.col("body_md")).withColumn("body_md", searchable_text(F.col("raw"))), "changed")

    def make(generations: list[dict]) -> dict[str, DataFrame] | None:
        rows, held = changed, _held(spark, target, generations, changed)
        if held is not None:
            rows = written(rows.join(held[0], "id", "left").where("held_at is null or updated_at_utc >= held_at").select(*changed.columns), "winning")
        if rows.isEmpty():
            return None
        owner = F.col("id").alias("owner")
        text = embed_input(F.col("title"), F.col("body_md"))
        guided = F.when(F.col("predicate") == "style-guides", F.col("dst_id")).otherwise(F.col("src_id"))
        words = tokens(F.concat_ws(" ", "title", "body_md"))
        forward = written(rows.select(owner, F.size(words).cast("long").alias("dl"), F.array_distinct(words).alias("terms")), "forward")
        old = forward.limit(0) if held is None else held[1].join(rows.select(owner), "owner", "left_semi")
        return {
            "claims": rows.select(owner, F.col("updated_at_utc").alias("at"), F.lit(False).alias("gone")),
            "nodes": rows.select(owner, "*"), "edges": derive_edges(rows).select(guided.alias("owner"), "*"),
            "vectors": embedder(rows.select("id", text.alias("text")).where(stripped(F.col("text")) != "")).select(owner, "id", "embedding"),
            "postings": postings(rows).select(owner, "*"), "forward": forward, **_statistics(forward, old),
        }

    _apply(spark, target, make, batch, compacts)


def delete_from_tables(ids: DataFrame, target: str, at: str, compacts: bool = True) -> None:
    """Take nodes ``(id)`` out with their own edges, vectors and postings; records older than ``at`` do not bring them back."""
    spark = ids.sparkSession

    def make(generations: list[dict]) -> dict[str, DataFrame] | None:
        held = _held(spark, target, generations, ids)
        if held is None:
            return None
        gone = ids.where("id is not null").select("id").distinct().join(held[0], "id", "left").where(F.col("held_at").isNull() | (F.col("held_at") <= at))
        gone = written(gone.select(F.col("id").alias("owner")), "gone")
        if gone.isEmpty():
            return None
        old = held[1].join(gone, "owner", "left_semi")
        nothing = {t: _read(spark, target, generations[-1], t).limit(0) for t in OWNED}
        return {"claims": gone.select("owner", F.lit(at).alias("at"), F.lit(True).alias("gone")), **nothing, **_statistics(old.limit(0), old)}

    _apply(spark, target, make, None, compacts)


def run_to_merge(sizes: list[int]) -> int | None:
    """Where the latest generations begin that are to be one, or None."""
    first, total = len(sizes) - 1, sum(sizes[-1:])
    while first > 0 and sizes[first - 1] < FACTOR * total:
        first -= 1
        total += sizes[first]
    return first if first < len(sizes) - 1 else None


def compact(spark: SparkSession, target: str, everything: bool = False) -> None:
    """Merge the latest generations where they are many for their size, or all; what readers see stays the same."""
    manifest = Manifest(spark, target)
    number, listed = manifest.read()
    generations = listed["generations"]
    first = (0 if len(generations) > 1 else None) if everything else run_to_merge([g["size"] for g in generations])
    if first is None:
        return
    run = generations[first:]
    claims = reduce(DataFrame.unionByName, (_read(spark, target, g, "claims").withColumn("g", F.lit(k)) for k, g in enumerate(run)))
    last = claims.groupBy("owner").agg(F.max_by(F.struct("at", "gone"), "g").alias("c")).select("owner", "c.at", "c.gone")
    summed = lambda t: reduce(DataFrame.unionByName, (_read(spark, target, g, t) for g in run))
    tables = {
        # a deletion is kept, also with nothing before it: it holds off older records
        "claims": last, **{t: _live(spark, target, run, t) for t in OWNED},
        "terms": summed("terms").groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0"), "stats": summed("stats").agg(F.sum("n_nodes").alias("n_nodes"), F.sum("length").alias("length")),
    }
    merged = _written(tables, target, run[-1]["batch"])
    manifest.commit(number + 1, {"generations": [*generations[:first], merged], "batch": listed["batch"]})


def open_tables(spark: SparkSession, target: str) -> dict[str, DataFrame]:
    """Nodes, edges, vectors and postings as the manifest lists them now; a later batch does not change what was opened."""
    generations = Manifest(spark, target).read()[1]["generations"]
    tables = {t: _live(spark, target, generations, t).drop("owner") for t in TABLES}
    return tables | {"edges": tables["edges"].distinct()}


def open_incremental_index(spark: SparkSession, target: str) -> Index:
    """The lexical index over these tables; its statistics are sums over generations."""
    generations = Manifest(spark, target).read()[1]["generations"]
    summed = lambda t: reduce(DataFrame.unionByName, (_read(spark, target, g, t) for g in generations))
    terms = summed("terms").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
    stats = summed("stats").agg(F.sum("n_nodes").alias("n_nodes"), F.sum("length").alias("length"))
    return Index(_live(spark, target, generations, "postings").drop("owner"), terms, stats.select("n_nodes", (F.col("length") / F.col("n_nodes")).alias("avg_len")))
