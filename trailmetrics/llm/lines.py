"""Line dedup over levelled sorted runs of line hashes, in DataFrame functions alone.

A line's key is the line without blanks at its ends and with A-Z in lower case; keys of at least ``LEAST_CHARS`` code points
count. Keys found in at least ``LEAST_DOCS`` documents lose their lines everywhere but in the largest id.

``LineRuns`` keeps what is known of keys as runs: tables bucketed and sorted by 128 bits of a key's hash, with the number of
documents and the largest id that hold it. A batch of documents becomes one row per key. It is merge-anti-joined with every
run: keys that a run knows to be in enough documents already are decided, and not stored again; the others become a run of
their own on level 0. ``FAN_IN`` runs of one level are merged to one of the next, which adds up their counts. Batches and
runs share one bucketing, so a run is shuffled when it is merged and never when it is joined. A manifest per version names the
runs, so that a later job can open them and go on; of two jobs that add at once, one fails. ``dedup_lines`` adds the documents in descending
order of id, so a key's first batch has its largest id, and batches after it only decide how often it is there.

Keys in a share of ``1 / HOT_KEYS`` of a batch's lines are stored each time, so they are known as hot: at most ``HOT_KEYS``
a batch. These are joined to the lines as a broadcast of that bound, all others by a shuffle in which none of them weighs. A line in a
third of all documents so reaches no task as a group: it is one row per task and batch when counted, and none is shuffled to be dropped.

Defined results: a null or empty text is one empty line, which is never dropped; rows that share an id count as one document, those
without an id as one before all others, and each row gives a row; a line that a document repeats goes or stays everywhere in
it; a document whose lines all go has an empty text; an empty table gives no rows. Texts of any length are cut as a whole, with work
in proportion to their length. Other columns may have any name.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmetrics.llm.common import LOWER, UPPER, free_names, let, table
from trailmetrics.session import materialise, scratch_path

LEAST_CHARS = 20
LEAST_DOCS = 3
BATCHES = 6
FAN_IN = 3
HOT_KEYS = 10_000
#: Fixed value: what is stripped at both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"
KEY = ["key_a", "key_b"]


def line_key(line: Column) -> Column:
    stripped = F.btrim(line, F.lit(BLANKS))
    ascii_only = F.octet_length(stripped) == F.char_length(stripped)
    return F.when(ascii_only, F.lower(stripped)).otherwise(F.translate(stripped, UPPER, LOWER))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def key_hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("key_a"), F.xxhash64(F.lit(1), key).alias("key_b")]


def sightings(lines: DataFrame, id_col: str) -> DataFrame:
    """One row per key: ``key_a, key_b, n_docs, last``. Partial counts come before each shuffle."""
    documents = F.count_distinct(id_col) + F.max(F.col(id_col).isNull().cast("long"))
    return lines.groupBy(*KEY).agg(documents.alias("n_docs"), F.max(id_col).alias("last"))


@dataclass(frozen=True)
class Run:
    level: int
    name: str
    buckets: int
    columns: str


_MANIFEST = "level int, name string, buckets int, columns string"


class LineRuns:
    """Levelled sorted runs of line hashes below one folder."""

    def __init__(self, spark: SparkSession, folder: str, fan_in: int = FAN_IN, buckets: int | None = None):
        self.spark, self.folder, self.fan_in = spark, folder, fan_in
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.version, self.runs = 0, []

    @classmethod
    def open(cls, spark: SparkSession, folder: str, fan_in: int = FAN_IN) -> LineRuns:
        """The runs as the newest manifest names them."""
        manifests = spark.read.schema(f"{_MANIFEST}, version int").json(f"{folder}/manifest")
        newest = manifests.where(F.col("version") == manifests.agg(F.max("version")).first()[0]).collect()
        opened = cls(spark, folder, fan_in, newest[0].buckets)
        opened.version = newest[0].version
        opened.runs = [Run(row.level, row.name, row.buckets, row.columns) for row in newest]
        return opened

    def read(self, run: Run) -> DataFrame:
        """A run as a table that Spark knows to be bucketed and sorted."""
        if not self.spark.catalog.tableExists(run.name):
            path = f"{self.folder}/{run.name}"
            self.spark.sql(
                f"CREATE TABLE {run.name} ({run.columns}) USING parquet CLUSTERED BY ({', '.join(KEY)})"
                f" SORTED BY ({', '.join(KEY)}) INTO {run.buckets} BUCKETS LOCATION '{path}'"
            )
        return self.spark.table(run.name)

    def _write(self, rows: DataFrame, level: int) -> Run:
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
        run = Run(level, f"line_run_{uuid.uuid4().hex}", self.buckets, columns)
        (
            rows.write.format("parquet").bucketBy(run.buckets, *KEY).sortBy(*KEY)
            .option("path", f"{self.folder}/{run.name}").saveAsTable(run.name)
        )
        return run

    def _merged(self, runs: list[Run]) -> DataFrame:
        """Read as plain files: Spark 4.1 plans a union of bucketed scans as if it were bucketed, which it is not."""
        rows = reduce(DataFrame.unionAll, [self.spark.read.schema(run.columns).parquet(f"{self.folder}/{run.name}") for run in runs])
        return rows.groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("last").alias("last"))

    def undecided(self, batch: DataFrame, least_docs: int, hot: int) -> DataFrame:
        """The batch's keys that no run knows to be in enough documents, and those in ``hot`` or more of its own."""
        for run in self.runs:
            known = self.read(run).where(F.col("n_docs") >= least_docs).select(*KEY).hint("merge")
            same = [batch[name] == known[name] for name in KEY]
            batch = batch.join(known, [*same, batch["n_docs"] < hot], "left_anti")
        return batch

    def add(self, batch: DataFrame, least_docs: int = LEAST_DOCS, hot: int = 1 << 62) -> None:
        """Adds the sightings of one batch, whose documents are in no other, and merges full levels."""
        self.runs.append(self._write(self.undecided(batch, least_docs, hot), 0))
        for level in range(len(self.runs)):
            full = [run for run in self.runs if run.level == level]
            if len(full) < self.fan_in:
                break
            self.runs = [run for run in self.runs if run.level != level] + [self._write(self._merged(full), level + 1)]
        self.version += 1
        named = self.spark.createDataFrame([(r.level, r.name, r.buckets, r.columns) for r in self.runs], _MANIFEST)
        named.coalesce(1).write.json(f"{self.folder}/manifest/version={self.version}")

    def repeated(self, least_docs: int = LEAST_DOCS) -> DataFrame:
        """``key_a, key_b, n_docs, last`` of the keys in at least ``least_docs`` documents; of those that were decided
        early, not all documents are counted."""
        return self._merged(self.runs).where(F.col("n_docs") >= least_docs)

    def close(self) -> None:
        """Takes the runs out of the session's catalog; their files stay."""
        for run in self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {run.name}")


def _stored_lines(docs: DataFrame, id_col: str, text_col: str, least_chars: int, batches: int) -> tuple[DataFrame, int]:
    """The keys of the long enough lines, stored by batch: ``doc, text_hash, position, key_a, key_b, batch``."""
    spark, path = docs.sparkSession, scratch_path(docs.sparkSession, "lines")
    shares = [i / batches for i in range(batches - 1, 0, -1)]
    cuts = sorted(set(docs.agg(F.percentile_approx(id_col, shares, 10_000)).first()[0] or []), reverse=True)
    below = [F.coalesce(F.col("doc") < cut, F.lit(True)).cast("int") for cut in cuts]
    rows = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    lines = rows.select("doc", F.xxhash64("text").alias("text_hash"), F.posexplode_outer(lines_of(F.col("text"))).alias("position", "line"))
    keys = lines.withColumn("key", line_key(F.col("line"))).where(F.char_length("key") >= least_chars)
    keys = keys.select("doc", "text_hash", "position", *key_hashes(F.col("key")), reduce(Column.__add__, below, F.lit(0)).alias("batch"))
    keys.write.partitionBy("batch").parquet(path)
    return spark.read.schema(keys.schema).parquet(path), len(cuts) + 1


def dropped_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS,
    least_docs: int = LEAST_DOCS, batches: int = BATCHES, fan_in: int = FAN_IN,
) -> DataFrame:
    """``doc, text_hash, positions``: the positions, from 0 and ascending, of the lines that go from each text."""
    spark = docs.sparkSession
    lines, n_batches = _stored_lines(docs, id_col, text_col, least_chars, batches)
    hot = max(least_docs, -(-lines.count() // HOT_KEYS))
    runs = LineRuns(spark, scratch_path(spark, "line-runs"), fan_in)
    for batch in range(n_batches):
        runs.add(sightings(lines.where(F.col("batch") == batch), "doc"), least_docs, hot)
    repeated = materialise(runs.repeated(least_docs), "repeated-lines")
    runs.close()

    is_hot = F.col("n_docs") >= hot  # at most ``HOT_KEYS`` for each batch, as each counted document is a line
    columns = ["doc", "text_hash", "position", *KEY]
    often = repeated.where(is_hot).select(*KEY, F.col("last").alias("last"), F.lit(True).alias("known"))
    marked = lines.select(*columns).join(F.broadcast(often), KEY, "left")
    found = marked.where("known").select(*columns[:3], "last").unionAll(
        marked.where("known IS NULL").select(*columns)
        .join(repeated.where(~is_hot).select(*KEY, "last"), KEY).select(*columns[:3], "last")
    )
    gone = found.where(~F.col("doc").eqNullSafe(F.col("last")))
    return gone.groupBy("doc", "text_hash").agg(F.array_sort(F.collect_set("position")).alias("positions"))


def _without(text: Column, positions: Column) -> Column:
    """The text without the lines at these ascending positions, put together from the stretches between them."""

    def kept(lines: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), F.transform(positions, lambda at: at + 1))
        ends = F.concat(positions, F.array(F.size(lines)))
        stretches = F.zip_with(starts, ends, lambda start, end: F.slice(lines, start + 1, end - start))
        return F.array_join(F.flatten(stretches), "\n")

    return let(lines_of(text), kept)


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS,
    least_docs: int = LEAST_DOCS, batches: int = BATCHES, fan_in: int = FAN_IN,
    n_lines: str = "n_lines", n_dropped: str = "n_dropped",
) -> DataFrame:
    """The documents with all their columns, the text without its repeated lines, and two counts."""
    gone = dropped_lines(docs, id_col, text_col, least_chars, least_docs, batches, fan_in)
    doc, text_hash, positions = free_names(docs.columns, "doc", "text_hash", "positions")
    gone = gone.select(F.col("doc").alias(doc), F.col("text_hash").alias(text_hash), F.col("positions").alias(positions))
    text, at = F.coalesce(F.col(text_col), F.lit("")), F.col(positions)
    same = F.col(id_col).eqNullSafe(F.col(doc)) & (F.xxhash64(text) == F.col(text_hash))
    found = docs.join(gone, same, "left")
    kept = F.when(at.isNull(), F.col(text_col)).otherwise(_without(text, at))
    others = [name for name in docs.columns if name not in (n_lines, n_dropped)]
    return found.select(
        *[kept.alias(name) if name == text_col else F.col(f"`{name}`") for name in others],
        F.size(lines_of(text)).cast("long").alias(n_lines),
        F.coalesce(F.size(at), F.lit(0)).cast("long").alias(n_dropped),
    )


def op12_levelled_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(text, 256).alias("kept_sha256"))


#: ``chr(10)`` and so on are the blanks of ``BLANKS``.
OP12_SQL = """
WITH lines AS (
    SELECT row_id, doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS position
    FROM (
        SELECT row_number() OVER () AS row_id, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
    )
), keyed AS (
    SELECT *, translate(
        trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'
    ) AS key
    FROM lines
), repeated AS (
    SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20
    GROUP BY key HAVING count(DISTINCT doc_id) + max((doc_id IS NULL)::INT) >= 3
), judged AS (
    SELECT k.*, r.key IS NOT NULL AND k.doc_id IS DISTINCT FROM r.last AS gone FROM keyed k LEFT JOIN repeated r ON k.key = r.key
)
SELECT
    doc_id,
    count(*) AS n_lines,
    count(*) FILTER (gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY position) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY row_id, doc_id
"""
