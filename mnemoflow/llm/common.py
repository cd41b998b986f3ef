"""What the operators of this subpackage share: words, scratch tables, batching by bytes."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Text that one numpy step of the Python operators handles at once; bounds their memory, not their results.
CHUNK_BYTES = 2 << 20

_own_dir: dict[str, str] = {}


#: Spark's own removal of a query's shuffle files as soon as it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one of our own only where that is unset and one machine does all."""
    if there := spark.conf.get("spark.checkpoint.dir", None):
        return there.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share: scratch tables go there")
    if "at" not in _own_dir:
        _own_dir["at"] = "file://" + tempfile.mkdtemp(prefix="mnemoflow-")
    return _own_dir["at"]


class Scratch:
    """Written tables that cut lineage: a lost executor costs a reread, not a recomputation of what came before.

    They lie in the folder all executors share.  ``drop`` removes one that nothing will read again;
    the rest goes when the Python driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/mnemoflow-{name}-{uuid.uuid4().hex}", 0
        atexit.register(self.clear)

    def cut(self, df: DataFrame, name: str = "t") -> DataFrame:
        """df as written; the shuffles that made it are removed at once, for nothing will read them again."""
        self.n += 1
        path = f"{self.root}/{self.n:02d}-{name}"
        was = self.spark.conf.get(CLEANUP)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, was)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._mnemoflow_path = path
        return out

    def _delete(self, path: str) -> None:
        jvm, sc = self.spark._jvm, self.spark.sparkContext
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self._delete(t._mnemoflow_path)

    def clear(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # noqa: BLE001  the session has ended; nothing is left to ask
            pass


def text_or_empty(text: Column | str = "text") -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def n_words(text: Column) -> Column:
    """Number of maximal runs of characters other than space and \\t to \\r."""
    t = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, SPACE))).cast("long")


def words(text: Column) -> Column:
    t = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever its case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def as_bytes(texts: pa.Array) -> list[bytes]:
    """UTF-8 of each text, null as empty."""
    return [b or b"" for b in texts.cast(pa.binary()).to_pylist()]


def runs_by_size(sizes: list[int], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive (from, to) of about limit bytes; one long text makes a run of its own."""
    lo = size = 0
    for i, n in enumerate(sizes):
        if size and size + n > limit:
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(sizes):
        yield lo, len(sizes)


def runs_by_bytes(items: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    return runs_by_size(list(map(len, items)), limit)


def byte_runs(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, list[bytes]]]:
    """(from, to, the texts' UTF-8) of runs of about limit bytes; only one run is in Python's memory at a time."""
    for lo, hi in runs_by_size(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), limit):
        yield lo, hi, as_bytes(texts.slice(lo, hi - lo))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
