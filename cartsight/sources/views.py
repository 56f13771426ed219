"""Materialised views: results that are stored once, read by many queries, and rebuilt on change.

A view is known by what defines it: the analysed plan, and the name, size and time of every file that
the plan reads. Another plan or a changed, new or missing input file makes another view, so a
stored one never goes stale; it is only no longer asked for. Nothing has to be declared or
invalidated, and sessions share what they have stored in one folder.
"""

from __future__ import annotations

import contextlib
import hashlib
import io
import re
import uuid
from collections.abc import Callable, Iterator, Sequence
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartsight.sources.store import FileStore
from cartsight.sources.stored import shared_folder

# Parts of plans that do not say what they compute: code, rows held in memory, clocks and dice.
_OPAQUE = re.compile(
    r"EvalPython|AggregatePython|WindowPython|InPandas|InArrow|ScalaUDF|\bUDF\("
    r"|LocalRelation|LocalTableScan|LogicalRDD|ExistingRDD|StreamingRelation"
    r"|\b(rand|randn|uuid|shuffle|current_timestamp|current_date|now|localtimestamp)\("
)
# What else decides a result: how text becomes time and what an overflow does.
_SETTINGS = ["spark.sql.session.timeZone", "spark.sql.ansi.enabled", "spark.sql.caseSensitive"]


@contextlib.contextmanager
def _whole_plans(spark: SparkSession) -> Iterator[None]:
    """Plans print all their fields, however many there are."""
    name = "spark.sql.debug.maxToStringFields"
    before = spark.conf.get(name)
    spark.conf.set(name, 1_000_000)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def plan_text(df: DataFrame) -> tuple[str, str | None]:
    """The analysed plan, with columns numbered in the order in which they appear, and what in the
    plans does not say what it computes, if anything."""
    text = io.StringIO()
    with _whole_plans(df.sparkSession), contextlib.redirect_stdout(text):
        df.explain(mode="extended")
    parts = re.split(r"^== (.*?)(?: Logical)? Plan ==$", text.getvalue(), flags=re.MULTILINE)
    analysed = parts[parts.index("Analyzed") + 1]
    numbers: dict[str, str] = {}
    plan = re.sub(r"#(\d+)", lambda m: numbers.setdefault(m[1], f"#{len(numbers)}"), analysed)
    hidden = _OPAQUE.search(analysed + parts[parts.index("Physical") + 1])
    return plan, hidden[0] if hidden else None


def input_state(df: DataFrame) -> str:
    """A digest of the name, size and time of all files that ``df`` reads."""
    files = sorted({_as_pattern(uri) for uri in df.inputFiles()})
    if not files:
        return "none"
    state = files_state(df.sparkSession, files)
    if int(state.split()[0]) != len(files):
        raise FileNotFoundError(f"{len(files)} input files, of which {state.split()[0]} are there")
    return state


def files_state(spark: SparkSession, paths: Sequence[str]) -> str:
    """Number of files in ``paths``, and a digest of the name, size and time of each, listed by Spark.

    Each file is one row, of which only its hash is added up, so any number of them will do. No
    content is read.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths))
    seen = F.xxhash64("path", "length", F.unix_micros("modificationTime"))
    state = listed.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(seen.cast("decimal(38,0)")).alias("total"),
        F.bit_xor(F.xxhash64(seen)).alias("mixed"),
    ).first()
    return f"{state.n} {state.total} {state.mixed}"


def _as_pattern(uri: str) -> str:
    """What a reader takes to find the very file that Spark names as a URI, whatever its name holds."""
    parts = urlsplit(uri)
    path = f"{parts.scheme}://{parts.netloc}{unquote(parts.path)}" if parts.scheme else uri
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def _settings(spark: SparkSession) -> list[str]:
    return [str(spark.conf.get(name, None)) for name in _SETTINGS]


def _definition(df: DataFrame, version: str) -> str:
    """A digest of all that defines the view of ``df`` but its inputs."""
    plan, hidden = plan_text(df)
    if hidden and not version:
        raise ValueError(f"the plan does not say what {hidden!r} gives; name a version of it")
    return _digest(df.sparkSession.version, version, df.schema.json(), plan, *_settings(df.sparkSession))


def _digest(*parts: str) -> str:
    return hashlib.sha256("\0".join(parts).encode()).hexdigest()[:32]


def view_key(df: DataFrame, version: str = "") -> str:
    """The digest by which the view of ``df`` is known."""
    return _digest(_definition(df, version), input_state(df))


def _finished(spark: SparkSession, folder: str) -> str | None:
    """The first complete build below ``folder``; one that failed has no mark of success."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/*/_SUCCESS")
    marks = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    found = sorted(mark.getPath().getParent().toString() for mark in marks or [])
    return found[0] if found else None


def _built(
    spark: SparkSession,
    name: str,
    definition: str,
    state: Callable[[], str],
    build: Callable[[], DataFrame],
) -> str:
    """The folder of the view, built if there is none; once more if its inputs changed meanwhile."""
    for _ in range(3):
        before = state()
        folder = f"{shared_folder(spark)}/cartsight/views/{name}-{_digest(definition, before)}"
        found = _finished(spark, folder)
        if found is not None:
            return found
        found = f"{folder}/{uuid.uuid4().hex}"
        build().write.parquet(found)
        if state() == before:
            return found
        _delete(spark, found)
    raise RuntimeError(f"the inputs of {name} keep changing")


def view(df: DataFrame, name: str, version: str = "") -> DataFrame:
    """``df`` as read from its stored view, which is built if there is none yet.

    Two sessions that build the same view at once do not disturb each other: each writes a folder of its
    own, and later readers all take the same one. A build that fails leaves nothing that is ever read.
    ``version`` stands for what the plan does not show, such as Python code or local rows. The order
    of the rows is not kept.
    """
    spark = df.sparkSession
    definition = _definition(df, version)
    folder = _built(spark, name, definition, lambda: input_state(df), lambda: df)
    return spark.read.schema(df.schema).parquet(folder)


# Of the functions that built a view in this process: what defines it, its schema and its paths.
_KNOWN: dict[tuple, tuple[str, T.StructType, list[str]]] = {}


def store_view(store: FileStore, build: Callable[[FileStore], DataFrame], name: str, version: str = "") -> DataFrame:
    """:func:`view` of ``build(store)``, for a store of files and a function that is defined once.

    ``build`` runs only where there is no view yet, or was none in this process, so a query that
    reads a stored view neither plans nor analyses what it took to make it. The files of the tables
    that ``build`` reads are listed every time.
    """
    spark = store.spark

    def fresh() -> DataFrame:
        tables = type(store)(spark, store.folder, store.fmt)  # with files as they are now
        df = build(tables)
        paths.update(tables.paths)
        return df

    key = (spark.sparkContext.applicationId, build, type(store), store.folder, store.fmt, version, *_settings(spark))
    paths: set[str] = set()
    if key not in _KNOWN:
        df = fresh()
        _KNOWN[key] = _definition(df, version), df.schema, sorted(paths)
    definition, schema, used = _KNOWN[key]
    folder = _built(spark, name, definition, lambda: files_state(spark, used), fresh)
    return spark.read.schema(schema).parquet(folder)


def _delete(spark: SparkSession, pattern: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    for found in files.globStatus(path) or []:
        files.delete(found.getPath(), True)


def drop_views(spark: SparkSession, name: str) -> None:
    """Delete all views of that name, of whatever plan and inputs."""
    _delete(spark, f"{shared_folder(spark)}/cartsight/views/{name}-*")
