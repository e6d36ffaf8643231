"""Checks of an installation. They read; nothing is written, and a check that breaks is an item of the report."""

from __future__ import annotations

import os
import platform
import sys
from collections.abc import Callable
from dataclasses import dataclass

import pyspark
from pyspark.sql import SparkSession

import engram
from engram.config import Settings
from engram.errors import EngramError
from engram.functions.embedding import Embedder, check_output
from engram.functions.text import tokenize
from engram.operators import constraints
from engram.sources.store import Store

OK, WARN, FAIL = "ok", "warn", "fail"


@dataclass(frozen=True)
class Item:
    name: str
    state: str
    said: str


def _platform(spark: SparkSession) -> tuple[str, str]:
    java = spark.sparkContext._jvm.java.lang.System.getProperty("java.version")
    known = sys.version_info >= (3, 11) and int(pyspark.__version__.split(".")[0]) >= 4
    return OK if known else WARN, f"{platform.system()} {platform.machine()}, Python {platform.python_version()}, Java {java}, Spark {pyspark.__version__}"


def _paths(settings: Settings) -> tuple[str, str]:
    given = [n for n in ("BRAIN_ID", "BRAIN_DATA_DIR", "TIMELINE_TIMEZONE") if os.environ.get(n)]
    return OK, f"store {settings.store}, brain {settings.brain_id}, zone {settings.tz}" + (f"; set: {', '.join(given)}" if given else "")


def _package() -> tuple[str, str]:
    return OK, f"at {os.path.dirname(engram.__file__)}"


def _model(embedder: Embedder) -> tuple[str, str]:
    check_output(embedder(["a probe"]), embedder.dimension)
    return OK, f"{type(embedder).__name__}, {embedder.dimension} dimensions"


def _database(spark: SparkSession, settings: Settings, dimension: int) -> tuple[str, str]:
    store = Store(spark, settings.store, read_only=True)
    rows = store.memories()
    facts = constraints.integrity(rows, store.table("profiles")).first().asDict()
    broken = [r["rule"] for r in constraints.counted(rows, constraints.memory_rules(dimension)).collect()]
    broken += [r["rule"] for r in constraints.counted(store.table("audit"), constraints.audit_rules()).collect()]
    broken += [r["rule"] for r in constraints.counted(store.imports(), constraints.import_run_rules()).collect()]
    bad = bool(broken or facts["orphans"] or facts["profiles"] > 1 or not constraints.duplicates(rows).isEmpty())
    return FAIL if bad else OK, f"{facts['memories']} memories, {facts['orphans']} without a profile, {facts['without_vector']} without a vector, broken rules: {', '.join(sorted(broken)) or 'none'}"


def _probe(spark: SparkSession) -> tuple[str, str]:
    """The session's tokenizer and Python workers give what the driver's do."""
    from pyspark.sql import functions as F

    from engram.functions.text import tokens, tokens_any_script

    text = "Probe: été 42"
    row = spark.createDataFrame([(text,)], "t string").select(tokens(F.col("t")).alias("a"), tokens_any_script(F.col("t")).alias("b")).first()
    same = list(row["a"]) == list(row["b"]) == tokenize(text)
    return OK if same else FAIL, "workers answer" if same else f"tokens differ: {row}"


def examine(spark: SparkSession, settings: Settings, embedder: Embedder) -> list[Item]:
    """An item for each of platform, paths, package, model, database and probe, in this order."""
    checks: dict[str, Callable[[], tuple[str, str]]] = {
        "platform": lambda: _platform(spark),
        "paths": lambda: _paths(settings),
        "package": _package,
        "model": lambda: _model(embedder),
        "database": lambda: _database(spark, settings, embedder.dimension),
        "probe": lambda: _probe(spark),
    }
    out = []
    for name, check in checks.items():
        try:
            out.append(Item(name, *check()))
        except EngramError as e:
            missing = name == "database" and "no store" in str(e)
            out.append(Item(name, WARN if missing else FAIL, str(e)))
        except Exception as e:  # a report is wanted whatever breaks
            out.append(Item(name, FAIL, f"{type(e).__name__}: {e}"))
    return out
