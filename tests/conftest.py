import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from callgrove.session import build_session  # noqa: E402
from callgrove.sources.graph import Graph  # noqa: E402

NODES = [
    ("r:1", "route", "GET /api/u", "GET /api/u", "Controller.java", 10, 10),
    ("m:entry", "method", "listUsers", "pkg::C::m", "Controller.java", 10, 30),
    ("m:1", "method", "findAll", "pkg::S::m", "Service.java", 5, 25),
    ("m:2", "method", "executeQuery", "pkg::Dao::executeQuery", "Dao.java", 1, 15),
    ("m:3", "method", "RuntimeExec", "pkg::Util::RuntimeExec", "Util.java", 1, 10),
    ("c:1", "class", "Controller", "pkg::Controller", "Controller.java", 1, 40),
    ("c:2", "class", "Service", "pkg::Service", "Service.java", 1, 30),
    ("f:1", "field", "mapper", "pkg::Service::mapper", "Service.java", 3, 3),
]
EDGES = [
    ("m:entry", "m:1", "calls", 15), ("m:1", "m:2", "calls", 12), ("c:1", "m:entry", "contains", None),
    ("c:2", "m:1", "contains", None), ("m:1", "m:1", "calls", 20), ("m:2", "m:3", "calls", 5),
]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "6g",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints"))})
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def graph(spark):
    nodes = spark.createDataFrame(
        [(*n, ["@GetMapping"] if n[0] == "m:entry" else None) for n in NODES],
        "id string, kind string, name string, qualified_name string, file_path string, start_line int, end_line int, decorators array<string>")
    edges = spark.createDataFrame(EDGES, "source string, target string, kind string, line int")
    files = spark.createDataFrame([(f, "java", 10) for f in sorted({n[4] for n in NODES})], "path string, language string, size long")
    return Graph(nodes, edges, files)


@pytest.fixture(scope="session")
def ids(spark):
    return lambda *names: spark.createDataFrame([(n,) for n in names], "id string")
