"""Symbol lookups and one-hop neighbourhoods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callgrove.constants import PATTERNS, SINK_NAMES
from callgrove.sources.graph import Graph

NODE_COLUMNS = ["id", "name", "qualified_name", "file_path", "start_line"]


def resolve_entry(g: Graph, fqn: str) -> DataFrame:
    """The node of one exact qualified name; methods win over other kinds, at most one row."""
    hits = g.nodes.filter(F.col("qualified_name") == fqn)
    return hits.orderBy(F.col("kind") != "method", "id").select("id", "qualified_name").limit(1)


def resolve_entries(g: Graph, names: DataFrame) -> DataFrame:
    """Set form: one id per name, null when the name is unknown."""
    known = g.methods.groupBy("qualified_name").agg(F.min("id").alias("id"))
    return names.select(F.col("fqn").alias("qualified_name")).distinct().join(known, "qualified_name", "left")


def find_methods(g: Graph, like: str) -> DataFrame:
    """Methods whose simple name contains ``like``; ASCII case does not matter."""
    return g.methods.filter(F.col("name").ilike(f"%{like}%")).select("id", "name", "qualified_name")


def routes(g: Graph, limit: int | None = None) -> DataFrame:
    """All routes, or the first ``limit`` in source order (interactive tools show 3,000)."""
    rows = g.routes.select("id", "name", "file_path", "start_line")
    return rows if limit is None else rows.orderBy("file_path", "start_line", "id").limit(limit)


def routes_by_verb(g: Graph, verb: str) -> DataFrame:
    return (g.routes.filter(F.col("name").startswith(f"{verb.upper()} "))
            .select("id", "name", "file_path", "start_line").orderBy("name", "id"))


def _matches(words: Sequence[str], columns: Sequence[str]) -> Column:
    hit = F.lit(False)
    for word in words:
        for column in columns:
            hit = hit | F.col(column).ilike(f"%{word}%")
    return hit


def pattern_search(g: Graph, pattern: str) -> DataFrame:
    """Symbols that look like a sink of the named pattern."""
    if pattern not in PATTERNS:
        raise ValueError(f"unknown pattern {pattern!r}; known: {', '.join(PATTERNS)}")
    kind, words = PATTERNS[pattern]
    return g.of_kind(kind).filter(_matches(words, ["name", "qualified_name"])).select(*NODE_COLUMNS)


def pattern_counts(g: Graph) -> DataFrame:
    """Hits of every pattern in one pass over the nodes."""
    counts = [
        F.struct(F.lit(p).alias("pattern"),
                 F.count_if((F.col("kind") == kind) & _matches(words, ["name", "qualified_name"])).alias("hits"))
        for p, (kind, words) in PATTERNS.items()
    ]
    return g.nodes.agg(F.array(*counts).alias("c")).select(F.inline("c"))


def sink_type(name: Column) -> Column:
    """Sink class of a callee name: first matching word, null when none matches."""
    out = F
    for word, label in SINK_NAMES:
        out = out.when(name.ilike(f"%{word}%"), label)
    return out


def segment_match(df: DataFrame, cls: str) -> DataFrame:
    """Methods with ``cls`` as a whole segment of the qualified name."""
    q = F.col("qualified_name")
    return df.filter((F.col("kind") == "method") & (q.contains(f"::{cls}::") | q.endswith(f"::{cls}")))


def get_method(g: Graph, cls: str, method: str) -> DataFrame:
    return g.methods.filter(F.col("qualified_name").endswith(f"::{cls}::{method}")).select(*NODE_COLUMNS)


def skip_packages(df: DataFrame, prefixes: Sequence[str], column: str = "qualified_name") -> DataFrame:
    """Drop framework rows; the prefixes come from the preset document and fold into one predicate.  Rows without a name stay."""
    hit = F.lit(False)
    for prefix in prefixes:
        hit = hit | F.col(column).startswith(prefix)
    return df.filter(~F.coalesce(hit, F.lit(False)))


def _glob_to_regex(glob: str) -> str:
    special = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    out, i = "^", 0
    while i < len(glob):
        for token in special:
            if glob.startswith(token, i):
                out, i = out + special[token], i + len(token)
                break
        else:
            out, i = out + ("\\" + glob[i] if glob[i] in ".+()[]{}^$|\\" else glob[i]), i + 1
    return out + "$"


def files(df: DataFrame, directory: str = "", glob: str | None = None, max_depth: int | None = None,
          fmt: str = "flat") -> DataFrame:
    """File listing: flat rows, counts per folder, or one row per tree node."""
    rows = df.filter(F.col("path").startswith(directory))
    depth = F.size(F.split("path", "/"))
    if glob:
        rows = rows.filter(F.col("path").rlike(_glob_to_regex(glob)))
    if max_depth is not None:
        rows = rows.filter(depth <= max_depth)
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    if fmt == "grouped":
        return rows.groupBy(folder.alias("folder")).agg(
            F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("bytes"))
    if fmt == "tree":
        parts = F.split("path", "/")
        ups = F.transform(F.sequence(F.lit(1), depth), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
        return (rows.select(F.explode(ups).alias("node"), "size").groupBy("node")
                .agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("bytes"))
                .withColumn("level", F.size(F.split("node", "/")) - 1))
    return rows.select("path", "language", "size", depth.alias("depth"))


def node_detail(g: Graph, symbol: str, file: str | None = None, line: int | None = None) -> DataFrame:
    rows = g.nodes.filter((F.col("name") == symbol) | (F.col("qualified_name") == symbol))
    if file is not None:
        rows = rows.filter(F.col("file_path").endswith(file))
    if line is not None:
        rows = rows.filter(F.col("start_line") == line)
    return rows.select("kind", *NODE_COLUMNS)


def prefer_source(df: DataFrame, rank: Column) -> DataFrame:
    """One row per fqn, the lowest ``rank`` first: partial aggregation, no sort per key."""
    row = F.struct(*[F.col(c) for c in df.columns])
    best = df.groupBy("fqn").agg(F.min_by(row, F.struct(rank, *[F.col(c) for c in df.columns])).alias("r"))
    return best.select("r.*")


def route_methods(g: Graph) -> DataFrame:
    """Handlers: the method declared where a route is."""
    r = g.routes.select("file_path", "start_line", F.col("name").alias("route"), F.col("id").alias("route_id"))
    m = g.methods.select("file_path", "start_line", F.col("name").alias("handler"), "qualified_name",
                         F.col("id").alias("method_id"))
    return r.join(m, ["file_path", "start_line"])


def callees(g: Graph, node_id: str | None = None, limit: int | None = None) -> DataFrame:
    """Methods called, all or the first ``limit`` per caller (interactive tools show 20)."""
    return _neighbours(g, "source", "target", node_id, limit)


def callers(g: Graph, node_id: str | None = None, limit: int | None = None) -> DataFrame:
    """Methods that call, all or the first ``limit`` per method called (interactive tools show 20)."""
    return _neighbours(g, "target", "source", node_id, limit)


def _neighbours(g: Graph, here: str, there: str, node_id: str | None, limit: int | None) -> DataFrame:
    """Call partners of one node, or of every node at once; ``limit`` holds per node."""
    e = g.calls.select(F.col(here).alias("of_id"), F.col(there).alias("id"))
    if node_id is not None:
        e = e.filter(F.col("of_id") == node_id)
    rows = e.join(g.nodes.select(*NODE_COLUMNS), "id")
    if limit is None:
        return rows
    first = Window.partitionBy("of_id").orderBy("file_path", "start_line", "id")
    return rows.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= limit)


def controller_routes(g: Graph, cls: str) -> DataFrame:
    """Methods of the classes named ``*cls*`` with their route, if any."""
    c = g.classes.filter(F.col("name").contains(cls)).select(F.col("id").alias("source"), F.col("name").alias("class_name"))
    held = g.edges_of("contains").select("source", "target").join(c, "source")
    m = g.methods.select(F.col("id").alias("target"), F.col("name").alias("method"), "file_path", "start_line")
    r = g.routes.select("file_path", "start_line", F.col("name").alias("route"))
    return (held.join(m, "target").join(r, ["file_path", "start_line"], "left")
            .select("class_name", "method", "file_path", "start_line", "route"))


def trail(g: Graph, node_id: str | None = None, shown: int = 20) -> DataFrame:
    """Per method: route, numbers of callers and callees, and the first ``shown`` of each."""
    out = g.methods
    if node_id is not None:
        out = out.filter(F.col("id") == node_id)
    for here, there, label in (("target", "source", "caller"), ("source", "target", "callee")):
        e = g.calls.select(F.col(here).alias("id"), F.col(there).alias("other"))
        totals = e.groupBy("id").agg(F.count(F.lit(1)).alias(f"n_{label}s"))
        first = Window.partitionBy("id").orderBy("other")
        top = (e.distinct().withColumn("r", F.row_number().over(first)).filter(F.col("r") <= shown)
               .groupBy("id").agg(F.array_sort(F.collect_list("other")).alias(f"{label}s")))
        out = out.join(totals, "id", "left").join(top, "id", "left")
    r = (g.routes.groupBy("file_path", "start_line").agg(F.min("name").alias("route")))
    out = out.join(r, ["file_path", "start_line"], "left")
    return out.select(
        "id", "qualified_name", "route",
        *[F.coalesce(f"n_{x}s", F.lit(0)).alias(f"n_{x}s") for x in ("caller", "callee")],
        *[F.coalesce(f"{x}s", F.array().cast("array<string>")).alias(f"{x}s") for x in ("caller", "callee")])


def blast_radius(g: Graph, test_regex: str, shown: int = 5, pieces: int = 4) -> DataFrame:
    """Per called symbol: callers, whether a test calls it, and relations by kind as text.

    Relations meet their names once. A symbol's relations of a kind are dealt to ``pieces`` by name, so that no symbol is one task;
    each piece is counted and its first names are kept, then the pieces of a symbol meet.
    """
    names = g.nodes.select(F.col("id").alias("source"), F.col("name").alias("from_name"), F.col("file_path").rlike(test_regex).alias("from_test"))
    e = g.edges.filter("target IS NOT NULL").select("source", "target", "kind").join(names, "source")
    piece = ["target", "kind", "piece"]
    ranked = (e.withColumn("piece", F.pmod(F.xxhash64("from_name"), F.lit(pieces)))
              .withColumn("r", F.dense_rank().over(Window.partitionBy(*piece).orderBy("from_name"))))
    unnamed = F.col("unnamed").cast("int")  # a missing name sorts first and takes a place, but is not shown
    parts = ranked.groupBy(*piece).agg(
        F.count(F.lit(1)).alias("n"), F.bool_or((F.col("kind") == "calls") & F.col("from_test")).alias("tested"),
        F.bool_or(F.col("from_name").isNull()).alias("unnamed"), F.least(F.max("r"), F.lit(shown)).alias("kept"),
        F.array(*[F.max(F.when(F.col("r") == k, F.col("from_name"))) for k in range(1, shown + 1)]).alias("top"))
    parts = parts.withColumn("top", F.slice("top", unnamed + 1, F.col("kept") - unnamed)).repartition("target")
    # one row a piece: its list is taken by max, which needs no list of lists in memory
    tops = [F.coalesce(F.max(F.when(F.col("piece") == k, F.col("top"))), F.array().cast("array<string>")) for k in range(pieces)]
    kinds = parts.groupBy("target", "kind").agg(
        F.sum("n").alias("n"), F.bool_or("tested").alias("tested"), F.bool_or("unnamed").alias("unnamed"), F.concat(*tops).alias("top"))
    symbol = Window.partitionBy("target")
    more = F.when(F.col("n") > shown, F.concat(F.lit(" and "), (F.col("n") - shown).cast("string"), F.lit(" more"))).otherwise("")
    first = F.slice(F.sort_array("top"), F.lit(1), shown - unnamed)
    return (kinds.withColumn("n_callers", F.coalesce(F.max(F.when(F.col("kind") == "calls", F.col("n"))).over(symbol), F.lit(0)))
            .withColumn("tested", F.bool_or("tested").over(symbol)).filter("kind IS NOT NULL")
            .select("target", "kind", "n", F.concat(F.array_join(first, ", "), more).alias("relations"), "n_callers", "tested"))


def resolve_body(requests: DataFrame, nodes: DataFrame) -> DataFrame:
    """Answer each request by exact id, else by name, else by file and line."""
    n = nodes.select(F.col("id").alias("node_id"), "name", "file_path", "start_line")
    by_id = requests.join(n, requests["want_id"] == n["node_id"]).select("req_id", "node_id", F.lit(1).alias("via"))
    one = n.groupBy(F.col("name").alias("want_name")).agg(F.min("node_id").alias("node_id"))
    by_name = requests.join(one, "want_name").select("req_id", "node_id", F.lit(2).alias("via"))
    spot = n.groupBy(F.col("file_path").alias("want_file"), F.col("start_line").alias("want_line")).agg(F.min("node_id").alias("node_id"))
    by_spot = requests.join(spot, ["want_file", "want_line"]).select("req_id", "node_id", F.lit(3).alias("via"))
    found = by_id.unionByName(by_name).unionByName(by_spot).groupBy("req_id").agg(
        F.min_by(F.struct("node_id", "via"), F.struct("via", "node_id")).alias("b"))
    return requests.select("req_id").join(found, "req_id", "left").select(
        "req_id", F.col("b.node_id").alias("node_id"), F.coalesce("b.via", F.lit(0)).alias("via"))
