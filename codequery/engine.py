"""The engine: versions of code bases as partitioned tables, search and graph questions over them."""

from __future__ import annotations

import hashlib
import json
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import code_graph, describe, graph, knowledge, modes, results, risk, search
from .sources import files as source_files
from .sources.units import SCHEMA as UNIT

KEYS = code_graph.KEYS
# Written out, so that a table without rows can be read, and a commit of digits stays a string.
TABLES = {
    "units": UNIT,
    "edges": "source string, target string, kind string, resolution string, line int, ord struct<p:array<string>,u:int,s:int>",
    "unresolved": "unit_id string, name string, line int, reason string",
    "external": "path string, spec string",
    "postings": "unit_id string, term string, tf long",
    "lengths": "unit_id string, dl long",
    "vectors": "unit_id string, bucket int, weight double",
    "findings": "path string, line int, rule_id string, severity string",
    "commits": "sha string, author string, message string, files array<string>",
    "kg_nodes": "id string, kind string, name string",
    "kg_edges": "source string, target string, kind string",
    "versions": "indexed_at timestamp",
}
COMMIT = re.compile(r"[\w.-]{1,80}")


def repository_id(place: str) -> str:
    """Twelve hex digits that stay the same for a folder, or for an address with or without .git."""
    remote = re.match(r"(?:https://|ssh://|git@)", place)
    key = "git:" + place.lower().removesuffix(".git") if remote else "local:" + os.path.abspath(place)
    return hashlib.sha1(key.encode()).hexdigest()[:12]


def texts_of(units: DataFrame) -> DataFrame:
    """(path, text) of file units, for code that comes as units alone; long files are clipped there."""
    return units.where("unit_type = 'file' AND source IS NOT NULL").select("path", F.col("source").alias("text"))


class Engine:
    """Tables under one root, each partitioned by repository and commit; a version is replaced as a whole."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def table(self, name: str) -> DataFrame:
        schema = f"{TABLES[name]}, repository_id string, commit_sha string"
        fs, path = self._place(name)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}") if fs.exists(path) else self.spark.createDataFrame([], schema)

    def _write(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*KEYS).parquet(f"{self.root}/{name}")

    def ingest(self, folder: str, commit: str = "worktree", commits: DataFrame | None = None) -> str:
        """Parse a folder as one version, with its history if given; gives its repository's id."""
        repo = repository_id(describe.source_of(folder))
        files = source_files.scan(self.spark, folder)
        self.load(source_files.parse(files, repo, commit), repo, commit, source_files.scannable(files), commits)
        return repo

    def load(self, units: DataFrame, repo: str, commit: str, texts: DataFrame | None = None, commits: DataFrame | None = None) -> None:
        """Write one version's units and what follows from them. Units are written first, so they are parsed once.

        texts: (path, text) of all files to scan, whole. commits: the history that risks count, in TABLES' columns.
        """
        if not COMMIT.fullmatch(commit):
            raise ValueError("a commit is up to 80 letters, digits, dots, dashes and underscores")
        self._write("units", units.withColumn("repository_id", F.lit(repo)).withColumn("commit_sha", F.lit(commit)))
        own = self.version("units", repo, commit)
        edges, missing, outside = code_graph.build(own)
        postings, lengths, vectors = modes.index_tables(own, KEYS)
        keyed = lambda rows: rows.withColumn("repository_id", F.lit(repo)).withColumn("commit_sha", F.lit(commit))
        findings = keyed(risk.scan_files(texts if texts is not None else texts_of(own)))
        past = keyed(commits if commits is not None else self.spark.createDataFrame([], TABLES["commits"]))
        stamp = self.spark.range(1).select(F.lit(repo).alias("repository_id"), F.lit(commit).alias("commit_sha"), F.current_timestamp().alias("indexed_at"))
        for name, rows in (("edges", edges), ("unresolved", missing), ("external", outside), ("postings", postings), ("lengths", lengths), ("vectors", vectors), ("findings", findings), ("commits", past), ("kg_nodes", knowledge.nodes(own)), ("kg_edges", knowledge.edges(own, edges)), ("versions", stamp)):
            self._write(name, rows)

    def version(self, name: str, repo: str, commit: str) -> DataFrame:
        """One version's rows of a table: a partition filter."""
        return self.table(name).where((F.col("repository_id") == repo) & (F.col("commit_sha") == commit))

    def _place(self, name: str, repo: str | None = None, commit: str | None = None):
        below = "" if repo is None else f"/repository_id={repo}/commit_sha={commit}"
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}{below}")
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), path

    def versions(self) -> DataFrame:
        return self.table("versions").select("repository_id", "commit_sha", "indexed_at")

    def latest(self, repo: str) -> str:
        row = self.versions().where(F.col("repository_id") == repo).agg(F.max_by("commit_sha", "indexed_at").alias("c")).first()
        if row.c is None:
            raise LookupError(f"no version of {repo}")
        return row.c

    def delete(self, repo: str, commit: str) -> None:
        """Drop one version from all tables; versions go first, so that half a deletion isn't found again."""
        for name in reversed(TABLES):
            fs, path = self._place(name, repo, commit)
            fs.delete(path, True)

    def index(self, repo: str, commit: str | None = None, language: str | None = None) -> modes.Index:
        commit = commit or self.latest(repo)
        return modes.Index(*(self.version(n, repo, commit) for n in ("units", "postings", "lengths", "vectors", "edges")), language)

    def search(self, query: str, repo: str, mode: str = "hybrid", top_k: int = 10, commit: str | None = None, language: str | None = None, folder: str | None = None, budget: modes.Budget | None = None) -> DataFrame:
        """The top_k units by rank, with excerpt, evidence, relationships and warnings.

        With a folder, only units that its files still hold count towards top_k; stale ones stay, with a warning.
        """
        if not query.strip() or mode not in modes.MODES or not 1 <= top_k <= 100:
            raise ValueError("a query, one of the modes and 1 to 100 results are needed")
        commit = commit or self.latest(repo)
        found, limit = self.index(repo, commit, language), max(search.FIRST_STAGE, top_k)
        links = self.spark.createDataFrame([], "unit_id string, links array<string>")
        if mode == "adaptive":
            told = modes.adaptive(self.spark, found, query, top_k, budget)
            rows = [(u, float(s), i, {n: r[u] for n, r in told.ranks.items() if u in r}) for i, (u, s) in enumerate(told.ranked, 1)]
            ranked = self.spark.createDataFrame(rows, "unit_id string, score double, _rank int, _ranks map<string,int>")
            links = self.spark.createDataFrame([(u, [json.dumps(x, default=str) for x in xs]) for u, xs in told.links.items()], links.schema)
        else:
            if mode == "hybrid_rerank":
                ranked = modes.reranked(self.spark, found, query, max(search.POOL, top_k), limit)
            else:
                ranked = getattr(modes, mode)(self.spark, found, query, limit)
            ranks = results.ranks_of(ranked) if mode.startswith("hybrid") else F.create_map(F.lit(mode), F.col("rank"))
            ranked = ranked.select("unit_id", "score", F.col("rank").alias("_rank"), ranks.alias("_ranks"))
        hits = found.units.join(F.broadcast(ranked), "unit_id")
        if folder:
            now = source_files.scan(self.spark, folder).select("path", F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "^\uFEFF", "").alias("text"))
            hits = modes.checked(hits, now).where("status = 'verified'")
        notes = results.unresolved_note(self.version("unresolved", repo, commit)).select("unit_id", F.to_json("note").alias("_note"))
        top = hits.orderBy("_rank").limit(top_k).join(links, "unit_id", "left").join(notes, "unit_id", "left")
        # a unit's unresolved calls are told where its relationships are
        every = F.when(F.col("links").isNull(), F.array().cast("array<string>")).otherwise(F.concat("links", F.array_compact(F.array("_note"))))
        out = results.shaped(top, F.col("_ranks"), every)
        return out.withColumn("rank", F.row_number().over(search.Window.orderBy("_rank"))).drop("_rank", "_ranks", "links", "_note")

    def warnings(self, repo: str, commit: str | None = None) -> DataFrame:
        """What of the version was not parsed."""
        return results.coverage_warnings(self.coverage(repo, commit))

    def summary(self, repo: str, commit: str | None = None) -> DataFrame:
        """One row: architecture, dependencies, risk, counts."""
        commit = commit or self.latest(repo)
        units = self.version("units", repo, commit)
        needs = describe.dependencies(units).agg(F.sort_array(F.collect_list("root")).alias("dependencies"))  # at most a hundred
        return describe.architecture(units).crossJoin(needs).crossJoin(self.risk(repo, commit)).crossJoin(self.coverage(repo, commit))

    def export(self, repo: str, limit: int = 250, commit: str | None = None) -> tuple[DataFrame, DataFrame]:
        """The first nodes of the knowledge graph and the edges among them."""
        commit = commit or self.latest(repo)
        return knowledge.exported(self.version("kg_nodes", repo, commit), self.version("kg_edges", repo, commit), limit)

    def ask_graph(self, repo: str, question: str, hops: int = 4, commit: str | None = None) -> DataFrame:
        """(id, hop) of what the nodes that a question names reach in the knowledge graph."""
        commit = commit or self.latest(repo)
        return knowledge.asked(self.version("kg_nodes", repo, commit), self.version("kg_edges", repo, commit), question, hops)

    def unit(self, repo: str, unit_id: str, commit: str | None = None) -> DataFrame:
        return self.version("units", repo, commit or self.latest(repo)).where(F.col("unit_id") == unit_id)

    def findings(self, repo: str, commit: str | None = None) -> DataFrame:
        return self.version("findings", repo, commit or self.latest(repo))

    def callers(self, repo: str, unit_id: str, commit: str | None = None) -> DataFrame:
        return self.version("edges", repo, commit or self.latest(repo)).where((F.col("kind") == "CALLS") & (F.col("target") == unit_id))

    def callees(self, repo: str, unit_id: str, commit: str | None = None) -> DataFrame:
        return self.version("edges", repo, commit or self.latest(repo)).where((F.col("kind") == "CALLS") & (F.col("source") == unit_id))

    def impact(self, repo: str, symbol: str, commit: str | None = None, reverse: bool = False, hops: int = 4) -> DataFrame:
        """(id, hop) that functions, methods and classes of a name reach; with reverse, what reaches them."""
        commit = commit or self.latest(repo)
        edges = self.version("edges", repo, commit).select("source", "target")
        edges = edges.select(F.col("target").alias("source"), F.col("source").alias("target")) if reverse else edges
        named = self.version("units", repo, commit).where(F.lower("name").contains(symbol.lower()) & F.col("unit_type").isin("function", "method", "class"))
        return graph.reach(edges, named.select(F.col("unit_id").alias("id")), hops)

    def risks(self, repo: str, commit: str | None = None) -> DataFrame:
        """Risk of each function and method, by its complexity, calls, findings and its file's history."""
        commit = commit or self.latest(repo)
        fns = self.version("units", repo, commit).where("unit_type IN ('function', 'method')").select("unit_id", "path", "qualified_name", "line_start", "line_end", "complexity", F.size("calls").alias("n_calls"))
        hit = risk.within(self.findings(repo, commit).select("path", "line"), fns, ["path"], "line", "line_start", "line_end").groupBy("s.unit_id").agg(F.count("*").alias("n_findings"))
        past = risk.history(self.version("commits", repo, commit))
        known = fns.join(hit, "unit_id", "left").join(past, "path", "left").na.fill(0, ["n_findings", "changes", "authors"])
        score, reasons = risk.function_risk(F.col("complexity"), F.col("n_calls"), F.col("changes"), F.col("authors"), F.col("n_findings"))
        return known.select("unit_id", "qualified_name", score.alias("risk"), reasons.alias("reasons"))

    def risk(self, repo: str, commit: str | None = None) -> DataFrame:
        """One row: the version's risk."""
        return risk.repository_risk(self.risks(repo, commit), self.findings(repo, commit))

    def coverage(self, repo: str, commit: str | None = None) -> DataFrame:
        return source_files.coverage(self.version("units", repo, commit or self.latest(repo)))
