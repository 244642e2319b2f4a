"""Secret scanning with an incremental blob ledger, in DataFrame functions only.

Every version of a text is addressed by its content (sha256).  The ledger is two
tables in a shared folder: ``versions`` holds (commit, path, blob) for every text
ever presented, ``findings`` one row for each (rules version, blob) ever scanned,
with its spans, in folders by rules version and blob prefix.  A scan picks one path
for each distinct blob of its input, drops the pairs that the ledger has, reads the
texts of those left and no others, runs the rules over them, appends their
findings, and then records its versions.  Findings are joined back to all paths of
a commit, or of the whole history.

The ledger's own side of the look-up is filtered by the input's blobs and prefixes,
so a small commit moves none of the ledger.  Paths join their findings with blobs
that many paths share dealt into parts.

A rule is a regular expression with a least length for one of its groups.  Spans
come from cutting a text at a rule's matches: the lengths of the pieces and of
the matches, added up, are the matches' places.  Places are code points, the end
is exclusive.  Blobs that no rule's cheap screen can match are recorded as clean
without cutting.

Defined results: null text is the empty blob; documents with the same text get
the same findings, and rows that repeat an id and a text are all returned; a null
id is a path like any other; spans that start at one place are in the order of the
rules, then by end; texts of any length are scanned whole; an empty table is a
commit without versions and gives an empty result.  Only the named columns are
read, so others may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from protolith.llm._common import crc_mod, discard, hot_keys, salted_join, table, work_path, written


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: The group that must have ``least`` characters.
    group: int = 0
    least: int = 1
    #: What a text must match for the rule to match; cheaper than the rule.
    screen: str = ""


#: Raise when a rule changes: all blobs are then scanned anew.
RULES_VERSION = 1
RULES = (
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    # A run that is too short holds no match that is long enough, so these may ask for the length themselves.
    Rule("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 1),
)
BASE = ("assign", "access", "hex")
#: Hexadecimal digits of a blob that name its folder.
PREFIX = 1
SPAN = "struct<start:int,kind:int,end:int>"


def _add(kind: int, least: int):
    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["piece"]
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + x["size"]).alias("end"))
        out = F.when((x["size"] > 0) & (x["shown"] >= least), F.array_append(acc["out"], span)).otherwise(acc["out"])
        return F.struct((start + x["size"]).alias("at"), out.alias("out"))

    return add


def spans(text: Column, rules=RULES) -> Column:
    """An array of (start, kind's place in the list, end), sorted by start, then kind."""
    found = []
    for k, r in enumerate(rules):
        whole = F.regexp_extract_all(text, F.lit(r.pattern), F.lit(0))
        shown = F.regexp_extract_all(text, F.lit(r.pattern), F.lit(r.group))
        pieces = F.transform(F.split(text, r.pattern, -1), F.char_length)
        step = F.transform(F.arrays_zip(pieces.alias("piece"), F.transform(whole, F.char_length).alias("size"), F.transform(shown, F.char_length).alias("shown")), lambda x, i: F.struct(x["piece"].alias("piece"), F.coalesce(x["size"], F.lit(0)).alias("size"), F.coalesce(x["shown"], F.lit(0)).alias("shown")))
        # running places: a fold keeps the end so far and the spans that count
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))
        hit = F.aggregate(step, start, _add(k, r.least), lambda acc: acc["out"])
        found.append(F.when(text.rlike(r.screen or r.pattern), hit).otherwise(F.array().cast(f"array<{SPAN}>")))
    return F.array_sort(F.concat(*found))


class Ledger:
    """What was presented and what was scanned so far, as two Parquet tables in a shared folder."""

    findings_schema = f"blob binary, spans array<{SPAN}>, rules int, prefix string"

    def __init__(self, spark: SparkSession, path: str | None = None, rules=RULES, version: int = RULES_VERSION, id_type: str = "long"):
        self.spark, self.rules, self.version = spark, tuple(rules), version
        self.path = path or work_path(spark, "secret-ledger")
        self.versions_schema = f"path {id_type}, blob binary, commit int"
        for name, schema, parts in (("findings", self.findings_schema, ("rules", "prefix")), ("versions", self.versions_schema, ("commit",))):
            spark.createDataFrame([], schema).write.mode("append").partitionBy(*parts).parquet(f"{self.path}/{name}")

    def entries(self) -> DataFrame:
        """(blob, spans, rules, prefix) of the blobs that were scanned with this version of the rules."""
        return self.spark.read.schema(self.findings_schema).parquet(f"{self.path}/findings").filter(F.col("rules") == self.version)

    def versions(self) -> DataFrame:
        """(path, blob, commit) of everything presented."""
        return self.spark.read.schema(self.versions_schema).parquet(f"{self.path}/versions")

    def commits(self) -> int:
        return (self.versions().agg(F.max("commit")).first()[0] or 0) + 0

    def record(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> int:
        """Scan the blobs of ``docs`` that the ledger lacks, and record its paths; returns the commit's number."""
        commit = self.commits() + 1
        text = F.coalesce(F.col(text_col), F.lit(""))
        rows = docs.select(F.col(id_col).alias("path"), F.unhex(F.sha2(text, 256)).alias("blob"), text.alias("body"))
        seen = written(rows.select("path", "blob"), "secret-versions")
        # one path for each distinct blob; a null path only where there is no other
        ones = seen.groupBy("blob").agg(F.min("path").alias("one")).withColumn("prefix", F.lower(F.hex(F.substring("blob", 1, 1))).substr(1, PREFIX))
        ones = written(ones, "secret-blobs")
        known = self.entries().select("blob", "prefix").join(ones.select("blob", "prefix"), ["blob", "prefix"], "left_semi").select("blob")
        unseen = written(ones.join(known, "blob", "left_anti"), "secret-unseen")
        bodies = rows.join(unseen.withColumnRenamed("blob", "key"), (F.col("blob") == F.col("key")) & F.col("path").eqNullSafe(F.col("one")))
        done = bodies.select("blob", spans(F.col("body"), self.rules).alias("spans"), F.lit(self.version).alias("rules"), "prefix").dropDuplicates(["blob"])
        # a task for each prefix, more where a prefix is large
        done.hint("rebalance", "prefix").write.mode("append").partitionBy("rules", "prefix").parquet(f"{self.path}/findings")
        seen.write.mode("append").parquet(f"{self.path}/versions/commit={commit}")
        discard(seen, ones, unseen)
        return commit

    def found(self, commit: int | None = None) -> DataFrame:
        """doc_id, blob, commit and spans for every path of one commit, or of all."""
        paths = self.versions()
        paths = paths if commit is None else paths.filter(F.col("commit") == commit)
        # two scans at once may both have recorded a blob
        hits = self.entries().filter(F.size("spans") > 0).select("blob", "spans").dropDuplicates(["blob"])
        hot = hot_keys(paths.groupBy(F.col("blob").alias("key")).agg(F.count(F.lit(1)).alias("n")))
        out = salted_join(paths, hits, "blob", hot, "path", "left")
        return out.select(F.col("path").alias("doc_id"), "blob", "commit", F.coalesce("spans", F.array().cast(f"array<{SPAN}>")).alias("spans"))

    def scan(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """doc_id, blob, commit and spans for every row of ``docs``, after scanning the blobs not yet in the ledger."""
        return self.found(self.record(docs, id_col, text_col))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table as a history of two commits (even and odd crc32 of the id), with the findings of all its paths."""
    docs, ledger = table(spark, sf_dir, "documents"), Ledger(spark)
    even = F.coalesce(crc_mod(F.col("doc_id"), 2) == 0, F.lit(False))
    for part in (docs.filter(even), docs.filter(~even)):
        ledger.record(part)
    kinds = F.array(*[F.lit(r.kind) for r in RULES])
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    joined = lambda c: F.concat_ws(",", F.transform(c, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])))
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    return ledger.found().select("doc_id", *[count(k).alias(f"n_{b}") for k, b in enumerate(BASE)], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
