"""Secret scans over a ledger of content-addressed blobs.

Every version of every path is addressed by the SHA-256 of its bytes. The ledger keeps three growing tables in one
folder: ``versions`` (path, blob), ``scans`` (blob, rule) and ``findings`` (blob, rule, span). A run scans only pairs
of blob and rule version that ``scans`` lacks, once for any number of copies, and joins the findings back to all
paths. A rule's version is a digest of its pattern, so a changed rule is scanned anew and the others are not.
``scans`` is written last: a run that was lost before that is simply done again.

Spans count code points, end exclusive. They come from the lengths of the matches and of what lies between them, as
running sums, so no Python is involved. Only one row of each new blob carries its text through the shuffle.
Null texts count as empty, and empty texts have no findings. Rows with equal path and text get equal findings; null
paths are kept.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize, staging_path
from .common import query, table, texts


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``, leftmost and not overlapping, whose ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def version(self) -> str:
        return hashlib.sha256(repr((self.kind, self.pattern, self.group, self.least)).encode()).hexdigest()[:16]


#: The kinds in the order in which spans of one start are listed. Where too short a match can only lie inside a longer
#: run of the same characters, the least length is part of the pattern.
RULES = (
    Rule(
        "assign",
        r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=1,
        least=12,
    ),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)


def _matches(text: Column, rule: Rule) -> Column:
    """Length of the gap before each match, of the match and of the rule's group."""
    pattern = F.lit(rule.pattern)
    lengths = [
        F.transform(F.split(text, rule.pattern, -1), F.length),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length),
    ]
    return F.arrays_zip(*(x.alias(n) for x, n in zip(lengths, ("gap", "match", "group"))))


def find_spans(blobs: DataFrame, rules=RULES) -> DataFrame:
    """``blob``, ``text``, ``wanted`` (rule versions) -> ``blob``, ``rule``, ``start``, ``end`` of the findings."""
    found = F.array(
        *(
            F.when(
                F.array_contains("wanted", r.version) & F.col("text").rlike(r.pattern),
                F.struct(F.lit(r.version).alias("rule"), F.lit(r.least).alias("least"), _matches(F.col("text"), r).alias("m")),
            )
            for r in rules
        )
    )
    # a blob comes twice if its row does, so rows have numbers
    rows = blobs.select("blob", F.monotonically_increasing_id().alias("row"), F.explode(found).alias("f"))
    rows = rows.where(F.col("f").isNotNull())
    rows = rows.select("blob", "row", "f.rule", "f.least", F.posexplode("f.m").alias("pos", "m"))
    before = W.partitionBy("blob", "row", "rule").orderBy("pos")
    end = F.sum(F.col("m.gap") + F.coalesce(F.col("m.match"), F.lit(0))).over(before)
    rows = rows.withColumn("end", end.cast("bigint"))
    rows = rows.where(F.col("m.match").isNotNull() & (F.col("m.group") >= F.col("least")))
    return rows.select("blob", "rule", (F.col("end") - F.col("m.match")).alias("start"), "end")


class Ledger:
    """The tables under ``folder``; every run adds a folder of its own to each."""

    SCHEMAS = {
        "versions": "path bigint, blob binary",
        "scans": "blob binary, rule string",
        "findings": "blob binary, rule string, start bigint, end bigint",
    }

    def __init__(self, spark: SparkSession, folder: str, rules=RULES):
        self.spark, self.folder, self.rules = spark, folder, rules

    def read(self, name: str, run: str = "*") -> DataFrame:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        there = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        if not there:
            return self.spark.createDataFrame([], self.SCHEMAS[name])
        return self.spark.read.schema(self.SCHEMAS[name]).parquet(f"{self.folder}/{name}/{run}")

    def add(self, versions: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Scan what is new in ``versions`` (path, text): their (path, blob) rows, and the findings of all blobs."""
        run = f"run={uuid.uuid4().hex}"
        addressed = versions.select(
            "path", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("blob"), "text"
        )
        addressed.select("path", "blob").write.parquet(f"{self.folder}/versions/{run}")
        wanted = F.explode(F.array(*(F.lit(r.version) for r in self.rules)))
        added = self.read("versions", run).groupBy("blob").agg(F.min("path").alias("path"))
        pairs = added.withColumn("rule", wanted).join(self.read("scans"), ["blob", "rule"], "left_anti")
        new = pairs.groupBy("blob").agg(F.first("path").alias("p"), F.collect_set("rule").alias("wanted"))
        new = new.select(F.col("blob").alias("b"), "p", "wanted").hint("shuffle_hash")
        texts_ = addressed.join(new, F.col("path").eqNullSafe(F.col("p")) & (F.col("blob") == F.col("b")))
        spans = find_spans(texts_.select("blob", "text", "wanted"), self.rules).distinct()
        spans.write.parquet(f"{self.folder}/findings/{run}")
        pairs.select("blob", "rule").write.parquet(f"{self.folder}/scans/{run}")
        versions_rules = [r.version for r in self.rules]
        return self.read("versions", run), self.read("findings").where(F.col("rule").isin(versions_rules)).distinct()


def findings_by_path(versions: DataFrame, findings: DataFrame, rules=RULES) -> DataFrame:
    """One row per version: ``path``, ``blob`` and ``found``, its spans (start, kind_no, end) in order."""
    number = F.create_map(*(x for i, r in enumerate(rules) for x in (F.lit(r.version), F.lit(i))))
    span = F.struct("start", number[F.col("rule")].alias("kind_no"), "end")
    per_blob = findings.groupBy("blob").agg(F.array_sort(F.collect_list(span)).alias("found"))
    per_blob = materialize(per_blob)  # so that a hot blob's versions can be split in the join
    empty = F.array().cast("array<struct<start:bigint,kind_no:int,end:bigint>>")
    return versions.join(per_blob, "blob", "left").select("path", "blob", F.coalesce("found", empty).alias("found"))


def scan_documents(docs: DataFrame, folder: str | None = None, rules=RULES) -> DataFrame:
    """``findings_by_path`` of ``docs`` (doc_id, text); without a folder in a new ledger of the shared folder."""
    spark = docs.sparkSession
    ledger = Ledger(spark, folder or staging_path(spark, "ledger"), rules)
    return findings_by_path(*ledger.add(texts(docs).withColumnRenamed("doc_id", "path")), rules)


def redact(docs: DataFrame, marker: str = "[SECRET]") -> DataFrame:
    """``docs`` with each span found in ``text`` replaced; overlapping spans together by one marker.

    ``n_chars``, if there, follows the text. A text that stands under several rows with one id is told apart by its bytes.
    """
    found = scan_documents(docs).where(F.size("found") > 0).dropDuplicates(["path", "blob"])
    spans = found.select("path", "blob", F.posexplode("found").alias("pos", "s"))
    by_version = W.partitionBy("path", "blob").orderBy("pos")
    reach = F.max("s.end").over(by_version.rowsBetween(W.unboundedPreceding, -1))
    spans = spans.withColumn("new", F.coalesce(F.col("s.start") >= reach, F.lit(True)).cast("int"))
    spans = spans.withColumn("block", F.sum("new").over(by_version))
    spans = spans.groupBy("path", "blob", "block").agg(F.min("s.start").alias("start"), F.max("s.end").alias("end"))
    cuts = spans.groupBy("path", "blob").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("__cuts"))
    cuts = cuts.select(F.col("path").alias("__path"), F.col("blob").alias("__blob"), "__cuts")
    blob = F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    joined = docs.join(
        cuts.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("__path")) & (blob == F.col("__blob")), "left"
    )
    pieces = F.expr(
        "transform(sequence(0, size(__cuts)), i -> substring(text, "
        "int(if(i = 0, 0, __cuts[i - 1].end)) + 1, "
        "int(if(i = size(__cuts), length(text), __cuts[i].start) - if(i = 0, 0, __cuts[i - 1].end))))"
    )
    text = F.when(F.col("__cuts").isNotNull(), F.array_join(pieces, marker)).otherwise(F.col("text"))
    joined = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.when(F.col("__cuts").isNotNull(), F.length("text")).otherwise(F.col("n_chars")))
    return joined.select(docs.columns)


def _sql(rules=RULES) -> str:
    parts = []
    for i, r in enumerate(rules):
        p = r.pattern.replace("'", "''")
        parts.append(
            f"select doc_id, {i} k, '{r.kind}' kind, string_split_regex(t, '{p}') g, "
            f"regexp_extract_all(t, '{p}', 0) m, regexp_extract_all(t, '{p}', {r.group}) q, {r.least} least from d"
        )
    return f"""
with d as (select doc_id, coalesce(text, '') t from documents),
z as ({' union all '.join(parts)}),
e as (select doc_id, k, kind, m, q, least, list_transform(g, lambda x: length(x)) gl, list_transform(m, lambda x: length(x)) ml,
  unnest(generate_series(1, len(m))) i from z where len(m) > 0),
s as (select doc_id, k, kind, cast(list_sum(gl[1:i]) + coalesce(list_sum(ml[1:i - 1]), 0) as bigint) b,
  cast(list_sum(gl[1:i]) + list_sum(ml[1:i]) as bigint) f from e where length(q[i]) >= least),
a as (select doc_id, count(*) filter (k = 0) n_assign, count(*) filter (k = 1) n_access, count(*) filter (k = 2) n_hex,
  string_agg(kind || ':' || b || ':' || f, ',' order by b, k) spans from s group by doc_id)
select d.doc_id, coalesce(n_assign, 0) n_assign, coalesce(n_access, 0) n_access, coalesce(n_hex, 0) n_hex,
  sha256(coalesce(spans, '')) base_sha256, coalesce(spans, '') spans
from d left join a on d.doc_id = a.doc_id
"""


@query("op5_secret_ledger", _sql())
def op5(spark, sf_dir):
    """Findings of the three kinds in every document, through a new ledger."""
    kinds = F.array(*(F.lit(r.kind) for r in RULES))
    found = scan_documents(table(spark, sf_dir, "documents"))
    listed = F.concat_ws(
        ",", F.transform("found", lambda s: F.concat_ws(":", F.get(kinds, s["kind_no"]), s["start"], s["end"]))
    )
    counts = [
        F.expr(f"size(filter(found, s -> s.kind_no = {i}))").cast("bigint").alias(f"n_{r.kind}")
        for i, r in enumerate(RULES)
    ]
    out = found.select(F.col("path").alias("doc_id"), *counts, listed.alias("spans"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("spans", 256).alias("base_sha256"), "spans")
