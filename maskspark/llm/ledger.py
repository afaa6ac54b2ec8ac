"""Secret scans over an incremental ledger of blobs, in DataFrame expressions alone.

Every version of every text is addressed by its SHA-256. Of the pairs (blob, rule and its version) only those that a
ledger doesn't have are scanned, each once however many paths hold the blob. A ledger is a Parquet table that only grows:
each of its rows has a blob, the keys of rules that it was scanned for, and the findings, each with its rule's key. Findings
under the keys that are current, and no others, are then joined back to all paths.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, fresh_path, materialize, unused


@dataclass(frozen=True)
class Rule:
    """Leftmost, non-overlapping matches of pattern whose group has at least least code points are findings."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}:{self.version}"


BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    # [0-9a-f]+ of 32 and more: a maximal run either way
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)
MORE_RULES = (
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("forge", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abeoprs]-[A-Za-z0-9-]{10,}"),
    Rule("bearer", r"(?i:bearer)\x20+[A-Za-z0-9._~+/-]{20,}=*"),
    Rule("url", r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,64}:([^\s/:@]{3,128})@", 1, 3),
)
RULES = BASE_RULES + MORE_RULES


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256)


#: A row of a ledger's table.
LEDGER = "blob string, scanned array<string>, findings array<struct<start: bigint, end: bigint, rule: string>>"


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, findings) of the blobs (blob, text, todo) that have any; todo: keys of the rules to scan for.

    findings: array of (start, end, rule), rule being a key; places in code points, end exclusive.
    """
    text = F.col("text")
    hits = []
    for rule in rules:
        pattern = F.lit(rule.pattern)
        gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
        sizes = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length)
        inner = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length) if rule.group else sizes
        hit = F.struct(F.lit(rule.key).alias("rule"), F.lit(rule.least).alias("least"), F.arrays_zip(gaps.alias("gap"), sizes.alias("size"), inner.alias("inner")).alias("places"))
        hits.append(F.when(F.array_contains("todo", rule.key) & text.rlike(rule.pattern), hit))
    found = blobs.select("blob", F.explode(F.array_compact(F.array(*hits))).alias("hit")).select("blob", "hit.rule", "hit.least", F.posexplode("hit.places").alias("at", "place"))
    # the last gap has no match after it
    found = found.where("place.size is not null")
    before = Window.partitionBy("blob", "rule").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = found.withColumn("end", F.sum(F.col("place.gap") + F.col("place.size")).over(before)).where("place.inner >= least")
    finding = F.struct((F.col("end") - F.col("place.size")).alias("start"), "end", "rule")
    return found.groupBy("blob").agg(F.collect_list(finding).alias("findings"))


def unseen(versions: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, text, todo): each blob of versions (blob, text) once, with the rules that the ledger doesn't have for it."""
    every = F.array(*(F.lit(r.key) for r in rules)).cast("array<string>")
    blobs = versions.groupBy("blob").agg(F.first("text").alias("text"))
    if ledger is None:
        return blobs.withColumn("todo", every)
    seen = ledger.groupBy("blob").agg(F.flatten(F.collect_list("scanned")).alias("seen"))
    todo = F.array_except(every, F.coalesce("seen", F.array().cast("array<string>")))
    return blobs.join(seen, "blob", "left").withColumn("todo", todo).where(F.size("todo") > 0).select("blob", "text", "todo")


def new_rows(docs: DataFrame, ledger: DataFrame | None = None, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows that a ledger lacks for the versions in docs: one for each blob with rules that it wasn't scanned for."""
    versions = docs.select(blob_of(F.col(text)).alias("blob"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    todo = unseen(versions, ledger, rules)
    # blob by blob in one pass: what was to be scanned, and what was found
    found = scan_blobs(todo, rules).select("blob", F.array().cast("array<string>").alias("scanned"), "findings")
    none = F.array().cast(found.schema["findings"].dataType)
    return todo.select("blob", F.col("todo").alias("scanned"), none.alias("findings")).unionByName(found)


def extend_ledger(docs: DataFrame, path: str, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scans what the ledger in the folder path lacks for the versions in docs, appends it, and returns the whole ledger.

    A missing or empty folder is an empty ledger. A run that is cut off before its append has been committed leaves the ledger
    as it was; a row that is appended twice changes nothing.
    """
    spark = docs.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    known = spark.read.schema(LEDGER).parquet(path) if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) else None
    new_rows(docs, known, text, rules).write.mode("append").parquet(path)
    return spark.read.schema(LEDGER).parquet(path)


def current(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, findings) of the ledger's blobs with findings of these rules' versions.

    findings: array of (start, rank, kind, end) by start, then by the rules' order. Whatever the ledger has of other versions
    or in other orders, and rows that it has twice, make no difference.
    """
    ranks = {r.key: i for i, r in enumerate(rules)}
    rank = F.element_at(F.create_map(*(F.lit(x) for pair in ranks.items() for x in pair)), F.col("x.rule"))
    kind = F.element_at(F.array(*(F.lit(r.kind) for r in rules)), F.col("rank") + 1)
    hits = ledger.select("blob", F.explode("findings").alias("x")).select("blob", F.col("x.start").alias("start"), rank.alias("rank"), F.col("x.end").alias("end")).where("rank is not null")
    return hits.groupBy("blob").agg(F.array_sort(F.collect_set(F.struct("start", "rank", kind.alias("kind"), "end"))).alias("findings"))


def to_paths(paths: DataFrame, found: DataFrame, blob: str) -> tuple[DataFrame, str]:
    """paths left joined with found by blob, and the path of found's table. As found is read from a table of its own, both
    sides of the join are plain exchanges, which Spark splits where one blob has very many paths."""
    found, path = materialize(found, "found")
    return paths.join(found, blob, "left"), path


def secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, blob, findings) of every row: findings by start, then the rules' order (see current()).

    ledger: one that has all versions in docs for these rules, as extend_ledger() returns it; then no text is scanned. Without
    it, a ledger of these versions alone is made first. Null texts count as empty ones. Equal texts, repeated rows and rows
    with a null doc_id all get their blob's findings. Other columns are not read. An empty table gives no rows.
    """
    if ledger is None:
        ledger = extend_ledger(docs, fresh_path(docs.sparkSession, "ledger"), text, rules)
    paths = docs.select(F.col(doc_id).alias("doc_id"), blob_of(F.col(text)).alias("blob"))
    joined, _ = to_paths(paths, current(ledger, rules), "blob")
    none = F.array().cast(joined.schema["findings"].dataType)
    return joined.select("doc_id", "blob", F.coalesce("findings", none).alias("findings"))


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with the characters of every finding replaced by mark; overlapping findings are replaced together.

    ledger: as in secrets(). Other columns, null texts and texts without findings stay as they are; no row is lost or repeated.
    """
    spark = docs.sparkSession
    own, found = unused(docs, "blob"), unused(docs, "findings")
    path = None
    if ledger is None:
        path = fresh_path(spark, "ledger")
        ledger = extend_ledger(docs, path, text, rules)
    hits = current(ledger, rules).select(F.col("blob").alias(own), F.col("findings").alias(found))
    joined, _ = to_paths(docs.withColumn(own, blob_of(F.col(text))), hits, own)
    if path is not None:
        discard(spark, path)
    body = F.col(text)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(state: Column, x: Column) -> Column:
        kept = F.substr(body, (state.at + 1).cast("int"), F.greatest(x.start - state.at, F.lit(0)).cast("int"))
        out = F.when(x.start >= state.at, F.concat(state.out, kept, F.lit(mark))).otherwise(state.out)
        return F.struct(F.greatest(state.at, x.end).alias("at"), out.alias("out"))

    clean = F.aggregate(found, start, step, lambda state: F.concat(state.out, F.substr(body, (state.at + 1).cast("int"))))
    return joined.withColumn(text, F.when(F.col(found).isNull(), body).otherwise(clean)).select(*docs.columns)


def listed(findings: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """kind:start:end of the findings (of some kinds), comma-joined."""
    some = F.filter(findings, lambda x: x.kind.isin(*kinds)) if kinds else findings
    return F.array_join(F.transform(some, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")
