"""Secret scans with corpus-wide ownership frequency.

Base candidates are found by pattern, leftmost and non-overlapping for each kind; generic ones are long runs of
key characters that hold letters and digits. The value of each candidate is hashed, and over all documents the
distinct owners and repositories of each hash are counted: a value of more than ``MAX_OWNERS`` owners is a copied
example, any other looks live. Base spans always stay; generic ones are added where the value looks live and no
base span covers them. An owner is a source, a repository a source and a language.

Offsets are code points. Where a pattern matches is told from the lengths of the matches and of what lies
between them, so all is array expressions; rows without a match skip them. The frequency tables hold a row per
distinct hash and owner, and partial aggregation takes a hot value's rows down to one for each task.

Null and empty texts have no spans; a null source is an owner of its own; each of several rows with one id gets
its own result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.shared import written

MAX_OWNERS = 1

# The kinds, their patterns and the least length of each value.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
GENERIC = r"[A-Za-z0-9+/_=-]+"
MIN_ASSIGN, MIN_ACCESS, MIN_HEX, MIN_GENERIC = 6, 20, 24, 24
#: name, pattern, group of the value, least length, order among kinds.
KINDS = (("assign", ASSIGN, 2, MIN_ASSIGN, 0), ("access", ACCESS, 0, MIN_ACCESS, 1), ("hex", HEX, 0, MIN_HEX, 2), ("generic", GENERIC, 0, MIN_GENERIC, 3))


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", r"\x27") + "'"


def _spans(kind: str, pattern: str, group: int, least: int, order: int) -> Column:
    """Array of (start, order, kind, end, value) of the matches whose value is long enough."""
    # A run of one class fails as a whole when it is short, so its least length may stand in the pattern.
    fixed = pattern[:-1] + f"{{{least - (4 if kind == 'access' else 0)},}}" if group == 0 else pattern
    p = _quoted(fixed)
    nothing = "cast(array() as array<struct<start: int, ord: int, kind: string, end: int, value: string>>)"
    found = f"""
    transform(array(struct(regexp_extract_all(text, {p}, 0) as m, regexp_extract_all(text, {p}, {group}) as v, split(text, {p}, -1) as b)), x ->
      filter(
        transform(
          array(aggregate(
            sequence(0, size(x.m) - 1),
            struct(0 as at, cast(array() as array<struct<start: int, end: int>>) as spans),
            (acc, i) -> struct(
              acc.at + length(x.b[i]) + length(x.m[i]) as at,
              concat(acc.spans, array(struct(acc.at + length(x.b[i]) as start, acc.at + length(x.b[i]) + length(x.m[i]) as end))) as spans),
            acc -> acc.spans)),
          s -> transform(x.v, (v, i) -> struct(s[i].start as start, {order} as ord, '{kind}' as kind, s[i].end as end, v as value)))[0],
        y -> length(y.value) >= {least}))[0]
    """
    return F.expr(f"if(text rlike {p}, {found}, {nothing})")


def _looks_random(value: str) -> str:
    return rf"{value} rlike '[0-9].*[0-9].*[0-9]' and {value} rlike '[A-Za-z]'"


def candidates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: row, doc_id, owner, repo, and the arrays base and generic of candidates; written."""
    text = docs.select("doc_id", F.col("source").alias("owner"), F.concat_ws("/", "source", "lang").alias("repo"), F.coalesce("text", F.lit("")).alias("text"))
    found = text.withColumns({kind: _spans(kind, pattern, group, least, order) for kind, pattern, group, least, order in KINDS})
    covered = "exists(base, b -> b.start < g.end and g.start < b.end)"
    found = found.withColumn("base", F.array_sort(F.concat("assign", "access", "hex"))).withColumn("generic", F.expr(f"filter(generic, g -> {_looks_random('g.value')} and not {covered})"))
    hashed = {c: F.expr(f"transform({c}, x -> struct(x.start as start, x.ord as ord, x.kind as kind, x.end as end, sha2(x.value, 256) as hash))") for c in ("base", "generic")}
    return written(found.select("doc_id", "owner", "repo", *[v.alias(k) for k, v in hashed.items()]).withColumn("row", F.monotonically_increasing_id()))


def ownership(found: DataFrame) -> DataFrame:
    """hash, n_owners and n_repos of every candidate value."""
    seen = found.select("owner", "repo", F.explode(F.concat("base", "generic")).alias("c")).select(F.col("c.hash").alias("hash"), "owner", "repo")
    owned = seen.groupBy("hash", "owner", "repo").agg(F.lit(1).alias("one"))
    each = owned.groupBy("hash", "owner").agg(F.count("*").alias("repos"))
    return each.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos"))


def scan(docs: DataFrame, max_owners: int = MAX_OWNERS) -> DataFrame:
    """Per row of ``docs``: doc_id, base and added spans as arrays of (start, ord, kind, end), n_live, n_example."""
    found = candidates(docs)
    copied = ownership(found).filter(F.col("n_owners") > max_owners).select("hash", F.lit(True).alias("copied"))
    each = found.select("row", F.explode(F.concat("base", "generic")).alias("c")).select("row", "c.*").join(copied, "hash", "left")
    copied_once = F.coalesce("copied", F.lit(False))
    verdicts = each.groupBy("row").agg(
        F.count_if(~copied_once).alias("n_live"),
        F.count_if(copied_once).alias("n_example"),
        F.array_sort(F.collect_list(F.when((F.col("kind") == "generic") & ~copied_once, F.struct("start", "ord", "kind", "end")))).alias("added"),
    )
    joined = found.select("doc_id", "row", F.expr("transform(base, x -> struct(x.start as start, x.ord as ord, x.kind as kind, x.end as end))").alias("base")).join(verdicts, "row", "left")
    none = F.expr("cast(array() as array<struct<start: int, ord: int, kind: string, end: int>>)")
    return joined.select("doc_id", "base", F.coalesce("added", none).alias("added"), F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_example", F.lit(0)).alias("n_example"))


def _listed(column: str) -> Column:
    return F.expr(f"array_join(transform({column}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')")


def secrets_query(docs: DataFrame) -> DataFrame:
    """The contract's columns, n_live and n_example."""
    found = scan(docs).withColumn("every", F.array_sort(F.concat("base", "added")))
    return found.select(
        "doc_id",
        *[F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) as long)").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(_listed("base"), 256).alias("base_sha256"),
        _listed("every").alias("spans"),
        "n_live",
        "n_example",
    )


def _oracle() -> str:
    def spans(kind, pattern, group, least, order):
        p = "'" + pattern.replace("'", "''") + "'"
        return f"""
  SELECT row, owner, {order} AS ord, '{kind}' AS kind, unnest(list_transform(range(1, len(m) + 1), lambda i: struct_pack(
      s := CAST(coalesce(list_sum(list_transform(list_slice(b, 1, i), lambda z: length(z))), 0) + coalesce(list_sum(list_transform(list_slice(m, 1, i - 1), lambda z: length(z))), 0) AS INTEGER),
      e := CAST(coalesce(list_sum(list_transform(list_slice(b, 1, i), lambda z: length(z))), 0) + coalesce(list_sum(list_transform(list_slice(m, 1, i), lambda z: length(z))), 0) AS INTEGER),
      v := v[i]))) AS x
  FROM (SELECT row, owner, regexp_extract_all(text, {p}) AS m, regexp_extract_all(text, {p}, {group}) AS v, string_split_regex(text, {p}) AS b FROM t)"""

    short = {"hex": "[0-9a-f]{24,}", "access": "AKIA[A-Z0-9]{16,}", "generic": f"[A-Za-z0-9+/_=-]{{{MIN_GENERIC},}}"}
    parts = " UNION ALL ".join(spans(k, short.get(k, p), g, n, o) for k, p, g, n, o in KINDS)
    return f"""
WITH t AS (SELECT row_number() OVER () AS row, doc_id, source AS owner, coalesce(text, '') AS text FROM documents),
raw AS ({parts}),
found AS (
  SELECT row, owner, ord, kind, x.s AS s, x.e AS e, x.v AS v FROM raw
  WHERE length(x.v) >= CASE kind WHEN 'assign' THEN {MIN_ASSIGN} WHEN 'access' THEN {MIN_ACCESS} WHEN 'hex' THEN {MIN_HEX} ELSE {MIN_GENERIC} END),
kept AS (
  SELECT * FROM found f WHERE kind <> 'generic' OR (
    regexp_matches(v, '[0-9].*[0-9].*[0-9]') AND regexp_matches(v, '[A-Za-z]')
    AND NOT EXISTS (SELECT 1 FROM found g WHERE g.row = f.row AND g.kind <> 'generic' AND g.s < f.e AND f.s < g.e))),
copied AS (SELECT v FROM kept GROUP BY v HAVING count(DISTINCT owner) + max(CASE WHEN owner IS NULL THEN 1 ELSE 0 END) > {MAX_OWNERS}),
judged AS (SELECT k.*, c.v IS NOT NULL AS copied FROM kept k LEFT JOIN copied c ON k.v = c.v),
per AS (
  SELECT row,
    count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) FILTER (kind <> 'generic') AS base,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) FILTER (kind <> 'generic' OR NOT copied) AS spans,
    count(*) FILTER (NOT copied) AS n_live, count(*) FILTER (copied) AS n_example
  FROM judged GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM t LEFT JOIN per USING (row)
"""


ORACLE = _oracle()
