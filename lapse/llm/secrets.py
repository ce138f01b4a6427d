"""Operator 2: secret scan with corpus-wide ownership frequency.

Candidates of three base kinds, and of a bare high-entropy kind, are found in
whole texts. The hash of each candidate's value is aggregated over the corpus
by distinct repositories and owners: values of few owners are live-looking,
widely copied ones are examples. A bare candidate becomes a span only where
the corpus shows its value as a live-looking credential, i.e. the same value
stands as a base span somewhere, or it mixes character classes and has one
owner. Base spans always stay; the frequency only labels them.

A text of any length is scanned whole; its matches are one array, and work follows their number.
Null text: as empty. A null source counts as one owner of its own. Repeated
rows: each has its own row (their candidates count once, by distinct owners).
An empty table gives an empty result. Only doc_id, text, source and lang are
read, so extra columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapse.session import materialize

#: Kinds in their listed order with the pattern of a whole match; the first three are the base.
ASSIGN = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_HEAD = r"""(?i)^(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
#: Runs are maximal, so a least length inside the pattern drops the same matches as a filter behind it.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
BARE = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ["assign", "access", "hex", "bare"]
#: A value of at most so many distinct owners (sources) and repositories (source and language) looks live.
MAX_OWNERS, MAX_REPOSITORIES = 2, 4
#: Matches of a text whose places are added up together.
BLOCK = 256


def located(text: Column, pattern: str, kind: int) -> Column:
    """All leftmost matches as array<struct(start, kind, end, match)>, in code points: the places follow from the
    lengths of the parts between matches, added up in blocks of BLOCK matches and then over blocks, so that a text of many
    matches takes work in proportion (an array that grows match by match would be copied each time)."""
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    between = F.split(text, pattern, -1)
    pairs = F.zip_with(found, F.slice(between, 1, F.size(found)), lambda m, b: F.struct(m.alias("m"), F.length(b).alias("b")))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,match:string>>")
    span = lambda x, at: F.struct((at + x["b"]).alias("start"), F.lit(kind).alias("kind"),
                                  (at + x["b"] + F.length(x["m"])).alias("end"), x["m"].alias("match"))
    walked = lambda block: F.aggregate(block, F.struct(F.lit(0).alias("at"), none.alias("out")), lambda acc, x: F.struct(
        (acc["at"] + x["b"] + F.length(x["m"])).alias("at"), F.concat(acc["out"], F.array(span(x, acc["at"]))).alias("out")))
    starts = F.sequence(F.lit(1), F.size(found), F.lit(BLOCK))
    # `found` and its parts are bound once, as the arguments of a lambda, not evaluated anew for each block.
    blocks = F.transform(F.array(pairs), lambda all_: F.transform(starts, lambda i: walked(F.slice(all_, i, BLOCK))))[0]
    moved = lambda block, by: F.transform(block["out"], lambda x: F.struct(
        (x["start"] + by).alias("start"), x["kind"].alias("kind"), (x["end"] + by).alias("end"), x["match"].alias("match")))
    whole = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array(none).alias("out")), lambda acc, block: F.struct(
        (acc["at"] + block["at"]).alias("at"), F.concat(acc["out"], F.array(moved(block, acc["at"]))).alias("out")))
    return F.when(text.rlike(pattern), F.flatten(whole["out"])).otherwise(none)


def value_of(match: Column, kind: Column) -> Column:
    return F.when(kind == 0, F.regexp_replace(match, ASSIGN_HEAD, "")).otherwise(match)


def _mixed(value: Column) -> Column:
    return value.rlike("[A-Z]") & value.rlike("[a-z]") & value.rlike("[0-9].*[0-9]")


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, owner, repo, text_hash, found): one row a document; found: its candidates in order, with the hash of
    each value. The text itself goes no further."""
    text = F.coalesce(docs["text"], F.lit(""))
    base = docs.select(docs["doc_id"], text.alias("text"), F.coalesce(docs["source"], F.lit("\0null")).alias("owner"),
                       F.coalesce(docs["lang"], F.lit("\0null")).alias("lang"))
    hits = F.concat(*(located(F.col("text"), p, k) for k, p in enumerate((ASSIGN, ACCESS, HEX, BARE))))
    valued = F.transform(hits, lambda x: F.struct(
        x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), value_of(x["match"], x["kind"]).alias("value")))
    held = F.filter(valued, lambda x: ((x["kind"] == 0) & (F.length(x["value"]) >= 8)) | x["kind"].isin(1, 2) | ((x["kind"] == 3) & _mixed(x["value"])))
    hashed = F.array_sort(F.transform(held, lambda x: F.struct(
        x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), F.sha2(x["value"], 256).alias("hash"))))
    return base.select("doc_id", "owner", F.concat_ws("\0", "owner", "lang").alias("repo"), F.xxhash64("text").alias("text_hash"),
                       hashed.alias("found"))


def ownership(found: DataFrame, max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """(hash, n_owners, n_repositories, n_documents, as_base, live) by candidate value. Distinct (hash, owner,
    repository) are made before the shuffle, so a value that is copied everywhere sends a few rows a task."""
    each = found.select("owner", "repo", F.explode("found").alias("c")).select(
        F.col("c.hash").alias("hash"), "owner", "repo", (F.col("c.kind") < 3).alias("base"))
    parts = each.groupBy("hash", "owner", "repo").agg(F.count(F.lit(1)).alias("n"), F.max("base").alias("base"))
    owners = parts.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"), F.sum("n").alias("n"), F.max("base").alias("base"))
    return owners.groupBy("hash").agg(
        F.count(F.lit(1)).alias("n_owners"), F.sum("repos").alias("n_repositories"), F.sum("n").alias("n_spans"),
        F.max("base").alias("as_base")).withColumn(
        "live", (F.col("n_owners") <= max_owners) & (F.col("n_repositories") <= max_repositories))


def secret_spans(docs: DataFrame, **limits: int) -> DataFrame:
    """(doc_id, spans): spans as array<struct(start, kind, end, hash, n_owners, n_repositories, live)> of every
    document, bare ones only where the corpus shows them as live. A bare span that overlaps a base one is left out."""
    # Written once: the scans of whole texts aren't repeated, and rows of equal id and text stay apart by their number.
    found = materialize(candidates(docs).withColumn("row", F.monotonically_increasing_id()), "op2-candidates")
    freq = ownership(found, **limits)
    each = found.where(F.size("found") > 0).select("row", F.explode("found").alias("c")).select("row", "c.*")
    labelled = each.join(freq, "hash").where((F.col("kind") < 3) | F.col("live") | F.col("as_base"))
    # A bare span overlaps a base one that begins no later and ends behind its start, or begins inside it.
    by, base = Window.partitionBy("row"), F.col("kind") < 3
    reach = F.max(F.when(base, F.col("end"))).over(by.orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    ahead = F.min(F.when(base, F.col("start"))).over(by.orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, -1))
    apart = labelled.withColumn("reach", reach).withColumn("ahead", ahead).where(
        base | ~(F.coalesce(F.col("reach") > F.col("start"), F.lit(False)) | F.coalesce(F.col("ahead") < F.col("end"), F.lit(False))))
    own = apart.groupBy("row").agg(F.array_sort(F.collect_list(F.struct(
        "start", "kind", "end", "hash", "n_owners", "n_repositories", "live"))).alias("spans"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,hash:string,n_owners:bigint,n_repositories:bigint,live:boolean>>")
    return found.select("row", "doc_id").join(own, "row", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))


def _joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def digests(found: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda x: x["kind"] < 3)
    count = lambda test: F.size(F.filter("spans", test)).cast("long")
    of_kind = lambda k: count(lambda x: x["kind"] == k)
    return found.select(
        "doc_id", *(of_kind(k).alias(f"n_{KINDS[k]}") for k in range(3)),
        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"),
        count(lambda x: x["live"]).alias("n_live"), count(lambda x: ~x["live"]).alias("n_example"))


def _oracle() -> str:
    def found(name: str, pattern: str, k: int) -> str:
        p = pattern.replace("'", "''")
        return f"""
{name}m AS (SELECT r, t, regexp_extract_all(t, '{p}') AS ms, string_split_regex(t, '{p}') AS bs FROM d WHERE regexp_matches(t, '{p}')),
{name}l AS (SELECT r, i, ms[i] AS m, length(ms[i]) AS n, length(bs[i]) AS b FROM (SELECT r, ms, bs, unnest(range(1, len(ms) + 1)) AS i FROM {name}m)),
{name} AS (SELECT r, {k} AS kind, m, sum(n + b) OVER (PARTITION BY r ORDER BY i) AS e, n FROM {name}l)"""

    kinds = ",".join(found(n, p, k) for k, (n, p) in enumerate(zip(("ka", "kc", "kh", "kb"), (ASSIGN, ACCESS, HEX, BARE), strict=True)))
    head = ASSIGN_HEAD.replace("'", "''")
    names = "['assign', 'access', 'hex', 'bare'][kind + 1]"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce(source, chr(1)) AS o,
           coalesce(source, chr(1)) || chr(0) || coalesce(lang, chr(1)) AS rp FROM documents),
{kinds},
u AS (SELECT r, kind, CAST(e - n AS BIGINT) AS s, CAST(e AS BIGINT) AS e, CASE WHEN kind = 0 THEN regexp_replace(m, '{head}', '') ELSE m END AS v
      FROM (SELECT * FROM ka UNION ALL SELECT * FROM kc UNION ALL SELECT * FROM kh UNION ALL SELECT * FROM kb)),
c AS (SELECT * FROM u WHERE (kind = 0 AND length(v) >= 8) OR kind IN (1, 2)
      OR (kind = 3 AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[0-9].*[0-9]'))),
f AS (SELECT v, count(DISTINCT o) <= {MAX_OWNERS} AND count(DISTINCT rp) <= {MAX_REPOSITORIES} AS live, bool_or(kind < 3) AS as_base
      FROM c JOIN d USING (r) GROUP BY v),
g AS (SELECT c.*, live, {names} || ':' || s || ':' || e AS x FROM c JOIN f USING (v) WHERE kind < 3 OR live OR as_base),
a AS (SELECT * FROM g WHERE kind < 3 OR NOT EXISTS (SELECT 1 FROM g h WHERE h.r = g.r AND h.kind < 3 AND h.s < g.e AND g.s < h.e)),
p AS (SELECT r, count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2,
      string_agg(x, ',' ORDER BY s, kind) FILTER (kind < 3) AS base, string_agg(x, ',' ORDER BY s, kind) AS spans,
      count(*) FILTER (live) AS nl, count(*) FILTER (NOT live) AS ne FROM a GROUP BY r)
SELECT doc_id, coalesce(n0, 0)::BIGINT AS n_assign, coalesce(n1, 0)::BIGINT AS n_access, coalesce(n2, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(nl, 0)::BIGINT AS n_live, coalesce(ne, 0)::BIGINT AS n_example
FROM d LEFT JOIN p USING (r)
"""


ORACLE = _oracle()
