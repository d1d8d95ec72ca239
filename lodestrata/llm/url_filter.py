"""URL filters: rules of hosts and paths, and a path-template tree for what no rule names.

A host's paths form a tree that is grown from the top, a level a round. Under a template, a
segment stays where it holds its share of the URLs; all others are variable and become one
wildcard. Branches that stayed and do not differ, neither in the share of blocked URLs among
their labelled ones (two proportions) nor in what kinds of segments follow, become one
branch. A URL's template is the path down the tree; a template is rejected if enough of its
labelled URLs are blocked, with a few pseudo-labels at the share of all labelled ones, half
at most, so that a single label does not reject a template. Where nothing in a template is
labelled, nothing is rejected. URLs that a rule decides are the labelled ones, with further
ones of the caller's.

DataFrame functions only. Counts are summed before they are shuffled; a hot host's URLs meet
its few kept segments in plain left joins, whose large partitions Spark splits; the segments
of one parent that stay are at most 1 / SHARE.

Cases: a null URL or one without ``://`` has an empty host and path, fits no rule and is
judged by that host's templates; null page_ids and repeated rows stay as they are; paths of
any length are judged, templates hold DEPTH segments and stand for all that follows with
one tail; empty segments do not count; a segment that is itself ``*`` or holds ``|`` is
written as in a URL (``%2A``, ``%7C``); of rules of one length the one of the longer host
wins; no URLs, no rows; other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.common import written

#: Fixed values of the contract: host, path, verdict.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]

#: A segment stays with so many URLs and so large a share of its parent's.
LEAST, SHARE = 4, 0.05
#: Branches are alike within so many standard errors of their blocked shares, if at most so
#: large a part of the segments that follow is of other kinds.
ERRORS, OTHER_KINDS = 1.96, 0.25
#: Segments of a template; pseudo-labels; the least purity of a rejected template.
DEPTH, PSEUDO, REJECTED = 6, 4.0, 0.8

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_KINDS = ["ends", "digits", "letters", "others"]


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, host, path."""
    url = F.col("url").cast("string")
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    split = pages.select("page_id", F.coalesce(rest, F.lit("")).alias("rest")).withColumn("host", F.regexp_extract("rest", "^[^/?#]*", 0))
    path = F.regexp_extract(F.substr("rest", F.length("host") + 1), "^[^?#]*", 0)
    return split.select("page_id", F.translate("host", _UPPER, _UPPER.lower()).alias("host"), path.alias("path"))


def _ranked(rules: list[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    return sorted(rules, key=lambda r: (-len(r[0]) - len(r[1]), -len(r[0]), r))


def ruled(urls: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """urls with rule and blocked (null where no rule fits)."""
    fits = lambda h, p: ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
    first = lambda value: F.coalesce(*[F.when(fits(h, p), F.lit(value(h, p, v))) for h, p, v in _ranked(rules)])
    if not rules:
        return urls.withColumns({"rule": F.lit(None).cast("string"), "blocked": F.lit(None).cast("boolean")})
    return urls.withColumns({"rule": first(lambda h, p, v: h + p), "blocked": first(lambda h, p, v: v == "block")})


def _kind(segment: Column) -> list[Column]:
    ends, digits, letters = segment.isNull(), segment.rlike(r"\A[0-9]+\z"), segment.rlike(r"\A[A-Za-z]+\z")
    return [ends, ~ends & digits, ~ends & letters, ~ends & ~digits & ~letters]


def _branches(urls: DataFrame, level: int) -> DataFrame:
    """host, template, segment of the segments that stay, and the branch each is part of."""
    here = ["host", "template"]
    counts = urls.select(*here, F.get("segments", F.lit(level)).alias("segment"), "blocked", *[k.cast("long").alias(n) for n, k in zip(_KINDS, _kind(F.get("segments", F.lit(level + 1))), strict=True)])
    counts = counts.where("segment IS NOT NULL").groupBy(*here, "segment").agg(F.count("*").alias("n"), F.count("blocked").alias("labelled"), F.count_if("blocked").alias("bad"), *[F.sum(k).alias(k) for k in _KINDS])
    totals = counts.groupBy(*here).agg(F.sum("n").alias("total"))
    kept = counts.where(F.col("n") >= LEAST).join(totals, here).where(F.col("n") >= SHARE * F.col("total"))
    kept = kept.withColumn("rate", F.col("bad") / F.nullif("labelled", F.lit(0)))
    row = Window.partitionBy(*here).orderBy(F.col("rate").asc_nulls_last(), "segment")
    last = lambda c: F.lag(c).over(row)
    pooled = (F.col("bad") + last("bad")) / F.nullif(F.col("labelled") + last("labelled"), F.lit(0))
    error = F.sqrt(pooled * (1 - pooled) * (1 / F.nullif("labelled", F.lit(0)) + 1 / F.nullif(last("labelled"), F.lit(0))))
    apart = sum((F.abs(F.col(k) / F.col("n") - last(k) / last("n")) for k in _KINDS), F.lit(0.0)) / 2
    alike = (F.abs(F.col("rate") - last("rate")) <= ERRORS * error) & (apart <= OTHER_KINDS)
    kept = kept.withColumn("new", (~F.coalesce(alike, F.lit(False))).cast("int"))
    kept = kept.withColumn("branch", F.sum("new").over(row.rowsBetween(Window.unboundedPreceding, 0)))
    literal = F.replace(F.replace("segment", F.lit("|"), F.lit("%7C")), F.lit("*"), F.lit("%2A"))
    name = F.array_join(F.array_sort(F.collect_list(literal).over(Window.partitionBy(*here, "branch"))), "|")
    return kept.select(*here, "segment", name.alias("name"))


def templates(urls: DataFrame) -> DataFrame:
    """urls (host, path, blocked and others) with template."""
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    urls = written(urls.withColumns({"segments": F.slice(segments, 1, DEPTH + 1), "template": F.lit("")}))
    deepest = urls.agg(F.max(F.size("segments"))).first()[0] or 0
    for level in range(min(DEPTH, deepest)):
        urls = urls.withColumn("segment", F.get("segments", F.lit(level))).join(_branches(urls, level), ["host", "template", "segment"], "left")
        urls = written(urls.withColumn("template", F.when(F.col("segment").isNotNull(), F.concat("template", F.lit("/"), F.coalesce("name", F.lit("*")))).otherwise(F.col("template"))).drop("segment", "name"))
    tail = F.when(F.size("segments") > DEPTH, F.lit("/**")).otherwise("")
    return urls.withColumn("template", F.concat("template", tail)).drop("segments")


def judged(urls: DataFrame) -> DataFrame:
    """urls (host, path, blocked where labelled, and others) with template, labelled, purity
    and rejected: whether the template is."""
    urls = templates(urls)
    stats = urls.groupBy("host", "template").agg(F.count("blocked").alias("labelled"), F.count_if("blocked").alias("bad"))
    bad, labelled = stats.agg(F.sum("bad"), F.sum("labelled")).first()
    prior = min(bad / labelled, 0.5) if labelled else 0.0
    purity = (F.col("bad") + PSEUDO * prior) / (F.col("labelled") + PSEUDO)
    stats = stats.select("host", "template", "labelled", purity.alias("purity")).withColumn("rejected", (F.col("labelled") > 0) & (F.col("purity") >= REJECTED))
    return urls.join(stats, ["host", "template"])


def verdicts(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, labelled: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, template, labelled, purity of every page. labelled:
    url and blocked of further labelled URLs."""
    urls = ruled(parsed(pages), RULES if rules is None else rules).withColumn("asked", F.lit(True))
    if labelled is not None:
        more = parsed(labelled.select(F.col("blocked").cast("boolean").alias("page_id"), "url"))
        urls = urls.unionByName(more.select(F.lit(None).cast(urls.schema["page_id"].dataType).alias("page_id"), "host", "path", F.lit(None).cast("string").alias("rule"), F.col("page_id").alias("blocked"), F.lit(False).alias("asked")))
    block = F.when(F.col("rule").isNotNull(), F.col("blocked")).otherwise(F.col("rejected"))
    return judged(urls).where("asked").select("page_id", "host", "path", "rule", F.when(block, "block").otherwise("allow").alias("verdict"), "template", "labelled", "purity")


def held_out(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """blocked, rejected, urls: what the tree says of labelled URLs whose labels it was not
    given, half of all by hash."""
    urls = ruled(parsed(pages), RULES if rules is None else rules).withColumns({"truth": F.col("blocked"), "hidden": F.pmod(F.xxhash64("host", "path"), F.lit(2)) == 0})
    said = judged(urls.withColumn("blocked", F.when(~F.col("hidden"), F.col("blocked"))))
    return said.where("hidden AND truth IS NOT NULL").groupBy(F.col("truth").alias("blocked"), "rejected").agg(F.count("*").alias("urls"))


def _sql() -> str:
    """DuckDB SQL of the query: the same levels, one after another."""
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    case = lambda value: "CASE " + " ".join(f"WHEN {fits(h, p)} THEN {value(h, p, v)}" for h, p, v in _ranked(RULES)) + " END"
    parts = [f"""WITH s AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS own, rest FROM s),
p AS (SELECT page_id, translate(own, '{_UPPER}', '{_UPPER.lower()}') AS host, regexp_extract(substr(rest, length(own) + 1), '^[^?#]*') AS path FROM h),
u0 AS (SELECT *, {case(lambda h, p, v: f"'{h}{p}'")} AS rule, {case(lambda h, p, v: str(v == "block").lower())} AS blocked, list_filter(string_split(path, '/'), lambda x: x <> '') AS segments, '' AS template FROM p)"""]
    for i in range(DEPTH):
        follow = f"segments[{i + 2}]"
        digits, letters = f"regexp_full_match({follow}, '[0-9]+')", f"regexp_full_match({follow}, '[A-Za-z]+')"
        kinds = [f"{follow} IS NULL", digits, letters, f"NOT {digits} AND NOT {letters}"]
        apart = " + ".join(f"abs({k} / n - lag({k}) OVER w / lag(n) OVER w)" for k in _KINDS)
        parts.append(f"""c{i} AS (SELECT host, template, segments[{i + 1}] AS segment, count(*) AS n, count(blocked) AS labelled, count(*) FILTER (blocked) AS bad, {", ".join(f"count(*) FILTER ({k}) AS {n}" for n, k in zip(_KINDS, kinds, strict=True))} FROM u{i} WHERE len(segments) > {i} GROUP BY 1, 2, 3),
k{i} AS (SELECT *, bad / nullif(labelled, 0) AS rate FROM (SELECT *, sum(n) OVER (PARTITION BY host, template) AS total FROM c{i}) WHERE n >= {LEAST} AND n >= {SHARE} * total),
a{i} AS (
  SELECT *, (bad + lag(bad) OVER w) / nullif(labelled + lag(labelled) OVER w, 0) AS pooled, 1 / nullif(labelled, 0) + 1 / nullif(lag(labelled) OVER w, 0) AS inverse, abs(rate - lag(rate) OVER w) AS off, ({apart}) / 2 AS apart
  FROM k{i} WINDOW w AS (PARTITION BY host, template ORDER BY rate NULLS LAST, encode(segment))),
b{i} AS (SELECT *, sum(CASE WHEN off <= {ERRORS} * sqrt(pooled * (1 - pooled) * inverse) AND apart <= {OTHER_KINDS} THEN 0 ELSE 1 END) OVER (PARTITION BY host, template ORDER BY rate NULLS LAST, encode(segment)) AS branch FROM a{i}),
n{i} AS (SELECT host, template, segment, string_agg(replace(replace(segment, '|', '%7C'), '*', '%2A'), '|') OVER (PARTITION BY host, template, branch ORDER BY encode(replace(replace(segment, '|', '%7C'), '*', '%2A')) ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS name FROM b{i}),
u{i + 1} AS (SELECT u.* REPLACE (CASE WHEN len(segments) > {i} THEN u.template || '/' || coalesce(n.name, '*') ELSE u.template END AS template) FROM u{i} u LEFT JOIN n{i} n ON n.host = u.host AND n.template = u.template AND n.segment = u.segments[{i + 1}])""")
    parts.append(f"""t AS (SELECT page_id, host, path, rule, blocked, template || CASE WHEN len(segments) > {DEPTH} THEN '/**' ELSE '' END AS template FROM u{DEPTH}),
st AS (SELECT host, template, count(blocked) AS labelled, count(*) FILTER (blocked) AS bad FROM t GROUP BY 1, 2),
q AS (SELECT host, template, labelled, (bad + {PSEUDO} * (SELECT least(coalesce(sum(bad) / nullif(sum(labelled), 0), 0), 0.5) FROM st)) / (labelled + {PSEUDO}) AS purity FROM st)
SELECT t.page_id, t.host, t.path, t.rule, CASE WHEN CASE WHEN t.rule IS NOT NULL THEN t.blocked ELSE q.labelled > 0 AND q.purity >= {REJECTED} END THEN 'block' ELSE 'allow' END AS verdict, t.template, q.labelled, q.purity
FROM t JOIN q ON q.host = t.host AND q.template = t.template""")
    return ",\n".join(parts)


SQL = _sql()
