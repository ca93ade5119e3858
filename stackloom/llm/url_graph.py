"""URL filters by link-graph propagation.

Rules judge the urls that they fit.  Their verdicts also seed the hosts: a host's trust starts
from its allowed pages and its distrust from its blocked pages.  Over the host graph of absolute
links, personalised PageRank spreads trust along links, and distrust against them (a host that
links to a bad one is bad).  A page without a rule gets its host's verdict: block if the host's
distrust is over ``THRESHOLD`` times its trust, else allow.

Scores are whole numbers (``UNIT`` for the sum of all seeds), so sums don't depend on the order
of rows and a retried task gives the same result.  Each round is one join and one pre-aggregated
sum over distinct host pairs; lineage is cut each ``EACH`` rounds, and rounds end as soon as no
score changes any more, after ``ROUNDS`` at the latest.

A null url or one without ``://`` has an empty host and path, and the empty host is judged like
any other.  Null html has no links.  Repeated rows stay and count again as seeds; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackloom.llm.spark import cut

#: (host, path, verdict) as the contract lists them: fixed values.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
UNIT = 10**18
DAMPING = 0.85
#: After so many rounds less than 1/10,000 of a seed's score is still on its way.
ROUNDS = 57
EACH = 4
THRESHOLD = 1.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) columns of a url."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def fitting(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null; equal lengths: the first in name."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
    tests = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for h, p, v in ordered]
    return F.coalesce(*tests)


def host_links(pages: DataFrame) -> DataFrame:
    """Distinct (src, dst) host pairs of absolute or protocol-relative links, with counts n."""
    host, _ = split_url(F.col("url"))
    links = F.regexp_extract_all(F.col("html"), F.lit(r"""(?i)href\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""), F.lit(1))
    raw = pages.where(F.instr("html", "//") > 0).select(host.alias("src"), F.explode(links).alias("dst"))
    return raw.select("src", F.translate("dst", UPPER, LOWER).alias("dst")).where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(seeds: DataFrame, links: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(host, score): personalised PageRank of seeds (host, n) over links (src, dst, n)."""
    total = seeds.agg(F.sum("n")).first()[0] or 1
    start = seeds.groupBy("host").agg(F.sum("n").alias("n")).select("host", F.floor(F.col("n") / F.lit(total) * UNIT).cast("bigint").alias("seed"))
    start = cut(start)
    outs = links.groupBy("src").agg(F.sum("n").alias("out"))
    shares = cut(links.join(outs, "src").select("src", "dst", (F.col("n") / F.col("out")).alias("part")))
    score = start.select("host", F.col("seed").alias("score"))
    if shares.isEmpty():
        return score
    again = start.select("host", F.floor(F.col("seed") * (1 - DAMPING)).cast("bigint").alias("score"))
    for k in range(1, rounds + 1):
        before = score
        moved = shares.join(score, shares["src"] == score["host"]).select(F.col("dst").alias("host"), F.floor(F.col("score") * DAMPING * F.col("part")).cast("bigint").alias("score"))
        score = again.unionAll(moved).groupBy("host").agg(F.sum("score").alias("score"))
        if k % EACH == 0 or k == rounds:
            score = cut(score)
            changed = score.alias("x").join(before.alias("y"), "host", "full").where(~F.col("x.score").eqNullSafe(F.col("y.score")))
            if changed.isEmpty():
                break
    return score


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, host_trust, host_distrust for every page."""
    host, path = split_url(F.col("url"))
    at = pages.select("page_id", host.alias("host"), path.alias("path"))
    at = at.withColumn("hit", fitting(F.col("host"), F.col("path"), rules))
    counts = cut(at.groupBy("host").agg(F.count_if(F.col("hit.verdict") == "allow").alias("good"), F.count_if(F.col("hit.verdict") == "block").alias("bad")))
    links = cut(host_links(pages))
    trust = propagate(counts.where("good > 0").select("host", F.col("good").alias("n")), links)
    back = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    distrust = propagate(counts.where("bad > 0").select("host", F.col("bad").alias("n")), back)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)
    by_host = counts.select("host").join(trust.withColumnRenamed("score", "host_trust"), "host", "left").join(distrust.withColumnRenamed("score", "host_distrust"), "host", "left")
    by_host = cut(by_host.select("host", zero("host_trust"), zero("host_distrust")))
    own = F.when(F.col("host_distrust") > F.col("host_trust") * THRESHOLD, "block").otherwise("allow")
    return at.join(by_host, "host").select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce(F.col("hit.verdict"), own).alias("verdict"), "host_trust", "host_distrust")


def _rules_sql(rules: list[tuple[str, str, str]]) -> tuple[str, str]:
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
    fit = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN " for h, p, _ in ordered]
    return " ".join(f + f"'{h}{p}'" for f, (h, p, _) in zip(fit, ordered)), " ".join(f + f"'{v}'" for f, (_, _, v) in zip(fit, ordered))


def oracle(rounds: int = ROUNDS) -> str:
    """The same in DuckDB SQL, with the rounds written out."""
    rule, verdict = _rules_sql(RULES)
    sql = [
        rf"""WITH raw AS (SELECT page_id, html, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
place AS (SELECT page_id, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM raw),
hit AS (SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} END AS verdict FROM place),
counts AS (SELECT host, count(*) FILTER (verdict = 'allow') AS good, count(*) FILTER (verdict = 'block') AS bad FROM hit GROUP BY host),
link AS (SELECT src, dst, count(*) AS n FROM (SELECT host AS src, translate(unnest(regexp_extract_all(html, '(?i)href\s*=\s*["'']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"''\s>]+)', 1)), '{UPPER}', '{LOWER}') AS dst FROM place) WHERE src <> dst GROUP BY ALL)"""
    ]
    for name, seed, a, b in (("t", "good", "src", "dst"), ("d", "bad", "dst", "src")):
        sql.append(f"{name}p AS (SELECT {a} AS src, {b} AS dst, n / sum(n) OVER (PARTITION BY {a}) AS part FROM link)")
        sql.append(f"{name}s AS (SELECT host, CAST(floor({seed} / (SELECT sum({seed}) FROM counts) * {UNIT}) AS BIGINT) AS score FROM counts WHERE {seed} > 0)")
        sql.append(f"{name}0 AS (SELECT * FROM {name}s)")
        for k in range(rounds):
            # without any link the seeds stand as they are
            sql.append(
                f"{name}{k + 1} AS (SELECT host, CAST(sum(score) AS BIGINT) AS score FROM (SELECT host, CASE WHEN EXISTS (SELECT 1 FROM link) THEN CAST(floor(score * {1 - DAMPING!r}) AS BIGINT) ELSE score END AS score FROM {name}s"
                f" UNION ALL SELECT dst, CAST(floor(score * {DAMPING}::DOUBLE * part) AS BIGINT) FROM {name}{k} JOIN {name}p ON host = src) GROUP BY host)"
            )
    return ",\n".join(sql) + f"""
SELECT page_id, hit.host AS host, path, rule, coalesce(verdict, CASE WHEN coalesce(d.score, 0) > coalesce(t.score, 0) * {THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict,
coalesce(t.score, 0) AS host_trust, coalesce(d.score, 0) AS host_distrust
FROM hit LEFT JOIN t{rounds} t ON hit.host = t.host LEFT JOIN d{rounds} d ON hit.host = d.host"""
