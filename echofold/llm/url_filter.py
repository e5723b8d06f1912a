"""URL verdicts from path rules and link-graph propagation, in DataFrame operations only.

Hosts are vertices. An edge runs from the host of a page to each host that the page links to (absolute
``href``), and from every host to the site one label above it. Trust is personalised PageRank from
hosts with pages that a rule allows; distrust is the same walk over reversed edges from hosts with
pages that a rule blocks. Both are measured in pages, and a host whose distrust exceeds its trust
by more than a share of its own pages is blocked where no rule decides.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echofold.llm.spark_util import cut

#: Fixed values of the contract: verdict, rule as host suffix and path prefix.
RULES = (
    ("block", "net/"),
    ("allow", "example.net/en/"),
    ("block", "example.com/de/"),
    ("allow", "org/fr/"),
)
#: The walks end when trust and distrust change by less than this share of their seeds, summed over hosts and over CUT steps.
TOLERANCE, CUT = 1e-7, 4
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?i)<a\s[^>]*href\s*=\s*["']?[a-z][a-z0-9+.-]*://([^/?#"'\s>]+)"""


def url_host(url):
    return F.coalesce(F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def url_path(url):
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def _by_rule(host, path, rules: Sequence[tuple[str, str]], field: int):
    """The rule (field 1) or its verdict (field 0) that fits with the longest text; among equals the first."""
    out = None
    for rule in sorted(rules, key=lambda r: -len(r[1])):
        of_host, _, of_path = rule[1].partition("/")
        fits = ((host == of_host) | host.endswith("." + of_host)) & path.startswith("/" + of_path)
        out = F.when(fits, F.lit(rule[field])) if out is None else out.when(fits, F.lit(rule[field]))
    return F.lit(None).cast("string") if out is None else out


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, w (share of the links that leave src) from rows (host, html)."""
    links = pages.select(
        F.col("host").alias("src"),
        F.explode(F.regexp_extract_all(F.col("html"), F.lit(_LINK), F.lit(1))).alias("dst"),
    ).select("src", F.translate("dst", _UPPER, _LOWER).alias("dst"))
    up = pages.select(F.col("host").alias("src")).distinct().where("instr(src, '.') > 0").select("src", F.regexp_replace("src", r"^[^.]*\.", "").alias("dst"))
    edges = links.unionByName(up).where("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    out = edges.groupBy("src").agg(F.sum("n").alias("total"))
    return edges.join(out, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("w"))


def _walks(edges: DataFrame, seeds: DataFrame, damping: float, tolerance: float) -> DataFrame:
    """host, trust, distrust: both start from ``seeds`` (the same columns) and sum to the seeds' sums.

    What reaches hosts without further edges starts again at the seeds; scaling at the end has that effect.
    """
    reversed_out = edges.groupBy("dst").agg(F.sum("w").alias("total"))
    both = cut(
        edges.select(F.col("src").alias("host"), F.col("dst").alias("to"), F.col("w").alias("forward"), F.lit(0.0).alias("backward")).unionByName(
            edges.join(reversed_out, "dst").select(
                F.col("dst").alias("host"), F.col("src").alias("to"), F.lit(0.0).alias("forward"), (F.col("w") / F.col("total")).alias("backward")
            )
        )
    )
    state, settled = seeds, False
    full = seeds.agg(F.sum("trust").alias("t"), F.sum("distrust").alias("d")).first()
    while not settled:
        last = state
        for _ in range(CUT):
            moved = both.join(state, "host").select(
                F.col("to").alias("host"),
                (F.col("trust") * F.col("forward") * damping).alias("trust"),
                (F.col("distrust") * F.col("backward") * damping).alias("distrust"),
            )
            restart = seeds.select("host", (F.col("trust") * (1 - damping)).alias("trust"), (F.col("distrust") * (1 - damping)).alias("distrust"))
            state = moved.unionByName(restart).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
        state = cut(state)
        both_times = state.select("host", "trust", "distrust").unionByName(last.select("host", (-F.col("trust")).alias("trust"), (-F.col("distrust")).alias("distrust")))
        change = both_times.groupBy("host").agg(F.abs(F.sum("trust")).alias("t"), F.abs(F.sum("distrust")).alias("d")).agg(F.sum("t").alias("t"), F.sum("d").alias("d")).first()
        settled = all((change[k] or 0.0) <= tolerance * (full[k] or 0.0) for k in ("t", "d"))
    now = state.agg(F.sum("trust").alias("t"), F.sum("distrust").alias("d")).first()
    scale = [(a or 0.0) / b if b else 0.0 for a, b in ((full["t"], now["t"]), (full["d"], now["d"]))]
    return state.select("host", (F.col("trust") * scale[0]).alias("trust"), (F.col("distrust") * scale[1]).alias("distrust"))


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, threshold: float = 0.25, damping: float = 0.85, tolerance: float = TOLERANCE) -> DataFrame:
    """page_id, host, path, rule, verdict, and trust and distrust of the host (in pages), for rows (page_id, url, html).

    A null url or one without ``://`` has an empty host and path, no rule, and is allowed unless pages of
    the empty host are distrusted. Null html has no links. Rows that repeat are judged alike, one result
    each. An empty table gives an empty result. Other columns are ignored.
    """
    rows = pages.select(
        F.col("page_id"),
        url_host(F.col("url")).alias("host"),
        url_path(F.col("url")).alias("path"),
        F.col("html").cast("string").alias("html"),
    ).withColumns(
        {
            "rule": _by_rule(F.col("host"), F.col("path"), rules, 1),
            "by_rule": _by_rule(F.col("host"), F.col("path"), rules, 0),
        }
    )
    seeds = cut(
        rows.groupBy("host").agg(
            F.count(F.lit(1)).alias("pages"),
            F.sum((F.col("by_rule") == "allow").cast("double")).alias("trust"),
            F.sum((F.col("by_rule") == "block").cast("double")).alias("distrust"),
        )
    ).fillna(0.0, ["trust", "distrust"])
    walked = _walks(cut(host_edges(rows)), seeds.select("host", "trust", "distrust"), damping, tolerance)
    scored = cut(
        seeds.select("host", "pages")
        .join(walked, "host", "left")
        .select(
            "host",
            F.round(F.coalesce("trust", F.lit(0.0)), 6).alias("trust"),
            F.round(F.coalesce("distrust", F.lit(0.0)), 6).alias("distrust"),
            (F.round(F.coalesce("distrust", F.lit(0.0)) - F.coalesce("trust", F.lit(0.0)), 6) > F.col("pages") * threshold).alias("bad"),
        )
    )
    return (
        rows.drop("html")
        .join(scored, "host", "left")
        .select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(F.col("bad"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "trust", "distrust")
    )


def op9_link_graph_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("trust", "distrust")
