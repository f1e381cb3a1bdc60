"""URL rules propagated over redirect equivalence, in DataFrame functions only.

Addresses are vertices.  An edge says that two addresses lead to the same page:

* an address and its canonical form (scheme, default port, ``www.``, fragment,
  tracking parameters, index page and trailing slash do not tell pages apart;
  servers redirect one to the other);
* a page and the target of its ``<link rel=canonical>``;
* a page and the target of its ``<meta http-equiv=refresh>``;
* the rows of an optional table of observed redirects.

Connected components of these edges are sets of aliases.  An address that a rule
fits keeps the rule's action.  The others take the component's decision: allow if
any alias is explicitly allowed (allow has precedence), else block if any is
blocked, else allow.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefsight.llm.components import connected_components

#: A rule list is part of the plan, so it has to be short.
MAX_RULES = 10_000


@dataclass(frozen=True)
class Rule:
    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"),
         Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to /, ?, # or the end; empty without one."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, "://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_form(url: Column) -> Column:
    """The form all trivial variants of an address share; null without ``://``."""
    host = F.regexp_replace(F.regexp_replace(url_host(url), "^www[.]", ""), ":(80|443)$", "")
    path = F.regexp_replace(url_path(url), "(/index[.]html?)?/*$", "")
    query = F.regexp_extract(url, "://[^?#]*[?]([^#]*)", 1)
    query = F.regexp_replace(F.regexp_replace(query, "(^|&)(utm_[^=&]*|ref|gclid|fbclid)(=[^&]*)?", ""), "^&+", "")
    form = F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(url.contains("://"), form)


def _attribute(tag: Column, name: str) -> Column:
    value = F.regexp_extract(tag, rf"(?is)\b{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", 1)
    return F.replace(F.trim(F.regexp_replace(value, "^[\"']|[\"']$", "")), F.lit("&amp;"), F.lit("&"))


def _absolute(target: Column, base: Column) -> Column:
    """A link target against the address of its page."""
    site = F.regexp_extract(base, "^([^?#]*?://[^/?#]*)", 1)
    folder = F.regexp_extract(base, "^([^?#]*?://[^?#]*/)", 1)
    return (F.when(target == "", F.lit(None))
            .when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), target)
            .when(target.startswith("//"), F.concat(F.regexp_extract(base, "^([^?#]*?:)//", 1), target))
            .when(target.startswith("/"), F.concat(site, target))
            .otherwise(F.concat(F.when(folder == "", F.concat(site, F.lit("/"))).otherwise(folder), target)))


def page_edges(pages: DataFrame) -> DataFrame:
    """(src, dst) of canonical links and refreshes of pages (url, html)."""
    links = F.filter(F.regexp_extract_all("html", F.lit(r"(?is)<link\b[^>]*>"), F.lit(0)),
                     lambda t: t.rlike(r"(?is)\brel\s*=\s*[\"']?\s*canonical\b"))
    moves = F.filter(F.regexp_extract_all("html", F.lit(r"(?is)<meta\b[^>]*>"), F.lit(0)),
                     lambda t: t.rlike(r"(?is)\bhttp-equiv\s*=\s*[\"']?\s*refresh\b"))
    targets = F.concat(
        F.transform(links, lambda t: _attribute(t, "href")),
        F.transform(moves, lambda t: F.replace(F.regexp_extract(t, r"(?is)\burl\s*=\s*['\"]?([^\"'>\s]+)", 1),
                                               F.lit("&amp;"), F.lit("&"))))
    return (pages.where("url is not null").select(F.col("url").alias("src"), F.explode(targets).alias("t"))
            .select("src", _absolute(F.col("t"), F.col("src")).alias("dst")).where("dst is not null"))


def best_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Struct (size, allow, rule, verdict) of the longest rule that fits, or null.

    A rule fits its host and its subdomains if the path starts with the rule's;
    of equally long ones an allow wins.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    fits = [F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path),
                   F.struct(F.lit(len(r.name)).alias("size"), F.lit(int(r.action == "allow")).alias("allow"),
                            F.lit(r.name).alias("rule"), F.lit(r.action).alias("verdict"))) for r in rules]
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast(
        "struct<size:int,allow:int,rule:string,verdict:string>")


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, redirects: DataFrame | None = None, *,
                keep: str = "page_id") -> DataFrame:
    """(page_id, host, path, rule, verdict, alias_group) of every row of ``pages``.

    A null url or one without ``://`` has an empty host and path, no rule and no
    aliases: allow.  Pages that repeat a url get the same verdict each; a null
    html has no links.  ``redirects`` has (src, dst) addresses; null ends are left
    out.  alias_group is the least vertex of the component.  Other columns are
    not read.  No rows give no rows.
    """
    rows = pages.select(F.col(keep), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    linked = page_edges(rows)
    if redirects is not None:
        linked = linked.union(redirects.select(F.col("src").cast("string"), F.col("dst").cast("string"))
                              .where("src is not null and dst is not null"))
    linked = linked.checkpoint()
    urls = rows.select("url").union(linked.select("src")).union(linked.select("dst")).where("url is not null").distinct()
    forms = urls.select(F.col("url").alias("src"), F.concat(F.lit("canonical "), canonical_form(F.col("url"))).alias("dst"))
    comps = connected_components(linked.union(forms))
    best = best_rule(url_host(F.col("url")), url_path(F.col("url")), rules)
    judged = urls.withColumn("best", best).join(comps, F.col("url") == F.col("node"), "left").select(
        "url", F.coalesce("component", "url").alias("group"), F.col("best.allow").alias("allow"))
    # 1 if any alias is allowed by a rule, 0 if none is and one is blocked.
    decided = judged.groupBy("group").agg(F.max("allow").alias("decision"))
    decided = judged.select("url", "group").join(decided, "group").withColumnRenamed("url", "known")
    out = rows.select(keep, "url").withColumn("host", url_host(F.col("url"))).withColumn("path", url_path(F.col("url")))
    out = out.withColumn("best", best_rule(F.col("host"), F.col("path"), rules))
    out = out.join(decided, out["url"] == decided["known"], "left")
    spread = F.when(F.col("decision") == 0, F.lit("block")).otherwise("allow")
    return out.select(keep, "host", "path", F.col("best.rule").alias("rule"),
                      F.coalesce("best.verdict", spread).alias("verdict"), F.col("group").alias("alias_group"))
