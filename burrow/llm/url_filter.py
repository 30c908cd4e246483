"""URL filters with redirect equivalence (operator 1), with DataFrame operations alone.

Rules name a host and the start of a path; a rule fits the host and all its subdomains, and the longest rule that fits
decides. Urls that no rule fits take part by equivalence: redirects and canonical links join urls to components, over
which a block spreads to all aliases, unless an explicit allow in the component takes precedence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from burrow.llm.components import components
from burrow.llm.store import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What holds no links though it may look so, elements that may hold one, and the value of an attribute, with its quotes.
SILENT = r"(?is)<!--.*?(?:-->|\z)|<(script|style|template|noscript)\b.*?(?:</\1\s*>|\z)"
ELEMENTS = r"(?is)<(?:link|meta)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>"
VALUE = r"(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)"
#: The named references that urls need.
NAMED = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "amp": "&"}


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, with A-Z lower-cased; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def plain_path(path: Column) -> Column:
    """A path without . and .. segments, as a browser asks for it."""
    parts = F.split(path, "/")
    kept = F.aggregate(
        F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))),
        F.array().cast("array<string>"),
        lambda held, part: F.when(part == "..", F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(0)))).when(part == ".", held).otherwise(F.concat(held, F.array(part))),
    )
    whole = F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(path.rlike(r"/\.\.?$") & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit("")))
    return F.when(F.contains(path, F.lit("/.")), whole).when(path == "", F.lit("/")).otherwise(path)


def node_of(url: Column) -> Column:
    """The url that its server sees: host in lower case, http and https alike, no default port, no fragment, a slash for no
    path, no dot segments."""
    query = F.regexp_extract(url, r"^[^?#]*(\?[^#]*)?", 1)
    host = F.when(url.rlike("(?i)^https:"), F.regexp_replace(host_of(url), ":443$", "")).otherwise(F.regexp_replace(host_of(url), ":80$", ""))
    return F.when(F.instr(url, "://") > 0, F.concat(host, plain_path(path_of(url)), query))


def decoded(text: Column) -> Column:
    """Text with its character references decoded: numbers, and the names that urls need."""

    def one(part: Column) -> Column:
        shown = F.regexp_extract(part, r"^&#([0-9]{1,7}|[xX][0-9a-fA-F]{1,6});", 1)
        code = F.when(F.lower(F.substring(shown, 1, 1)) == "x", F.conv(F.substring(shown, 2, 6), 16, 10)).otherwise(shown).cast("long")
        known = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        sign = F.decode(F.unhex(F.lpad(F.hex(F.when(known, code).otherwise(F.lit(0xFFFD))), 8, "0")), "UTF-32")
        return F.when(shown == "", part).otherwise(F.concat(sign, F.regexp_replace(part, "^&#[0-9a-fA-FxX]+;", "")))

    out = F.when(F.contains(text, F.lit("&#")), F.array_join(F.transform(F.split(text, "(?=&#)"), one), "")).otherwise(text)
    for name, sign in NAMED.items():
        out = F.regexp_replace(out, F.lit(f"&{name};"), F.lit(sign))
    return out


def links_in(page: Column) -> Column:
    """The links of all canonical and refresh elements of a page, without those in comments and scripts."""
    elements = F.regexp_extract_all(F.regexp_replace(page, SILENT, ""), F.lit(ELEMENTS), F.lit(0))

    def value(element: Column, name: str) -> Column:
        return F.regexp_replace(F.regexp_extract(element, rf"(?i)\s{name}\s*=\s*{VALUE}", 1), "^[\"']|[\"']$", "")

    def link(element: Column) -> Column:
        canonical = value(element, "rel").rlike(r"(?i)(?:^|\s)canonical(?:\s|$)")
        refresh = value(element, "http-equiv").rlike(r"(?i)^\s*refresh\s*$")
        target = F.regexp_extract(decoded(value(element, "content")), r"(?i)\burl\s*=\s*[\"']?([^\"']+)", 1)
        return F.when(canonical, decoded(value(element, "href"))).when(refresh, target).otherwise(F.lit(""))

    found = F.transform(elements, lambda e: F.trim(link(e)))
    return F.when(page.rlike("(?i)canonical|refresh"), F.array_distinct(F.filter(found, lambda x: x != ""))).otherwise(F.array().cast("array<string>"))


def link_target(url: Column, link: Column) -> Column:
    """The absolute url of a link found on `url`: absolute, without a scheme, from the root, a query or fragment of the
    page itself, or beside the page. Dot segments are left to node_of()."""
    scheme = F.regexp_extract(url, r"^([^:]*)://", 1)
    root = F.regexp_extract(url, r"^([^:]*://[^/?#]*)", 1)
    page = F.regexp_extract(url, r"^([^?#]*)", 1)
    folder = F.regexp_extract(url, r"^([^:]*://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    return (
        F.when(link.isNull() | (link == ""), None)
        .when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link.startswith("?") | link.startswith("#"), F.concat(page, link))
        .otherwise(F.concat(folder, link))
    )


def rule_of(url: Column, rules: list[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits, or null. Rules: (allow or block, host, path), at most 1000.

    Of equally long rules an allow comes first, then the smaller text.
    """
    if len(rules) > 1000:
        raise ValueError("more than 1000 rules: pass them to matched() as a table")
    ranked = sorted({(len(h) + len(p), v == "allow", h, p) for v, h, p in rules}, key=lambda r: (-r[0], not r[1], r[2] + r[3]))
    host, path, out = F.concat(F.lit("."), host_of(url)), path_of(url), F.lit(None).cast("struct<rule:string,verdict:string>")
    for _, allow, h, p in reversed(ranked):
        found = F.struct(F.lit(h + p).alias("rule"), F.lit("allow" if allow else "block").alias("verdict"))
        out = F.when(host.endswith("." + h) & path.startswith(p), found).otherwise(out)
    return out


def matched(urls: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """urls with the column `match` from a table of rules (verdict, host, path) of any size.

    Urls are joined to rules on the suffixes of their hosts; both sides keep to the keys, so a rule for a hot host is
    an ordinary skewed join. `urls` must have the unique column __row.
    """
    host = host_of(F.col(url_col))
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    keyed = urls.select("__row", path_of(F.col(url_col)).alias("__path"), F.explode(F.array_distinct(suffixes)).alias("host"))
    fits = keyed.join(rules.select("host", "path", "verdict"), "host").where(F.col("__path").startswith(F.col("path")))
    rank = F.struct((F.length("host") + F.length("path")).alias("n"), (F.col("verdict") == "allow").alias("a"))
    best = fits.groupBy("__row").agg(F.min_by(F.struct(F.concat("host", "path").alias("rule"), "verdict"), F.struct(-rank.n, ~rank.a, F.concat("host", "path"))).alias("match"))
    return urls.join(best, "__row", "left")


def judge(
    pages: DataFrame,
    rules: list[tuple[str, str, str]] | DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str | None = "html",
    redirects: DataFrame | None = None,
) -> DataFrame:
    """page_id, url, host, path, rule (null if none fits) and verdict (allow or block) of every row.

    rules: (allow or block, host, path), as a list or as a table (verdict, host, path). Links come from all canonical and
    refresh elements of `html_col` outside comments and scripts, and from `redirects` (from_url, to_url). A url without a rule is allowed if a url
    of its component has an allow rule, else blocked if one has a block rule, else allowed; rules of link targets
    that are no rows themselves count as well. Null urls and urls without :// have empty host and path, no rule and no
    alias. Repeated rows are each judged; other columns are not read. An empty table gives no rows.
    """
    url = F.col(url_col).cast("string")
    columns = [F.col(id_col).alias("page_id"), url.alias("url")]
    rows = pages.select(*columns, host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"))
    links = [redirects.select(F.col("from_url").alias("a"), F.col("to_url").alias("b"))] if redirects is not None else []
    if html_col:
        named = pages.select(url.alias("a"), F.explode(links_in(F.coalesce(F.col(html_col).cast("string"), F.lit("")))).alias("link"))
        links.append(named.select("a", link_target(F.col("a"), F.col("link")).alias("b")))
    group, known = None, None
    if links:
        edges = links[0] if len(links) == 1 else links[0].unionByName(links[1])
        edges = edges.where("a IS NOT NULL AND b IS NOT NULL")
        group = components(edges.select(node_of(F.col("a")).alias("a"), node_of(F.col("b")).alias("b")), "a", "b")
        known = _component_verdicts(group, rules)
    own = _with_match(rows, rules).select("page_id", "url", "host", "path", "node", F.col("match.rule").alias("rule"), F.col("match.verdict").alias("own"))
    if group is None:
        return own.select("page_id", "url", "host", "path", "rule", F.coalesce("own", F.lit("allow")).alias("verdict"))
    return own.join(known, "node", "left").select(
        "page_id", "url", "host", "path", "rule", F.coalesce("own", "spread", F.lit("allow")).alias("verdict"), F.coalesce("component", "node").alias("component")
    )


def _with_match(rows: DataFrame, rules: list | DataFrame) -> DataFrame:
    if isinstance(rules, DataFrame):
        return matched(written(rows.withColumn("__row", F.monotonically_increasing_id()), "urls"), rules)
    return rows.withColumn("match", rule_of(F.col("url"), rules))


def _component_verdicts(group: DataFrame, rules: list | DataFrame) -> DataFrame:
    """(node, component, spread): what the rules of a component's urls say about those without one."""
    nodes = _with_match(group.withColumn("url", F.concat(F.lit("http://"), F.col("node"))), rules)
    said = nodes.select("node", "component", F.col("match.verdict").alias("verdict"))
    spread = said.groupBy("component").agg(F.min("verdict").alias("spread"))  # allow comes before block
    return written(said.select("node", "component").join(spread, "component").select("node", "component", "spread"), "verdicts")
