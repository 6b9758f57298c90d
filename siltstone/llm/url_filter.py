"""URL verdicts: host and path rules, and block decisions spread to aliases over redirect and canonical-link edges.

Everything is DataFrame functions: no Python runs on the executors.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.batches import spare
from siltstone.operators.graph import connected_components
from siltstone.operators.joins import join_checked
from siltstone.session import discard, materialize

#: The rules of the query: verdict, then host and path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

#: Rules up to which each url is held against one after another in the scan; more are joined by host.
INLINE_RULES = 64

#: What a browser doesn't read as tags; what isn't closed goes on to the end of the page.
UNREAD = r"(?is)<!--.*?(?:-->|\z)|<script[ \t\n\f\r/>].*?(?:</script|\z)|<style[ \t\n\f\r/>].*?(?:</style|\z)"
BODY = r"(?i)<body[ \t\n\f\r/>]"
TAG = r"(?i)<(?:link|meta)[ \t\n\f\r/][^<>]*>"
ATTRIBUTE = r"""([^ \t\n\f\r"'<>/=]+)[ \t\n\f\r]*=[ \t\n\f\r]*(?:"([^"]*)"|'([^']*)'|([^ \t\n\f\r"'=<>`]+))"""
REFRESH = r"""(?is)^ *[0-9.]* *[;, ] *url *= *(?:"([^"]*)|'([^']*)|([^ "'][^ ]*))"""
ABSOLUTE = r"^[A-Za-z][A-Za-z0-9+.-]*:"


def _lower(c: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(c, ascii_uppercase, ascii_lowercase)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


def host_of(url: Column) -> Column:
    """What stands after the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null and without ://."""
    return F.coalesce(_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    """What stands after the host up to ?, # or the end; empty for null and without ://."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x computed once however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _without_dots(path: Column) -> Column:
    """The path with its . and .. segments carried out."""
    up = lambda a: F.when(F.size(a) > 1, F.slice(a, 1, F.size(a) - 1)).otherwise(a)
    step = lambda a, s: F.when(s == "..", up(a)).when(s == ".", a).otherwise(F.concat(a, F.array(s)))
    closed = lambda parts: F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(parts, F.array(F.lit("")))).otherwise(parts)
    done = F.array_join(F.aggregate(_let(F.split(path, "/", -1), closed), F.expr("cast(array() as array<string>)"), step), "/")
    return F.when(F.contains(path, F.lit("/.")), done).otherwise(path)


def node_of(url: Column) -> Column:
    """The form in which urls are nodes: scheme and host in lower case, / for no path, . and .. carried out, no fragment.

    Null for null and for what has no scheme and host. A query stays, as it may name another page; http and https, and
    hosts with and without www, are told apart unless an edge joins them.
    """

    def form(u: Column) -> Column:
        scheme = _lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
        path = _let(path_of(u), lambda p: F.when(p == "", F.lit("/")).otherwise(_without_dots(p)))
        query = F.regexp_extract(_rest(u), r"^[^?#]*(\?[^#]*)", 1)
        return F.when((scheme != "") & (host_of(u) != ""), F.concat(scheme, F.lit("://"), host_of(u), path, query))

    return _let(url, form)


def resolve(target: Column, url: Column) -> Column:
    """The url that a link on the page of url leads to; null for an empty one, a fragment, and where url has no host."""
    scheme = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)
    origin = F.concat(scheme, F.lit("://"), host_of(url))
    folder = F.regexp_extract(path_of(url), r"(?s)^(.*/)", 1)

    def lead(t: Column) -> Column:
        found = (
            F.when((t == "") | t.startswith("#"), F.lit(None).cast("string"))
            .when(t.startswith("//"), F.concat(scheme, F.lit(":"), t))
            .when(t.startswith("/"), F.concat(origin, t))
            .when(t.startswith("?"), F.concat(origin, path_of(url), t))
            .otherwise(F.concat(origin, F.when(folder == "", F.lit("/")).otherwise(folder), t))
        )
        return F.when(t.rlike(ABSOLUTE), t).when(scheme != "", found)

    return _let(F.replace(F.trim(F.regexp_replace(target, r"[\t\n\f\r]", " ")), F.lit("&amp;"), F.lit("&")), lead)


def page_edges(pages: DataFrame) -> DataFrame:
    """a and b, nodes that link rel=canonical and meta http-equiv=refresh in the heads of pages (url, html) join.

    Read are tags before <body that no comment, script or style holds, all of them. The cost is in proportion to a page:
    what isn't closed is passed over to the end once.
    """
    head = F.split(F.regexp_replace(F.coalesce("html", F.lit("")), UNREAD, " "), BODY, 2)[0]
    tags = pages.select("url", F.explode(F.regexp_extract_all(head, F.lit(TAG), F.lit(0))).alias("tag")).where(F.lower("tag").rlike("canonical|refresh"))

    def target(inner: Column) -> Column:
        groups = [F.regexp_extract_all(inner, F.lit(ATTRIBUTE), F.lit(k)) for k in range(1, 5)]
        return _let(F.struct(*[g.alias(f"g{k}") for k, g in enumerate(groups, 1)]), chosen)

    def chosen(g: Column) -> Column:
        names = F.transform(g["g1"], F.lower)

        def attribute(name: str) -> Column:
            at = lambda n: F.when(n > 0, F.concat(*[F.coalesce(F.get(g[f"g{k}"], n.cast("int") - 1), F.lit("")) for k in (2, 3, 4)])).otherwise("")
            return _let(F.array_position(names, name), at)

        canonical = (kind == "link") & F.array_contains(F.split(F.lower(attribute("rel")), r"[ \t\n\f\r]+"), "canonical")
        refresh = (kind == "meta") & (F.lower(F.trim(attribute("http-equiv"))) == "refresh")
        content = _let(attribute("content"), lambda c: F.concat(*[F.regexp_extract(c, REFRESH, k) for k in (1, 2, 3)]))
        return F.when(canonical, attribute("href")).when(refresh, content)

    kind = F.lower(F.substring("tag", 2, 4))
    ends = F.struct(node_of(F.col("url")).alias("a"), node_of(resolve(target(F.regexp_replace("tag", "^<[A-Za-z]+", "")), F.col("url"))).alias("b"))
    linked = tags.select(F.explode(F.array(ends)).alias("edge"))  # so that no filter takes the expression in again
    return linked.select("edge.a", "edge.b").where("a IS NOT NULL AND b IS NOT NULL AND a <> b")


def _order(rules: Sequence[tuple[str, str]]) -> list[tuple[str, str]]:
    """Longest first; of equal length allow first, then by the rule."""
    return sorted({(v, r) for v, r in rules}, key=lambda x: (-len(x[1]), x[0] != "allow", x[1]))


def with_rule(urls: DataFrame, rules: Sequence[tuple[str, str]], host: str = "host", path: str = "path") -> DataFrame:
    """Add rule and rule_verdict, those of the longest rule that fits; null if none does.

    A rule's host is what stands before its first /. It fits that host and its subdomains, if the path starts with the
    rule's. Of rules of one length, allow goes before block. Few rules are conditions within the scan. More are joined
    with the distinct hosts and paths by the ends of hosts, which have as many labels as a rule's host has at most.
    """
    ordered = _order(rules)
    if len(ordered) <= INLINE_RULES:
        fits = []
        for verdict, rule in ordered:
            own, slash, rest = rule.partition("/")
            fit = ((F.col(host) == own) | F.col(host).endswith("." + own)) & F.col(path).startswith(slash + rest)
            fits.append((fit, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
        none = F.lit(None).cast("struct<rule:string,verdict:string>")
        best = reduce(lambda c, x: F.when(x[0], x[1]).otherwise(c), reversed(fits), none)
        found = spare("best", urls)
        return urls.withColumn(found, best).withColumn("rule", F.col(f"{found}.rule")).withColumn("rule_verdict", F.col(f"{found}.verdict")).drop(found)
    spark = urls.sparkSession
    most = max(r.partition("/")[0].count(".") + 1 for _, r in ordered)
    listed = spark.createDataFrame([(r.partition("/")[0], "".join(r.partition("/")[1:]), r, v, k) for k, (v, r) in enumerate(ordered)], "_end string, _start string, rule string, rule_verdict string, _place long")
    keys = urls.select(F.col(host).alias("_h"), F.col(path).alias("_p")).distinct()
    labels = F.split("_h", r"\.", -1)
    ends = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(most))), lambda k: F.array_join(F.slice(labels, -k, k), "."))
    near = join_checked(keys.select("_h", "_p", F.explode(ends).alias("_end")), listed, ["_end"], "inner", max(2 * len(r) for _, r in ordered) + 64)
    best = near.where(F.col("_p").startswith(F.col("_start"))).groupBy("_h", "_p").agg(F.min_by(F.struct("rule", "rule_verdict"), "_place").alias("_best"))
    joined = urls.join(best, (F.col(host) == F.col("_h")) & (F.col(path) == F.col("_p")), "left")
    return joined.withColumn("rule", F.col("_best.rule")).withColumn("rule_verdict", F.col("_best.rule_verdict")).drop("_h", "_p", "_best")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and through of every row of pages (page_id, url, html).

    A url that a rule fits has that rule's verdict, allow included. Any other is blocked if it is an alias of a url that
    a rule blocks: if edges, in any direction and over any number of steps, join the two. Aliases needn't be pages of the
    table. An allowed url within such a class stays allowed, and doesn't clear the others of the class. What is left is
    allowed. through is the smallest blocked url of the class if that decided, else null.

    Edges are those of page_edges and the rows of redirects (from_url, to_url), such as a crawler's log. A null or empty
    url has empty host and path and is allowed; null html has no edges; repeated rows are judged each; other columns are
    left out.
    """
    edges = page_edges(pages)
    if redirects is not None:
        edges = edges.union(redirects.select(node_of(F.col("from_url")), node_of(F.col("to_url"))))
    classes = connected_components(edges, last_edges=0)
    judged = with_rule(classes.select("node", "component", host_of(F.col("node")).alias("host"), path_of(F.col("node")).alias("path")), rules)
    judged = materialize(judged, "judged")
    blocked = judged.where("rule_verdict = 'block'").groupBy("component").agg(F.min("node").alias("through"))
    width = judged.agg(F.max(F.octet_length("node"))).first()[0] or 0
    blocked = materialize(blocked, "blocked")
    spread = materialize(join_checked(judged.where("rule IS NULL OR rule_verdict = 'block'").select("node", "component"), blocked, ["component"], "inner", 2 * width + 64).select(F.col("node").alias("_node"), "through"), "spread")
    discard(blocked, judged)
    urls = pages.select("page_id", F.col("url").alias("_url"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), node_of(F.col("url")).alias("_node"))
    rows = join_checked(with_rule(urls, rules), spread, ["_node"], "left", 2 * width + 64)
    through = F.when(F.col("rule").isNull(), F.col("through"))
    verdict = F.coalesce("rule_verdict", F.when(through.isNotNull(), F.lit("block")), F.lit("allow"))
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), through.alias("through"))


def _sql(rules: Sequence[tuple[str, str]] = RULES) -> str:
    """The same rows in DuckDB; classes by reaching out from blocked urls."""

    def q(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def rest(u: str) -> str:
        return f"CASE WHEN instr({u}, '://') > 0 THEN substr({u}, instr({u}, '://') + 3) END"

    def lower(x: str) -> str:
        return f"translate({x}, '{ascii_uppercase}', '{ascii_lowercase}')"

    def host(u: str) -> str:
        return f"coalesce({lower(f"regexp_extract({rest(u)}, '^[^/?#]*', 0)")}, '')"

    def path(u: str) -> str:
        return f"coalesce(regexp_extract({rest(u)}, '^[^/?#]*([^?#]*)', 1), '')"

    def scheme(u: str) -> str:
        return f"regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)"

    def dots(p: str) -> str:
        parts = f"string_split({p}, '/')"
        closed = f"CASE WHEN {parts}[-1] IN ('.', '..') THEN list_append({parts}, '') ELSE {parts} END"
        step = "lambda a, s: CASE WHEN s[1] = '..' THEN CASE WHEN len(a) > 1 THEN a[1:len(a) - 1] ELSE a END WHEN s[1] = '.' THEN a ELSE list_concat(a, s) END"
        return f"CASE WHEN contains({p}, '/.') THEN array_to_string(list_reduce(list_transform({closed}, lambda x: [x]), {step}), '/') ELSE {p} END"

    def node(u: str) -> str:
        full = f"CASE WHEN {path(u)} = '' THEN '/' ELSE {dots(path(u))} END"
        query = f"coalesce(regexp_extract({rest(u)}, '^[^?#]*(\\?[^#]*)', 1), '')"
        return f"CASE WHEN {scheme(u)} <> '' AND {host(u)} <> '' THEN {lower(scheme(u))} || '://' || {host(u)} || ({full}) || {query} END"

    def attribute(name: str) -> str:
        at = f"list_position(g1, '{name}')"
        return "coalesce(" + " || ".join(f"coalesce(g{k}[{at}], '')" for k in (2, 3, 4)) + ", '')"

    fits = "".join(f" WHEN (host = {q(r.partition('/')[0])} OR ends_with(host, {q('.' + r.partition('/')[0])})) AND starts_with(path, {q(''.join(r.partition('/')[1:]))}) THEN {{}}{k}" for k, (_, r) in enumerate(_order(rules)))
    place = f"CASE{fits.replace('{}', '')} END"
    listed = ", ".join(f"({k}, {q(v)}, {q(r)})" for k, (v, r) in enumerate(_order(rules)))
    content = " || ".join(f"coalesce(regexp_extract({attribute('content')}, {q(REFRESH)}, {k}), '')" for k in (1, 2, 3))
    return f"""
WITH RECURSIVE rules(place, verdict, rule) AS (VALUES {listed}),
tags AS (SELECT url, unnest(regexp_extract_all(regexp_split_to_array(regexp_replace(coalesce(html, ''), {q(UNREAD)}, ' ', 'g'), {q(BODY)})[1], {q(TAG)}, 0)) AS tag FROM pages),
parts AS (SELECT url, lower(substr(tag, 2, 4)) AS kind, regexp_replace(tag, '^<[A-Za-z]+', '') AS inn FROM tags),
named AS (SELECT url, kind, list_transform(regexp_extract_all(inn, {q(ATTRIBUTE)}, 1), lambda x: lower(x)) AS g1, regexp_extract_all(inn, {q(ATTRIBUTE)}, 2) AS g2, regexp_extract_all(inn, {q(ATTRIBUTE)}, 3) AS g3, regexp_extract_all(inn, {q(ATTRIBUTE)}, 4) AS g4 FROM parts),
targets AS (SELECT url, CASE
    WHEN kind = 'link' AND list_contains(regexp_split_to_array(lower({attribute('rel')}), '[ \t\n\f\r]+'), 'canonical') THEN {attribute('href')}
    WHEN kind = 'meta' AND lower(trim({attribute('http-equiv')})) = 'refresh' THEN {content} END AS raw FROM named),
cleaned AS (SELECT url, replace(trim(regexp_replace(raw, '[\t\n\f\r]', ' ', 'g')), '&amp;', '&') AS t FROM targets),
resolved AS (SELECT url, CASE
    WHEN t = '' OR starts_with(t, '#') THEN NULL
    WHEN regexp_matches(t, '{ABSOLUTE}') THEN t
    WHEN {scheme('url')} = '' OR url IS NULL THEN NULL
    WHEN starts_with(t, '//') THEN {scheme('url')} || ':' || t
    WHEN starts_with(t, '/') THEN {scheme('url')} || '://' || {host('url')} || t
    WHEN starts_with(t, '?') THEN {scheme('url')} || '://' || {host('url')} || {path('url')} || t
    ELSE {scheme('url')} || '://' || {host('url')} || CASE WHEN regexp_extract({path('url')}, '(?s)^(.*/)', 1) = '' THEN '/' ELSE regexp_extract({path('url')}, '(?s)^(.*/)', 1) END || t END AS target FROM cleaned),
links AS (SELECT {node('url')} AS a, {node('target')} AS b FROM resolved),
edges AS (SELECT a, b FROM links WHERE a <> b UNION SELECT b, a FROM links WHERE a <> b),
nodes AS (SELECT a AS node, {host('a')} AS host, {path('a')} AS path FROM (SELECT DISTINCT a FROM edges)),
bad AS (SELECT node FROM (SELECT node, {place} AS place FROM nodes) JOIN rules USING (place) WHERE verdict = 'block'),
reach(node, root) AS (SELECT node, node FROM bad UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.node),
spread AS (SELECT node, min(root) AS through FROM reach WHERE node NOT IN (SELECT node FROM (SELECT node, {place} AS place FROM nodes) JOIN rules USING (place) WHERE verdict = 'allow') GROUP BY node),
urls AS (SELECT page_id, {host('url')} AS host, {path('url')} AS path, {node('url')} AS node FROM pages),
placed AS (SELECT *, {place} AS place FROM urls)
SELECT page_id, host, path, rules.rule, coalesce(rules.verdict, CASE WHEN through IS NOT NULL THEN 'block' END, 'allow') AS verdict,
    CASE WHEN rules.rule IS NULL THEN through END AS through
FROM placed LEFT JOIN rules USING (place) LEFT JOIN spread USING (node)
"""


ORACLE = _sql()
