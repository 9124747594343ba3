"""URL filter: rules first, then a path-template tree with smoothed labelled purity.

DataFrame functions only. Urls of one host form a tree of path segments. Segments with
digits generalise to wildcards at once; then, level by level from the root to the deepest path, rare children of
a node with many children become one wildcard, and labelled children whose share of blocked
urls doesn't differ significantly from the pooled share of those siblings that lean the same
way are merged into one (``*block`` or ``*allow``). A template is rejected if its blocked share, smoothed by its host's, reaches one half.

The tree is built from one row per (host, pattern) with counts, far fewer than urls, so a host
that holds a third of all urls weighs no more than any other after the first, map-side
aggregation. Labels are the verdicts of the rules, unless the caller has others.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.llm.common import landed

#: (verdict, host and path) of the contract; a rule holds for its host and all subdomains.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class TreeOptions:
    """Parameters of the tree.

    fan: a node with more children than this generalises those below ``rare`` of its urls.
    z: children merge if the two-sided test of their share against the pool stays below it.
    prior, coverage, strength: share assumed of an unlabelled url, its weight as a part of
    the host's urls, and the weight of the host's share in a template's.
    """

    fan: int = 12
    rare: float = 0.02
    z: float = 1.96
    prior: float = 0.25
    coverage: float = 0.5
    strength: float = 2.0
    threshold: float = 0.5


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for a null url or one without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, or nulls."""
    rule = verdict = None
    for kind, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, tail = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + tail)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    return (rule, verdict) if rules else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def pattern(path: Column) -> Column:
    """The path's segments; one with a digit is ``*``, with its extension if that has none."""
    wild = lambda s: F.when(s.rlike("[0-9]"), F.concat(F.lit("*"), F.regexp_extract(s, r"\.[A-Za-z]+$", 0))).otherwise(s)
    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), wild)


def tree(counts: DataFrame, options: TreeOptions = TreeOptions()) -> DataFrame:
    """From (host, raw, n, labelled, blocked), one row per host and raw pattern, the same with ``template``.

    A level works on those paths only that reach it and share their start with another; the others are done.
    A merge can bring paths together whose starts then agree, so this is asked anew at each level.
    """
    o, t, done, level = options, counts.withColumn("t", F.col("raw")), None, 0
    while True:
        level += 1
        start = F.when(F.size("t") >= level, F.slice("t", 1, level - 1))
        t = t.withColumn("up", start)
        alone = t.where("up is not null").groupBy("host", "up").agg(F.count("*").alias("sharing"))
        t = landed(t.join(alone, ["host", "up"], "left"), "url-level")
        settled = t.where("sharing is null or sharing = 1").drop("up", "sharing")
        done = settled if done is None else done.unionByName(settled)
        t = t.where("sharing > 1").drop("sharing")
        if t.isEmpty():
            break
        t = t.withColumn("child", F.get("t", F.lit(level - 1)))
        sums = [F.sum(c).alias(c) for c in ("n", "labelled", "blocked")]
        nodes = t.groupBy("host", "up", "child").agg(*sums).withColumn("lean", 2 * F.col("blocked") >= F.col("labelled"))
        nodes = landed(nodes, "url-nodes")
        size = nodes.groupBy("host", "up").agg(F.count("*").alias("fan"), F.sum("n").alias("all_n"))
        pool = nodes.groupBy("host", "up", "lean").agg(F.sum("labelled").alias("all_labelled"), F.sum("blocked").alias("all_blocked"))
        share = F.try_divide(F.col("all_blocked"), F.col("all_labelled"))
        gap = F.col("blocked") - F.col("labelled") * share
        alike = (F.col("labelled") > 0) & (gap * gap <= o.z**2 * F.col("labelled") * share * (1 - share))
        rare = (F.col("fan") > o.fan) & (F.col("n") < o.rare * F.col("all_n"))
        marked = nodes.join(size, ["host", "up"]).join(pool, ["host", "up", "lean"]).withColumn("rare", rare).withColumn(
            "alike", F.coalesce(alike, F.lit(False)) & ~rare,
        )
        several = marked.groupBy("host", "up", "lean").agg(F.count_if("alike").alias("n_alike"))
        merged = (
            marked.where("rare or alike").join(several, ["host", "up", "lean"])
            .select(
                "host", "up", "child",
                F.when(F.col("rare"), "*").when(
                    F.col("n_alike") > 1, F.when(F.col("lean"), "*block").otherwise("*allow"),
                ).otherwise(F.col("child")).alias("to"),
            )
        )
        swap = F.transform("t", lambda s, i: F.when((i == level - 1) & F.col("to").isNotNull(), F.col("to")).otherwise(s))
        t = t.join(merged, ["host", "up", "child"], "left").withColumn("t", swap).drop("up", "child", "to")
    return done.withColumnRenamed("t", "template")


def judge(pages: DataFrame, rules=RULES, labels: DataFrame | None = None, options: TreeOptions = TreeOptions(), id_col: str = "page_id") -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity of every row of ``pages``.

    ``labels`` (url, blocked boolean) replaces the rules' verdicts as evidence. Null urls and
    those without ``://`` have host and path empty, no rule, and the method's verdict on that
    empty host (allowed without other evidence). Repeated rows each get a row and count as
    evidence each; null ids stay; other columns are ignored, whatever their names; an empty
    table gives an empty result.
    """
    o = options
    host, path = parts(F.col("url"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    seen = pages.select(F.col(id_col), F.col("url")).withColumns({"host": host, "path": path})
    seen = seen.withColumns({"rule": rule, "ruled": verdict, "raw": pattern(F.col("path"))})
    if labels is None:
        evidence = seen.select(
            "host", "raw", F.lit(1).alias("n"), F.col("ruled").isNotNull().cast("int").alias("l"),
            F.coalesce(F.col("ruled") == "block", F.lit(False)).cast("int").alias("b"),
        )
    else:
        lh, lp = parts(F.col("url"))
        marks = labels.select(
            lh.alias("host"), pattern(lp).alias("raw"), F.lit(0).alias("n"), F.lit(1).alias("l"),
            F.coalesce(F.col("blocked").cast("int"), F.lit(0)).alias("b"),
        )
        evidence = seen.select("host", "raw", F.lit(1).alias("n"), F.lit(0).alias("l"), F.lit(0).alias("b")).unionByName(marks)
    counts = evidence.groupBy("host", "raw").agg(F.sum("n").alias("n"), F.sum("l").alias("labelled"), F.sum("b").alias("blocked"))
    grown = tree(landed(counts, "url-counts"), o)
    of_host = grown.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("labelled").alias("hl"), F.sum("blocked").alias("hb"))
    leaves = grown.groupBy("host", "template").agg(F.sum("labelled").alias("tl"), F.sum("blocked").alias("tb"))
    weight = o.coverage * F.greatest(F.col("hn"), F.col("hl"))
    share = (F.col("hb") + weight * o.prior) / (F.col("hl") + weight)
    purity = (F.col("tb") + o.strength * share) / (F.col("tl") + o.strength)
    judged = leaves.join(of_host, "host").select("host", "template", F.round(purity, 9).alias("purity"))
    known = grown.select("host", "raw", "template").join(judged, ["host", "template"])
    out = seen.join(known, ["host", "raw"], "left")
    said = F.coalesce("ruled", F.when(F.col("purity") >= o.threshold, "block").otherwise("allow"))
    return out.select(
        id_col, "host", "path", "rule", said.alias("verdict"), F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"),
        "purity",
    )


def oracle(options: TreeOptions = TreeOptions(), rules=RULES, levels: int = 8) -> str:
    """The same in DuckDB SQL over the view ``pages``, written out for paths of up to ``levels`` segments; a deeper one is an error."""
    o = options
    cases = {"rule": "", "ruled": ""}
    for kind, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, tail = text.partition("/")
        fits = f"(host = '{name}' or suffix(host, '.{name}')) and prefix(path, '{slash + tail}')"
        cases["rule"] += f" when {fits} then '{text}'"
        cases["ruled"] += f" when {fits} then '{kind}'"
    steps, last = [], "t0"
    for k in range(1, levels + 1):
        steps.append(f"""
        n{k} as (select host, t[:{k - 1}] as up, t[{k}] as child, sum(n) as n, sum(labelled) as l, sum(blocked) as b, 2 * sum(blocked) >= sum(labelled) as lean from {last} where len(t) >= {k} group by all),
        m{k} as (select *, count(*) over (partition by host, up) > {o.fan} and n < {o.rare}e0 * sum(n) over (partition by host, up) as rare,
            sum(l) over (partition by host, up, lean) as al, sum(b) over (partition by host, up, lean) as ab from n{k}),
        a{k} as (select *, not rare and l > 0 and coalesce((b - l * (ab::double / al)) * (b - l * (ab::double / al)) <= {o.z**2!r}e0 * l * (ab::double / al) * (1 - ab::double / al), false) as alike from m{k}),
        s{k} as (select *, count(*) filter (where alike) over (partition by host, up, lean) as n_alike from a{k}),
        t{k} as (select x.host, x.raw, case when s.child is null or not (s.rare or (s.alike and s.n_alike > 1)) then x.t else list_concat(list_concat(x.t[:{k - 1}], [case when s.rare then '*' when s.lean then '*block' else '*allow' end]), x.t[{k + 1}:]) end as t, x.n, x.labelled, x.blocked
            from {last} x left join s{k} s on x.host = s.host and x.t[:{k - 1}] = s.up and x.t[{k}] = s.child and len(x.t) >= {k})""")
        last = f"t{k}"
    return f"""
    with u as (select page_id, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
    h as (select page_id, rest, regexp_extract(rest, '^[^/?#]*') as raw_host from u),
    hp as (select page_id, translate(raw_host, '{_UPPER}', '{_LOWER}') as host, regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') as path from h),
    seen as (select *, case{cases['rule']} end as rule, case{cases['ruled']} end as ruled,
        list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: case when regexp_matches(s, '[0-9]') then '*' || regexp_extract(s, '\\.[A-Za-z]+$') else s end) as raw from hp),
    t0 as (select host, raw, case when len(raw) > {levels} then error('a path is deeper than this SQL') else raw end as t, count(*) as n, count(ruled) as labelled, count(*) filter (where ruled = 'block') as blocked from seen group by all),
    {','.join(steps)},
    oh as (select host, sum(n) as hn, sum(labelled) as hl, sum(blocked) as hb from {last} group by host),
    lv as (select host, t, sum(labelled) as tl, sum(blocked) as tb from {last} group by all),
    jd as (select host, t, round((tb + {o.strength}e0 * ((hb + {o.coverage}e0 * greatest(hn, hl) * {o.prior}e0) / (hl + {o.coverage}e0 * greatest(hn, hl)))) / (tl + {o.strength}e0), 9) as purity from lv join oh using (host))
    select page_id, host, path, rule, coalesce(ruled, case when purity >= {o.threshold}e0 then 'block' else 'allow' end) as verdict, '/' || array_to_string(t, '/') as template, purity
    from seen join {last} using (host, raw) join jd using (host, t)"""
