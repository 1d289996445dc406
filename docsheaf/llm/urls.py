"""URL filters with link-graph propagation.

Rules decide the urls they fit.  The rest is decided per host by two propagations over the host
graph: personalised PageRank from trusted seeds along the links (what trusted hosts link to is
trusted), and the reverse, distrust from blocked seeds against the links (who links to blocked hosts
is distrusted).  A host is blocked when its distrust is over THRESHOLD of both together; a host that
neither reaches is allowed.

Edges: absolute ``href`` and ``src`` links between hosts, each pair counted once per page, and with
``siblings`` an edge both ways between a host and its parent domain, since sub-domains of one owner
mostly share what they publish.  Seeds weigh with the pages of the host that a rule decided.

Edges are summed per pair of hosts before they are shuffled, and every iteration moves only one
row per edge.  Both propagations run together until no host's score changes by more than TOLERANCE of
itself, so hosts at any distance are reached and scored, far ones as exactly as near ones; each is cut, and a check
follows every cycle.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is
allowed; a null html has no links; repeated rows each get a verdict; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsheaf.llm.shared import cut

#: (action, host and path); fixed by the query's contract.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
DAMPING, THRESHOLD = 0.85, 0.5
#: Relative change at which propagation ends; iterations in a cycle; scores that count as none, so that it ends.
TOLERANCE, CYCLE, FLOOR = 1e-8, 4, 1e-300
#: A guard that is not met: after some 4,400 iterations damping leaves no change over FLOOR.
ITERATIONS = 10_000
LINK = r"""(?i)(?:href|src)\s*=\s*["']?(?:https?:)?//([^/?#"'\s<>]+)"""


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end; path: then up to ``?``, ``#`` or the end."""
    url = F.coalesce(url, F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return lower_ascii(F.regexp_extract(url, pattern, 1)), F.regexp_extract(url, pattern, 2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (null if none) and its action; the rules become one CASE, longest first."""
    text, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        domain, slash, tail = rule.partition("/")
        fits = ((host == domain) | F.endswith(host, F.lit("." + domain))) & F.startswith(path, F.lit(slash + tail))
        text, action = F.when(fits, F.lit(rule)).otherwise(text), F.when(fits, F.lit(act)).otherwise(action)
    return text, action


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, action, html."""
    host, path = host_and_path(F.col("url"))
    df = pages.select("page_id", host.alias("host"), path.alias("path"), "html")
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    return df.withColumn("rule", rule).withColumn("action", action)


def host_edges(pages: DataFrame, siblings: bool = False) -> DataFrame:
    """(src, dst, weight) between different hosts, from judged pages."""
    targets = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(F.col("html"), F.lit("")), F.lit(LINK), F.lit(1)), lower_ascii))
    links = pages.select(F.col("host").alias("src"), F.explode(targets).alias("dst")).filter("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    if not siblings:
        return links
    parent = F.regexp_extract("host", r"^[^.]+\.((?:[^.]+\.)+[^.]+)$", 1)
    hosts = pages.select("host").distinct().withColumn("parent", parent).filter("parent <> ''")
    both = hosts.select(F.explode(F.array(F.struct(F.col("host").alias("src"), F.col("parent").alias("dst")), F.struct(F.col("parent").alias("src"), F.col("host").alias("dst")))).alias("e")).select("e.*", F.lit(1.0).alias("weight"))
    return links.unionByName(both).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, iterations: int = ITERATIONS, damping: float = DAMPING, tolerance: float = TOLERANCE, by: tuple[str, ...] = ()) -> DataFrame:
    """Personalised PageRank: (host, score) from seeds (host, weight) along edges (src, dst, weight), until it converges.

    Columns ``by`` of both tables set apart graphs that share no score; they lead the result.  Edges and hosts are dealt
    by host once; so are the scores that an iteration sums, and its one shuffle is that of the shares to their targets.

    After cycles 1, 2, 4, 8, ... of iterations the scores go on from that combination of them whose change is smallest (reduced rank
    extrapolation), for which the products of the changes, some sums per graph, come to the driver.  The iteration has one
    fixed point, whatever it goes on from, the stretches without such a step grow, and it only ends when a plain cycle
    changes nothing.
    """
    keys = [*by, "host"]
    out = edges.groupBy(*by, "src").agg(F.sum("weight").alias("out"))
    share = (F.col("weight") / F.col("out") * damping).alias("share")
    steps = cut(edges.join(out, [*by, "src"]).select(*by, F.col("src").alias("host"), "dst", share).repartition(*keys))
    start = seeds.groupBy(*keys).agg(F.sum("weight").alias("weight"))
    total = start.groupBy(*by).agg(F.sum("weight").alias("total"))
    start = (start.join(total, list(by)) if by else start.crossJoin(total)).select(*keys, F.when(F.col("total") != 0, F.col("weight") / F.col("total")).otherwise(F.col("weight")).alias("seed"))
    ends = edges.select(*by, F.explode(F.array("src", "dst")).alias("host"))
    every = ends.select(*keys, F.lit(0.0).alias("seed")).unionByName(start).groupBy(*keys).agg(F.max("seed").alias("seed"))
    hosts = cut(every.repartition(*keys))
    names = [f"x{k}" for k in range(CYCLE + 1)]
    scores, done = hosts.withColumn(names[0], F.col("seed")), 0
    while done < iterations:
        for now, then in zip(names[:-1], names[1:], strict=True):
            moved = scores.join(steps, keys).select(*by, F.col("dst").alias("host"), (F.col(now) * F.col("share")).alias("moved")).groupBy(*keys).agg(F.sum("moved").alias("moved"))
            scores = cut(scores.join(moved, keys, "left").withColumn(then, F.col("seed") * (1 - damping) + F.coalesce("moved", F.lit(0.0))).drop("moved"))
        done += CYCLE
        first, last = F.col(names[0]), F.col(names[CYCLE])
        steps_of = [F.col(names[k + 1]) - F.col(names[k]) for k in range(CYCLE)]
        products = [F.sum(steps_of[i] * steps_of[j]).alias(f"g{i}{j}") for i in range(CYCLE) for j in range(i + 1)]
        groups = scores.groupBy(*by).agg(F.max(F.abs(last - first) / F.greatest(F.abs(last), F.abs(first), F.lit(FLOOR))).alias("change"), *products).collect()
        if not groups or max(g["change"] or 0.0 for g in groups) <= tolerance:
            return scores.filter(last > 0).select(*keys, last.alias("score"))
        ahead, cycle = last, done // CYCLE
        for g in groups if cycle & (cycle - 1) == 0 else []:
            own = F.lit(True)
            for b in by:
                own = own & F.col(b).eqNullSafe(F.lit(g[b]))
            if weights := extrapolation([[g[f"g{max(i, j)}{min(i, j)}"] for j in range(CYCLE)] for i in range(CYCLE)]):
                ahead = F.when(own, sum((F.lit(w) * F.col(n) for w, n in zip(weights, names[1:], strict=True)), F.lit(0.0))).otherwise(ahead)
        scores = scores.select(*keys, "seed", ahead.alias(names[0]))
    return scores.filter(F.col(names[0]) > 0).select(*keys, F.col(names[0]).alias("score"))


def extrapolation(gram: list[list[float]]) -> list[float] | None:
    """Weights, of sum 1, of a cycle's scores whose combined change is smallest, from the products of their changes.

    None where the last plain scores are as good.
    """
    scale = sum(gram[k][k] for k in range(CYCLE))
    if not scale > 0:
        return None
    rows = [[gram[i][j] / scale + (1e-14 if i == j else 0.0) for j in range(CYCLE)] + [1.0] for i in range(CYCLE)]
    for i in range(CYCLE):
        pivot = max(range(i, CYCLE), key=lambda r: abs(rows[r][i]))
        rows[i], rows[pivot] = rows[pivot], rows[i]
        if rows[i][i] == 0:
            return None
        for r in range(CYCLE):
            if r != i:
                rows[r] = [x - rows[r][i] / rows[i][i] * y for x, y in zip(rows[r], rows[i], strict=True)]
    raw = [rows[i][CYCLE] / rows[i][i] for i in range(CYCLE)]
    if not sum(raw):
        return None
    weights = [x / sum(raw) for x in raw]
    left = sum(weights[i] * weights[j] * gram[i][j] for i in range(CYCLE) for j in range(CYCLE))
    return weights if left < gram[CYCLE - 1][CYCLE - 1] else None


def host_verdicts(pages: DataFrame, siblings: bool = False, threshold: float = THRESHOLD) -> DataFrame:
    """(host, trust, distrust, host_verdict) of every host that either propagation reached, from judged pages."""
    edges = cut(host_edges(pages, siblings))
    seeds = cut(pages.filter("action is not null and host <> ''").groupBy("host", "action").agg(F.count("*").cast("double").alias("weight")))
    back = edges.select(F.lit("block").alias("action"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    score = propagate(edges.withColumn("action", F.lit("allow")).unionByName(back), seeds, by=("action",))
    trust, distrust = (score.filter(F.col("action") == a).drop("action") for a in ("allow", "block"))
    both = trust.withColumnRenamed("score", "trust").join(distrust.withColumnRenamed("score", "distrust"), "host", "full").fillna(0.0, ["trust", "distrust"])
    blocked = F.col("distrust") > threshold * (F.col("trust") + F.col("distrust"))
    return both.withColumn("host_verdict", F.when(blocked, "block").otherwise("allow"))


def filter_urls(pages: DataFrame, rules=RULES, siblings: bool = False, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust of the host for every page."""
    rows = judged(pages, rules)
    hosts = cut(host_verdicts(rows, siblings, threshold))
    verdict = F.coalesce("action", "host_verdict", F.lit("allow"))
    return rows.drop("html").join(hosts, "host", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), "trust", "distrust")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: judges every page.  Its pages link to no other host, so parent domains give the graph its edges."""
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), siblings=True)
