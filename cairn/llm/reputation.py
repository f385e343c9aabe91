"""URL filter: explicit rules first, then an empirical-Bayes host reputation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import split_join, table

#: Bounds that are tried are multiples of 1 / STEPS.
STEPS = 50
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MAX_RULES = 1000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def suffix_and_domain(host: Column, suffixes: tuple[str, ...]) -> tuple[Column, Column]:
    """Suffix and the registered domain, a label more.

    The suffix is the last label, or the longest of ``suffixes`` that fits: the entries of
    several labels of a public suffix list, which the caller brings along.
    """
    labels = F.split(host, "\\.")
    last = lambda k: F.array_join(F.slice(labels, F.greatest(F.size(labels) - k + 1, F.lit(1)), k), ".")
    deep = sorted({s.count(".") + 1 for s in suffixes}, reverse=True)
    size = reduce(lambda c, k: c.when(last(k).isin([s for s in suffixes if s.count(".") + 1 == k]), F.lit(k)), deep, F.when(F.lit(False), F.lit(1))).otherwise(F.lit(1))
    return last(size), last(size + 1)


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest (verdict, host, path) rule that fits, as (rule, verdict); nulls if none does.

    Of equally long ones that with the longer host wins, of equal ones ``allow``.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    rule = verdict = None
    for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = (F.when(fits, h + p), F.when(fits, v)) if rule is None else (rule.when(fits, h + p), verdict.when(fits, v))
    if rule is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return rule, verdict


def _strengths(children: DataFrame, labelled: dict[int, int]) -> Column:
    """Strength of the beta priors of one level in each fold, by the method of moments over its children.

    A child has n labelled pages, k bad ones and the shrunk rate m of its parent. With priors of
    mean m and strength s, the n-weighted squared deviations from m sum to e + (v - e) / (s + 1)
    on average, where e sums m (1 - m) and v sums n m (1 - m). Clamped to 1 ... 1000; without
    spread beyond binomial noise it is 1000. No prior weighs more than all ``labelled`` pages
    that it is learned from, so without labels nothing is certain and nothing is blocked.
    """
    noise = F.col("m") * (1 - F.col("m"))
    sums = children.filter("n > 0").groupBy("fold").agg(F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - F.col("m"), 2)).alias("q"), F.sum(noise).alias("e"), F.sum(F.col("n") * noise).alias("v"))
    rows = {r["fold"]: r for r in sums.collect()}  # one for each fold
    strength = F.lit(1.0)
    for fold, n in labelled.items():
        r = rows.get(fold)
        found = (r["v"] - r["e"]) / (r["q"] - r["e"]) - 1 if r is not None and r["q"] > r["e"] else 1000.0
        strength = F.when(F.col("fold") == fold, F.lit(max(1.0, min(1000.0, float(n), found)))).otherwise(strength)
    return strength


def host_reputation(hosts: DataFrame, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """``hosts`` (fold, host, n labelled, k bad and more) with the posterior (a, b) of each host's bad-page rate.

    Suffix rates are shrunk to the corpus rate, domains to their suffix, hosts to their domain,
    each level with a beta prior whose strength that level's own spread decides, and that is
    weaker where the parent's rate rests on few pages itself. Hosts without labels keep the rate
    of what is above them, and its uncertainty. Each fold is learned by itself; only three sums
    a level and fold come to the driver.
    """
    suffix, domain = suffix_and_domain(F.col("host"), suffixes)
    h = table(hosts.withColumns({"suffix": suffix, "domain": domain, "n": F.coalesce("n", F.lit(0)), "k": F.coalesce("k", F.lit(0))}), "hosts")
    sums = [F.sum("n").alias("n"), F.sum("k").alias("k")]
    d = h.groupBy("fold", "suffix", "domain").agg(*sums)
    s = d.groupBy("fold", "suffix").agg(*sums)
    whole = {r["fold"]: r for r in h.groupBy("fold").agg(*sums).collect()}
    labelled = {fold: r["n"] for fold, r in whole.items()}

    def prior(children: DataFrame) -> Column:
        """1 / weight is 1 / strength of the level and 1 / pages (and prior) behind the parent's rate."""
        strength = _strengths(children, labelled)
        return strength * F.col("p") / (strength + F.col("p"))

    def shrunk(children: DataFrame, *names: str) -> DataFrame:
        t = prior(children)
        return children.select(*names, ((t * F.col("m") + F.col("k")) / (t + F.col("n"))).alias("m"), (t + F.col("n")).alias("p"))

    mean = pages = F.lit(0.0)
    for fold, r in whole.items():
        mean = F.when(F.col("fold") == fold, F.lit((r["k"] + 1) / (r["n"] + 2))).otherwise(mean)
        pages = F.when(F.col("fold") == fold, F.lit(r["n"] + 2.0)).otherwise(pages)
    s = shrunk(s.withColumns({"m": mean, "p": pages}), "fold", "suffix")
    d = shrunk(split_join(d, s, ["fold", "suffix"]), "fold", "suffix", "domain")
    h = split_join(h, d, ["fold", "suffix", "domain"])
    t = prior(h)
    return h.withColumns({"a": t * F.col("m") + F.col("k"), "b": t * (1 - F.col("m")) + F.col("n") - F.col("k")}).drop("m", "p")


def choose_bound(judged: DataFrame, miss_cost: float) -> float:
    """The bound of least loss over labelled pages that the posterior (``bad_bound``) hasn't seen.

    ``judged`` has host, bad_bound, and other_n and other_k, labelled and bad pages of the half
    not learned from. A good page that is blocked costs 1, a bad one let through ``miss_cost``.
    Of equal bounds the highest is taken, so what nothing speaks for isn't blocked.
    """
    step = F.greatest(F.lit(0), F.least(F.lit(STEPS), F.ceil(F.col("bad_bound") * STEPS)))  # blocked at all lower multiples
    rows = judged.filter("host != ''").groupBy(step.alias("step")).agg(F.sum(F.col("other_n") - F.col("other_k")).alias("good"), F.sum("other_k").alias("bad")).collect()
    loss = [sum(r["good"] if r["step"] > j else miss_cost * r["bad"] for r in rows) for j in range(STEPS + 1)]
    return max(j for j in range(STEPS + 1) if loss[j] == min(loss)) / STEPS


def filter_urls(
    pages: DataFrame,
    outcomes: DataFrame | None,
    rules: list[tuple[str, str, str]],
    key: str = "page_id",
    suffixes: tuple[str, ...] = (),
    max_bad: float | None = None,
    miss_cost: float = 1.0,
    z: float = 2.326,
) -> DataFrame:
    """Judge every url: the longest fitting rule, else the host's reputation.

    ``outcomes`` has (key, bad 0/1) for labelled pages; of several for a page the worst holds,
    null ones don't count. A host is blocked if even the lower posterior bound of its bad-page
    rate, ``z`` standard deviations under the mean, exceeds ``max_bad``. Where that isn't given
    it is learned: the labelled pages are halved by their keys' hash, each half gives posteriors
    that are held against the other one (:func:`choose_bound`).

    Adds host, path, rule, verdict, bad_rate and bad_bound to the columns of ``pages``; columns
    of ``pages`` of these names give way. Urls that are null or have no ``://`` share the empty
    host, which is never blocked. Repeated rows are judged each. An empty table gives an empty
    one.
    """
    made = ("host", "path", "rule", "verdict", "bad_rate", "bad_bound")
    kept = [c for c in pages.columns if c not in made]
    host, path = host_and_path(F.col("url"))
    seen = pages.select(host.alias("host"), F.col(key).alias("__key"))
    if outcomes is None:
        seen = seen.withColumn("bad", F.lit(None).cast("int"))
    else:
        known = outcomes.groupBy(F.col(key).alias("__key")).agg(F.max("bad").cast("int").alias("bad"))
        seen = split_join(seen, known, ["__key"], "left")
    first = F.substring(F.md5(F.coalesce(F.col("__key").cast("string"), F.lit(""))), 1, 1) < "8"
    half = lambda own: [F.count(F.when(own, F.col("bad"))), F.coalesce(F.sum(F.when(own, F.col("bad"))), F.lit(0))]
    (n0, k0), (n1, k1) = half(first), half(~first)
    counts = seen.groupBy("host").agg(n0.alias("n0"), k0.alias("k0"), n1.alias("n1"), k1.alias("k1"))
    fold = lambda i, n, k, m, l: F.struct(F.lit(i).alias("fold"), F.expr(n).alias("n"), F.expr(k).alias("k"), F.expr(m).alias("other_n"), F.expr(l).alias("other_k"))
    folds = F.array(fold(0, "n0", "k0", "n1", "k1"), fold(1, "n1", "k1", "n0", "k0"), fold(2, "n0 + n1", "k0 + k1", "0L", "0L"))
    hosts = counts.select("host", F.explode(folds).alias("x")).select("host", "x.*")
    mean = F.col("a") / (F.col("a") + F.col("b"))
    bound = mean - z * F.sqrt(mean * (1 - mean) / (F.col("a") + F.col("b") + 1))
    judged = table(host_reputation(hosts, suffixes).select("fold", "host", "other_n", "other_k", mean.alias("bad_rate"), bound.alias("bad_bound")), "reputation")
    most = choose_bound(judged.filter("fold < 2"), miss_cost) if max_bad is None else max_bad
    known = judged.filter("fold = 2").select("host", "bad_rate", "bad_bound")
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    own = F.when((F.col("bad_bound") > most) & (F.col("host") != ""), "block").otherwise("allow")
    urls = split_join(pages.select(*kept, host.alias("host"), path.alias("path")), known, ["host"], "left")
    return urls.select(*kept, "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "bad_rate", "bad_bound")
