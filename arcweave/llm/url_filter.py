"""URL filters: rules by host and path, then empirical-Bayes reputation of hosts.

Every function is built of DataFrame expressions. Null urls and urls without "://" have an empty host and path and fit no
rule. Repeated rows give repeated results. An empty table gives no rows; without any labelled page the reputation is the
prior alone. Other columns, whatever their names, play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcweave.llm.common import written

#: Suffixes of two labels; any other host's suffix is its last label. A parameter of ``levels``.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz", "co.in")
#: A prior is worth so many pages of its parent's rate at most, and that many if a level's outcomes show no spread: a host's
#: own pages always come to count.
MAX_STRENGTH = 50.0
#: A prior is worth so many pages at least: one page alone never speaks against its host.
MIN_STRENGTH = 4.0
#: A host is blocked if the lower bound of its bad rate (posterior mean less Z deviations, the normal approximation of the
#: beta's lower tenth) is above the limit: MAX_BAD, or without one the overall rate of all labelled pages.
Z, MAX_BAD = 1.282, None
#: Tasks that share a host's pages in the join.
SALTS = 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits, nulls if none does. Rules: ("example.com/en/", "allow" or "block").

    A rule fits its host and all subdomains if the path starts with the rule's path. Of equally long rules the first in
    alphabetical order wins. The rules are few and become one expression.
    """
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, act in sorted(rules, key=lambda r: (len(r[0]), [-ord(c) for c in r[0]])):
        at = text.find("/")
        h, p = (text, "") if at < 0 else (text[:at], text[at:])
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, action = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(act)).otherwise(action)
    return rule, action


def levels(host: Column, two_label_suffixes: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> dict[str, Column]:
    """host without port, its registered domain (suffix and one label more) and its suffix; an address is its own domain."""
    name = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":\d*$", "")
    last2, last3 = F.substring_index(name, ".", -2), F.substring_index(name, ".", -3)
    two = last2.isin(*two_label_suffixes) if two_label_suffixes else F.lit(False)
    address = name.rlike(r"^\d+(\.\d+){3}$|^\[")
    return {
        "h": name,
        "d": F.when(address, name).when(two, last3).otherwise(last2),
        "s": F.when(address, name).when(two, last2).otherwise(F.substring_index(name, ".", -1)),
    }


def strength(rows: DataFrame) -> float:
    """k of a level's prior from its rows (n, bad, parent's mean m), by the method of moments: one row comes back."""
    q = F.col("m") * (1 - F.col("m"))
    ss, inside, scale = rows.agg(
        F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("m"), 2)), F.sum(q), F.sum(F.col("n") * q)
    ).first()
    # E[ss] = sum q (1 + (n - 1) / (k + 1)), so 1 / (k + 1) = (ss - sum q) / (sum n q - sum q)
    if ss is None or scale <= inside:
        return MAX_STRENGTH
    r = (ss - inside) / (scale - inside)
    return max(1 / min(r, 0.999) - 1, MIN_STRENGTH) if r > 1 / (MAX_STRENGTH + 1) else MAX_STRENGTH


def reputation(outcomes: DataFrame, suffixes: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """Posterior bad rate of each labelled host. outcomes: host (string), bad (0 or 1), one row per labelled page.

    Counts per host come first, so a host with very many pages is one row from there on; they and each level's posteriors
    are written to the shared folder, which keeps the plans short. Each level's prior is Beta(m * k, (1 - m) * k): m is the
    posterior mean of the level above (suffixes: the overall rate), k comes from the spread of the level's rates around m.
    Returns h, d, s, n, overall (the overall rate) and the posterior's a and b at each level: host a_h, b_h; domain a_d,
    b_d; suffix a_s, b_s.
    """
    at = levels(F.col("host"), suffixes)
    by_h = outcomes.where("bad is not null").groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("double")).alias("bad"))
    by_h = by_h.select(*[c.alias(k) for k, c in at.items()], "n", "bad").groupBy("h", "d", "s").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    by_h = written(by_h, "hosts")
    by_d = by_h.groupBy("d", "s").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    by_s = by_d.groupBy("s").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    n, bad = by_h.agg(F.sum("n"), F.sum("bad")).first()

    def posterior(placed: DataFrame, tag: str) -> DataFrame:
        """The rows with their posterior (a_tag, b_tag) and its mean m, under a prior around their parents' m."""
        k = F.lit(strength(placed))
        a, b = F.col("m") * k + F.col("bad"), (1 - F.col("m")) * k + F.col("n") - F.col("bad")
        out = placed.withColumns({f"a_{tag}": a, f"b_{tag}": b}).withColumn("m", F.col(f"a_{tag}") / (F.col(f"a_{tag}") + F.col(f"b_{tag}")))
        return written(out, f"posterior-{tag}")

    overall = F.lit(((bad or 0.0) + 1) / ((n or 0) + 2))
    s = posterior(by_s.withColumn("m", overall), "s").drop("n", "bad")
    d = posterior(by_d.join(s, "s"), "d").drop("n", "bad")
    return posterior(by_h.join(d, ["d", "s"]), "h").drop("m", "bad").withColumn("overall", overall)


def lower_bound(a: Column, b: Column, z: float = Z) -> Column:
    return a / (a + b) - z * F.sqrt(a * b / (F.pow(a + b, 2) * (a + b + 1)))


def limit(max_bad: float | None) -> Column:
    return F.col("overall") if max_bad is None else F.lit(max_bad)


def blocked_hosts(outcomes: DataFrame, z: float = Z, max_bad: float | None = MAX_BAD) -> DataFrame:
    """Hosts (column h) whose bad rate has a posterior lower bound above the limit."""
    return reputation(outcomes).where(lower_bound(F.col("a_h"), F.col("b_h"), z) > limit(max_bad)).select("h").distinct()


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", z: float = Z, max_bad: float | None = MAX_BAD, suffixes: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """id, host, path, rule, verdict, ``bad_bound`` (the lower bound that judges the host; null without any) and ``by``
    (rule or reputation) of every page.

    Outcomes: host, bad. A host without labelled pages takes its domain's posterior, else its suffix's, else is allowed.
    Verdicts are made once per distinct host (found by a combined aggregation) and joined to the pages by host and salt, so
    that a host of very many pages is no task of its own.
    """
    src = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rule, action = fitting_rule(F.col("host"), F.col("path"), rules)
    src = src.withColumns({"rule": rule, "action": action})
    rep = reputation(outcomes, suffixes)
    top = limit(max_bad)
    bound = lambda t: F.struct(lower_bound(F.col(f"a_{t}"), F.col(f"b_{t}"), z).alias("at"), top.alias("top"))
    h_bad = rep.select("h", bound("h").alias("h_bad"))
    d_bad = rep.groupBy("d").agg(F.max(bound("d")).alias("d_bad"))
    s_bad = rep.groupBy("s").agg(F.max(bound("s")).alias("s_bad"))
    hosts = src.select("host").distinct().withColumns(levels(F.col("host"), suffixes))
    hosts = hosts.join(h_bad, "h", "left").join(d_bad, "d", "left").join(s_bad, "s", "left").withColumn("judged", F.coalesce("h_bad", "d_bad", "s_bad"))
    method = F.when(F.col("judged.at") > F.col("judged.top"), "block").otherwise("allow")
    # a host's pages are dealt to SALTS tasks by their id, its verdict is copied to all of them
    salted = hosts.select("host", method.alias("method"), F.col("judged.at").alias("bad_bound"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    out = src.withColumn("salt", F.pmod(F.hash("id"), F.lit(SALTS))).join(salted, ["host", "salt"])
    return out.select(
        F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("action", "method").alias("verdict"), "bad_bound", F.when(F.col("rule").isNotNull(), "rule").otherwise("reputation").alias("by")
    )
