"""URL filters: dated list entries as validity intervals, and an as-of join of captures against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERIOD = 30 * 86400  # seconds of a join period


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, an IPv6 address with its brackets, without user, port and dots at its end."""
    host = F.regexp_extract(F.lower(url), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/@?#]*@)?(\[[^\]/?#]*\]|[^/:?#]+)", 1)
    return F.regexp_replace(host, "[.]+$", "")


def intervals(entries: DataFrame) -> DataFrame:
    """pattern, action, valid_from, valid_to of each list entry: it holds until the pattern's next entry.

    Patterns are taken in lower case and without dots at the end of the host.  Of entries of one pattern and moment
    the last by action holds, so repeated entries count once.  The action 'clear' ends an entry and is none.  Entries
    with a null pattern, action or date are ignored; without entries there are no intervals.
    """
    pattern = F.regexp_replace(F.lower("pattern"), "^([^/]*[^/.])[.]+(?=/|$)", "$1")
    e = entries.select(pattern.alias("pattern"), "action", F.col("listed_at").cast("timestamp").alias("at"))
    e = e.filter("pattern IS NOT NULL AND action IS NOT NULL AND at IS NOT NULL").groupBy("pattern", "at").agg(F.max("action").alias("action"))
    e = e.withColumn("valid_to", F.lead("at").over(Window.partitionBy("pattern").orderBy("at")))
    return e.filter("action <> 'clear'").select("pattern", "action", F.col("at").alias("valid_from"), "valid_to")


def url_keys(url: str = "url") -> Column:
    """Patterns that can cover a URL: its host and the domains above it (of an IP address only itself), and the host
    with each path prefix."""
    return F.transform(F.array(F.struct(host_of(F.col(url)).alias("host"), F.col(url).alias("url"))), _keys)[0]


def _keys(x: Column) -> Column:
    labels = F.when(x["host"].rlike(r"^([0-9.]*|\[.*)$"), F.array(x["host"])).otherwise(F.split(x["host"], "[.]"))
    at = F.sequence(F.lit(1), F.size(labels))
    domains = F.transform(at, lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parts = F.filter(F.split(F.regexp_extract(F.lower(x["url"]), "^(?:[a-z][a-z0-9+.-]*:)?//[^/?#]*([^?#]*)", 1), "/"), lambda p: p != "")
    paths = F.transform(F.array(parts), lambda ps: F.transform(F.filter(F.sequence(F.lit(0), F.size(ps)), lambda j: j > 0), lambda j: F.concat_ws("/", x["host"], F.slice(ps, F.lit(1), j))))[0]
    return F.filter(F.concat(domains, paths), lambda k: (k != "") & (x["host"] != ""))


def url_filter(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """What the lists said of every capture when it was fetched.

    captures: page_id, url, fetched_at.  entries: pattern (a domain, or host/path), action ('block', 'allow' or
    'clear'), listed_at.  Of the entries active at fetch time the longest pattern decides.  A domain, of one label
    too, covers its subdomains, an IP address only itself, host/path what lies below it.

    The as-of join is an equi-join on (pattern, period of 30 days): an interval is put in each period that it meets,
    so a pattern with a long history, or a hot one, meets only entries of the capture's period.  Only page_id, url
    and fetched_at are read; Spark broadcasts the entries if they are small.

    Result: page_id, url, fetched_at, verdict ('block', 'allow' or 'none'), pattern (null without a match).
    Captures with a null or unreadable URL, or without fetch time, get 'none'.  Equal captures count once.
    Intervals contain their start and not their end.  Empty tables give no rows, or 'none' throughout without
    entries.  Other columns are ignored, whatever their names.
    """
    c = captures.select("page_id", "url", F.col("fetched_at").cast("timestamp").alias("fetched_at"))
    last = c.agg(F.max("fetched_at").alias("last"))
    first, end = F.unix_timestamp("valid_from"), F.unix_timestamp(F.least(F.coalesce("valid_to", "last"), "last"))
    spans = intervals(entries).crossJoin(F.broadcast(last)).filter("valid_from <= last")
    spans = spans.withColumn("period", F.explode(F.sequence(F.floor(first / PERIOD), F.greatest(F.floor(first / PERIOD), F.floor(end / PERIOD)))))
    keyed = c.select("*", F.explode_outer(url_keys()).alias("pattern"), F.floor(F.unix_timestamp("fetched_at") / PERIOD).alias("period"))
    hit = F.expr("valid_from <= fetched_at AND (valid_to IS NULL OR fetched_at < valid_to)")
    found = keyed.join(spans, ["pattern", "period"], "left").withColumn("hit", F.when(hit, F.struct(F.length("pattern").alias("n"), "pattern", "action")))
    best = found.groupBy("page_id", "url", "fetched_at").agg(F.max("hit").alias("best"))
    return best.select("page_id", "url", "fetched_at", F.coalesce("best.action", F.lit("none")).alias("verdict"), F.col("best.pattern").alias("pattern"))
