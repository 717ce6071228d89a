"""URL filters by a temporal list join, in DataFrame functions only.

Dated list entries (list, domain, on_date, action add|remove) become validity intervals [from_date, to_date); every
capture is held against the entries that were active when it was fetched, for its host and each parent domain.

Defined cases: a null or host-less URL, or a null fetch date, matches nothing and is kept; a capture without a page_id is
judged like any other; of several entries for one
(list, domain, date) a removal wins; adding twice keeps the entry active; repeated captures stay repeated; an empty list
blocks nothing; other columns of the inputs are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import salted_left_join

#: Allow-lists outrank block-lists when they name the same or a longer domain.
ALLOW = "allow"
#: Intervals are cut at so many days, so that no host gathers all its captures under one join key.
BUCKET_DAYS = 32
OPEN_END = "9999-12-31"


def host_of(url):
    """Lower-case host without user, port and final dot; null where there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    return F.nullif(F.regexp_replace(host, r"\.+$", ""), F.lit(""))


def with_domains(rows: DataFrame, host: str = "host") -> DataFrame:
    """One row for the host and each parent domain of two labels or more (as `domain`)."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    cuts = F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)))
    return rows.withColumn("domain", F.explode(F.transform(cuts, lambda i: F.array_join(F.slice(labels, i, n), "."))))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(list, domain, from_date, to_date) of dated entries; to_date is the next entry's date, or open."""
    daily = entries.groupBy("list", "domain", "on_date").agg(F.max((F.col("action") == "remove").cast("int")).alias("gone"))
    after = Window.partitionBy("list", "domain").orderBy("on_date")
    return (
        daily.withColumn("to_date", F.coalesce(F.lead("on_date").over(after), F.lit(OPEN_END).cast("date")))
        .where("gone = 0").select("list", "domain", F.col("on_date").alias("from_date"), "to_date")
    )


def bucket_of(day):
    return F.floor(F.datediff(day, F.lit("1970-01-01").cast("date")) / BUCKET_DAYS)


def temporal_list_join(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures(page_id, url, fetched_on) with host, n_active, matched_list, matched_domain and blocked.

    The longest matching domain decides; of the same domain, an allow-list, then the list's name. Entries count if
    from_date <= fetched_on < to_date.
    """
    seen = captures.select("page_id", "url", "fetched_on").withColumn("host", host_of(F.col("url")))
    # What decides is the host and the day: each pair is looked up once, whatever rows and ids have it.
    keys = ["host", "fetched_on"]
    probes = with_domains(seen.where("host IS NOT NULL AND fetched_on IS NOT NULL").select(*keys).distinct()).withColumn("bucket", bucket_of(F.col("fetched_on")))
    # Two scalars: open intervals are cut into buckets only as far as there are captures.
    first, last = (F.lit(d).cast("date") for d in captures.agg(F.min("fetched_on"), F.max("fetched_on")).first())
    spans = validity_intervals(entries).where((F.col("from_date") <= last) & (F.col("to_date") > first))
    spans = spans.withColumn("bucket", F.explode(F.sequence(bucket_of(F.greatest("from_date", first)), bucket_of(F.least(F.date_sub("to_date", 1), last)))))
    # A domain with a third of all hosts, or a host with a third of all captures, is one key: both joins are spread.
    at, day = F.concat_ws(" ", "bucket", "domain"), F.concat_ws(" ", F.col("fetched_on").cast("string"), "host")
    hits = salted_left_join(probes.select(*keys, "domain", at.alias("_at")), spans.select(at.alias("_at"), "list", "from_date", "to_date"), "_at")
    hits = hits.where("from_date <= fetched_on AND fetched_on < to_date")
    rank = F.struct(F.length("domain"), F.when(F.col("list") == ALLOW, 1).otherwise(0), F.col("list"))
    best = hits.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_active"), F.max_by("list", rank).alias("matched_list"), F.max_by("domain", rank).alias("matched_domain")
    )
    best = best.select(day.alias("_day"), "n_active", "matched_list", "matched_domain")
    rows = salted_left_join(seen.withColumn("_day", F.when(F.col("fetched_on").isNotNull() & F.col("host").isNotNull(), day)), best, "_day").drop("_day")
    return rows.withColumn("n_active", F.coalesce("n_active", F.lit(0).cast("long"))).withColumn("blocked", F.coalesce(F.col("matched_list") != ALLOW, F.lit(False)))
